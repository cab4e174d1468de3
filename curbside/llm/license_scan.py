"""Licence recognition by sentences and ordered rules.

A text is cut into sentences: end marks before white space, a colon at a line's end, blank lines (or lines of comment
marks) and list items end one; other line breaks are wraps. Each sentence is brought to a normal form (lower-case ASCII
letters and digits, one space between words) and looked up among known licence sentences; if it is not known, each of
its lines is, so that one-line notices between other lines are found too. The identifiers found, in text order, form a
sequence. Licence rules are tried in a fixed order: a rule whose identifier sequence occurs in it,
without other known sentences between, takes those sentences, and later rules see only what is left.

Everything is a DataFrame expression on the row itself: no shuffle, no Python on the executors. Only texts that
hold one of TRIGGERS are cut at all; every known sentence holds one, so nothing is missed.

Null and empty texts have no sentences and no licences; repeated rows are scanned one by one; very long texts are cut
whole. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import clean_ids, query, table

# What a notice says before the licence's name.
_SUBJECTS = ("", "this work is ", "this software is ", "this file is ", "this project is ", "this document is ", "this code is ", "this program is ", "the software is ", "all code is ")
_VERBS = ("licensed under", "released under", "distributed under", "available under", "published under", "made available under")
_TERMS = ("", "the terms of ")
# Licence names in normal form, by identifier.
_NAMES = {
    "Apache-2.0": ("apache license version 2 0", "apache license version 2 0 the license", "apache license 2 0", "apache 2 0"),
    "MIT": ("mit license", "mit licence"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3", "gpl v3"),
    "GPL-2.0": ("gnu general public license version 2", "gpl v2"),
    "LGPL-3.0": ("gnu lesser general public license version 3",),
    "AGPL-3.0": ("gnu affero general public license version 3",),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license"),
    "ISC": ("isc license",),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0",),
    "CC-BY-NC-4.0": ("cc by nc 4 0",),
    "CC0-1.0": ("cc0 1 0",),
}
# Sentences of licence texts in normal form, by sentence identifier, with their variants.
_GPL_TERMS = "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
_SENTENCES = {
    "rights": ("all rights reserved",),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ),
    "mit-condition": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit-warranty": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "the software is provided as is without warranty of any kind express or implied",
    ),
    "mit-liability": (
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
    ),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "isc-warranty": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "isc-liability": (
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    "bsd-grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "bsd-endorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "bsd-warranty": (
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness "
        "for a particular purpose are disclaimed",
    ),
    "bsd-liability": (
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
    ),
    "apache-comply": ("you may not use this file except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at http www apache org licenses license 2 0",),
    "apache-copy-at": ("you may obtain a copy of the license at",),
    "apache-address": ("http www apache org licenses license 2 0", "https www apache org licenses license 2 0"),
    "gpl-free": (
        f"this program is free software {_GPL_TERMS} either version 3 of the license or at your option any later version",
    ),
    "gpl-terms": (_GPL_TERMS,),
    "gpl-2-later": ("either version 2 of the license or at your option any later version",),
    "gpl-3-later": ("either version 3 of the license or at your option any later version",),
    "gpl-copy": ("you should have received a copy of the gnu general public license along with this program",),
    "mpl-terms": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
}
TRIGGERS = ("licen", "liab", "public domain", "rights", "permi", "warrant", "redistribut", "copyright", "released under", "distributed under", "available under", "published under")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENDS, _OTHER = r"[.!?;]+([\x20\x09-\x0D]|\z)", "[^a-z0-9]+"
_BREAK = "\x1e"  # between sentences, once they are cut
# What ends a sentence: list items first, as their numbers end in a mark. The last group is the letter that goes on.
_CUTS = (
    (r"\n[\x20\x09]*([*+-]|[0-9]{1,2}[.)]|\([0-9a-z]{1,2}\))[\x20\x09]+([A-Z])", 2), (r"\r?\n[\x20\x09*#/-]*\r?\n", 0), (r":[\x20\x09]*\r?\n", 0), (_ENDS, 0),
)


def known_sentences() -> dict[str, str]:
    """normal form -> sentence identifier."""
    found = {f"{s}{v} {t}{a}{n}": f"under:{k}" for k, names in _NAMES.items() for n in names for s, v, t, a in product(_SUBJECTS, _VERBS, _TERMS, ("", "the "))}
    found |= {f"spdx license identifier {n}": f"under:{k}" for k, names in _NAMES.items() for n in (*names, re.sub(_OTHER, " ", k.lower()))}
    return found | {v: k for k, variants in _SENTENCES.items() for v in variants}


# (licence, sentence identifiers), tried in this order: longer and more specific ones first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "isc-warranty", "isc-liability")),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-or-later", ("gpl-terms", "gpl-3-later")),
    ("GPL-2.0-or-later", ("gpl-terms", "gpl-2-later", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl-terms", "gpl-2-later")),
    ("Apache-2.0", ("under:Apache-2.0", "apache-comply", "apache-copy-at", "apache-address")),
    ("Apache-2.0", ("under:Apache-2.0", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("under:Apache-2.0", "apache-copy")),
    ("MPL-2.0", ("mpl-terms",)),
    ("Unlicense", ("unlicense",)),
    *((k, (f"under:{k}",)) for k in _NAMES),
    ("proprietary", ("rights",)),
)


def _sentences(text: Column) -> Column:
    """Sentences as they stand, wraps included."""
    for pattern, group in _CUTS:
        text = F.regexp_replace(text, pattern, f"{_BREAK}${group}" if group else _BREAK)
    return F.split(text, _BREAK)


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, _UPPER, _LOWER), _OTHER, " "))


def _has_trigger(text: Column) -> Column:
    low = F.translate(text, _UPPER, _LOWER)
    return reduce(lambda a, b: a | b, [low.contains(t) for t in TRIGGERS])


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: Sequence[tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids in text order, and licenses in rule order, comma-joined."""
    sentences = known_sentences() if sentences is None else sentences
    names = sorted(set(sentences.values()))
    by_name = F.create_map(*[F.lit(x) for n in names for x in (n, "|" + "|".join(sorted(k for k, v in sentences.items() if v == n)) + "|")])
    text = F.coalesce(F.col("text"), F.lit(""))
    known = lambda s: F.get(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: by_name[n].contains(F.concat(F.lit("|"), s, F.lit("|")))), F.lit(0))
    lines = lambda s: F.transform(F.filter(F.split(s, "\n"), _has_trigger), lambda x: known(_normal(x)))
    of = lambda s: F.flatten(F.transform(F.array(known(_normal(s))), lambda i: F.when(i.isNotNull(), F.array(i)).otherwise(lines(s))))
    ids = F.flatten(F.transform(F.filter(_sentences(text), _has_trigger), of))
    found = F.when(_has_trigger(text), F.filter(ids, lambda i: i.isNotNull())).otherwise(F.array().cast("array<string>"))
    out = clean_ids(docs, "doc_id", "text").select("doc_id", found.alias("ids"))
    left = F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(","))
    out = out.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), left.alias("left"), F.array().cast("array<string>").alias("hits"))
    return out.select("doc_id", "n_sentences", "sentence_ids", _matched(F.col("left"), rules).alias("licenses"))


def _matched(sequence: Column, rules: Sequence[tuple[str, tuple[str, ...]]]) -> Column:
    """Licences of the rules that take sentences, tried in order; one fold over the rules."""
    table_ = F.array(*[F.struct(F.lit(k).alias("k"), F.lit("".join(f",{i}," for i in ids)).alias("p")) for k, ids in rules])
    start = F.struct(sequence.alias("s"), F.array().cast("array<string>").alias("m"))
    step = lambda acc, r: F.when(
        acc["s"].contains(r["p"]), F.struct(F.replace(acc["s"], r["p"], F.lit(";")).alias("s"), F.array_append(acc["m"], r["k"]).alias("m"))
    ).otherwise(acc)
    return F.when(sequence == ",,", F.lit("")).otherwise(F.aggregate(table_, start, step, lambda acc: F.array_join(F.array_distinct(acc["m"]), ",")))


def _oracle() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in sorted(known_sentences().items()))
    steps, last = [], "ids"
    for i, (_, ids) in enumerate(RULES):
        pattern = "".join(f",{x}," for x in ids)
        steps.append(f"r{i} AS (SELECT * EXCLUDE (s, m), replace(s, '{pattern}', ';') AS s, CASE WHEN contains(s, '{pattern}') THEN list_append(m, '{RULES[i][0]}') ELSE m END AS m FROM {last})")
        last = f"r{i}"
    cut = "coalesce(text, '')"
    for pattern, group in _CUTS:
        cut = f"regexp_replace({cut}, '{pattern}', '{_BREAK}{f'{chr(92)}{group}' if group else ''}', 'g')"
    low = f"translate(s, '{_UPPER}', '{_LOWER}')"
    trigger = " OR ".join(f"contains({low}, '{t}')" for t in TRIGGERS)
    normal = f"trim(regexp_replace({low}, '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split({cut}, '{_BREAK}') AS ls FROM documents),
e AS (SELECT * FROM (SELECT r, generate_subscripts(ls, 1) AS pos, unnest(ls) AS s FROM d) WHERE {trigger}),
n AS (SELECT r, pos, s, id FROM (SELECT r, pos, s, {normal} AS sentence FROM e) LEFT JOIN known USING (sentence)),
l AS (SELECT r, pos, line, id FROM (SELECT r, pos, line, {normal} AS sentence FROM (SELECT r, pos, generate_subscripts(ls, 1) AS line, unnest(ls) AS s FROM (SELECT r, pos, string_split(s, chr(10)) AS ls FROM n WHERE id IS NULL))) JOIN known USING (sentence)),
f AS (SELECT r, list(id ORDER BY pos, line) AS found FROM (SELECT r, pos, 0 AS line, id FROM n WHERE id IS NOT NULL UNION ALL SELECT r, pos, line, id FROM l) GROUP BY r),
ids AS (SELECT doc_id, coalesce(len(found), 0)::BIGINT AS n_sentences, coalesce(array_to_string(found, ','), '') AS sentence_ids,
 ',' || coalesce(array_to_string(found, ',,'), '') || ',' AS s, []::VARCHAR[] AS m FROM d LEFT JOIN f USING (r)),
{', '.join(steps)}
SELECT doc_id, n_sentences, sentence_ids, array_to_string(list_transform(list_filter(list_zip(m, range(1, len(m) + 1)), lambda x: list_position(m, x[1]) = x[2]), lambda x: x[1]), ',') AS licenses FROM {last}"""


@query("op3_license_scan", _oracle())
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
