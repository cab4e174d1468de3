"""Quality rules as a short-circuit cascade.

Each rule looks at one document and may reject it. A sample of the documents gives every rule's cost
(seconds a document) and selectivity (share it rejects); rules then run in order of rejections per cost,
and the first one that rejects ends the work on that document. The order changes only the time: a document
is kept when no rule rejects it.

Null or empty texts have no words and are rejected as too short. Repeated rows are judged one by one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import DOCUMENT_COLUMNS, TEXTS, clean_ids, map_batches, query, table

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
CAPITALS = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
WINDOW = 5
SAMPLE_ROWS = 2000  # expected size of the sample that orders the rules


class Text:
    """One document with its counts, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes.split parts at \x20 and \x09-\x0D only

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points: bytes that do not continue a UTF-8 sequence."""
        kept = np.frombuffer(self.raw.translate(None, SPACES), np.uint8)
        return int(np.count_nonzero((kept & 0xC0) != 0x80))

    def count(self, which: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, which))

    @cached_property
    def n_symbols(self) -> int:
        return self.count(SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 5-word windows that occur twice or more in the text."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        ids: dict[bytes, int] = {}
        words = np.fromiter((ids.setdefault(w, len(ids)) for w in self.words), np.uint64, self.n_words)
        if len(ids) == self.n_words:
            return 0
        code, bound = words[:n], len(ids)
        for k in range(1, WINDOW):  # exact: codes are renumbered before they could overflow
            if bound * len(ids) >= 2**63:
                _, code = np.unique(code, return_inverse=True)
                code, bound = code.astype(np.uint64), n
            code, bound = code * np.uint64(len(ids)) + words[k : k + n], bound * len(ids)
        _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
        steps = np.zeros(self.n_words + 1, np.int64)
        starts = np.flatnonzero(counts[inverse] > 1)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + WINDOW, -1)
        return int(np.count_nonzero(np.cumsum(steps[:-1])))

    @property
    def base_failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


RULES: tuple[Rule, ...] = (
    Rule("too_short", lambda t: t.n_words < 10),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
    Rule("repeated_lines", lambda t: 100 * t.n_dup_lines > 30 * len(t.lines)),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("capitals", lambda t: 100 * t.count(CAPITALS) > 40 * t.word_chars),
    Rule("digits", lambda t: 100 * t.count(DIGITS) > 40 * t.word_chars),
    Rule("word_length", lambda t: t.word_chars > 20 * t.n_words or t.word_chars < 2 * t.n_words),
)


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> dict[str, tuple[float, float]]:
    """rule -> (seconds a document, share rejected), over a random sample. Each rule meets fresh documents."""
    total = docs.count()
    if not total:
        return {r.name: (0.0, 0.0) for r in rules}
    rules = tuple(rules)

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, rule in enumerate(rules):
                began = time.perf_counter()
                rejected = sum(rule.rejects(Text(x)) for x in texts)
                yield pa.RecordBatch.from_pydict(
                    {"rule": pa.array([i], pa.int32()), "seconds": [time.perf_counter() - began], "rejected": pa.array([rejected], pa.int64()), "rows": pa.array([len(texts)], pa.int64())}
                )

    sample = docs.select("text").sample(min(1.0, sample_rows / total), seed)
    sums = sample.mapInArrow(run, "rule int, seconds double, rejected long, rows long").groupBy("rule").agg(F.sum("seconds"), F.sum("rejected"), F.sum("rows"))
    found = {rules[i].name: (s / n, k / n) for i, s, k, n in sums.collect() if n}
    return {r.name: found.get(r.name, (0.0, 0.0)) for r in rules}


def cascade_order(stats: dict[str, tuple[float, float]], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """Most rejections per second first; ties keep the given order."""
    gain = lambda r: stats[r.name][1] / max(stats[r.name][0], 1e-9)
    return sorted(rules, key=gain, reverse=True)


def first_rejection(text: Text, ordered: Sequence[Rule]) -> str | None:
    return next((r.name for r in ordered if r.rejects(text)), None)


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the counts, base_failed, kept and rejected_by (the first rule of the measured order that rejects)."""
    docs = clean_ids(docs, "doc_id", "text")
    ordered = cascade_order(measure(docs, rules, sample_rows), rules)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")}
        for x in batch.column(1).to_pylist():
            t = Text(x)
            by = first_rejection(t, ordered)
            for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"):
                out[k].append(getattr(t, k))
            out["kept"].append(by is None and not t.base_failed)
            out["rejected_by"].append(by)
        ints = {k: pa.array(v, pa.int64()) for k, v in out.items() if k[0] in "nw"}
        return pa.RecordBatch.from_pydict(
            {"doc_id": batch.column(0)} | ints | {"base_failed": pa.array(out["base_failed"], pa.bool_()), "kept": pa.array(out["kept"], pa.bool_()), "rejected_by": pa.array(out["rejected_by"], pa.string())}
        )

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(
        docs, judge,
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string",
    )


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects; each stops at the first rule that does. No shuffle."""
    docs = clean_ids(docs, *DOCUMENT_COLUMNS)
    ordered = cascade_order(measure(docs, rules, sample_rows), rules)
    at = DOCUMENT_COLUMNS.index("text")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([first_rejection(Text(x), ordered) is None for x in batch.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, keep, docs.schema, TEXTS)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
 WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
p AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i:i+4]) AS c FROM p),
rep AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM g WHERE c > 1) GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
 coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS caps, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits
 FROM d LEFT JOIN l USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_dup_lines > 30 * n_lines OR 10 * n_symbols > n_words OR 100 * caps > 40 * word_chars
 OR 100 * digits > 40 * word_chars OR word_chars > 20 * n_words OR word_chars < 2 * n_words) AS kept
FROM f"""


@query("op10_quality_rules", ORACLE_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).drop("rejected_by")
