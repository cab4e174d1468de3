"""Personal data in whole texts, also where it is disguised.

Base spans come from the text as it stands: e-mail addresses, IPv4 addresses, card numbers and phone numbers,
leftmost and non-overlapping per kind, then checked (part size, Luhn, digit count). The method then reads the
text through a chain of transducers. Each one rewrites a disguise to its plain form and keeps, for every
output character, the source range it came from:

    homoglyphs      look-alike letters, full-width forms and other scripts' digits -> ASCII; invisible characters -> nothing
    spelled digits  runs of three or more digit words ("five five five") -> digits; "plus" before a digit -> +
    at / dot        "(at)", " [dot] ", " AT ... DOT " -> "@" and "."

The same detectors run on the rewritten text and their spans are carried back. A found span is added when it meets no
base span of its kind or reaches beyond those it meets ("jоhn@x.org" with a Cyrillic o holds the base span
"hn@x.org"); base spans stay as they are.

Offsets are code points, end exclusive. Null and empty texts have no spans; repeated rows are handled one by one.
Work is linear in the text, also for very long words or digit runs.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .base import DOCUMENT_COLUMNS, TEXTS, clean_ids, map_batches, query, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the longest local part not before the last match, then the domain."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            floor = match.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.findall(m.group())) <= 15:
            yield m.span()


def detect(text: str) -> list[Span]:
    """Base spans by start, then by kind."""
    spans: list[Span] = []
    if "@" in text:
        spans += [("email", *s) for s in emails(text)]
    if _DIGITS.search(text):
        if "." in text:
            spans += [("ip", *s) for s in _ips(text)]
        spans += [("card", *s) for s in _cards(text)]
        if "+" in text:
            spans += [("phone", *s) for s in _phones(text)]
    return ordered(spans)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Letters that look like ASCII letters, by script.
_CYRILLIC = dict(zip("аАвВеЕкКмМнНоОрРсСтТуУхХіІјЈѕЅԁԛԝ", "aABBeEkKmMHHoOpPcCTTyYxXiIjJsSdqw", strict=True))
_GREEK = dict(zip("αΑΒεΕΖΗιΙκΚΜνΝοΟρΡτΤυΥΧχ", "aABeEZHiIkKMvNoOpPtTuYXx", strict=True))
# Characters without width.
_INVISIBLE = "­​‌‍⁠﻿"
# Signs and spaces that stand for ASCII ones.
_SIGNS = {
    "＋": "+", "﹢": "+", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "｡": ".",
    "﹫": "@", " ": " ", " ": " ", " ": " ",
}
# Digit words.
_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:plus[\x20-]+)?(?:{_WORD}|[0-9])(?:[\x20,.-]{{1,2}}(?:{_WORD}|[0-9])){{2,}}\b", re.IGNORECASE)
_NUMERALS = frozenset(_WORDS) | frozenset("0123456789")
_ITEM = re.compile(rf"plus[\x20-]+|{_WORD}|[0-9]|[\x20,.-]+", re.IGNORECASE)
_BRACKET_AT = r"[\x20]?[\(\[\{<][\x20]?(?:at|@)[\x20]?[\)\]\}>][\x20]?"
_BRACKET_DOT = r"[\x20]?[\(\[\{<][\x20]?(?:dot|\.)[\x20]?[\)\]\}>][\x20]?"
_WORD_DOT = r"\x20(?:dot|punkt|point|punto)\x20"
_SEPARATOR = rf"(?:\.|{_BRACKET_DOT}|{_WORD_DOT})"
_DISGUISED_DOMAIN = re.compile(rf"[A-Za-z0-9-]++(?:{_SEPARATOR}[A-Za-z0-9-]++)+", re.IGNORECASE | re.ASCII)
# The local part read backwards from the at-sign, over reversed text.
_LOCAL_BACK = re.compile(
    r"[A-Za-z0-9_%+-]++(?:(?:\.|[\x20]?[\)\]\}>][\x20]?(?:tod|\.)[\x20]?[\(\[\{<][\x20]?|\x20(?:tod|tknup|tniop|otnup)\x20)[A-Za-z0-9_%+-]++)*+",
    re.IGNORECASE | re.ASCII,
)
_AT_SIGN = re.compile(rf"{_BRACKET_AT}|\x20(?:at|@)\x20|@", re.IGNORECASE)
# Endings of domains that say enough by themselves after a bare at-sign.
_ENDINGS = frozenset("com org net edu gov mil int info biz io dev app cloud online site shop store tech email xyz museum aero coop".split())
_COUNTRY = re.compile(r"[a-z]{2}|xn--[a-z0-9-]+")
_BARE_AT_HINT = re.compile(r"\x20at\x20[a-z0-9-]++\.[a-z0-9-]", re.ASCII)  # on lower-case text; other dots have hints of their own
_DISGUISE_HINTS = (" dot ", " punkt ", " point ", " punto ", " @ ", *(f"{b}{s}{w}" for b in "([{<" for s in ("", " ") for w in ("at", "dot", "@", ".")))
_DOT = re.compile(rf"{_BRACKET_DOT}|{_WORD_DOT}", re.IGNORECASE)
_WIDE = re.compile(r"[^\x00-\x9f\xa1-\xac\xae-\xff]")


class Tape:
    """A rewritten text; output character i came from source[start[i]:end[i]]."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.start = list(range(len(text))) if start is None else start
        self.end = list(range(1, len(text) + 1)) if end is None else end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """edits: (from, to, output), in order and disjoint. An output maps to the whole range it replaces."""
        if not edits:
            return self
        out, start, end, at = [], [], [], 0
        for a, b, put in edits:
            out += [self.text[at:a], put]
            lo, hi = self.start[a], self.end[b - 1]
            start += self.start[at:a] + [lo] * len(put)
            end += self.end[at:a] + [hi] * len(put)
            at = b
        out.append(self.text[at:])
        return Tape("".join(out), start + self.start[at:], end + self.end[at:])


def _plain(ch: str) -> str | None:
    """The ASCII form of one character, '' for an invisible one, None to leave it."""
    if ch in _INVISIBLE:
        return ""
    for known in (_CYRILLIC, _GREEK, _SIGNS):
        if ch in known:
            return known[ch]
    digit = unicodedata.digit(ch, None)
    if digit is not None:
        return str(digit)
    if "！" <= ch <= "～":
        return chr(ord(ch) - 0xFEE0)
    if "\U0001d400" <= ch <= "\U0001d7ff":
        folded = unicodedata.normalize("NFKC", ch)
        return folded if folded.isascii() else None
    return None


def _homoglyphs(tape: Tape) -> Tape:
    found = [(m.start(), m.end(), _plain(m.group())) for m in _WIDE.finditer(tape.text)]
    return tape.rewrite([e for e in found if e[2] is not None])


def _spelled_digits(tape: Tape) -> Tape:
    edits = []
    for m in _SPELLED.finditer(tape.text):
        for item in _ITEM.finditer(m.group()):
            raw = item.group().lower()
            put = "+" if raw.startswith("plus") else _WORDS.get(raw, raw if raw.isdigit() else "")
            if put != raw:
                edits.append((m.start() + item.start(), m.start() + item.end(), put))
    return tape.rewrite(edits)


def _at_and_dot(tape: Tape) -> Tape:
    """Outward from each at-sign, plain or disguised: the domain after it, then the whole local part before it.

    An at-sign that stands between spaces, as a word or as a sign, needs more: the domain ends in a known name, or in two
    small letters after a local part with a dot or a digit ("jane at example.com", "j.doe at x.de"; not "at 3.15", nor
    "look at this.It was" with a space left out).
    """
    text, edits, floor, pos = tape.text, [], 0, 0
    back, size = text[::-1], len(text)
    while at := _AT_SIGN.search(text, pos):
        pos = at.start() + 1
        local = at.start() > floor and text[at.start() - 1] in _LOCAL
        domain = _DISGUISED_DOMAIN.match(text, at.end()) if local else None
        if domain is None:
            continue
        local = _LOCAL_BACK.match(back, size - at.start(), size - floor)
        if local is None:
            continue
        if at.group().lower() in (" at ", " @ "):
            ending = _DOT.sub(".", domain.group()).rpartition(".")[2]
            marked = re.search(r"[.0-9]", _DOT.sub(".", text[size - local.end() : at.start()])) is not None
            if ending not in _ENDINGS and not (marked and _COUNTRY.fullmatch(ending)):
                continue
        edits += [(d.start(), d.end(), ".") for d in _DOT.finditer(text, size - local.end(), at.start())]
        if at.group() != "@":
            edits.append((at.start(), at.end(), "@"))
        edits += [(d.start(), d.end(), ".") for d in _DOT.finditer(text, at.end(), domain.end())]
        floor = pos = domain.end()
    return tape.rewrite(edits)


def _has_wide(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return "\xad" in text or "\xa0" in text


def _has_spelled(lowered: str) -> bool:
    """Three numerals in a row, one of them a word."""
    words = lowered.replace(",", " ").replace(".", " ").replace("-", " ").split()
    if _WORDS.keys().isdisjoint(words):
        return False
    run = 0
    for w in words:
        run = run + 1 if w in _NUMERALS else 0
        if run == 3:
            return True
    return False


def normalise(text: str) -> Tape | None:
    """The rewritten text with source offsets; None when no transducer has anything to rewrite."""
    tape = Tape(text) if _has_wide(text) else None
    if tape is not None:
        tape = _homoglyphs(tape)
    lowered = (tape.text if tape else text).lower()
    spelled, disguised = _has_spelled(lowered), any(h in lowered for h in _DISGUISE_HINTS) or _BARE_AT_HINT.search(lowered) is not None
    if spelled or disguised:
        tape = tape or Tape(text)
        tape = _spelled_digits(tape) if spelled else tape
        tape = _at_and_dot(tape) if disguised else tape
    return None if tape is None or tape.text == text else tape


def personal_data(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans)."""
    text = text or ""
    base = detect(text)
    tape = normalise(text)
    if tape is None:
        return base, base
    taken = {k: [s for s in base if s[0] == k] for k in KINDS}
    added = []
    for kind, a, b in detect(tape.text):
        lo, hi = tape.start[a], tape.end[b - 1]
        met = [(s, e) for _, s, e in taken[kind] if s < hi and lo < e]
        if all(lo <= s and e <= hi and (lo, hi) != (s, e) for s, e in met):
            added.append((kind, lo, hi))
            taken[kind].append((kind, lo, hi))
    return base, ordered(base + added)


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are masked as one, by the first's kind."""
    if not text:
        return text
    out, at = [], 0
    spans = personal_data(text)[1]
    for i, (kind, a, b) in enumerate(spans):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    out.append(text[at:])
    return "".join(out) if spans else text


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each kind of base span, the digest of the base spans, all spans as text, and their number."""
    docs = clean_ids(docs, "doc_id", "text")

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": [], "n_spans": []}
        for text in batch.column(1).to_pylist():
            base, spans = personal_data(text)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(spans_text(base).encode()).hexdigest())
            out["spans"].append(spans_text(spans))
            out["n_spans"].append(len(spans))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items()})

    return map_batches(docs, find, f"doc_id {dict(docs.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked and n_chars counted anew. No shuffle."""
    docs = clean_ids(docs, *DOCUMENT_COLUMNS)
    at, count = DOCUMENT_COLUMNS.index("text"), DOCUMENT_COLUMNS.index("n_chars")

    def mask(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column(at).to_pylist()
        new = [masked(t) for t in old]
        lengths = [n if a == b else len(b) for n, a, b in zip(batch.column(count).to_pylist(), old, new)]
        columns = list(batch.columns)
        columns[at], columns[count] = pa.array(new, columns[at].type), pa.array(lengths, columns[count].type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_batches(docs, mask, docs.schema, TEXTS)


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
