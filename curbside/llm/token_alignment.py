"""Alignment of two tokenizers over the same text, and corpus-wide counts of the id pairs it links.

Spans: the first tokenizer (byte-level BPE) gives character offsets, the second (sentencepiece) gives byte spans in
its proto. They are coarse cuts: a token whose span is as long as its decoded bytes ends where the span ends; tokens
that share a multibyte character, byte-fallback tokens and the added space end where their decoded bytes do. The
decoded bytes of both must spell the text, else the text has no tokens. Offsets where tokens of both end cut them
into groups; every token pair within a group is a link.

Parts: no token of either spans a white-space run's start, so a text is cut there and each distinct part of a block
of texts is encoded once, many in one call; texts with marks for which this may not hold go in whole. Blocks hold
about BLOCK characters (at least one text), which bounds a task's memory.

Counts: a block numbers its distinct id pairs and keeps, for each text, the numbers and multiplicities, written as one
row a block. Pairs travel once a block to be counted, and once back with their count; a block's answers then meet
its texts again. A pair has at most one row a block, so no key outgrows the others.

Null, empty and undecodable texts (such as those with U+2581) have zeros and an empty groups text. Repeated rows count
as documents of their own; null ids stay; columns besides doc_id and text are not read. Very long texts are one block.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, clean_ids, query, table

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK = 16_000_000  # characters of text whose pairs are numbered together
CALL = 100_000  # characters of parts encoded in one call
WIDE = 4096  # links of a group from which its equal ids are merged before they are paired
LEAD = "x"  # stands before the parts of a call, so that each follows a character that is not white space
SPACE = "▁"

_PART = re.compile(r"\s*\S+|\s+")
_ODD = re.compile(rf"[^\S \n]|{SPACE}")


# --- tokens -----------------------------------------------------------------

class Pair:
    """Both tokenizers with the bytes of their entries; `parts` tells whether texts may be cut at white space."""

    def __init__(self, first: str, second: str):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(first))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(second))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(byte[c] for c in n) if all(c in byte for c in n) else n.encode() for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.parts = not any(re.search(rf"[^{SPACE}]{SPACE}|\n", p) for p in pieces)
        self.shown = np.array([str(i) for i in range(max(len(names), len(pieces)))], object)

    def first(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and byte ends in space + text, whose characters the offsets count."""
        whole = " " + text
        found = self.a.encode(whole, add_special_tokens=False)
        ids, spans = np.array(found.ids, np.int64), np.array(found.offsets, np.int64).reshape(-1, 2)
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])
        return ids, refined(at[spans[:, 0]], at[spans[:, 1]], self.a_size[ids])

    def second(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and byte ends in space + text; the proto's spans count the text's bytes, without the added space."""
        found = self.b.encode(text, return_type="proto")
        spans = np.array([(p.id, p.begin, p.end) for p in found.pieces], np.int64).reshape(-1, 3)
        ids = spans[:, 0]
        return ids, refined(spans[:, 1] + 1, spans[:, 2] + 1, self.b_size[ids])


@lru_cache(maxsize=2)
def pair(first: str = FIRST, second: str = SECOND) -> Pair:
    return Pair(first, second)


def refined(start: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse end where the span is as long as the token's bytes, else counted in bytes from the last such end."""
    coarse = end - start == size
    total = np.cumsum(size)
    last = np.maximum.accumulate(np.where(coarse, np.arange(len(size)), -1))
    known = last >= 0
    return np.where(coarse, end, np.where(known, end[last], 0) + total - np.where(known, total[last], 0))


@dataclass
class Aligned:
    """Sums and shown groups by part, and the links of all parts as (part, a << 32 | b, times)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    part: np.ndarray
    key: np.ndarray
    times: np.ndarray


def align(text: str, ends: np.ndarray, tokens: Pair) -> Aligned | None:
    """Groups and links of space + text, whose parts end at the byte offsets `ends`; None if the tokens spell another text or span two parts."""
    whole = (" " + text).encode()
    a, a_end = tokens.first(text)
    b, b_end = tokens.second(text)
    if b"".join(map(tokens.a_bytes.__getitem__, a.tolist())) != whole or b"".join(map(tokens.b_bytes.__getitem__, b.tolist())) != whole:
        return None
    cut = np.intersect1d(a_end, b_end)
    if not np.isin(ends, cut).all():
        return None
    a_stop, b_stop = np.searchsorted(a_end, cut, "right"), np.searchsorted(b_end, cut, "right")
    n_a, n_b = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
    of = np.searchsorted(ends, cut)  # part of each group
    keys, parts, times = links(a, b, a_stop - n_a, b_stop - n_b, n_a, n_b, of)
    add = lambda x: np.bincount(of, x, len(ends)).astype(np.int64)
    return Aligned(add(n_a), add(n_b), np.bincount(of, minlength=len(ends)), add(n_a * n_b), shown(tokens, a, b, a_stop, b_stop, n_a, n_b, of, len(ends)), parts, keys, times)


def links(a, b, a_at, b_at, n_a, n_b, of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, part and times of the links of groups; equal ones may come more than once."""
    wide = n_a * n_b > WIDE
    some = np.flatnonzero(~wide)
    n = (n_a * n_b)[some]
    group = np.repeat(some, n)
    k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    keys = [a[a_at[group] + k // n_b[group]] << 32 | b[b_at[group] + k % n_b[group]]]
    parts, times = [of[group]], [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(wide):
        x, x_n = np.unique(a[a_at[g] : a_at[g] + n_a[g]], return_counts=True)
        y, y_n = np.unique(b[b_at[g] : b_at[g] + n_b[g]], return_counts=True)
        keys.append((x[:, None] << 32 | y).ravel())
        times.append((x_n[:, None] * y_n).ravel())
        parts.append(np.full(len(x) * len(y), of[g]))
    return np.concatenate(keys), np.concatenate(parts), np.concatenate(times)


def shown(tokens: Pair, a, b, a_stop, b_stop, n_a, n_b, of, n_parts: int) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` for each part."""
    group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    out = np.empty(len(a) + len(b), object)
    end_a, end_b = np.arange(len(a)) + 1 == a_stop[group_a], np.arange(len(b)) + 1 == b_stop[group_b]
    last = np.diff(of, append=n_parts) > 0  # the last group of its part
    marks = np.array([",", "|", ";", ""], object)
    out[np.arange(len(a)) + (b_stop - n_b)[group_a]] = tokens.shown[a] + marks[end_a.astype(int)]
    out[np.arange(len(b)) + a_stop[group_b]] = tokens.shown[b] + marks[np.where(end_b, 2 + last[group_b], 0)]
    stop = (a_stop + b_stop)[last].tolist()
    items, at = out.tolist(), dict(zip(of[last].tolist(), zip([0, *stop], stop)))
    return ["".join(items[slice(*at[k])]) if k in at else "" for k in range(n_parts)]


# --- blocks -----------------------------------------------------------------

class Number(dict):
    """Numbers its keys in the order in which they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def parts_of(text: str, cut: bool) -> list[str]:
    whole = " " + text
    return _PART.findall(whole) if cut and not _ODD.search(text) else [whole]


def calls(parts: list[str], cut: bool) -> list[list[int]]:
    """Parts to encode in one call. White space at a text's end and texts with odd marks, which a next part could change, go alone."""
    out, now, size = [], [], 0
    for k, p in enumerate(parts):
        if not cut or p[-1].isspace() or _ODD.search(p):
            out.append([k])
            continue
        now.append(k)
        size += len(p)
        if size > CALL:
            out.append(now)
            now, size = [], 0
    return out + [now] * bool(now)


def block(texts: list[str], tokens: Pair, cut: bool = True) -> tuple[dict[str, list], np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Columns of the texts; the block's pairs and in how many of its texts each is linked; (text's start, pair number, times) of the texts' distinct links."""
    number = Number()
    own = [np.fromiter(map(number.__getitem__, parts_of(t, cut)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    parts = list(number)
    n = len(parts)
    sums, groups, good = np.zeros((4, n), np.int64), [""] * n, np.ones(n, bool)
    part, key, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for call in calls(parts, cut):
        chosen = [parts[k] for k in call]
        ends = np.cumsum([2, *(len(p.encode()) for p in chosen)])
        found = align(LEAD + "".join(chosen), ends, tokens)
        if found is None:
            if cut and not (len(call) == 1 and _ODD.search(chosen[0])):
                return block(texts, tokens, cut=False)
            good[call] = False
            continue
        for row, x in zip(sums, (found.n_a, found.n_b, found.n_groups, found.n_links)):
            row[call] = x[1:]
        for k, g in zip(call, found.groups[1:]):
            groups[k] = g
        rest = found.part > 0
        part.append(np.array(call)[found.part[rest] - 1])
        key.append(found.key[rest])
        times.append(found.times[rest])
    pairs, of_pair = np.unique(np.concatenate(key), return_inverse=True)
    part, times = np.concatenate(part), np.concatenate(times)
    order = np.argsort(part, kind="stable")
    of_pair, times = of_pair[order], times[order]
    first = np.searchsorted(part[order], np.arange(n + 1))

    columns: dict[str, list] = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    starts, numbers, counts = [0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for o in own:
        o = o if good[o].all() else o[:0]
        for c, row in zip(columns, sums):
            columns[c].append(int(row[o].sum()))
        columns["groups_sha256"].append(hashlib.sha256(";".join([groups[k] for k in o.tolist()]).encode()).hexdigest() if len(o) else "")
        some, often = np.unique(o, return_counts=True)
        length = first[some + 1] - first[some]
        at = np.repeat(first[some] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        distinct, inverse = np.unique(of_pair[at], return_inverse=True)
        numbers.append(distinct)
        counts.append(np.bincount(inverse, times[at] * np.repeat(often, length), len(distinct)).astype(np.int64))
        starts.append(starts[-1] + len(distinct))
    numbers = np.concatenate(numbers)
    return columns, pairs, np.bincount(numbers, minlength=len(pairs)), (np.array(starts), numbers, np.concatenate(counts))


def squeezed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unsqueezed(x: bytes, kind: str) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def blocks(docs: DataFrame, first: str, second: str) -> DataFrame:
    """One row a block: its texts' columns, its pairs with their number of texts, and the texts' links, compressed."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"block long, doc_id array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<long>, texts array<int>, starts binary, numbers binary, times binary"

    def run(batches):
        tokens, task, seen = pair(first, second), TaskContext.get().partitionId(), 0

        def done(ids, texts):
            nonlocal seen
            columns, pairs, count, (starts, numbers, times) = block(texts, tokens, tokens.parts)
            deltas = np.diff(numbers, prepend=0).astype("<i4")  # small within a text, where numbers ascend
            row = {"block": [task << 32 | seen], "doc_id": [ids], **{c: [x] for c, x in columns.items()}, "pairs": [pairs], "texts": [count.astype(np.int32)],
                   "starts": [squeezed(starts.astype("<i8"))], "numbers": [squeezed(deltas)], "times": [squeezed(times.astype("<i4"))]}
            seen += 1
            types = {"doc_id": pa.list_(id_type), "pairs": pa.list_(pa.int64()), "texts": pa.list_(pa.int32()), "groups_sha256": pa.list_(pa.string())} | {c: pa.list_(pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}
            return pa.RecordBatch.from_pydict({c: pa.array(x, types[c]) if c in types else pa.array(x) for c, x in row.items()})

        ids, texts, size, id_type = [], [], 0, pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1]) + 1
                if size >= BLOCK:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield done(ids, texts)

    return clean_ids(docs, "doc_id", "text").mapInArrow(run, schema)


# --- counts -----------------------------------------------------------------

def pair_counts(made: DataFrame, scratch: Scratch) -> DataFrame:
    """pair and n, the number of texts that hold it linked, negative where it is the highest of its first id.

    Broadcasts one number for each first id, at most as many as its vocabulary has entries.
    """
    counts = made.select(F.explode(F.arrays_zip("pairs", "texts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.texts").alias("n"))
    counts = scratch.write(counts.withColumn("a", F.shiftright("pair", 32)), "counts")
    tops = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(tops), "a").select("pair", F.when(F.col("n") == F.col("top"), -F.col("n")).otherwise(F.col("n")).alias("n"))


def align_documents(docs: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    scratch = Scratch(spark, "alignment")
    made = scratch.write(blocks(docs, first, second), "blocks")
    told = made.select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair")).join(pair_counts(made, scratch), "pair").select("of", "at", "n")
    texts = made.drop("pairs", "texts")

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        n = np.zeros(right.num_rows, np.int64)
        n[right.column("at").to_numpy()] = right.column("n").to_numpy()
        row = {c: left.column(c)[0] for c in left.column_names}
        starts, times = unsqueezed(row["starts"].as_py(), "<i8"), unsqueezed(row["times"].as_py(), "<i4").astype(np.int64)
        numbers = np.cumsum(unsqueezed(row["numbers"].as_py(), "<i4").astype(np.int64))
        add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])
        out = {c: row[c].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        found = n[numbers]
        return pa.table(out | {"n_best": add(np.where(found < 0, times, 0)), "count_sum": add(np.abs(found) * times)}).select(columns)

    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(finish, schema)


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
