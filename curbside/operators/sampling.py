"""Many samples without replacement, as sums: the facts are read once and never multiplied by the samples.

The rows of a group are numbered by (hash bucket, unit), or by unit alone if `by_unit` is asked for: then the samples do
not depend on the size of a bucket, at the price of one sort by ranges. Sample `sim` of a group takes the first k distinct values of
floor(u_j * rows), u_j the 53-bit draw of (seed, group, sim, j): a uniform sample without replacement whose cost is
its own size. Ranks are drawn in tasks of about DRAWS draws, go to the bucket that holds them as packed arrays, meet
its rows there once, and leave as one row of sums for each sample and bucket.

A bucket holds about BUCKET rows, so a group with a third of all rows is many tasks. Where few buckets serve very many
draws, a bucket is handed out in parts, one for each PART draws.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import dtype_of, null_safe_join, spread, stable_checkpoint
from ..functions.hashing import continued, draw_bits, draw_key, uniforms
from .ranks import row_ranks

BUCKET, DRAWS, PART = 65_536, 1_000_000, 4_000_000
STEP, GROUPS = 256, 64  # half splits handled at once; groups whose sums a task holds


def distinct_ranks(bits: int, sim: int, n: int, k: int) -> np.ndarray:
    """k ranks below n without repeats, ascending. More than half of them: all but the first n - k that are drawn."""
    take = min(k, n - k)
    if take <= 0:
        return np.arange(n if k >= n else 0)
    own = continued(sim, np.uint64(bits))
    draws = int(1.1 * n * np.log(n / (n - take))) + 64
    while True:
        drawn = np.minimum((uniforms(continued(np.arange(draws), own)) * n).astype(np.int64), n - 1)
        ranks, first = np.unique(drawn, return_index=True)
        if len(ranks) >= take:
            break
        draws *= 2
    ranks = ranks[first <= np.partition(first, take - 1)[take - 1]]
    return ranks if take == k else np.setdiff1d(np.arange(n), ranks, assume_unique=True)


def sample_sums(
    rows: DataFrame, unit: str, columns: dict[str, Column], products: Sequence[tuple[str, str]], keys: Sequence[str], sims: int,
    size: Column, seed: int = 1, centred: Sequence[str] = (), by_unit: bool = False,
) -> DataFrame:
    """(keys, sim, rows, <column>, <a>_<b>): sums of columns and of products over samples 1..sims of every group.

    `size` is the sample size as a function of the column `__n`, the group's rows. Columns in `centred` are taken about
    their mean over the group, which comes out as `<column>_mean`. `unit` identifies a row of its group; null column
    values count as 0. `by_unit`: rows are numbered by unit, and a bucket is a range of these numbers.
    """
    keys = list(keys)
    measured = rows.select(*keys, F.col(unit).alias("__unit"), *[c.cast("double").alias(n) for n, c in columns.items()])
    groups = measured.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(c).alias(f"{c}_mean") for c in centred])
    groups = groups.withColumn("__k", F.least(F.col("__n"), size).cast("bigint")).withColumn("__buckets", F.greatest(F.ceil(F.col("__n") / BUCKET), F.lit(1)))
    bits = draw_bits(seed, *[draw_key(F.col(k), dtype_of(rows, k)) for k in keys])
    total = F.col("__k") * sims
    groups = stable_checkpoint(groups.withColumns({
        "__bits": bits, "__parts": F.ceil(F.greatest(total, F.lit(1)) / F.col("__buckets") / PART).cast("int"),
        "__chunks": F.least(F.lit(sims), F.ceil(F.greatest(total, F.lit(1)) / DRAWS)).cast("int"), "__group": F.monotonically_increasing_id(),
    }))
    values = {c: F.coalesce(F.col(c) - F.col(f"{c}_mean") if c in centred else F.col(c), F.lit(0.0)) for c in columns}
    bucket = F.pmod(F.xxhash64("__unit"), F.col("__buckets"))
    if by_unit:
        measured, bucket = row_ranks(measured, keys, [F.col("__unit")], "__rank"), F.floor((F.col("__rank") - 1) / BUCKET)
    placed = null_safe_join(measured, groups, keys).withColumns(values).withColumn("__bucket", bucket)
    sizes = placed.groupBy("__group", "__bucket").agg(F.count(F.lit(1)).alias("__rows"))
    lists = sizes.groupBy("__group").agg(F.array_sort(F.collect_list(F.struct("__bucket", "__rows"))).alias("__list"))  # an entry for each bucket
    tasks = groups.join(lists, "__group").where((F.col("__k") > 0) & (F.lit(sims) > 0)).select(
        "__group", "__bits", "__n", "__k", "__parts", "__chunks", "__list.__bucket", "__list.__rows", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)).alias("__chunk"))

    def draw(batches):
        for batch in batches:
            for r in batch.to_pylist():
                first, last = (r["__chunk"] + i for i in (0, 1))
                first, last = 1 + first * sims // r["__chunks"], 1 + last * sims // r["__chunks"]
                found = [distinct_ranks(r["__bits"] % (1 << 64), sim, r["__n"], r["__k"]) for sim in range(first, last)]
                which = np.repeat(np.arange(first, last), [len(f) for f in found])
                ranks = np.concatenate(found) if found else np.zeros(0, np.int64)
                ends = np.cumsum(r["__rows"])
                at = np.searchsorted(ends, ranks, "right")
                order = np.argsort(at, kind="stable")
                cuts = np.searchsorted(at[order], np.arange(len(ends) + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    mine = order[cuts[b] : cuts[b + 1]]
                    inside = ranks[mine] - (ends[b] - r["__rows"][b])
                    yield pa.RecordBatch.from_pydict({
                        "__g": pa.array([r["__group"]]), "__b": pa.array([r["__bucket"][b]], pa.int64()), "__p": pa.array([r["__chunk"] % r["__parts"]], pa.int32()),
                        "first": pa.array([first], pa.int64()), "counts": pa.array([np.bincount(which[mine] - first, minlength=last - first).astype("<i4").tobytes()], pa.binary()),
                        "ranks": pa.array([inside.astype("<i4").tobytes()], pa.binary())})

    drawn = spread(tasks, "__group", "__chunk").mapInArrow(draw, "__g long, __b long, __p int, first long, counts binary, ranks binary")
    names = list(columns)
    sums = [*names, *[f"{a}_{b}" for a, b in products]]

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("__unit")
        m = [left.column(c).to_numpy() for c in names]
        m += [m[names.index(a)] * m[names.index(b)] for a, b in products]
        out: dict[str, list] = {c: [] for c in ("sim", "rows", *sums)}
        for first, counts, ranks in zip(*(right.column(c).to_pylist() for c in ("first", "counts", "ranks"))):
            counts, ranks = np.frombuffer(counts, "<i4"), np.frombuffer(ranks, "<i4")
            some = np.flatnonzero(counts)
            starts = np.cumsum(counts)[some] - counts[some]
            out["sim"].append(first + some)
            out["rows"].append(counts[some])
            for c, x in zip(sums, m):
                out[c].append(np.add.reduceat(x[ranks], starts))
        wide = {c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()}
        return pa.table({"__group": np.full(len(wide["sim"]), key[0].as_py(), np.int64), "sim": wide["sim"].astype(np.int64), "rows": wide["rows"].astype(np.int64)} | {c: wide[c].astype(np.float64) for c in sums})

    parts = placed.select("__group", "__bucket", "__unit", *names, F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"))
    met = parts.groupBy("__group", "__bucket", "__part").cogroup(drawn.groupBy("__g", "__b", "__p")).applyInArrow(
        meet, "__group long, sim long, rows long, " + ", ".join(f"{c} double" for c in sums))
    found = met.groupBy("__group", "sim").agg(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in sums])
    return found.join(groups.select("__group", *keys, *[f"{c}_mean" for c in centred]), "__group").drop("__group")


def half_sums(rows: DataFrame, unit: str, columns: Sequence[str], products: Sequence[tuple[str, str]], keys: Sequence[str], sims: int, seed: int = 1) -> DataFrame:
    """(keys, sim, split, rows, <column>, <a>_<b>) of both halves in each of `sims` random splits of the rows.

    A row is in half A of split `sim` if its draw is below one half. Tasks add up all splits over their rows and send
    one row for each group, split and half; a group is sent early when GROUPS of them are open.
    """
    keys = list(keys)
    key_fields = "".join(f"`{k}` {dtype_of(rows, k)}, " for k in keys)
    frame = rows.select(*keys, draw_bits(seed, draw_key(F.col(unit), dtype_of(rows, unit))).alias("__bits"), *[F.col(c).cast("double").alias(c) for c in columns])
    sums = [*columns, *[f"{a}_{b}" for a, b in products]]
    schema = f"{key_fields}sim long, split string, rows long, " + ", ".join(f"{c} double" for c in sums)

    def run(batches):
        types: list[pa.DataType] = []

        def sent(group: tuple, total: np.ndarray) -> pa.RecordBatch:
            n = 2 * sims
            out = {k: pa.array([v] * n, t) for k, v, t in zip(keys, group, types)}
            out |= {"sim": np.tile(np.arange(1, sims + 1), 2), "split": pa.array(["A"] * sims + ["B"] * sims), "rows": total[:, :, 0].ravel().astype(np.int64)}
            return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in (out | {c: total[:, :, i + 1].ravel() for i, c in enumerate(sums)}).items()})

        open_: dict[tuple, np.ndarray] = {}
        for batch in batches:
            types = [batch.column(i).type for i in range(len(keys))]
            bits = batch.column(len(keys)).to_numpy().view(np.uint64)
            m = [np.nan_to_num(batch.column(len(keys) + 1 + i).to_numpy(zero_copy_only=False)) for i in range(len(columns))]
            m = np.stack([np.ones(len(bits)), *m, *[m[list(columns).index(a)] * m[list(columns).index(b)] for a, b in products]], 1)
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))))) if keys else [()] * len(bits)
            at: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                at.setdefault(name, []).append(i)
            for name, own in at.items():
                total = open_.setdefault(name, np.zeros((2, sims, 1 + len(sums))))
                some, all_ = m[own], m[own].sum(0)
                for s in range(0, sims, STEP):
                    sim = np.arange(s + 1, min(s + STEP, sims) + 1)
                    a = (uniforms(continued(sim[:, None], bits[own][None, :])) < 0.5).astype(np.float64) @ some
                    total[0, s : s + STEP] += a
                    total[1, s : s + STEP] += all_ - a
            while len(open_) > GROUPS:
                name = next(iter(open_))
                yield sent(name, open_.pop(name))
        for name, total in open_.items():
            yield sent(name, total)

    found = frame.mapInArrow(run, schema)
    return found.groupBy(*keys, "sim", "split").agg(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in sums]).where("rows > 0")
