"""Weighted medians of very many bootstrap replicates over one pass, or few.

Every row has a Poisson(1) weight in each replicate. Values are cut into bins at approximate quantiles of their group;
a task adds up, for each bin, the vector of the replicates' weights, so what is shuffled is bins x replicates numbers a
task whatever the rows. The running sums over bins tell each replicate which bin holds its middle ranks. Only rows of
those bins go on: to the next, finer cut while a bin holds more than LEAF rows of different values, else to the exact
end, where the bin's rows are sorted and their weights summed once more.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import dtype_of, null_safe_join, stable_checkpoint
from ..functions.hashing import POISSON_1_CDF, continued, draw_bits, draw_key, uniforms

BINS, LEAF = 64, 20_000
ACCURACY = 2_000  # of the approximate quantiles that only place the cuts
STEP = 1024  # rows whose weights are made at once
OPEN = 16  # groups of bins whose weight vectors a task holds


def _by_head() -> np.ndarray:
    """The weight for each value of a draw's first 16 bits; -1 where the other bits decide."""
    low = np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)
    ends = [np.searchsorted(np.array(POISSON_1_CDF), uniforms(x), "right") for x in (low, low | np.uint64((1 << 48) - 1))]
    return np.where(ends[0] == ends[1], ends[0], -1).astype(np.float64)


_BY_HEAD = _by_head()


def weights(bits: np.ndarray, reps: int) -> np.ndarray:
    """Poisson(1) weights of each row (a row of the result) in replicates 1..reps."""
    drawn = continued(np.arange(1, reps + 1)[None, :], bits[:, None])
    w = _BY_HEAD[drawn >> np.uint64(48)]
    open_ = np.nonzero(w < 0)
    w[open_] = np.searchsorted(np.array(POISSON_1_CDF), uniforms(drawn[open_]), "right")
    return w


def _bin_weights(rows: DataFrame, reps: int) -> DataFrame:
    """(g, bin, w): summed weight vectors of the bins of every group, from rows (g, bin, bits)."""

    def run(batches):
        held: dict[int, dict[int, np.ndarray]] = {}

        def sent(g: int) -> pa.RecordBatch:
            bins = held.pop(g)
            return pa.RecordBatch.from_pydict({"g": pa.array([g] * len(bins), pa.int64()), "bin": pa.array(list(bins), pa.int32()), "w": pa.array([x.tobytes() for x in bins.values()], pa.binary())})

        for batch in batches:
            g, bins, bits = (batch.column(i).to_numpy() for i in range(3))
            order = np.lexsort((bins, g))
            for s in range(0, len(order), STEP):
                own = order[s : s + STEP]
                w = weights(bits[own].view(np.uint64), reps)
                starts = np.flatnonzero(np.diff(g[own], prepend=g[own[0]] - 1) | np.diff(bins[own], prepend=bins[own[0]] - 1))
                for k, total in zip(own[starts].tolist(), np.add.reduceat(w, starts)):
                    into = held.setdefault(int(g[k]), {})
                    into[int(bins[k])] = into[int(bins[k])] + total if int(bins[k]) in into else total
            while len(held) > OPEN:
                yield sent(next(iter(held)))
        for name in list(held):
            yield sent(name)

    def add(key, part):
        total = np.sum([np.frombuffer(w, np.float64) for w in part.column("w").to_pylist()], axis=0)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "bin": pa.array([key[1].as_py()], pa.int32()), "w": pa.array([total.tobytes()], pa.binary())})

    made = rows.select("g", "bin", "bits").mapInArrow(run, "g long, bin int, w binary")
    return made.groupBy("g", "bin").applyInArrow(add, "g long, bin int, w binary")


def _wanted(sums: DataFrame, asked: DataFrame) -> DataFrame:
    """(g, bin, asked): for each bin that holds wanted ranks, which replicate and side wants which rank inside it.

    `asked` has (g, asked): packed (replicate, side, rank) triples; null asks for the middle of all.
    """

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"g": pa.array([], pa.int64()), "bin": pa.array([], pa.int32()), "asked": pa.array([], pa.binary())})
        left = left.sort_by("bin")
        bins = left.column("bin").to_numpy()
        run_sum = np.cumsum([np.frombuffer(w, np.float64) for w in left.column("w").to_pylist()], axis=0)
        packed = right.column("asked")[0].as_py()
        if packed is None:
            total = run_sum[-1]
            reps = np.flatnonzero(total > 0)
            triples = np.concatenate([np.stack([reps, np.full(len(reps), side), f((total[reps] - 1) / 2).astype(np.int64)], 1) for side, f in enumerate((np.floor, np.ceil))])
        else:
            triples = np.frombuffer(packed, np.int64).reshape(-1, 3)
        at = (run_sum[:, triples[:, 0]] <= triples[:, 2]).sum(0)
        before = np.where(at > 0, run_sum[np.maximum(at - 1, 0), triples[:, 0]], 0).astype(np.int64)
        inside = np.stack([triples[:, 0], triples[:, 1], triples[:, 2] - before], 1)
        hit = np.unique(at)
        return pa.table({"g": np.full(len(hit), key[0].as_py(), np.int64), "bin": bins[hit].astype(np.int32), "asked": pa.array([inside[at == k].tobytes() for k in hit], pa.binary())})

    return sums.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(run, "g long, bin int, asked binary")


def _leaf_values(rows: DataFrame, asked: DataFrame, reps: int) -> DataFrame:
    """(g, rep, side, v): the asked ranks' values among rows (g, v, bits), at most LEAF a group or of one value."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"g": [], "rep": [], "side": [], "v": []}
        if left.num_rows and right.num_rows:
            v, bits = left.column("v").to_numpy(), left.column("bits").to_numpy().view(np.uint64)
            triples = np.frombuffer(right.column("asked")[0].as_py(), np.int64).reshape(-1, 3)
            order = np.lexsort((bits, v))
            v, bits = v[order], bits[order]
            found, done = np.full(len(triples), v[-1]), np.full(len(triples), v[0] == v[-1])
            before = np.zeros(reps)
            for s in range(0, len(v), STEP):
                if done.all():
                    break
                run_sum = before + np.cumsum(weights(bits[s : s + STEP], reps), axis=0)
                rank = triples[:, 2]
                here = ~done & (run_sum[-1, triples[:, 0]] > rank)
                at = (run_sum[:, triples[here, 0]] <= rank[here]).sum(0)
                found[here] = v[s + at]
                done |= here
                before = run_sum[-1]
            out = {"g": np.full(len(triples), key[0].as_py(), np.int64), "rep": triples[:, 0] + 1, "side": triples[:, 1].astype(np.int32), "v": found}
        return pa.table({"g": pa.array(out["g"], pa.int64()), "rep": pa.array(out["rep"], pa.int64()), "side": pa.array(out["side"], pa.int32()), "v": pa.array(out["v"], pa.float64())})

    return rows.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(run, "g long, rep long, side int, v double")


def replicate_medians(rows: DataFrame, value: str, unit: str, keys: Sequence[str], reps: int, seed: int) -> DataFrame:
    """(keys, rep, v): the median of every replicate 1..reps of each group; the mean of both middle values.

    All rows of a unit have one weight in a replicate. A replicate without weight has no row.
    """
    keys = list(keys)
    bits = draw_bits(seed, draw_key(F.col(unit), dtype_of(rows, unit)))
    frame = rows.select(*keys, F.col(value).cast("double").alias("v"), bits.alias("bits"))
    names = stable_checkpoint(frame.select(*keys).distinct().withColumn("g", F.monotonically_increasing_id()))
    frame = stable_checkpoint(null_safe_join(frame, names, keys).select("g", "v", "bits"))
    asked = names.select("g", F.lit(None).cast("binary").alias("asked"))
    origin = names.select("g", F.col("g").alias("root"))
    leaves: list[DataFrame] = []
    while True:
        probs = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
        cuts = stable_checkpoint(frame.groupBy("g").agg(F.array_distinct(F.concat(F.array(F.min("v")), F.percentile_approx("v", probs, ACCURACY))).alias("cuts")))  # at most BINS numbers a group; the least value leaves any bin of several
        placed = frame.join(cuts, "g").withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("v"))).cast("int")).select("g", "v", "bits", "bin")
        wanted = _wanted(_bin_weights(placed, reps), asked)
        sizes = placed.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
        inside = F.monotonically_increasing_id().alias("next")
        wanted = stable_checkpoint(wanted.join(sizes, ["g", "bin"]).select("g", "bin", "asked", inside, ((F.col("rows") <= LEAF) | (F.col("low") == F.col("high"))).alias("leaf"), "low", "high"))
        origin = stable_checkpoint(wanted.select("g", "next").join(origin, "g").select(F.col("next").alias("g"), "root"))
        # a bin of one value answers at once, whatever its rows
        one = wanted.where("leaf AND low = high").select(F.col("next").alias("g"), "low", "asked")
        rest = placed.join(wanted.where("NOT (leaf AND low = high)").select("g", "bin", "next", "leaf"), ["g", "bin"])
        rest = stable_checkpoint(rest.select(F.col("next").alias("g"), "v", "bits", "leaf"))
        asked = wanted.select(F.col("next").alias("g"), "asked", "leaf", "low", "high").where("NOT (leaf AND low = high)")
        found = _constant(one).unionByName(_leaf_values(rest.where("leaf").drop("leaf"), asked.where("leaf").select("g", "asked"), reps))
        leaves.append(found.join(origin, "g").select("root", "rep", "side", "v"))
        frame, asked = rest.where("NOT leaf").drop("leaf"), asked.where("NOT leaf").select("g", "asked")
        if asked.isEmpty():
            break
    found = leaves[0]
    for x in leaves[1:]:
        found = found.unionByName(x)
    medians = found.groupBy("root", "rep").agg((F.sum("v") / 2).alias("v"))  # both sides
    return null_safe_join(medians.withColumnRenamed("root", "g"), names, ["g"]).select(*keys, F.col("rep").cast("int").alias("rep"), "v")


def _constant(one: DataFrame) -> DataFrame:
    """(g, rep, side, v) of bins whose rows all have the value `low`."""

    def run(batches):
        for batch in batches:
            for g, v, asked in zip(*(c.to_pylist() for c in batch.columns)):
                t = np.frombuffer(asked, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_pydict({"g": np.full(len(t), g, np.int64), "rep": t[:, 0] + 1, "side": t[:, 1].astype(np.int32), "v": np.full(len(t), v)})

    return one.mapInArrow(run, "g long, rep long, side int, v double")
