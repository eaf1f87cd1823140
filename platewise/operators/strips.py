"""Whole pools in one task: a strip of queries meets every reference of its pools, so its ranking is complete there.

Listing the partners of a query costs as many entries as it has partners. Where pools are large but fit a task, the
queries that meet the same pools are instead cut into strips, a few for each core whatever their number, and all
references of the pools are sent to each strip. What leaves a strip is a few numbers per query; what is shuffled grows
with the references. Ranks are taken over a bounded block of similarities at a time.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.functions.arrow import matrix_of
from platewise.functions.cells import codes_of, complete_precision, holders_of, prepared, similarities
from platewise.session import cut_lineage

REF_BYTES = 256 << 20  # features of the references that a strip meets
STRIPS_PER_CORE = 4
LEAST_ROWS = 64
BLOCK = 4 << 20  # similarities at a time


def strip_rows(spark: SparkSession, total: int) -> int:
    """Queries in a strip, so that there are a few strips for each core."""
    return max(LEAST_ROWS, -(-total // (STRIPS_PER_CORE * spark.sparkContext.defaultParallelism)))


def width_of(df: DataFrame) -> int:
    first = df.select(F.size(C.FEATURES)).first()
    return 1 if first is None else max(first[0] or 0, 1)


def strip_of(queries: DataFrame, pools: DataFrame, keys: list[str]) -> DataFrame:
    """Queries with the number of their strip; ``pools`` gives the strips of each key."""
    own = F.pmod(F.xxhash64("id", F.lit(31)), F.col("strips")).cast("int")
    return queries.join(pools.select(*keys, "strips"), keys).withColumn("strip", own).drop("strips")


class Partners:
    """References of one role in a strip: similarities to a block of queries, and which of them are allowed."""

    def __init__(self, left: pa.Table, refs: pa.Table, mine: list[str], metric: str):
        self.metric = metric
        self.r = prepared(matrix_of(refs.column(C.FEATURES)), metric)
        self.codes = [codes_of(left.column("id"), refs.column("id"))]
        self.codes += [codes_of(left.column(m), refs.column(f"d{i}")) for i, m in enumerate(mine)]

    def block(self, q: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.r):
            return np.zeros((len(q[part]), 0)), np.zeros((len(q[part]), 0), bool)
        allowed = np.ones((len(q[part]), len(self.r)), bool)
        for own, theirs in self.codes:
            allowed &= own[part][:, None] != theirs[None, :]
        return similarities(q[part], self.r, self.metric), allowed


def blocks_of(rows: int, refs: int):
    step = min(1024, max(1, BLOCK // max(refs, 1)))
    return [slice(start, min(start + step, rows)) for start in range(0, rows, step)]


def strip_precision(df: DataFrame, row_id: str, pos, neg, query: Column | None, pools: DataFrame, keys: tuple[Column, Column],
                    metric: str) -> DataFrame:
    """``id, lab, n_pos, n_neg, average_precision`` of the queries whose ``(pk, nk)`` are in ``pools``."""
    wide = max(len(pos.differ), len(neg.differ))
    texts = F.lit(None).cast("array<string>")
    labels = lambda name: texts if name is None else F.col(name)
    identity = [F.col(row_id).cast("string").alias("id"), F.col(C.FEATURES)]
    asking = df if query is None else df.filter(query)
    queries = strip_of(asking.select(
        keys[0].alias("pk"), keys[1].alias("nk"), *identity,
        *[F.col(c).cast("string").alias(f"p{i}") for i, c in enumerate(pos.differ)],
        *[F.col(c).cast("string").alias(f"n{i}") for i, c in enumerate(neg.differ)],
        labels(pos.shared).alias("shared"), labels(neg.disjoint).alias("disjoint")), pools, ["pk", "nk"])
    axis = pools.select("pk", "nk", F.explode(F.sequence(F.lit(0), (F.col("strips") - 1).cast("int"))).alias("strip"))

    def partners(rule, key: Column, name: str, kind: str | None, is_pos: bool) -> DataFrame:
        rows = df if rule.ref is None else df.filter(rule.ref)
        differ = [(F.col(rule.differ[i]) if i < len(rule.differ) else F.lit(None)).cast("string").alias(f"d{i}") for i in range(wide)]
        held = rows.select(key.alias(name), *identity, *differ, labels(kind).alias("labels"))
        return held.join(axis, name).select(
            "pk", "nk", "strip", "id", C.FEATURES, *[f"d{i}" for i in range(wide)], "labels", F.lit(is_pos).alias("is_pos"))

    refs = partners(pos, keys[0], "pk", pos.shared, True).unionByName(partners(neg, keys[1], "nk", neg.disjoint, False))
    refs = refs.select(*[F.col(c).alias(c) for c in refs.columns])
    names = [[f"p{i}" for i in range(len(pos.differ))], [f"n{i}" for i in range(len(neg.differ))]]
    by_label, apart = pos.shared is not None, neg.disjoint is not None

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"id": [], "lab": [], "n_pos": [], "n_neg": [], "average_precision": []}
        if left.num_rows and right.num_rows:
            sides = [right.filter(right.column("is_pos")), right.filter(pc.invert(right.column("is_pos")))]
            with_pos, with_neg = [Partners(left, side, mine, metric) for side, mine in zip(sides, names)]
            q = prepared(matrix_of(left.column(C.FEATURES)), metric)
            ids = left.column("id").to_pylist()
            shared = left.column("shared").to_pylist() if by_label else None
            disjoint = left.column("disjoint").to_pylist() if apart else None
            pos_holders = holders_of(sides[0].column("labels")) if by_label else {}
            neg_holders = holders_of(sides[1].column("labels")) if apart else {}
            for part in blocks_of(len(q), max(len(with_pos.r), len(with_neg.r))):
                pos_sims, pos_ok = with_pos.block(q, part)
                neg_sims, neg_ok = with_neg.block(q, part)
                for i, row in enumerate(range(part.start, part.stop)):
                    for label in (disjoint[row] or []) if apart else []:
                        if label in neg_holders:
                            neg_ok[i, neg_holders[label]] = False
                    below = np.sort(neg_sims[i, neg_ok[i]])
                    if not len(below):
                        continue
                    if by_label:
                        found = [(label, pos_holders[label]) for label in dict.fromkeys(shared[row] or []) if label in pos_holders]
                        found = [(label, pos_sims[i, at][pos_ok[i, at]]) for label, at in found]
                    else:
                        found = [("", pos_sims[i, pos_ok[i]])]
                    for label, sims in found:
                        if len(sims):
                            for name, value in zip(out, (ids[row], label or "", len(sims), len(below), complete_precision(sims, below))):
                                out[name].append(value)
        return pa.table({"id": pa.array(out["id"], pa.string()), "lab": pa.array(out["lab"], pa.string()),
                         "n_pos": pa.array(out["n_pos"], pa.int64()), "n_neg": pa.array(out["n_neg"], pa.int64()),
                         "average_precision": pa.array(out["average_precision"], pa.float64())})

    keys_ = ["pk", "nk", "strip"]
    return queries.groupBy(*keys_).cogroup(refs.groupBy(*keys_)).applyInArrow(
        run, "id string, lab string, n_pos bigint, n_neg bigint, average_precision double")


def pools_fit(df: DataFrame, pool: list[str], ref: Column | None = None) -> bool:
    """Whether the references of every pool fit a task."""
    rows = df if ref is None else df.filter(ref)
    largest = rows.groupBy(*pool).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return largest * width_of(df) * 8 <= REF_BYTES


def top_sets(sims: np.ndarray, places: np.ndarray, ranks: list[int]) -> list[np.ndarray]:
    """Which references are among the first of each rank: higher similarities first, then smaller places; -inf never counts."""
    n = int(np.isfinite(sims).sum())
    within = sorted({len(sims) - k for k in ranks if k < n})
    ordered = np.partition(sims, within) if within else sims
    found = []
    for k in ranks:
        if k >= n:
            found.append(np.isfinite(sims))
            continue
        edge = ordered[len(sims) - k]
        top, ties = sims > edge, np.nonzero(sims == edge)[0]
        top[ties[np.argsort(places[ties])][:k - int(top.sum())]] = True
        found.append(top)
    return found


def strip_recall(df: DataFrame, row_id: str, pool: list[str], sets: str, labels: str, k_percent: tuple[float, ...],
                 query: Column | None = None, ref: Column | None = None, metric: str = "cosine") -> DataFrame:
    """``id, name, n_pos, n_refs, hits``: references that hold a label of the set, and how many are in the top of the pool.

    ``sets`` is an array of ``(name, labels)`` of a query, ``labels`` the array of a reference. Ties rank by reference
    id; a query's own row ranks last but counts in the pool; sets without a reference are left out. Every pool must fit a task.
    """
    key = F.concat_ws("\u0001", F.lit(""), *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in pool]).alias("pool_")
    identity = [key, F.col(row_id).cast("string").alias("id"), F.col(C.FEATURES)]
    queries = (df if query is None else df.filter(query)).select(*identity, F.col(sets).alias("sets")).filter("size(sets) > 0")
    refs = (df if ref is None else df.filter(ref)).select(*identity, F.col(labels).alias("labels"))
    pools = cut_lineage(queries.groupBy("pool_").agg(F.count(F.lit(1)).alias("n")))
    rows = strip_rows(df.sparkSession, int(pools.agg(F.sum("n")).first()[0] or 0))
    pools = pools.withColumn("strips", F.ceil(F.col("n") / rows))
    axis = pools.select("pool_", F.explode(F.sequence(F.lit(0), (F.col("strips") - 1).cast("int"))).alias("strip"))
    queries, refs = strip_of(queries, pools, ["pool_"]), refs.join(axis, "pool_")
    refs = refs.select(*[F.col(c).alias(c) for c in refs.columns])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"id": [], "name": [], "n_pos": [], "n_refs": [], "hits": []}
        if left.num_rows and right.num_rows:
            refs_, q = Partners(left, right, [], metric), prepared(matrix_of(left.column(C.FEATURES)), metric)
            places = np.argsort(np.argsort(np.asarray(right.column("id").to_pylist(), dtype=object)))
            holders, ids, asked = holders_of(right.column("labels")), left.column("id").to_pylist(), left.column("sets").to_pylist()
            ranks = [max(1, int(np.floor(right.num_rows * pct / 100))) for pct in k_percent]
            for part in blocks_of(len(q), right.num_rows):
                sims, allowed = refs_.block(q, part)
                sims[~allowed] = -np.inf
                for i, row in enumerate(range(part.start, part.stop)):
                    tops = None
                    for one in asked[row]:
                        held = [holders[label] for label in one["labels"] or [] if label in holders]
                        if not held:
                            continue
                        positive = np.zeros(right.num_rows, bool)
                        positive[np.concatenate(held)] = True
                        positive &= allowed[i]
                        n_pos = int(positive.sum())
                        if n_pos:
                            tops = tops or top_sets(sims[i], places, ranks)
                            hits = [int((top & positive).sum()) for top in tops]
                            for name, value in zip(out, (ids[row], one["name"], n_pos, right.num_rows, hits)):
                                out[name].append(value)
        return pa.table({"id": pa.array(out["id"], pa.string()), "name": pa.array(out["name"], pa.string()),
                         "n_pos": pa.array(out["n_pos"], pa.int64()), "n_refs": pa.array(out["n_refs"], pa.int64()),
                         "hits": pa.array(out["hits"], pa.list_(pa.int64()))})

    return queries.groupBy("pool_", "strip").cogroup(refs.groupBy("pool_", "strip")).applyInArrow(
        run, "id string, name string, n_pos bigint, n_refs bigint, hits array<bigint>")
