"""The top of a ranking without listing it: order statistics of similarities from histograms over cells.

Every pair has a whole-number key that sorts as the ranking does: the rounded similarity first, then the place of the
reference id, smaller ids ahead. For each query and each wanted rank an interval of keys is narrowed: cells count the
keys of its references in ``BINS`` bins of the interval, counts are summed over cells, and the bin that holds the rank
is the next interval. It ends when the rank is that of the lowest key in its interval, after two or three rounds, or
after all rounds, with a single key, among very many equal rows. Neither partners nor references are listed, so
a query with a third of all rows as partners sends as many numbers as any other.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.functions.cells import DIGITS, Cell
from platewise.operators.similarity import CELL_ROWS, PairRule, into_cells, side
from platewise.session import cut_lineage

BITS = 8  # of a key that a round settles
BINS = 1 << BITS
PLACE_BITS = 27
KEY_BITS = 36 + PLACE_BITS
STATE = "id string, low array<bigint>, need array<bigint>, open bigint"


def id_places(df: DataFrame, row_id: str) -> DataFrame:
    """``id, place``: the dense number of every id in text order, from ranges of ids and the counts of the ranges."""
    ids = df.select(F.col(row_id).cast("string").alias("id")).distinct()
    ordered = ids.repartitionByRange("id").sortWithinPartitions("id")

    def numbered(batches):
        from pyspark import TaskContext

        own, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(n, own), pa.int32()), pa.array(np.arange(seen, seen + n))], ["id", "part", "local"])
            seen += n

    held = cut_lineage(ordered.mapInArrow(numbered, "id string, part int, local long"))
    # one count per range reaches the driver
    counts = sorted(map(tuple, held.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()))
    starts = np.cumsum([0, *[n for _, n in counts]])
    if starts[-1] >= 1 << PLACE_BITS:
        raise ValueError(f"{starts[-1]} references; a key has room for {1 << PLACE_BITS}")
    if not counts:
        return held.select("id", F.col("local").alias("place"))
    start = F.create_map(*[F.lit(x) for (part, _), at in zip(counts, starts.tolist()) for x in (part, at)])
    return held.select("id", (start[F.col("part")] + F.col("local")).alias("place"))


def keys_of(sims: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whole numbers that rise with the similarity and, at equal ones, fall with the place of the id."""
    whole = np.rint(sims * 10**DIGITS).astype(np.int64) + 2 * 10**DIGITS
    return (whole << PLACE_BITS) | ((1 << PLACE_BITS) - 1 - places)


def cell_keys(left: pa.Table, right: pa.Table, metric: str):
    """(query row of the cell, reference rows, keys) for every query of a cell; the query's own row is left out."""
    if not (left.num_rows and right.num_rows):
        return
    places = right.column("place").to_numpy()
    for part, rs, sims, allowed in Cell(left, right, 0, False, metric).steps():
        keys = keys_of(sims, places[rs][None, :])
        for i, q in enumerate(part):
            yield q, rs[allowed[i]], keys[i, allowed[i]]


def summed_lists(name: str):
    lists = F.collect_list(name)
    return F.aggregate(F.slice(lists, 2, F.size(lists)), F.element_at(lists, 1), lambda a, x: F.zip_with(a, x, lambda u, v: u + v))


def narrowed(state: DataFrame, counts: DataFrame) -> DataFrame:
    """The next, smaller interval of every query and rank, and how far into it the rank lies."""
    both = state.join(counts, "id", "left").select("id", "low", "need", "counts", "shift")

    def choose(batches):
        for batch in batches:
            lows, needs, opens = [], [], []
            for low, need, counts_, shift in zip(*[batch.column(i).to_pylist() for i in range(1, 5)]):
                table = np.zeros((len(low), BINS), np.int64) if counts_ is None else np.array(counts_, np.int64).reshape(len(low), BINS)
                above = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] - table  # keys in higher bins
                ranks = np.array(need)[:, None]
                holds = (above < ranks) & (above + table >= ranks)
                at = np.where(holds.any(axis=1), holds.argmax(axis=1), 0)  # fewer references than the rank: the lowest key
                lows.append([a + (int(b) << shift) for a, b in zip(low, at)])
                left = ranks[:, 0] - above[np.arange(len(at)), at]
                needs.append(left.tolist())
                opens.append(int((holds.any(axis=1) & (table[np.arange(len(at)), at] > left)).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lows, pa.list_(pa.int64())), pa.array(needs, pa.list_(pa.int64())),
                 pa.array(opens, pa.int64())], ["id", "low", "need", "open"])

    return both.mapInArrow(choose, STATE)


def top_shares(df: DataFrame, row_id: str, pool: list[str], labels: str, k_percent: tuple[float, ...], metric: str = "cosine",
               cell_rows: int = CELL_ROWS) -> DataFrame:
    """``id, n_pos, n_refs, hits``: partners that share a label, and how many are in the top of the pool at each percentage.

    A query's own row ranks last but counts in the pool; queries without a partner are left out.
    """
    rule = PairRule(same=pool)
    base = df.join(df.groupBy(*pool).agg(F.count(F.lit(1)).alias("n_refs")), pool) if pool else df.withColumn(
        "n_refs", F.lit(df.count()).cast("bigint"))
    places = id_places(df, row_id)
    rows = cut_lineage(base.withColumn("id_", F.col(row_id).cast("string")).join(places.withColumnRenamed("id", "id_"), "id_"))
    ranks = [F.greatest(F.lit(1), F.floor(F.col("n_refs") * F.lit(pct) / 100)).cast("bigint") for pct in k_percent]
    state = cut_lineage(rows.select(F.col("id_").alias("id"), F.array(*[F.lit(0).cast("bigint") for _ in ranks]).alias("low"),
                                    F.array(*ranks).alias("need")))

    def met(extra: list[str], run, schema: str) -> DataFrame:
        asking = rows.join(state.withColumnRenamed("id", "id_"), "id_")
        left, right = into_cells(side(asking, rule, row_id, None, extra), side(rows, rule, row_id, None, ["place", labels]), cell_rows,
                                 side(rows, rule, row_id, None, []))
        return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(run, schema)

    def histograms(shift: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, found = [], []
            names = left.column("id").to_pylist()
            lows = left.column("low").to_pylist() if left.num_rows else []
            for q, _, keys in cell_keys(left, right, metric):
                ids.append(names[q])
                table = []
                for low in lows[q]:
                    at = (keys - low) >> shift
                    table.append(np.bincount(at[(at >= 0) & (at < BINS)], minlength=BINS))
                found.append(np.concatenate(table))
            return pa.table({"id": pa.array(ids, pa.string()), "counts": pa.array(found, pa.list_(pa.int64()))})

        return run

    shift = KEY_BITS
    while shift:
        shift = max(0, shift - BITS)
        counts = met(["low"], histograms(shift), "id string, counts array<bigint>").groupBy("id").agg(summed_lists("counts").alias("counts"))
        state = cut_lineage(narrowed(state.drop("open").withColumn("shift", F.lit(shift)), counts))
        if not state.agg(F.max("open")).first()[0]:
            break

    def hits(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found = [], []
        if left.num_rows and right.num_rows:
            names, lows = left.column("id").to_pylist(), left.column("low").to_pylist()
            mine = left.column(labels).to_pylist()
            holders = {}
            for j, own in enumerate(right.column(labels).to_pylist()):
                for label in set(own or []):
                    holders.setdefault(label, []).append(j)
            for q, rs, keys in cell_keys(left, right, metric):
                shares = np.zeros(right.num_rows, bool)
                for label in mine[q] or []:
                    shares[holders.get(label, [])] = True
                positive = keys[shares[rs]]
                ids.append(names[q])
                found.append([len(positive), *[int((positive >= low).sum()) for low in lows[q]]])
        return pa.table({"id": pa.array(ids, pa.string()), "counts": pa.array(found, pa.list_(pa.int64()))})

    found = met(["low", labels], hits, "id string, counts array<bigint>").groupBy("id").agg(summed_lists("counts").alias("counts"))
    sized = rows.select(F.col("id_").alias("id"), "n_refs", *pool)
    return found.filter(F.col("counts")[0] > 0).join(sized, "id").select(
        "id", *pool, F.col("counts")[0].alias("n_pos"), "n_refs", F.slice("counts", 2, len(ranks)).alias("hits"))
