"""Blocked similarity: exact ranks without ever emitting all pairs.

Queries and references meet in *cells*. A pool (the rows sharing the equality keys of a
rule) that is small shares a cell with other small pools; a large pool is cut into a grid
of cells, each side repeated along one axis only, so a task sees a bounded number of rows
whatever the pool size. Inside a cell numpy computes similarities; only two things leave:

* anchors: for each query, the similarities of the smaller kind of partner;
* counts: for each query and anchor, how many partners of the other kind rank above it.

Ranks, average precision and recall follow exactly from these. Where such a list would be long and whole pools fit
a task, ``strips`` ranks queries against whole pools instead.
"""

from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.functions.arrow import matrix_of
from platewise.functions.cells import DIGITS, STEP, Cell, count_above, precision_of, prepared, row_similarities
from platewise.operators import strips
from platewise.session import cut_lineage

CELL_ROWS = 4096
EDGE_ROWS = 1024
TOP_BYTES = 64 << 20  # features of either side of a cell of ``top_k``
TOP_STEP = 2048
STRIP_COST = 50_000  # values that would take as long to send as a strip takes to begin


@dataclass(frozen=True)
class PairRule:
    """Which references a query meets.

    ``same`` columns are equal, ``differ`` columns differ, ``shared`` is a label array
    with a common element (each element is a pool of its own), ``disjoint`` a label array
    without one. ``query`` and ``ref`` restrict the two roles.
    """

    same: list[str] = field(default_factory=list)
    differ: list[str] = field(default_factory=list)
    shared: str | None = None
    disjoint: str | None = None
    query: Column | None = None
    ref: Column | None = None


def text_key(names: list[str]) -> Column:
    if not names:
        return F.lit("")
    return F.concat_ws("\u0001", *[F.coalesce(F.col(n).cast("string"), F.lit("\u0002")) for n in names])


def side(df: DataFrame, rule: PairRule, row_id: str, keep: Column | None, extra: list[str]) -> DataFrame:
    """Rows of one role: pool, id, features and what the rule compares."""
    rows = df if keep is None else df.filter(keep)
    cols = [F.col(row_id).cast("string").alias("id"), F.col(C.FEATURES)]
    cols += [F.col(c).cast("string").alias(f"d{i}") for i, c in enumerate(rule.differ)]
    if rule.disjoint:
        cols.append(F.col(rule.disjoint).alias("labels"))
    cols += [F.col(c) for c in extra]
    if rule.shared:
        rows = rows.withColumn("lab", F.explode(F.array_distinct(F.col(rule.shared))))
        return rows.select(text_key([*rule.same, "lab"]).alias("pool"), F.col("lab"), *cols)
    return rows.select(text_key(rule.same).alias("pool"), F.lit(None).cast("string").alias("lab"), *cols)


def into_cells(queries: DataFrame, refs: DataFrame, cell_rows: int,
               bound: DataFrame | None = None, ref_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Assign both sides to cells; a pool pair meets in exactly one cell per row pair.

    Pool sizes of both sides come from one aggregation. ``bound`` may name a cheaper table
    with at least the queries' pools, to size them from; ``ref_rows`` may allow a cell more references than queries.
    """
    spark = queries.sparkSession
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = (queries if bound is None else bound).select("pool", one.alias("q"), none.alias("r")).unionByName(
        refs.select("pool", none.alias("q"), one.alias("r")))
    # pools that share a cell: so many cells that one holds about half of ``cell_rows``
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * both.count() // cell_rows)
    counted = both.groupBy("pool").agg(F.sum("q").alias("q"), F.sum("r").alias("r")).filter("q > 0 and r > 0")
    grid = counted.select(
        "pool", F.ceil(F.col("q") / cell_rows).cast("int").alias("gq"),
        F.ceil(F.col("r") / (ref_rows or cell_rows)).cast("int").alias("gr"))
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(29)), F.col(n)).cast("int")
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shared_cell = F.pmod(F.xxhash64("pool"), F.lit(buckets))
    cell = F.when((F.col("gq") == 1) & (F.col("gr") == 1), shared_cell).otherwise(
        F.xxhash64("pool", "cq", "cr"))
    left = queries.join(grid, "pool").withColumn("cq", own("gq")).withColumn("cr", axis("gr"))
    right = refs.join(grid, "pool").withColumn("cr", own("gr")).withColumn("cq", axis("gq"))
    drop = ["gq", "gr", "cq", "cr"]
    left = left.withColumn("cell", cell).drop(*drop)
    right = right.withColumn("cell", cell).drop(*drop)
    # both sides may come from one table: give the right side columns of its own
    return left, right.select(*[F.col(c).alias(c) for c in right.columns])


def anchor_sims(df: DataFrame, row_id: str, rule: PairRule, metric: str = "cosine",
                cell_rows: int = CELL_ROWS) -> DataFrame:
    """``id, anchors array<struct<lab, ref, sim>>`` for queries with at least one partner."""
    queries, refs = into_cells(side(df, rule, row_id, rule.query, []),
                               side(df, rule, row_id, rule.ref, []), cell_rows)
    differ, disjoint = len(rule.differ), rule.disjoint is not None

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"id": [], "lab": [], "ref": [], "sim": []}
        if left.num_rows and right.num_rows:
            cell = Cell(left, right, differ, disjoint, metric)
            ids, labs = left.column("id").to_pylist(), left.column("lab").to_pylist()
            names = np.asarray(right.column("id").to_pylist(), dtype=object)
            for part, rs, sims, allowed in cell.steps():
                for i, q in enumerate(part):
                    hit = allowed[i]
                    if hit.any():
                        out["id"].append(ids[q])
                        out["lab"].append(labs[q])
                        out["ref"].append(names[rs[hit]].tolist())
                        out["sim"].append(sims[i, hit])
        return pa.table({
            "id": pa.array(out["id"], pa.string()), "lab": pa.array(out["lab"], pa.string()),
            "ref": pa.array(out["ref"], pa.list_(pa.string())),
            "sim": pa.array(out["sim"], pa.list_(pa.float64()))})

    found = queries.groupBy("cell").cogroup(refs.groupBy("cell")).applyInArrow(
        run, "id string, lab string, ref array<string>, sim array<double>")
    zipped = F.transform(F.arrays_zip("ref", "sim"), lambda a: F.struct(
        F.col("lab").alias("lab"), a["ref"].alias("ref"), a["sim"].alias("sim")))
    return found.groupBy("id").agg(F.flatten(F.collect_list(zipped)).alias("anchors"))


def partner_counts(df: DataFrame, row_id: str, rule: PairRule, anchors: DataFrame, mode: str,
                   metric: str = "cosine", cell_rows: int = CELL_ROWS) -> DataFrame:
    """``id, counts, total``: partners under ``rule`` above each anchor, and in all.

    ``mode``: ``negatives`` counts strictly greater ones, ``positives`` also equal ones,
    ``by_id`` breaks ties by the smaller id and leaves the anchors themselves out.
    """
    carried = df.join(anchors.withColumnRenamed("id", "__id"),
                      F.col(row_id).cast("string") == F.col("__id")).drop("__id")
    queries, refs = into_cells(side(carried, rule, row_id, rule.query, ["anchors"]),
                               side(df, rule, row_id, rule.ref, []), cell_rows,
                               side(df, rule, row_id, rule.query, []))
    differ, disjoint = len(rule.differ), rule.disjoint is not None

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"id": [], "counts": [], "total": []}
        if left.num_rows and right.num_rows:
            cell = Cell(left, right, differ, disjoint, metric)
            ids = left.column("id").to_pylist()
            names = np.asarray(right.column("id").to_pylist(), dtype=object)
            packed = left.column("anchors").combine_chunks()
            offsets = packed.offsets.to_numpy()
            flat = packed.values
            all_sim = flat.field("sim").to_numpy(zero_copy_only=False)
            all_ref = np.asarray(flat.field("ref").to_pylist(), dtype=object)
            for part, rs, sims, allowed in cell.steps():
                local = names[rs]
                index = {n: j for j, n in enumerate(local)} if mode == "by_id" else None
                for i, q in enumerate(part):
                    a_sim = all_sim[offsets[q]:offsets[q + 1]]
                    a_ref = all_ref[offsets[q]:offsets[q + 1]]
                    hit = allowed[i].copy()
                    if mode == "by_id":
                        hit[[index[a] for a in a_ref if a in index]] = False
                    counts = count_above(sims[i, hit], sims[i, hit], local[hit], a_sim, a_ref, mode)
                    out["id"].append(ids[q])
                    out["counts"].append(counts.astype(np.int64))
                    out["total"].append(int(hit.sum()))
        return pa.table({"id": pa.array(out["id"], pa.string()),
                         "counts": pa.array(out["counts"], pa.list_(pa.int64())),
                         "total": pa.array(out["total"], pa.int64())})

    found = queries.groupBy("cell").cogroup(refs.groupBy("cell")).applyInArrow(
        run, "id string, counts array<bigint>, total bigint")
    lists = F.collect_list("counts")
    summed = F.aggregate(F.slice(lists, 2, F.size(lists)), F.element_at(lists, 1),
                         lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))
    return found.groupBy("id").agg(summed.alias("counts"), F.sum("total").alias("total"))


def average_precision(df: DataFrame, row_id: str, pos: PairRule, neg: PairRule, anchor: str | None = None,
                      metric: str = "cosine", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Average precision of each query over its ranked positives and negatives.

    Ties rank positives first. Queries lacking either kind have no precision and are left out. Queries that meet the
    same large pools are ranked in strips against the whole pools; for the others the partners of one kind are listed:
    of the kind that ``anchor`` names, or of that with fewer rows in its pools. Both ways give the same rows.
    Returns ``id, lab, n_pos, n_neg, average_precision``.
    """
    keys = text_key(pos.same), text_key(neg.same)
    query = pos.query if neg.query is None else neg.query if pos.query is None else pos.query & neg.query
    sized = lambda keep, columns: (df if keep is None else df.filter(keep)).groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("n"))
    asked = sized(query, [keys[0].alias("pk"), keys[1].alias("nk")]).withColumnRenamed("n", "q")
    pools = cut_lineage(asked.join(sized(pos.ref, [keys[0].alias("pk")]).withColumnRenamed("n", "p"), "pk").join(
        sized(neg.ref, [keys[1].alias("nk")]).withColumnRenamed("n", "m"), "nk"))
    total = pools.agg(F.sum("q")).first()[0] or 0
    width = strips.width_of(df)
    rows = strips.strip_rows(df.sparkSession, int(total))
    # values sent either way: all references to every strip, or some eight for each partner listed
    pools = pools.withColumn("strips", F.ceil(F.col("q") / rows))
    sent = F.col("strips") * ((F.col("p") + F.col("m")) * (width + 1) + STRIP_COST)
    listed = F.lit(8.0) * F.col("q") * F.least("p", "m")
    fits = (F.col("p") + F.col("m")) * width * 8 <= strips.REF_BYTES
    plain = pos.disjoint is None and neg.shared is None
    whole = fits & F.lit(plain) & (F.lit(pos.shared is not None) | (sent < listed))
    pools = pools.withColumn("whole", whole)
    kinds = {r["whole"]: r for r in pools.groupBy("whole").agg(
        F.sum(F.col("q") * F.col("p")).alias("p"), F.sum(F.col("q") * F.col("m")).alias("m")).collect()}
    parts = []
    if True in kinds:
        parts.append(strips.strip_precision(df, row_id, pos, neg, query, pools.filter("whole"), keys, metric))
    if False in kinds or not kinds:
        rest = df
        if True in kinds:
            few = pools.filter("not whole").select(F.col("pk").alias("__pk"), F.col("nk").alias("__nk"), F.lit(True).alias("__few"))
            rest = cut_lineage(df.withColumn("__pk", keys[0]).withColumn("__nk", keys[1]).join(few, ["__pk", "__nk"], "left"))
            here = F.coalesce("__few", F.lit(False))
            pos, neg = [replace(rule, query=here if rule.query is None else rule.query & here) for rule in (pos, neg)]
        if anchor is None:
            anchor = "pos" if pos.shared is not None or not kinds or kinds[False]["p"] <= kinds[False]["m"] else "neg"
        parts.append(listed_precision(rest, row_id, pos, neg, anchor, metric, cell_rows))
    return reduce(DataFrame.unionByName, parts)


def listed_precision(df: DataFrame, row_id: str, pos: PairRule, neg: PairRule, anchor: str, metric: str,
                     cell_rows: int) -> DataFrame:
    """Average precision from a list of each query's partners of one kind and counts of the other kind."""
    first, second = (pos, neg) if anchor == "pos" else (neg, pos)
    mode = "negatives" if anchor == "pos" else "positives"
    # read by several branches below: computed once, whatever is lost later
    anchors = cut_lineage(anchor_sims(df, row_id, first, metric, cell_rows))
    counts = partner_counts(df, row_id, second, anchors, mode, metric, cell_rows)
    both = anchors.join(counts, "id", "left").select(
        "id", "anchors", F.coalesce("counts", F.transform("anchors", lambda a: F.lit(0).cast("bigint"))).alias("counts"),
        F.coalesce("total", F.lit(0)).alias("total"))

    def finish(batches):
        for batch in batches:
            out = {"id": [], "lab": [], "n_pos": [], "n_neg": [], "ap": []}
            for row in batch.to_pylist():
                labs = np.asarray([a["lab"] or "" for a in row["anchors"]], dtype=object)
                sims = np.asarray([a["sim"] for a in row["anchors"]], dtype=float)
                above = np.asarray(row["counts"])
                for lab in sorted(set(labs)):
                    at = labs == lab
                    n_pos, n_neg, ap = precision_of(sims[at], above[at], anchor, row["total"])
                    for key, value in zip(out, (row["id"], lab, n_pos, n_neg, ap)):
                        out[key].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["id"], pa.string()), pa.array(out["lab"], pa.string()),
                 pa.array(out["n_pos"], pa.int64()), pa.array(out["n_neg"], pa.int64()),
                 pa.array(out["ap"], pa.float64())],
                ["id", "lab", "n_pos", "n_neg", "average_precision"])

    scored = both.mapInArrow(
        finish, "id string, lab string, n_pos bigint, n_neg bigint, average_precision double")
    return scored.filter("average_precision is not null")


def edge_anchors(df: DataFrame, row_id: str, edges: DataFrame, query: Column | None = None,
                 ref: Column | None = None, metric: str = "cosine", block_rows: int = EDGE_ROWS) -> DataFrame:
    """Anchors for explicit positive pairs ``(query_id, ref_id)`` given as a table.

    Ids are hashed into blocks and every edge is addressed to the cell of its two blocks. Only ids travel with edges; a
    row's features go once to each cell in which it has an edge, so a row with very many edges goes to as many cells as
    there are blocks, and no cell holds more than two blocks of rows and the edges between them.
    """
    # so many blocks that one holds about ``block_rows`` rows
    blocks = max(1, -(-df.count() // block_rows))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    text = lambda c: F.col(c).cast("string").alias(c)
    addressed = cut_lineage(edges.select(text("query_id"), text("ref_id")).filter("query_id <> ref_id").distinct().withColumn(
        "cell", block("query_id") * blocks + block("ref_id")))

    def placed(role: str, keep: Column | None, asks: bool) -> DataFrame:
        rows = (df if keep is None else df.filter(keep)).select(F.col(row_id).cast("string").alias("id"), C.FEATURES)
        where = addressed.select("cell", F.col(role).alias("id")).distinct()
        return where.join(rows, "id").select("cell", "id", C.FEATURES, F.lit(asks).alias("asks"))

    rows = placed("query_id", query, True).unionByName(placed("ref_id", ref, False))
    # both sides come from the addressed edges: give the rows columns of their own
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])

    def run(pairs: pa.Table, held: pa.Table) -> pa.Table:
        asks = held.column("asks")
        sides = [held.filter(asks), held.filter(pc.invert(asks))] if held.num_rows else [held, held]
        at = [pc.index_in(pairs.column(c), value_set=side.column("id").combine_chunks()) for c, side in zip(("query_id", "ref_id"), sides)]
        found = pc.and_(*[pc.is_valid(a) for a in at])
        pairs, (qs, rs) = pairs.filter(found), [a.filter(found).to_numpy() for a in at]
        sims = np.zeros(0)
        if pairs.num_rows:
            q, r = [prepared(matrix_of(side.column(C.FEATURES)), metric) for side in sides]
            sims = np.concatenate([row_similarities(q[qs[i:i + STEP]], r[rs[i:i + STEP]], metric) for i in range(0, len(qs), STEP)])
        return pa.table({"query_id": pairs.column("query_id"), "ref_id": pairs.column("ref_id"), "sim": pa.array(sims, pa.float64())})

    met = addressed.groupBy("cell").cogroup(rows.groupBy("cell")).applyInArrow(run, "query_id string, ref_id string, sim double")
    item = F.struct(F.lit(None).cast("string").alias("lab"), F.col("ref_id").alias("ref"), "sim")
    return met.groupBy(F.col("query_id").alias("id")).agg(F.collect_list(item).alias("anchors"))


def top_k(df: DataFrame, row_id: str, rule: PairRule, k: int, metric: str = "cosine",
          cell_rows: int = CELL_ROWS) -> DataFrame:
    """The k most similar references of each query; ties by the smaller reference id.

    Each cell keeps k partners per query, which is enough for the exact overall k. A pool beyond ``cell_rows`` is cut
    into strips of queries, a few for each core, and blocks of references that fit a task.
    """
    width = strips.width_of(df)
    ask, hold = side(df, rule, row_id, rule.query, []), side(df, rule, row_id, rule.ref, [])
    left_rows = max(cell_rows, min(strips.strip_rows(df.sparkSession, ask.count()), TOP_BYTES // (8 * width)))
    queries, refs = into_cells(ask, hold, left_rows, ref_rows=max(cell_rows, TOP_BYTES // (8 * width)))
    differ, disjoint = len(rule.differ), rule.disjoint is not None

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "ref_id": [], "sim": []}
        if left.num_rows and right.num_rows:
            cell = Cell(left, right, differ, disjoint, metric)
            ids = left.column("id").to_pylist()
            names = np.asarray(right.column("id").to_pylist(), dtype=object)
            places = np.argsort(np.argsort(names))
            by_place = names[np.argsort(places)]
            top, held = np.full((len(ids), k), -np.inf), np.full((len(ids), k), len(names))
            for part, rs, sims, allowed in cell.steps(TOP_STEP, TOP_STEP, rounded=False):
                edge = top[part, -1]
                if np.isinf(edge).any() and sims.shape[1] > k:
                    sims[~allowed] = -np.inf
                    edge = np.maximum(edge, np.partition(sims, -k, axis=1)[:, -k])
                # rounding may raise a similarity to that of the k-th
                hits = np.flatnonzero(sims >= edge[:, None] - 10.0**(1 - DIGITS))
                rows, at = np.divmod(hits, sims.shape[1])
                kept = allowed[rows, at]
                rows, at = rows[kept], at[kept]
                some = np.unique(rows)
                owner = np.concatenate([rows, np.repeat(some, k)])
                values = np.concatenate([np.round(sims[rows, at], DIGITS), top[part[some]].ravel()])
                order = np.concatenate([places[rs[at]], held[part[some]].ravel()])
                ranked = np.lexsort((order, -values, owner))
                owner = owner[ranked]
                rank = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
                first = rank < k
                top[part[owner[first]], rank[first]] = values[ranked][first]
                held[part[owner[first]], rank[first]] = order[ranked][first]
            for q, (own, at) in enumerate(zip(top, held)):
                n = int((own > -np.inf).sum())
                out["query_id"].extend([ids[q]] * n)
                out["ref_id"].extend(by_place[at[:n]].tolist())
                out["sim"].extend(own[:n].tolist())
        return pa.table({"query_id": pa.array(out["query_id"], pa.string()),
                         "ref_id": pa.array(out["ref_id"], pa.string()),
                         "sim": pa.array(out["sim"], pa.float64())})

    found = queries.groupBy("cell").cogroup(refs.groupBy("cell")).applyInArrow(
        run, "query_id string, ref_id string, sim double")
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "ref_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
