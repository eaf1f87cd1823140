"""Retrieval metrics: activity, consistency, batch effects and recall."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.functions.expressions import seeded_bucket
from platewise.functions.stats import exceeding
from platewise.operators.aggregate import group_medians
from platewise.operators.cuts import top_shares
from platewise.operators.similarity import (
    CELL_ROWS, PairRule, anchor_sims, average_precision, edge_anchors, partner_counts,
)
from platewise.operators.strips import pools_fit, strip_recall
from platewise.session import cut_lineage

# Euler's constant and the size of the exact harmonic table.
EULER_GAMMA = 0.5772156649015329
EXACT_HARMONICS = 32


def harmonic(n: Column) -> Column:
    """n-th harmonic number: a short table, then its asymptotic series."""
    table = F.array(*[F.lit(float(sum(1.0 / i for i in range(1, m + 1)))) for m in range(EXACT_HARMONICS + 1)])
    x = n.cast("double")
    series = F.log(x) + EULER_GAMMA + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(n <= EXACT_HARMONICS, F.get(table, n.cast("int"))).otherwise(series)


def expected_precision(n_pos: Column, n_total: Column) -> Column:
    """Mean average precision of a random ranking."""
    share = harmonic(n_total) / n_total
    return F.when(n_total <= 1, F.lit(1.0)).otherwise(share + (n_pos - 1) / (n_total - 1) * (1 - share))


def normalized_precision(ap: Column, n_pos: Column, n_total: Column) -> Column:
    expected = expected_precision(n_pos, n_total)
    return F.when(expected < 1, (ap - expected) / (1 - expected))


def with_normalized(ap: DataFrame) -> DataFrame:
    total = F.col("n_pos") + F.col("n_neg")
    return ap.withColumn("n_total", total).withColumn(
        "normalized_average_precision",
        normalized_precision(F.col("average_precision"), F.col("n_pos"), total))


def attach(ap: DataFrame, df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Give AP rows back their metadata."""
    meta = df.select(F.col(row_id).cast("string").alias("id"), *columns)
    return with_normalized(ap).join(meta, "id")


def mean_average_precision(ap: DataFrame, by: list[str]) -> DataFrame:
    """mAP and mean normalised AP per group, with the pair counts that shape the null."""
    scored = ap.filter(F.col("average_precision").isNotNull())
    return scored.groupBy(*by).agg(
        F.avg("average_precision").alias("mean_average_precision"),
        F.avg("normalized_average_precision").alias("mean_normalized_average_precision"),
        F.count(F.lit(1)).alias("n_replicates"))


def with_significance(maps: DataFrame, ap: DataFrame, by: list[str], null_size: int = 10_000,
                      threshold: float = 0.05, seed: int = 0, within: list[str] | None = None) -> DataFrame:
    """Permutation p values with Benjamini-Hochberg correction.

    The null of a group is the mean of its members' nulls, so only the multiplicity of
    each (positives, total) pair is needed. p values take at most ``null_size + 1``
    distinct values: the correction ranks those counts, never the groups.
    """
    shape = ap.filter(F.col("average_precision").isNotNull()).groupBy(*by, "n_pos", "n_total").agg(
        F.count(F.lit(1)).alias("n"))
    shapes = shape.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n_pos", "n_total", "n"))).alias("shapes"))
    # nulls cost far more than rows: groups of equal shapes go to one task, the others to any
    joined = maps.join(shapes, by).repartition(int(maps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shapes")
    at = joined.columns.index("shapes")
    score = joined.columns.index("mean_average_precision")

    def run(batches):
        for batch in batches:
            values = batch.column(score).to_numpy(zero_copy_only=False)
            alike = {}  # rows whose groups have the same shapes share one null distribution
            for i, shapes_ in enumerate(batch.column(at).to_pylist()):
                alike.setdefault(tuple(sorted((s["n_pos"], s["n_total"], s["n"]) for s in shapes_)), []).append(i)
            counts = np.empty(batch.num_rows, np.int64)
            for own, rows in alike.items():
                counts[rows] = exceeding(own, values[rows], null_size, seed)
            arrays = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64())], [*names, "exceed"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != "shapes"]
    counted = joined.mapInArrow(run, ", ".join([*fields, "exceed bigint"]))
    counted = counted.withColumn("p_value", (F.col("exceed") + 1) / F.lit(null_size + 1.0))
    return corrected(counted, "exceed", "p_value", within or []).drop("exceed").withColumn(
        "below_corrected_p", F.col("corrected_p_value") < threshold)


def corrected(df: DataFrame, rank_col: str, p_col: str, within: list[str]) -> DataFrame:
    """Benjamini-Hochberg over the distinct p values of each family."""
    family = [F.lit(0).alias("__family")] if not within else [F.col(c) for c in within]
    keys = ["__family"] if not within else within
    base = df.withColumn("__family", F.lit(0)) if not within else df
    levels = df.groupBy(*family, rank_col, p_col).agg(F.count(F.lit(1)).alias("__n"))
    up = Window.partitionBy(*keys).orderBy(rank_col)
    down = Window.partitionBy(*keys).orderBy(F.desc(rank_col))
    placed = levels.withColumn("__rank", F.sum("__n").over(up)).withColumn(
        "__m", F.sum("__n").over(Window.partitionBy(*keys)))
    adjusted = F.least(F.lit(1.0), F.min(F.col(p_col) * F.col("__m") / F.col("__rank")).over(down))
    table = placed.withColumn("corrected_p_value", adjusted).select(*keys, rank_col, "corrected_p_value")
    return base.join(table, [*keys, rank_col]).drop("__family")


# ---- activity and consistency ------------------------------------------------------


def phenotypic_activity(df: DataFrame, row_id: str = C.ROW_ID, compound: str = C.PERT, group: str = C.GROUP,
                        plate: str = C.PLATE, negcon: str = C.NEGCON, metric: str = "cosine",
                        cell_rows: int = CELL_ROWS) -> DataFrame:
    """AP of each treated profile: replicates against controls of its plate and group.

    Controls never serve as each other's positives, so only treated rows are queries.
    """
    treated, control = ~F.col(negcon), F.col(negcon)
    pos = PairRule(same=[compound, group], query=treated, ref=treated)
    neg = PairRule(same=[plate, group], differ=[compound], query=treated, ref=control)
    ap = average_precision(df, row_id, pos, neg, None, metric, cell_rows)
    return attach(ap, df, row_id, [compound, group])


def filter_targets(df: DataFrame, row_id: str, targets: str, compound: str = C.PERT,
                   scope: list[str] | None = None, min_compounds: int = 3, max_targets: int | None = 50,
                   keep_unknown: bool = False) -> DataFrame:
    """Drop promiscuous compounds, then targets with too few compounds.

    ``keep_unknown`` keeps rows without a valid target as background, labelled
    ``unknown``; otherwise they are dropped.
    """
    scope = scope or []
    known = F.array_distinct(F.filter(targets, lambda t: t != C.UNKNOWN))
    counted = F.size(known) if keep_unknown else F.size(targets)
    rows = df if max_targets is None else df.filter(counted <= max_targets)
    pairs = rows.select(row_id, *scope, compound, F.explode(known).alias("__t"))
    valid = pairs.groupBy(*scope, "__t").agg(F.count_distinct(compound).alias("__n")).filter(
        F.col("__n") >= min_compounds)
    kept = pairs.join(valid, [*scope, "__t"], "left_semi").groupBy(row_id).agg(
        F.array_sort(F.collect_set("__t")).alias("__kept"))
    joined = rows.join(kept, row_id, "left" if keep_unknown else "inner")
    if keep_unknown:
        joined = joined.filter(F.col("__kept").isNotNull() | F.array_contains(targets, C.UNKNOWN))
        joined = joined.withColumn("__kept", F.coalesce("__kept", F.array(F.lit(C.UNKNOWN))))
    return joined.withColumn(targets, F.col("__kept")).drop("__kept")


def target_profiles(df: DataFrame, compound: str = C.PERT, group: str = C.GROUP,
                    target_list: str = C.TARGET_LIST, negcon: str = C.NEGCON,
                    groups: list[str] | None = None, scope: list[str] | None = None) -> DataFrame:
    """Consensus profiles of treated rows with a target array and a row id."""
    rows = df.filter(F.col(group).isin(groups)) if groups else df
    rows = rows.filter(~F.col(negcon)).withColumn(target_list, F.coalesce(target_list, F.lit(C.UNKNOWN)))
    keys = list(dict.fromkeys([*(scope or []), compound, group, target_list]))
    merged = group_medians(rows, keys)
    return merged.withColumn("targets", F.split(target_list, r"\|")).withColumn(
        C.ROW_ID, F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def phenotypic_consistency(profiles: DataFrame, scope: list[str], row_id: str = C.ROW_ID,
                           compound: str = C.PERT, targets: str = "targets", min_compounds: int = 3,
                           max_targets: int | None = 50, keep_unknown: bool = False,
                           metric: str = "cosine", cell_rows: int = CELL_ROWS) -> DataFrame:
    """AP per (consensus profile, target): positives share the target, negatives none."""
    rows = cut_lineage(filter_targets(
        profiles, row_id, targets, compound, scope, min_compounds, max_targets, keep_unknown))
    known = ~F.array_contains(targets, C.UNKNOWN)
    pos = PairRule(same=scope, shared=targets, query=known, ref=known)
    neg = PairRule(same=scope, disjoint=targets, query=known)
    ap = average_precision(rows, row_id, pos, neg, None, metric, cell_rows)
    return attach(ap, rows, row_id, list(dict.fromkeys([*scope, compound]))).withColumnRenamed("lab", "target")


def subset_profiles(df: DataFrame, annotations: DataFrame, subsets: list[dict], active: DataFrame | None = None,
                    compound: str = C.PERT, group: str = C.GROUP, tier: str = "WithinModalityTier") -> DataFrame:
    """Profiles once per evaluation subset, with that subset's target list.

    Each subset is ``{subset, tiers, modality, active_only, background}``. All of them are
    evaluated in one pass because ``subset`` becomes part of the keys. ``background``
    also keeps compounds annotated in no tier at all, as unknowns.
    """
    options = F.array(*[F.struct(
        F.lit(s["subset"]).alias("subset"), F.array(*[F.lit(t) for t in s["tiers"]]).alias("tiers"),
        F.lit(s.get("modality", "all")).alias("modality"),
        F.lit(s.get("active_only", False)).alias("active_only"),
        F.lit(s.get("background", False)).alias("background")) for s in subsets])
    fits = lambda s: F.array_contains(s["tiers"], F.col(tier)) & (
        (s["modality"] == "all") | (s["modality"] == F.col("modality_clean")))
    tagged = annotations.withColumn("s", F.explode(F.filter(options, fits)))
    lists = tagged.groupBy("s.subset", "s.active_only", compound).agg(
        F.concat_ws("|", F.array_sort(F.collect_set("target"))).alias(C.TARGET_LIST))
    named = df.drop(C.TARGET_LIST)
    known = named.join(lists, compound)
    used = annotations.filter(F.col(tier) != "Excluded").select(compound).distinct()
    bare = named.join(used, compound, "left_anti").withColumn(
        "s", F.explode(F.filter(options, lambda s: s["background"])))
    unknown = bare.select(*named.columns, "s.subset", "s.active_only", F.lit(C.UNKNOWN).alias(C.TARGET_LIST))
    out = known.select(*unknown.columns).unionByName(unknown)
    if active is None:
        return out.filter(~F.col("active_only")).drop("active_only")
    flags = active.filter("below_corrected_p").select(compound, group).distinct().withColumn("__on", F.lit(True))
    return out.join(flags, [compound, group], "left").filter(
        ~F.col("active_only") | F.coalesce("__on", F.lit(False))).drop("__on", "active_only")


# ---- batch effects -----------------------------------------------------------------


def random_index(df: DataFrame, keys: list[str], per: Column, name: str, row_id: str, seed: int) -> DataFrame:
    """A seeded index between 1 and max(2, floor(per)) for each row of the keys' groups."""
    sizes = df.groupBy(*keys).agg(F.greatest(F.lit(2), F.floor(per)).cast("bigint").alias("__buckets"))
    return df.join(sizes, keys).withColumn(
        name, seeded_bucket(seed, F.col("__buckets"), row_id)).drop("__buckets")


def well_position_effect(df: DataFrame, row_id: str = C.ROW_ID, compound: str = C.PERT, group: str = C.GROUP,
                         plate: str = C.PLATE, well: str = C.WELL, negcon: str = C.NEGCON,
                         mode: str = "sampled", seed: int = 0, metric: str = "cosine") -> DataFrame:
    """Do equal well positions look alike across compounds?

    ``sampled``: positives on other plates, negatives within a random part of the plate.
    ``full``: positives on any plate, negatives anywhere on the plate.
    """
    rows = df.filter(~F.col(negcon))
    if mode == "sampled":
        wells = rows.groupBy(group, well).agg(F.count_distinct(plate).alias("n")).filter("n >= 2")
        rows = rows.join(wells, [group, well], "left_semi")
        per = F.count(F.lit(1)) / F.count_distinct(plate) / F.lit(15)
        rows = random_index(rows, [group], per, "random_index", row_id, seed)
        pos = PairRule(same=[group, well], differ=[plate, compound])
        neg = PairRule(same=[group, plate, "random_index"], differ=[well, compound])
    else:
        wells = rows.groupBy(group, well).agg(F.count_distinct(compound).alias("n")).filter("n >= 2")
        rows = rows.join(wells, [group, well], "left_semi")
        pos = PairRule(same=[group, well], differ=[compound])
        neg = PairRule(same=[group, plate], differ=[well, compound])
    return attach(average_precision(rows, row_id, pos, neg, None, metric), rows, row_id, [group, well])


def plate_effect(df: DataFrame, row_id: str = C.ROW_ID, compound: str = C.PERT, group: str = C.GROUP,
                 plate: str = C.PLATE, well: str = C.WELL, negcon: str = C.NEGCON, mode: str = "sampled",
                 seed: int = 0, metric: str = "cosine") -> DataFrame:
    """Can plates be told apart?

    ``sampled``: treatments, positives within a random part of a plate, negatives from a
    random part of the other plates. ``controls``: controls of one plate against the same
    well on other plates.
    """
    if mode == "controls":
        rows = df.filter(F.col(negcon))
        pos, neg = PairRule(same=[plate]), PairRule(same=[well], differ=[plate])
        return attach(average_precision(rows, row_id, pos, neg, None, metric), rows, row_id, [group, plate])
    rows = df.filter(~F.col(negcon))
    plates = rows.groupBy(group).agg(F.count_distinct(plate).alias("n")).filter("n >= 2")
    rows = rows.join(plates, group, "left_semi")
    per_plate = F.count(F.lit(1)) / F.count_distinct(plate) / F.lit(15)
    rows = random_index(rows, [group], per_plate, "index_pos", row_id, seed)
    rows = random_index(rows, [group], F.count(F.lit(1)) / F.lit(25), "index_neg", row_id, seed + 1)
    pos = PairRule(same=[group, plate, "index_pos"], differ=[compound])
    neg = PairRule(same=[group, "index_neg"], differ=[plate, well, compound])
    return attach(average_precision(rows, row_id, pos, neg, None, metric), rows, row_id, [group, plate])


# ---- summaries ---------------------------------------------------------------------


def activity_summary(maps: DataFrame, by: list[str], unit: str) -> DataFrame:
    """Share of significant groups and the spread of normalised mAP."""
    nap = F.col("mean_normalized_average_precision")
    flag = F.col("below_corrected_p").cast("int")
    return maps.groupBy(*by).agg(
        (F.avg(flag) * 100).alias("pct_active"), F.sum(flag).alias("num_active"),
        F.avg(nap).alias("mean_nap"), F.median(nap).alias("median_nap"),
        F.avg(F.greatest(nap, F.lit(0.0))).alias("mean_nap_clipped"),
        F.count_distinct(unit).alias("n_units"))


# ---- recall ------------------------------------------------------------------------


def recall_table(df: DataFrame, row_id: str, anchors: DataFrame, pool: list[str], query: Column | None = None,
                 ref: Column | None = None, k_percent: tuple[float, ...] = (1.0, 5.0, 10.0),
                 metric: str = "cosine", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Hits among the top k percent of the pool, per query with a positive.

    Ranks break ties by reference id. A query's own cell ranks last but stays part of
    the pool size, so k does not depend on it.
    """
    rule = PairRule(same=pool, query=query, ref=ref)
    anchors = cut_lineage(anchors)
    counts = partner_counts(df, row_id, rule, anchors, "by_id", metric, cell_rows)
    sizes = (df if ref is None else df.filter(ref)).groupBy(*pool).agg(F.count(F.lit(1)).alias("n_refs")) \
        if pool else None
    meta = df.select(F.col(row_id).cast("string").alias("id"), *pool)
    ranked = F.array_sort(F.arrays_zip(
        F.transform("anchors", lambda a: -a["sim"]).alias("minus"),
        F.transform("anchors", lambda a: a["ref"]).alias("ref"), F.col("counts").alias("above")))
    both = anchors.join(counts, "id", "left").withColumn(
        "counts", F.coalesce("counts", F.transform("anchors", lambda a: F.lit(0).cast("bigint"))))
    placed = both.withColumn("places", F.transform(ranked, lambda a, i: a["above"] + i + 1)).join(meta, "id")
    if pool:
        placed = placed.join(sizes, pool)
    else:
        total = (df if ref is None else df.filter(ref)).count()
        placed = placed.withColumn("n_refs", F.lit(total).cast("bigint"))
    out = [F.size("anchors").alias("n_pos"), F.col("n_refs")]
    for pct in k_percent:
        k = F.greatest(F.lit(1), F.floor(F.col("n_refs") * F.lit(pct) / 100))
        hits = F.size(F.filter("places", lambda p: p <= k))
        out.append((hits / F.size("anchors")).alias(f"recall_{pct:g}"))
    return placed.select("id", *pool, *out)


def shares(found: DataFrame, k_percent: tuple[float, ...]) -> list:
    """Recall columns of hits among the top at each percentage."""
    return [(F.col("hits")[i] / F.col("n_pos")).alias(f"recall_{pct:g}") for i, pct in enumerate(k_percent)]


def one_set(labels: Column) -> Column:
    return F.array(F.struct(F.lit("").alias("name"), labels.alias("labels")))


def edge_recall(df: DataFrame, row_id: str, edges: DataFrame, pool: list[str], query: Column | None = None,
                ref: Column | None = None, k_percent: tuple[float, ...] = (1.0, 5.0, 10.0), metric: str = "cosine",
                cell_rows: int = CELL_ROWS) -> DataFrame:
    """``recall_table`` for positive pairs ``(query_id, ref_id)`` inside the pools: partners are told by id, not listed with
    similarities, while every pool fits a task."""
    if not pools_fit(df, pool, ref):
        return recall_table(df, row_id, edge_anchors(df, row_id, edges, query, ref, metric), pool, query, ref, k_percent, metric, cell_rows)
    text = lambda c: F.col(c).cast("string")
    partners = edges.groupBy(text("query_id").alias("id_")).agg(one_set(F.collect_set(text("ref_id"))).alias("sets_"))
    rows = cut_lineage(df.withColumn("id_", text(row_id)).join(partners, "id_", "left").withColumn("labels_", F.array("id_")))
    found = strip_recall(rows, row_id, pool, "sets_", "labels_", k_percent, query, ref, metric)
    meta = rows.select(F.col("id_").alias("id"), *pool)
    return found.join(meta, "id").select("id", *pool, "n_pos", "n_refs", *shares(found, k_percent))


def recall_summary(table: DataFrame, by: list[str]) -> DataFrame:
    recalls = [c for c in table.columns if c.startswith("recall_")]
    return table.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries_with_positives"), F.sum("n_pos").alias("n_positive_pairs"),
        F.max("n_refs").alias("n_references"), *[F.avg(c).alias(c) for c in recalls])


def consensus_rows(df: DataFrame, compound: str = C.PERT, group: str = C.GROUP, negcon: str = C.NEGCON,
                   symbol: str | None = None) -> DataFrame:
    """Consensus profiles of treated rows with ``row_id = compound|group``."""
    keys = [compound, group, *([symbol] if symbol else [])]
    return group_medians(df.filter(~F.col(negcon)), keys).withColumn(
        C.ROW_ID, F.concat_ws("|", F.col(compound).cast("string"), F.col(group).cast("string")))


def edges_to_rows(rows: DataFrame, edges: DataFrame, compound: str, query: Column | None, ref: Column | None,
                  on: list[str] | None = None) -> DataFrame:
    """Map compound-level edges to row-level ``(query_id, ref_id)`` pairs."""
    on = on or []
    q = (rows if query is None else rows.filter(query)).select(
        F.col(compound).alias("__a"), F.col(C.ROW_ID).alias("query_id"), *on)
    r = (rows if ref is None else rows.filter(ref)).select(
        F.col(compound).alias("__b"), F.col(C.ROW_ID).alias("ref_id"), *on)
    pairs = edges.select(F.col("Metadata_JCP2022").alias("__a"), F.col("partner_jcp").alias("__b")).distinct()
    return pairs.join(q, "__a").join(r, ["__b", *on]).select("query_id", "ref_id")


def compound_recall(rows: DataFrame, edges: DataFrame, groups: list[str], compound: str = C.PERT,
                    group: str = C.GROUP, **options) -> DataFrame:
    """Compound to compound recall inside each compound group."""
    scope = rows.filter(F.col(group).isin(groups))
    cc = edges.filter(F.col("source") == "cc")
    pairs = edges_to_rows(scope, cc, compound, None, None, [group])
    return edge_recall(scope, C.ROW_ID, pairs, [group], **options)


def shared_target_recall(rows: DataFrame, targets: str, pool: list[str], k_percent: tuple[float, ...] = (1.0, 5.0, 10.0),
                         **options) -> DataFrame:
    """Recall whose positives share a target. Neither pairs nor partners are listed, whatever the size of a target.

    Pools that fit a task are ranked whole; beyond that histograms over cells of ``cell_rows`` narrow the wanted ranks.
    """
    if pools_fit(rows, pool):
        own = rows.withColumn("sets_", one_set(F.coalesce(F.col(targets), F.array().cast("array<string>"))))
        found = strip_recall(own, C.ROW_ID, pool, "sets_", targets, k_percent, metric=options.get("metric", "cosine"))
        sized = rows.select(F.col(C.ROW_ID).cast("string").alias("id"), *pool)
        return found.join(sized, "id").select("id", *pool, "n_pos", "n_refs", *shares(found, k_percent))
    found = top_shares(rows, C.ROW_ID, pool, targets, k_percent, **options)
    return found.select("id", *pool, "n_pos", "n_refs", *shares(found, k_percent))


def gene_recall(rows: DataFrame, edges: DataFrame, pool: str = "full", compound: str = C.PERT,
                group: str = C.GROUP, modalities: tuple[str, ...] = ("orf", "crispr"), **options) -> DataFrame:
    """Gene to gene recall per modality; ``filtered`` keeps genes that have an edge."""
    named = rows.filter(F.col(group).isin([f"group_{m}" for m in modalities]))
    # read by several branches below: edges may be distinct rows of a large table
    gg = cut_lineage(edges.filter(F.col("source") == "gg").select(
        "Metadata_JCP2022", "partner_jcp", F.concat(F.lit("group_"), F.col("target_modality")).alias(group)))
    if pool == "filtered":
        ends = gg.select(F.col("Metadata_JCP2022").alias(compound), group).unionByName(
            gg.select(F.col("partner_jcp").alias(compound), group)).distinct()
        named = cut_lineage(named.join(ends, [compound, group], "left_semi"))
    a = named.select(F.col(compound).alias("Metadata_JCP2022"), group, F.col(C.ROW_ID).alias("query_id"))
    b = named.select(F.col(compound).alias("partner_jcp"), group, F.col(C.ROW_ID).alias("ref_id"))
    pairs = gg.distinct().join(
        a, ["Metadata_JCP2022", group]).join(b, ["partner_jcp", group])
    return edge_recall(named, C.ROW_ID, pairs, [group], **options)


def cross_recall(rows: DataFrame, pairs: DataFrame, query_groups: list[str], ref_group: str,
                 group: str = C.GROUP, allowed_refs: DataFrame | None = None, metric: str = "cosine",
                 **options) -> DataFrame:
    """Recall of queries of some groups in the pool of one reference group.

    ``pairs`` are row-level positives; ``allowed_refs`` (row ids) restricts the pool.
    """
    is_query, is_ref = F.col(group).isin(query_groups), F.col(group) == ref_group
    scope = rows.filter(is_query | is_ref)
    if allowed_refs is not None:
        kept = scope.filter(is_ref).join(allowed_refs, C.ROW_ID, "left_semi")
        scope = scope.filter(is_query & ~is_ref).unionByName(kept)
    table = edge_recall(scope, C.ROW_ID, pairs, [], is_query, is_ref, metric=metric, **options)
    names = scope.select(F.col(C.ROW_ID).alias("id"), F.col(group))
    return table.join(names, "id").withColumn("reference_group", F.lit(ref_group))


def compound_gene_recall(rows: DataFrame, edges: DataFrame, modality: str, query_groups: list[str],
                         pool: str = "full", compound: str = C.PERT, group: str = C.GROUP, **options) -> DataFrame:
    """Compound to gene recall for one modality and pool."""
    cg = edges.filter((F.col("source") == "cg") & (F.col("target_modality") == modality)
                      & F.col("partner_jcp").isNotNull())
    ref = F.col(group) == f"group_{modality}"
    pairs = edges_to_rows(rows, cg, compound, F.col(group).isin(query_groups), ref)
    allowed = None
    if pool == "filtered":
        genes = cg.select(F.col("partner_jcp").alias(compound)).distinct()
        allowed = rows.filter(ref).join(genes, compound, "left_semi").select(C.ROW_ID)
    return cross_recall(rows, pairs, query_groups, f"group_{modality}", group, allowed, **options)


def edge_coverage(rows: DataFrame, edges: DataFrame, kind: str, compound: str = C.PERT,
                  group: str = C.GROUP) -> DataFrame:
    """Per modality: edges, genes in the graph, genes with profiles, and their overlap."""
    used = edges.filter((F.col("source") == kind) & F.col("target_modality").isNotNull())
    ends = used.select("target_modality", F.col("partner_jcp").alias("gene"))
    if kind == "gg":
        ends = ends.unionByName(used.select("target_modality", F.col("Metadata_JCP2022").alias("gene")))
    genes = ends.distinct()
    profiled = rows.select(F.regexp_replace(group, "^group_", "").alias("target_modality"),
                           F.col(compound).alias("gene")).distinct()
    edge_counts = used.groupBy("target_modality").agg(F.count(F.lit(1)).alias("n_edges"))
    flags = genes.withColumn("g", F.lit(1)).join(
        profiled.withColumn("p", F.lit(1)), ["target_modality", "gene"], "full")
    overlap = flags.groupBy("target_modality").agg(
        F.count("g").alias("genes_in_graph"), F.count("p").alias("genes_in_profiles"),
        F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("genes_in_both"))
    return edge_counts.join(overlap, "target_modality")


def symbol_pairs(rows: DataFrame, targets: DataFrame, compound: str = C.PERT, group: str = C.GROUP,
                 symbol: str = C.SYMBOL) -> DataFrame:
    """Positives between annotated compounds ``(compound, target[, subset])`` and genes by symbol."""
    extra = [c for c in targets.columns if c not in (compound, "target")]
    q = rows.select(compound, F.col(C.ROW_ID).alias("query_id"))
    r = rows.filter(F.col(symbol).isNotNull()).select(
        F.col(symbol).alias("target"), F.col(C.ROW_ID).alias("ref_id"), F.col(group).alias("ref_group"))
    return targets.join(q, compound).join(r, "target").select(*extra, "query_id", "ref_id", "ref_group")


def subset_recall(rows: DataFrame, targets: DataFrame, query_groups: list[str], ref_groups: list[str],
                  active: DataFrame | None = None, compound: str = C.PERT, group: str = C.GROUP,
                  symbol: str = C.SYMBOL, direction: str = "top", **options) -> DataFrame:
    """Cross-modality recall for all subsets at once.

    ``targets`` is ``(subset, compound, target)``. The pool of a reference group is the
    same for every subset, so each query is ranked once per reference group and its hits
    are split by subset afterwards. ``active`` limits queries and references.
    """
    metric = "cosine" if direction == "top" else "anticosine"
    used = rows if active is None else rows.join(
        active.select(compound, group).distinct(), [compound, group], "left_semi")
    k_percent = options.get("k_percent", (1.0, 5.0, 10.0))
    if pools_fit(used, [group], F.col(group).isin(ref_groups)):
        lists = targets.filter(F.col("target").isNotNull()).groupBy(compound, "subset").agg(F.collect_set("target").alias("labels"))
        sets = lists.groupBy(compound).agg(F.collect_list(F.struct(F.col("subset").alias("name"), "labels")).alias("sets"))
        asked = used.filter(F.col(group).isin(query_groups)).join(sets, compound).select(
            F.explode(F.array(*[F.lit(g) for g in ref_groups])).alias("pool"), C.ROW_ID, "sets",
            F.lit(None).cast("array<string>").alias("labels"), F.lit(True).alias("is_query"), C.FEATURES)
        # a row is its own query in another role: text keeps its id apart from those of references
        asked = asked.withColumn("key", F.concat_ws("\u0001", F.col(C.ROW_ID).cast("string"), F.lit("?")))
        held = used.filter(F.col(group).isin(ref_groups)).select(
            F.col(group).alias("pool"), C.ROW_ID, F.lit(None).cast(asked.schema["sets"].dataType).alias("sets"),
            F.array_compact(F.array(symbol)).alias("labels"), F.lit(False).alias("is_query"), C.FEATURES,
            F.col(C.ROW_ID).cast("string").alias("key"))
        scope = cut_lineage(asked.unionByName(held).withColumn("key", F.when(
            F.col("is_query"), F.concat_ws("\u0001", "key", "pool")).otherwise(F.col("key"))))
        found = strip_recall(scope, "key", ["pool"], "sets", "labels", k_percent, F.col("is_query"), ~F.col("is_query"), metric)
        own = F.split("id", "\u0001")
        names = used.select(F.col(C.ROW_ID).cast("string").alias("query_id"), F.col(group).alias("query_group"))
        per_query = found.select(F.col("name").alias("subset"), own[0].alias("query_id"), own[2].alias("ref_group"), "n_pos", "n_refs",
                                 *shares(found, k_percent)).join(names, "query_id")
        return recall_summary(per_query, ["subset", "query_group", "ref_group"]).withColumn("direction", F.lit(direction))
    # a query appears once per reference group, so that the group is an ordinary pool
    tagged = lambda query, pool: F.concat_ws(">", query, pool)
    pairs = cut_lineage(symbol_pairs(used, targets, compound, group, symbol).filter(
        F.col("ref_group").isin(ref_groups)).distinct().withColumn("tag", tagged("query_id", "ref_group")))
    pools = F.explode(F.array(*[F.lit(g) for g in ref_groups]))
    queries = used.filter(F.col(group).isin(query_groups)).withColumn("pool", pools).select(
        tagged(C.ROW_ID, "pool").alias(C.ROW_ID), "pool", F.lit(True).alias("is_query"), C.FEATURES)
    refs = used.filter(F.col(group).isin(ref_groups)).select(
        C.ROW_ID, F.col(group).alias("pool"), F.lit(False).alias("is_query"), C.FEATURES)
    scope = queries.unionByName(refs)
    asks, answers = F.col("is_query"), ~F.col("is_query")
    edges = pairs.select(F.col("tag").alias("query_id"), "ref_id")
    anchors = cut_lineage(edge_anchors(scope, C.ROW_ID, edges, asks, answers, metric))
    rule = PairRule(same=["pool"], query=asks, ref=answers)
    counts = partner_counts(scope, C.ROW_ID, rule, anchors, "by_id", metric)
    # rank over the whole pool: non-anchors above plus anchors of any subset above
    zipped = F.array_sort(F.arrays_zip(
        F.transform("anchors", lambda a: -a["sim"]).alias("minus"),
        F.transform("anchors", lambda a: a["ref"]).alias("ref"), F.col("counts").alias("above")))
    both = anchors.join(counts, "id", "left").withColumn(
        "counts", F.coalesce("counts", F.transform("anchors", lambda a: F.lit(0).cast("bigint"))))
    ranks = both.select("id", F.posexplode(zipped)).select(
        F.col("id").alias("tag"), F.col("col.ref").alias("ref_id"),
        (F.col("col.above") + F.col("pos") + 1).alias("place"))
    placed = pairs.join(ranks, ["tag", "ref_id"])
    sizes = used.groupBy(F.col(group).alias("ref_group")).agg(F.count(F.lit(1)).alias("n_refs"))
    names = used.select(F.col(C.ROW_ID).alias("query_id"), F.col(group).alias("query_group"))
    per_query = placed.join(sizes, "ref_group").join(names, "query_id").groupBy(
        "subset", "query_group", "ref_group", "query_id").agg(
        F.count(F.lit(1)).alias("n_pos"), F.max("n_refs").alias("n_refs"),
        *[F.avg((F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n_refs") * F.lit(p) / 100)))
                .cast("double")).alias(f"recall_{p:g}") for p in k_percent])
    return recall_summary(per_query, ["subset", "query_group", "ref_group"]).withColumn(
        "direction", F.lit(direction))


def genetic_pairs(rows: DataFrame, query_group: str, ref_group: str, group: str = C.GROUP,
                  symbol: str = C.SYMBOL) -> DataFrame:
    """Row-level positives between two genetic modalities by equal symbol."""
    named = rows.filter(F.col(symbol).isNotNull() & (F.col(symbol) != ""))
    q = named.filter(F.col(group) == query_group).select(symbol, F.col(C.ROW_ID).alias("query_id"))
    r = named.filter(F.col(group) == ref_group).select(symbol, F.col(C.ROW_ID).alias("ref_id"))
    return q.join(r, symbol).select("query_id", "ref_id")


def symbol_recall(rows: DataFrame, query_group: str, ref_group: str, group: str = C.GROUP, symbol: str = C.SYMBOL,
                  k_percent: tuple[float, ...] = (1.0, 5.0, 10.0), metric: str = "cosine", **options) -> DataFrame:
    """Recall between two genetic modalities whose positives have equal symbols; a symbol of many rows is never paired out."""
    is_query, is_ref = F.col(group) == query_group, F.col(group) == ref_group
    if not pools_fit(rows, [], is_ref):
        pairs = genetic_pairs(rows, query_group, ref_group, group, symbol)
        return cross_recall(rows, pairs, [query_group], ref_group, group, metric=metric, k_percent=k_percent, **options)
    own = F.filter(F.array(F.col(symbol).cast("string")), lambda s: s.isNotNull() & (s != ""))
    scope = cut_lineage(rows.filter(is_query | is_ref).withColumn("labels_", own).withColumn("sets_", one_set(F.col("labels_"))))
    found = strip_recall(scope, C.ROW_ID, [], "sets_", "labels_", k_percent, is_query, is_ref, metric)
    names = scope.filter(is_query).select(F.col(C.ROW_ID).cast("string").alias("id"), F.col(group))
    return found.join(names, "id").select("id", "n_pos", "n_refs", *shares(found, k_percent), group).withColumn(
        "reference_group", F.lit(ref_group))
