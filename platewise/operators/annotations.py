"""Annotation graph: confidence tiers, edges between compounds and genes, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.operators.blocks import salted_self_pairs
from platewise.operators.metadata import connectivity, target_lists

# Relation types accepted per edge kind and strictness.
CG_STRICT = [
    "target", "targets", "binds", "BINDS_CHbG", "DRUG_BINDING_GENE", "DRUG_INHIBITION_GENE",
    "inhibitor", "DRUG_ACTIVATION_GENE", "agonist", "antagonist", "enzyme",
]
GG_STRICT = ["ppi", "PPI", "GENE_BINDING_GENE", "INTERACTS_GiG", "interacts", "GENE_PTMOD_GENE"]
GG_ULTRA = ["ppi", "PPI", "GENE_BINDING_GENE", "GENE_PTMOD_GENE"]
ACTIONS = {
    "inhibitory": [
        "inhibitor", "antagonist", "blocker", "negative modulator", "inverse agonist",
        "DRUG_INHIBITION_GENE", "inhibitory allosteric modulator",
    ],
    "activating": [
        "agonist", "activator", "positive modulator", "partial agonist", "DRUG_ACTIVATION_GENE",
        "agonist,allosteric modulator",
    ],
    "binding": [
        "binds", "targets", "modulator", "allosteric modulator", "DRUG_BINDACT_GENE",
        "agonist,antagonist", "blocker,activator",
    ],
}
# fixed values: the accepted relation types, kept apart from their classes so that an unmapped one is noticed
CG_ULTRA = [
    "inhibitor", "antagonist", "blocker", "negative modulator", "inverse agonist", "DRUG_INHIBITION_GENE",
    "inhibitory allosteric modulator", "agonist", "activator", "positive modulator", "partial agonist",
    "DRUG_ACTIVATION_GENE", "agonist,allosteric modulator", "binds", "targets", "modulator", "allosteric modulator",
    "DRUG_BINDACT_GENE", "agonist,antagonist", "blocker,activator",
]

# pairs of genes that a task makes distinct
PAIRS_PER_TASK = 1_000_000

EDGE = ["Metadata_JCP2022", "target", "partner_jcp", "target_modality", "source"]


def tier_annotate(evidence: DataFrame, compound: str = C.PERT) -> DataFrame:
    """Confidence tiers of compound-target evidence with support above one.

    Counts come from aggregations joined back, so a hub target is never sorted. A missing
    count (no strong evidence) fails every comparison and falls through to Tier3.
    """
    df = evidence.filter((F.col("target_type") == "gene") & (F.col("support") > 1))
    strong = F.nullif(F.count_if(F.col("support") >= 5), F.lit(0))
    by_compound = df.groupBy(compound).agg(
        strong.alias("c_geq5"), F.count(F.lit(1)).alias("c_gt1"))
    by_target = df.groupBy("target").agg(
        strong.alias("t_geq5"), F.count(F.lit(1)).alias("t_gt1"),
        F.count_distinct("mode").alias("__modes"), F.max(F.col("mode").isNull().cast("int")).alias("__null_mode"))
    rows = df.join(by_compound, compound).join(by_target, "target")
    stated = F.col("mode") != "unspecified"
    single = (F.col("c_gt1") == 1) & (F.col("c_geq5") == 1)
    cross = (
        F.when(single & (F.col("t_gt1") == 1) & (F.col("t_geq5") == 1) & stated, "Tier0")
        .when(single & stated, "Tier1")
        .when((F.col("c_geq5") < 3) & stated, "Tier2")
        .otherwise("Tier3"))
    one_mode = (F.col("__modes") + F.col("__null_mode")) == 1
    flags = {
        "e0": stated & one_mode & single,
        "e1": stated & one_mode & (F.col("c_geq5") == 1),
        "e2": stated & one_mode,
        "e3": F.col("t_gt1") > 1,
    }
    rows = rows.withColumn("CrossModalityTier", cross).withColumns(
        {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    counts = rows.groupBy("target").agg(*[F.count_if(F.col(k)).alias(f"n_{k}") for k in flags])
    joined = rows.join(counts, "target")
    within = F.lit("Excluded")
    for i in (3, 2, 1, 0):
        within = F.when(F.col(f"e{i}") & (F.col(f"n_e{i}") >= 2), f"Tier{i}").otherwise(within)
    return joined.select(
        *evidence.columns,
        F.col("c_geq5").alias("Num_Cmpd2Target_Interactions_geq5"),
        F.col("c_gt1").alias("Num_Cmpd2Target_Interactions_gt1"),
        F.col("t_geq5").alias("Num_TargetByCmpd_Interactions_geq5"),
        F.col("t_gt1").alias("Num_TargetByCmpd_Interactions_gt1"),
        "CrossModalityTier", within.alias("WithinModalityTier"))


def evidence_overlap(compounds: DataFrame, raw: DataFrame) -> DataFrame:
    """Evidence rows of registered compounds, matched by the full structure string."""
    return compounds.select(C.PERT, "Metadata_InChI").join(
        raw.distinct().withColumnRenamed("InChI_standardized", "Metadata_InChI"), "Metadata_InChI")


def match_genes(tiered: DataFrame, registry: DataFrame) -> DataFrame:
    """Evidence to genetic perturbations, by direction where the direction is stated."""
    genes = registry.filter(F.col("modality") != "compound").select(
        F.col(C.PERT).alias("Metadata_JCP2022_target"), "modality", F.col("standard_key").alias("target"),
        F.when(F.col("modality") == "orf", "Positive").otherwise("Negative").alias("modality_clean"))
    stated = tiered.filter(F.col("mode") != "unspecified")
    by_direction = stated.withColumn("modality_clean", F.col("mode")).join(genes, ["target", "modality_clean"])
    open_ = tiered.filter(F.col("mode") == "unspecified").join(genes, "target")
    return by_direction.withColumn("cmpd_pert_dir_matched", F.lit(True)).unionByName(
        open_.withColumn("cmpd_pert_dir_matched", F.lit(False)))


def gene_lookup(metadata: DataFrame) -> DataFrame:
    """``(target, partner_jcp, target_modality)`` of genetic perturbations."""
    return metadata.filter(F.col(C.PERT_TYPE).isin("orf", "crispr") & F.col(C.SYMBOL).isNotNull()).select(
        F.col(C.SYMBOL).cast("string").alias("target"), F.col(C.PERT).cast("string").alias("partner_jcp"),
        F.col(C.PERT_TYPE).cast("string").alias("target_modality")).distinct()


def as_edges(df: DataFrame, source: str, extra: list[str] | None = None) -> DataFrame:
    text = F.lit(None).cast("string")
    have = lambda n: F.col(n) if n in df.columns else text.alias(n)
    return df.withColumn("source", F.lit(source)).select(
        "Metadata_JCP2022", have("target"), "partner_jcp", have("target_modality"), "source", *(extra or []))


def compound_targets(metadata: DataFrame, target_col: str) -> DataFrame:
    """Exploded pipe-joined targets of compounds."""
    listed = metadata.filter(
        (F.col(C.PERT_TYPE) == "compound") & F.col(target_col).isNotNull() & (F.col(target_col) != C.UNKNOWN))
    one = listed.groupBy(F.col(C.PERT).cast("string").alias("Metadata_JCP2022")).agg(F.min(target_col).alias("__t"))
    return one.withColumn("target", F.explode(F.array_distinct(F.split("__t", r"\|")))).filter(
        F.col("target") != "").drop("__t")


def cg_edges(metadata: DataFrame, target_col: str) -> DataFrame:
    """Compound to gene edges from the target lists in the metadata."""
    return as_edges(compound_targets(metadata, target_col).join(gene_lookup(metadata), "target"), "cg")


def action_table(spark) -> DataFrame:
    rows = [(rel, action) for action, rels in ACTIONS.items() for rel in rels]
    return spark.createDataFrame(rows, ["rel_type", "action_class"])


def curated_targets(curated: DataFrame, structures: DataFrame, strictness: str = "strict") -> DataFrame:
    """``(compound, target[, rel_type, action_class])`` of accepted relation types.

    ``structures`` maps connectivity blocks to perturbation ids. A relation type without
    an action class is an error in the ultra-strict mode.
    """
    allowed = CG_STRICT if strictness == "strict" else CG_ULTRA
    kept = curated.filter(F.col("rel_type").isin(allowed))
    cols = ["Metadata_JCP2022", "target"]
    if strictness != "strict":
        kept = kept.join(action_table(curated.sparkSession), "rel_type", "left").withColumn(
            "action_class", F.coalesce("action_class", F.raise_error(
                F.concat(F.lit("no action class for "), F.col("rel_type"))).cast("string")))
        cols += ["rel_type", "action_class"]
    mapped = kept.withColumn("InChIKey_Connectivity", connectivity("inchikey")).join(
        structures.select("InChIKey_Connectivity", F.col(C.PERT).cast("string").alias("Metadata_JCP2022")),
        "InChIKey_Connectivity")
    return mapped.filter(F.col("target").isNotNull() & (F.col("target") != "")).select(*cols).distinct()


def cg_edges_curated(targets: DataFrame, metadata: DataFrame) -> DataFrame:
    extra = [c for c in ("rel_type", "action_class") if c in targets.columns]
    return as_edges(targets.join(gene_lookup(metadata), "target"), "cg", extra)


def symmetric(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of every pair, each once."""
    flipped = pairs.withColumnsRenamed({a: "__a", b: a}).withColumnRenamed("__a", b)
    return pairs.unionByName(flipped).distinct()


def cc_edges(pairs: DataFrame, structures: DataFrame) -> DataFrame:
    """Compound to compound edges from a structure pair table."""
    ids = structures.select("InChIKey_Connectivity", F.col(C.PERT).cast("string").alias("id")).distinct()
    a = ids.select(F.col("InChIKey_Connectivity").alias("__ka"), F.col("id").alias("Metadata_JCP2022"))
    b = ids.select(F.col("InChIKey_Connectivity").alias("__kb"), F.col("id").alias("partner_jcp"))
    keyed = pairs.select(connectivity("inchikey_a").alias("__ka"), connectivity("inchikey_b").alias("__kb")).distinct()
    met = keyed.join(a, "__ka").join(b, "__kb").filter("Metadata_JCP2022 <> partner_jcp")
    return as_edges(symmetric(met.select("Metadata_JCP2022", "partner_jcp"), "Metadata_JCP2022", "partner_jcp"), "cc")


def bridged_edges(targets: DataFrame, keys: list[str] | None = None, block: int = 4096) -> DataFrame:
    """Compound pairs sharing a target (or target and action class), both directions.

    A hub target is split over block pairs. A pair sharing several targets is emitted only
    for the smallest of them, so no global distinct is needed. The edge list is as long as
    the graph it describes; ``shared_target_recall`` scores the same positives without it.
    """
    keys = keys or ["target"]
    rows = targets.select("Metadata_JCP2022", F.concat_ws("\u0001", *keys).alias("__hub")).distinct()
    hubs = rows.groupBy("Metadata_JCP2022").agg(F.collect_set("__hub").alias("hubs"))
    carried = rows.join(hubs, "Metadata_JCP2022").withColumnRenamed("Metadata_JCP2022", "id")
    pairs = salted_self_pairs(carried, ["__hub"], "id", ["id", "hubs"], block)
    first = F.array_min(F.array_intersect("hubs_a", "hubs_b")) == F.col("__hub")
    met = pairs.filter((F.col("id_a") != F.col("id_b")) & first)
    return as_edges(met.select(F.col("id_a").alias("Metadata_JCP2022"), F.col("id_b").alias("partner_jcp")), "cc")


def gg_edges(pairs: DataFrame, metadata: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Gene to gene edges within each modality, symmetrised.

    The modality is part of the join key, so both modalities are resolved in one pass. An edge is made distinct once,
    smaller id first, and both directions follow from it. Rows meet their equals before any are collected, in tasks
    whose number grows with the pairs.
    """
    kept = pairs if allowed is None else pairs.filter(F.col("rel_type").isin(allowed))
    stated = kept.filter("target_a is not null and target_b is not null and target_a <> target_b")
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), stated.count() // PAIRS_PER_TASK)
    apart = lambda df: df.repartition(tasks, *df.columns).distinct()
    canon = apart(stated.select(F.least("target_a", "target_b").alias("lo"), F.greatest("target_a", "target_b").alias("hi")))
    genes = gene_lookup(metadata)
    low = genes.select(F.col("target").alias("lo"), F.col("partner_jcp").alias("a"), "target_modality")
    high = genes.select(F.col("target").alias("hi"), F.col("partner_jcp").alias("b"), "target_modality")
    met = canon.join(low, "lo").join(high, ["hi", "target_modality"]).filter("a <> b")
    once = apart(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "target_modality"))
    way = lambda a, b: F.struct(F.col(a).alias("Metadata_JCP2022"), F.col(b).alias("partner_jcp"))
    sides = once.select("target_modality", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("way"))
    return as_edges(sides.select("way.*", "target_modality"), "gg")


def build_splits(raw: DataFrame, structures: DataFrame, key: str, split: str) -> DataFrame:
    """Split table by perturbation id, mapped by structure where that is the key."""
    named = raw.select(F.col(key).alias("__key"), F.col(split).alias("split"))
    if key in ("Metadata_JCP2022", "JCP2022"):
        return named.select(F.col("__key").alias("Metadata_JCP2022"), "split").distinct()
    if key in ("Metadata_InChIKey", "InChIKey", "inchikey", "compound_inchikey"):
        ids = structures.select("InChIKey_Connectivity", F.col(C.PERT).alias("Metadata_JCP2022"))
        return named.withColumn("InChIKey_Connectivity", connectivity("__key")).join(
            ids, "InChIKey_Connectivity").select("Metadata_JCP2022", "split").distinct()
    raise ValueError(f"cannot map split key {key!r}")


def restrict_to_split(df: DataFrame, splits: DataFrame, split: str, compound: str = C.PERT,
                      groups: list[str] | None = None) -> DataFrame:
    """Compounds only of one split; genetic rows untouched."""
    if C.PERT_TYPE in df.columns:
        is_compound = F.col(C.PERT_TYPE) == "compound"
    elif C.GROUP in df.columns:
        is_compound = F.col(C.GROUP).isin(groups or ["group_high", "group_low"])
    else:
        raise ValueError("no column tells compounds from genes")
    wanted = splits.filter(F.col("split") == split).select(F.col(compound).cast("string").alias(compound)).distinct()
    flags = wanted.withColumn("__in", F.lit(True))
    return df.withColumn(compound, F.col(compound).cast("string")).join(flags, compound, "left").filter(
        ~F.coalesce(is_compound, F.lit(False)) | F.col("__in")).drop("__in").select(*df.columns)


def attach_target_list(df: DataFrame, edges: DataFrame, compound: str = C.PERT) -> DataFrame:
    cg = edges.filter(F.col("source") == "cg").select(F.col("Metadata_JCP2022").alias(compound), "target")
    return df.drop(C.TARGET_LIST).join(target_lists(cg, compound), compound, "left")
