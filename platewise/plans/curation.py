"""Metadata curation from registry tables to annotated wells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.operators import annotations as A
from platewise.operators import metadata as M
from platewise.session import cut_lineage


def curate(registry: dict[str, DataFrame], profiles: DataFrame, cc: DataFrame, cg: DataFrame,
           min_fill: float = 25.0, negcon_fraction: float = 1.0, min_replicates: int = 4, seed: int = 42,
           denied: DataFrame | None = None, tiers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The eight curation steps; returns annotated wells and step membership.

    ``registry`` holds well, plate, compound, crispr and orf; ``cc`` and ``cg`` are the
    structure-keyed annotation tables. What several steps start from is written once, so that the
    annotation tables are not read anew for every step.
    """
    key = "Metadata_InChIKey"
    keys = [cc.select(F.col("inchikey_a").alias(key)).unionByName(cc.select(F.col("inchikey_b").alias(key))),
            cg.select(F.col("inchikey").alias(key))]
    structures = cut_lineage(M.structure_map(keys, registry["compound"]))
    wanted = structures.select(C.PERT).unionByName(
        registry["crispr"].select(C.PERT)).unionByName(registry["orf"].select(C.PERT)).dropna().distinct()
    raw = cut_lineage(M.classify(M.wells_with_plates(registry["well"], registry["plate"], wanted),
                                 registry["crispr"], registry["orf"], registry["compound"]))
    filtered = M.filter_plates(raw, registry["plate"], min_fill=min_fill)
    everything = M.wells_with_plates(registry["well"], registry["plate"])
    controls = M.sample_controls(M.control_wells(filtered, everything), negcon_fraction, seed)
    matched = cut_lineage(M.match_to_profiles(filtered, controls, profiles, denied))
    replicated = M.replicate_filter(matched, min_replicates)
    lists = M.target_lists(
        cg.filter(F.col("inchikey").isNotNull())
        .withColumn("InChIKey_Connectivity", M.connectivity("inchikey"))
        .join(structures.select("InChIKey_Connectivity", C.PERT), "InChIKey_Connectivity"))
    out = M.target_column(replicated, lists, "Metadata_graph_target")
    if tiers is not None:
        strong = tiers.filter(F.col("WithinModalityTier").isin("Tier1", "Tier2", "Tier3"))
        out = M.target_column(out, M.target_lists(strong), "Metadata_tier_target")
    steps = {"structures": structures, "raw": raw, "filtered": filtered, "matched": matched,
             "replicated": replicated}
    return out, M.membership(steps)


def build_graph(metadata: DataFrame, cg: DataFrame, cc: DataFrame, gg: DataFrame, structures: DataFrame,
                mode: str = "full", target_col: str = "Metadata_graph_target") -> DataFrame:
    """Edge list of the annotation graph in one of three strictness modes, one schema."""
    if mode == "full":
        parts = [A.cg_edges(metadata, target_col), A.cc_edges(cc, structures), A.gg_edges(gg, metadata)]
    elif mode == "strict":
        targets = A.curated_targets(cg, structures, "strict")
        parts = [A.cg_edges_curated(targets, metadata), A.bridged_edges(targets),
                 A.gg_edges(gg, metadata, A.GG_STRICT)]
    elif mode == "ultra_strict":
        targets = A.curated_targets(cg, structures, "ultra")
        parts = [A.cg_edges_curated(targets, metadata).select(*A.EDGE).distinct(),
                 A.bridged_edges(targets, ["target", "action_class"]), A.gg_edges(gg, metadata, A.GG_ULTRA)]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    out = parts[0].select(*A.EDGE)
    for part in parts[1:]:
        out = out.unionByName(part.select(*A.EDGE))
    return out
