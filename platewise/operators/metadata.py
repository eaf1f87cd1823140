"""Perturbation metadata: joins, filters, controls and target columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.functions.expressions import seeded_number, seeded_order
from platewise.operators.blocks import ordinal_rank

# Control perturbations per modality, and the pooled source groups.
MODALITY_CONTROLS = {
    "COMPOUND": ["JCP2022_033924"],
    "CRISPR": ["JCP2022_800001"],
    "ORF": ["JCP2022_915128", "JCP2022_915129", "JCP2022_915130", "JCP2022_915131"],
}
DEFAULT_CONTROL_ID = "JCP2022_085227"
SOURCE_GROUPS = {
    "group_high": ["source_2", "source_6", "source_8"],
    "group_low": ["source_7"],
    "group_orf": ["source_4"],
    "group_crispr": ["source_13"],
}
COMPOUND_GROUPS = ["group_high", "group_low"]
WELLS_PER_PLATE = 384


def as_text(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the smallest by ``order`` (and then by every other column).

    Takes the minimum of a struct, which folds on the map side and never sorts a group.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("__best"))
    return best.select(*[
        F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in df.columns])


def merge_metadata(profiles: DataFrame, metadata: DataFrame, keys: list[str] | None = None,
                   how: str = "inner", order: list[str] | None = None) -> DataFrame:
    """Join well metadata to profiles, metadata columns winning over profile columns.

    Metadata is first reduced to one row per key. Missing control types become ``trt`` and
    the control flag follows from them.
    """
    keys = keys or [k for k in C.WELL_PARTS if k in profiles.columns and k in metadata.columns]
    meta = first_per_key(as_text(metadata, keys), keys, order or [])
    overlap = [c for c in meta.columns if c in profiles.columns and c not in keys]
    out = as_text(profiles.drop(*overlap), keys).join(meta, keys, how)
    if C.CONTROL_TYPE in out.columns:
        out = out.withColumn(C.CONTROL_TYPE, F.coalesce(C.CONTROL_TYPE, F.lit("trt")))
    return control_flag(out)


def control_flag(df: DataFrame, default_id: str = DEFAULT_CONTROL_ID) -> DataFrame:
    """Add the control flag from the first column able to tell."""
    if C.NEGCON in df.columns:
        return df
    names = df.columns
    if "Metadata_pert_type" in names:
        flag = F.col("Metadata_pert_type") == "negcon"
    elif C.CONTROL_TYPE in names:
        flag = F.col(C.CONTROL_TYPE) == "negcon"
    elif C.PERT in names:
        flag = F.col(C.PERT) == default_id
    else:
        flag = F.lit(False)
    return df.withColumn(C.NEGCON, F.coalesce(flag, F.lit(False)))


def add_annotations(df: DataFrame, annotations: DataFrame, key: str = C.PERT) -> DataFrame:
    """Left join that only brings columns the table does not have yet."""
    new = [c for c in annotations.columns if c == key or c not in df.columns]
    return df.join(annotations.select(*new), key, "left")


def merge_tables(tables: list[DataFrame], how: str = "left") -> DataFrame:
    """Fold metadata tables on their common columns, later ones adding new columns only."""
    def step(left, right):
        common = [c for c in right.columns if c in left.columns]
        return as_text(left, common).join(as_text(right, common), common, how)

    merged = reduce(step, tables)
    renames = {}
    for name in merged.columns:
        target = name if name.startswith(C.META) else C.META + name
        renames[name] = C.CONTROL_TYPE if target == "Metadata_pert_type" else target
    return merged.withColumnsRenamed({k: v for k, v in renames.items() if k != v})


def wells_with_plates(wells: DataFrame, plates: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """well ⋈ plate on (source, plate), restricted to wanted perturbations."""
    chosen = wells if wanted is None else wells.join(wanted, C.PERT, "left_semi")
    return chosen.join(plates, [C.SOURCE, C.PLATE]).select(
        C.SOURCE, C.BATCH, C.PLATE, C.WELL, C.PERT)


def connectivity(key: Column | str) -> Column:
    """First block of a structure key, which ignores stereochemistry and charge."""
    return F.substring_index(key, "-", 1)


def match_structures(keys: DataFrame, compounds: DataFrame, key: str = "Metadata_InChIKey") -> DataFrame:
    """Structure keys to perturbation ids by their connectivity block, 1:n, keeping misses."""
    block = "InChIKey_Connectivity"
    known = compounds.filter(F.col(key).isNotNull() & F.col(C.PERT).isNotNull()).select(
        connectivity(key).alias(block), C.PERT).distinct()
    wanted = keys.filter(F.col(key).isNotNull()).withColumn(block, connectivity(key))
    wanted = wanted.groupBy(block).agg(F.min(key).alias(key))
    return wanted.join(known, block, "left").select(key, block, C.PERT)


def structure_map(annotation_keys: list[DataFrame], compounds: DataFrame) -> DataFrame:
    """One row per perturbation over all annotation sources, misses dropped."""
    parts = [match_structures(k, compounds).filter(F.col(C.PERT).isNotNull()) for k in annotation_keys]
    return first_per_key(reduce(DataFrame.unionByName, parts), [C.PERT], [])


def classify(df: DataFrame, crispr: DataFrame, orf: DataFrame, compound: DataFrame,
             name: str = "Perturbation_Type") -> DataFrame:
    """CRISPR before ORF before COMPOUND before UNKNOWN, from one registry join."""
    ranked = [("CRISPR", crispr), ("ORF", orf), ("COMPOUND", compound)]
    registry = reduce(DataFrame.unionByName, [
        t.select(C.PERT).withColumn("__rank", F.lit(i)) for i, (_, t) in enumerate(ranked)])
    best = registry.filter(F.col(C.PERT).isNotNull()).groupBy(C.PERT).agg(F.min("__rank").alias("__rank"))
    labels = F.array(*[F.lit(label) for label, _ in ranked])
    return df.join(best, C.PERT, "left").withColumn(
        name, F.coalesce(F.get(labels, "__rank"), F.lit("UNKNOWN"))).drop("__rank")


def fill_rates(df: DataFrame, capacity: int = WELLS_PER_PLATE) -> DataFrame:
    """Percentage of wells present per (source, plate)."""
    return df.groupBy(C.SOURCE, C.PLATE).agg(F.count_distinct(C.WELL).alias("wells_present")).withColumn(
        "fill_rate", F.round(F.col("wells_present") / capacity * 100, 2))


def filter_plates(df: DataFrame, plates: DataFrame, sources: list[str] | None = None,
                  plate_type: str = "%TARGET2%", min_fill: float = 25.0) -> DataFrame:
    """Drop listed sources, plates of a type, and sparsely filled plates (in percent)."""
    out = df.filter(~F.col(C.SOURCE).isin(sources or ["source_9"]))
    typed = plates.filter(F.ilike(F.col(C.PLATE_TYPE), F.lit(plate_type))).select(C.PLATE).distinct()
    out = out.join(typed, C.PLATE, "left_anti")
    full = fill_rates(out).filter(F.col("fill_rate") >= min_fill).select(C.SOURCE, C.PLATE)
    return out.join(full, [C.SOURCE, C.PLATE], "left_semi")


def deny_plates(df: DataFrame, denied: DataFrame) -> DataFrame:
    """Drop explicitly listed plates ``(plate, reason)``."""
    return df.join(denied.select(C.PLATE).distinct(), C.PLATE, "left_anti")


def red_list(plates: DataFrame) -> DataFrame:
    """Plates known to be unusable. The batches, patterns and plates below."""
    bad = (
        ((F.col(C.SOURCE) == "source_4") & F.col(C.BATCH).endswith("Batch12"))
        | ((F.col(C.SOURCE) == "source_3") & (
            F.col(C.BATCH).rlike("^CP_3[23456]_all_Phenix1$") | F.col(C.BATCH).isin("CP59", "CP60")))
        | ((F.col(C.SOURCE) == "source_15") & F.col(C.PLATE).isin("PEP00004458", "PEP00004421"))
    )
    return plates.filter(bad).select(*C.PLATE_PARTS)


def gray_list(plates: DataFrame) -> DataFrame:
    return plates.filter(F.col(C.PLATE).rlike("CP-CC9-R[123456]-28")).select(*C.PLATE_PARTS)


def usable_plates(plates: DataFrame) -> DataFrame:
    listed = red_list(plates).unionByName(gray_list(plates))
    return plates.select(*C.PLATE_PARTS).join(listed, C.PLATE_PARTS, "left_anti")


def site_sample(sites: DataFrame, keep: int = 4, keys: list[str] | None = None,
                order: str = C.SITE) -> DataFrame:
    """The first ``keep`` sites of every well, in site order.

    The filter on the row number lets Spark keep only that many rows per well before
    the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(*(keys or C.WELL_PARTS)).orderBy(order))
    return sites.withColumn("__place", place).filter(F.col("__place") <= keep).drop("__place")


def control_wells(filtered: DataFrame, wells: DataFrame, controls: dict[str, list[str]] | None = None) -> DataFrame:
    """Wells of each modality's controls on the plates where that modality was filtered in."""
    rows = [(m, i) for m, ids in (controls or MODALITY_CONTROLS).items() for i in ids]
    known = filtered.sparkSession.createDataFrame(rows, ["Modality", C.PERT])
    plates = filtered.select(F.col("Perturbation_Type").alias("Modality"), C.PLATE).distinct()
    return wells.join(known, C.PERT).join(plates, ["Modality", C.PLATE], "left_semi")


def sample_controls(wells: DataFrame, fraction: float, seed: int = 42, plate: str = C.PLATE,
                    ident: list[str] | None = None) -> DataFrame:
    """A seeded share of each plate's controls, at least one per plate.

    The order is a hash of the well, so the sample does not depend on row placement.
    """
    if fraction >= 1.0:
        return wells
    ident = ident or [C.SOURCE, C.PLATE, C.WELL, C.PERT]
    sizes = wells.groupBy(plate).agg(
        F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(fraction))).alias("__keep"))
    keyed = wells.withColumn("__order", seeded_number(seed, *ident)).withColumn("__ident", F.xxhash64(*ident))
    placed = ordinal_rank(keyed, [plate], "__order", "__ident", "__place")
    return placed.join(sizes, plate).filter(F.col("__place") <= F.col("__keep")).select(*wells.columns)


def match_to_profiles(treatments: DataFrame, controls: DataFrame, profiles: DataFrame,
                      denied: DataFrame | None = None) -> DataFrame:
    """Wells present in metadata and in profiles, with the profile annotations joined on."""
    key = [C.SOURCE, C.PLATE, C.WELL]
    wells = treatments.select(*C.WELL_PARTS).unionByName(controls.select(*C.WELL_PARTS))
    if denied is not None:
        wells = deny_plates(wells, denied)
    extra = [C.PERT, "Metadata_broad_sample", C.SYMBOL, "Metadata_pert_type", C.PERT_TYPE]
    notes = as_text(profiles.select(*key, *[c for c in extra if c in profiles.columns]), key).distinct()
    if C.PERT_TYPE in notes.columns:
        kind = F.col(C.PERT_TYPE).cast("string")
        notes = notes.withColumn(C.PERT_TYPE, F.when(kind.isin("orf", "crispr"), kind).otherwise("compound"))
    matched = as_text(wells, key).distinct().join(notes, key)
    return matched.select(*[c for c in [*C.WELL_PARTS, *extra] if c in matched.columns])


def replicate_filter(df: DataFrame, least: int = 4, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Keep compounds with enough wells in their source group, other rows as they are.

    Controls are recognised by their perturbation type and always kept. Adds the group.
    """
    groups = groups or SOURCE_GROUPS
    label = F.lit("group_other")
    for name, sources in reversed(groups.items()):
        label = F.when(F.col(C.SOURCE).isin(sources), name).otherwise(label)
    tagged = df.withColumn(C.GROUP, label)
    enough = tagged.filter(F.col(C.GROUP).isin(COMPOUND_GROUPS) & F.col(C.PERT).isNotNull()).groupBy(
        C.GROUP, C.PERT).count().filter(F.col("count") >= least)
    flags = enough.select(C.GROUP, C.PERT, F.lit(True).alias("__enough"))
    spared = F.lit(False)
    for name in ("Metadata_pert_type", C.CONTROL_TYPE):
        if name in df.columns:
            spared = spared | F.coalesce(F.col(name) == "negcon", F.lit(False))
    return tagged.join(flags, [C.GROUP, C.PERT], "left").filter(
        F.col("__enough").isNotNull() | ~F.col(C.GROUP).isin(COMPOUND_GROUPS) | spared
    ).drop("__enough").select(*df.columns, C.GROUP)


def target_lists(edges: DataFrame, key: str = C.PERT, target: str = "target",
                 name: str = C.TARGET_LIST) -> DataFrame:
    """Sorted distinct targets per id, joined by a pipe."""
    return edges.filter(F.col(target).isNotNull()).groupBy(key).agg(
        F.concat_ws("|", F.array_sort(F.collect_set(target))).alias(name))


def target_column(df: DataFrame, lists: DataFrame, name: str, listed: str = C.TARGET_LIST) -> DataFrame:
    """Controls unknown; genes by symbol; compounds by their list; otherwise unknown."""
    joined = df.drop(name).join(lists.withColumnRenamed(listed, "__list"), C.PERT, "left")
    value = (
        F.when(F.col("Metadata_pert_type") == "negcon", F.lit(C.UNKNOWN))
        .when(F.col(C.PERT_TYPE).isin("orf", "crispr"), F.col(C.SYMBOL))
        .otherwise(F.coalesce("__list", F.lit(C.UNKNOWN))))
    return joined.withColumn(name, value).drop("__list")


def tag_profiles(profiles: DataFrame, metadata: DataFrame, model: str, dataset: str, compression: str,
                 keys: list[str] | None = None) -> DataFrame:
    """Profiles of the listed wells with id and tag columns in canonical order.

    With a site column on the profile side, metadata applies to each site of its well.
    """
    keys = keys or C.WELL_PARTS
    if "site" in profiles.columns and any(k not in profiles.columns for k in keys):
        parts = F.split("site", "__")
        profiles = profiles.withColumns(
            {n: parts[i] for i, n in enumerate(C.SITE_PARTS)}).drop("site", "model", "filename")
    meta = as_text(metadata, keys).withColumnsRenamed({"Metadata_pert_type": C.CONTROL_TYPE})
    features = [c for c in profiles.columns if not c.startswith(C.META)]
    per_site = [C.SITE] if C.SITE in profiles.columns else []
    out = as_text(profiles.select(*keys, *per_site, *features), keys).join(meta, keys)
    out = out.withColumns({
        "Metadata_id": F.concat_ws("__", *[F.col(c) for c in [*C.WELL_PARTS, *per_site]]),
        "Metadata_model": F.lit(model), "Metadata_dataset": F.lit(dataset),
        "Metadata_compression": F.lit(compression)})
    trailing = [*C.WELL_PARTS, *per_site, C.CONTROL_TYPE, C.PERT_TYPE, C.PERT, "Metadata_broad_sample",
                C.SYMBOL, "Metadata_model", "Metadata_dataset", "Metadata_compression"]
    return out.select("Metadata_id", *features, *[c for c in trailing if c in out.columns])


def membership(steps: dict[str, DataFrame], key: str = C.PERT) -> DataFrame:
    """``(key, step)`` rows: which ids survive each step."""
    return reduce(DataFrame.unionByName, [
        df.select(key).dropna().distinct().withColumn("step", F.lit(name)) for name, df in steps.items()])


def membership_profile(members: DataFrame, key: str = C.PERT, step: str = "step") -> DataFrame:
    """How many ids lie in exactly each combination of steps.

    An id has at most one row per step, so the collected set is bounded by the steps.
    """
    combos = members.groupBy(key).agg(F.concat_ws("&", F.array_sort(F.collect_set(step))).alias("combination"))
    return combos.groupBy("combination").agg(F.count(F.lit(1)).alias("n"))


def overlap_report(df: DataFrame, reference: DataFrame, group: str = C.GROUP, key: str = C.PERT) -> DataFrame:
    """Per group: distinct ids, those in the reference, and the reference targets reached."""
    ids = df.select(group, key).distinct()
    found = ids.join(reference.select(key, "target").distinct(), key, "left")
    return found.groupBy(group).agg(
        F.count_distinct(key).alias("n_ids"),
        F.count_distinct(F.when(F.col("target").isNotNull(), F.col(key))).alias("n_in_reference"),
        F.count_distinct("target").alias("n_targets"))


def registry_union(compound: DataFrame, crispr: DataFrame, orf: DataFrame) -> DataFrame:
    """All perturbations with their modality and the key they are matched by."""
    text = F.lit(None).cast("string")
    return (
        compound.select(C.PERT, text.alias("standard_key"), F.lit("compound").alias("modality"))
        .unionByName(crispr.select(C.PERT, F.col(C.SYMBOL).alias("standard_key"), F.lit("crispr").alias("modality")))
        .unionByName(orf.select(C.PERT, F.col(C.SYMBOL).alias("standard_key"), F.lit("orf").alias("modality"))))


def nested_subsample(df: DataFrame, sizes: list[int], seeds: list[int], key: str = C.PERT,
                     negcon: str = C.NEGCON, plate: str = C.PLATE) -> DataFrame:
    """Treatments sampled at several sizes and seeds in one table, nested by size.

    Only distinct ids are ranked, and no more than the largest size is kept. All controls on the plates of a sample are kept.
    """
    seeds_col = F.explode(F.array(*[F.lit(s) for s in seeds]))
    ids = df.filter(~F.col(negcon)).select(key).distinct().withColumn("seed", seeds_col)
    order = F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col(key).cast("string")))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(order, key))
    wanted = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n >= F.col("place"))
    first = ids.withColumn("place", place).filter(F.col("place") <= max(sizes))
    chosen = first.withColumn("n", F.explode(wanted)).select("seed", "n", key)
    treated = df.filter(~F.col(negcon)).join(chosen, key)
    plates = treated.select("seed", "n", plate).distinct()
    controls = df.filter(negcon).join(plates, plate)
    return treated.unionByName(controls)


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A reproducible sample of ``n`` distinct keys: the first by a hash order."""
    return df.select(key).distinct().orderBy(seeded_order(seed, key), key).limit(n)


def rows_of_sites(rows: DataFrame, sites: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows whose site occurs in another table."""
    keys = keys or ["source_id", "file"]
    return rows.join(sites.select(*keys).distinct(), keys, "left_semi")
