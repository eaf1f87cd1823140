"""Readers: profiles, long feature trees, indexes, registries, metric files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise import columns as C
from platewise.functions.keys import file_stem

# Accepted names of split and key columns, in order of preference.
SPLIT_COLUMNS = ["split", "Split", "fold", "subset"]
KEY_COLUMNS = ["Metadata_JCP2022", "JCP2022", "Metadata_InChIKey", "InChIKey", "inchikey", "compound_inchikey"]
TIER_COLUMNS = ["Metadata_JCP2022", "target", "modality_clean", "WithinModalityTier"]
CELL_OBJECTS = {"cell", "nuclei"}

METRIC_SUMMARIES = {
    "PA_group_summary": "PA", "PC_group_summary": "PC", "PC_replicable_group_summary": "PC_rep",
    "well_effect_group_summary": "well_effect", "plate_effect_group_summary": "plate_effect",
}


def format_of(path: str) -> str:
    """File format by suffix; parquet when the suffix says nothing."""
    low = path.lower()
    if low.endswith((".csv", ".csv.gz")):
        return "csv"
    if low.endswith((".tsv", ".txt", ".tsv.gz")):
        return "tsv"
    return "parquet"


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None) -> DataFrame:
    """A parquet, csv, csv.gz or tsv table. Text files are inferred unless given a schema."""
    fmt = fmt or format_of(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt not in ("csv", "tsv", "csv.gz"):
        raise ValueError(f"unsupported format {fmt!r}")
    reader = spark.read.option("header", True).option("sep", "\t" if fmt == "tsv" else ",")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def path_parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^[a-z0-9]+:/*", "/"), "/")


def read_feature_tree(spark: SparkSession, base: str, layout: str = "MODEL/DATASET/CODEC", model: str | None = None,
                      dataset: str | None = None, codec: str | None = None) -> DataFrame:
    """All per-site files under ``*/profiles/`` as one scan, with path parts as columns.

    ``layout`` names the three folders above ``profiles``. Filters become path globs, so
    unwanted folders are never listed; ``cache`` folders are skipped.
    """
    wanted = {"MODEL": model, "DATASET": dataset, "CODEC": codec}
    names = layout.split("/")
    if sorted(names) != sorted(wanted):
        raise ValueError(f"layout must order MODEL, DATASET and CODEC, not {layout!r}")
    glob = "/".join(wanted[n] or "*" for n in names)
    df = spark.read.option("pathGlobFilter", "*.parquet").option("mergeSchema", True).parquet(
        f"{base.rstrip('/')}/{glob}/profiles")
    parts = path_parts(F.col("_metadata.file_path"))
    at = {n: F.element_at(parts, -5 + i) for i, n in enumerate(names)}
    out = df.select("*", F.col("_metadata.file_path").alias("__path"),
                    F.col("_metadata.file_name").alias("filename"),
                    at["MODEL"].alias("Metadata_model"), at["DATASET"].alias("Metadata_dataset"),
                    at["CODEC"].alias("Metadata_compression"))
    return out.filter(~F.array_contains(path_parts(F.col("__path")), "cache")).drop("__path")


def first_profiles(spark: SparkSession, base: str) -> DataFrame:
    """The files of the first ``profiles`` folder, in path order, below each folder of ``base``, named in ``top``.

    Folders are found from file names alone; one path per folder of ``base`` reaches the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(base)
    # the root is part of every path, so it is told from the paths themselves and not from how ``base`` is written
    inside = F.regexp_extract("path", "/" + re.escape(base.rstrip("/").rsplit("/", 1)[-1]) + "/(.*)$", 1)
    folder = F.regexp_extract("path", "^(.*?/profiles)/", 1)
    found = files.select(F.regexp_extract(inside, "^([^/]+)/", 1).alias("top"), folder.alias("folder")).filter(
        "top <> '' and folder <> ''").groupBy("top").agg(F.min("folder").alias("folder")).orderBy("top").collect()
    if not found:
        raise FileNotFoundError(f"no profiles folder below {base}")
    df = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(*[r["folder"] for r in found])
    own = F.regexp_extract(F.col("_metadata.file_path"), "^(.*?/profiles)/", 1)
    tops = F.create_map(*[F.lit(x) for r in found for x in (path_tail(r["folder"]), r["top"])])
    return df.select("*", tops[F.element_at(F.split(own, ":/*"), -1)].alias("top"))


def path_tail(path: str) -> str:
    return re.split(":/*", path)[-1]


def sniff_layout(df: DataFrame, branch: str = "branch", metric: str = "metric", obj: str = "object") -> dict:
    """``wide``, ``dl_long`` or ``cp_long``, from the schema and at most three object names."""
    types = {f.name: f.dataType for f in df.schema.fields}
    value = "value" if "value" in types else ("values" if "values" in types else None)
    if metric not in types or branch not in types or value is None:
        return {"layout": "wide", "value": None, "is_list": False, "has_label": "label" in types}
    objects = set()
    if obj in types:
        objects = {r[0] for r in df.select(obj).distinct().limit(3).collect()}
    return {
        "layout": "cp_long" if objects and objects <= CELL_OBJECTS else "dl_long", "value": value,
        "is_list": isinstance(types[value], T.ArrayType), "has_label": "label" in types}


def read_index(spark: SparkSession, paths: list[str], pattern: str, schemas: list[str] | None = None) -> DataFrame:
    """Index files united by name, keeping columns whose name matches ``pattern``.

    Every file keeps its text columns; files of one schema are best given as one glob.
    """
    frames = [spark.read.option("header", True).csv(p) for p in paths] if not schemas else [
        spark.read.option("header", True).schema(s).csv(p) for p, s in zip(paths, schemas)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return union.select(union.colRegex(f"`{pattern}`"))


def read_splits(spark: SparkSession, path: str, key: str | None = None,
                split: str | None = None) -> tuple[DataFrame, str, str]:
    """Split file with its key and split column, found by name unless given."""
    df = read_table(spark, path)
    return df, key or first_present(df, KEY_COLUMNS, "key"), split or first_present(df, SPLIT_COLUMNS, "split")


def first_present(df: DataFrame, candidates: list[str], what: str) -> str:
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"no {what} column among {df.columns}")


def read_tiers(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Tier annotations: the required columns, distinct; an absent column is an error."""
    df = read_table(spark, path)
    wanted = columns or TIER_COLUMNS
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"annotations lack {missing}")
    return df.select(*wanted).distinct()


def json_files(spark: SparkSession, base: str, name: str = "metrics.json") -> DataFrame:
    """``(path, text)`` of all files of one name below a folder, one row per file."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", name).text(base).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def flatten_metrics(files: DataFrame) -> DataFrame:
    """``(model, config, metric, value)`` rows of metric records.

    Scalars keep their name; per-group summaries become ``prefix_group_statistic``.
    """
    parts = path_parts(F.col("path"))
    top = F.from_json("text", "map<string,string>")
    rows = files.select(F.element_at(parts, -4).alias("model"), F.element_at(parts, -3).alias("config"),
                        F.explode(top).alias("metric", "raw"))
    scalar = rows.filter(F.col("raw").isNotNull() & ~F.col("raw").startswith("{") & ~F.col("raw").startswith("["))
    number = F.when(F.col("raw") == "true", F.lit(1.0)).when(F.col("raw") == "false", F.lit(0.0)).otherwise(
        F.expr("try_cast(raw as double)"))
    prefix = F.create_map(*[F.lit(x) for kv in METRIC_SUMMARIES.items() for x in kv])
    nested = rows.filter(F.col("metric").isin(list(METRIC_SUMMARIES))).select(
        "model", "config", prefix[F.col("metric")].alias("prefix"),
        F.explode(F.from_json("raw", "map<string,map<string,double>>")).alias("group", "stats"))
    stats = nested.select("model", "config", "prefix", "group", F.explode("stats").alias("stat", "value"))
    return scalar.select("model", "config", "metric", number.alias("value")).filter(
        F.col("value").isNotNull()).unionByName(
        stats.select("model", "config", F.concat_ws("_", "prefix", "group", "stat").alias("metric"), "value"))


def metrics_table(long: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per (model, config); the metric names are few and looked up once if not given."""
    if names is None:
        names = sorted(r[0] for r in long.select("metric").distinct().collect())
    return long.groupBy("model", "config").pivot("metric", names).agg(F.first("value"))


def recall_rows(files: DataFrame, dataset: str) -> DataFrame:
    """Recall records of the three graph tasks as rows.

    Top-level keys end in ``_CC``, ``_GG`` or ``_CG``. Gene tasks keep only the full
    reference pool. The feature folder is ``<family>_<dataset>_[updated_<codec>_]raw_features``.
    """
    parts = path_parts(F.col("path"))
    folder, config = F.element_at(parts, -4), F.element_at(parts, -3)
    full = f"^(.+?)_{dataset}_updated_(.+)_raw_features$"
    plain = f"^(.+?)(?:_raw)?_{dataset}_raw_features$"
    coded = F.regexp_extract(folder, full, 1)
    family = F.when(coded != "", coded).otherwise(F.regexp_extract(folder, plain, 1))
    codec = F.when(coded != "", F.regexp_extract(folder, full, 2)).otherwise("raw")
    entry = "struct<summary:array<map<string,string>>>"
    rows = files.select(family.alias("family"), codec.alias("codec"), config.alias("config"),
                        F.explode(F.from_json("text", "map<string,string>")).alias("name", "raw"))
    rows = rows.withColumn("task", F.regexp_extract("name", "_(CC|GG|CG)$", 1)).filter(
        (F.col("task") != "") & (F.col("family") != ""))
    one = rows.withColumn("s", F.explode(F.from_json("raw", entry)["summary"]))
    item = F.col("s")
    kept = one.filter((F.col("task") == "CC") | item["setting"].isNull() | (item["setting"] == "") |
                      (item["setting"] == "full"))
    value = lambda k: item[f"recall@{k}%"].cast("double").alias(f"recall_{k}")
    return kept.select(
        "family", "codec", "config", "task",
        F.when(F.col("task") != "CC", item["target_modality"]).alias("modality"),
        F.when(F.col("task") != "GG", item["compound_group"]).alias("group"), value(1), value(5), value(10))


def named_stem(suffix: str) -> Column:
    """Stem of the file, or of the folder ``<stem><suffix>`` where Spark wrote the file in parts."""
    name = F.col("_metadata.file_name")
    folder = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1)
    plain = F.when(folder.contains("%"), F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))).otherwise(folder)
    return file_stem(F.when(name.startswith("part-") & folder.endswith(suffix), plain).otherwise(name))


def read_instance_mappings(spark: SparkSession, glob: str) -> DataFrame:
    """Instance mappings of several methods, the method taken from the name of the file or folder of parts."""
    return spark.read.parquet(glob).withColumn("method", named_stem(".parquet"))


def read_detailed(spark: SparkSession, glob: str, pattern: str = r"^(.*?)_(.*)$") -> DataFrame:
    """Per-site csv results with object type and codec taken from the name of the file or folder of parts."""
    stem = named_stem(".csv")
    return spark.read.option("header", True).option("inferSchema", True).csv(glob).withColumns(
        {"object_type": F.regexp_extract(stem, pattern, 1), "codec": F.regexp_extract(stem, pattern, 2)})


def read_registry(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The five registry tables of a folder."""
    return {n: spark.read.parquet(f"{base.rstrip('/')}/{n}.parquet")
            for n in ("well", "plate", "compound", "crispr", "orf")}
