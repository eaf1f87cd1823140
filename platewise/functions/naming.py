"""Feature-name vocabularies as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.expressions import as_col

# Name parts of each measurement group.
TEXTURE = [
    "AngularSecondMoment", "Contrast", "Correlation", "DifferenceEntropy", "DifferenceVariance", "Entropy",
    "InfoMeas1", "InfoMeas2", "InverseDifferenceMoment", "SumAverage", "SumEntropy", "SumVariance", "Variance",
]
INTENSITY = [
    "IntegratedIntensity", "MeanIntensity", "StdIntensity", "MaxIntensity", "MinIntensity", "MedianIntensity",
    "MADIntensity", "MassDisplacement", "LowerQuartileIntensity", "UpperQuartileIntensity", "Location_Center",
    "Location_Max",
]
SIZE_SHAPE = [
    "Area", "Perimeter", "FormFactor", "Solidity", "Extent", "Eccentricity", "MajorAxisLength",
    "MinorAxisLength", "Orientation", "Compactness", "EulerNumber", "Center_X", "Center_Y", "BoundingBox",
    "EquivalentDiameter", "ConvexArea", "MaxFeretDiameter", "MinFeretDiameter", "MaximumRadius", "MeanRadius",
    "MedianRadius", "MinimumRadius", "Moment", "InertiaTensor",
]
MOMENTS = ["CentralMoment", "HuMoment", "NormalizedMoment", "SpatialMoment", "InertiaTensor"]
UNSTABLE = [
    "InertiaTensor_", "InertiaTensorEigenvalues_", "SpatialMoment_", "HuMoment_", "CentralMoment_",
    "NormalizedMoment_",
]
COMPARTMENTS = {"cell": "Cells", "nuclei": "Nuclei", "cytoplasm": "Cytoplasm"}
CHANNELS = {"0": "DNA", "1": "AGP", "2": "Mito", "3": "RNA", "4": "ER"}
CATEGORIES = {
    "sizeshape": "AreaShape", "feret": "AreaShape", "zernike": "AreaShape", "intensity": "Intensity",
    "radial_distribution": "RadialDistribution", "radial_zernikes": "RadialDistribution", "texture": "Texture",
    "correlation": "Correlation", "granularity": "Granularity", "neighbors": "Neighbors",
}
RED_PATTERN = "CentralMoment_0_1|CentralMoment_1_0|ZernikePhase"


def starts_with_any(name: Column, parts: list[str]) -> Column:
    return name.rlike("^(" + "|".join(parts) + ")")


def contains_any(name: Column, parts: list[str]) -> Column:
    return name.rlike("(" + "|".join(parts) + ")")


def feature_group(name: Column | str) -> Column:
    """Measurement group of a feature; a leading channel digit is ignored."""
    base = F.regexp_replace(as_col(name), r"^\d_(?=.)", "")
    return (
        F.when(starts_with_any(base, TEXTURE), "Texture")
        .when(contains_any(base, INTENSITY), "Intensity")
        .when(contains_any(base, ["RadialDistribution"]) | starts_with_any(base, ["FracAtD", "MeanFrac", "RadialCV"]),
              "RadialDistribution")
        .when(base.contains("Zernike"), "Zernike")
        .when(base.startswith("Granularity"), "Granularity")
        .when(starts_with_any(base, SIZE_SHAPE), "SizeShape")
        .otherwise("Other"))


def feature_subcategory(name: Column | str) -> Column:
    """Family of a feature without its numeric parameters."""
    name = as_col(name)
    pair = F.regexp_extract(name, r"_(\d+_\d+)$", 1)
    radial = F.regexp_replace(F.regexp_replace(
        F.regexp_replace(name, "^radial_", ""), r"_\d+_\d+$", ""), r"_\d+of\d+$", "")
    rest = F.regexp_extract(name, "^[a-z]+([A-Z].*)", 1)
    moment = F.regexp_extract(rest, "^(" + "|".join(MOMENTS) + ")", 1)
    return (
        F.when(name.isNull(), "Unknown")
        .when(name.startswith("zernike") & name.contains("Zernike"),
              F.when(pair != "", pair).otherwise("Zernike"))
        .when(name.startswith("radial_"), radial)
        .when(rest == "", name)
        .when(moment != "", moment)
        .otherwise(F.regexp_extract(rest, "^([A-Z][a-zA-Z]*)", 1)))


def with_name_parts(df: DataFrame, feature: str = "feature") -> DataFrame:
    """Split ``compartment/mode/feature`` and keep the full name and its branch prefix."""
    parts = F.split(F.col("full_feature_name"), "/")
    return df.withColumn("full_feature_name", F.col(feature)).withColumns({
        "compartment": parts[0], "mode": F.get(parts, F.lit(1)), feature: F.get(parts, F.lit(2)),
    }).withColumn("feature_group", F.nullif(F.regexp_extract(feature, "^([a-z]+)", 1), F.lit("")))


def core_parts(full: Column | str) -> dict[str, Column]:
    """(object, channel, core measurement) of a full feature name."""
    parts = F.split(as_col(full), "/")
    place = F.regexp_extract(parts[0], r"^(cell|nuclei)_(\d+)", 0)
    inner = F.get(parts, F.lit(2))
    stripped = F.regexp_extract(inner, "^[a-z][a-z_]*([A-Z].*)", 1)
    return {
        "g_object": F.when(place != "", F.regexp_extract(place, "^(cell|nuclei)_", 1)),
        "g_channel": F.when(place != "", F.regexp_extract(place, r"_(\d+)", 1)),
        "g_core": F.when(stripped != "", stripped).otherwise(inner),
    }


def filter_by_green_list(df: DataFrame, green: DataFrame, full: str = "full_feature_name") -> DataFrame:
    """Rows whose feature is listed for its object, with or without a channel.

    ``green`` is ``(object, feature)``; a leading number is a channel. Unstable moment
    families never pass.
    """
    channel = F.regexp_extract("feature", r"^(\d+)_", 1)
    core = F.regexp_replace("feature", r"^\d+_", "")
    listed = green.select(
        F.col("object").alias("g_object"), F.when(channel != "", channel).alias("g_channel"), core.alias("g_core"))
    listed = listed.filter(~starts_with_any(F.col("g_core"), UNSTABLE)).distinct()
    keyed = df.select(full).distinct().withColumns(core_parts(full))
    exact = listed.filter("g_channel is not null").withColumn("__exact", F.lit(True))
    loose = listed.filter("g_channel is null").select("g_object", "g_core", F.lit(True).alias("__loose"))
    joined = keyed.join(exact, ["g_object", "g_channel", "g_core"], "left").join(
        loose, ["g_object", "g_core"], "left")
    return df.join(joined.filter("__exact or __loose").select(full), full, "left_semi")


def without_red_features(df: DataFrame, feature: str = "feature", pattern: str = RED_PATTERN,
                         listed: DataFrame | None = None) -> DataFrame:
    out = df.filter(~F.col(feature).rlike(pattern))
    return out if listed is None else out.join(listed.select(feature).distinct(), feature, "left_anti")


def lookup(table: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return pairs[key]


def candidate_name(full: Column | str) -> Column:
    """Name in the long vocabulary for a ``compartment_channel/mode/branchName`` feature.

    The branch decides the category; texture and radial names put the channel before
    their numeric parameters, intensity names after everything, shape names carry none.
    """
    parts = F.split(as_col(full), "/")
    place, inner = parts[0], F.get(parts, F.lit(2))
    compartment = lookup(COMPARTMENTS, F.regexp_extract(place, "^(.*)_[^_]*$", 1))
    channel = lookup(CHANNELS, F.regexp_extract(place, "_([^_]*)$", 1))
    branches = sorted(CATEGORIES, key=len, reverse=True)
    branch = F.regexp_extract(inner, "^(" + "|".join(branches) + ")", 1)
    category = lookup(CATEGORIES, branch)
    rest = F.regexp_replace(inner, "^(" + "|".join(branches) + ")", "")
    inner_name = F.regexp_replace(rest, "^(Intensity|RadialDistribution|Texture)_?", "")
    location = F.regexp_replace(rest, "^Location_", "")
    params = F.regexp_extract(inner_name, r"_(\d.*|[^_]*of.*)$", 1)
    base = F.when(params == "", inner_name).otherwise(
        F.expr("NULL").cast("string"))
    base = F.coalesce(base, F.regexp_replace(inner_name, r"_(\d.*|[^_]*of.*)$", ""))
    shape = F.regexp_extract(inner, "^ferret(M(?:ax|in)FeretDiameter)$", 1)
    join = lambda *cols: F.concat_ws("_", *cols)
    return (
        F.when((F.size(parts) != 3) | compartment.isNull(), F.lit(None).cast("string"))
        .when((branch == "intensity") & rest.startswith("Location"),
              join(compartment, F.lit("Location"), location, channel))
        .when(branch == "intensity", join(compartment, category, inner_name, channel))
        .when(branch.isin("radial_distribution", "radial_zernikes", "texture") & (params != ""),
              join(compartment, category, base, channel, params))
        .when(branch.isin("radial_distribution", "radial_zernikes", "texture"),
              join(compartment, category, inner_name, channel))
        .when(branch != "", join(compartment, category, rest))
        .when(shape != "", join(compartment, F.lit("AreaShape"), shape)))


def map_names(short: DataFrame, long: DataFrame, name: str = "feature") -> DataFrame:
    """``(feature, mapped)`` for short-vocabulary names found in the long vocabulary."""
    known = long.select(F.col(name).alias("mapped")).distinct()
    return short.select(name).distinct().withColumn("mapped", candidate_name(name)).join(known, "mapped").select(
        name, "mapped")


def map_coverage(short: DataFrame, long: DataFrame, mapping: DataFrame, name: str = "feature") -> DataFrame:
    """Mapped and unmapped counts of both vocabularies, and names hit more than once."""
    hits = {
        "short": (short, mapping.groupBy(F.col(name)).agg(F.count(F.lit(1)).alias("hits"))),
        "long": (long, mapping.groupBy(F.col("mapped").alias(name)).agg(F.count(F.lit(1)).alias("hits"))),
    }
    parts = []
    for side, (names, found) in hits.items():
        kinds = ["mapped", "unmapped"] + (["ambiguous"] if side == "long" else [])
        counts = names.select(name).distinct().join(found, name, "left").agg(
            F.count("hits").alias("mapped"), F.count_if(F.col("hits").isNull()).alias("unmapped"),
            F.count_if(F.col("hits") > 1).alias("ambiguous"))
        parts.append(counts.select(F.lit(side).alias("vocabulary"), *kinds).unpivot(["vocabulary"], kinds, "kind", "n"))
    return reduce(DataFrame.unionByName, parts)
