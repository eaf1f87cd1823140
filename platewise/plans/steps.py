"""Ordered profile processing: a registry of named steps and their configuration."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.operators import aggregate, metadata, normalize, select, validate
from platewise.operators.packed import Profiles
from platewise.session import cut_lineage

Step = Callable[..., Profiles]


def control_flag_of(profiles: Profiles, control_col: str, control_key: str) -> Profiles:
    if C.NEGCON in profiles.df.columns:
        return profiles
    return profiles.with_df(profiles.df.withColumn(
        C.NEGCON, F.coalesce(F.col(control_col) == control_key, F.lit(False))))


def fitted(fn):
    """Steps that fit on controls or on all rows, per batch or globally."""

    def run(p: Profiles, batch_col: str | None = C.PLATE, fit_on_controls: bool = True,
            control_col: str = C.CONTROL_TYPE, control_key: str = "negcon", **params) -> Profiles:
        flagged = control_flag_of(p, control_col, control_key) if fit_on_controls else p
        return fn(flagged, batch_col or None, C.NEGCON if fit_on_controls else None, params)

    return run


def renamed(result: tuple[DataFrame, list[str]], before: Profiles) -> Profiles:
    df, names = result
    return Profiles(df, names or before.names)


def spherize_step(p: Profiles, batch: str | None, control: str | None, params: dict) -> Profiles:
    out = normalize.spherize(p.df, batch, control, **params).drop("model_status")
    width = out.select(F.size(C.FEATURES)).first()
    names = p.names if width is None or width[0] == len(p.names) else [f"PC_{i}" for i in range(width[0])]
    return Profiles(out, names)


STEPS: dict[str, Step] = {
    "clean_nans": lambda p, na_cutoff=0.30: select.clean_rows(p, na_cutoff),
    "merge_metadata": lambda p, table, keys=None, how="inner", order=None: p.with_df(
        metadata.merge_metadata(p.df, table, keys, how, order)),
    "filter_features": lambda p, operations=None: select.filter_features(p, operations)[0],
    "prune_correlated": lambda p, threshold=0.9: p.keep(select.prune_correlated(p, threshold)),
    "aggregate_wells": lambda p, strata=(C.PLATE, C.WELL), method="median", order=None: p.with_df(
        aggregate.aggregate_strata(p.df, list(strata), method, None, order)),
    "normalize_robustmad": fitted(lambda p, b, c, o: p.with_df(normalize.robust_mad(p.df, b, c, **o))),
    "normalize_standardize": fitted(lambda p, b, c, o: p.with_df(normalize.standardize(p.df, b, c, **o))),
    "normalize_tvn": fitted(lambda p, b, c, o: p.with_df(normalize.tvn(p.df, b, c, **o).drop("model_status"))),
    "normalize_tvn_efaar": fitted(lambda p, b, c, o: renamed(normalize.tvn_efaar(p.df, b, c or C.NEGCON, **o), p)),
    "normalize_tvn_original": fitted(lambda p, b, c, o: renamed(normalize.tvn_original(p.df, b, c or C.NEGCON, **o), p)),
    "normalize_tvn_cascade": fitted(lambda p, b, c, o: renamed(normalize.tvn_cascade(p.df, b, c or C.NEGCON, **o), p)),
    "normalize_spherize": fitted(spherize_step),
    "normalize_pca": fitted(lambda p, b, c, o: renamed(normalize.pca(p.df, control=c, **o), p)),
    "well_position_correct": lambda p, well_col=C.WELL: p.with_df(normalize.well_position_correct(p.df, well_col)),
    "inverse_normal_transform": lambda p, row_id=C.ROW_ID: p.with_df(normalize.inverse_normal(p.df, row_id)),
    "sample_norm": lambda p, norm="l2": p.with_df(normalize.sample_normalize(p.df, norm)),
}


# Steps that read their input more than once to fit or to choose features: what comes before is written first.
FITTED = {"clean_nans", "filter_features", "prune_correlated", *(n for n in STEPS if n.startswith("normalize_")), "inverse_normal_transform"}


def run_steps(profiles: Profiles, steps: list[dict], max_pc1: float | None = None, check_values: bool = True,
              materialize: bool = True) -> tuple[Profiles, list[dict]]:
    """Run enabled steps in order and report the gates.

    Row-wise steps are one plan. Their result is written to the shared folder only before a step that fits, as it reads
    its input several times, and at the end. The counts of invalid values ride along with that write as observations
    of each step, so a gate costs no scan. A step that leaves invalid values, or a leading component above
    ``max_pc1``, stops the run.
    """
    report, waiting = [], []

    def written(held: Profiles) -> Profiles:
        out = held.with_df(cut_lineage(held.df)) if materialize else held
        if not materialize and waiting:
            held.df.write.format("noop").mode("overwrite").save()
        for entry, seen, abort in waiting:
            entry.update(seen.get)
            if abort and entry["n_null"] + entry["n_nan"] + entry["n_inf"] > 0:
                raise ValueError(f"step {entry['step']} left invalid values: {entry}")
        waiting.clear()
        return out

    for step in [s for s in steps if s.get("enabled", True)]:
        if step["name"] in FITTED and waiting:
            profiles = written(profiles)
        profiles = STEPS[step["name"]](profiles, **step.get("params", {}))
        entry = {"step": step["name"], "n_features": len(profiles.names)}
        if check_values and step["name"] != "merge_metadata":
            seen_df, seen = validate.observe_invalid(profiles.df, f"{len(report)}_{step['name']}")
            profiles = profiles.with_df(seen_df)
            waiting.append((entry, seen, step.get("abort_on_invalid", True)))
        report.append(entry)
    profiles = written(profiles)
    if max_pc1 is not None and len(profiles.names) >= 2:
        ok, share = normalize.leading_variance_gate(profiles.df, max_pc1)
        report.append({"step": "leading_variance", "pc1": share, "ok": ok})
        if not ok:
            raise ValueError(f"first component explains {share:.1%}, allowed {max_pc1:.0%}")
    return profiles, report


def epsilon_text(epsilon: float) -> str:
    return f"e{abs(round(math.log10(epsilon)))}" if epsilon < 0.001 else f"e{epsilon}"


def part_name(name: str, p: dict) -> str | None:
    """The part of a configuration name one step contributes."""
    fit = "_ctrl" if p.get("fit_on_controls", False) else "_all"
    if name == "normalize_robustmad":
        return "robustmad" + fit
    if name == "normalize_standardize":
        return "std" + fit
    if name == "normalize_pca":
        return f"pca{p.get('n_components', 128)}"
    if name == "normalize_tvn":
        return f"tvn_a{p.get('alpha', 0.5)}"
    if name == "normalize_tvn_original":
        return f"tvn_original_k{p.get('k', 64)}"
    if name == "normalize_tvn_cascade":
        return f"cascade_tvn_k{p.get('k1', 128)}_k{p.get('k2', 32)}"
    if name == "normalize_tvn_efaar":
        k = p.get("n_components", 128)
        return f"tvn_efaar_e{p.get('epsilon', 0.5)}" + ("" if k == 128 else f"_c{k}")
    if name == "normalize_spherize":
        scope = "" if p.get("batch_col", C.PLATE) else "_global"
        cut = {"pa": f"_truncPA{p.get('n_permutations', 10)}", "mp": "_truncMP"}.get(p.get("remove_variance_method"))
        if cut is None:
            share = p.get("remove_variance_threshold")
            cut = "" if share is None else f"_trunc{share}"
        return f"{p.get('method', 'ZCA-cor')}{scope}{fit}_{epsilon_text(p.get('epsilon', 1e-6))}{cut}"
    if name == "filter_features":
        cutoffs = [f.get("outlier_cutoff", 50) for f in p.get("operations", []) if f["name"] == "drop_outliers"]
        return f"outlier{cutoffs[0]}" if cutoffs else None
    if name == "prune_correlated":
        return f"prune{p.get('threshold', 0.9)}"
    if name == "aggregate_wells":
        method = p.get("method", "median")
        return "agg" if method == "median" else f"agg_{method}"
    return {"well_position_correct": "wellcorr", "inverse_normal_transform": "INT",
            "sample_norm": f"snorm_{p.get('norm', 'l2')}"}.get(name)


def config_name(steps: list[dict], use_prune: bool | None = None) -> str:
    """Name of a step list; the inverse of ``results.config_settings``."""
    parts = [part_name(s["name"], s.get("params", {})) for s in steps if s.get("enabled", True)]
    named = [p for p in parts if p]
    if use_prune is False and not any(p.startswith("prune") for p in named):
        named.append("noprune")
    return "__".join(named) or "default"
