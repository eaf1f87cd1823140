import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.functions import linalg
from platewise.operators import normalize as N
from platewise.operators import moments as MO
from platewise.operators.factors import factor_table, factors_of, global_factor
from platewise.operators.moments import global_moments, moment_table, moments_of, pilot_of


def matrix(df):
    rows = df.orderBy("row_id").select("features").collect()
    return np.array([r[0] for r in rows])


def frame(df):
    pdf = df.orderBy("row_id").toPandas()
    return np.vstack(pdf["features"].map(np.asarray)), pdf["Metadata_Plate"].to_numpy(), pdf["Metadata_negcon"].to_numpy()


def test_moments_match_numpy(profiles):
    x, _, _ = frame(profiles)
    m = global_moments(profiles, with_cubic=True)
    assert m.n == len(x)
    assert np.allclose(m.mean, x.mean(axis=0))
    assert np.allclose(m.cov(), np.cov(x.T))
    assert np.isclose(m.fourth, (((x - x.mean(axis=0)) ** 2).sum(axis=1) ** 2).sum())


def grouped_moments(df, pilot):
    table = moment_table(df, "Metadata_Plate", pilot).toArrow()
    return {g: m for batch in table.to_batches() for g, m in moments_of(batch, pilot)}


def test_grouped_moments_in_bands_and_salts(profiles, monkeypatch):
    x, plate, _ = frame(profiles)
    pilot = pilot_of(profiles)
    for band, rows in ((1 << 20, 8192), (1, 8192), (100, 10)):
        monkeypatch.setattr(MO, "BAND_BYTES", band)
        monkeypatch.setattr(MO, "LEAST_ROWS", rows)
        found = grouped_moments(profiles, pilot)
        assert set(found) == set(plate)
        for group, got in found.items():
            assert got.n == (plate == group).sum() and np.allclose(got.cov(), np.cov(x[plate == group].T))


def test_partial_moments_of_mixed_plates_stay_below_models_and_input(spark, monkeypatch):
    """100 plates, their rows mixed over 40 tasks: matrix rows are counted, not only summed."""
    monkeypatch.setattr(MO, "LEAST_ROWS", 1)
    d, plates, each = 20, 100, 200
    rows = [(f"P{i % plates}", np.random.default_rng(i).normal(size=d).tolist()) for i in range(plates * each)]
    df = spark.createDataFrame(rows, "Metadata_Plate string, features array<double>").repartition(40)
    pilot = pilot_of(df)
    partial = MO.partial_moments(MO.dealt_rows(df, "Metadata_Plate", d), pilot).count()
    assert partial <= (d + 1) * plates + (plates * each) * 1.05 / MO.ROWS_PER_FEATURE * (d + 1) / d
    found = grouped_moments(df, pilot)
    x = np.array([r[1] for r in rows])
    assert np.allclose(found["P7"].cov(), np.cov(x[7::plates].T))


# ---- triangular factors ------------------------------------------------------------


def conditioned(rng, n, d, cond):
    """Centred rows whose singular values run from 1 down to 1 / cond."""
    u = np.linalg.qr(rng.normal(size=(n, d)) - 0)[0]
    u = np.linalg.qr(u - u.mean(axis=0))[0]
    v = np.linalg.qr(rng.normal(size=(d, d)))[0]
    return u * np.logspace(0, -np.log10(cond), d) @ v.T


@pytest.mark.parametrize("salts", [8192, 10])
def test_factors_agree_with_numpy(profiles, monkeypatch, salts):
    monkeypatch.setattr(MO, "LEAST_ROWS", salts)
    monkeypatch.setattr("platewise.operators.factors.FAN", 2)
    x, plate, _ = frame(profiles)
    pilot = pilot_of(profiles)
    table = factor_table(profiles, "Metadata_Plate", pilot).toArrow()
    found = {g: f for batch in table.to_batches() for g, f in factors_of(batch, pilot)}
    assert set(found) == set(plate) and table.num_rows == 4
    for group, f in found.items():
        part = x[plate == group]
        assert f.n == len(part) and np.allclose(f.mean, part.mean(0)) and np.allclose(f.std(), part.std(0))
        centred = np.linalg.svd(part - part.mean(0), compute_uv=False)
        assert np.allclose(np.linalg.svd(f.root, compute_uv=False), centred)
        assert np.allclose(np.linalg.svd(f.raw_root(), compute_uv=False), np.linalg.svd(part, compute_uv=False))


def test_condition_is_told_beyond_the_reach_of_gram_matrices(spark):
    rng = np.random.default_rng(8)
    conds = {"P0": 1e6, "P1": 1e9, "P2": 1e11, "P3": 1e12}
    parts = {p: conditioned(rng, 400, 12, c) for p, c in conds.items()}
    rows = [(p, x.tolist()) for p, part in parts.items() for x in part]
    rng.shuffle(rows)
    df = spark.createDataFrame([(p, x) for p, x in rows], "Metadata_Plate string, features array<double>")
    pilot = np.zeros(12)
    for batch in factor_table(df, "Metadata_Plate", pilot).toArrow().to_batches():
        for group, f in factors_of(batch, pilot):
            sigma = np.linalg.svd(f.root, compute_uv=False)
            assert np.isclose(sigma[0] / sigma[-1], conds[group], rtol=1e-2)
    out = N.spherize(df.withColumn("row_id", F.monotonically_increasing_id()), "Metadata_Plate", None, "ZCA", epsilon=1e-15)
    states = {r[0]: r[1] for r in out.select("Metadata_Plate", "model_status").distinct().collect()}
    assert states == {"P0": "ok", "P1": "ok", "P2": "ill conditioned", "P3": "ill conditioned"}


def test_spherize_per_plate_against_numpy(profiles):
    x, plate, _ = frame(profiles)
    for method in ("ZCA", "PCA", "ZCA-cor", "PCA-cor"):
        got = matrix(N.spherize(profiles, "Metadata_Plate", None, method, epsilon=1e-6))
        for p in np.unique(plate):
            part = x[plate == p]
            work = (part - part.mean(0)) / (part.std(0) if "cor" in method else 1.0)
            _, sigma, vt = np.linalg.svd(work, full_matrices=False)
            w = linalg.fixed_signs(vt.T) / (sigma + 1e-6) * np.sqrt(len(part) - 1)
            assert np.allclose(got[plate == p], work @ (w @ linalg.fixed_signs(vt.T).T if "ZCA" in method else w), atol=1e-7)


def test_standardize_falls_back_to_all_rows_without_controls(profiles):
    bare = profiles.withColumn("Metadata_negcon", F.col("Metadata_negcon") & (F.col("Metadata_Plate") != "P1"))
    x, plate, _ = frame(bare)
    got = matrix(N.standardize(bare))
    part = plate == "P1"
    assert np.allclose(got[part], (x[part] - x[part].mean(0)) / x[part].std(0))


def test_robust_mad_paths_agree(profiles, monkeypatch):
    near = matrix(N.robust_mad(profiles))
    monkeypatch.setattr(N, "IN_MEMORY_GROUP", 0)
    far = matrix(N.robust_mad(profiles))
    assert np.allclose(near, far, rtol=1e-9)


def test_tvn_matches_definition(profiles):
    x, plate, ctl = frame(profiles)
    got = matrix(N.tvn(profiles))
    for p in np.unique(plate):
        part = plate == p
        fit = x[part & ctl]
        if len(fit) < 2:
            assert np.allclose(got[part], x[part])
            continue
        power = linalg.sym_power(np.cov(fit.T) + np.eye(6), -0.5)
        assert np.allclose(got[part], (x[part] - fit.mean(0)) @ power)


def test_efaar_matches_definition(profiles):
    x, plate, ctl = frame(profiles)
    got, names = N.tvn_efaar(profiles, n_components=4)
    assert names == ["PC_0", "PC_1", "PC_2", "PC_3"]
    z = (x - x[ctl].mean(0)) / x[ctl].std(0)
    _, vectors = linalg.eigen_desc(np.cov(z[ctl].T))
    y = (z - z[ctl].mean(0)) @ vectors[:, :4]
    for p in np.unique(plate):
        fit = (plate == p) & ctl
        if fit.sum() >= 2:
            mean, std = y[fit].mean(0), y[fit].std(0)
            y[plate == p] = (y[plate == p] - mean) / std
    target = linalg.sym_power(np.cov(y[ctl].T) + 0.5 * np.eye(4), 0.5)
    want = y.copy()
    for p in np.unique(plate):
        fit = (plate == p) & ctl
        if fit.sum() >= 2:
            source = linalg.sym_power(np.cov(y[fit].T) + 0.5 * np.eye(4), -0.5)
            want[plate == p] = y[plate == p] @ source @ target
    assert np.allclose(np.abs(matrix(got)), np.abs(want), atol=1e-8)


def test_original_zeroes_batches_without_controls_and_whitens_the_rest(profiles):
    x, plate, ctl = frame(profiles)
    out, _ = N.tvn_original(profiles, k=3)
    got = matrix(out)
    assert np.allclose(got[plate == "P3"], 0)
    enough = ctl & (plate != "P3")
    w = linalg.whitening(np.cov(x[enough].T), 3, 1e-8)
    y = (x - x[enough].mean(0)) @ w
    fit = y[enough & (plate == "P0")]
    centred = fit - fit.mean(0)
    cov = linalg.shrunk_cov(len(fit), centred.T @ centred, ((centred ** 2).sum(1) ** 2).sum())
    want = y[plate == "P0"] @ linalg.sym_power(cov, -0.5)
    assert np.allclose(np.abs(got[plate == "P0"]), np.abs(want), atol=1e-8)


def test_large_models_use_blocks_with_the_same_result(profiles, monkeypatch):
    near = matrix(N.tvn(profiles))
    monkeypatch.setattr(N, "CLOSURE_MODELS", 0)
    assert np.allclose(near, matrix(N.tvn(profiles)))


def test_cascade_width(profiles):
    out, names = N.tvn_cascade(profiles, k1=5, k2=2)
    assert len(names) == 2 and matrix(out).shape == (240, 2)


@pytest.mark.parametrize("method", ["ZCA", "PCA", "ZCA-cor", "PCA-cor"])
def test_spherize_whitens(profiles, method):
    out = matrix(N.spherize(profiles, None, None, method, epsilon=1e-9))
    assert np.allclose(np.cov(out.T), np.eye(6), atol=1e-5)


def test_spherize_parallel_analysis_keeps_noise(spark, profiles):
    out = N.spherize(profiles, None, None, "ZCA-cor", remove_variance_method="pa", n_permutations=3)
    width = out.select(F.size("features")).first()[0]
    assert 1 <= width <= 6


def test_rank_deficient_pca_spherize_pads(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>")
    out = N.spherize(df, None, None, "PCA")
    assert out.select(F.size("features")).first()[0] == 8


def test_pca_fraction_and_names(profiles):
    out, names = N.pca(profiles, n_components=0.9, control=None)
    x, _, _ = frame(profiles)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.9)) + 1
    assert names == [f"PC_{i + 1}" for i in range(k)]
    assert np.allclose(np.var(matrix(out), axis=0, ddof=1), values[:k])


def test_dimension_guard():
    assert N.clamp_dimensions(100, 10) == 9
    assert N.clamp_dimensions(20, 10) == 20
    with pytest.raises(ValueError):
        N.clamp_dimensions(100, 10, action="abort")


def test_inverse_normal_keeps_rank_and_nan(spark):
    df = spark.createDataFrame([(0, [3.0]), (1, [1.0]), (2, [float("nan")]), (3, [2.0])], "row_id long, features array<double>")
    got = matrix(N.inverse_normal(df)).ravel()
    assert np.isnan(got[2]) and got[1] < got[3] < got[0]


def test_scaling_keeps_rows_without_batch_or_well(spark):
    from pyspark.sql import functions as F

    from platewise.operators import normalize as N

    rows = [(i, None if i % 3 == 0 else f"P{i % 2}", None if i % 4 == 0 else "A1", i % 5 == 0, [float(i), float(i * i % 7)]) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, Metadata_Plate string, Metadata_Well string, Metadata_negcon boolean, features array<double>")
    for found in (N.standardize(df), N.robust_mad(df), N.well_position_correct(df), N.tvn(df)):
        assert found.count() == 40
        assert found.filter(F.size("features") == 2).count() == 40


def test_mad_with_gaps_is_the_same_at_every_size(spark, monkeypatch):
    from platewise.operators import normalize as N

    rows = [("P", True, [1.0, 10.0]), ("P", True, [3.0, 20.0]), ("P", True, [5.0, None]), ("P", True, [9.0, 25.0]), (None, True, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "Metadata_Plate string, Metadata_negcon boolean, features array<double>")
    read = lambda: sorted(str((r["grp"], list(r["center"]), list(r["scale"]))) for r in N.mad_model(df, "Metadata_Plate", "Metadata_negcon").collect())
    near = read()
    monkeypatch.setattr(N, "IN_MEMORY_GROUP", 0)
    assert near == read() and any("[4.0, nan]" in r for r in near)


def test_inverse_normal_takes_text_ids_at_every_size(spark, monkeypatch):
    from platewise.operators import blocks as B
    from platewise.operators import normalize as N

    rows = [(f"c{i}|g", [float(i % 4), float("nan") if i % 6 == 0 else -float(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id string, features array<double>")
    read = lambda: {r["row_id"]: [round(v, 9) if v == v else "nan" for v in r["features"]] for r in N.inverse_normal(df, "row_id").collect()}
    near = read()
    monkeypatch.setattr(B, "ranges_for", lambda rows, hot_rows, per_range=0: 16)
    assert near == read() and len(near) == 60


def test_feature_arrays_must_be_whole():
    import pyarrow as pa
    import pytest as pt

    from platewise.functions.arrow import matrix_of

    with pt.raises(ValueError):
        matrix_of(pa.array([[1.0, 2.0], None], pa.list_(pa.float64())))
    with pt.raises(ValueError):
        matrix_of(pa.array([[1.0, 2.0], [1.0]], pa.list_(pa.float64())))
    assert matrix_of(pa.array([[1.0, None]], pa.list_(pa.float64()))).shape == (1, 2)
