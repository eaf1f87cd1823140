from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.functions.stats import correlation_p, null_draws
from platewise.operators import retrieval as R
from platewise.operators.similarity import PairRule, average_precision, top_k


def unit(df):
    pdf = df.orderBy("row_id").toPandas()
    x = np.vstack(pdf["features"].map(np.asarray))
    return pdf, x / np.linalg.norm(x, axis=1, keepdims=True)


def brute_ap(sims, positive):
    order = sorted(range(len(sims)), key=lambda i: (-round(sims[i], 10), not positive[i]))
    hits, total = 0, []
    for place, i in enumerate(order, 1):
        if positive[i]:
            hits += 1
            total.append(hits / place)
    return np.mean(total)


@pytest.mark.parametrize("cell_rows", [4096, 7])
def test_activity_against_brute_force(profiles, cell_rows):
    """A tiny cell size forces the grid of a pool far beyond one task."""
    pdf, u = unit(profiles)
    got = {int(r["id"]): r["average_precision"] for r in R.phenotypic_activity(profiles, cell_rows=cell_rows).collect()}
    ctl = pdf["Metadata_negcon"].to_numpy()
    pert, plate = pdf["Metadata_JCP2022"].to_numpy(), pdf["Metadata_Plate"].to_numpy()
    for i in range(0, len(pdf), 11):
        if ctl[i]:
            assert i not in got
            continue
        pos = (pert == pert[i]) & ~ctl & (np.arange(len(pdf)) != i)
        neg = (plate == plate[i]) & ctl
        if not pos.any() or not neg.any():
            continue
        pick = np.nonzero(pos | neg)[0]
        assert np.isclose(got[i], brute_ap((u[pick] @ u[i]).tolist(), pos[pick].tolist()))


def test_both_anchors_agree(profiles):
    treated, control = ~F.col(C.NEGCON), F.col(C.NEGCON)
    pos = PairRule(same=[C.PERT], query=treated, ref=treated)
    neg = PairRule(same=[C.PLATE], query=treated, ref=control)
    a = {r["id"]: (r["n_pos"], r["n_neg"], r["average_precision"])
         for r in average_precision(profiles, "row_id", pos, neg, "pos").collect()}
    b = {r["id"]: (r["n_pos"], r["n_neg"], r["average_precision"])
         for r in average_precision(profiles, "row_id", pos, neg, "neg", cell_rows=9).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][:2] == b[k][:2] and np.isclose(a[k][2], b[k][2])


def test_ties_and_zero_vectors(spark):
    rows = [("q", "a", [1.0, 0.0]), ("p", "a", [2.0, 0.0]), ("n", "b", [3.0, 0.0]), ("z", "b", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, label string, features array<double>")
    ap = average_precision(df, "id", PairRule(same=["label"]), PairRule(differ=["label"]))
    got = {r["id"]: r["average_precision"] for r in ap.collect()}
    assert got["q"] == 1.0  # an equal similarity ranks the positive first
    assert got["z"] == 1.0  # all similarities are zero


def test_perfect_ranking_is_one_and_expectation_matches_enumeration(spark):
    values = []
    for order in set(permutations([1, 1, 0, 0, 0])):
        hits = np.cumsum(order)
        values.append(np.mean([hits[i] / (i + 1) for i in range(5) if order[i]]))
    got = spark.range(1).select(R.expected_precision(F.lit(2), F.lit(5))).first()[0]
    assert np.isclose(got, np.mean(values))
    big = spark.range(1).select(R.harmonic(F.lit(1000))).first()[0]
    assert np.isclose(big, sum(1 / i for i in range(1, 1001)), atol=1e-12)


@pytest.mark.parametrize("shape", [(2, 5), (3, 400), (40, 80), (4, 4)])
def test_null_draws_have_the_expected_mean(spark, shape):
    n_pos, n = shape
    draws = null_draws(n_pos, n, 4000, 0)
    expected = spark.range(1).select(R.expected_precision(F.lit(n_pos), F.lit(n))).first()[0]
    assert np.isclose(draws.mean(), expected, atol=0.02)
    assert np.array_equal(draws, null_draws(n_pos, n, 4000, 0))


def test_significance_corrects_within_the_table(profiles):
    ap = R.phenotypic_activity(profiles)
    maps = R.mean_average_precision(ap, [C.PERT, C.GROUP])
    got = R.with_significance(maps, ap, [C.PERT, C.GROUP], null_size=500).toPandas()
    p = np.sort(got["p_value"].to_numpy())
    adjusted = np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    assert np.allclose(np.sort(got["corrected_p_value"]), np.minimum(adjusted, 1))


@pytest.mark.parametrize("cell_rows", [4096, 6])
def test_recall_against_brute_force(spark, profiles, cell_rows):
    rows = profiles.filter("row_id < 60").withColumn("row_id", F.lpad(F.col("row_id").cast("string"), 3, "0"))
    pdf, u = unit(rows)
    ids = pdf["row_id"].tolist()
    edges = [(ids[i], ids[(i * 7 + 3) % 60]) for i in range(60)] + [(ids[0], ids[5])]
    table = spark.createDataFrame(edges, "query_id string, ref_id string")
    got = R.recall_table(rows, "row_id", R.edge_anchors(rows, "row_id", table), [], cell_rows=cell_rows)
    got = {r["id"]: (r["n_pos"], r["n_refs"], r["recall_10"]) for r in got.collect()}
    sims = np.round(u @ u.T, 10)
    for i, name in enumerate(ids):
        partners = {b for a, b in edges if a == name and b != name}
        if not partners:
            assert name not in got
            continue
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-sims[i, j], ids[j]))
        hits = sum(ids[j] in partners for j in order[:6])
        assert got[name] == (len(partners), 60, pytest.approx(hits / len(partners)))


def test_top_k_in_small_cells(profiles):
    _, u = unit(profiles)
    sims = np.round(u @ u.T, 10)
    np.fill_diagonal(sims, -9)
    got = top_k(profiles, "row_id", PairRule(), 3, cell_rows=50).collect()
    assert len(got) == 240 * 3
    for r in got:
        if r["rank"] == 1:
            assert np.isclose(r["sim"], sims[int(r["query_id"])].max())


def test_shared_targets_and_background(spark):
    rng = np.random.default_rng(0)
    rows = [(f"r{i}", f"c{i}", "g", ["unknown"] if i > 8 else [f"t{i % 2}", "x"] if i % 3 else [f"t{i % 2}"],
             rng.normal(size=4).tolist()) for i in range(12)]
    df = spark.createDataFrame(
        rows, "row_id string, Metadata_JCP2022 string, Metadata_Group string, targets array<string>, features array<double>")
    plain = R.phenotypic_consistency(df, [C.GROUP]).toPandas()
    wide = R.phenotypic_consistency(df, [C.GROUP], keep_unknown=True).toPandas()
    assert "unknown" not in set(wide["target"])
    assert (wide.set_index(["id", "target"])["n_neg"] - plain.set_index(["id", "target"])["n_neg"] == 3).all()


def test_correlation_p_value():
    # two-sided p of r = 0.5 with n = 10 from tables of the t distribution
    assert np.isclose(correlation_p(0.5, 10), 0.141111, atol=1e-5)
    assert correlation_p(1.0, 5) == 0.0


def test_shared_cells_stay_bounded(spark):
    """Many small pools: the number of cells follows the rows."""
    from pyspark.sql import functions as F

    from platewise.operators import similarity as S

    rows = spark.range(20_000).select(
        F.concat(F.lit("p"), F.col("id") % 5000).alias("pool"), F.col("id").cast("string").alias("id"))
    left, right = S.into_cells(rows, rows, 16)
    sizes = left.groupBy("cell").count().agg(F.max("count")).first()[0]
    assert sizes <= 16 * 8 and left.count() == right.count() == 20_000


def test_edges_meet_in_cells_with_features_sent_once_a_cell(spark, monkeypatch):
    """A hub with an edge to every row, blocks of a few rows: the similarities are those of single pairs."""
    import numpy as np

    from platewise.operators import similarity as S

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    x[3] = 0
    df = spark.createDataFrame([(i, i % 2 == 0, v.tolist()) for i, v in enumerate(x)], "row_id long, even boolean, features array<double>")
    edges = [(0, i) for i in range(60)] + [(i, (i * 7) % 60) for i in range(60)] + [(5, 6), (5, 6), (1, 999)]
    table = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "query_id string, ref_id string")
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    for block_rows in (4, 1000):
        for query in (None, F.col("even")):
            found = {(r["id"], a["ref"]): a["sim"] for r in S.edge_anchors(df, "row_id", table, query, block_rows=block_rows).collect()
                     for a in r["anchors"]}
            want = {(str(a), str(b)): unit[a] @ unit[b] for a, b in set(edges) if a != b and b < 60 and (query is None or a % 2 == 0)}
            assert set(found) == set(want) and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    assert S.edge_anchors(df, "row_id", table.limit(0)).count() == 0


# ---- null distributions ------------------------------------------------------------


def test_random_places_are_uniform_subsets():
    import collections
    import itertools

    import numpy as np

    from platewise.functions.stats import random_places

    found = random_places(np.random.default_rng(3), 30_000, 3, 6)
    assert (np.diff(found, axis=1) > 0).all()
    counts = collections.Counter(map(tuple, found.tolist()))
    assert set(counts) == set(itertools.combinations(range(6), 3))
    assert max(abs(n - 1500) for n in counts.values()) < 5 * np.sqrt(1500)


def test_null_draws_follow_closed_forms():
    import itertools

    import numpy as np

    from platewise.functions.stats import exceeding, null_draws

    one = null_draws(1, 50, 20_000, 0)  # the reciprocal of a uniform place
    for k in (1, 2, 5, 25):
        assert abs((one >= 1 / k - 1e-12).mean() - k / 50) < 5 * np.sqrt(0.25 / 20_000)
    for n_pos, n_total in ((2, 7), (5, 7)):
        exact = np.array([np.mean([(i + 1) / (p + 1) for i, p in enumerate(c)]) for c in itertools.combinations(range(n_total), n_pos)])
        drawn = null_draws(n_pos, n_total, 20_000, 1)
        assert abs(drawn.mean() - exact.mean()) < 0.01 and abs(np.median(drawn) - np.median(exact)) < 0.03
    assert (null_draws(4, 4, 10, 0) == 1).all()
    draws = 0.25 * null_draws(1, 50, 1000, 0) + 0.75 * null_draws(2, 7, 1000, 0)
    values = np.array([0.0, 0.2, 0.5, 2.0])
    assert exceeding(((2, 7, 3), (1, 50, 1)), values, 1000, 0).tolist() == [(draws > v + 1e-12).sum() for v in values]


def test_null_draws_cost_the_positives_only():
    import time

    from platewise.functions.stats import null_draws

    null_draws.cache_clear()
    begun = time.process_time()
    assert len(null_draws(1000, 100_000, 10_000, 0)) == 10_000
    assert time.process_time() - begun < 4  # below one second on an idle machine; drawing all places takes minutes


# ---- top of a ranking from histograms ----------------------------------------------


@pytest.mark.parametrize("cell_rows", [25])
def test_shared_target_recall_equals_ranking_all_pairs(spark, cell_rows):
    """A target of half the rows, equal vectors and ties, several pools, rows without labels."""
    import numpy as np

    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(90, 3)), 1)
    x[10:30] = x[10]  # a crowd of equal vectors
    labels = [["hub"] * (i % 2 == 0) + [f"t{i % 9}", f"t{i % 9}"] * (i % 3 == 0) for i in range(90)]
    labels[5], labels[7] = None, []
    pools = [f"g{i % 2}" if i % 17 else None for i in range(90)]
    rows = [(f"id{(i * 37) % 90}", pools[i], labels[i], x[i].tolist()) for i in range(90)]
    df = spark.createDataFrame([r for r in rows if r[1]], "row_id string, pool string, targets array<string>, features array<double>")
    found = {r["id"]: (r["n_pos"], r["n_refs"], round(r["recall_1"], 9), round(r["recall_10"], 9), round(r["recall_50"], 9))
             for r in R.shared_target_recall(df, "targets", ["pool"], (1.0, 10.0, 50.0), cell_rows=cell_rows).collect()}
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    want = {}
    for i, (name, pool, own, _) in enumerate(rows):
        refs = [j for j in range(90) if rows[j][1] == pool and pool]
        order = sorted((j for j in refs if j != i), key=lambda j: (-round(float(unit[i] @ unit[j]), 10), rows[j][0]))
        hit = [bool(set(own or []) & set(rows[j][2] or [])) for j in order]
        if sum(hit):
            share = lambda pct: round(sum(hit[:max(1, int(len(refs) * pct / 100))]) / sum(hit), 9)
            want[name] = (sum(hit), len(refs), share(1), share(10), share(50))
    assert found == want


def test_hub_partners_cost_bins_not_pairs(spark, monkeypatch):
    """With one target on all rows, what leaves the cells is bins per query and cell, however many the partners."""
    from platewise.operators import cuts

    sent = []
    real = cuts.summed_lists
    monkeypatch.setattr(cuts, "summed_lists", lambda name: sent.append(name) or real(name))
    rows = [(f"r{i}", ["hub"], [float(i % 5), float(i % 7), 1.0]) for i in range(150)]
    df = spark.createDataFrame(rows, "row_id string, targets array<string>, features array<double>")
    out = R.shared_target_recall(df, "targets", [], (1.0,))
    assert [r["n_pos"] for r in out.collect()] == [149] * 150
    assert len(sent) <= -(-cuts.KEY_BITS // cuts.BITS) + 1  # rounds of histograms and one of hits: no list of partners
