"""Rankings over whole pools in strips against the lists and grids they replace."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise import columns as C
from platewise.operators import retrieval as R
from platewise.operators import similarity as S
from platewise.operators import strips


def found(ap):
    return {(r["id"], r["lab"]): (r["n_pos"], r["n_neg"], round(r["average_precision"], 9)) for r in ap.collect()}


@pytest.fixture
def crowd(spark):
    """A target on every second row, ties, rows without labels, two pools and a NULL pool."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(120, 3)), 1)
    x[20:50] = x[20]
    labels = [["hub"] * (i % 2 == 0) + [f"t{i % 5}", f"t{i % 5}"] * (i % 3 > 0) for i in range(120)]
    labels[4], labels[9] = None, []
    rows = [(f"r{i}", f"c{i % 60}", f"g{i % 2}" if i % 11 else None, f"p{i % 3}", i % 7 == 0, labels[i], x[i].tolist()) for i in range(120)]
    return spark.createDataFrame(
        rows, "row_id string, Metadata_JCP2022 string, Metadata_Group string, Metadata_Plate string, Metadata_negcon boolean, "
              "targets array<string>, features array<double>").cache()


def test_hub_targets_are_ranked_without_lists(crowd, monkeypatch):
    """No list of partners is made, in strips of a few rows too, and every value is that of the lists."""
    pos, neg = S.PairRule(same=[C.GROUP], shared="targets"), S.PairRule(same=[C.GROUP], disjoint="targets")
    real = S.anchor_sims
    monkeypatch.setattr(S, "anchor_sims", lambda *a: pytest.fail("partners were listed"))
    monkeypatch.setattr(strips, "LEAST_ROWS", 1)
    whole = found(S.average_precision(crowd, "row_id", pos, neg))
    monkeypatch.setattr(S, "anchor_sims", real)
    monkeypatch.setattr(strips, "REF_BYTES", 0)
    assert len(whole) > 100 and whole == found(S.average_precision(crowd, "row_id", pos, neg, "pos"))


@pytest.mark.parametrize("block", [1, strips.BLOCK])
def test_pools_in_strips_and_lists_agree(crowd, monkeypatch, block):
    """Differing columns, controls as references; all in strips, all listed, and some of each."""
    treated, control = ~F.col(C.NEGCON), F.col(C.NEGCON)
    pos = S.PairRule(same=[C.GROUP], differ=[C.PLATE, C.PERT], query=treated, ref=treated)
    neg = S.PairRule(same=[C.PLATE], differ=[C.PERT], query=treated, ref=control)
    monkeypatch.setattr(strips, "BLOCK", block)
    got = []
    for cost in (0, 1_000, 10**9):
        monkeypatch.setattr(S, "STRIP_COST", cost)
        got.append(found(S.average_precision(crowd, "row_id", pos, neg)))
    assert len(got[0]) > 80 and got[0] == got[1] == got[2]


def test_many_pairs_of_large_pools_cost_no_list(spark, monkeypatch):
    """Wells and plates of a few hundred rows: strips are chosen by their size alone."""
    monkeypatch.setattr(S, "anchor_sims", lambda *a: pytest.fail("partners were listed"))
    rng = np.random.default_rng(1)
    rows = [(i, f"c{i % 50}", "g", f"p{i % 2}", f"w{i // 2 % 2}", False, rng.normal(size=2).tolist()) for i in range(1200)]
    df = spark.createDataFrame(
        rows, "row_id long, Metadata_JCP2022 string, Metadata_Group string, Metadata_Plate string, Metadata_Well string, "
              "Metadata_negcon boolean, features array<double>")
    assert R.well_position_effect(df, mode="full").count() == 1200


def test_subset_and_symbol_recall_make_no_pairs(crowd, monkeypatch):
    """targets that are the symbol of very many genes are told by label; every value is that of the pairs."""
    rows = crowd.withColumn(C.GROUP, F.concat(F.lit("h"), F.substring("row_id", 2, 9).cast("int") % 4)).withColumn(
        C.SYMBOL, F.when(F.col("row_id") < "r7", F.concat(F.lit("t"), F.substring("row_id", 2, 9).cast("int") % 3)))
    targets = crowd.sparkSession.createDataFrame(
        [("a", f"c{i}", f"t{i % 3}") for i in range(40)] + [("b", f"c{i}", f"t{j}") for i in range(0, 60, 2) for j in range(3)],
        f"subset string, {C.PERT} string, target string")
    sides = (["h0", "h1"], ["h1", "h2"])
    plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    asked = lambda way: [plain(R.subset_recall(rows, targets, *sides, direction=way)), plain(R.symbol_recall(rows, "h1", "h2").select(
        "id", "n_pos", "n_refs", "recall_1", "recall_5", "recall_10"))]
    real = R.symbol_pairs, R.genetic_pairs
    for name in ("symbol_pairs", "genetic_pairs"):
        monkeypatch.setattr(R, name, lambda *a: pytest.fail("pairs were made"))
    monkeypatch.setattr(strips, "LEAST_ROWS", 1)
    whole = asked("top") + asked("bottom")[:1]
    monkeypatch.setattr(R, "symbol_pairs", real[0])
    monkeypatch.setattr(R, "genetic_pairs", real[1])
    monkeypatch.setattr(strips, "REF_BYTES", 0)
    assert len(whole[0]) == 6 and len(whole[1]) > 10 and whole == asked("top") + asked("bottom")[:1]


def test_shared_target_recall_needs_no_grid(crowd, monkeypatch):
    """F8: a small cell size does not cut a pool that fits a task; edges are told by id."""
    df = crowd.filter(f"{C.GROUP} is not null")
    edges = df.select(F.col("row_id").alias("query_id")).join(df.select(F.col("row_id").alias("ref_id"), C.GROUP), F.expr(
        f"hash(query_id, ref_id) % 9 = 0")).join(df.select(F.col("row_id").alias("query_id"), F.col(C.GROUP).alias("g")), "query_id").filter(
        f"g = {C.GROUP}").select("query_id", "ref_id")
    plain = lambda t: {r["id"]: [round(v, 9) if isinstance(v, float) else v for v in r] for r in t.collect()}
    asked = lambda: [plain(R.shared_target_recall(df, "targets", [C.GROUP], cell_rows=20)), plain(R.edge_recall(df, "row_id", edges, [C.GROUP]))]
    real = R.top_shares
    monkeypatch.setattr(R, "top_shares", lambda *a, **k: pytest.fail("the pool was cut into cells"))
    whole = asked()
    monkeypatch.setattr(R, "top_shares", real)
    monkeypatch.setattr(strips, "REF_BYTES", 0)
    assert min(map(len, whole)) > 80 and whole == asked()


def test_top_k_cuts_no_small_cells(spark, monkeypatch):
    """pools beyond the cell size go to cells that fit a task; ties over many blocks; the same rows as all pairs."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 4))
    x[30:90] = x[30]
    df = spark.createDataFrame([(f"r{i}", i % 3, v.tolist()) for i, v in enumerate(x)], "row_id string, plate long, features array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 10)
    monkeypatch.setattr(S, "TOP_STEP", 16)
    for rule, allowed in ((S.PairRule(), lambda i, j: i != j), (S.PairRule(differ=["plate"]), lambda i, j: i % 3 != j % 3)):
        want = {(f"r{i}", n + 1): f"r{j}" for i in range(150) for n, j in enumerate(
            sorted((j for j in range(150) if allowed(i, j)), key=lambda j: (-sims[i, j], f"r{j}"))[:7])}
        assert {(r["query_id"], r["rank"]): r["ref_id"] for r in S.top_k(df, "row_id", rule, 7, cell_rows=20).collect()} == want
        monkeypatch.setattr(S, "TOP_BYTES", 4 * 8 * 25)
        assert {(r["query_id"], r["rank"]): r["ref_id"] for r in S.top_k(df, "row_id", rule, 7, cell_rows=20).collect()} == want
        monkeypatch.undo()
        monkeypatch.setattr(S, "TOP_STEP", 16)
    cells = []
    real = S.into_cells
    monkeypatch.setattr(S, "into_cells", lambda *a, **o: cells.append(real(*a, **o)) or cells[-1])
    S.top_k(df, "row_id", S.PairRule(), 7, cell_rows=2)
    assert cells[0][1].count() <= 150 * 3  # a reference goes to each strip of queries; 75 times in cells of two rows


def test_null_draws_cost_the_fewer_places():
    """ten thousand positives and a few negatives cost as little as the negatives."""
    import time

    from platewise.functions.stats import null_draws

    null_draws.cache_clear()
    begun = time.process_time()
    draws = null_draws(30_000, 30_020, 2_000, 0)
    assert time.process_time() - begun < 1 and 0.9 < draws.min() and draws.max() <= 1


def test_nulls_of_few_groups_are_drawn_in_many_tasks(spark):
    """each group has a shape of its own, and the draws of all of them are not left to one task."""
    ap = spark.createDataFrame([(f"t{i}", 3 + i, 40 + 2 * i, 0.2, 0.1) for i in range(24)],
                               "target string, n_pos long, n_total long, average_precision double, normalized_average_precision double")
    maps = R.mean_average_precision(ap, ["target"])
    seen = []
    real = type(maps).mapInArrow
    try:
        type(maps).mapInArrow = lambda self, *a, **k: seen.append(self) or real(self, *a, **k)
        out = R.with_significance(maps, ap, ["target"], null_size=50).collect()
    finally:
        type(maps).mapInArrow = real
    assert len(out) == 24
    assert seen[0].select(F.spark_partition_id()).distinct().count() > 1
