import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from platewise.session import build_session

    session = build_session("tests", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def profiles(spark):
    """240 profiles, 6 features, 4 plates with differing controls; one plate with one control."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        plate = i % 4
        control = (i % 6 == 0) if plate < 3 else (i == 3)
        x = rng.normal(size=6) * (1 + plate) + plate + np.array([0, 1, 2, 3, 4, 5.0])
        x[1] += x[0]
        rows.append((i, f"P{plate}", f"W{i % 12}", "ctl" if control else f"C{i % 9}", "g", control, x.tolist()))
    df = spark.createDataFrame(
        rows, "row_id long, Metadata_Plate string, Metadata_Well string, Metadata_JCP2022 string, "
              "Metadata_Group string, Metadata_negcon boolean, features array<double>")
    return df.cache()
