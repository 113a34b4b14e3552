"""Every query with SQL against DuckDB, the others for rows and a stable schema; and the driver's entry."""

import os

import pytest

from panelforge.plans import catalogue
from tests import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = catalogue.oracle_sql()
@pytest.fixture(scope="module")
def con():
    return compare.database(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    assert compare.differences(catalogue.queries()[name](spark, SF), con, SQL[name]) is None


#: Columns that identify a row of each query without SQL.
KEYS = {
    "fuzzy_ratio": ["p_partkey"], "composite_rank": ["left_id", "rank"], "one_to_one": ["left_id"], "seeds": ["left_id"], "propagate_final": ["left_id"], "propagation_counts": ["metric"],
    "topology_counts": ["metric"], "distance_by_label": ["label"], "ablation": ["variant"], "sensitivity_grid": ["parameter", "value"], "review_samples": ["left_id", "stratum"], "case_studies": ["case"],
    "ridge_forecast": ["bus", "ts"], "elastic_net_forecast": ["bus", "ts"], "rf_forecast": ["bus", "ts"], "gbt_forecast": ["bus", "ts"], "zone_model_forecast": ["bus", "ts"], "forecast_errors": ["model", "horizon", "level"],
    "kmeans_profiles": ["bus"], "cluster_summary": ["kmeans_cluster"], "gmm_profiles": ["bus"], "embedding_clusters": ["vec_id"], "logistic_match": ["left_id", "dataset"], "classifier_quality": ["rows"],
    "selection_errors": ["fold", "model"], "selection_levels": ["fold", "model", "horizon", "level"], "selection_clusters": ["model"], "selection_log": ["fold", "part"],
}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_rows(spark, name):
    """Rows there are, one of a key, with numbers where scores, errors and forecasts are due."""
    rows = catalogue.queries()[name](spark, SF).toPandas()
    assert len(rows) and len(rows.columns) == len(set(rows.columns))
    if name in KEYS:
        assert not rows.duplicated(KEYS[name]).any()
    for c in set(rows.columns) & {"ratio", "composite", "score", "final_score", "probability_1", "kmeans_confidence", "cluster_confidence", "accuracy", "auc"}:
        assert rows[c].dropna().between(0, 1).all() and rows[c].notna().any(), c
    if "predicted_pd" in rows:
        known = rows.dropna(subset=["actual_pd"])
        assert (rows.predicted_pd >= 0).all() and abs(known.predicted_pd - known.actual_pd).mean() < known.actual_pd.std() * 1.2
    if "right_id" in rows and name in ("propagate_final", "one_to_one", "seeds"):
        assert not rows.right_id.dropna().duplicated().any()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_a_library(tmp_path):
    """A missing library of the corpus operators takes only their queries away."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print('metrics_zone' in q, any(n.startswith('op10') for n in q), 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(catalogue.__file__).resolve().parents[2], capture_output=True, text=True)
    assert done.stdout.split() == ["True", "False", "False"], done.stderr[-500:]


def test_nothing_imports_the_corpus_subpackage():
    import pathlib

    root = pathlib.Path(catalogue.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "panelforge.llm" not in p.read_text(), p
