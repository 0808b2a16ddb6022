"""Every registered query with check SQL agrees with it; the others return rows."""

import shutil
import subprocess
import sys
from pathlib import Path

import oracle as tool
import pytest
from conftest import SMALL

from voltmill.plans import load_queries

QUERIES = load_queries()
CHECKED = [name for name, q in QUERIES.items() if q.sql is not None]
# queries whose answer is empty on the smallest tables
LARGER = "/root/testdata/sf0.01"
NEED_MORE_ROWS = {
    "approval_status", "approval_violations", "baseline_metrics", "baselines", "battery_rejects", "forecast_metrics",
    "holdout_split", "model_health", "promotion_gates", "psi_features", "rank_models", "target_drift",
}


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, oracle, name):
    """Equal to the SQL, and not empty."""
    if name in NEED_MORE_ROWS:
        assert tool.compare(spark, tool.connect(LARGER), QUERIES[name], LARGER) == ""
    else:
        assert tool.compare(spark, oracle, QUERIES[name], SMALL) == ""


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())


def test_entry_without_the_text_operators(tmp_path):
    """The rest loads where the subpackage and the pipeline are missing."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "voltmill", tmp_path / "voltmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    for pipeline_too in (False, True):
        if pipeline_too:
            shutil.copy(root / "corpus_pipeline.py", tmp_path)
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
        found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
        assert list(map(int, found.stdout.split())) == [len(QUERIES), len(CHECKED)]
