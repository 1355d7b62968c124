"""Every registered query against its SQL counterpart."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_points
import oracle
from postulant.catalogue import all_queries, all_sql


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())
    assert set(all_queries()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, con, folder, name):
    rows, difference = oracle.compare(spark, con, name, folder)
    assert not difference
    assert rows > 0 or name == "br_nobody"


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["job", "month", "n"]
    assert df.count() > 0


# These work on stored tables and return rows read back from a file.
STORED = {"ing_stream", "mut_table", "mut_files", "mut_compact", "st_maintained", "ing_retire", "br_spelled"}
# Only these call Python; every other plan stays in the JVM.
PYTHON = {"ux_extract"}


@pytest.mark.parametrize("name", sorted(set(all_queries()) - STORED))
def test_no_python_in_plans(spark, folder, name):
    plan = entry_points.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert any(word in plan for word in ("Python", "Pandas", "Arrow")) == (name in PYTHON)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",), ("corpus_pipeline.py", "postulant/llm")])
def test_import_without_the_optional_part(tmp_path, left):
    """A copy without the training-data operators, with or without their pipeline, offers all other queries."""
    root = Path(__file__).resolve().parent.parent
    copied = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(root / "postulant", tmp_path / "postulant", ignore=copied)
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    for name in left:
        if (root / name).is_dir():
            shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("*.py"))
        elif (root / name).exists():
            shutil.copy(root / name, tmp_path)
    said = "import __spark_entry__ as e; print(*sorted(e.queries()), len(e.queries()) == len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [*sorted(all_queries()), "True"]
