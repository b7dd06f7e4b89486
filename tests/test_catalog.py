import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from recollect import catalog
from tests.oracle import compare

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
#: Results that may be empty on the smallest tables.
MAY_BE_EMPTY = {"alias_stubs", "chunks_since", "entities_since", "allowlist_intersection"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tiny, name):
    n = compare(QUERIES[name](spark, tiny), ORACLES[name], tiny)
    assert n or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_entry_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_works_without_the_optional_package(tmp_path):
    """The contract's module imports, and registers the other queries, where the optional package is gone."""
    root = Path(__file__).resolve().parents[1]
    for name in ("__spark_entry__.py", "recollect"):
        (tmp_path / name).symlink_to(root / name) if name.endswith(".py") else None
    (tmp_path / "recollect").mkdir()
    for item in (root / "recollect").iterdir():
        if item.name not in ("llm", "__pycache__"):
            (tmp_path / "recollect" / item.name).symlink_to(item)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_retrieve' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
