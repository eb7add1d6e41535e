"""Every registered query against its counterpart in DuckDB."""

import pytest

from larkspur import registry
from tests.comparing import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, sf_dir, name):
    got = spark_rows(registry.QUERIES[name](spark, sf_dir))
    if name in registry.ORACLES:
        assert got == duck_rows(sf_dir, registry.ORACLES[name])
    assert got[0]


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 200 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], timeout=120).returncode == 0
