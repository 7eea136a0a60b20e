"""Every registered query of the engine against its SQL."""

import pytest
from oracle import same

from casewright.plans.catalog import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    same(spark, QUERIES[name], ORACLE.get(name))


def test_entry_imports_without_the_optional_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "casewright", tmp_path / "casewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) == len(QUERIES)
