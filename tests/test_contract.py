import os
import pathlib
import re
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from terrasift.plans import registry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_query_names():
    for name in registry.load():
        assert not re.match(r"op\d", name)
        assert "pipeline" not in name


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["month", "dataset"]
    assert df.count() > 0


def test_works_without_the_optional_package(tmp_path):
    """Only the entry point knows of the training-data operators."""
    root = pathlib.Path(entry.__file__).parent
    shutil.copytree(root / "terrasift", tmp_path / "terrasift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'habitat_ranking' in q and not any(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
