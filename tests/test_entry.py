"""The library without its training-data part."""

import os
import shutil
import subprocess
import sys

import pytest

from ledgerfold.plans.queries import ORACLE_SQL, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("removed", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_training_data_part(tmp_path, removed):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in removed and os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/ledgerfold", tmp_path / "ledgerfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as c; print(len(c.queries()), len(c.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert got.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))], got.stderr


def test_errors_inside_a_present_part_are_not_hidden(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/ledgerfold", tmp_path / "ledgerfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "ledgerfold" / "llm").mkdir()
    (tmp_path / "ledgerfold" / "llm" / "__init__.py").touch()
    (tmp_path / "ledgerfold" / "llm" / "queries.py").write_text("import no_such_module\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as c; c.queries()"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "no_such_module" in got.stderr
