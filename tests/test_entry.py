"""The driver contract without the optional folders."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q), len(o), sum(n.startswith('op') for n in q), 'pipeline' in q)"


def copy(folder, keep_pipeline):
    for name in ("attnstrata", "workloads"):
        shutil.copytree(f"{ROOT}/{name}", f"{folder}/{name}", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", folder)
    if keep_pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", folder)


def names(folder):
    return subprocess.run([sys.executable, "-c", NAMES], cwd=folder, capture_output=True, text=True, check=False)


@pytest.mark.parametrize("keep_pipeline", [True, False])
def test_queries_stay_when_the_llm_folders_are_gone(tmp_path, keep_pipeline):
    copy(tmp_path, keep_pipeline)
    found = names(tmp_path)
    assert found.returncode == 0, found.stderr
    queries, oracles, ops, pipeline = found.stdout.split()
    assert int(queries) > 150 and int(oracles) > 130 and int(ops) == 0 and pipeline == "False"


def test_a_broken_module_still_raises(tmp_path):
    copy(tmp_path, False)
    os.mkdir(tmp_path / "attnstrata/llm")
    (tmp_path / "attnstrata/llm/__init__.py").write_text("")
    (tmp_path / "attnstrata/llm/queries.py").write_text("import a_module_that_is_not_there\n")
    found = names(tmp_path)
    assert found.returncode and "a_module_that_is_not_there" in found.stderr
