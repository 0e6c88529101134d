"""The entry without the training-data operators: they may be taken away, with or without the pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_without_the_subpackage(tmp_path, with_pipeline):
    tree = tmp_path / "tree"
    shutil.copytree(HERE, tree, ignore=lambda _, names: [n for n in names if n in (".git", "llm", "__pycache__", ".pytest_cache") or (n == "corpus_pipeline.py" and not with_pipeline)])
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 40 and set(s) <= set(q); assert not any(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in q); import bench"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tree, env=env, capture_output=True, text=True, timeout=120)
    assert not done.returncode, done.stderr
