"""The library without its optional part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n[:2] == 'op' or n == 'pipeline' for n in e.queries()))"


@pytest.mark.parametrize("left_out", [("acervo/llm", "tests/llm"), ("acervo/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_imports(tmp_path, left_out):
    gone = {os.path.join(ROOT, name) for name in left_out}
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or os.path.join(folder, n) in gone])
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, sql, optional = map(int, done.stdout.split())
    assert n > 100 and sql > 100 and optional == 0
