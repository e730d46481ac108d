"""The library without its optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("without", [["llm"], ["llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without(tmp_path, without):
    for name in os.listdir(ROOT):
        if name == "tidewatch":
            shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=lambda _, names: [x for x in names if x in (*without, "__pycache__")])
        elif name.endswith(".py") and name not in without:
            shutil.copy(f"{ROOT}/{name}", tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1') for n in q), set(e.oracle_sql()) <= set(q))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True, timeout=120)
    n, pipeline, text, whole = out.stdout.split()
    assert int(n) > 200 and whole == "True" and pipeline == "False" and text == str("llm" not in without)
