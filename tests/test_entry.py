"""The entry without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q = e.queries(); assert e.oracle_sql().keys() <= q.keys(); print(len(q), *[n for n in q if n.startswith('op')])"


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_entry_loads_without_the_subpackage(tmp_path, pipeline_too):
    import __spark_entry__ as entry

    left_out = ("llm", "__pycache__", *["corpus_pipeline.py"] * pipeline_too)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out:
            shutil.copy(ROOT / name, tmp_path / name) if (ROOT / name).exists() else None
    for name in ("jobtide", "bindings"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns(*left_out))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    rest = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]
    assert done.stdout.split() == [str(len(rest))]
