"""The driver contract holds with and without the training-data operations."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    return set(subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.split())


def test_entry_without_the_training_data_operations(tmp_path):
    shutil.copytree(REPO / "depmill", tmp_path / "depmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    rest = names(tmp_path)
    assert len(rest) > 80 and not any(n.startswith("op") for n in rest)


def test_entry_runs(spark):
    import __spark_entry__

    if os.path.isdir("/root/testdata/sf0.001"):
        assert len(__spark_entry__.entry(spark).collect()) == 5
