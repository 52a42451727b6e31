"""The entry module with and without the training-data subpackage and the pipeline over it."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'pipeline' in q, any(n.startswith('op') for n in q))"


@pytest.mark.parametrize("gone", [("packetloom/llm", "corpus_pipeline.py"), ("packetloom/llm",), ("corpus_pipeline.py",)])
def test_entry_works_without(tmp_path, gone):
    for name in ("packetloom", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
        elif (tmp_path / name).exists():
            (tmp_path / name).unlink()
    said = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 200 and int(said[1]) > 150 and said[2] == "False"
    assert said[3] == str((tmp_path / "packetloom/llm").exists())
