"""The library without its optional subpackage: folders absent, or empty, or the pipeline left behind."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAYS = """
import __spark_entry__ as e
from sigwarn import registry
names = set(e.queries())
assert names == set(registry.QUERIES) and set(e.oracle_sql()) == set(registry.ORACLES), names ^ set(registry.QUERIES)
"""


@pytest.mark.parametrize(("folder", "pipeline"), [("absent", False), ("empty", False), ("absent", True), ("empty", True)])
def test_the_rest_imports(tmp_path, folder, pipeline):
    for name in ("sigwarn", "__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])):
        at = ROOT / name
        shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if at.is_dir() else shutil.copy(at, tmp_path)
    if folder == "empty":
        (tmp_path / "sigwarn" / "llm").mkdir()
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=False)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "sigwarn").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "sigwarn.llm" not in path.read_text(), path
