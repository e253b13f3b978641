"""The driver's entry with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def _names(folder: Path) -> tuple[set[str], set[str]]:
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    a, b = out.stdout.splitlines()[-2:]
    return set(a.split()), set(b.split())


def _copy(to: Path, *without: str) -> Path:
    shutil.copytree(REPO, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.parquet", "*.json"))
    for name in without:
        target = to / name
        shutil.rmtree(target, ignore_errors=True) if target.is_dir() else target.unlink(missing_ok=True)
    return to


def test_without_the_subpackage(tmp_path):
    core, sql = _names(_copy(tmp_path / "core", "corvane/llm", "tests/llm", "corpus_pipeline.py"))
    assert len(core) >= 70 and sql <= core and "pipeline" not in core and not any(n.startswith("op") and n[2:3].isdigit() for n in core)
    # the pipeline's file alone, without what it imports, doesn't matter
    assert _names(_copy(tmp_path / "half", "corvane/llm", "tests/llm")) == (core, sql)


def test_oracles_are_for_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
