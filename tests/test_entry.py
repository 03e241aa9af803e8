"""The driver contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_every_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert {"bm25_vectors", "p5_found"} <= set(__spark_entry__.queries())


def test_entry_works_without_the_training_data_operators(tmp_path):
    """A copy of the repository without that subpackage imports and lists the core queries."""
    code = "import __spark_entry__ as e; names = e.queries(); assert names and 'p1_found' not in names and 'p5_found' in names"
    for name in ("lexflume", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else _copied(ROOT / name, tmp_path / name)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def _copied(source: Path, target: Path) -> None:
    for path in source.rglob("*.py"):
        own = path.relative_to(source)
        if own.parts[0] != "llm":
            (target / own).parent.mkdir(parents=True, exist_ok=True)
            (target / own).write_bytes(path.read_bytes())


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "lexflume").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "lexflume.llm" not in path.read_text()
