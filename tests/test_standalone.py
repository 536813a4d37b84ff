"""The engine without its corpus subpackage: nothing else imports it, and the entry module loads."""

from __future__ import annotations

import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_corpus_subpackage():
    for path in (ROOT / "vellumine").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_entry_loads_without_it(tmp_path):
    for name in ("__spark_entry__.py", "vellumine"):
        source = ROOT / name
        if source.is_dir():
            for path in source.rglob("*.py"):
                if "llm" not in path.relative_to(ROOT).parts:
                    target = tmp_path / path.relative_to(ROOT)
                    target.parent.mkdir(parents=True, exist_ok=True)
                    target.write_text(path.read_text())
        else:
            (tmp_path / name).write_text(source.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q01_pricing_summary' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_sql_is_for_registered_queries():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
