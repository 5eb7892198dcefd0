"""The entry module without the optional corpus parts."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder: Path) -> list[str]:
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, check=True, capture_output=True, text=True).stdout.split()


def test_imports_without_the_corpus_parts(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "tillspark", tmp_path / "tillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    rest = names(tmp_path)
    assert len(rest) > 100 and not [n for n in rest if n.startswith("op") or n == "pipeline"]


def test_nothing_else_imports_the_corpus_parts():
    for path in (ROOT / "tillspark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:  # the folder itself
            text = path.read_text()
            assert not re.search(r"\bllm\b|\bcorpus_pipeline\b", text), path
