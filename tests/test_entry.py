"""The entry module with and without the training-data folders."""

import ast
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("seguelab/llm", "tests/llm"), ("seguelab/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_without_the_training_data_folders(tmp_path, gone):
    for name in ("seguelab", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path)
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True)
        if (tmp_path / name).is_file():
            (tmp_path / name).unlink()
    code = "import __spark_entry__ as e; print(sorted(e.queries()), '|', sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    names, with_sql = map(ast.literal_eval, out.split("|"))
    assert "transition_summary" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert set(with_sql) <= set(names)


def test_other_import_errors_are_errors(monkeypatch):
    import __spark_entry__ as entry

    def broken(name):
        raise ModuleNotFoundError("no module", name="pyarrow")

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_the_core_imports_nothing_of_the_training_data_folder():
    for file in (ROOT / "seguelab").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT / "seguelab").parts:
            assert not re.search(r"^\s*(?:from|import)\b.*\bllm\b", file.read_text(), re.M), file
