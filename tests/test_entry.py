"""The entry without the parts that may be missing."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROBE = """
import __spark_entry__ as entry
assert not entry.LLM_QUERIES and not entry.LLM_ORACLES
assert set(entry.queries()) == set(entry.oracle_sql()) and len(entry.queries()) == 43
"""


@pytest.mark.parametrize("gone", [["dealtide/llm", "tests/llm"], ["dealtide/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_entry_without_the_subpackage(tmp_path, gone):
    """A copy without these imports, has all other queries, and its tests can be collected."""
    shutil.copytree(
        ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json")
    )
    copy = tmp_path / "copy"
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    subprocess.run([sys.executable, "-c", PROBE], cwd=copy, check=True, timeout=120)
    collected = [sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"]
    subprocess.run(collected, cwd=copy, check=True, timeout=120, stdout=subprocess.DEVNULL)


def test_other_import_errors_are_not_hidden(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json"))
    if not (copy / "corpus_pipeline.py").exists():
        pytest.skip("there is no pipeline to break")
    with (copy / "corpus_pipeline.py").open("a") as out:
        out.write("\nimport a_module_that_is_nowhere\n")
    run = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__"], cwd=copy, timeout=120, capture_output=True, text=True
    )
    assert run.returncode and "a_module_that_is_nowhere" in run.stderr
