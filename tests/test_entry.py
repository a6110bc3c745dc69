"""The driver contract with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.fixture
def copy(tmp_path):
    """The repository without its data and without the optional folders."""
    left_out = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm")
    return shutil.copytree(REPO, tmp_path / "repo", ignore=left_out)


def run(copy, *command):
    environment = os.environ | {"PYTHONPATH": str(copy), "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, *command], cwd=copy, env=environment, capture_output=True, text=True)


LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_optional_folders(copy, with_pipeline):
    if not with_pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    done = run(copy, "-c", LIST)
    assert done.returncode == 0, done.stderr
    names = done.stdout.split()
    assert "top_coupons" in names and "pipeline" not in names
    assert not any(name.startswith("op") and name[2:3].isdigit() for name in names)


def test_all_other_tests_are_collected_without_the_optional_folders(copy):
    done = run(copy, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider")
    assert done.returncode == 0, done.stdout + done.stderr


def test_other_missing_modules_are_errors(copy):
    (copy / "corpus_pipeline.py").write_text("import no_such_module\n")
    done = run(copy, "-c", LIST)
    assert done.returncode != 0 and "no_such_module" in done.stderr
