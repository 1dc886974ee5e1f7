"""The entry file with and without its optional part."""

import importlib.util
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in sys.argv[1:]:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Hidden())
import __spark_entry__
from floorledger.catalogue import QUERIES
print(set(__spark_entry__.queries()) == set(QUERIES))
"""


def imported_without(*names):
    command = [sys.executable, "-B", "-c", SCRIPT, *names]
    return subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("names", [("corpus_pipeline",), ("floorledger.llm",), ("corpus_pipeline", "floorledger.llm")])
def test_other_queries_stay_without_the_optional_part(names):
    done = imported_without(*names)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == ["True"]


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the optional part is not there")
def test_a_missing_library_is_not_taken_for_a_missing_part():
    done = imported_without("xxhash")
    assert done.returncode != 0
    assert "xxhash" in done.stderr
