"""The entry works where the training-data subpackage, its pipeline or its tokenizers are missing."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _names(missing: str) -> list[str]:
    code = f"import sys; sys.modules.update(dict.fromkeys({missing!r}.split())); import __spark_entry__ as e; print(*sorted(e.queries())); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.mark.parametrize("missing", ["chorus.llm corpus_pipeline", "chorus.llm", "public_tokenizers"])
def test_entry_without_the_subpackage(missing):
    names = _names(missing)
    assert "q02_daily_report" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)


def test_other_missing_modules_are_errors():
    code = "import sys; sys.modules['chorus.plans.catalog'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, timeout=120).returncode
