"""The entry works without the training-data operators, and without the packages that only they need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') and n[2].isdigit() for n in e.queries()))"


@pytest.mark.parametrize("missing", ["xxhash", "tallyrule.llm", "corpus_pipeline"])
def test_entry_without(missing):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
{COUNT}"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n, oracles, operators = map(int, out.stdout.split())
    assert n > 90 and oracles > 85 and operators == 0
    assert (f"{missing} is missing" in out.stderr) == (missing == "xxhash")
