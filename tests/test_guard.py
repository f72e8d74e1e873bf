"""The library and its queries stand without the training-data operators."""

from __future__ import annotations

import subprocess
import sys

BLOCK = """
import sys
class Refuse:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("threadloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Refuse())
import __spark_entry__ as e
names = set(e.queries())
assert "w1_canonical_operation" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= names
"""


def test_entry_without_llm():
    assert subprocess.run([sys.executable, "-c", BLOCK], timeout=120).returncode == 0


def test_entry_is_consistent():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
