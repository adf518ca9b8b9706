import subprocess
import sys

import __spark_entry__ as entry

WITHOUT = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("flowlearn.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
q = e.queries()
assert "threshold_sweep" in q and not any(n.startswith("op") or n == "pipeline" for n in q), sorted(q)
assert set(e.oracle_sql()) <= set(q)
"""


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_the_optional_parts():
    subprocess.run([sys.executable, "-c", WITHOUT], check=True, timeout=120)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.tn + row.fp + row.fn + row.tp > 0
