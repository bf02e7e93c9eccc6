import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
WITHOUT = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] == 'corpus_pipeline' or name.startswith('lamella.llm'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert 'roi_type_pivot' in e.queries() and not any(k.startswith('op') for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_works_without_training_data_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
