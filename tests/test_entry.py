"""The driver contract without the corpus operators or something they need."""

import subprocess
import sys

import pytest

ROOT = __file__.rsplit("/tests/", 1)[0]
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError("hidden", name=name)
sys.meta_path.insert(0, Hidden())
import warnings; warnings.simplefilter("ignore")
import __spark_entry__ as E
print(len(E.queries()), len(E.oracle_sql()), any(k.startswith("op") and k[2].isdigit() for k in E.queries()))
"""


@pytest.mark.parametrize("name", ["sigeval.llm", "corpus_pipeline", "xxhash", "sentencepiece", "tokenizers", "public_tokenizers"])
def test_base_queries_survive(name):
    out = subprocess.run([sys.executable, "-c", HIDE.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, with_sql, corpus = out.stdout.split()
    from sigeval.plans.queries import QUERIES
    assert int(n) >= len(QUERIES) and int(with_sql) >= 60
    if name in ("sigeval.llm", "corpus_pipeline", "xxhash", "public_tokenizers"):
        assert int(n) == len(QUERIES) and corpus == "False"
