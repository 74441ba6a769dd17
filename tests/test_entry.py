"""The driver contract, with and without the optional subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.strip()


def test_queries_have_names_and_sql_belongs_to_queries():
    out = run("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q) > 100, set(s) <= set(q), all(map(callable, q.values())))")
    assert out == "True True True"


def test_without_the_subpackage():
    block = "import sys; sys.modules['durata.llm'] = None; sys.modules['corpus_pipeline'] = None; "
    out = run(block + "import __spark_entry__ as e; q = e.queries(); print(len(q) > 90, not any(k.startswith('op') for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))")
    assert out == "True True False True"


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["layout", "day", "s"] and df.count() == 9
