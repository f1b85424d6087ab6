import subprocess
import sys

WITHOUT = "import sys; sys.modules['ripplegraph.llm'] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(q) == set(s) and 'pipeline' not in q"


def test_entry_without_the_optional_queries():
    subprocess.run([sys.executable, "-c", WITHOUT], check=True)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
