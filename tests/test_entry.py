import subprocess
import sys
import textwrap


def test_queries_and_oracles_agree():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 100


def test_entry_works_without_the_llm_subpackage():
    code = """
        import sys
        sys.modules["quillion.llm"] = None
        import __spark_entry__ as e
        assert len(e.queries()) > 100 and not any(k.startswith("op") for k in e.queries())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
