"""Every registered query against its SQL on the smallest tables; the others must give rows."""

import pytest
from tools.check import compare, connect

from gridloom.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, duck, key):
    df = QUERIES[key](spark, FOLDER)
    if key in ORACLES:
        assert compare(df, duck, ORACLES[key]) is None
    else:
        assert df.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("hidden", [["gridloom.llm"], ["gridloom.llm", "corpus_pipeline"], ["corpus_pipeline"]])
def test_entry_without_the_training_data_operators(hidden):
    """The entry, with all other queries, stands without them."""
    import subprocess
    import sys
    from pathlib import Path

    code = (f"import sys; sys.modules.update(dict.fromkeys({hidden!r})); import __spark_entry__ as e; q = e.queries(); "
            "assert 'pipeline' not in q and len(q) > 160 and 'asof_nearest' in e.oracle_sql(), len(q)")
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)
