import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from careerloom.runtime import local_session

    s = local_session("8", memory="8g", app="tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


def rows(df, *cols):
    """Rows as a sorted list of plain tuples."""
    if cols:
        df = df.select(*cols)
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
