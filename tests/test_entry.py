import os

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


def test_every_check_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_flagship(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(0 <= r.js_distance <= 1 and 0 <= r.novelty <= 1 for r in rows)
