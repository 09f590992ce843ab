import os

import pytest
from common import DATA

from tidemark.llm import registry, storage


def tables(spark) -> set[str]:
    folder = storage.shared_folder(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_tables_on_the_way_are_removed(spark):
    before = tables(spark)

    def make():
        return storage.written(storage.settled(spark, "inner", lambda: storage.written(spark.range(9), "a").filter("id > 2")), "b").filter("id < 7")

    got = storage.settled(spark, "outer", make)
    assert sorted(r.id for r in got.collect()) == [3, 4, 5, 6]
    (left,) = tables(spark) - before
    assert left.startswith("outer-")
    storage.written(spark.range(2), "stays")
    assert len(tables(spark) - before) == 2


def test_a_failure_removes_them_too(spark):
    before = tables(spark)

    def make():
        storage.written(spark.range(3), "a")
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        storage.settled(spark, "outer", make)
    with pytest.raises(Exception, match="no such row"):
        storage.settled(spark, "outer", lambda: storage.written(spark.range(3), "b").selectExpr("raise_error('no such row')"))
    assert tables(spark) == before


@pytest.mark.parametrize(("name", "most"), [("op1_toxicity", 0), ("op4_quality", 0), ("op2_line_dedup", 1), ("op6_near_dedup", 1), ("fingerprint_classes", 1)])
def test_queries_leave_their_results_alone(spark, name, most):
    before = tables(spark)
    assert registry.QUERIES[name](spark, DATA).count()
    assert len(tables(spark) - before) <= most
