import pytest

from countylens.operators import lookup


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([(1001, "A"), (1001, "B"), (1003, None), (None, "N")],
                                 "fips long, area_name string")


def test_one_row_per_code(dim):
    rows = lookup.one_row_per_code(dim).collect()
    assert sorted((r.fips, r.area_name) for r in rows) == [(1001, "B"), (1003, None)]


def test_codes_outside_the_code_space_end_the_job(spark):
    wide = spark.createDataFrame([(100000, "A")], "fips long, area_name string")
    with pytest.raises(Exception, match="is not an area code"):
        lookup.one_row_per_code(wide).collect()


def test_area_join_broadcasts_and_keeps_facts(spark, dim, plan):
    facts = spark.createDataFrame([(1001, 1), (1001, 2), (7, 3), (None, 4)], "fips long, v int")
    joined = lookup.area_join(facts, dim, "left")
    assert "BroadcastHashJoin" in plan(joined)
    got = {(r.fips, r.v, r.area_name) for r in joined.collect()}
    assert got == {(1001, 1, "B"), (1001, 2, "B"), (7, 3, None), (None, 4, None)}


def test_map_lookup_keeps_every_area_once(spark, dim):
    ids = spark.createDataFrame([(1001,), (1002,), (1003,)], "fips long")
    got = lookup.map_lookup(ids, dim, "area_name").collect()
    assert sorted((r.fips, r.has_data) for r in got) == [(1001, True), (1002, False), (1003, False)]
