"""Queries over the sample cube, with results worked out by hand."""

import pytest
from sample_cube import CUBE, build

from cubespark import CubeError, Query

HOUR = ("2014-06-24-23", "2014-06-25-00")
DAY = ("2014-06-25-00", "2014-06-26-00")
BOTH = ("2014-06-24-23", "2014-06-26-01")
RAW = ("2014-06-25-20", "2014-06-26-02")


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    return build(spark, tmp_path_factory.mktemp("sample"))


@pytest.fixture(scope="module")
def cube(model):
    return lambda span, *items: Query.of(model, "sample_cube").select(*items).time_range("dt", *span)


def rows(q, spark):
    return sorted((tuple(r) for r in q.to_df(spark).collect()), key=lambda r: [(v is None, v) for v in r])


@pytest.mark.parametrize("span,total", [(HOUR, 3600), (DAY, 86400), (BOTH, 93600)])
def test_sum_over_partitions(spark, cube, span, total):
    q = cube(span, "measure2")
    assert q.resolve(spark).fact.name == "fact1"
    assert rows(q, spark) == [(total,)]


def test_cover_is_hour_day_hour(spark, cube):
    parts = cube(BOTH, "measure2").resolve(spark).parts
    assert sorted((p["period"], p["dt"]) for p in parts) == [
        ("DAILY", "2014-06-25"), ("HOURLY", "2014-06-24-23"), ("HOURLY", "2014-06-26-00"),
    ]


def test_attribute_is_grouped(spark, cube):
    assert rows(cube(HOUR, "dim1", "measure2"), spark) == [(20 + i, 100 * i) for i in range(1, 9)]


def test_second_fact_has_dim3(spark, cube):
    q = cube(HOUR, "dim3", "measure3")
    assert q.resolve(spark).fact.name == "fact2"
    assert rows(q, spark) == [(i, 100.0 * i) for i in range(1, 9)]


@pytest.mark.parametrize("span", [HOUR, DAY, BOTH])
def test_dimension_is_joined(spark, cube, span):
    names = ["first", "second", "third", "fourth", "fifth", "six", "seven"]
    want = sorted((n, 100.0 * (i + 1)) for i, n in enumerate(names))
    assert rows(cube(span, "sample_dim.name", "measure4"), spark) == want
    got = rows(cube(span, "sample_dim.name", "measure4").where("sample_dim.name != 'first'"), spark)
    assert got == [r for r in want if r[0] != "first"]


def test_order_and_limit(spark, cube):
    q = cube(HOUR, "sample_dim.name", "measure2").order_by("sample_dim.name desc").limit(2)
    assert [tuple(r) for r in q.to_df(spark).collect()] == [("third", 300), ("six", 600)]


def test_other_aggregates_need_rows(spark, cube):
    q = cube(RAW, "dim1", "avg(measure2)")
    assert q.resolve(spark).fact.name == "rawfact"
    assert rows(q, spark) == [(20 + i, 100.0 * i) for i in range(1, 9)]
    q = cube(RAW, "dim3", "min(measure3)")
    assert rows(q, spark) == [(i, 100.0 * i) for i in range(1, 9)]


def test_default_aggregate_written_out_stays_rolled_up(spark, cube):
    q = cube(BOTH, "dim1", "sum(measure2) as total")
    assert q.resolve(spark).fact.name == "fact1"
    assert rows(q, spark) == [(20 + i, 2600 * i) for i in range(1, 9)]


def test_measure_without_aggregate_is_refused(spark, cube):
    with pytest.raises(CubeError, match="measure1"):
        cube(RAW, "dim1", "dim2", "measure1", "measure2").to_df(spark)
    q = cube(RAW, "dim1", "dim2", "sum(measure1) as m1", "measure2")
    assert rows(q, spark) == [(20 + i, 10 + i, 600 * i, 600 * i) for i in range(1, 9)]


def test_rows_without_aggregation(spark, cube):
    q = cube(RAW, "dim1", "measure1", "measure2").conf(aggregate_default=False)
    assert len(rows(q, spark)) == 48


def test_expression_over_measures(spark, cube):
    got = rows(cube(BOTH, "dim1", "measure5"), spark)
    assert got == [(20 + i, 200.0 * i) for i in range(1, 9)]


@pytest.mark.parametrize(
    "how,n", [("inner", 7), ("left outer", 8), ("right outer", 8), ("full outer", 9)]
)
def test_explicit_joins(spark, cube, how, n):
    q = cube(BOTH, "sample_dim.name", "measure4").join("sample_dim", how)
    assert len(rows(q, spark)) == n
    assert rows(q.conf(eager=False), spark) == rows(q, spark)


def test_partial_data(spark, cube):
    late = ("2014-06-25-23", "2014-06-26-05")
    q = cube(late, "dim1", "sum(measure1) as m1")
    with pytest.raises(CubeError, match="all partitions"):
        q.conf(fail_if_partial=True).to_df(spark)
    assert rows(q, spark) == [(20 + i, 300 * i) for i in range(1, 9)]
    missing = [r["dt"] for r in q.missing_partitions(spark).orderBy("dt").collect()]
    assert missing == ["2014-06-26-02", "2014-06-26-03", "2014-06-26-04"]


def test_fact_options(spark, cube):
    q = cube(BOTH, "dim1", "measure2")
    assert q.conf(valid_facts=("fact2",)).resolve(spark).fact.name == "fact2"
    with pytest.raises(CubeError):
        q.conf(valid_facts=("nothing",)).resolve(spark)
    with pytest.raises(CubeError):
        q.conf(valid_storages=("elsewhere",)).resolve(spark)
    assert q.conf(valid_storage_tables=("local_fact2",)).resolve(spark).fact.name == "fact2"
    hours = q.conf(max_interval="hourly").resolve(spark)
    assert {p["period"] for p in hours.parts} == {"HOURLY"} and not hours.complete


def test_validity(spark, cube):
    early = ("2013-12-01-00", "2014-01-01-00")
    with pytest.raises(CubeError, match="measure3"):
        cube(early, "dim1", "measure3").resolve(spark)


def test_derived_cube(spark, model):
    derived = CUBE.derive("small", ["measure2"], ["dim1"])
    q = Query.of(model, derived).time_range("dt", *HOUR)
    assert rows(q.select("dim1", "measure2"), spark) == [(20 + i, 100 * i) for i in range(1, 9)]
    with pytest.raises(CubeError):
        rows(q.select("small.measure3"), spark)


def test_single_table_and_auto_join_off(spark, cube):
    q = cube(HOUR, "sample_dim.name", "measure4")
    with pytest.raises(CubeError):
        q.conf(multi_table=False).to_df(spark)
    with pytest.raises(CubeError):
        q.conf(auto_join=False).to_df(spark)


def test_range_must_not_be_empty(model):
    with pytest.raises(CubeError):
        Query.of(model, "sample_cube").time_range("dt", "2014-06-26", "2014-06-25")


def test_cube_needs_a_range(spark, model):
    with pytest.raises(CubeError):
        Query.of(model, "sample_cube").select("measure2").to_df(spark)


# ------------------------------------------------------------------ dimension queries


def dim(model, *items):
    return Query.of(model, "sample_dim").select(*items)


def test_dimension_select(spark, model):
    assert len(rows(dim(model, "id", "name"), spark)) == 8
    assert len(rows(dim(model, "id", "name").where("name != 'first'"), spark)) == 7
    q = dim(model, "id", "name").order_by("name").limit(2)
    assert [tuple(r) for r in q.to_df(spark).collect()] == [(None, "eight"), (5, "fifth")]


def test_dimension_counts(spark, model):
    assert rows(dim(model, "count(id)"), spark) == [(7,)]
    assert rows(dim(model, "count(distinct id)"), spark) == [(7,)]
    assert rows(dim(model, "count(id)").group_by("name"), spark) == [(0,)] + [(1,)] * 7
    assert rows(dim(model, "count(id)").where('name != "first"'), spark) == [(6,)]


@pytest.mark.parametrize("how,n", [(None, 7), ("inner", 7), ("left", 8), ("right", 9), ("full", 10)])
def test_dimension_chain(spark, model, how, n):
    q = dim(model, "sample_dim.name", "sample_dim2.name")
    q = q if how is None else q.join("sample_dim2", how)
    df = q.to_df(spark)
    assert df.columns == ["sample_dim_name", "sample_dim2_name"]
    assert df.count() == n


def test_dimension_chain_filtered(spark, model):
    q = dim(model, "sample_dim.name", "sample_dim2.name").where("sample_dim.name != 'first'")
    assert len(rows(q, spark)) == 6
