"""Roles, dimension tables, fact reduction, two time columns, look-ahead, files of partitions."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubespark import Attr, Cube, CubeError, Dim, DimStorage, DimTable, Fact, FactStorage, Measure, Model, Query, Ref, UpdatePeriod
from cubespark.operators.query import PartialAnswer
from cubespark.plans import partitions as P
from cubespark.plans import resolve as R
from cubespark.plans.periods import ceil_instant, floor_instant, shift_instant
from cubespark.session import settings

U = UpdatePeriod


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows, schema):
    return lambda s: spark.createDataFrame(rows, schema)


def test_instants_as_spark_truncates_them(spark):
    draw = random.Random(1)
    at = [datetime(2023, 12, 25) + timedelta(seconds=draw.randrange(10**8)) for _ in range(60)]
    at += [datetime(2024, 2, 29), datetime(2024, 12, 31, 23, 59, 59), datetime(2024, 12, 30), datetime(2025, 1, 1)]
    df = spark.createDataFrame([(x,) for x in at], "t timestamp_ntz")
    for period in U:
        begin = period.truncate(F.col("t"))
        for row in df.select("t", begin.alias("b"), period.shift(begin).alias("e"), period.shift(begin, 3).alias("third")).collect():
            assert floor_instant(row["t"], period) == row["b"]
            assert ceil_instant(row["t"], period) == (row["b"] if row["b"] == row["t"] else row["e"])
            assert shift_instant(row["b"], period, 3) == row["third"]
    assert shift_instant(datetime(2024, 1, 31), U.MONTHLY) == datetime(2024, 2, 29)
    assert shift_instant(datetime(2024, 1, 31), U.MONTHLY, -2) == datetime(2023, 11, 30)


def test_settings_come_back(spark):
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    with pytest.raises(KeyError), settings(spark, spark_sql_files_maxPartitionBytes="1m", spark_sql_some_name="x"):
        assert spark.conf.get(name) == "1m"
        raise KeyError
    assert spark.conf.get(name) == before and spark.conf.get("spark.sql.some.name", None) is None


# ------------------------------------------------------------------------- star models


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """Trips from a town to a town; towns lie in lands."""
    base = tmp_path_factory.mktemp("star")

    def frame(spark, rows, schema):  # files, so that Spark knows their size
        path = str(base / str(len(list(base.iterdir()))))
        spark.createDataFrame(rows, schema).write.parquet(path)
        return lambda s: s.read.parquet(path)

    cube = Cube(
        "trips",
        (Measure("n", "bigint", "sum"), Measure("length", "double", "avg")),
        (
            Attr("origin", "int", (Ref("town", "id", "start_town"),)),
            Attr("target", "int", (Ref("town", "id", "end_town"),)),
            Attr("t", "timestamp_ntz"),
        ),
        timed=("t",),
    )
    trips = [(i % 6, i * 5 % 7, datetime(2024, 1, 1) + timedelta(hours=i), 1, float(i)) for i in range(200)]
    fact = Fact(
        "trips",
        "trips",
        ("origin", "target", "t", "n", "length"),
        (FactStorage("s", frame(spark, trips, "origin int, target int, t timestamp_ntz, n bigint, length double"), (U.DAILY,), False),),
        aggregated=False,
        time_column="t",
    )
    towns = [(i, f"town{i}", i % 3) for i in range(7)]
    town = Dim("town", (Attr("id", "int"), Attr("name"), Attr("land", "int", (Ref("land", "code"),))), (DimStorage("s", frame(spark, towns, "id int, name string, land int")),))
    land = Dim("land", (Attr("code", "int"), Attr("title")), (DimStorage("s", frame(spark, [(i, f"land{i}") for i in range(3)], "code int, title string")),))
    return Model((cube,), (fact,), (town, land)), trips


def trips_of(model):
    return Query.of(model, "trips").time_range("t", "2024-01-01", "2024-02-01")


def test_one_dimension_in_two_roles(spark, star):
    model, trips = star
    got = trips_of(model).select("start_town.name as a", "end_town.name as b", "n").to_df(spark)
    want = {}
    for o, e, *_ in trips:
        want[f"town{o}", f"town{e}"] = want.get((f"town{o}", f"town{e}"), 0) + 1
    assert as_rows(got) == sorted(((*k, v) for k, v in want.items()), key=str)


def test_roles_behind_roles_and_joins_by_role(spark, star):
    model, trips = star
    q = trips_of(model).role("start_land", "land", via="start_town").role("end_land", "land", via="end_town")
    got = q.select("start_land.title as a", "end_land.title as b", "n").where("start_land.title <> end_land.title").to_df(spark)
    want = {}
    for o, e, *_ in trips:
        if o % 3 != e % 3:
            want[f"land{o % 3}", f"land{e % 3}"] = want.get((f"land{o % 3}", f"land{e % 3}"), 0) + 1
    assert as_rows(got) == sorted(((*k, v) for k, v in want.items()), key=str)
    left = trips_of(model).join("end_town", "left", on_filter="end_town.name = 'town2'").select("end_town.name as b", "n").to_df(spark)
    assert {r["b"] for r in left.collect()} == {None, "town2"} and left.agg(F.sum("n")).first()[0] == 200


def test_names_of_roles_are_checked(spark, star):
    model, _ = star
    with pytest.raises(CubeError):
        trips_of(model).role("x", "nothing")
    with pytest.raises(CubeError):
        trips_of(model).role("x", "land", via="nowhere").select("x.title", "n").to_df(spark)
    with pytest.raises(CubeError):  # both towns are one reference away
        trips_of(model).select("town.name", "n").to_df(spark)


def _plans(df):
    ran = df._jdf.queryExecution()
    return ran.optimizedPlan().toString().splitlines(), ran.executedPlan().toString().splitlines()


def test_facts_are_reduced_below_the_first_exchange(spark, star):
    model, _ = star
    q = trips_of(model).role("start_land", "land", via="start_town")
    q = q.select("start_land.title as a", "n", "length").where("start_land.title in ('land0', 'land1') and start_town.name <> 'town0'")
    logical, physical = _plans(q.to_df(spark))
    semi = [i for i, line in enumerate(physical) if "LeftSemi" in line]
    shuffles = [i for i, line in enumerate(physical) if "Exchange hashpartitioning" in line]
    aggregates = [i for i, line in enumerate(logical) if "Aggregate" in line]
    assert semi and all("Broadcast" in physical[i] for i in semi)
    assert min(semi) > max(i for i in shuffles if i < min(semi)) and any("LeftSemi" in line for line in logical[max(aggregates) :])
    plain = q.conf(reduce=False)
    assert not any("LeftSemi" in line for line in _plans(plain.to_df(spark))[0])
    assert as_rows(q.to_df(spark)) == as_rows(plain.to_df(spark)) == as_rows(q.conf(eager=False).to_df(spark))


def test_only_inner_joins_reduce(spark, star):
    model, _ = star
    q = trips_of(model).join("start_town", "left").select("start_town.name as a", "n").where("start_town.name is null or start_town.name <> 'town1'")
    assert not any("LeftSemi" in line for line in _plans(q.to_df(spark))[0])
    assert len(as_rows(q.to_df(spark))) == 5
    with settings(spark, spark_sql_autoBroadcastJoinThreshold="-1"):  # nothing is small enough
        q = trips_of(model).select("start_town.name as a", "n").where("start_town.name <> 'town1'")
        assert not any("LeftSemi" in line for line in _plans(q.to_df(spark))[0])
        assert any("LeftSemi" in line for line in _plans(q.conf(reduce=True).to_df(spark))[0])


# -------------------------------------------------------------------- dimension tables


def test_lightest_table_with_the_columns_and_a_dump(spark):
    rows = "id int, a string, b string, dt string"
    read = lambda tag, *dts: DimStorage("s", frame(spark, [(1, tag + d, "b", d) for d in dts], rows), U.MONTHLY)
    dim = Dim(
        "d",
        (Attr("id", "int"), Attr("a"), Attr("b")),
        tables=(
            DimTable("light", ("id", "a"), (read("light", "2024-03", "2024-05"),), 1),
            DimTable("heavy", ("id", "a", "b"), (read("heavy", "2024-01", "2024-04"),), 5),
        ),
    )
    conf = R.QueryConf(dim_as_of="range")

    def chosen(columns, to, conf=conf):
        table, _, dump = R.choose_dim(spark, dim, columns, conf, ("t", datetime(2023, 1, 1), to))
        return table.name, dump

    assert chosen({"id", "a"}, datetime(2024, 6, 1)) == ("light", "2024-05")
    assert chosen({"id", "a"}, datetime(2024, 5, 1)) == ("light", "2024-03")  # May begins where the range ends
    assert chosen({"id", "a"}, datetime(2024, 2, 15)) == ("heavy", "2024-01")  # no light dump is in force yet
    assert chosen({"id", "b"}, datetime(2024, 6, 1)) == ("heavy", "2024-04")
    assert chosen({"id"}, datetime(2024, 6, 1), replace(conf, valid_dim_tables=("s_heavy",))) == ("heavy", "2024-04")
    assert chosen({"id"}, datetime(2024, 6, 1), replace(conf, dim_as_of="2024-04")) == ("light", "2024-03")
    with pytest.raises(CubeError):
        chosen({"id"}, datetime(2023, 12, 1))
    with pytest.raises(CubeError):
        chosen({"id"}, datetime(2024, 6, 1), replace(conf, valid_storages=("x",)))
    got = R.read_dim(spark, dim, {"id", "a"}, R.QueryConf())
    assert [tuple(r) for r in got.select("id", "a").collect()] == [(1, "light2024-05")]


# ----------------------------------------------------------------- partitions and time


def _two_times(spark, tmp_path, others):
    """Rows by day and by month of another date, in folders."""
    path, schema = str(tmp_path / "facts"), "g string, n bigint, update_period string, dt string, made string"
    rows = [(f"g{d % 3}", 1, "DAILY", f"2024-05-{d:02d}", f"2024-{m:02d}") for d in range(1, 31) for m in range(1, 5) if (d + m) % 4]
    spark.createDataFrame(rows, schema).write.partitionBy("update_period", "dt", "made").parquet(path)
    kind = T.StructType.fromDDL(schema)
    storage = FactStorage("s", lambda s: s.read.schema(kind).parquet(path), (U.DAILY,), base=path, schema=kind, others=others)
    cube = Cube("c", (Measure("n", "bigint", "sum"),), (Attr("g"), Attr("made_on", "timestamp_ntz"), Attr("t", "timestamp_ntz")), timed=("t", "made_on"))
    listed = [("f", "s", "DAILY", f"2024-05-{d:02d}", f"{path}/update_period=DAILY/dt=2024-05-{d:02d}") for d in range(1, 31)]
    manifest = P.manifest_rows(spark.createDataFrame(listed, "table string, storage string, period string, dt string, location string"))
    return Model((cube,), (Fact("f", "c", ("g", "n"), (storage,)),), (), lambda s: manifest), rows


def test_two_ranges_prune_both_partition_columns(spark, tmp_path):
    model, rows = _two_times(spark, tmp_path, {"made_on": ("made", U.MONTHLY)})
    q = Query.of(model, "c").time_range("t", "2024-05-04", "2024-05-20").time_range("made_on", "2024-02", "2024-04").select("g", "n")
    df = q.to_df(spark)
    kept = [r for r in rows if "2024-05-04" <= r[3] < "2024-05-20" and "2024-02" <= r[4] < "2024-04"]
    assert as_rows(df) == sorted({g: sum(r[0] == g for r in kept) for g in ("g0", "g1", "g2")}.items())
    scan = R.scan_fact(spark, q._settled(spark)._resolve(spark, _names(q, spark)), q.span, q._settled(spark).options)
    used = P.partitions_used(scan, ["dt", "made"])
    assert {(r["dt"], r["made"]) for r in used.collect()} == {(r[3], r[4]) for r in kept}
    assert "PartitionFilters" in df._jdf.queryExecution().executedPlan().toString() and "made" in str(scan._jdf.queryExecution().executedPlan())
    # a range inside a month cannot be had from partitions, and the fact has no such column
    with pytest.raises(CubeError):
        q.time_range("made_on", "2024-02-10", "2024-04").to_df(spark)


def _names(q, spark):
    from cubespark.operators.query import _Names

    names = _Names()
    q._settled(spark)._analyse(names)
    return names


def test_look_ahead_by_the_calendar_and_per_fact(spark):
    def fact(name, weight, periods, months):
        rows = [("g", 1, datetime(2024, 1, 31), "MONTHLY", m) for m in months]
        schema = "g string, n bigint, t timestamp_ntz, update_period string, dt string"
        storage = FactStorage("s", frame(spark, rows, schema), periods)
        return Fact(name, "c", ("g", "n", "t"), (storage,), weight, aggregated=False, time_column="t")

    months = ["2024-01", "2024-02", "2024-03"]
    facts = (fact("short", 1, (U.MONTHLY,), months[:2]), fact("long", 2, (U.MONTHLY,), months))
    listed = [(f.name, "s", "MONTHLY", m) for f, ms in zip(facts, (months[:2], months)) for m in ms]
    manifest = P.manifest_rows(spark.createDataFrame(listed, "table string, storage string, period string, dt string"))
    cube = Cube("c", (Measure("n", "bigint", "sum"),), (Attr("g"), Attr("t", "timestamp_ntz")), timed=("t",))
    model = Model((cube,), facts, (), lambda s: manifest)
    q = Query.of(model, "c").time_range("t", "2024-01", "2024-02").select("g", "n").conf(process_time_col="pt")
    assert q.conf(lookahead=1).resolve(spark).fact.name == "short"
    two = q.conf(lookahead={U.MONTHLY: 2}).resolve(spark)
    assert two.fact.name == "long" and two.complete and two.until == datetime(2024, 4, 1)
    assert {r["dt"] for r in two.parts} == set(months)
    three = q.conf(lookahead=3)
    assert not three.resolve(spark).complete
    assert [r["dt"] for r in three.missing_partitions(spark).collect()] == ["2024-04"]
    with pytest.warns(PartialAnswer):
        three.to_df(spark)
    with pytest.raises(CubeError):
        three.conf(fail_if_partial=True).to_df(spark)


def test_files_belong_to_the_longest_location(spark, tmp_path):
    odd = tmp_path / "a b+c 50%"
    (odd / "k=0" / "x").mkdir(parents=True)
    (odd / "z").mkdir()
    for name, n in (("one.csv", 10), ("k=0/two.csv", 10), ("k=0/x/three.csv", 5), ("z/four.csv", 7)):
        (odd / name).write_text("\n".join(f"{i}" for i in range(n)))
    listed = [("2024-01-01", str(odd)), ("2024-01-02", f"file:{odd}/k=0/x"), ("2024-01-03", f"file://{odd}/z/four.csv")]
    rows = [("t", "s", "DAILY", dt, at, "csv") for dt, at in listed]
    manifest = P.manifest_rows(spark.createDataFrame(rows, "table string, storage string, period string, dt string, location string, format string"))
    schema = T.StructType.fromDDL("v int")
    got = P.scan_partitions(spark, manifest, schema).groupBy("dt").count()
    assert dict(got.collect()) == {"2024-01-01": 20, "2024-01-02": 5, "2024-01-03": 7}
    single = manifest.filter("dt = '2024-01-02'")
    assert P.scan_partitions(spark, single, schema).count() == 5
    stray = {"csv": lambda s, paths, kind: s.read.schema(kind).option("recursiveFileLookup", True).csv(str(odd))}
    with pytest.raises(Exception, match="no listed partition"):
        P.scan_partitions(spark, single, schema, stray).collect()
