"""Star joins, joins, rollups, query log, ordering under skew, streaming, plans."""

import json
import os
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from cubespark import Attr, Cube, CubeError, Dim, DimStorage, Fact, FactStorage, Measure, Model, Query, Ref, UpdatePeriod
from cubespark.operators import querylog as QL
from cubespark.operators import rollup as RU
from cubespark.operators import star
from cubespark.operators.joins import outer_join, unique_join
from cubespark.operators.ordering import number_within, previous_within
from cubespark.plans import partitions as P
from cubespark.session import shared_dir
from cubespark.sources.database import read_db
from cubespark.streaming.rollup import stream_manifest, stream_rollup
from cubespark.streaming.stats import changed_logs, ingest_stats, rolled_logs

U = UpdatePeriod


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ----------------------------------------------------------------------------- star


@pytest.fixture(scope="module")
def sales_star(spark):
    fact = spark.createDataFrame(
        [
            # Four sales.
            (1001, 234, 119, 223, 3000.58, 56),
            (1002, 235, 120, 224, 3456.26, 62),
            (1003, 236, 121, 225, 6745.23, 97),
            (1004, 237, 122, 226, 8753.49, 106),
        ],
        "time_key int, item_key int, branch_key int, location_key int, dollars_sold double, units_sold int",
    )
    times = spark.sql("select 1001 + id as t_key, date_add(date'1900-01-01', id) as day, id + 1 as dow from (select cast(id as int) id from range(4))")
    items = spark.sql("select 234 + id as i_key, concat('item', id + 1) as item_name from range(4)")
    return fact, times, items


def test_star_reduction_and_eager_aggregation(spark, sales_star):
    fact, times, items = sales_star
    kept = star.reduce_fact(
        fact, [(times, "time_key", "t_key", "dow between 1 and 3"), (items, "item_key", "i_key", "item_name != 'item1'")]
    )
    assert as_rows(kept.select("time_key")) == [(1002,), (1003,)]
    got = star.eager_agg(
        kept,
        [(times, [("time_key", "t_key")]), (items, [("item_key", "i_key")])],
        ["time_key", "dow", "item_name"],
        [("sum", "dollars_sold", "dollars")],
        ["time_key"],
    )
    assert as_rows(got) == [(1002, 2, "item2", 3456.26), (1003, 3, "item3", 6745.23)]


def test_average_is_not_an_average_of_averages(spark):
    fact = spark.createDataFrame([(1, 1, 10), (1, 1, 20), (2, 1, 60)], "k int, d int, v int")
    dim = spark.createDataFrame([(1, "a"), (2, "a")], "pk int, name string")
    got = star.eager_agg(
        fact, [(dim, [("k", "pk")])], ["name"], [("avg", "v", "mean"), ("count", "v", "n"), ("count", "*", "all")]
    )
    assert as_rows(got) == [("a", 30.0, 3, 3)]
    with pytest.raises(CubeError):
        star.eager_agg(fact, [(dim, [("k", "pk")])], ["name"], [("stddev", "v", "x")])


def hot_tables(spark):
    """A third of the fact rows share one key; some keys are on one side only."""
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.34 else rng.choice([None, *range(2, 60)]), i % 7, float(i)) for i in range(3000)]
    fact = spark.createDataFrame(rows, "k int, g int, v double")
    dim = spark.createDataFrame([(i, f"n{i % 5}") for i in range(1, 90, 2)], "pk int, name string")
    return fact, dim


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_joins_agree_with_and_without_early_aggregation(spark, how):
    fact, dim = hot_tables(spark)
    cube = Cube("c", (Measure("v", "double", "sum"), Measure("w", "double")), (Attr("k", "int", (Ref("d", "pk"),)), Attr("g", "int")))
    model = Model(
        (cube,),
        (Fact("f", "c", ("k", "g", "v", "w"), (FactStorage("s", lambda s: fact, (U.DAILY,), False),), aggregated=False, exprs={"w": "v"}),),
        (Dim("d", (Attr("pk", "int"), Attr("name")), (DimStorage("s", lambda s: dim),)),),
    )
    q = (
        Query.of(model, "c")
        .select("d.name", "v", "avg(w) as mean", "count(w) as n", "min(w) as lo")
        .time_range("t", "2024", "2025")
        .join("d", how)
    )
    plain = outer_join(fact, dim, F.col("k") == F.col("pk"), how, ["k"], skewed=True)
    want = as_rows(
        plain.groupBy("name").agg(F.sum("v"), F.avg("v"), F.count("v"), F.min("v"))
    )
    native = fact.join(dim, F.col("k") == F.col("pk"), how)
    assert want == as_rows(native.groupBy("name").agg(F.sum("v"), F.avg("v"), F.count("v"), F.min("v")))
    assert as_rows(q.conf(eager=True).to_df(spark)) == want
    assert as_rows(q.conf(eager=False).to_df(spark)) == want
    assert "count(distinct" not in q.to_df(spark).columns


def test_unique_join(spark):
    a = spark.createDataFrame([(1, "a1"), (2, "a2"), (None, "a0")], "k int, a string")
    b = spark.createDataFrame([(2, "b2"), (3, "b3")], "k int, b string")
    c = spark.createDataFrame([(3, "c3"), (1, "c1")], "k int, c string")
    got = as_rows(unique_join([a, b, c], "k").select("k", "a", "b", "c"))
    assert got == sorted(
        [(1, "a1", None, "c1"), (2, "a2", "b2", None), (3, None, "b3", "c3"), (None, "a0", None, None)], key=str
    )
    assert unique_join([a, b], "k", "inner").count() == 1


# -------------------------------------------------------------------------- rollups


def test_rollups_nest(spark, tmp_path):
    """Every period written gives what rows give, from one pass over them."""
    cube = Cube(
        "c",
        (Measure("s", "bigint", "sum"), Measure("hi", "bigint", "max"), Measure("lo", "bigint", "min")),
        (Attr("g", "int"),),
    )
    rows = spark.sql(
        "select timestamp_ntz'2024-01-29 00:00:00' + make_interval(0,0,0,0,cast(id * 7 % 900 as int),0,0) as t, "
        "cast(id % 3 as int) as g, id as v from range(2000)"
    )
    exprs = {"s": "v", "hi": "v", "lo": "v"}
    path = str(tmp_path / "facts")
    RU.build_rollups(rows, cube, [U.HOURLY, U.DAILY, U.WEEKLY, U.MONTHLY], ["g"], "t", path, exprs)
    written = RU.read_partitions(spark, path, RU.rollup_schema(cube, ["g"]))
    for period in (U.HOURLY, U.DAILY, U.WEEKLY, U.MONTHLY):
        direct = RU.rollup(rows, cube, period, ["g"], "t", exprs)
        mine = written.filter(F.col("update_period") == period.name)
        assert as_rows(mine.select(direct.columns)) == as_rows(direct), period
    check = RU.consistency(
        written.filter("update_period = 'DAILY'").groupBy("g").agg(F.sum("s").alias("s")),
        rows.groupBy("g").agg(F.sum("v").alias("s")),
        ["g"], ["s"],
    )
    assert [(r["rows"], r["s_difference"]) for r in check.collect()] == [(2, 0)] * 3


def test_partitions_are_replaced_when_written_again(spark, tmp_path):
    path = str(tmp_path / "t")
    part = lambda dt, v: spark.sql(f"select {v} as v, 'DAILY' as update_period, '{dt}' as dt")
    RU.write_partitions(part("2024-01-01", 1), path)
    RU.write_partitions(part("2024-01-02", 2), path)
    RU.write_partitions(part("2024-01-02", 3), path)
    assert as_rows(spark.read.parquet(path).select("v")) == [(1,), (3,)]


def test_partitions_on_two_storages_count_once(spark):
    """A day on both storages is read from one of them; more partitions than fit a list are joined."""
    from cubespark.plans import resolve as R
    from cubespark.plans.partitions import manifest_of_span

    cube = Cube("c", (Measure("v", "bigint", "sum"),), (Attr("g", "int"),))

    def days(lo, hi):
        return lambda s: s.sql(
            f"select cast(id % 2 as int) as g, 1L as v, 'DAILY' as update_period, "
            f"date_format(date_add(date'2024-01-01', cast(id as int)), 'yyyy-MM-dd') as dt from range({lo}, {hi})"
        )

    def manifest(s):
        spans = {"a": (1, 20), "b": (15, 31)}
        rows = None
        for storage, (lo, hi) in spans.items():
            span = s.sql(f"select timestamp_ntz'2024-01-{lo:02}' as first, timestamp_ntz'2024-01-{hi:02}' as last")
            m = manifest_of_span(span, "f", storage, U.DAILY)
            rows = m if rows is None else rows.unionByName(m)
        return rows

    fact = Fact("f", "c", ("g", "v"), (FactStorage("a", days(0, 20), (U.DAILY,)), FactStorage("b", days(14, 31), (U.DAILY,))))
    q = Query.of(Model((cube,), (fact,), (), manifest), "c").select("v").time_range("t", "2024-01-01", "2024-02-01")
    assert as_rows(q.to_df(spark)) == [(31,)]
    assert q.resolve(spark).complete and len(q.resolve(spark).parts) == 31
    assert as_rows(q.select("case when g = 0 then 'x' else 'y' end as band").group_by("band").to_df(spark)) == [
        (15, "y"), (16, "x"),
    ]


# ------------------------------------------------------------------- skewed ordering


def test_numbering_and_lag_of_a_hot_key(spark):
    rng = random.Random(9)
    rows = [
        ("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.randrange(10**6), i, rng.choice("xyz") if i % 11 else None)
        for i in range(2000)
    ]
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint, s string")
    bucket = F.floor(F.col("t") / 50_000)
    placed = number_within(df, ["k"], bucket, [F.col("t"), F.col("id")], "place")
    con = duckdb.connect()
    con.register("df", df.toPandas().astype({"t": "int64"}))
    want = con.sql("select k, t, id, s, row_number() over (partition by k order by t, id) from df").fetchall()
    assert as_rows(placed.select("k", "t", "id", "s", "place")) == sorted(want, key=str)
    prev = previous_within(df, "k", bucket, ["t", "id"], "s", "before")
    want = con.sql("select k, t, id, s, lag(s) over (partition by k order by t, id) from df").fetchall()
    assert as_rows(prev.select("k", "t", "id", "s", "before")) == sorted(want, key=str)


# ------------------------------------------------------------------------ query log


def test_transitions(spark):
    log = spark.createDataFrame(
        [("q", s, i) for i, s in enumerate(["NEW", "QUEUED", "LAUNCHED", "RUNNING", "EXECUTED", "SUCCESSFUL", "CLOSED"])]
        + [("r", s, i) for i, s in enumerate(["NEW", "LAUNCHED", "RUNNING", "RUNNING", "SUCCESSFUL"])],
        "handle string, status string, ts int",
    )
    bad = QL.illegal_transitions(log, order=["ts"], bucket=F.floor(F.col("ts") / 2))
    assert as_rows(bad.select("handle", "from_status", "status")) == [
        ("r", "NEW", "LAUNCHED"), ("r", "RUNNING", "SUCCESSFUL"),
    ]


def test_search_and_retention(spark):
    log = spark.sql(
        "select id as handle, 'FAILED' as status, concat('u', id % 2, '@x') as user, concat('Name', id) as name, "
        "timestamp_ntz'2024-01-01' + make_interval(0,0,0,cast(id as int),0,0,0) as submitted from range(10)"
    )
    found = QL.search(log, "FAILED", "u1@other", "name", "2024-01-03", "2024-01-09")
    assert as_rows(found.select("handle")) == [(3,), (5,), (7,)]
    with pytest.raises(ValueError):
        QL.search(log, frm="2024-01-09", to="2024-01-03")
    kept, moved = QL.retain(log, 3, end="submitted")
    assert as_rows(kept.select("handle")) == [(7,), (8,), (9,)] and moved.count() == 7


def test_task_progress(spark):
    tasks = [
        {"taskId": "s1", "type": "MAPRED", "externalHandle": "job1", "taskState": "FINISHED_STATE"},
        {"taskId": "s2", "type": "MAPRED", "externalHandle": "job2", "taskState": "FAILED_STATE"},
        {"taskId": "s3", "type": "MOVE", "externalHandle": None, "taskState": "RUNNING_STATE"},
        {"taskId": "s4", "type": "MOVE", "externalHandle": None, "taskState": "failed_state"},
    ]
    df = spark.createDataFrame([(json.dumps(tasks),), ("[]",), (None,)], "tasks string")
    got = [(r["progress"], r["failed_tasks"]) for r in QL.task_progress(df).collect()]
    assert got[0][0] == 0.25
    assert [(t["taskId"], t["type"], t["externalHandle"]) for t in got[0][1]] == [("s2", "MAPRED", "job2"), ("s4", "MOVE", None)]
    assert got[1:] == [(0.0, []), (0.0, [])]


def test_stream_of_rolled_logs(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()

    def log(name, *handles):
        (logs / name).write_text("".join(json.dumps({"handle": h, "status": {"status": "OPEN"}}) + "\n" for h in handles))

    log("test.log.2014-08-05-11-28", "a", "b")
    log("test.log", "live")
    log(".test.log.2014-08-05-11-28.swp", "hidden")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def handles():
        return as_rows(QL.stats_table(spark, out).select("dt", "handle"))

    ingest_stats(spark, str(logs), out, checkpoint)
    assert handles() == [("2014-08-05-11-28", "a"), ("2014-08-05-11-28", "b")]
    log("test.log.2014-08-05-11-29", "c")
    ingest_stats(spark, str(logs), out, checkpoint)
    assert handles()[-1] == ("2014-08-05-11-29", "c") and len(handles()) == 3
    counters = QL.status_counters(
        rolled_logs(spark, str(logs)).select(F.col("status")["status"].alias("status"))
    )
    run = counters.writeStream.outputMode("complete").format("memory").queryName("counters").start()
    run.processAllAvailable()
    run.stop()
    assert tuple(spark.table("counters").first()) == (0, 0, 0, 0, 0)
    # seen again, by a fresh stream: its own partition is replaced
    log("test.log.2014-08-05-11-28", "d")
    ingest_stats(spark, str(logs), out, str(tmp_path / "cp2"))
    assert handles() == [("2014-08-05-11-28", "d"), ("2014-08-05-11-29", "c")]


# ---------------------------------------------------------------------------- other


def test_database_reads_are_split_by_the_bounds_of_the_table():
    calls = []

    class Reader:
        def jdbc(self, url, table, **kw):
            calls.append((table, kw))
            return self

        def first(self):
            return (5, 105)

    class Session:
        read = Reader()

    read_db(Session(), "jdbc:x", "dim", "id", 8)
    assert calls[0][0] == "(select min(id) lo, max(id) hi from dim) edges"
    assert calls[1][0] == "dim"
    assert {k: calls[1][1][k] for k in ("column", "lowerBound", "upperBound", "numPartitions")} == {
        "column": "id", "lowerBound": 5, "upperBound": 106, "numPartitions": 8,
    }


def test_shared_folder_comes_from_the_session():
    class Session:
        def __init__(self, folder, master):
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}
            self.sparkContext = type("C", (), {"master": master, "applicationId": "app"})

    assert shared_dir(Session("hdfs://x/shared/", "yarn")) == "hdfs://x/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session(None, "yarn"))


def test_a_range_needs_a_timed_dimension(spark):
    cube = Cube("c", (Measure("v", "bigint", "sum"),), (Attr("t", "timestamp_ntz"), Attr("u", "timestamp_ntz")), timed=("t", "u"))

    def rows(s):
        return s.sql(
            "select * from values (timestamp_ntz'2024-01-01', timestamp_ntz'2024-02-01', 1L), "
            "(timestamp_ntz'2024-01-02', timestamp_ntz'2024-02-05', 2L), "
            "(timestamp_ntz'2024-03-01', timestamp_ntz'2024-02-01', 4L) as x(t, u, v)"
        )

    fact = Fact("f", "c", ("t", "u", "v"), (FactStorage("a", rows, (U.DAILY,), partitioned=False),), aggregated=False, time_column="t")
    q = Query.of(Model((cube,), (fact,), (), None), "c").select("v")
    assert as_rows(q.time_range("t", "2024-01", "2024-02").to_df(spark)) == [(3,)]
    both = q.time_range("T", "2024-01", "2024-02").time_range("u", "2024-02-01", "2024-02-02")
    assert as_rows(both.to_df(spark)) == [(1,)]
    with pytest.raises(CubeError):
        q.time_range("no_such_column", "2024-01", "2024-02")
    with pytest.raises(CubeError):
        q.time_range("t", "2024-01", "2024-02").conf(valid_update_periods={("nothing", "a"): ["DAILY"]}).to_df(spark)


def test_old_logs_and_equal_names_of_two_hosts(spark, tmp_path):
    row = '{"handle": "%s", "status": {"status": "S"}}\n'
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    for host in ("h1", "h2"):
        (logs / host).mkdir(parents=True)
    (logs / "h1" / "q.log.2024-01-01-00").write_text(row % "a")
    os.utime(logs / "h1" / "q.log.2024-01-01-00", (10**9, 10**9))
    (logs / "h1" / "q.log.2024-01-02-00").write_text(row % "b")
    ingest_stats(spark, str(logs), out, str(tmp_path / "cp"))
    (logs / "h2" / "q.log.2024-01-01-00").write_text(row % "c")
    os.utime(logs / "h2" / "q.log.2024-01-01-00", (10**9, 10**9))
    ingest_stats(spark, str(logs), out, str(tmp_path / "cp"))
    assert {r["handle"] for r in spark.read.json(out).collect()} == {"a", "b", "c"}


def test_unique_join_reads_each_input_once(spark, tmp_path):
    inputs = []
    for i in range(5):
        spark.range(i, i + 4).withColumn(f"v{i}", F.lit(i)).write.parquet(str(tmp_path / f"t{i}"))
        inputs.append(spark.read.parquet(str(tmp_path / f"t{i}")))
    df = unique_join(inputs, "id")
    assert df.count() == 8
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") <= 10
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 5


def test_measures_that_do_not_merge_are_refused(spark):
    cube = Cube("c", (Measure("v", "double", "stddev"),), (Attr("g"),))
    rows = spark.sql("select timestamp_ntz'2024-01-01' as t, 'a' as g, 1.0d as v")
    with pytest.raises(CubeError):
        RU.rollup(rows, cube, U.DAILY, ["g"], "t")


def test_counts_and_averages_of_parts(spark, tmp_path):
    """States of hours add up to those of days and months, with nulls and groups without values."""
    cube = Cube("c", (Measure("mean", "double", "avg"), Measure("seen", "bigint", "count")), (Attr("g", "int"),))
    rows = spark.sql(
        "select timestamp_ntz'2024-01-29 00:00:00' + make_interval(0,0,0,0,cast(id * 7 % 900 as int),0,0) as t, "
        "cast(id % 3 as int) as g, if(id % 5 = 0 or id % 3 = 2, null, cast(id as double)) as v from range(2000)"
    )
    exprs, path = {"mean": "v", "seen": "v"}, str(tmp_path / "facts")
    RU.build_rollups(rows, cube, [U.HOURLY, U.DAILY, U.MONTHLY], ["g"], "t", path, exprs)
    written = RU.read_partitions(spark, path, RU.rollup_schema(cube, ["g"]))
    for period in (U.HOURLY, U.DAILY, U.MONTHLY):
        direct = RU.rollup(rows, cube, period, ["g"], "t", exprs)
        mine = written.filter(F.col("update_period") == period.name)
        assert as_rows(mine.select(direct.columns)) == as_rows(direct), period
        plain = rows.groupBy(period.truncate(F.col("t")).alias("s"), "g").agg(F.avg("v").alias("m"), F.count("v").alias("n"))
        read = mine.select(P.period_start(F.lit(period.name), F.col("dt")).alias("s"), "g", RU.read_state(cube.measures[0], "mean").alias("m"), F.col("seen").alias("n"))
        assert as_rows(read) == as_rows(plain)


# -------------------------------------------------------------------- streamed rollups

STREAM_CUBE = Cube("c", (Measure("s", "bigint", "sum"), Measure("mean", "double", "avg"), Measure("n", "bigint", "count")), (Attr("g"),))
STREAM_EXPRS = {"s": "v", "mean": "v", "n": "v"}


def _slices(spark, tmp_path, slices, late="2 hours", periods=(U.HOURLY, U.DAILY)):
    """Rows (hour, minute, group, value) per slice through a stream that stops after each."""
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "facts", "cp"))
    schema = "t timestamp_ntz, g string, v bigint"
    start = datetime(2024, 1, 30)
    for rows in slices:
        df = spark.createDataFrame([(start + timedelta(hours=h, minutes=m), g, v) for h, m, g, v in rows], schema)
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        stream_rollup(stream, STREAM_CUBE, list(periods), ["g"], "t", late, path, checkpoint, STREAM_EXPRS).awaitTermination()
    return path, schema, start


def test_late_rows_within_the_watermark_count(spark, tmp_path):
    slices = [
        [(0, 5, "a", 1), (1, 0, "a", 2), (2, 30, "b", 3)],
        [(0, 50, "a", 4), (1, 59, "b", 5), (4, 0, "a", 6)],  # late, but within two hours of 2:30
        [(0, 1, "a", 100), (26, 0, "b", 7)],  # the first hour was closed at 4:00: left out
        [(25, 0, "a", 8), (30, 0, "a", 9)],
    ]
    path, schema, start = _slices(spark, tmp_path, slices)
    listed = stream_manifest(spark, path)
    assert {(r["period"], r["dt"]) for r in listed.collect()} == {
        ("HOURLY", "2024-01-30-00"), ("HOURLY", "2024-01-30-01"), ("HOURLY", "2024-01-30-02"), ("HOURLY", "2024-01-30-04"),
        ("HOURLY", "2024-01-31-01"), ("HOURLY", "2024-01-31-02"), ("DAILY", "2024-01-30"),
    }
    counted = [r for rows in slices for r in rows if r[3] != 100]
    df = spark.createDataFrame([(start + timedelta(hours=h, minutes=m), g, v) for h, m, g, v in counted], schema)
    written = RU.read_partitions(spark, path, RU.rollup_schema(STREAM_CUBE, ["g"]))
    for period, end in ((U.HOURLY, start + timedelta(hours=28)), (U.DAILY, start + timedelta(days=1))):
        direct = RU.rollup(df.filter(F.col("t") < F.lit(end).cast("timestamp_ntz")), STREAM_CUBE, period, ["g"], "t", STREAM_EXPRS)
        mine = written.filter(F.col("update_period") == period.name)
        assert as_rows(mine.select(direct.columns)) == as_rows(direct), period


def test_a_stream_that_fails_goes_on_from_its_checkpoint(spark, tmp_path, monkeypatch):
    """The batch that failed between its rows and its list is run again and replaces what it wrote."""
    from cubespark.streaming import rollup as SR

    slices = [[(h, 0, "a", h) for h in range(4)], [(h, 30, "b", h) for h in range(3, 60)]]
    _slices(spark, tmp_path, slices[:1])
    real, calls = SR.write_partitions, []

    def failing(df, path, *more):
        real(df, path, *more)
        calls.append(path)
        if len(calls) == 2:  # the days of the second slice
            raise OSError("lost")

    monkeypatch.setattr(SR, "write_partitions", failing)
    with pytest.raises(Exception, match="lost"):
        _slices(spark, tmp_path, slices[1:])
    monkeypatch.setattr(SR, "write_partitions", real)
    path, schema, start = _slices(spark, tmp_path, [[(60, 0, "a", 1)]])
    every = [r for rows in slices for r in rows] + [(60, 0, "a", 1)]
    df = spark.createDataFrame([(start + timedelta(hours=h, minutes=m), g, v) for h, m, g, v in every], schema)
    written = RU.read_partitions(spark, path, RU.rollup_schema(STREAM_CUBE, ["g"]))
    listed = stream_manifest(spark, path)
    assert listed.count() == listed.select("period", "dt").distinct().count()
    for period, end in ((U.HOURLY, start + timedelta(hours=58)), (U.DAILY, start + timedelta(days=2))):
        direct = RU.rollup(df.filter(F.col("t") < F.lit(end).cast("timestamp_ntz")), STREAM_CUBE, period, ["g"], "t", STREAM_EXPRS)
        mine = written.filter(F.col("update_period") == period.name)
        assert as_rows(mine.select(direct.columns)) == as_rows(direct), period


def test_queries_read_what_a_stream_has_closed(spark, tmp_path):
    """Days and hours of the stream's manifest cover a range, and what is open is told as missing."""
    path, _, _ = _slices(spark, tmp_path, [[(h, 0, "ab"[h % 2], h) for h in range(60)]])
    schema = RU.rollup_schema(STREAM_CUBE, ["g"])
    storage = FactStorage("stream", lambda s: RU.read_partitions(s, path, schema), (U.HOURLY, U.DAILY), base=path, schema=schema)
    cube = Cube("c", STREAM_CUBE.measures, (Attr("g"), Attr("t", "timestamp_ntz")), timed=("t",))
    model = Model((cube,), (Fact("facts", "c", ("g", "s", "mean", "n"), (storage,)),), (), lambda s: stream_manifest(s, path))
    q = Query.of(model, "c").time_range("t", "2024-01-30", "2024-02-01-09").select("g", "s", "mean", "n")
    answer = q.answer(spark)
    assert answer.complete and as_rows(answer.df) == [("a", 812, 28.0, 29), ("b", 784, 28.0, 28)]
    assert {r["period"] for r in q.resolve(spark).parts} == {"DAILY", "HOURLY"}
    part = q.time_range("t", "2024-01-30", "2024-02-01-12").answer(spark)
    assert not part.complete and [r["dt"] for r in part.missing.collect()] == ["2024-02-01-09", "2024-02-01-10", "2024-02-01-11"]


def test_weeks_are_no_base_for_months(spark, tmp_path):
    rows = spark.readStream.schema("t timestamp_ntz, g string, v bigint").parquet(str(tmp_path))
    for periods in ([U.WEEKLY, U.MONTHLY], [U.MONTHLY]):
        with pytest.raises(CubeError):
            stream_rollup(rows, STREAM_CUBE, periods, ["g"], "t", "1 hour", str(tmp_path / "o"), str(tmp_path / "c"), STREAM_EXPRS)


def test_rewritten_logs_replace_their_rows(spark, tmp_path):
    logs, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "cp")
    logs.mkdir()
    row = '{"handle": "%s", "status": {"status": "S"}}\n'

    def log(name, *handles):
        (logs / name).write_text("".join(row % h for h in handles))

    def handles():
        ingest_stats(spark, str(logs), out, checkpoint)
        return sorted(r["handle"] for r in spark.read.json(out).collect())

    log("q.log.2024-01-01-00", "a", "b")
    log("q.log.2024-01-01-01")
    assert handles() == ["a", "b"]
    log("q.log.2024-01-01-00", "a", "c", "d")
    log("q 1.log.2024-01-01-02", "e")
    assert handles() == ["a", "c", "d", "e"]
    log("q.log.2024-01-01-01", "late")  # was empty when it was taken
    assert handles() == ["a", "c", "d", "e", "late"]
    log("q.log.2024-01-01-00")  # empty now
    log("q 1.log.2024-01-01-02", "f")
    assert handles() == ["f", "late"]
    assert handles() == ["f", "late"]
    assert changed_logs(spark, str(logs), checkpoint).count() == 0
