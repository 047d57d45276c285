"""Jobs that write: streaming ingestion, replication, JDBC, headers; and histories without a customer."""

import glob
import gzip
import itertools
import os
import random
import shutil
import tempfile
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderloom.functions.constraints import CONSTRAINTS, checkable, columns_of
from orderloom.operators import incremental as I
from orderloom.operators import models as M
from orderloom.operators import quality as Q
from orderloom.operators import replication as P
from orderloom.operators import runlog as L
from orderloom.operators.watermarks import Watermarks
from orderloom.plans import changes, files, warehouse
from orderloom.sources import database, storage
from orderloom.sources import shipment_files as S
from orderloom.sources.buckets import BucketedTable
from orderloom.sources.storage import refresh_partitions
from orderloom.streaming import ingest


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def write(folder, name, lines):
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(lines) + "\n")


def now():
    return F.lit("2001-08-02 00:00:00").cast("timestamp_ntz")


def test_a_record_in_two_batches_is_stored_once(spark, folder):
    os.mkdir(f"{folder}/in")
    run = lambda: ingest.ingest_files(spark, f"file://{folder}/in", f"file://{folder}/out", f"file://{folder}/state", now(), most_files=1)
    write(f"{folder}/in", "a.csv", ["shipment_id,order_id,carrier", "s1,o1,ups", "s2,o2,dhl"])
    run()
    write(f"{folder}/in", "b.csv", ['order_id,"shipment_id",carrier,colour', "o1,s1,ups,red", "o3,s3,ups,blue"])
    run()
    run()
    got = sorted((r.shipment_id, r.order_id, r.carrier) for r in ingest.ingested(spark, f"file://{folder}/out").collect())
    assert got == [("s1", "o1", "ups"), ("s2", "o2", "dhl"), ("s3", "o3", "ups")]


def test_files_done_are_archived(spark, folder):
    for d in ("in", "archive"):
        os.mkdir(f"{folder}/{d}")
    for k in range(3):
        write(f"{folder}/in", f"{k}.csv", ["shipment_id,order_id", f"s{k},o{k}"])
    ingest.ingest_files(spark, f"file://{folder}/in", f"file://{folder}/out", f"file://{folder}/state", now(), most_files=1, archive=f"file://{folder}/archive")
    assert ingest.ingested(spark, f"file://{folder}/out").count() == 3
    assert glob.glob(f"{folder}/archive/**/*.csv", recursive=True)


def test_headers_may_be_quoted_hold_line_breaks_and_be_compressed(spark, folder):
    write(folder, "a.csv", ['a,"b, c","d', 'e"', "1,2,3"])
    with gzip.open(f"{folder}/b.csv.gz", "wt", encoding="utf-8-sig") as f:
        f.write("x,y\n" + "1,2\n" * 100_000)
    assert S.header_of(spark, f"file://{folder}/a.csv") == ["a", "b, c", "d\ne"]
    assert S.header_of(spark, f"file://{folder}/b.csv.gz") == ["x", "y"]
    write(folder, "c.csv", [""])
    with pytest.raises(ValueError):
        S.header_of(spark, f"file://{folder}/c.csv")


def ledger_of(spark, folder):
    log = spark.read.parquet(f"file://{folder}/state/ledger")
    return {os.path.basename(r.path): (r.status, r.records, r.attempts) for r in S.ledger_state(log).collect()}


def test_a_bad_file_stays_alone_and_is_tried_again(spark, folder):
    os.mkdir(f"{folder}/in")
    hour = itertools.count()
    run = lambda: ingest.ingest_files(spark, f"file://{folder}/in", f"file://{folder}/out", f"file://{folder}/state", now() + F.make_dt_interval(hours=F.lit(next(hour))), tries=2)
    for k in range(6):
        write(f"{folder}/in", f"good {k}+é.csv", ["shipment_id,order_id", f"s{k},o{k}", f"t{k},", f'"u{k}","o{k}",more'])
    whole = gzip.compress(("shipment_id,order_id\n" + "".join(f"g{i},{i * 7919 % 10007}\n" for i in range(90_000))).encode())
    with open(f"{folder}/in/cut.csv.gz", "wb") as f:
        f.write(whole[: len(whole) // 2])
    write(f"{folder}/in", "no ids.csv", ["shipment_id,carrier", "x,ups"])
    run()
    good = {f"good {k}+é.csv": ("processed", 1, 1) for k in range(6)}
    assert ledger_of(spark, folder) == good | {"cut.csv.gz": ("failed", None, 1), "no ids.csv": ("failed", None, 1)}
    assert sorted(r.shipment_id for r in ingest.ingested(spark, f"file://{folder}/out").collect()) == [f"s{k}" for k in range(6)]
    bad = [(r.line, r.reason) for r in ingest.quarantined(spark, f"file://{folder}/out").collect()]
    assert len(bad) == 12 and ('"u3","o3",more', "malformed") in bad and {x for _, x in bad} == {"malformed", "missing order_id"}
    with open(f"{folder}/in/cut.csv.gz", "wb") as f:
        f.write(whole)
    run()
    assert ledger_of(spark, folder) == good | {"cut.csv.gz": ("processed", 90_000, 2), "no ids.csv": ("failed", None, 2)}
    assert ingest.ingested(spark, f"file://{folder}/out").count() == 90_006
    run()
    assert ledger_of(spark, folder)["no ids.csv"] == ("failed", None, 2)  # given up
    write(f"{folder}/in", "no ids.csv", ["shipment_id,order_id", "x,o1", "s1,o1"])
    run()
    assert ledger_of(spark, folder)["no ids.csv"] == ("processed", 2, 3)
    assert ingest.ingested(spark, f"file://{folder}/out").count() == 90_007  # s1 of o1 was there


def test_batches_do_not_read_what_is_stored(spark, folder):
    os.mkdir(f"{folder}/in")
    for k in range(3):
        write(f"{folder}/in", f"{k}.csv", ["shipment_id,order_id", f"s{k},o{k}", "same,row"])
        ingest.ingest_files(spark, f"file://{folder}/in", f"file://{folder}/out", f"file://{folder}/state", now())
        if k == 1:  # what is stored may be gone: what has been seen is state of the stream
            for f in glob.glob(f"{folder}/out/rows/*.parquet"):
                os.rename(f, f"{folder}/{os.path.basename(f)}")
            shutil.move(f"{folder}/out/rows/_spark_metadata", f"{folder}/metadata")
    assert [r.shipment_id for r in spark.read.parquet(*(f"file://{f}" for f in glob.glob(f"{folder}/out/rows/*.parquet"))).collect()] == ["s2"]


def test_only_moved_files_are_hashed(spark, folder):
    write(folder, "a.csv", ["1"])
    write(folder, "b.csv", ["1"])
    one = S.manifest(spark, f"file://{folder}")
    kept = spark.createDataFrame([(*r[:3], "kept") for r in one.collect()], one.schema)
    os.utime(f"{folder}/b.csv", (1, 1))
    two = S.manifest(spark, f"file://{folder}", before=kept)
    assert {os.path.basename(r.path): r.hash == "kept" for r in two.collect()} == {"a.csv": True, "b.csv": False}
    assert [(os.path.basename(r.path), r.change) for r in S.file_changes(two, kept).collect()] == [("b.csv", "changed")]


def test_manifest_hashes_follow_the_contents(spark, folder):
    write(folder, "a.csv", ["x", "1"])
    write(folder, "b.csv", ["x", "1"])
    write(folder, "c.csv", ["x", "2"])
    found = {os.path.basename(r.path): (r.size, r.hash) for r in S.manifest(spark, f"file://{folder}").collect()}
    assert found["a.csv"] == found["b.csv"] != found["c.csv"] and found["a.csv"][0] == 4


def test_replication_keeps_state_when_checks_fail(spark, folder):
    rows = lambda *r: spark.createDataFrame([(k, f"2020-01-{d:02d} 00:00:00", v) for k, d, v in r], "id long, at string, v long").withColumn("at", F.col("at").cast("timestamp_ntz"))
    how = {"target": f"file://{folder}/t", "state": f"file://{folder}/s", "table": "t", "watermark": "at", "keys": ["id"], "at": now(), "checks": [Q.between("v", 0, 9)]}
    one = P.replicate(rows((1, 1, 1), (2, 2, 2)), **how).first()
    assert (one.extracted, one.inserted, one.updated, one.held, one.version, one.watermark_before) == (2, 2, 0, 2, 1, None)
    with pytest.raises(ValueError):
        P.replicate(rows((1, 3, 99)), **how)
    two = P.replicate(rows((1, 1, 1), (2, 3, 5), (3, 4, 6)), lag_tolerance=3600, **how).first()
    assert (two.extracted, two.inserted, two.updated, two.held, two.version, two.lag_breach) == (2, 1, 1, 3, 2, True)
    assert sorted((r.id, r.v) for r in P.target_table(spark, how["target"], 2).collect()) == [(1, 1), (2, 5), (3, 6)]
    three = P.replicate(rows((3, 4, 6)), **how).first()
    assert (three.extracted, three.held, three.version, three.watermark_after) == (0, 3, 2, two.watermark_after)
    for bad in ({"watermark": "absent"}, {"mode": "delete"}):
        with pytest.raises(ValueError):
            P.replicate(rows((1, 1, 1)), **how | bad)


def test_an_upsert_leaves_other_buckets_alone(spark, folder):
    t = BucketedTable(spark, f"file://{folder}/t", ["id"], buckets=8, keep=2)

    def batch(name, *rows):
        spark.createDataFrame(rows, "id long, at long, v string").write.parquet(f"file://{folder}/{name}")
        return spark.read.parquet(f"file://{folder}/{name}")

    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/t/data/version=1/**/*.parquet", recursive=True)}
    assert P.apply_batch(t, 0, batch("a", *((i, 1, "a") for i in range(100)), (None, 1, "a")), "upsert", ["at"]) == (101, 0)
    before = files()
    assert P.apply_batch(t, 1, batch("b", (7, 2, "b"), (7, 3, "c"), (200, 1, "new")), "upsert", ["at"]) == (1, 1)
    after, touched = files(), t.touched(batch("c", (7, 0, ""), (200, 0, "")))
    assert {r.bucket for r in t.manifest(2).collect() if r.held == 2} == set(touched) and 0 < len(touched) < 8
    assert after == before and len(t.rows(2).collect()) == 102
    assert [tuple(r) for r in t.rows(2).where("id in (7, 200)").orderBy("id").collect()] == [(7, 3, "c"), (200, 1, "new")]
    assert P.apply_batch(t, 2, batch("d", (7, 4, "d"), (7, 4, "d")), "insert", ["at"]) == (2, 0)
    assert t.rows(3).where("id = 7").count() == 3 and t.versions() == [2, 3]  # the first version is expired
    gone = [f for f in before if not os.path.exists(f)]
    assert {f.split("bucket=")[1].split("/")[0] for f in gone} == {str(b) for b in touched}


def test_one_of_two_writers_goes_on(spark, folder):
    t = BucketedTable(spark, f"file://{folder}/t", ["id"])
    with t.writing(1):
        with pytest.raises(RuntimeError), t.writing(1):
            pass
    with t.writing(1):
        pass
    t.claim_seconds = -1
    with t.writing(1), t.writing(1):  # a claim that is too old does not count
        pass


def test_a_damaged_state_is_an_error(spark, folder):
    os.mkdir(f"{folder}/s")
    with open(f"{folder}/s/part.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        Watermarks(spark, f"file://{folder}/s").current().collect()
    assert Watermarks(spark, f"file://{folder}/none").current().collect() == []


def test_watermarks_are_restored(spark, folder):
    m = Watermarks(spark, f"file://{folder}/w")
    day = lambda d: F.lit(f"2020-01-{d:02d} 00:00:00").cast("timestamp_ntz")
    value = lambda: {(r.table_name, r.watermark.day, r.version) for r in m.current().collect()}
    m.set("raw.t", "at", day(1), day(11), 1)
    m.backup("one", day(11))
    m.set("t", "at", day(2), day(12), 2)
    m.set("u", "at", day(5), day(12))
    assert value() == {("t", 2, 2), ("u", 5, None)}
    m.restore(day(13), label="one")
    assert value() == {("t", 1, 2), ("u", 5, None)}
    m.restore(day(14), until=day(12))
    assert value() == {("t", 2, 2), ("u", 5, None)}
    for bad in ({"label": "two"}, {}, {"label": "one", "until": day(1)}):
        with pytest.raises(ValueError):
            m.restore(day(15), **bad)


def test_versions_merged_on_arrival_are_those_of_one_pass(spark, folder):
    rng = random.Random(3)
    feed = [(k, n, f"2020-01-{rng.randint(1, 28):02d} 00:00:00", "DELETE" if k % 7 == 0 and n == 3 else "UPDATE", rng.choice("ab")) for k in range(60) for n in range(rng.randint(1, 5))]
    rng.shuffle(feed)
    frame = lambda rows: spark.createDataFrame(rows, "k long, nth int, at string, operation_type string, status string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    v, d = (BucketedTable(spark, f"file://{folder}/{n}", ["k"], 4) for n in "vd")
    for n, rows in enumerate((feed[:40], feed[40:90], feed[90:] + feed[:5], feed[-1:])):
        frame(rows).write.parquet(f"file://{folder}/batch{n}")
        batch = spark.read.parquet(f"file://{folder}/batch{n}")
        I.merge_versions(v, batch, "at", "nth")
        I.merge_dimension(d, v, batch, ["status"], "at", "nth")
    want = I.versions(frame(feed), ["k"], "at", "nth")
    assert sorted(map(str, v.rows(v.version()).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    want = I.scd2(frame(feed), ["k"], ["status"], "at", "nth")
    assert sorted(map(str, d.rows(d.version()).select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_jdbc_scans_in_ranges_and_writes_once(spark, folder):
    url = f"jdbc:derby:{folder}/db;create=true"
    spark.range(1000).select(F.col("id").alias("n"), (F.col("id") * 2).alias("twice"), F.lit("x").alias("name")).write.parquet(f"file://{folder}/rows")
    df, types = spark.read.parquet(f"file://{folder}/rows"), "name VARCHAR(10)"
    assert [database.write(df, url, "t", "one", column_types=types), database.write(df, url, "t", "one", column_types=types)] == [1000, 0]
    assert database.write(df.where("n < 10"), url, "t", "two", column_types=types) == 10
    found = database.scan(spark, url, "t", "n", "twice", F.lit(200), task_rows=100)
    assert found.count() == 899 and found.rdd.getNumPartitions() == 9
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(twice,200)" in plan and "Filter" not in plan.replace("PushedFilters", "")
    assert database.write(df.where("n < 20").withColumn("twice", F.lit(-1).cast("long")), url, "t", "three", keys=["n"], column_types=types) == 20
    assert database.scan(spark, url, "t", "n", task_rows=100).agg(F.count("n"), F.count_if(F.col("twice") == -1)).first()[:] == (1000, 20)
    with pytest.raises(ValueError):
        database.scan(spark, url, "t; drop table t", "n")


def test_a_task_that_is_run_again_does_not_double_rows(spark, folder):
    url = f"jdbc:derby:{folder}/db;create=true"
    spark.range(50).withColumnRenamed("id", "n").write.parquet(f"file://{folder}/rows")
    df = spark.read.parquet(f"file://{folder}/rows")
    whole, move = database.run, []

    def twice(connection, sql, *values):
        if sql.startswith("INSERT INTO t ") and not move:  # some rows were stored by a run of a task that was lost
            move.append(whole(connection, 'INSERT INTO t_stage SELECT * FROM t_stage WHERE "n" < 20'))
        return whole(connection, sql, *values)

    database.run = twice
    try:
        assert database.write(df, url, "t", "b") == 50 and move == [20]
    finally:
        database.run = whole
    assert database.scan(spark, url, "t", "n").count() == 50


@pytest.mark.parametrize("table", ["t", "shop.t"])
def test_replaced_rows_are_found_by_an_index_on_all_keys(spark, folder, table):
    url = f"jdbc:derby:{folder}/db;create=true"
    spark.range(300).select((F.col("id") % 100).alias("n"), (F.col("id") % 3).alias("part"), F.col("id").alias("cents")).write.parquet(f"file://{folder}/rows")
    df = spark.read.parquet(f"file://{folder}/rows")
    if "." in table:
        with database.transaction(spark, url) as c:
            database.run(c, "CREATE SCHEMA shop")
    whole, indexed = database.run, []

    def watched(connection, sql, *values):
        if sql.startswith("DELETE "):
            found = connection.getMetaData().getIndexInfo(None, None, "T_STAGE", False, True)
            while found.next():
                indexed.append(found.getString("COLUMN_NAME"))
        return whole(connection, sql, *values)

    database.run = watched
    try:
        assert database.write(df, url, table, "one", keys=["n", "part"]) == 300
        assert database.write(df.where("n < 10").withColumn("cents", F.lit(-1).cast("long")), url, table, "two", keys=["n", "part"]) == 30
    finally:
        database.run = whole
    assert indexed == ["n", "part"] * 2
    assert database.scan(spark, url, table, "n").agg(F.count("n"), F.count_if(F.col("cents") == -1)).first()[:] == (300, 30)


@pytest.mark.parametrize("query, tables", [("jdbc_scan_incremental", ["SOURCE_EVENTS"]), ("jdbc_sink", ["APPENDED", "REPLACED"])])
def test_ranges_of_a_scan_are_found_by_an_index(spark, folder, query, tables):
    url = f"jdbc:derby:{folder}/db;create=true"
    spark.conf.set("spark.orderloom.jdbc.url", url)
    try:
        first, again = (changes.queries()[query](spark, "/root/testdata/sf0.001").count() for _ in range(2))
    finally:
        spark.conf.unset("spark.orderloom.jdbc.url")
    indexed = []
    with database.transaction(spark, url) as c:
        for t in tables:
            found = c.getMetaData().getIndexInfo(None, None, t, False, True)
            while found.next():
                indexed.append((t, found.getString("COLUMN_NAME")))
    assert indexed == [(t, "event_id") for t in tables] and first == again > 0


def test_a_mart_keeps_the_days_that_no_row_touches(spark, folder):
    frame = lambda *rows: spark.createDataFrame(rows, "day string, n long")
    total = lambda df: df.groupBy("day").agg(F.sum("n").alias("n"))
    to, one = f"file://{folder}/mart", frame(("a", 1), ("a", 2), ("b", 3), (None, 4))
    refresh_partitions(total, one, one, F.col("day"), "day", to)
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/mart/day=*/*.parquet")}
    late = frame(("b", 10), ("c", 5))
    refresh_partitions(total, one.unionByName(late), late, F.col("day"), "day", to)
    assert sorted(map(str, spark.read.parquet(to).select("day", "n").collect())) == sorted(map(str, total(one.unionByName(late)).collect()))
    again = {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/mart/day=*/*.parquet")}
    assert {f for f in files if "day=b" not in f} <= set(again) and all(again[f] == files[f] for f in set(files) & set(again)) and len(again) == 4


def test_jobs_are_logged_from_start_to_end(spark, folder):
    log = L.JobLog(spark, f"file://{folder}/log")
    assert log.run("1", "good", lambda: spark.range(7), f"file://{folder}/good", now())
    assert not log.run("2", "bad", lambda: spark.range(1).select(F.raise_error(F.lit("no luck"))), f"file://{folder}/bad", now())
    log.append("3", "open", "start", now())
    log.append("4", "lost", "end", now(), "SUCCESS", processed=3)
    log.append("5", "old", "start", now() - F.make_dt_interval(days=F.lit(1)))
    got = {r.job_id: r for r in log.jobs(now()).collect()}
    assert [got[k].status for k in "12345"] == ["SUCCESS", "FAILED", "RUNNING", "SUCCESS", "ABANDONED"]
    assert (got["1"].processed, got["4"].processed, got["4"].started_at, got["2"].processed) == (7, 3, None, None) and got["2"].error


def test_constraints_name_their_columns():
    assert columns_of("a >= 0 AND regexp_like(b, '^x y$') OR c IS NOT NULL") == {"a", "b", "c"}
    assert set(checkable("raw_orders", ["currency"])) == {"chk_raw_orders_currency_format"}
    assert sum(map(len, CONSTRAINTS.values())) == 37


def test_orders_without_a_customer_are_one_history(spark):
    rows = [(f"o{i:03d}", None if i % 3 else f"c{i % 2}", f"2020-01-{1 + i * 7 % 20:02d} 0{i % 9}:00:00", None if i % 11 == 0 else i) for i in range(90)]
    df = spark.createDataFrame(rows, "order_id string, customer_id string, order_date string, total_amount long").withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))
    part = df.withColumn("part_", F.when(F.col("customer_id").isNull(), F.to_date("order_date")))
    got = M.with_history(part, df).select("order_id", "customer_order_sequence", "days_since_previous_order", "cumulative_customer_value", "cumulative_order_count")
    w = Window.partitionBy("customer_id").orderBy("order_date", "order_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select(
        "order_id",
        F.row_number().over(w),
        F.coalesce(M.days_between(F.col("order_date"), F.lag("order_date").over(w)), F.lit(0)),
        F.sum("total_amount").over(so_far),
        F.count(F.lit(1)).over(so_far),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


SF = "/root/testdata/sf0.001"


def test_folders_have_more_files_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(files, "FILE_ROWS", 200)
    w = files.Files(spark, SF)
    n = w.raw_shipments.count()
    assert w.parts == n // 200 > 2 * files.PARTS
    for folder in (w.folder(), files._broken_folder(w)):
        assert len(glob.glob(folder.removeprefix("file://") + "/*.csv")) >= w.parts
    _, state = files._ingested_folder(w)
    batches = {r.path for r in spark.read.parquet(f"{state}/ledger").select("path").distinct().collect()}
    assert len(batches) == w.parts + files.BAD + 1
    assert len(glob.glob(state.removeprefix("file://") + "/files/commits/[0-9]*")) == 2


def size_of(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(f))


def test_landed_and_stored_rows_are_packed(spark, folder):
    """A hash is 64 digits of text, of which half is enough; it is in the landed and in the stored rows."""
    os.mkdir(f"{folder}/in")
    n = 20_000
    write(f"{folder}/in", "a.csv", ["shipment_id,order_id,carrier", *(f"s{k},o{k % 999},ups" for k in range(n))])
    ingest.ingest_files(spark, f"file://{folder}/in", f"file://{folder}/out", f"file://{folder}/state", now())
    assert ingest.ingested(spark, f"file://{folder}/out").select("record_hash").distinct().count() == n
    assert size_of(f"{folder}/out") < 2 * 64 * n


def test_a_folder_to_ingest_is_packed_and_takes_nothing_else(spark, monkeypatch):
    """Neither the table that its files are written from stays, nor the shuffles of their writes."""
    to = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    monkeypatch.setattr(files, "scratch", lambda spark, name: f"file://{to}/{name}")
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    archived = files._archived(files.Files(spark, SF))
    assert archived.count() == files.Files(spark, SF).raw_shipments.count()
    assert glob.glob(f"{to}/archive/*.csv.gz") and not glob.glob(f"{to}/archive/*.csv") and not os.path.exists(f"{to}/shipments")
    again = files.Files(spark, SF)
    monkeypatch.setattr(files, "scratch", lambda spark, name: f"file://{to}/again-{name}")
    before = shuffled()
    again.folder("gzip")
    until = time.time() + 5  # they are removed in the background
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before


def test_what_has_been_seen_is_packed_and_old_versions_go(spark, folder, monkeypatch):
    """State that was written unpacked goes on to hold."""
    os.mkdir(f"{folder}/in")
    n = 20_000
    ingest_one = lambda: ingest.ingest_files(spark, f"file://{folder}/in", f"file://{folder}/out", f"file://{folder}/state", now())
    write(f"{folder}/in", "a.csv", ["shipment_id,order_id,carrier", *(f"s{k},o{k % 999},ups" for k in range(n))])
    with monkeypatch.context() as m:
        m.setattr(ingest, "ROCKS", {"spark.sql.streaming.stateStore.providerClass": ingest.ROCKS["spark.sql.streaming.stateStore.providerClass"]})
        ingest_one()
    unpacked = size_of(f"{folder}/state/rows/state")
    write(f"{folder}/in", "b.csv", ["shipment_id,order_id,carrier", *(f"s{k},o{k % 999},ups" for k in range(n // 2, 3 * n // 2))])
    ingest_one()
    assert ingest.ingested(spark, f"file://{folder}/out").count() == 3 * n // 2
    ingest.ingest_files(spark, f"file://{folder}/in", f"file://{folder}/other", f"file://{folder}/other-state", now())
    assert ingest.ingested(spark, f"file://{folder}/other").count() == 3 * n // 2
    assert size_of(f"{folder}/other-state/rows/state") < unpacked < 2 * 64 * n
    for k in range(3):
        write(f"{folder}/in", f"c{k}.csv", ["shipment_id,order_id,carrier", f"c{k},o,ups"])
        ingest_one()
    assert len(glob.glob(f"{folder}/state/rows/commits/[0-9]*")) <= 3  # and with them the versions of the state


def test_rows_are_told_apart_in_batches_whose_shuffles_go(spark, folder, monkeypatch):
    os.mkdir(f"{folder}/in")
    for k in range(8):
        write(f"{folder}/in", f"{k}.csv", ["shipment_id,order_id", *(f"s{i},o{i}" for i in range(100 * k, 100 * k + 200))])
    with monkeypatch.context() as m:
        m.setattr(ingest, "dedupe", lambda *_: None)
        ingest.ingest_files(spark, f"file://{folder}/in", f"file://{folder}/out", f"file://{folder}/state", now(), most_files=4)
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffles = lambda: {os.path.basename(f).split("_")[1] for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = shuffles()
    monkeypatch.setattr(ingest, "BATCH_BYTES", 1)  # a file at least
    monkeypatch.setattr(ingest, "COLLECT_SECONDS", 0.5)
    ingest.dedupe(spark, f"file://{folder}/out/landing", f"file://{folder}/out/rows", f"file://{folder}/state/rows")
    time.sleep(1)  # they are removed in the background
    landed = glob.glob(f"{folder}/out/landing/batch=*/group=*/kept=true/*.parquet")
    assert max(int(os.path.basename(f)) for f in glob.glob(f"{folder}/state/rows/commits/[0-9]*")) + 1 == len(landed) > 4
    assert len(shuffles() - before) < len(landed) // 2
    got = ingest.ingested(spark, f"file://{folder}/out").select("shipment_id", "order_id").collect()
    assert sorted(map(tuple, got)) == sorted((f"s{i}", f"o{i}") for i in range(900))


def test_batches_of_files_hold_no_content(spark, folder, monkeypatch):
    seen, listed = [], ingest.listed
    monkeypatch.setattr(ingest, "listed", lambda f: seen.append(f.columns) or listed(f))
    os.mkdir(f"{folder}/in")
    write(f"{folder}/in", "a.csv", ["shipment_id,order_id,carrier", "s1,o1,ups"])
    ingest.ingest_files(spark, f"file://{folder}/in", f"file://{folder}/out", f"file://{folder}/state", now())
    assert seen and all("content" not in c for c in seen)
    assert "path_" not in ingest.ingested(spark, f"file://{folder}/out").columns


def test_tasks_stay_small_where_tables_grow(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    w = warehouse.Warehouse(spark, SF)
    assert w.raw_shipments.rdd.getNumPartitions() >= w.order_items.count() // 500 > 4
    assert "REPARTITION_BY_NUM" in warehouse._by_category(w)._jdf.queryExecution().executedPlan().toString()
    to = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    monkeypatch.setattr(warehouse, "scratch", lambda spark, name: f"file://{to}/{name}")
    warehouse._per_file(w)
    assert len(glob.glob(f"{to}/by-carrier/carrier=ups/*.parquet")) > 4


def test_stored_versions_have_more_buckets_for_more_orders(spark, monkeypatch):
    monkeypatch.setattr(changes, "BUCKET_ORDERS", 50)
    w = changes.Changes(spark, SF)
    v, d = changes._arrived(w)
    assert v.buckets == d.buckets == spark.read.parquet(f"{SF}/orders.parquet").count() // 50 > changes.BUCKETS
    assert v.rows(v.version()).count() == w.feed.count()
