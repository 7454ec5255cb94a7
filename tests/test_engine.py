import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import cdc, dlq, layers, quality
from lodestone.plans import models, pipeline
from lodestone.sources import files
from lodestone.sources.adapter import EVENT_SCHEMA
from lodestone.streaming import streams
from lodestone.table import versioned
from lodestone.table.versioned import VersionedTable


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0), (3, "c", 30.0)], "id long, name string, v double")


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}", "t")


def test_merge_is_idempotent_and_versions_replay(spark, table, people):
    table.append(people)
    change = spark.createDataFrame([(2, "B", 21.0), (4, "d", 40.0)], people.schema)
    table.merge(change, "id")
    once = rows(table.read())
    table.merge(change, "id")
    assert rows(table.read()) == once == [(1, "a", 10.0), (2, "B", 21.0), (3, "c", 30.0), (4, "d", 40.0)]
    assert rows(table.read(0)) == rows(people)
    assert rows(table.changes(1, 1), "id", "_change_type") == [(2, "update_postimage"), (2, "update_preimage"), (4, "insert")]


def test_merge_refuses_double_keys_and_inserts_null_keys(spark, table, people):
    table.append(people)
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([(2, "x", 0.0), (2, "y", 0.0)], people.schema), "id")
    table.merge(spark.createDataFrame([(None, "n", 0.0)], people.schema), "id")
    assert table.read().count() == 4


def test_history_restore_diff_vacuum(spark, table, people):
    table.append(people)
    table.delete("id = 1")
    assert table.diff_versions(0, 1)["row_delta"] == -1
    with pytest.raises(ValueError, match="must be less than current"):
        table.restore(1)
    table.restore(0)
    assert table.read().count() == 3 and table.latest_version() == 2
    assert [r["operation"] for r in table.history().collect()] == ["RESTORE", "DELETE", "APPEND"]
    assert table.version_at(datetime.now(UTC)) == 2
    with pytest.raises(ValueError):
        table.vacuum(0)
    import time

    assert table.vacuum(1) == []  # counts as 168 hours
    gone = table.vacuum(1, dry_run=True, allow_unsafe=True, now=time.time() + 10 * 3600)
    assert gone and table.read(1).count() == 2
    table.vacuum(1, allow_unsafe=True, now=time.time() + 10 * 3600)
    assert rows(table.read()) == rows(people)


def test_schema_changes(spark, table, people):
    table.append(people)
    with pytest.raises(RuntimeError):
        table.rename_column("name", "label")
    table.add_column("w", "int")
    table.enable_column_mapping()
    table.rename_column("name", "label")
    table.drop_column("v")
    table.add_column("v", "string")  # a new column of an old name doesn't see old values
    table.append(spark.createDataFrame([(9, "z", 5, "q", 1)], "id long, label string, w int, v string, more int"))
    assert rows(table.read(), "id", "label", "w", "v", "more")[-1] == (9, "z", 5, "q", 1)
    assert [r[0] for r in table.read().orderBy("id").select("v").collect()] == [None, None, None, "q"]
    table.enable_type_widening()
    table.widen_column("w", "bigint")
    assert dict(table.read().dtypes)["w"] == "bigint" and table.read().filter("w = 5").count() == 1
    with pytest.raises(ValueError):
        table.widen_column("w", "int")


def test_zorder_keeps_rows_and_skips_files(spark, table):
    df = spark.range(4000).select((F.col("id") * 7919 % 1000).alias("u"), (F.col("id") * 104729 % 777).alias("k"))
    table.append(df.repartition(8))
    before = table.files_scanned({"u": (5, 5)})
    assert table.optimize(["u", "k"], files=16)["numFilesRemoved"] == 8
    after, total = table.files_scanned({"u": (5, 5)})
    assert before == (8, 8) and after <= total // 2
    assert rows(table.read()) == rows(df) and rows(table.read(ranges={"u": (5, 5)})) == rows(df.filter("u = 5"))


def test_batches_are_written_once(spark, table, people):
    table.append(people, txn=("job", 1))
    table.append(people, txn=("job", 1))
    assert table.read().count() == 3 and table.latest_version() == 0


def test_losing_writer_retries(spark, table, people):
    table.append(people)
    other = VersionedTable(spark, table.root.rsplit("/", 1)[0], "t")
    create, raced = table.store.create, []

    def late(path, text):
        if not raced:
            raced.append(1)
            other.append(people)
        return create(path, text)

    table.store.create = late
    table.append(people)
    assert table.read().count() == 9 and table.latest_version() == 2


def test_partition_overwrite_and_update(spark, table, people):
    table.append(people, partition_by=["name"])
    table.overwrite_partitions(spark.createDataFrame([(7, "a", 1.0)], people.schema), "name")
    table.update("v > 15", {"v": F.col("v") + 1})
    assert rows(table.read()) == [(2, "b", 21.0), (3, "c", 31.0), (7, "a", 1.0)]


def test_pipeline(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [json.dumps({"event_id": f"E{i % 40}", "event_ts": f"2024-01-0{1 + i % 5} 00:00:00", "user_id": f"U{i % 3}", "event_type": " Click ", "revenue_amount": float(i), "product_line": "A"}) for i in range(50)]
    (src / "a.json").write_text("\n".join([*lines, '{"event_id": "broken']) + "\n")
    c = pipeline.PipelineConfig(f"file://{tmp_path}/lake", str(src), "1")
    r = pipeline.run_pipeline(spark, c, sleep=lambda s: None)
    assert r["status"] == "SUCCESS", r
    assert (r["metrics"]["bronze_good_records"], r["metrics"]["bronze_bad_records"], r["metrics"]["silver_row_count"]) == (50, 1, 40)
    assert pipeline.run_pipeline(spark, c, sleep=lambda s: None)["status"] == "SUCCESS"  # the same batch again
    assert VersionedTable(spark, c.root, "bronze").read().count() == 50
    assert VersionedTable(spark, c.root, "silver").read().filter("event_type = 'click'").count() == 40
    bad = pipeline.run_pipeline(spark, pipeline.PipelineConfig(f"file://{tmp_path}/l2", str(src), "1", gate=quality.GateConfig(min_rows=1000)), sleep=lambda s: None)
    assert bad["status"] == "FAILED" and bad["failed_stage"] == "silver" and "gold" not in bad["stages"]


def test_empty_source(spark, tmp_path):
    (tmp_path / "e.json").write_text("")
    with pytest.raises(ValueError):
        files.infer_schema(spark, str(tmp_path / "e.json"))


def test_gates(spark, people):
    assert quality.gate(people, quality.GateConfig(3, ("id",))).passed
    with pytest.raises(ValueError, match="missing"):
        quality.gate(people, quality.GateConfig(expected_columns=("zz",)))
    holed = people.withColumn("name", F.when(F.col("id") > 2, F.col("name")))
    with pytest.raises(ValueError, match="null"):
        quality.gate(holed)
    assert quality.profile(people.limit(0))[1]["id"] == 0.0 and not quality.check_not_null(holed, "name")


def test_unknown_family(people):
    with pytest.raises(ValueError, match="unknown metric family"):
        layers.gold("nope", people)


def test_rolling_by_days(spark):
    s = spark.createDataFrame([("s1", "u", "2024-01-01"), ("s2", "u", "2024-01-20")], "session_id string, user_id string, d string").select("session_id", "user_id", F.to_date("d").alias("session_date"), F.lit(1).alias("duration_seconds"), F.lit(1).alias("total_events"), F.lit(1).alias("product_lines_count"), F.lit(5.0).alias("session_revenue"), F.lit(True).alias("had_payment"), F.lit("smb").alias("revenue_tier"), F.lit("casual").alias("engagement_tier"))
    assert rows(models.daily_mart(s), "rolling_7d_sessions") == [(1,), (2,)]
    assert rows(models.daily_mart(s, by_days=True), "rolling_7d_sessions") == [(1,), (1,)]


#: In this order they add up to 99.99999999999999, from the end or by twos to 100.
CENTS = (17.16, 34.41, 24.88, 23.55)


def bound_events(spark):
    """A session of several tasks whose revenue, added up event by event, stays a hair below a tier's bound."""
    at = lambda i: datetime(2024, 1, 30, 10, i, tzinfo=UTC)
    events = [(i, 1, "click", at(i), "1-20240130", v, "pl_1", False, "{}") for i, v in enumerate(CENTS)]
    schema = "event_id long, user_id long, event_type string, event_ts timestamp, session_id string, revenue_amount double, product_line string, is_paid boolean, metadata string"
    return spark.createDataFrame(spark.sparkContext.parallelize(events[::-1], 2), schema)


def test_incremental_sessions_add_up_in_the_order_of_events(spark):
    s = models.sessions(bound_events(spark), datetime(2024, 1, 31), incremental=True, stamp=False)
    assert rows(s, "session_revenue", "revenue_tier") == [(99.99999999999999, "smb")]


def test_mart_puts_a_session_at_a_bound_into_the_tier_of_its_sum(spark):
    m = models.daily_mart(models.sessions(bound_events(spark), stamp=False))
    assert rows(m, "revenue_tier", "unique_sessions", "p50_revenue") == [("smb", 1, 99.99999999999999)]


def test_mart_rounds_halves_as_its_sql(spark):
    # 97 / 40 is 2.425, in binary a hair less: DuckDB's round(2.425, 2) is 2.42, Spark's 2.43.
    s = spark.range(40).select(F.col("id").cast("string").alias("session_id"), F.lit(1).alias("user_id"), F.lit("2024-01-01").cast("date").alias("session_date"), *[F.when(F.col("id") < 23, 2).otherwise(3).alias(c) for c in ("duration_seconds", "total_events", "product_lines_count")], F.lit(5.0).alias("session_revenue"), F.lit(True).alias("had_payment"), F.lit("smb").alias("revenue_tier"), F.lit("bounced").alias("engagement_tier"))
    assert rows(models.daily_mart(s), "avg_session_duration_seconds", "avg_events_per_session", "avg_products_per_session") == [(2.42, 2.42, 2.42)]


def test_sessions_add_up_in_the_order_of_events(spark):
    e = bound_events(spark)
    lost = e.withColumns({"session_id": F.lit(None).cast("string"), "user_id": F.lit(2).cast("long")})
    s = models.sessions(e.unionByName(lost), stamp=False)
    assert rows(s, "user_id", "total_events", "session_revenue", "revenue_tier") == [(1, 4, 99.99999999999999, "smb"), (2, 4, None, "free")]


def test_run_models(spark, tmp_path):
    raw = spark.createDataFrame([(str(i), "u1", f"s{i % 4}", f"2024-01-{10 + i % 4}T00:00:{i:02d}", "Click", "A", "2.5", "yes", "{}") for i in range(20)], "event_id string, user_id string, session_id string, event_ts string, event_type string, product_line string, revenue_amount string, is_paid string, metadata string")
    s, m = VersionedTable(spark, f"file://{tmp_path}", "sessions"), VersionedTable(spark, f"file://{tmp_path}", "mart")
    for _ in range(2):
        models.run_models(raw, s, m, datetime(2024, 1, 14))
    assert s.read().count() == 4 and m.read().agg(F.sum("unique_sessions")).first()[0] == 4


def test_dead_letters(spark, tmp_path, people):
    dead, target = VersionedTable(spark, f"file://{tmp_path}", "dead"), VersionedTable(spark, f"file://{tmp_path}", "good")
    assert dlq.write(dead, people.limit(0), "src") == 0
    assert dlq.write(dead, people, "src") == 3
    r = dlq.reprocess(dead, target, lambda df: df.filter("id <> 3"), max_attempts=2)
    assert (r.attempted, r.resolved, r.returned, r.unresolvable) == (3, 2, 1, 0)
    r = dlq.reprocess(dead, target, lambda df: df.filter("id < 0"), max_attempts=2)
    assert (r.attempted, r.resolved, r.returned, r.unresolvable) == (1, 0, 0, 1)
    assert rows(target.read(), "id") == [(1,), (2,)] and rows(dead.read(), "id", "dlq_status")[-1] == (3, "UNRESOLVABLE")
    dlq.write(dead, people, "src")
    with pytest.raises(RuntimeError):
        dlq.reprocess(dead, target, lambda df: (_ for _ in ()).throw(RuntimeError("x")))
    assert dead.read().filter("dlq_status = 'QUARANTINED'").count() == 3


def test_changes_to_target(spark, tmp_path, table, people):
    table.append(people)
    table.merge(spark.createDataFrame([(2, "B", 0.0)], people.schema), "id")
    table.delete("id = 3")
    copy = VersionedTable(spark, f"file://{tmp_path}", "copy")
    cdc.apply_changes(table.changes(0), copy, ["id"])
    assert rows(copy.read()) == rows(table.read())
    out = VersionedTable(spark, f"file://{tmp_path}", "out")
    for _ in range(2):  # a replay adds nothing
        r = cdc.run_batch(table, [cdc.Target(out, "id = 2"), cdc.Target(VersionedTable(spark, f"file://{tmp_path}", "none"), "id = 99")], 1)
    assert r["deletes"] == 1 and r["targets"] == {"out": 1, "none": 0} and out.read().count() == 1


def _messages(spark, path, lines, first):
    df = spark.createDataFrame([(None, x.encode(), "events", 0, first + i, datetime(2024, 1, 1, tzinfo=UTC), 0) for i, x in enumerate(lines)], files.KAFKA_ROW)
    df.coalesce(1).write.mode("append").parquet(str(path))


def test_event_stream_survives_restarts(spark, tmp_path):
    src, event = tmp_path / "msgs", lambda i, ts, **more: json.dumps({"event_id": str(i), "user_id": f"u{i % 2}", "event_type": "click", "event_ts": ts, "session_id": "s", "revenue_amount": 1.5, "product_line": "A"} | more)
    windows, dead = VersionedTable(spark, f"file://{tmp_path}", "w"), VersionedTable(spark, f"file://{tmp_path}", "d")
    for k in range(2):
        _messages(spark, src, [event(10 * k + i, f"2024-01-01T00:0{i}:00Z") for i in range(8)] + ["not json", event(9, None)], 100 * k)
        for q in streams.run_events(files.message_files(spark, str(src), 1), windows, dead, str(tmp_path / "ck"), availableNow=True):
            q.awaitTermination()
    assert windows.read().agg(F.sum("event_count")).first()[0] == 16
    assert dead.read().count() == 4 and dead.read().filter("raw_value = 'not json'").count() == 2
    raw, bad = VersionedTable(spark, f"file://{tmp_path}", "r"), VersionedTable(spark, f"file://{tmp_path}", "rb")
    for q in streams.run_raw(files.message_files(spark, str(src)), raw, bad, str(tmp_path / "ck2"), availableNow=True):
        q.awaitTermination()
    assert raw.read().count() == 20 and not bad.exists()


def test_change_stream_fans_out(spark, tmp_path, table, people):
    table.append(people)
    table.delete("id = 1")
    out = VersionedTable(spark, f"file://{tmp_path}", "out")
    streams.run_changes(streams.change_stream(table), [cdc.Target(out)], "t", str(tmp_path / "ck"), availableNow=True).awaitTermination()
    assert out.read().count() == 3


def test_windows_match_between_batch_and_slides(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 4), "c", "A", 1.0, "u", "s")], "event_ts timestamp, event_type string, product_line string, revenue_amount double, user_id string, session_id string")
    assert streams.window_aggregate(df).count() == 1 and streams.window_aggregate(df, slide="1 minute").count() == 5
    assert EVENT_SCHEMA["event_id"].nullable is False


def test_layout_benchmarks(spark, tmp_path):
    from lodestone.plans import benchmarks as B

    found, report = B.run_all(spark, f"file://{tmp_path}", rows=3000, runs=1)
    by_name = {r.name: r for r in found}
    assert len(found) == 4 and "| compaction |" in report
    assert by_name["zorder_user"].files_after[0] < by_name["zorder_user"].files_before[0]
    assert by_name["partition_date"].files_after[0] <= 10 and by_name["compaction"].files_after[1] == 4


def test_optimize_by_partition(spark, table, people):
    from lodestone.plans import benchmarks as B

    table.append(people.repartition(3), partition_by=["name"])
    got = B.optimize_by_partition(table, "name", ["a", "b"])
    assert set(got) == {"a", "b"} and rows(table.read()) == rows(people)
    table.view("t_now")
    assert spark.sql("select count(*) from t_now").first()[0] == 3
    assert table.freshness("name") == "c"


def test_bronze_stream_restarts_and_grows(spark, tmp_path):
    """Added columns join bronze, what doesn't parse is quarantined, and a restart neither loses nor repeats a file."""
    import json

    from lodestone.plans import pipeline

    source = tmp_path / "in"
    source.mkdir()
    c = pipeline.PipelineConfig(str(tmp_path / "tables"), str(source), "b1")

    def put(name, *rows):
        (source / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))

    def run():
        q = pipeline.run_bronze_stream(spark, c, str(tmp_path / "checkpoint"), availableNow=True)
        q.awaitTermination()

    put("a.json", {"event_id": "e1", "n": 1}, {"event_id": "e2", "n": 2}, "{not json")
    run()
    put("b.json", {"event_id": "e3", "n": 3, "extra": "x"})
    run()
    run()
    got = VersionedTable(spark, c.root, "bronze").read()
    assert sorted(tuple(r) for r in got.select("event_id", "n", F.coalesce("extra", F.lit("-"))).collect()) == [("e1", 1, "-"), ("e2", 2, "-"), ("e3", 3, "x")]
    assert [r["raw_value"] for r in VersionedTable(spark, c.root, "quarantine").read().collect()] == ["{not json"]


def test_pruning_to_the_fraction_of_a_second(spark, tmp_path):
    from datetime import UTC, date, datetime, timedelta, timezone

    t = VersionedTable(spark, str(tmp_path), "times")
    t.append(spark.sql("SELECT 1 AS id, TIMESTAMP'2024-01-01 00:00:00.5' AS ts, DATE'2024-01-01' AS d"))
    t.append(spark.sql("SELECT 2 AS id, TIMESTAMP'2024-01-01 12:00:00.25' AS ts, DATE'2024-01-02' AS d"))
    at = lambda *x, z=UTC: datetime(2024, 1, 1, *x, tzinfo=z)
    ids = lambda **r: sorted(x["id"] for x in t.read(ranges=r).collect())
    assert ids(ts=(None, at(0, 0, 0, 700_000))) == [1] and ids(ts=(None, at(0, 0, 0, 400_000))) == [] and ids(ts=(at(12, 0, 0, 200_000), None)) == [2]
    assert ids(ts=(at(13, 0, z=timezone(timedelta(hours=1))), None)) == [2] and t.files_scanned({"ts": (at(13, 0, 1, z=timezone(timedelta(hours=1))), None)}) == (0, 2)
    assert ids(d=(date(2024, 1, 2), None)) == [2] and t.files_scanned({"d": (datetime(2024, 1, 2), None)}) == (1, 2)


def test_changes_rewrite_only_the_files_they_touch(spark, table):
    table.append(spark.range(2_000).select("id", F.concat(F.lit("n"), F.col("id")).alias("name"), (F.col("id") * 1.0).alias("v")))
    table.optimize(["id"], files=20)
    paths = lambda: {f["path"] for f in table.snapshot().files}
    before = paths()
    assert len(before) == 20
    table.merge(spark.range(1_000, 1_020).select("id", F.lit("new").alias("name"), F.lit(-1.0).alias("v")), "id")
    assert len(before - paths()) <= 2  # one percent of the keys, which are neighbours
    assert table.read().count() == 2_000 and table.read().filter("name = 'new'").count() == 20
    kinds = {r[0]: r[1] for r in table.changes(table.latest_version()).groupBy("_change_type").count().collect()}
    assert kinds == {"update_preimage": 20, "update_postimage": 20}

    before = paths()
    table.update("id = 7", {"v": F.lit(70.0)})
    assert len(before - paths()) == 1
    before = paths()
    table.delete("id = 1999 OR id IS NULL")
    assert len(before - paths()) == 1
    assert table.read().count() == 1_999 and table.read().filter("id = 7").first()["v"] == 70.0

    before = paths()
    table.merge(spark.createDataFrame([(5_000, "far", 1.0), (None, "none", 2.0)], "id long, name string, v double"), "id")  # inserts only
    assert before <= paths() and table.read().count() == 2_001
    before = paths()
    table.merge(spark.createDataFrame([], "id long, name string, v double"), "id")
    table.delete("id = -1")
    assert before <= paths() and table.read().count() == 2_001


def test_partition_values_that_paths_must_escape(spark, table, people):
    odd = spark.createDataFrame([(1, "a b", 1.0), (2, "c:d", 2.0), (3, "50%", 3.0), (4, None, 4.0), (5, "e/data/f", 5.0), (6, "é", 6.0)], people.schema)
    table.append(odd, partition_by=["name"])
    assert len(rows(table.read())) == 6 and all(f["size"] > 0 for f in table.snapshot().files)
    kept = {f["path"] for f in table.snapshot().files}
    table.overwrite_partitions(spark.createDataFrame([(9, "50%", 9.0), (8, None, 8.0)], people.schema), "name")
    assert sorted(r["id"] for r in table.read().collect()) == [1, 2, 5, 6, 8, 9]
    assert len(kept - {f["path"] for f in table.snapshot().files}) == 2
    table.merge(spark.createDataFrame([(2, "c:d", 20.0)], people.schema), ["id", "name"])
    assert table.read().filter("id = 2").first()["v"] == 20.0


def test_checkpoints_hold_the_same_state(spark, table, people, monkeypatch):
    monkeypatch.setattr(versioned, "CHECKPOINT_EVERY", 2)
    table.append(people)
    table.delete("id = 1")
    table.append(spark.createDataFrame([(5, "e", 5.0)], people.schema))  # version 2
    table.set_properties(owner="x")
    table.update("id = 5", {"v": F.lit(6.0)})  # version 4
    assert table._checkpoints() == [2, 4]
    seen = [(s.files, s.schema, s.column_map, s.properties, s.timestamp) for s in map(table.snapshot, range(5))]
    found = [rows(table.read(v)) for v in range(5)]
    assert [len(f) for f in found] == [3, 2, 3, 3, 3] and (5, "e", 6.0) in found[4]
    monkeypatch.setattr(VersionedTable, "_checkpoints", lambda self: [])
    assert seen == [(s.files, s.schema, s.column_map, s.properties, s.timestamp) for s in map(table.snapshot, range(5))]
    assert found == [rows(table.read(v)) for v in range(5)]
