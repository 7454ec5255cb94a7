from datetime import UTC, datetime, timedelta

import pytest

from lodestone.operators import dlq
from lodestone.plans import governance as G
from lodestone.sources import files
from lodestone.streaming import monitor as M

NOW = datetime(2024, 2, 1, tzinfo=UTC)


@pytest.mark.parametrize("before, after, pct", [(14.3, 2.6, 81.8), (10, 10, 0.0), (10, 0, 100.0), (5, 10, -100.0)])
def test_improvement(before, after, pct):
    assert G.improvement_pct(before, after) == pct


@pytest.mark.parametrize("before, after", [(0, 5), (5, -1)])
def test_improvement_refuses(before, after):
    with pytest.raises(ValueError):
        G.improvement_pct(before, after)


@pytest.mark.parametrize("pct, one, two", [(81, "BENEFICIAL", "EXCELLENT"), (50, "BENEFICIAL", "EXCELLENT"), (20, "BENEFICIAL", "GOOD"), (19.9, "MARGINAL", "MARGINAL"), (5, "MARGINAL", "MARGINAL"), (4.9, "NOT_BENEFICIAL", "NOT_BENEFICIAL")])
def test_verdicts(pct, one, two):
    assert (G.benchmark_verdict(pct), G.scenario_verdict(pct)) == (one, two)


def test_statements():
    assert G.optimize_sql("silver.events", ["user_id", "event_type"]) == "OPTIMIZE silver.events ZORDER BY (user_id, event_type)"
    assert "WHERE event_date='2024-01-01'" in G.optimize_sql("silver.events", ["user_id"], "event_date='2024-01-01'")
    assert G.vacuum_sql("silver.events", 168) == "VACUUM silver.events RETAIN 168 HOURS"
    assert G.vacuum_sql("silver.events", 168, True).endswith("DRY RUN")
    assert G.schema_sql("add", "silver.events", "session_revenue", "DOUBLE") == "ALTER TABLE silver.events ADD COLUMN session_revenue DOUBLE"
    assert G.schema_sql("rename", "silver.events", "user_id", new_name="customer_id") == "ALTER TABLE silver.events RENAME COLUMN user_id TO customer_id"
    assert G.schema_sql("drop", "silver.events", "legacy_field") == "ALTER TABLE silver.events DROP COLUMN legacy_field"


@pytest.mark.parametrize("call, text", [
    (lambda: G.optimize_sql("", ["a"]), "table_name must not be empty"), (lambda: G.optimize_sql("t", []), "z_order_columns must not be empty"), (lambda: G.vacuum_sql("", 168), "table_name must not be empty"),
    (lambda: G.vacuum_sql("t", 0), "retention_hours must be >= 1"), (lambda: G.schema_sql("modify", "t", "c"), "Unsupported operation"), (lambda: G.schema_sql("add", "t", "c"), "type"), (lambda: G.schema_sql("rename", "t", "c"), "new name"),
])
def test_statements_refuse(call, text):
    with pytest.raises(ValueError, match=text):
        call()


def test_schemas():
    old = [("id", "String"), ("ts", "Timestamp"), ("amount", "Int")]
    assert G.diff_schemas(old, [*old, ("revenue", "Double")]) == {"added": ["revenue"], "removed": [], "type_changed": {}, "compatible": True}
    assert not G.diff_schemas(old, old[:2])["compatible"]
    assert G.diff_schemas(old, [*old[:2], ("amount", "Double")])["type_changed"] == {"amount": ("Int", "Double")}
    with pytest.raises(ValueError):
        G.validate_compatible(old, old[:1], strict=True)


def test_layer_metrics():
    m = G.layer_metrics({"good_records": 95, "bad_records": 5}, {"row_count": 90, "gx_checks": {}}, {"row_count": 10, "sla_breached": False, "duration_seconds": 3.0})
    assert m["quarantine_rate"] == 0.05
    assert G.layer_metrics({}, {}, {})["quarantine_rate"] == 0


def test_backoff_and_retry():
    assert [G.backoff(k) for k in (1, 2, 3)] == [2, 4, 8]
    assert G.backoff(10, base=10, most=50) == 50
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return 7

    r = G.run_with_retry("s", flaky, 3, sleep=waits.append)
    assert (r.success, r.attempts, r.result, waits) == (True, 3, 7, [2, 4])
    r = G.run_with_retry("s", lambda: 1 / 0, 2, sleep=waits.append)
    assert not r.success and "ZeroDivisionError" in r.error


def test_sla():
    assert not G.track_sla("revenue_summary", 0, 1, now=300)["sla_breached"]
    assert G.track_sla("revenue_summary", 0, 1, now=301)["sla_breached"]
    assert G.track_sla("other", 0, 1, now=1)["sla_threshold_seconds"] == 1800


@pytest.mark.parametrize("hours, status", [(6, "pass"), (12, "warn"), (18, "warn"), (24, "error"), (30, "error")])
def test_freshness(hours, status):
    assert G.check_freshness("s", NOW - timedelta(hours=hours), now=NOW).status == status
    assert G.check_freshness("s", (NOW - timedelta(hours=hours)).replace(tzinfo=None), now=NOW).age_hours == hours


def test_freshness_worst_and_limits():
    ok, f = (NOW - timedelta(hours=1)), G.Freshness()
    assert G.check_all({}, NOW)[0] == "pass"
    assert G.check_all({"a": (ok, f), "b": (None, f)}, NOW)[0] == "unknown"
    assert G.check_all({"a": (NOW - timedelta(hours=50), f), "b": (None, f)}, NOW)[0] == "error"
    assert G.check_all({"a": (ok, f), "b": (NOW - timedelta(hours=7), G.Freshness(6, 12))}, NOW)[0] == "warn"
    with pytest.raises(ValueError):
        G.Freshness(12, 12)


def test_lineage():
    t = G.Lineage()
    t.register("raw", ["id", "ts"])
    t.register("stg", ["id", "ts"], ["raw"])
    t.register("a", ["id"], ["stg"])
    t.register("b", ["id"], ["stg"])
    t.register("mart", ["id", "n"], ["a", "b"])
    assert t.upstream_chain("mart") == ["a", "b", "stg", "raw"]  # a diamond: each once
    assert t.column_lineage("mart", "ts") == ["stg", "raw"]
    assert t.columns("none") == [] and t.list_models()[0] == "a"


def test_coverage():
    m = {"name": "stg", "columns": [{"name": "a", "tests": ["unique", "not_null"]}, {"name": "b"}, {"name": "c", "tests": []}]}
    c = G.model_coverage(m)
    assert (c.percent, c.untested, c.tests["a"]) == (33.3, ["b", "c"], 2)
    assert G.model_coverage({"name": "x"}).percent == 0
    assert G.project_coverage([m, {"name": "y", "columns": [{"name": "d", "tests": ["unique"]}]}])["coverage_pct"] == 50.0


def test_dependencies():
    g = G.Dependencies({"stg": ["raw"], "int": ["stg"], "mart": ["int", "stg"], "alone": []})
    assert g.missing() == {"stg": ["raw"]} and g.orphans() == ["alone"] and not g.cycles() and not g.validate()["valid"]
    assert g.order().index("stg") < g.order().index("int") < g.order().index("mart")
    for loop in ({"a": ["b"], "b": ["a"]}, {"a": ["b"], "b": ["c"], "c": ["a"]}):
        assert len(G.Dependencies(loop).cycles()) == 1
        with pytest.raises(ValueError):
            G.Dependencies(loop).order()


def test_lag():
    r = M.consumer_lag({("t", 0): 100, ("t", 1): 50, ("t", 2): 7}, {("t", 0): 40, ("t", 1): 60})
    assert r.partitions == {("t", 0): 60, ("t", 1): 0, ("t", 2): 7} and r.total == 67 and r.largest == 60
    limits = M.LagLimits()
    assert [limits.severity(n) for n in (9_999, 10_000, 99_999, 100_000)] == ["OK", "WARN", "WARN", "CRITICAL"]
    assert M.consumer_lag({}, {}).severity() == "OK"
    waits = []
    assert len(M.run_monitor(lambda: {("t", 0): 5}, dict, max_iterations=3, sleep=waits.append)) == 3 and len(waits) == 2
    assert M.run_monitor(lambda: 1 / 0, dict, max_iterations=2, sleep=waits.append) == []


@pytest.mark.parametrize("rates, detected, reason", [([1000, 950], False, "ok"), ([1000, 500], True, "rate_drop"), ([1000, 700], True, "rate_drop"), ([1000, 100], True, "rate_drop"), ([1000], False, "insufficient_history"), ([0, 5], False, "zero_previous_rate")])
def test_backpressure(rates, detected, reason):
    got = M.detect_backpressure([{"processed_rows_per_second": r} for r in rates])
    assert (got["detected"], got["reason"]) == (detected, reason)


def test_delays():
    assert M.parse_delay("10 minutes") == {"value": 10, "unit": "minute", "total_seconds": 600, "spark_string": "10 minutes"}
    assert M.parse_delay("2 hours")["total_seconds"] == 7200 and M.parse_delay("1 day")["spark_string"] == "1 day"
    for bad in ("10min", "10 weeks", "x minutes", "-5 minutes", "0 seconds", ""):
        with pytest.raises(ValueError):
            M.parse_delay(bad)
    assert M.late_data_policy("10 minutes", "1 minute", 10)["valid"]
    assert len(M.late_data_policy("30 seconds", "1 minute", 5)["warnings"]) == 2


def test_dead_letter_rules():
    assert dlq.classify_record({"user_id": None, "_corrupt_record": "x"}, ["event_id", "user_id"]) == "NULL_REQUIRED_FIELDS:event_id,user_id"
    assert dlq.classify_record({"user_id": 1, "_corrupt_record": "x"}, ["user_id"]) == "PARSE_FAILURE"
    assert dlq.classify_record({"user_id": 1}, ["user_id"]) is None
    assert [dlq.dlq_rate(1000, n)["severity"] for n in (5, 10, 20, 50, 60)] == ["OK", "WARN", "WARN", "CRITICAL", "CRITICAL"]
    assert dlq.dlq_rate(0, 0)["severity"] == "OK" and len(dlq.dlq_rate(0, 0)) == 3


def test_kafka_options():
    c = files.KafkaConfig("broker:9092", "events", "/chk", "silver.events")
    assert files.kafka_read_options(c)["subscribe"] == "events" and all(isinstance(v, str) for v in files.kafka_read_options(c).values()) and len(files.kafka_read_options(c)) == 6
    assert files.stream_write_options(c)["checkpointLocation"] == "/chk" and c.dead_letter_table == "silver.events_dlq"
    with pytest.raises(ValueError, match="checkpoint_location must not be empty"):
        files.stream_write_options(files.KafkaConfig("b", "t", " ", "o"))
