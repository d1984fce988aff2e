"""Tables laid out by date, backfills of one scan, and limited runs that get further."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.test_pipelines import add_orders, minutes, orders_spec, target
from tidewell.operators import backfill
from tidewell.plans import runner
from tidewell.sinks import storage
from tidewell.sinks.dataset import Dataset, NullKeys
from tidewell.sinks.partitions import PartitionTarget
from tidewell.spec import PipelineSpec, SpecError

T0 = datetime(2025, 1, 1)
SCHEMA = "id bigint, at timestamp_ntz, name string"


def parts(spark, path, **options):
    return PartitionTarget(spark, f"{path}/raw", Dataset(spark, str(path), "raw"), field="at", **options)


def frame(spark, *entries, schema=SCHEMA):
    return spark.createDataFrame(list(entries), schema)


def names(out, table="t"):
    held = storage.child_names(out.spark, f"{out.path}/{table}")
    return sorted(n.split("=")[1] for n in held if n.startswith("_part="))


def files(out, part, table="t"):
    held = storage.child_names(out.spark, f"{out.path}/{table}/_part={part}")
    return sorted(n for n in held if n.endswith(".parquet"))


def test_merge_rewrites_only_its_partitions(spark, tmp_path):
    out = parts(spark, tmp_path)
    months = [(k, T0 + timedelta(days=31 * k), f"a{k}") for k in range(6)] + [(9, None, "no date")]
    out.load("t", frame(spark, *months), "merge", key="id")
    assert len(names(out)) == 7 and "none" in names(out)
    before = {p: files(out, p) for p in names(out)}
    delta = frame(spark, (1, T0 + timedelta(days=31), "b1"), (2, T0, "moved"), (7, T0 + timedelta(days=31), "new"))
    assert out.load("t", delta, "merge", key="id")["n_rows"] == 3
    # id 2 was alone in its month, which is gone; it and id 1 touch two more
    touched = {p for p in before if p not in names(out) or files(out, p) != before[p]}
    assert touched == {"2025-01", "2025-02", "2025-03"} and "2025-03" not in names(out)
    got = {r["id"]: r["name"] for r in out.read("t").collect()}
    assert got == {0: "a0", 1: "b1", 2: "moved", 3: "a3", 4: "a4", 5: "a5", 7: "new", 9: "no date"}


def test_a_repeated_merge_changes_nothing(spark, tmp_path):
    out = parts(spark, tmp_path, unit="day")
    delta = frame(spark, (1, T0, "x"), (1, T0 + timedelta(days=3), "y"), (2, None, "z"))
    for _ in range(2):
        out.load("t", delta, "merge", key="id", cursor="at")
        assert [tuple(r) for r in out.read("t").orderBy("id").collect()] == [(1, T0 + timedelta(days=3), "y"), (2, None, "z")]
    out.load("t", frame(spark), "merge", key="id", cursor="at")
    assert out.read("t").count() == 2 and out.cursor("t").startswith("2025-01-04")


def test_a_load_that_dies_before_its_audit_row_is_repeated(spark, tmp_path, monkeypatch):
    out = parts(spark, tmp_path)
    out.load("t", frame(spark, (1, T0, "a"), (2, T0, "b")), "merge", key="id", cursor="at")
    again = frame(spark, (2, T0 + timedelta(days=40), "moved"))
    monkeypatch.setattr(Dataset, "commit_external", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        out.load("t", again, "merge", key="id", cursor="at")
    monkeypatch.undo()
    assert out.cursor("t").startswith("2025-01-01")
    out.load("t", again, "merge", key="id", cursor="at")
    assert [r["name"] for r in out.read("t").orderBy("id").collect()] == ["a", "moved"]


def test_partition_dispositions(spark, tmp_path):
    out = parts(spark, tmp_path, unit="year")
    out.load("t", frame(spark, (1, T0, "a")), "append")
    out.load("t", frame(spark, (1, T0, "a"), (2, datetime(2020, 5, 1), "b")), "append")
    assert out.read("t").count() == 3 and names(out) == ["2020", "2025"]
    out.load("t", out.read("t").filter("id = 2"), "replace")
    assert [tuple(r) for r in out.read("t").select("id").collect()] == [(2,)] and names(out) == ["2020"]
    with pytest.raises(NullKeys):
        out.load("t", frame(spark, (None, T0, "c")), "merge", key="id")
    assert out.read("t").count() == 1 and names(out) == ["2020"]
    wider = frame(spark, (3, T0, 1.5), schema="id bigint, at timestamp_ntz, name double")
    out.load("t", wider, "append")  # text beside a number: all of it becomes text
    assert sorted(r["name"] for r in out.read("t").collect()) == ["1.5", "b"]
    out.load("t", frame(spark), "replace")
    assert out.read("t").count() == 0 and names(out) == []


def test_fixed_dates_skip_the_lookup(spark, tmp_path):
    out = parts(spark, tmp_path, fixed=True)
    for text in ("a", "b"):
        out.load("t", frame(spark, (1, T0, text)), "merge", key="id")
    assert [r["name"] for r in out.read("t").collect()] == ["b"]


def test_run_with_partitions_and_nested_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    nested = spark.sql("SELECT 1L AS id, timestamp_ntz'2025-01-05' AS updated_at, array(named_struct('x', 1), named_struct('x', 2)) AS items")
    nested.write.parquet(source)
    spec = orders_spec(source, options={"partition_field": "updated_at"})
    runner.run(spark, spec, str(tmp_path / "out"))
    later = nested.selectExpr("id", "updated_at + INTERVAL 60 DAYS AS updated_at", "slice(items, 2, 1) AS items")
    later.write.mode("append").parquet(source)
    runner.run(spark, spec, str(tmp_path / "out"))
    out = runner.target_of(spark, spec, str(tmp_path / "out"), {})
    assert isinstance(out, PartitionTarget) and names(out, "orders") == ["2025-03"]
    children = out.read("orders__items").collect()
    assert len(children) == 1 and 2 in tuple(children[0])
    status = runner.delete_pipeline(spark, spec, str(tmp_path / "out"))
    assert status["status"] == "ok" and not storage.exists(spark, out.path)


def test_partition_options_are_checked(tmp_path):
    for bad in ({"partition_unit": "week"}, {"delete_mode": "both"}, {"partition_field": 3}):
        with pytest.raises(SpecError):
            orders_spec(tmp_path, options=bad)


@pytest.mark.parametrize("disposition", ["merge", "append"])
def test_backfill_reads_its_source_once(spark, tmp_path, disposition):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spec = orders_spec(source, sync={"backfill": {"chunk_size": "P1D"}}, options={"write_disposition": disposition})
    add_orders(spark, source, *[(i, float(i), timedelta(hours=7 * i)) for i in range(100)])
    empty = spark.read.parquet(str(source)).limit(3).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    empty.withColumn("id", F.col("id") + 1000).write.mode("append").parquet(str(source))
    aware = datetime(2025, 1, 1, tzinfo=timezone.utc)
    first = runner.run_backfill(spark, spec, aware + timedelta(days=3), aware + timedelta(days=6), out)
    assert first.count() == 3 and {r["n_skipped"] for r in first.collect()} == {3}
    second = runner.run_backfill(spark, spec, aware, aware + timedelta(days=40), out).collect()
    assert len(second) == 37 and len({r["load_id"] for r in second}) == 1
    per_day = [sum(24 * d <= 7 * i < 24 * (d + 1) for i in range(100)) for d in range(40)]
    got = {(r["chunk_start"] - T0).days: r["n_rows"] for r in second}
    assert got == {d: n for d, n in enumerate(per_day) if d not in (3, 4, 5)}
    landed = target(spark, tmp_path)
    assert landed.read("orders").count() == 100 and landed.loads().count() == 2
    assert runner.run_backfill(spark, spec, aware, aware + timedelta(days=40), out).count() == 0


def test_ranges_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "x")
    days = spark.range(0, 400).select(F.expr("timestamp_ntz'2025-01-01' + make_dt_interval(CAST(id AS INT))").alias("at"))
    days.write.parquet(path)
    df = spark.read.parquet(path)
    few = [(T0, T0 + timedelta(days=2)), (T0 + timedelta(days=9), T0 + timedelta(days=10))]
    many = [(T0 + timedelta(days=3 * k), T0 + timedelta(days=3 * k + 1)) for k in range(100)]
    for ranges, n in ((few, 3), (many, 100)):
        kept = df.filter(backfill.in_ranges(F.col("at"), df.schema["at"].dataType, ranges))
        assert kept.count() == n
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "GreaterThanOrEqual(at" in plan.split("PushedFilters")[1]
        counts = backfill.range_counts(kept, "at", ranges)
        assert sum(counts) == n and len(counts) == len(ranges)
    assert backfill.joined_ranges([(3, 4), (1, 2), (2, 3), (6, 9), (7, 8)]) == [(1, 4), (6, 9)]


@pytest.mark.parametrize("disposition", ["merge", "append"])
def test_limit_one_lands_every_row(spark, tmp_path, disposition):
    spec = orders_spec(tmp_path / "in", options={"write_disposition": disposition})
    add_orders(spark, tmp_path / "in", *[(i, 1.0, minutes(i // 2)) for i in range(6)])
    seen = []
    for _ in range(4):
        runner.run(spark, spec, str(tmp_path / "out"), limit=1)
        seen.append(target(spark, tmp_path).read("orders").count())
    assert seen == [2, 4, 6, 6]


def test_hard_deletes_from_a_spec(spark, tmp_path):
    raw = {
        "name": "orders_cdc",
        "source": {"type": "pg_cdc", "connection": "pg", "config": {"slot_name": "s", "publication_name": "p", "tables": ["orders"]}},
        "sync": {"mode": "cdc", "primary_key": "id"},
        "destination": {"type": "duckdb", "connection": "local", "dataset": "raw_cdc"},
        "options": {"delete_mode": "hard"},
    }
    log = spark.sql(
        "SELECT * FROM VALUES (1L, 1L, 'I', 1L, 'a'), (2L, 2L, 'D', 1L, CAST(NULL AS STRING)) AS t(lsn, tx_id, op, id, name)"
    ).selectExpr("lsn", "tx_id", "op", "timestamp_ntz'2025-01-01' AS commit_ts", "'orders' AS table_name", "id", "name")
    log.write.parquet(str(tmp_path / "log"))
    spec = PipelineSpec.from_dict(raw)
    place = {"pg": {"log_path": str(tmp_path / "log")}}
    runner.run(spark, spec, str(tmp_path / "out"), place)
    out = Dataset(spark, str(tmp_path / "out"), "raw_cdc")
    assert out.read("orders", live_only=True).count() == 0
    assert out.read("orders").filter("name IS NOT NULL").count() == 0
