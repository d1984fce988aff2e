"""Loads that must not lose, repeat or alter rows."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import types as T

from tests.test_pipelines import (  # noqa: F401
    add_orders,
    change_source,
    frame,
    minutes,
    orders_spec,
    rows,
    state_of,
    target,
)
from tidewell.operators import backfill
from tidewell.operators.contracts import ContractViolation, contract_discard_row
from tidewell.plans import runner
from tidewell.sinks.dataset import Dataset
from tidewell.sources import files, registry
from tidewell.sources.changelog import LogConfig
from tidewell.spec import PipelineSpec, Source
from tidewell.streaming.change_stream import sync_changes


def test_limit_then_full_run(spark, tmp_path):
    # keys run against the cursor, and two rows share the last value of the limited run
    spec = orders_spec(tmp_path / "in")
    add_orders(spark, tmp_path / "in", *[(9 - i, 1.0, minutes(i - (i == 3))) for i in range(9)])
    assert runner.run(spark, spec, str(tmp_path / "out"), limit=3).first().n_rows == 4
    runner.run(spark, spec, str(tmp_path / "out"))
    assert [r[0] for r in rows(target(spark, tmp_path).read("orders"), "id")] == list(range(1, 10))


@pytest.mark.parametrize("disposition", ["merge", "append"])
def test_rows_without_cursor_are_loaded_once(spark, tmp_path, disposition):
    spec = orders_spec(tmp_path / "in", options={"write_disposition": disposition})
    add_orders(spark, tmp_path / "in", (1, 1.0, minutes(1)))
    runner.run(spark, spec, str(tmp_path / "out"))
    late = spark.read.parquet(str(tmp_path / "in")).selectExpr("id + 1 AS id", "amount", "cast(NULL AS timestamp_ntz) AS updated_at")
    late.select(*spark.read.parquet(str(tmp_path / "in")).columns).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        runner.run(spark, spec, str(tmp_path / "out"))
    assert [r[0] for r in rows(target(spark, tmp_path).read("orders"), "id")] == [1, 2]


def test_cdc_replace_rerun(spark, tmp_path, change_source):  # noqa: F811
    place, log = change_source
    spec = PipelineSpec.from_dict(
        {
            "name": "orders_cdc",
            "source": {"type": "pg_cdc", "connection": "pg",
                       "config": {"slot_name": "s", "publication_name": "p", "tables": ["orders"]}},
            "sync": {"mode": "cdc", "primary_key": "id"},
            "destination": {"type": "duckdb", "connection": "local", "dataset": "raw_orders_cdc"},
            "options": {"write_disposition": "replace"},
        }
    )
    log((3, "U", "orders", 1, 11.0))
    for _ in range(2):
        runner.run(spark, spec, str(tmp_path / "out"), place)
        landed = Dataset(spark, str(tmp_path / "out"), "raw_orders_cdc").read("orders")
        assert state_of(landed) == [(1, 11.0, False), (2, 20.0, False)]


def test_all_pages_by_default(spark):
    config = {"base_url": "https://api.example.com", "endpoints": ["a", {"name": "b", "max_pages": 1}]}
    tables = registry.build(spark, Source("rest_api", "api", config), {"api": {"fetcher": "tests.page_fetcher:fetch"}})
    assert {t: d.count() for t, d in tables.items()} == {"a": 6, "b": 3}


def test_discarded_rather_than_altered(spark):
    known = T.StructType.fromDDL("id bigint, n int, d date")
    came = frame(
        spark, (1, 1.0, "2025-01-01 00:00:00"), (2, 1.7, "2025-01-01 00:00:00"), (3, None, "2025-01-01 10:00:00"), (4, None, None),
        schema="id bigint, n double, d string",
    ).selectExpr("id", "n", "cast(d AS timestamp_ntz) AS d")
    accepted, rejected = contract_discard_row(known, came)
    assert [r[0] for r in rows(accepted, "id")] == [1, 4]
    assert [r[0] for r in rows(rejected, "id")] == [2, 3]


def test_csv_headers_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"say ""hi"", you"\n')
    read = files.scan_files(spark, str(tmp_path), "csv", "*.csv", schema="id bigint, name string")
    assert rows(read, "id") == [(1, 'say "hi", you')]
    (tmp_path / "b.csv").write_text("name,id\nx,2\n")
    both = files.scan_files(spark, str(tmp_path), "csv", "*.csv", schema="id bigint, name string")
    assert rows(both, "id") == [(1, 'say "hi", you'), (2, "x")]


def test_uncovered_parts_of_a_chunk():
    day = [datetime(2025, 1, 1) + timedelta(days=i) for i in range(11)]
    done = [(day[1], day[3]), (day[5], day[6]), (day[9], day[10])]
    cut = lambda a, b: [(day.index(x), day.index(y)) for x, y in backfill.uncovered((day[a], day[b]), done)]
    assert cut(0, 10) == [(0, 1), (3, 5), (6, 9)]
    assert cut(1, 3) == cut(5, 6) == []
    assert cut(2, 6) == [(3, 5)]
    assert cut(3, 5) == [(3, 5)]
    assert backfill.uncovered((day[0], day[2]), []) == [(day[0], day[2])]


@pytest.mark.parametrize("disposition", ["merge", "append"])
def test_backfill_with_other_bounds_repeats_nothing(spark, tmp_path, disposition):
    add_orders(spark, tmp_path / "in", *[(i, 1.0, timedelta(days=i)) for i in range(30)])
    for size, first, last, loaded in (("P7D", 0, 10, 10), ("P3D", 5, 20, 10), ("P30D", 0, 30, 10), ("P1D", 0, 30, 0)):
        spec = orders_spec(
            tmp_path / "in", sync={"backfill": {"chunk_size": size}}, options={"write_disposition": disposition}
        )
        start = datetime(2025, 1, 1, tzinfo=timezone.utc)
        done = runner.run_backfill(
            spark, spec, start + timedelta(days=first), start + timedelta(days=last), str(tmp_path / "out")
        )
        assert sum(r.n_rows for r in done.collect()) == loaded
    assert [r[0] for r in rows(target(spark, tmp_path).read("orders"), "id")] == list(range(30))


def test_failures_are_recorded_with_credentials_masked(spark, tmp_path, monkeypatch):
    spec = orders_spec(tmp_path / "in")

    def fail(*_):
        raise RuntimeError("postgresql://me:hunter2@host/db " + "x" * 450 + " password=hunter2 hunter3")

    monkeypatch.setattr(runner.registry, "build", fail)
    with pytest.raises(RuntimeError, match="hunter2"):
        runner.run(spark, spec, str(tmp_path / "out"))
    raw = {
        "name": "orders_inc", "source": {"type": "filesystem", "connection": "o", "config": {"bucket_url": "b", "file_glob": "*.parquet"}},
        "sync": {"mode": "full_refresh"}, "destination": {"type": "duckdb", "connection": "local", "dataset": "raw_orders_inc"},
    }
    status = runner.run_fleet(spark, [raw], str(tmp_path / "out")).collect()
    failed = spark.read.parquet(str(tmp_path / "out" / "raw_orders_inc" / "_failed")).collect()
    assert len(status) == 1 and len(failed) == 2
    for row in [*status, *failed]:
        assert row.status == "failed" and "hunter2" not in row.error and "me:***@host" in row.error
        assert len(row.error) <= 500


def test_frozen_stream(spark, tmp_path, change_source):  # noqa: F811
    place, log = change_source
    landed = Dataset(spark, str(tmp_path / "out"), "frozen")
    config = LogConfig.of(Source("pg_cdc", "pg", {"slot_name": "s", "publication_name": "p", "tables": ["orders"]}), place)
    log((3, "U", "orders", 1, 11.0))
    path = place["pg"]["log_path"]

    def drain():
        schema = spark.read.option("mergeSchema", True).parquet(path).schema
        sync_changes(spark, path, schema, landed, config, ["id"], str(tmp_path / "cp"), contract="freeze")

    drain()
    before = state_of(landed.read("orders"))
    spark.read.parquet(path).selectExpr("*", "1 AS surprise").write.mode("append").parquet(path)
    with pytest.raises(Exception, match="frozen schema|surprise"):
        drain()
    assert state_of(landed.read("orders")) == before
