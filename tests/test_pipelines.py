"""Whole pipelines, from source to target."""

import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewell.operators.contracts import ContractViolation
from tidewell.plans import alerting, runner
from tidewell.sinks.dataset import ConcurrentLoad, Dataset, NullKeys
from tidewell.sinks.jdbc import JdbcTarget, merge_statement
from tidewell.sources import files, jdbc, pages, registry
from tidewell.sources.changelog import LogConfig
from tidewell.spec import PipelineSpec, Source
from tidewell.streaming.change_stream import new_loads, sync_changes

T0 = datetime(2025, 1, 1)
ORDERS = "id bigint, amount double, updated_at timestamp_ntz"


def rows(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]


def add_orders(spark, folder, *entries, mode="append"):
    data = [(i, a, T0 + d) for i, a, d in entries]
    spark.createDataFrame(data, ORDERS).coalesce(1).write.mode(mode).parquet(str(folder))


def orders_spec(folder, name="orders_inc", **parts):
    raw = {
        "name": name,
        "source": {"type": "filesystem", "connection": "orders",
                   "config": {"bucket_url": str(folder), "file_glob": "*.parquet"}},
        "sync": {"mode": "incremental", "cursor_field": "updated_at", "primary_key": "id"},
        "destination": {"type": "duckdb", "connection": "local", "dataset": f"raw_{name}"},
        "options": {"write_disposition": "merge"},
    }
    for block, values in parts.items():
        raw[block] = {**raw.get(block, {}), **values}
    return PipelineSpec.from_dict(raw)


def target(spark, tmp_path, name="orders_inc"):
    return Dataset(spark, str(tmp_path / "out"), f"raw_{name}")


def minutes(n):
    return timedelta(minutes=n)


def test_incremental_merge_then_rerun(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spec = orders_spec(source)
    add_orders(spark, source, (1, 10.0, minutes(0)), (2, 20.0, minutes(1)), (3, 30.0, minutes(2)))
    runner.run(spark, spec, out)
    assert rows(target(spark, tmp_path).read("orders").select("id", "amount"), "id") == [(1, 10.0), (2, 20.0), (3, 30.0)]
    add_orders(spark, source, (2, 999.0, minutes(60)), (4, 40.0, minutes(61)))
    done = runner.run(spark, spec, out).first()
    # The bound is inclusive: the row at the stored cursor is read once more.
    assert (done.n_rows, done.state_cursor) == (3, "2025-01-01 01:01:00")
    expected = [(1, 10.0), (2, 999.0), (3, 30.0), (4, 40.0)]
    assert rows(target(spark, tmp_path).read("orders").select("id", "amount"), "id") == expected
    runner.run(spark, spec, out)
    assert rows(target(spark, tmp_path).read("orders").select("id", "amount"), "id") == expected


@pytest.mark.parametrize(("tolerance", "landed"), [(0, [1]), (10, [1, 2])])
def test_late_rows(spark, tmp_path, tolerance, landed):
    source = tmp_path / "in"
    spec = orders_spec(source, sync={"tolerance_seconds": tolerance})
    add_orders(spark, source, (1, 10.0, minutes(720)))
    runner.run(spark, spec, str(tmp_path / "out"))
    add_orders(spark, source, (2, 20.0, minutes(720) - timedelta(seconds=1)))
    runner.run(spark, spec, str(tmp_path / "out"))
    assert [r[0] for r in rows(target(spark, tmp_path).read("orders").select("id"), "id")] == landed


@pytest.mark.parametrize("key", ["id", None])
def test_append_does_not_repeat_boundary_rows(spark, tmp_path, key):
    source = tmp_path / "in"
    spec = orders_spec(source, sync={"primary_key": key, "lookback": "PT1H"}, options={"write_disposition": "append"})
    add_orders(spark, source, (1, 10.0, minutes(0)), (2, None, minutes(1)))
    runner.run(spark, spec, str(tmp_path / "out"))
    add_orders(spark, source, (3, 30.0, minutes(1)))
    runner.run(spark, spec, str(tmp_path / "out"))
    runner.run(spark, spec, str(tmp_path / "out"))
    assert [r[0] for r in rows(target(spark, tmp_path).read("orders").select("id"), "id")] == [1, 2, 3]


def test_full_refresh_replaces(spark, tmp_path):
    source = tmp_path / "in"
    raw = {"sync": {"mode": "full_refresh", "cursor_field": None, "primary_key": None},
           "options": {"write_disposition": None}}
    add_orders(spark, source, (1, 10.0, minutes(0)), (2, 20.0, minutes(0)))
    runner.run(spark, orders_spec(source, **raw), str(tmp_path / "out"))
    add_orders(spark, source, (9, 1.0, minutes(0)), mode="overwrite")
    runner.run(spark, orders_spec(source, **raw), str(tmp_path / "out"))
    assert [r[0] for r in rows(target(spark, tmp_path).read("orders"), "id")] == [9]


def test_limit_and_dry_run(spark, tmp_path):
    source = tmp_path / "in"
    spec = orders_spec(source)
    add_orders(spark, source, *[(i, 1.0, minutes(i)) for i in range(9)])
    assert rows(runner.dry_run(spark, spec, limit=4), "table_name") == [
        ("orders", 4, "id bigint, amount double, updated_at timestamp_ntz")
    ]
    assert not (tmp_path / "out").exists()
    assert runner.run(spark, spec, str(tmp_path / "out"), limit=4).first().n_rows == 4


def test_backfill_is_exact_and_resumes(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spec = orders_spec(source, sync={"backfill": {"chunk_size": "P7D"}, "tolerance_seconds": 5})
    add_orders(spark, source, *[(i, float(i), timedelta(days=i)) for i in range(1, 31)])
    start = datetime(2025, 1, 1, tzinfo=timezone.utc)
    done = runner.run_backfill(spark, spec, start, start + timedelta(days=14), out)
    assert done.count() == 2
    done = runner.run_backfill(spark, spec, start, start + timedelta(days=30), out)
    assert rows(done.select("n_rows"), "chunk_start") == [(7,), (7,), (2,)]
    landed = target(spark, tmp_path)
    assert landed.read("orders").count() == 29
    assert landed.cursor("orders") is None


def test_backfill_refusals(spark, tmp_path):
    aware = datetime(2025, 1, 1, tzinfo=timezone.utc)
    later = aware + timedelta(days=1)
    refresh = orders_spec(tmp_path, sync={"mode": "full_refresh", "cursor_field": None})
    with pytest.raises(ValueError, match="requires 'incremental'"):
        runner.run_backfill(spark, refresh, aware, later, str(tmp_path))
    with pytest.raises(ValueError, match="no sync.backfill block"):
        runner.run_backfill(spark, orders_spec(tmp_path), aware, later, str(tmp_path))
    with pytest.raises(ValueError, match="name its time zone"):
        runner.run_backfill(spark, orders_spec(tmp_path), T0, later, str(tmp_path))


# -- target tables -------------------------------------------------------------------


def frame(spark, *entries, schema="id bigint, name string"):
    return spark.createDataFrame(list(entries), schema)


def test_null_keys_change_nothing(spark, tmp_path):
    out = Dataset(spark, str(tmp_path), "raw")
    out.load("t", frame(spark, (1, "a")), "merge", key="id")
    with pytest.raises(NullKeys):
        out.load("t", frame(spark, (None, "b"), (2, "c")), "merge", key="id")
    assert rows(out.read("t"), "id") == [(1, "a")]
    assert os.listdir(tmp_path / "raw" / "_staging") == []


def test_schema_evolves_and_is_logged(spark, tmp_path):
    out = Dataset(spark, str(tmp_path), "raw")
    out.load("t", frame(spark, (1, "a"), (2, "b")), "merge", key="id")
    wide = frame(spark, (2, "B", "m"), (3, "c", "n"), schema="id bigint, name string, email string")
    out.load("t", wide, "merge", key="id", pipeline="p")
    assert rows(out.read("t"), "id") == [(1, "a", None), (2, "B", "m"), (3, "c", "n")]
    assert [r.new_columns for r in out.schema_log().collect()] == [["email"]]


def test_key_type_change_rewrites(spark, tmp_path):
    out = Dataset(spark, str(tmp_path), "raw")
    out.load("t", frame(spark, (1, "a"), (2, "b"), schema="id int, name string"), "merge", key="id")
    out.load("t", frame(spark, (2, "B"), (3, "c")), "merge", key="id")
    assert rows(out.read("t"), "id") == [(1, "a"), (2, "B"), (3, "c")]
    out.load("t", frame(spark, ("x", "d"), schema="id string, name string"), "append")
    assert rows(out.read("t"), "id") == [("1", "a"), ("2", "B"), ("3", "c"), ("x", "d")]


def test_contracts_hold_in_the_writer(spark, tmp_path):
    out = Dataset(spark, str(tmp_path), "raw")
    out.load("t", frame(spark, (1, "a")), "append")
    wide = frame(spark, (2, "b", None), (3, "c", "x"), schema="id bigint, name string, email string")
    with pytest.raises(ContractViolation):
        out.load("t", wide, "append", contract="freeze")
    audit = out.load("t", wide, "append", contract="discard_row")
    assert (audit["n_rows"], audit["n_rejected"]) == (1, 1)
    assert rows(out.read("t"), "id") == [(1, "a"), (2, "b")]


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    out = Dataset(spark, str(tmp_path), "raw", buckets=8)
    first = out.load("t", spark.range(1000), "merge", key="id")
    second = out.load("t", spark.createDataFrame([(5,)], "id bigint"), "merge", key="id")
    changed = [b for b in first["layout"] if first["layout"][b] != second["layout"][b]]
    assert len(first["layout"]) == 8 and len(changed) == 1
    assert out.read("t").count() == 1000
    assert out.vacuum("t") == 0
    out.load("t", spark.range(1000), "merge", key="id")
    assert out.vacuum("t") == 2 and out.read("t").count() == 1000


def test_unfinished_and_concurrent_loads(spark, tmp_path):
    out = Dataset(spark, str(tmp_path), "raw")
    audit = out.load("t", frame(spark, (1, "a")), "append")
    # Rows of a load that died before its commit are not there.
    frame(spark, (7, "ghost")).write.parquet(f"{out.path}/t/load=dead")
    assert rows(out.read("t"), "id") == [(1, "a")]
    with pytest.raises(ConcurrentLoad):
        out._commit("t", audit["seq"], audit)


def test_empty_loads(spark, tmp_path):
    out = Dataset(spark, str(tmp_path), "raw")
    empty = frame(spark)
    for disposition in ("append", "merge", "replace"):
        audit = out.load(disposition, empty, disposition, key="id" if disposition == "merge" else ())
        assert audit["n_rows"] == 0
        assert out.read(disposition).count() == 0
    out.load("merge", frame(spark, (1, "a")), "merge", key="id", cursor="id")
    assert out.load("merge", empty, "merge", key="id", cursor="id")["state_cursor"] == "1"
    assert rows(out.read("merge"), "id") == [(1, "a")]


def test_cursor_never_moves_back(spark, tmp_path):
    out = Dataset(spark, str(tmp_path), "raw")
    out.load("t", frame(spark, (10, "a")), "append", cursor="id")
    assert out.load("t", frame(spark, (9, "b")), "append", cursor="id")["state_cursor"] == "10"


# -- sources -------------------------------------------------------------------------


@pytest.mark.parametrize("fmt", ["csv", "jsonl", "parquet"])
def test_file_formats_agree(spark, tmp_path, fmt):
    data = [(i, 100 + i, i + 0.5) for i in range(1, 6)]
    df = spark.createDataFrame(data, "id bigint, customer_id bigint, amount double").coalesce(1)
    folder = str(tmp_path / fmt)
    {"csv": lambda: df.write.option("header", True).csv(folder), "jsonl": lambda: df.write.json(folder),
     "parquet": lambda: df.write.parquet(folder)}[fmt]()
    glob = {"csv": "*.csv", "jsonl": "*.json", "parquet": "*.parquet"}[fmt]
    config = {"bucket_url": folder, "file_glob": glob, "format": fmt, "table_name": "orders",
              "reader_kwargs": {"chunksize": 5000}}
    read = registry.build(spark, Source("filesystem", "c", config), {})["orders"]
    assert sorted(read.dtypes) == [("amount", "double"), ("customer_id", "bigint"), ("id", "bigint")]
    assert rows(read.select("id", "customer_id", "amount"), "id") == data


def test_csv_with_a_schema_binds_by_name(spark, tmp_path):
    (tmp_path / "o.csv").write_text("amount,id,note\n1.5,1,x\noops,2,y\n")
    config = {"bucket_url": str(tmp_path), "file_glob": "*.csv",
              "reader_kwargs": {"schema": "id bigint, amount double, gone string"}}
    read = registry.build(spark, Source("filesystem", "c", config), {})["c"]
    assert rows(read, "id") == [(1, 1.5, None), (2, None, None)]


@pytest.mark.parametrize(
    ("config", "message"),
    [
        ({"bucket_url": "/x", "file_glob": "*"}, "does not tell the file format"),
        ({"bucket_url": "/x", "format": "xml"}, "is none of"),
        ({"bucket_url": "/x", "colour": 1}, "does not take"),
        ({"file_glob": "*.csv"}, "needs config.bucket_url"),
        ({"bucket_url": "s3://b/x", "file_glob": "*.csv"}, "is remote"),
    ],
)
def test_file_source_refusals(spark, config, message):
    with pytest.raises(ValueError, match=message):
        registry.build(spark, Source("filesystem", "c", config), {})


def test_listing_and_contents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "sub" / "b.txt").write_text("you")
    (tmp_path / "c.bin").write_text("no")
    listed = files.list_files(spark, str(tmp_path), "*.txt")
    assert rows(listed.select("file_name", "size_in_bytes"), "file_name") == [("a.txt", 5), ("b.txt", 3)]
    config = {"bucket_url": str(tmp_path), "file_glob": "*.txt", "format": "csv", "extract_content": True}
    content = registry.build(spark, Source("filesystem", "c", config), {})["c"]
    assert [bytes(r.content) for r in content.orderBy("file_name").collect()] == [b"hello", b"you"]


def test_bucket_urls():
    assert files.hadoop_url("s3://b/x") == "s3a://b/x"
    assert files.hadoop_url("gcs://b") == "gs://b"
    assert files.hadoop_url("abfss://c@a/x") == "abfss://c@a/x"
    assert files.hadoop_url("/local/x") == "/local/x"


def test_file_stream_pages(spark, tmp_path):
    for i in range(3):
        spark.range(2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = files.stream_files(spark, str(tmp_path / "in"), "parquet", schema, files_per_page=1)
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_jdbc_options():
    source = Source("sql_database", "db", {
        "tables": ["orders"], "schema": "public", "chunk_size": 500, "partition_column": "id",
        "lower_bound": 0, "upper_bound": 1000, "num_partitions": 8, "backend": "pyarrow",
        "reflection_level": "full_with_precision", "custom_schema": {"orders": "amount DECIMAL(12,2)"},
    })
    jdbc.check_config(source)
    assert jdbc.reader_options(source, "orders", {"url": "jdbc:x"}) == {
        "url": "jdbc:x", "dbtable": "public.orders", "fetchsize": "500", "partitionColumn": "id",
        "lowerBound": "0", "upperBound": "1000", "numPartitions": "8",
        "customSchema": "amount DECIMAL(12,2)",
    }


@pytest.mark.parametrize(
    ("config", "message"),
    [
        ({}, "needs config.tables"),
        ({"tables": []}, "needs config.tables"),
        ({"tables": ["t"], "colour": 1}, "does not take"),
        ({"tables": ["t"], "backend": "punch_cards"}, "backend must be one of"),
        ({"tables": ["t"]}, "must have an entry"),
    ],
)
def test_jdbc_refusals(spark, config, message):
    with pytest.raises(ValueError, match=message):
        registry.build(spark, Source("sql_database", "db", config), {})


def test_merge_statement():
    assert merge_statement('"s"."t"', '"s"."t_stage"', ["id", "v"], ["id"]) == (
        'MERGE INTO "s"."t" t USING "s"."t_stage" s ON (t."id" = s."id")'
        ' WHEN MATCHED THEN UPDATE SET "v" = s."v"'
        ' WHEN NOT MATCHED THEN INSERT ("id", "v") VALUES (s."id", s."v")'
    )
    guarded = merge_statement("t", "s", ["id", "_lsn"], ["id"], newer="_lsn")
    assert 'WHEN MATCHED AND (t."_lsn" IS NULL OR s."_lsn" > t."_lsn") THEN UPDATE' in guarded
    assert "WHEN MATCHED" not in merge_statement("t", "s", ["id"], ["id"]).replace("NOT MATCHED", "")


def test_jdbc_target_statements(spark, tmp_path, monkeypatch):
    """The order of writes and statements; no database is started for it."""
    calls = []
    audit = Dataset(spark, str(tmp_path), "wh")
    out = JdbcTarget(spark, {"url": "jdbc:x"}, "wh", audit)

    def write(df, table, mode):
        calls.append(("write", table.split("_stage")[0], mode, df.count()))
        df.write.format("noop").mode("overwrite").save()

    monkeypatch.setattr(out, "_write", write)
    monkeypatch.setattr(out, "_execute", lambda *s: calls.extend(t.split(" (")[0].split("_stage")[0] for t in s))
    first = frame(spark, (1, "a"), (1, "b"), (2, "c"))
    audit_row = out.load("t", first, "merge", key="id", cursor="id")
    assert (audit_row["n_rows"], audit_row["state_cursor"]) == (2, "2")
    assert calls == [
        ("write", '"wh"."t', "errorifexists", 2), ("write", '"wh"."t"', "append", 0),
        'MERGE INTO "wh"."t" t USING "wh"."t', 'DROP TABLE "wh"."t',
    ]
    calls.clear()
    first_lsn = out.apply("c", spark.createDataFrame([(5, "D", T0, 1)], "lsn bigint, op string, commit_ts timestamp_ntz, id bigint"), "id")
    assert first_lsn["state_cursor"] == "5" and calls[2].startswith('MERGE INTO "wh"."c" t')
    calls.clear()
    out.load("t", first.withColumn("n", F.lit(1)), "append", cursor="id")
    assert calls == ['ALTER TABLE "wh"."t" ADD COLUMN "n" INTEGER', ("write", '"wh"."t"', "append", 3)]
    with pytest.raises(NullKeys):
        out.load("t", frame(spark, (None, "a")), "merge", key="id")
    assert calls[-1] == 'DROP TABLE "wh"."t' and not any("MERGE" in str(c) for c in calls[2:])
    assert out.cursor("t") == "2"


def test_empty_rewrite_keeps_rows(spark, tmp_path):
    out = Dataset(spark, str(tmp_path), "raw")
    out.load("t", frame(spark, (1, "a")), "append")
    out.load("t", spark.createDataFrame([], "id string, name string"), "append")
    assert rows(out.read("t"), "id") == [("1", "a")]
    assert out.vacuum("t") == 1
    assert rows(out.read("t"), "id") == [("1", "a")]


def test_page_source(spark):
    config = {
        "base_url": "https://api.example.com", "resource_defaults": {"max_pages": 3},
        "endpoints": ["a", {"name": "b", "max_pages": 1, "record_schema": "name string"}],
    }
    source = Source("rest_api", "api", config)
    assert [e["max_pages"] for e in pages.endpoints_of(source)[1]] == [3, 1]
    tables = registry.build(spark, source, {"api": {"fetcher": "tests.page_fetcher:fetch"}})
    assert {t: d.count() for t, d in tables.items()} == {"a": 6, "b": 3}
    assert rows(tables["b"], "name") == [("b-0-0",), ("b-0-1",), ("b-0-2",)]
    with pytest.raises(ValueError, match="base_url"):
        pages.endpoints_of(Source("rest_api", "api", {"endpoints": ["a"]}))
    with pytest.raises(ValueError, match="endpoints"):
        pages.endpoints_of(Source("rest_api", "api", {"base_url": "u"}))


def test_registry(spark):
    assert registry.registered_types() == ["filesystem", "pg_cdc", "rest_api", "sql_database"]
    with pytest.raises(KeyError, match="registered"):
        registry.get_builder("ftp")
    assert "files" in registry.describe("filesystem")


NESTED = "id bigint, updated_at timestamp_ntz, who struct<name: string>, tags array<string>, lines array<struct<sku: string, lots: array<int>>>"


def test_nested_rows_become_tables(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spec = orders_spec(source)

    def put(*entries):
        spark.createDataFrame(list(entries), NESTED).coalesce(1).write.mode("append").parquet(str(source))

    put((1, T0, ("a",), ["x", "y"], [("s1", [7, 8]), ("s2", [])]), (2, T0, ("b",), None, []))
    shaped = runner.dry_run(spark, spec)
    assert [r.table_name for r in shaped.orderBy("table_name").collect()] == [
        "orders", "orders__lines", "orders__lines__lots", "orders__tags"
    ]
    runner.run(spark, spec, out)
    landed = target(spark, tmp_path)
    assert landed.read("orders").columns == ["id", "updated_at", "who__name"]
    assert rows(landed.read("orders__tags"), "_pos") == [(1, 0, "x"), (1, 1, "y")]
    assert rows(landed.read("orders__lines"), "_pos") == [(1, 0, "s1"), (1, 1, "s2")]
    assert rows(landed.read("orders__lines__lots"), "_pos2") == [(1, 0, 0, 7), (1, 0, 1, 8)]
    # Row 1 loses a tag and all lines; row 2 gains a tag; an older version must not count.
    put((1, T0 + minutes(2), ("a",), ["z"], None), (1, T0 + minutes(1), ("a",), ["old", "old"], None),
        (2, T0 + minutes(1), ("b",), ["n"], [("s3", [1])]))
    for _ in range(2):
        runner.run(spark, spec, out)
        assert rows(landed.read("orders__tags"), "id") == [(1, 0, "z"), (2, 0, "n")]
        assert rows(landed.read("orders__lines"), "id") == [(2, 0, "s3")]
        assert rows(landed.read("orders__lines__lots"), "id") == [(2, 0, 0, 1)]
        assert landed.read("orders").count() == 2


def test_nested_rows_without_a_key(spark, tmp_path):
    source = tmp_path / "in"
    spec = orders_spec(source, sync={"mode": "full_refresh", "cursor_field": None, "primary_key": None},
                       options={"write_disposition": None})
    data = [(1, T0, ("a",), ["x", "y"], None)]
    spark.createDataFrame(data, NESTED).write.parquet(str(source))
    runner.run(spark, spec, str(tmp_path / "out"))
    landed = target(spark, tmp_path)
    joined = landed.read("orders").join(landed.read("orders__tags"), "_row_id")
    assert rows(joined.select("id", "_pos", "value"), "_pos") == [(1, 0, "x"), (1, 1, "y")]


# -- change data ---------------------------------------------------------------------

LOG = "lsn bigint, tx_id bigint, op string, commit_ts timestamp_ntz, table_name string, id bigint, amount double"


def cdc_spec(check_mode="cross_cluster", **config):
    return PipelineSpec.from_dict(
        {
            "name": "orders_cdc",
            "source": {"type": "pg_cdc", "connection": "pg",
                       "config": {"slot_name": "s", "publication_name": "p", "tables": ["orders"], **config}},
            "sync": {"mode": "cdc", "primary_key": "id"},
            "destination": {"type": "duckdb", "connection": "local", "dataset": "raw_orders_cdc"},
            "quality": {"row_count_check": True, "check_mode": check_mode},
        }
    )


@pytest.fixture
def change_source(spark, tmp_path):
    """A snapshot of two orders, and a function that logs changes."""
    frame(spark, (1, 10.0), (2, 20.0), schema="id bigint, amount double").write.parquet(str(tmp_path / "snap" / "orders"))
    place = {"pg": {"log_path": str(tmp_path / "log"), "snapshot_path": str(tmp_path / "snap")}}

    def log(*entries):
        data = [(n, n // 2, op, T0 + timedelta(seconds=n), t, i, a) for n, op, t, i, a in entries]
        spark.createDataFrame(data, LOG).coalesce(1).write.mode("append").parquet(place["pg"]["log_path"])

    log((1, "I", "other", 1, 0.0))
    return place, log


def state_of(df):
    return rows(df.select("id", "amount", F.col("_deleted_at").isNotNull()), "id")


def test_cdc_batch(spark, tmp_path, change_source):
    place, log = change_source
    out = str(tmp_path / "out")
    runner.run(spark, cdc_spec(), out, place)
    target = Dataset(spark, out, "raw_orders_cdc")
    assert state_of(target.read("orders")) == [(1, 10.0, False), (2, 20.0, False)]
    log((3, "I", "orders", 3, 30.0), (4, "U", "orders", 1, 111.0), (5, "D", "orders", 2, None))
    runner.run(spark, cdc_spec(), out, place)
    expected = [(1, 111.0, False), (2, None, True), (3, 30.0, False)]
    assert state_of(target.read("orders")) == expected
    assert target.cursor("orders") == "5"
    assert runner.run(spark, cdc_spec(), out, place).first().n_rows == 0
    assert state_of(target.read("orders")) == expected
    assert target.read("orders", live_only=True).count() == 2


def test_cdc_shadow_read_and_reset(spark, tmp_path, change_source):
    place, log = change_source
    out = str(tmp_path / "out")
    runner.run(spark, cdc_spec(), out, place)
    target = Dataset(spark, out, "raw_orders_cdc")
    before = target.cursor("orders")
    log((3, "U", "orders", 1, 11.0))
    runner.run(spark, cdc_spec(flush_slot=False), out, place)
    assert target.cursor("orders") == before
    assert state_of(target.read("orders"))[0] == (1, 11.0, False)
    runner.run(spark, cdc_spec(reset=True), out, place)
    assert state_of(target.read("orders")) == [(1, 11.0, False), (2, 20.0, False)]


def test_cdc_columns_and_kinds(spark, tmp_path, change_source):
    place, log = change_source
    log((3, "U", "orders", 1, 11.0), (4, "D", "orders", 2, None))
    spec = cdc_spec(publish="insert, update", columns={"orders": {"amount": {"data_type": "decimal(12,2)"}}})
    with pytest.raises(ValueError, match="row count mismatch for orders: source=1 destination=2"):
        runner.run(spark, spec, str(tmp_path / "out"), place)
    with pytest.raises(ValueError, match="row count mismatch for orders$"):
        same = cdc_spec("same_cluster", publish="insert, update")
        runner.run(spark, same, str(tmp_path / "same"), place)
    landed = Dataset(spark, str(tmp_path / "out"), "raw_orders_cdc").read("orders")
    assert dict(landed.dtypes)["amount"] == "decimal(12,2)"
    assert landed.count() == 2


@pytest.mark.parametrize("delete_mode", ["soft", "hard"])
def test_cdc_stream(spark, tmp_path, change_source, delete_mode):
    place, log = change_source
    log((3, "I", "orders", 3, 30.0), (4, "U", "orders", 1, 111.0))
    log((5, "D", "orders", 2, 20.0), (6, "U", "other", 1, 5.0))
    spec = cdc_spec(tables=["orders", "other"])
    config = LogConfig.of(spec.source, {"pg": {"log_path": place["pg"]["log_path"]}})
    out = Dataset(spark, str(tmp_path / "out"), "raw")
    schema = spark.read.parquet(place["pg"]["log_path"]).schema
    out.load("orders", spark.createDataFrame([(1, 10.0, 0, None), (2, 20.0, 0, None)],
             "id bigint, amount double, _lsn bigint, _deleted_at timestamp_ntz"), "merge", key="id")
    for _ in range(2):
        sync_changes(
            spark, place["pg"]["log_path"], schema, out, config, ["id"], str(tmp_path / "cp"),
            files_per_batch=1, delete_mode=delete_mode,
        )
        live = [r[:2] for r in state_of(out.read("orders", live_only=True))]
        assert live == [(1, 111.0), (3, 30.0)]
        assert state_of(out.read("other")) == [(1, 5.0, False)]
    gone = [r for r in state_of(out.read("orders")) if r[2]]
    assert gone == [(2, 20.0 if delete_mode == "soft" else None, True)]
    log((7, "I", "orders", 2, 22.0))
    sync_changes(spark, place["pg"]["log_path"], schema, out, config, ["id"], str(tmp_path / "cp"), delete_mode=delete_mode)
    assert state_of(out.read("orders", live_only=True))[1] == (2, 22.0, False)


def test_downstream_stream_sees_loads(spark, tmp_path):
    out = Dataset(spark, str(tmp_path / "out"), "raw")
    out.load("t", frame(spark, (1, "a")), "append")
    stream = new_loads(spark, out, out.loads().schema)
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "seen"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert [r.table_name for r in spark.read.parquet(str(tmp_path / "seen")).collect()] == ["t"]


# -- fleet, removal, alerts ----------------------------------------------------------


def test_fleet_isolates_failures(spark, tmp_path):
    add_orders(spark, tmp_path / "in", (1, 1.0, minutes(0)))

    def raw(name, folder, **extra):
        return {
            "name": name,
            "source": {"type": "filesystem", "connection": "orders",
                       "config": {"bucket_url": str(folder), "file_glob": "*.parquet"}},
            "sync": {"mode": "full_refresh"},
            "destination": {"type": "duckdb", "connection": "local", "dataset": "raw_fleet"},
            **extra,
        }

    specs = [raw("good", tmp_path / "in"), raw("absent", tmp_path / "nowhere"), raw("bad", tmp_path, colour=1)]
    status = runner.run_fleet(spark, specs, str(tmp_path / "out"))
    assert rows(status.select("pipeline", "status"), "pipeline") == [("absent", "failed"), ("bad", "failed"), ("good", "ok")]
    loads = Dataset(spark, str(tmp_path / "out"), "raw_fleet").loads()
    assert rows(loads.select("pipeline", "status"), "pipeline") == [("absent", "failed"), ("good", "ok")]
    assert alerting.failure_summaries(loads).count() == 1


def test_delete(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spec = orders_spec(source)
    add_orders(spark, source, (1, 10.0, minutes(0)))
    runner.run(spark, spec, out)
    report = runner.delete_pipeline(spark, spec, out, keep_data=True)
    assert report["status"] == "ok"
    assert "drop_destination_dataset" not in [s["step"] for s in report["steps"]]
    kept = target(spark, tmp_path)
    assert kept.read("orders").count() == 1 and kept.cursor("orders") is None
    for _ in range(2):
        assert runner.delete_pipeline(spark, spec, out)["status"] == "ok"
    with pytest.raises(LookupError):
        target(spark, tmp_path).read("orders")


def test_unused_destination(spark, tmp_path):
    spec = orders_spec(tmp_path, destination={"type": "databricks"})
    with pytest.raises(NotImplementedError):
        runner.run(spark, spec, str(tmp_path))


def test_schema_change_alerts_once(spark, tmp_path):
    spec = orders_spec(tmp_path, alerts={"slack_channel": "#data"}, sync={"sla_minutes": 60})
    out = Dataset(spark, str(tmp_path / "out"), "raw")
    out.load("t", frame(spark, (1, "a")), "merge", key="id", pipeline=spec.name)
    for column in ("email", "phone"):
        out.load("t", frame(spark, (1, "a")).withColumn(column, F.lit("x")), "merge", key="id", pipeline=spec.name)
    alerts = alerting.pipeline_alerts(out.loads(), spec, {})
    assert rows(alerts.select("kind", "severity", "channel", "deduped"), "ts") == [
        ("schema", "info", "#data", False), ("schema", "info", "#data", True)
    ]
    report = alerting.schema_report(out.loads()).first()
    assert [json.loads(line)["new_columns"] for line in report.summary.split("\n")] == [["email"], ["phone"]]
