import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators import backfill, changes, contracts, incremental, merge, normalize, quality

T0 = datetime(2025, 1, 1)


def rows(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]


# -- cursors -------------------------------------------------------------------------


def test_lag_adds_up():
    assert incremental.lag_seconds(10, "PT1M") == 70
    assert incremental.lag_seconds() is None
    with pytest.raises(ValueError, match="no fixed length"):
        incremental.lag_seconds(0, "P1M")


def test_incremental_filter_types(spark):
    ids = spark.range(10)
    assert incremental.incremental_filter(ids, "id", None).count() == 10
    assert incremental.incremental_filter(ids, "id", "7").count() == 3
    assert incremental.incremental_filter(ids, "id", "7", lag=2).count() == 5
    stamps = spark.createDataFrame([(T0 + timedelta(seconds=i),) for i in range(10)], "ts timestamp_ntz")
    assert incremental.incremental_filter(stamps, "ts", "2025-01-01 00:00:05").count() == 5
    assert incremental.incremental_filter(stamps, "ts", "2025-01-01 00:00:05", lag=3).count() == 8


def test_cursor_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).withColumn("ts", F.lit(T0).cast("timestamp_ntz")).write.parquet(path)
    df = incremental.incremental_filter(spark.read.parquet(path), "ts", "2025-01-01 00:00:00", 60)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan


def test_bounded_range_is_half_open_in_utc(spark):
    stamps = spark.createDataFrame([(T0 + timedelta(days=i),) for i in range(4)], "ts timestamp_ntz")
    east = timezone(timedelta(hours=2))
    start = datetime(2025, 1, 2, 2, tzinfo=east)
    end = datetime(2025, 1, 3, 2, tzinfo=east)
    assert rows(incremental.bounded_range(stamps, "ts", start, end), "ts") == [(T0 + timedelta(days=1),)]


def test_missing_cursor_names_the_table(spark):
    with pytest.raises(ValueError, match="'updated_at' is missing on b"):
        incremental.check_cursor({"a": spark.range(1).withColumn("updated_at", F.lit(1)), "b": spark.range(1)}, "updated_at")


# -- merge ---------------------------------------------------------------------------


def test_merge_is_idempotent_and_order_free(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    delta = [(2, 1, "x"), (2, 2, "y"), (3, 1, "z")]
    for _ in range(3):
        random.shuffle(delta)
        d = merge.dedup_latest(spark.createDataFrame(delta, "id int, n int, v string"), "id", ["n"]).drop("n")
        once = merge.merge_upsert(base, d, "id")
        assert rows(once, "id") == [(1, "a"), (2, "y"), (3, "z")]
        assert rows(merge.merge_upsert(once, d, "id", small_delta=True), "id") == rows(once, "id")


def test_dedup_prunes_before_the_shuffle(spark):
    df = merge.dedup_latest(spark.range(10).withColumn("k", F.col("id") % 2), "k", ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# -- backfill ------------------------------------------------------------------------


def test_chunk_bounds():
    chunks = backfill.chunk_bounds(T0, T0 + timedelta(days=30), "P7D")
    assert len(chunks) == 5
    assert chunks[-1] == (T0 + timedelta(days=28), T0 + timedelta(days=30))
    with pytest.raises(ValueError, match="must precede"):
        backfill.chunk_bounds(T0, T0, "P7D")
    with pytest.raises(ValueError, match="longer than zero"):
        backfill.chunk_bounds(T0, T0 + timedelta(days=1), "PT0S")
    months = backfill.chunk_bounds(datetime(2024, 1, 31), datetime(2024, 5, 1), "P1M")
    assert [c[0].day for c in months] == [31, 29, 31, 30]


@pytest.mark.parametrize("size", ["P7D", "PT0.3S", "P1M", "PT13H"])
def test_chunk_ids_agree_with_bounds(spark, size):
    start, end = datetime(2024, 1, 31), datetime(2024, 1, 31, 0, 0, 40) if size == "PT0.3S" else datetime(2024, 5, 1)
    chunks = backfill.chunk_bounds(start, end, size)
    points = {b + timedelta(microseconds=d) for c in chunks for b in c for d in (-1, 0, 1)}
    df = spark.createDataFrame([(p,) for p in points], "ts timestamp_ntz")
    ids = df.select("ts", backfill.chunk_id(F.col("ts"), T.TimestampNTZType(), start, end, size).alias("i"))
    for ts, number in ids.collect():
        expected = [i for i, (a, b) in enumerate(chunks) if a <= ts < b]
        assert ([number] if number is not None else []) == expected


# -- changes -------------------------------------------------------------------------

LOG = "lsn bigint, op string, commit_ts timestamp_ntz, id bigint, amount double"


def log(spark, *entries):
    return spark.createDataFrame([(n, op, T0, i, a) for n, op, i, a in entries], LOG)


@pytest.mark.parametrize("small", [False, True])
def test_changes_are_idempotent(spark, small):
    base = changes.latest_changes(log(spark, (0, "S", 1, 10.0), (0, "S", 2, 20.0)), "id")
    first = changes.latest_changes(log(spark, (5, "I", 3, 30.0), (6, "U", 1, 111.0), (7, "D", 2, None)), "id")
    once = changes.apply_changes(base, first, "id", small)
    expected = [(1, 111.0, 6, False), (2, None, 7, True), (3, 30.0, 5, False)]

    def state(df):
        return rows(df.select("id", "amount", "_lsn", F.col("_deleted_at").isNotNull()), "id")

    assert state(once) == expected
    assert state(changes.apply_changes(once, first, "id", small)) == expected
    older = changes.latest_changes(log(spark, (4, "I", 2, 1.0), (3, "U", 1, 2.0)), "id")
    assert state(changes.apply_changes(once, older, "id", small)) == expected
    assert [r[0] for r in state(changes.live_rows(once))] == [1, 3]


def test_erased_rows_stay_erased(spark):
    base = changes.latest_changes(log(spark, (0, "S", 2, 20.0)), "id")
    gone = changes.erase_deleted(changes.latest_changes(log(spark, (7, "D", 2, 20.0)), "id"), "id")
    once = changes.apply_changes(base, gone, "id")
    assert rows(once.select("id", "amount"), "id") == [(2, None)]
    older = changes.latest_changes(log(spark, (3, "I", 2, 5.0)), "id")
    assert changes.live_rows(changes.apply_changes(once, older, "id")).count() == 0


def test_publish_names():
    assert changes.published_codes() == ["I", "U", "D"]
    with pytest.raises(ValueError, match="publish must name"):
        changes.published_codes("insert, truncate")


def test_tx_batches_never_split(spark):
    rng = random.Random(3)
    entries, lsn = [], 0
    for tx in range(200):
        for _ in range(rng.choice([1, 2, 50])):
            lsn += rng.randrange(1, 40)
            entries.append((lsn, tx))
    df = spark.createDataFrame(entries, "lsn bigint, tx_id bigint")
    got = {r.tx_id: r.batch_id for r in changes.tx_batches(df, 60, slice_width=64).collect()}
    total, expected = 0, {}
    for tx in range(200):
        expected[tx] = total // 60
        total += sum(1 for _, t in entries if t == tx)
    assert got == expected


def test_missing_slot_is_an_error(spark):
    slots = spark.createDataFrame([("a",), ("b",)], "slot_name string")
    seen = spark.createDataFrame([("a", 100, 36)], "slot_name string, current_lsn bigint, confirmed_lsn bigint")
    lags = changes.replication_lag(slots, seen, max_lag=64)
    assert rows(lags, "slot_name") == [("a", True, 64, True), ("b", False, None, False)]
    with pytest.raises(LookupError, match="b"):
        changes.check_slots(lags)


# -- contracts -----------------------------------------------------------------------


def test_contract_modes(spark):
    known = T._parse_datatype_string("id bigint, n int")
    wider = spark.createDataFrame([(1, 2**40, None), (2, 5, "x"), (3, 6, None)], "id bigint, n bigint, note string")
    with pytest.raises(contracts.ContractViolation, match="note.*n int -> bigint"):
        contracts.contract_freeze(known, wider)
    accepted, rejected = contracts.contract_discard_row(known, wider)
    assert rows(accepted, "id") == [(3, 6)]
    assert rejected.count() == 2
    old = spark.createDataFrame([(9, 9)], known)
    both = contracts.contract_evolve(old, wider)
    assert both.dtypes == [("id", "bigint"), ("n", "bigint"), ("note", "string")]
    assert rows(both, "id")[-1] == (9, 9, None)


@pytest.mark.parametrize(
    ("left", "right", "expected"),
    [
        ("int", "bigint", "bigint"), ("int", "double", "double"), ("bigint", "string", "string"),
        ("decimal(10,2)", "int", "decimal(21,2)"), ("decimal(10,2)", "decimal(12,4)", "decimal(12,4)"),
        ("date", "timestamp_ntz", "timestamp_ntz"), ("boolean", "int", "string"),
    ],
)
def test_common_types(spark, left, right, expected):
    kinds = [T._parse_datatype_string(t) for t in (left, right, expected)]
    assert contracts.common_type(kinds[0], kinds[1]) == kinds[2]
    assert contracts.common_type(kinds[1], kinds[0]) == kinds[2]


def test_schema_updates_count_once(spark):
    updates = spark.createDataFrame(
        [("p", 1, "extract", "t", ["b", "a"]), ("p", 2, "load", "t", ["a", "b"]), ("p", 3, "load", "t", ["c"])],
        "pipeline string, step_no bigint, step string, table_name string, new_columns array<string>",
    )
    deduped = contracts.schema_update_dedup(updates)
    assert rows(deduped.select("step", "new_columns"), "step_no") == [("extract", ["a", "b"]), ("load", ["c"])]
    report = contracts.schema_update_report(deduped, shown=1).first()
    assert report.n_updates == 2
    assert report.summary == '{"new_columns": ["a", "b"], "step": "extract", "table": "t"}\n… (+1 more)'


# -- nested data ---------------------------------------------------------------------


def test_pages(spark):
    payloads = [
        ("e", 0, '{"count": 2, "next": null, "results": [{"name": "a", "url": "u"}, {"name": "b"}]}'),
        ("e", 1, '{"results": []}'), ("e", 2, "broken"),
        ("e", 3, '{"results": [{"name": "c", "url": "v"}]}'),
    ]
    pages = spark.createDataFrame(payloads, "endpoint string, page_no bigint, payload string")
    shape = normalize.infer_json_type(pages, "payload")
    records = normalize.records_of_pages(pages, shape)
    assert rows(records.select("page_no", "name", "url"), "name") == [(0, "a", "u"), (0, "b", None), (3, "c", "v")]
    assert normalize.records_of_pages(normalize.limit_pages(pages, 1), shape).count() == 2


def test_inferred_fractions_are_double(spark):
    pages = spark.createDataFrame([('{"results": [{"a": 1.50, "b": 2, "c": [0.1]}]}',)], "payload string")
    inferred = normalize.infer_json_type(pages, "payload").simpleString()
    assert inferred == "struct<results:array<struct<a:double,b:bigint,c:array<double>>>>"


def test_flatten_and_children(spark):
    nested = spark.createDataFrame(
        [(1, {"a": {"x y": 1}, "b": "t"}, [{"q": {"r": 5}}, {"q": {"r": 6}}], ["s"])],
        "id int, o struct<a: struct<`x y`: int>, b: string>, l array<struct<q: struct<r: int>>>, s array<string>",
    )
    assert normalize.flatten_struct(nested).columns == ["id", "o__a__x y", "o__b", "l", "s"]
    assert rows(normalize.child_table(nested, ["id"], "l"), "_pos") == [(1, 0, 5), (1, 1, 6)]
    assert rows(normalize.child_table(nested, ["id"], "s"), "_pos") == [(1, 0, "s")]


# -- quality -------------------------------------------------------------------------


def test_counts(spark):
    good, bad = spark.range(3), spark.range(2)
    flagged = good.withColumn("_deleted_at", F.when(F.col("id") == 0, F.lit(T0)))
    assert rows(quality.reconcile_counts({"t": bad}, {"t": flagged}), "table_name") == [("t", 2, 2, True)]
    unequal = quality.reconcile_counts({"t": bad}, {"t": flagged}, flagged=True)
    with pytest.raises(ValueError, match="row count mismatch for t: source=2 destination=3"):
        quality.check_counts(unequal)


def test_stale_components(spark):
    parts = spark.createDataFrame([("a",), ("b",), ("c",)], "component string")
    now = T0 + timedelta(seconds=120)
    beats = spark.createDataFrame(
        [("a", T0 + timedelta(seconds=60)), ("b", T0), ("b", T0 + timedelta(seconds=59))],
        "component string, ts timestamp_ntz",
    )
    stale = quality.stale_components(parts, beats, now, 60)
    assert rows(stale, "component") == [("b", "2025-01-01 00:00:59"), ("c", "never")]
