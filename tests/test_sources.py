"""Pages that are fetched once, CSV files of differing headers, and types that lose nothing."""

from __future__ import annotations

from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators import contracts, normalize
from tidewell.sources import files, pages, registry
from tidewell.spec import Source


def build_pages(spark, names, **endpoint):
    listed = [{"name": n, **endpoint} for n in names]
    source = Source("rest_api", "api", {"base_url": "https://api.example.com", "endpoints": listed})
    return registry.build(spark, source, {"api": {"fetcher": "tests.page_fetcher:counted"}})


def calls(folder):
    return Counter(p.name.rsplit("-", 2)[0] for p in folder.glob("*.call"))


def test_every_page_is_fetched_once(spark, tmp_path):
    tables = build_pages(spark, [f"{tmp_path}/{n}" for n in "abc"])
    assert len(tables) == 3
    for df in tables.values():
        assert df.count() == 12 and df.columns == ["name"] and df.distinct().count() == 12
    # three pages of each endpoint, and the call that finds no more
    assert calls(tmp_path) == {"a": 4, "b": 4, "c": 4}


def test_known_page_counts_need_no_last_call(spark, tmp_path):
    tables = build_pages(spark, [f"{tmp_path}/a"], max_pages=2)
    assert sum(df.count() for df in tables.values()) == 8 and calls(tmp_path) == {"a": 2}


def test_unreadable_pages_stop_the_load_or_are_counted(spark, tmp_path):
    schema = "name string"
    cut = build_pages(spark, [f"{tmp_path}/cut"], record_schema=schema)
    with pytest.raises(Exception, match="page is no JSON: .*cut 1"):
        next(iter(cut.values())).collect()
    kept = build_pages(spark, [f"{tmp_path}/cut"], record_schema=schema, on_unreadable="skip")
    assert next(iter(kept.values())).count() == 8
    rows = [("e", 0, '{"results": [{"name": "x"}]}'), ("e", 1, "{"), ("e", 2, None), ("e", 3, "{}"), ("f", 0, '{"results": []}')]
    report = normalize.page_report(spark.createDataFrame(rows, pages.PAGE_COLUMNS), "results array<struct<name string>>")
    assert {tuple(r) for r in report.collect()} == {("e", 4, 2, 1, 1), ("f", 1, 0, 1, 0)}


def test_filters_reach_the_page_reader(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

    reader = pages.FilteredPageReader({"fetcher": "x:y", "pages": '{"a": 3, "b": null, "c": 2}'})
    kept = list(reader.pushFilters([In(("endpoint",), ("a", "b")), LessThan(("page_no",), 2), GreaterThan(("page_no",), 0)]))
    assert [type(f) for f in kept] == [GreaterThan]
    assert [(p.endpoint, p.page_no) for p in reader.partitions()] == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    assert list(reader.pushFilters([EqualTo(("endpoint",), "b")])) == []
    assert {p.endpoint for p in reader.partitions()} == {"b"}


def test_pushed_endpoint_filter_fetches_only_that(spark, tmp_path):
    spark.conf.set(pages.PUSHDOWN, "true")
    try:
        found = pages.fetch_pages(spark, "tests.page_fetcher:counted", {f"{tmp_path}/{n}": None for n in "ab"})
        assert found.filter(F.col("endpoint") == f"{tmp_path}/a").count() == 3
    finally:
        spark.conf.unset(pages.PUSHDOWN)
    assert set(calls(tmp_path)) == {"a"}


def test_csv_files_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,\"y, \"\"z\"\"\"\n")
    (tmp_path / "b.csv").write_text("﻿extra,id,name\n2.5,3,w\n")
    (tmp_path / "c.csv").write_text("name,\"id\"\nlast,4\n")
    (tmp_path / "empty.csv").write_text("")
    schema = "id bigint, name string, extra double"
    got = files.scan_files(spark, str(tmp_path), "csv", "*.csv", schema=schema).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "x", None), (2, 'y, "z"', None), (3, "w", 2.5), (4, "last", None)]
    free = files.scan_files(spark, str(tmp_path), "csv", "*.csv")
    assert {f.name: f.dataType.simpleString() for f in free.schema} == {"id": "bigint", "name": "string", "extra": "double"}
    assert free.count() == 4 and free.filter("extra = 2.5").first()["id"] == 3
    assert len(files.csv_headers(spark, str(tmp_path), "*.csv", {})) == 3


def test_csv_headers_with_line_breaks_and_compression(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.csv.gz", "wt") as out:
        out.write('id;"two\nlines"\n1;x\n')
    (tmp_path / "b.csv").write_text("id;b\n2;y\n")
    found = files.csv_headers(spark, str(tmp_path), "*", {"sep": ";"})
    assert set(found) == {("id", "two\nlines"), ("id", "b")}
    df = files.scan_files(spark, str(tmp_path), "csv", "*", options={"sep": ";", "multiLine": True}, schema="id int, `two\nlines` string, b string")
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x", None), (2, None, "y")]


D = T._parse_datatype_string


@pytest.mark.parametrize(
    ("left", "right", "both"),
    [
        ("int", "double", "double"), ("bigint", "double", "string"), ("decimal(15,0)", "double", "double"),
        ("decimal(10,2)", "double", "string"), ("bigint", "decimal(10,4)", "decimal(23,4)"),
        ("int", "decimal(5,2)", "decimal(21,2)"), ("decimal(38,0)", "decimal(10,4)", "string"),
        ("date", "timestamp", "timestamp"), ("date", "timestamp_ntz", "timestamp_ntz"),
        ("timestamp_ntz", "timestamp", "timestamp"), ("date", "int", "string"), ("boolean", "int", "string"),
        ("array<int>", "array<bigint>", "array<bigint>"), ("array<int>", "int", "string"),
        ("map<string,int>", "map<string,decimal(12,1)>", "map<string,decimal(20,1)>"),
        ("struct<a:int,b:struct<c:date>>", "struct<b:struct<c:timestamp_ntz,d:int>,e:string>",
         "struct<a:int,b:struct<c:timestamp_ntz,d:int>,e:string>"),
        ("void", "array<int>", "array<int>"),
    ],
)
def test_common_types_lose_nothing(left, right, both):
    assert contracts.common_type(D(left), D(right)).simpleString() == D(both).simpleString()
    if "struct" not in left:  # new fields stand behind the known ones
        assert contracts.common_type(D(right), D(left)) == contracts.common_type(D(left), D(right))


def test_values_survive_evolution(spark):
    old = spark.createDataFrame(
        [(1, 2**53 + 1, {"x": 1, "l": [date(2024, 1, 2)]}, [7], Decimal("1.5")), (2, None, None, None, None)],
        "id int, n bigint, s struct<x:int,l:array<date>>, a array<int>, d decimal(3,1)",
    )
    new = spark.createDataFrame(
        [(3, 0.1, {"l": [datetime(2024, 5, 6, 7)], "y": "new", "x": 2**40}, "text", 12345678901)],
        "id bigint, n double, s struct<l:array<timestamp_ntz>,y:string,x:bigint>, a string, d bigint",
    )
    got = {r["id"]: r for r in contracts.contract_evolve(old, new).collect()}
    assert got[1]["n"] == str(2**53 + 1) and got[3]["n"] == "0.1" and got[2]["s"] is None
    assert got[1]["s"].asDict() == {"x": 1, "l": [datetime(2024, 1, 2)], "y": None}
    assert got[3]["s"].asDict() == {"x": 2**40, "l": [datetime(2024, 5, 6, 7)], "y": "new"}
    assert got[1]["a"] == "[7]" and got[3]["a"] == "text" and got[2]["a"] is None
    assert got[1]["d"] == Decimal("1.5") and got[3]["d"] == Decimal(12345678901)


def test_entry_survives_a_missing_library(spark):
    import builtins
    import importlib
    import sys
    from unittest import mock

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ImportError("no such library", name="some_wheel")
        return real(name, *args, **kwargs)

    with mock.patch.object(builtins, "__import__", without):
        entry = importlib.reload(sys.modules.get("__spark_entry__") or importlib.import_module("__spark_entry__"))
    assert "merge_upsert" in entry.queries() and not [n for n in entry.queries() if n.startswith("op")]
    importlib.reload(entry)
