"""Paged JSON: tables of response payloads, and a partitioned reader that fetches them.

No HTTP client lives here. A fetcher is a function ``(endpoint, page_no) -> JSON text or
None``, named as ``module:function``; Spark calls it once per endpoint and page, in parallel.
"""

from __future__ import annotations

import importlib
import json
import sys
from collections.abc import Iterable, Iterator, Mapping
from itertools import count
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan

from tidewell.operators.normalize import infer_json_type, limit_pages, records_of_pages
from tidewell.session import new_scratch
from tidewell.sources.registry import Connections, register
from tidewell.spec import Source

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
PAGE_COLUMNS = "endpoint string, page_no bigint, payload string"


def endpoints_of(source: Source) -> tuple[str, list[dict[str, Any]]]:
    """Base URL and endpoint settings; ``resource_defaults`` fill what an endpoint leaves out."""
    config, label = source.config, f"rest_api source {source.connection!r}"
    base_url = (config.get("client") or {}).get("base_url") or config.get("base_url")
    if not base_url:
        raise ValueError(f"{label} needs config.base_url or config.client.base_url")
    listed = config.get("resources")
    if listed is None:
        listed = config.get("endpoints")
    if not listed:
        raise ValueError(f"{label} needs config.endpoints or config.resources")
    defaults: Mapping[str, Any] = config.get("resource_defaults") or {}
    named = [{"name": item} if isinstance(item, str) else dict(item) for item in listed]
    return base_url, [{**defaults, **item} for item in named]


class PagePartition(InputPartition):
    def __init__(self, endpoint: str, page_no: int | None) -> None:
        self.endpoint = endpoint
        self.page_no = page_no


class PageReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.fetcher = options["fetcher"]
        self.pages = json.loads(options["pages"])

        self.wanted: set[str] | None = None
        self.below: int | None = None

    def take(self, filters: list[Filter]) -> Iterable[Filter]:
        """Endpoints and upper page bounds decide what is fetched; all other filters come back."""
        for given in filters:
            if isinstance(given, (EqualTo, In)) and given.attribute == ("endpoint",):
                names = {given.value} if isinstance(given, EqualTo) else set(given.value)
                self.wanted = names if self.wanted is None else self.wanted & names
            elif isinstance(given, LessThan) and given.attribute == ("page_no",):
                self.below = given.value if self.below is None else min(self.below, given.value)
            else:
                yield given

    def partitions(self) -> list[PagePartition]:
        found = []
        for endpoint, known in self.pages.items():
            if self.wanted is not None and endpoint not in self.wanted:
                continue
            if self.below is not None:
                known = max(0, self.below if known is None else min(known, self.below))
            found += [PagePartition(endpoint, n) for n in ([None] if known is None else range(known))]
        return found

    def read(self, partition: PagePartition) -> Iterator[tuple[str, int, str]]:
        module, _, name = self.fetcher.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        wanted = count() if partition.page_no is None else [partition.page_no]
        for page_no in wanted:
            payload = fetch(partition.endpoint, page_no)
            if payload is None:
                return
            yield partition.endpoint, page_no, payload


class FilteredPageReader(PageReader):
    """For sessions that push filters to Python data sources; Spark refuses it in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return self.take(filters)


class PageSource(DataSource):
    """``spark.read.format("paged_json")``: one task per endpoint and page, or one per endpoint
    that reads on until a page is missing, where the number of pages is not known."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return PAGE_COLUMNS

    def reader(self, schema: Any) -> PageReader:
        pushing = self.options.get("push", "false") == "true"
        return FilteredPageReader(self.options) if pushing else PageReader(self.options)


def fetch_pages(spark: SparkSession, fetcher: str, pages: Mapping[str, int | None]) -> DataFrame:
    """Payload rows of the first ``pages[endpoint]`` pages of every endpoint; None: of all.

    Filters on endpoint and page number reach the reader where the session pushes filters to
    Python data sources (``PUSHDOWN``); elsewhere Spark applies them to what was fetched."""
    spark.dataSource.register(PageSource)
    return (
        spark.read.format("paged_json")
        .option("fetcher", fetcher).option("pages", json.dumps(dict(pages)))
        .option("push", spark.conf.get(PUSHDOWN, "false")).load()
    )


def staged_pages(pages: DataFrame) -> DataFrame:
    """Payloads in a shared folder, an endpoint's in one of its own, which its readers alone read."""
    folder = new_scratch(pages.sparkSession, "pages")
    pages.write.partitionBy("endpoint").parquet(folder)
    return pages.sparkSession.read.schema(PAGE_COLUMNS).parquet(folder)


@register("rest_api")
def build(spark: SparkSession, source: Source, connections: Connections) -> dict[str, DataFrame]:
    """Records per endpoint, from stored page payloads or from a fetcher.

    ``record_schema`` saves the aggregate that otherwise infers the records' type. A page that is
    no JSON stops the load with its endpoint and number, unless the endpoint says
    ``on_unreadable: skip``; ``page_report`` counts them."""
    _, endpoints = endpoints_of(source)
    place = connections.get(source.connection) or {}
    if "pages_path" in place:
        pages = spark.read.schema(PAGE_COLUMNS).parquet(place["pages_path"])
    elif "fetcher" in place:
        counts = {
            e["name"]: None if e.get("max_pages") is None else int(e["max_pages"]) for e in endpoints
        }
        # Fetched once, before anything is inferred or loaded: an API may answer differently, and
        # each answer has its price.
        pages = staged_pages(fetch_pages(spark, place["fetcher"], counts))
    else:
        raise ValueError(
            f"rest_api source {source.connection!r}: pass connections entry "
            f"{source.connection!r} with pages_path or fetcher"
        )
    tables = {}
    for endpoint in endpoints:
        mine = pages.filter(pages.endpoint == endpoint["name"])
        if endpoint.get("limit_pages") is not None:
            mine = limit_pages(mine, int(endpoint["limit_pages"]))
        records = endpoint.get("data_selector", "results")
        if "record_schema" in endpoint:
            shape = f"{records} ARRAY<STRUCT<{endpoint['record_schema']}>>"
        else:
            shape = infer_json_type(mine, "payload")
        strict = endpoint.get("on_unreadable", "fail") != "skip"
        tables[endpoint["name"]] = records_of_pages(mine, shape, records, carry=(), strict=strict)
    return tables
