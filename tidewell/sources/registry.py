"""Source types by name. A builder turns a spec's source block into lazy tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewell.spec import Source

# Connection name -> options (url, user, path, ...); secrets stay out of specs.
Connections = Mapping[str, Mapping[str, Any]]
Builder = Callable[[SparkSession, Source, Connections], dict[str, DataFrame]]

_builders: dict[str, Builder] = {}


def register(name: str) -> Callable[[Builder], Builder]:
    """Add a source type, also from outside this package; a second one of a name is an error."""

    def add(builder: Builder) -> Builder:
        if _builders.get(name, builder) is not builder:
            raise ValueError(f"source type {name!r} is already registered")
        _builders[name] = builder
        return builder

    return add


def registered_types() -> list[str]:
    _load_builtin()
    return sorted(_builders)


def get_builder(name: str) -> Builder:
    _load_builtin()
    if name not in _builders:
        raise KeyError(f"unknown source type {name!r}; registered: {registered_types()}")
    return _builders[name]


def describe(name: str) -> str:
    """The first line of a builder's documentation."""
    return (get_builder(name).__doc__ or "").strip().split("\n")[0]


def build(spark: SparkSession, source: Source, connections: Connections) -> dict[str, DataFrame]:
    return get_builder(source.type)(spark, source, connections)


def check_keys(source: Source, allowed: frozenset[str], required: tuple[str, ...] = ()) -> None:
    """Unknown or missing config keys are errors that name the source."""
    label = f"{source.type} source {source.connection!r}"
    unknown = sorted(set(source.config) - allowed)
    if unknown:
        raise ValueError(f"{label} does not take {unknown}, only {sorted(allowed)}")
    for key in required:
        if not source.config.get(key):
            raise ValueError(f"{label} needs config.{key}")


def _load_builtin() -> None:
    from tidewell.sources import changelog, files, jdbc, pages  # noqa: F401
