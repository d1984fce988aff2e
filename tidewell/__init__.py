"""Declarative table replication on Spark: read, filter, merge, apply changes, audit."""

from tidewell.spec import PipelineSpec, SpecError

__all__ = ["PipelineSpec", "SpecError"]
