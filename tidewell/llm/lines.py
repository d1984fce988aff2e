"""Repeated lines or paragraphs: hash the units, keep each digest's earliest occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import join_by_key, stage

LINE, PARAGRAPH = "\n", "\n\n"
# Characters per batch that goes back to Spark.
BATCH_CHARS = 4_000_000


def _normal(unit: Column) -> Column:
    """Lower case, runs of ASCII white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(unit), r"[\x20\x09-\x0D]+", " "))


def without(text: str, gone: list[int], separator: str) -> tuple[str, int, int, list[tuple[int, int, int]]]:
    """(what stays, units, removed bytes, removed (unit, start, length)) of a text whose units of
    these numbers go; one pass, however many units there are."""
    parts, leaving, start = text.split(separator), set(gone), 0
    kept, removed, n_bytes = [], [], 0
    for unit, part in enumerate(parts):
        if unit in leaving:
            removed.append((unit, start, len(part)))
            n_bytes += len(part.encode("utf-8", "surrogateescape"))
        else:
            kept.append(part)
        start += len(part) + len(separator)
    return separator.join(kept), len(parts), n_bytes, removed


def repeated_units(
    docs: DataFrame,
    separator: str = LINE,
    min_words: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Remove every line (or paragraph) that occurred earlier in the table.

    Units are what ``separator`` separates. They are compared by the SHA-256 of their normal form.
    Units whose normal form is empty stay; with ``min_words`` above 1 so do shorter ones than that,
    counted by white space. Earlier means a smaller id (null ids last), or the same id and an
    earlier unit. Rows that share an id also share its rank: the same unit at the same place is
    removed from neither.

    Returns per row: doc_id, text (units that stay, joined again), n_units, n_removed (UTF-8 bytes
    of the units removed), removed_units, and removed (ordered structs of unit, start and length in
    characters of the original text). A null text has no units and stays null; an empty one has
    one empty unit. No rows give no rows. Work and memory of a text are linear in its length.
    """
    text = F.col(text_column)
    keyed = docs.select(
        F.col(id_column).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark")
    )
    kind = keyed.schema["doc_id"].dataType.simpleString()
    exploded = keyed.select(
        "doc_id", "mark", F.posexplode(F.split(F.col("text"), separator, -1)).alias("unit", "part")
    ).withColumn("normal", _normal(F.col("part")))
    counted = F.col("normal") != ""
    if min_words > 1:
        counted &= F.size(F.split("normal", " ")) >= min_words
    units = stage(
        exploded.filter(counted).select("doc_id", "mark", "unit", F.unhex(F.sha2("normal", 256)).alias("digest")),
        "lines-units",
    )
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "unit")
    totals = units.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    again = totals.filter("n > 1")
    found = join_by_key(units, again, "digest", "n", units.count()).filter(rank > F.col("first"))
    gone = found.groupBy("doc_id", "mark").agg(F.collect_set("unit").alias("gone"))
    met = keyed.join(
        gone.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "gone"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")),
        "left",
    ).select("doc_id", F.col("text").cast("binary").alias("text"), "gone")
    span = pa.struct([("unit", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(span)]
    names = ["text", "n_units", "n_removed", "removed_units", "removed"]

    def cut(raw: bytes | None, gone: list[int] | None) -> tuple:
        if raw is None:
            return None, 0, 0, 0, []
        if not gone:
            return raw, raw.count(separator.encode()) + 1, 0, 0, []
        text, n, n_bytes, removed = without(raw.decode("utf-8", "surrogateescape"), gone, separator)
        spans = [{"unit": u, "start": s, "length": m} for u, s, m in removed]
        return text.encode("utf-8", "surrogateescape"), n, n_bytes, len(spans), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, rows = 0, 0, []
            for k in range(batch.num_rows):
                raw = batch.column(1)[k].as_py()
                rows.append(cut(raw, batch.column(2)[k].as_py()))
                held += len(raw or b"")
                if held >= BATCH_CHARS or k == batch.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    ids = batch.column(0).slice(first, k + 1 - first)
                    yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *names])
                    first, held, rows = k + 1, 0, []

    done = met.mapInArrow(
        run,
        f"doc_id {kind}, text binary, n_units long, n_removed long, removed_units long, "
        "removed array<struct<unit: int, start: long, length: long>>",
    )
    return done.withColumn("text", F.col("text").cast("string"))
