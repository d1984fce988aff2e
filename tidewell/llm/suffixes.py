"""Repeated strings: anchor hashing, in place of prefix doubling over all suffixes.

Every string of LENGTH bytes holds GRAM-byte strings; the one with the least hash is its anchor.
Equal strings have the same anchor, and an anchor stands for a run of neighbouring strings, about
39 of them, so only anchors are compared at first:

1. Anchors are sorted by the hash of their GRAM bytes. Those that occur once are dropped, with all
   strings they stand for.
2. The others are sorted again by a hash of all the bytes of their run. Runs that are equal as a whole hold
   the same strings, so all but the earliest are repeated throughout and need no more work.
3. What is left differs somewhere in its run. These runs are expanded into their strings, which are
   grouped within their bucket by the hashes of their two halves (HALF bytes each).

Sorting is by buckets of the hash, which Spark deals out; entries travel as packed columns.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import partitions, stage
from tidewell.llm.hashing import Spans, mix, pack, tidied, tidy, unpack

LENGTH, GRAM = 100, 24
HALF = LENGTH // 2
CHUNK = 1 << 18  # bytes hashed at a time, in some 20 arrays of eight times that; anchors() needs less than 1 << 24
FLUSH = 300_000  # entries a task holds before it sends them
SEND = 8 << 20  # text per batch that goes back to Spark
BUCKET_BYTES = 8 << 20  # text per bucket of anchors
NULL_ID = 2**63 - 1
SIDE = (("kind", 1), ("cls", 6), ("run", 6), ("key", 8), ("mark", 4), ("lo", 5), ("hi", 1), ("off", 1))


def anchors(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """Of texts laid end to end: each anchor's text, place, and first and last string start."""
    spans = Spans(buffer)
    hashes = spans.all(GRAM)
    width = LENGTH - GRAM + 1
    low_bits = np.uint64((1 << 24) - 1)
    least = (hashes & ~low_bits) | np.arange(len(hashes), dtype=np.uint64)
    done = 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    text_of = np.repeat(np.arange(len(lengths)), np.maximum(lengths - LENGTH + 1, 0))
    first = np.concatenate([[0], np.cumsum(np.maximum(lengths - LENGTH + 1, 0))])[:-1]
    places = np.arange(len(text_of)) - first[text_of] + starts[text_of]
    chosen = (least[places] & low_bits).astype(np.int64)
    new = np.ones(len(places), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text_of[1:] != text_of[:-1])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(places)]]) - 1 if len(at) else at
    lo, hi, anchor, text = places[at], places[last], chosen[at], text_of[at]
    off = (anchor - lo).astype(np.uint64)
    shape = mix(off * np.uint64(256) + (hi - lo).astype(np.uint64))
    return {
        "text": text,
        "cls": hashes[anchor] if len(at) else hashes[:0],
        "run": spans.at(lo, hi + LENGTH) ^ shape,
        "lo": lo - starts[text],
        "hi": hi - lo,
        "off": off,
    }


def _later(*columns: np.ndarray, ranked: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort by all columns; per sorted row its group by the leading columns, and whether it comes
    strictly after its group's first row in the ``ranked`` last columns."""
    order = np.lexsort(columns[::-1])
    head, tail = columns[:-ranked], columns[-ranked:]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in head], axis=0)
    group = np.cumsum(new) - 1
    lead = order[np.flatnonzero(new)][group] if len(order) else order
    late = np.any([c[order] != c[lead] for c in tail], axis=0)
    return order, late


def _send(entries: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """One row of packed columns per bucket; entries known to be repeated go by their text's id."""
    order, late = _later(*(entries[c] for c in ("cls", "run", "key", "lo")), ranked=2)
    entries = {c: v[order] for c, v in entries.items()}
    entries["kind"] = late.astype(np.uint64)
    spread = np.where(late, mix(entries["key"].astype(np.uint64)), entries["cls"])
    bucket = (spread >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(edges)):
        part = order[edges[b] : edges[b + 1]]
        rows.append({"bucket": int(b)} | {c: pack(entries[c][part], w) for c, w in SIDE})
    return pa.RecordBatch.from_pylist(
        rows, pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c, _ in SIDE)])
    )


def _find(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    held: list[dict[str, np.ndarray]] = []
    count = 0

    def chunk(texts: list[bytes], keys: list[int], marks: list[int], base: int = 0) -> None:
        nonlocal count
        lengths = np.array(list(map(len, texts)), np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        found = anchors(np.frombuffer(b"".join(texts), np.uint8), starts, lengths)
        text = found.pop("text")
        found["key"] = np.array(keys, np.int64)[text]
        found["mark"] = np.array(marks, np.uint64)[text]
        found["lo"] += base
        held.append(found)
        count += len(text)

    def flush() -> pa.RecordBatch:
        nonlocal count
        whole = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        held.clear()
        count = 0
        return _send(whole, buckets)

    for batch in batches:
        texts, keys, marks, size = [], [], [], 0
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = raw.as_py()
            if len(text) < LENGTH:
                continue
            mark = zlib.crc32(text)
            if len(text) > 4 * CHUNK:  # by itself, in pieces that share all but one byte of a string
                for base in range(0, len(text) - LENGTH + 1, CHUNK):
                    chunk([text[base : base + CHUNK + LENGTH - 1]], [key], [mark], base)
                    if count >= FLUSH:
                        yield flush()
                continue
            texts.append(text)
            keys.append(key)
            marks.append(mark)
            size += len(text)
            if size >= CHUNK:
                chunk(texts, keys, marks)
                texts, keys, marks, size = [], [], [], 0
                if count >= FLUSH:
                    yield flush()
        if texts:
            chunk(texts, keys, marks)
    if count:
        yield flush()
    tidy()


def _rank(table: pa.Table) -> pa.Table:
    """Entries whose GRAM bytes occur again: repeated throughout, or to be looked at closer."""
    e = {c: unpack(table.column(c).to_pylist(), w) for c, w in SIDE}
    e["key"] = e["key"].view(np.int64)
    fresh = np.flatnonzero(e["kind"] == 0)
    known = np.flatnonzero(e["kind"] == 1)
    f = {c: v[fresh] for c, v in e.items()}
    order, late = _later(f["cls"], f["run"], f["key"], f["lo"], ranked=2)
    cls, run = f["cls"][order], f["run"][order]
    new_cls = np.ones(len(order), bool)
    new_cls[1:] = cls[1:] != cls[:-1]
    new_run = new_cls.copy()
    new_run[1:] |= run[1:] != run[:-1]
    group = np.cumsum(new_cls) - 1
    runs = np.bincount(group[new_run], minlength=group[-1] + 1 if len(group) else 0)
    # of equal runs the first is enough, as it stands for the earliest of all their strings
    several = (runs[group] > 1) & new_run if len(group) else new_run
    picked = np.concatenate([fresh[order[late]], fresh[order[several]], known])
    whole = np.concatenate([late[late], np.zeros(several.sum(), bool), np.ones(len(known), bool)])
    return pa.table(
        {
            "key": pa.array(e["key"][picked], pa.int64()),
            "mark": pa.array(e["mark"][picked].astype(np.int64), pa.int64()),
            "lo": pa.array(e["lo"][picked].astype(np.int64), pa.int64()),
            "hi": pa.array((e["lo"] + e["hi"])[picked].astype(np.int64), pa.int64()),
            "off": pa.array(e["off"][picked].astype(np.int16), pa.int16()),
            "whole": pa.array(whole),
        }
    )


def _contexts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The bytes of every run that needs a closer look, by its anchor's bytes."""
    kinds = [("bucket", pa.int32()), ("key", pa.int64()), ("mark", pa.int64()), ("lo", pa.int64()), ("bytes", pa.binary())]
    for batch in batches:
        rows: list[tuple] = []
        for key, mark, raw, runs in zip(*(batch.column(k) for k in range(4)), strict=True):
            text, key, mark = raw.as_py(), key.as_py(), mark.as_py()
            for run in runs.as_py():
                if not run["whole"]:
                    at = run["lo"] + run["off"]
                    rows.append(
                        (zlib.crc32(text[at : at + GRAM]) % buckets, key, mark, run["lo"], text[run["lo"] : run["hi"] + LENGTH])
                    )
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
    tidy()


def _expand(table: pa.Table) -> pa.Table:
    """Rank all strings of the runs; return those that occur earlier, as ranges of starts."""
    parts = table.column("bytes").to_pylist()
    lengths = np.array(list(map(len, parts)), np.int64)
    raw = b"".join(parts)
    key = table.column("key").to_numpy()
    lo = table.column("lo").to_numpy()
    spans = Spans(np.frombuffer(raw, np.uint8))
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    n = lengths - LENGTH + 1
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n)])[:-1][row]
    at = starts[row] + place
    # ranks of the first and second halves, then ranks of the pairs
    halves = np.unique(np.concatenate([spans.at(at, at + HALF), spans.at(at + HALF, at + LENGTH)]), return_inverse=True)[1]
    pair = halves[: len(at)].astype(np.uint64) << np.uint64(32) | halves[len(at) :].astype(np.uint64)
    order, late = _later(pair, key[row], lo[row] + place, ranked=2)
    flagged = np.sort(order[late])
    new = np.ones(len(flagged), bool)
    new[1:] = (np.diff(flagged) != 1) | (row[flagged][1:] != row[flagged][:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(flagged)]]) - 1 if len(first) else first
    a, b = flagged[first], flagged[last]
    return pa.table(
        {
            "key": pa.array(key[row[a]], pa.int64()),
            "mark": pa.array(table.column("mark").to_numpy()[row[a]], pa.int64()),
            "lo": pa.array(lo[row[a]] + place[a], pa.int64()),
            "hi": pa.array(lo[row[b]] + place[b], pa.int64()),
        }
    )


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans covered by strings that start in the given ranges, joined where they touch."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        end = hi + LENGTH
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((lo, end))
    return out


def _remove(batches: Iterator[pa.RecordBatch], carry: bool) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out: list[list] = [[], [], [], []]
        first = size = 0
        for k, (raw, whole, part) in enumerate(zip(*(batch.column(c) for c in range(1, 4)), strict=True)):
            text = raw.as_py() or b""
            spans = _merge([(r["lo"], r["hi"]) for r in (*(whole.as_py() or ()), *(part.as_py() or ()))])
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out[0].append(hashlib.sha256(kept).hexdigest())
            out[1].append([{"start": a, "end": b} for a, b in spans])
            out[2].append(sum(b - a for a, b in spans))
            out[3].append(kept.decode("utf-8", "ignore") if carry else None)
            size += len(text)
            if size >= SEND or k == batch.num_rows - 1:
                columns = [
                    pa.array(c, t) for c, t in zip(out, (pa.string(), span, pa.int64(), pa.string()), strict=True)
                ]
                given = batch.column(1).slice(first, k + 1 - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, k + 1 - first), *columns, given if carry else pa.nulls(len(given), pa.binary())],
                    names=["row", "kept_sha256", "spans", "n_removed", "kept", "bytes"],
                )
                out = [[], [], [], []]
                first, size = k + 1, 0
    tidy()


def repeated_strings(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: bool = False
) -> DataFrame:
    """Mark every byte covered by a string of LENGTH bytes that also starts earlier.

    Earlier means in a row of smaller id (null ids last), or earlier in the same text; strings are
    judged on the input and never cross texts. Rows that share an id share its rank, so what they
    have at the same place is removed from none of them. A null text counts as an empty one.

    Returns doc_id, n_bytes, n_removed, n_spans, spans (byte ranges removed, joined where they
    touch) and kept_sha256 (lowercase hex, of the remaining bytes). With ``carry`` also row (a
    struct of all the input's columns) and kept (the remaining text;
    what a cut leaves of a character in several bytes is left out of it). No rows give no rows.
    The carried text travels once, as the bytes that are judged, and ``row`` is rebuilt from them.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    others = [docs[c] for c in docs.columns if c != text_column]
    row = F.struct(*others, F.col(text_column).isNull().alias("_null_text")) if carry else F.lit(0)
    named = docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("key"),
        F.crc32(text).alias("mark"),
        text.alias("bytes"),
        row.alias("carried"),
    )
    total = docs.agg(F.sum(F.octet_length(F.col(text_column)))).first()[0] or 0
    buckets = max(partitions(spark), -(-total // BUCKET_BYTES))
    side = ", ".join(f"{c} binary" for c, _ in SIDE)
    runs = (
        named.select("key", "bytes")
        .mapInArrow(lambda it: _find(it, buckets), f"bucket int, {side}")
        .groupBy("bucket")
        .applyInArrow(tidied(_rank), "key long, mark long, lo long, hi long, off short, whole boolean")
        .groupBy(F.col("key").alias("_key"), F.col("mark").alias("_mark"))
        .agg(F.collect_list(F.struct("lo", "hi", "off", "whole")).alias("runs"))
    )
    touched = F.col("runs").isNotNull()
    met = stage(
        named.join(runs, (F.col("key") == F.col("_key")) & (F.col("mark") == F.col("_mark")), "left").select(
            "doc_id",
            "key",
            "mark",
            "carried",
            F.octet_length("bytes").cast("long").alias("n_bytes"),
            F.when(~touched, F.sha2("bytes", 256)).alias("sha"),
            F.when(touched | F.lit(carry), F.col("bytes")).alias("bytes"),
            "runs",
        ),
        "suffix-met",
    )
    open_runs = F.exists("runs", lambda r: ~r["whole"])
    closer = (
        met.filter(touched & open_runs)
        .select("key", "mark", "bytes", "runs")
        .mapInArrow(
            lambda it: _contexts(it, buckets), "bucket int, key long, mark long, lo long, bytes binary"
        )
        .groupBy("bucket")
        .applyInArrow(tidied(_expand), "key long, mark long, lo long, hi long")
        .groupBy(F.col("key").alias("_key"), F.col("mark").alias("_mark"))
        .agg(F.collect_list(F.struct("lo", "hi")).alias("more"))
    )
    whole_runs = F.filter("runs", lambda r: r["whole"])
    touched_rows = met.filter(touched).join(
        closer, (F.col("key") == F.col("_key")) & (F.col("mark") == F.col("_mark")), "left"
    )
    packed = touched_rows.select(
        F.struct("doc_id", "n_bytes", "carried").alias("row"), "bytes", whole_runs.alias("whole"), "more"
    )
    kind = packed.schema["row"].dataType.simpleString()
    cut = packed.mapInArrow(
        lambda it: _remove(it, carry),
        f"row {kind}, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, n_removed long, kept string, "
        "bytes binary",
    ).select("row.doc_id", "row.n_bytes", "row.carried", "n_removed", "spans", "kept_sha256", "kept", "bytes")
    rest = met.filter(~touched).select(
        "doc_id",
        "n_bytes",
        "carried",
        F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        F.col("sha").alias("kept_sha256"),
        F.col("bytes").cast("string").alias("kept"),
        "bytes",
    )
    given = F.when(~F.col("carried._null_text"), F.col("bytes").cast(docs.schema[text_column].dataType))
    fields = [given.alias(c) if c == text_column else F.col("carried").getField(c).alias(c) for c in docs.columns]
    extra = [F.struct(*fields).alias("row"), F.col("kept")] if carry else []
    return cut.unionByName(rest).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        "spans",
        "kept_sha256",
        *extra,
    )
