"""Fill-in-middle: cut each text at two line ranks, found in an indexable skip list, and reorder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# What marks the start of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Every FANOUT-th node of a lane also stands in the lane above it.
FANOUT = 8
# Characters per batch that goes back to Spark.
BATCH_CHARS = 4_000_000


class SkipList:
    """Units in order, under express lanes whose links carry two widths: units and code points.

    Link j of lane k leads over FANOUT**k units (the last of a lane may lead over fewer). To find
    where ``rank`` units end, walk the topmost lane while its next link does not pass the rank,
    then go on one lane below; the widths passed on the way add up to the place. Building costs
    little more than one pass over the units, a descent about FANOUT links in each lane.
    """

    def __init__(self, units: list[str]) -> None:
        self.lanes = [([1] * len(units), list(map(len, units)))]
        while len(self.lanes[-1][0]) > FANOUT:
            self.lanes.append(
                tuple([sum(w[k : k + FANOUT]) for k in range(0, len(w), FANOUT)] for w in self.lanes[-1])
            )

    def locate(self, rank: int) -> int:
        """The code points in the first ``rank`` units; rank may be 0 to the number of units."""
        at = passed = chars = 0
        for units, points in reversed(self.lanes):
            at *= FANOUT  # the same node, one lane below
            while at < len(units) and passed + units[at] <= rank:
                passed += units[at]
                chars += points[at]
                at += 1
        return chars


def lines(text: str) -> list[str]:
    """The matches of ``[^\\n]*\\n|[^\\n]+``: every line with its line feed."""
    found = text.split("\n")
    out = [line + "\n" for line in found[:-1]]
    return out + [found[-1]] if found[-1] else out


def draws(seed: str, name: str) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers that depend on seed and name alone."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))


def rearrange(
    text: str, name: str, seed: str = "7", rate: int = 100, spm_rate: int = 50
) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix and middle code points, output) of one text."""
    units = lines(text)
    h1, h2, h3, h4 = draws(seed, name)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    ranks = SkipList(units)
    first, last = sorted(ranks.locate(h % (len(units) + 1)) for h in (h1, h2))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < spm_rate:
        return len(units), "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(units), "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def reassemble(output: str, form: str) -> str:
    """The text from which an output of this form was made.

    No part of the text holds a mark, and no mark begins within another, so that each mark is
    found where it was put.
    """
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = head.removeprefix(PREFIX).split(SUFFIX)
    else:
        suffix, prefix = head.removeprefix(SUFFIX).split(PREFIX)
    return prefix + middle + suffix


def _text(raw: pa.Scalar) -> str:
    return (raw.as_py() or b"").decode("utf-8", "surrogateescape")


def _binary(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def transform(
    docs: DataFrame,
    seed: str = "7",
    rate: int = 100,
    spm_rate: int = 50,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Reorder each whole text for fill-in-middle training.

    ``rate`` and ``spm_rate`` are percentages: texts that are cut at all, and of these the ones
    whose suffix comes first. The draws depend on seed and id alone, so reruns agree.

    Returns per row: doc_id, n (lines), form (plain, psm or spm), prefix_chars and middle_chars
    (code points; null if plain) and output (binary, UTF-8). A null text counts as an empty one,
    which is plain; a null id counts as an empty name. Rows are independent: nothing is shuffled,
    repeated rows give equal results, a long text only makes its own batch larger. Bytes that are
    not UTF-8 count as one code point each and come back as they were. Other columns are ignored.
    """
    chosen = docs.selectExpr(
        f"`{id_column}` AS doc_id", f"CAST(`{id_column}` AS STRING) AS name", f"CAST(`{text_column}` AS BINARY) AS text"
    )
    kind = chosen.schema["doc_id"].dataType.simpleString()
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, rows = 0, 0, []
            for k in range(batch.num_rows):
                *found, output = rearrange(
                    _text(batch.column(2)[k]), batch.column(1)[k].as_py() or "", seed, rate, spm_rate
                )
                rows.append((*found, _binary(output)))
                held += len(output)
                if held >= BATCH_CHARS or k == batch.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    ids = batch.column(0).slice(first, k + 1 - first)
                    yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *names])
                    first, held, rows = k + 1, 0, []

    return chosen.mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary"
    )


def restore(transformed: DataFrame) -> DataFrame:
    """Add restored (binary): the text rebuilt from output and form alone."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.schema)
    names = transformed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, forms = batch.column(names.index("output")), batch.column(names.index("form"))
            restored = [_binary(reassemble(_text(o), f.as_py())) for o, f in zip(outputs, forms, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(restored, pa.binary())], [*names, "restored"]
            )

    return transformed.mapInArrow(run, f"{fields}, restored binary")
