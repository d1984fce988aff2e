"""How filters overlap: every order of a set of filters, audited from one count of failure masks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import join_by_key, stage

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "ABCDE"
# What a field of a packed counter holds about one step of one order, a counter each.
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")


def failures(
    docs: DataFrame,
    labels: DataFrame,
    part_column: str = "lang",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, part, mask, good and toxic of every document.

    Bit k of the mask says whether the document fails filter k of A to E:

    - A: fewer than 100 words;
    - B: fewer than 80 % of its words are different ones;
    - C: more than 10 % of its code points are A to Z;
    - D: it holds one of ``#$%&*|``;
    - E: a document of smaller id has the same text, compared by SHA-256.

    A null text counts as an empty one, a null part as an empty name. A null id is larger than all
    others, and rows that share an id are no copies of each other. Labels of one id are combined:
    one quality of 1 makes it good, one toxic of 1 toxic; other values and ids without a document
    count for nothing, and a null id has no labels.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [
        n < 100,
        100 * distinct < 80 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    rows = stage(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
            _bits(fails).alias("mask"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "audit-rows",
    )
    totals = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    again = totals.filter("n > 1 AND first IS NOT NULL")
    joined = join_by_key(rows, again, "digest", "n", rows.count(), "left")
    later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    flags = (
        labels.groupBy(F.col(id_column).alias("_id"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    return joined.join(flags, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id",
        "part",
        F.col("mask").bitwiseOR(F.when(later, 1 << len(fails)).otherwise(0)).alias("mask"),
        F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )


def _bits(fails: list[Column]) -> Column:
    return reduce(Column.__add__, (F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)))


def packed(mask: int, filters: int, width: int) -> int:
    """One document's outcomes in all orders and steps, as a number of fields.

    There is a field for each order (in the order of ``permutations``) and step, with a counter of
    ``width`` bytes for each of OUTCOMES. Sums of such numbers count all fields at once, and no
    counter overflows into the next while fewer than 256**width of them are added.
    """
    fields, at = bytearray(), 0
    for order in permutations(range(filters)):
        alive = True
        for k in order:
            fails = bool(mask >> k & 1)
            step = (alive and not fails, alive and fails, fails and not alive, mask == 1 << k)
            alive = step[0]
            fields.extend(bytes(len(OUTCOMES) * width))
            for yes in step:
                fields[at] = yes
                at += width
    return int.from_bytes(fields, "little")


def unpacked(total: int, filters: int, width: int) -> list[tuple[int, ...]]:
    """The counters of every field of a sum of packed numbers."""
    steps = sum(1 for _ in permutations(range(filters))) * filters
    raw = total.to_bytes(steps * len(OUTCOMES) * width, "little")
    values = [int.from_bytes(raw[k : k + width], "little") for k in range(0, len(raw), width)]
    return [tuple(values[k : k + len(OUTCOMES)]) for k in range(0, len(values), len(OUTCOMES))]


def tally(counts: Iterable[tuple[int, int, int, int]], letters: str) -> Iterator[dict]:
    """One row per order and step from (mask, good, toxic, n) counts of one part."""
    counts, m = list(counts), len(letters)
    width = (sum(n for *_, n in counts).bit_length() + 7) // 8 or 1
    every = good = toxic = 0
    for mask, is_good, is_toxic, n in counts:
        number = n * packed(mask, m, width)
        every += number
        good += is_good * number
        toxic += is_toxic * number
    sums = [unpacked(total, m, width) for total in (every, good, toxic)]
    names = [(letter, "".join(order), k + 1) for order in permutations(letters) for k, letter in enumerate(order)]
    removed, shapley = OUTCOMES.index("removed"), dict.fromkeys(letters, 0)
    for (letter, *_), field in zip(names, sums[0], strict=True):
        shapley[letter] += field[removed]
    for (letter, order, step), field, lost_good, lost_toxic in zip(names, *sums, strict=True):
        yield {
            "filter_order": order,
            "step": step,
            "filter": letter,
            **dict(zip(OUTCOMES, field, strict=True)),
            "good_lost": lost_good[removed],
            "toxic_lost": lost_toxic[removed],
            "shapley": shapley[letter],
        }


def audit(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Outcomes of applying the filters in every order, per part, from rows of ``failures``.

    The rows are counted by part, mask and labels where they lie, so that a part sends at most
    4 * 2**filters rows to the task that sums its packed counters, however many documents it has.

    Returns per part, filter_order and step: filter (its letter), kept, removed, redundant (fails
    it, but was removed earlier), unique_fails (fails it alone), good_lost and toxic_lost (removed
    here), and shapley (what this filter removes, summed over all orders). No rows give no rows.
    """
    counts = rows.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = zip(*(group[c].tolist() for c in ("mask", "good", "toxic", "n")), strict=True)
        return pd.DataFrame(tally(found, letters)).assign(part=key[0])

    counters = ", ".join(f"{name} long" for name in (*OUTCOMES, "good_lost", "toxic_lost", "shapley"))
    return counts.groupBy("part").applyInPandas(
        run, f"part string, filter_order string, step int, filter string, {counters}"
    )
