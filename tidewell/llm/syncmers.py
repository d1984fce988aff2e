"""Document fingerprints from closed syncmers; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import numbered, stage

# Units: up to eight characters of a word, or one of a script from Thai on, many of which put no
# blanks between words.
UNIT = r"[!-~\u0080-\u0DFF]{1,8}|[^\x20\x09-\x0D]"
K, S = 5, 2


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The fingerprint of a text as array<int>: its closed syncmers, in order.

    A run of ``k`` units is a closed syncmer if, of its inner runs of ``s`` units, a least one by
    hash is the first or the last. That depends on nothing around it, so what two texts share they
    also share as anchors, and any k - s + 1 runs in a row hold an anchor. Each anchor is given as
    the run's hash and the distance from the anchor before it (0 for the first), so equal entries
    mean equal runs at equal relative places. A text without a syncmer (among others, of less than
    k units) has one entry for all its units; one without units, or null, has none.

    Work and memory grow in proportion to the text.
    """
    w = k - s + 1
    gap_bits = (k - s).bit_length()

    def entry(values: Column, gap: Column) -> Column:
        mask = (1 << (31 - gap_bits)) - 1
        high = F.shiftleft(values.bitwiseAND(F.lit(mask)), gap_bits)
        return high.bitwiseOR(gap.cast("long")).cast("int")

    def run(units: Column, i: Column, n: int) -> Column:
        return F.xxhash64(*[F.get(units, i + j if j else i) for j in range(n)])

    def at_edge(h: Column, i: Column) -> Column:
        middle = [F.get(h, i + j) for j in range(1, w - 1)]
        if not middle:
            return F.lit(True)
        edge = F.least(F.get(h, i), F.get(h, i + (w - 1)))
        return edge <= (F.least(*middle) if len(middle) > 1 else middle[0])

    def chosen(units: Column) -> Column:
        inner = F.transform(units, lambda u, i: F.xxhash64(u, *[F.get(units, i + j) for j in range(1, s)]))
        return _let(inner, lambda h: F.filter(F.sequence(F.lit(0), F.size(units) - k), lambda i: at_edge(h, i)))

    def entries(units: Column, starts: Column) -> Column:
        gap = lambda i, j: F.when(j == 0, 0).otherwise(i - F.get(starts, j - 1))
        listed = F.transform(starts, lambda i, j: entry(run(units, i, k), gap(i, j)))
        return F.when(F.size(starts) > 0, listed).otherwise(F.array(entry(F.xxhash64(units), F.lit(0))))

    none = F.array().cast("array<int>")
    found = F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))
    return F.coalesce(
        _let(
            found,
            lambda units: F.when(F.size(units) == 0, none)
            .when(F.size(units) < k, F.array(entry(F.xxhash64(units), F.lit(0))))
            .otherwise(_let(chosen(units), lambda starts: entries(units, starts))),
        ),
        none,
    )


def written(entries: Column) -> Column:
    """A fingerprint as a string: eight hex digits for each anchor."""
    return F.array_join(F.transform(entries, lambda e: F.lower(F.lpad(F.hex(e.cast("long")), 8, "0"))), "")


def likeness(left: Column, right: Column) -> Column:
    """Of both fingerprints' different entries the share that the other also has, 0 to 1.

    Two without entries are alike.
    """

    def share(a: Column, b: Column) -> Column:
        both = F.size(a) + F.size(b)
        return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)

    return _let(F.array_distinct(left), lambda a: _let(F.array_distinct(right), lambda b: share(a, b)))


def edited(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text, edited, fingerprint, edited_fingerprint, near_edited and near_next per document.

    The edited text has, instead of the document's last floor(n / 2) code points, as many from the
    start of the next document (all of it, if it has fewer): by descending id, null ids last, and
    texts of one id by the hash of the text; after the last comes the first. Rows of equal id and
    text are one document here and get equal results; a lone document is its own next. A null text
    counts as an empty one. Other columns are ignored, and no rows give no rows.

    Only ids are sorted. Texts are shuffled once by id, and from the same shuffle each document's
    beginning, no longer than the one before it needs, is sent there.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    name = F.coalesce(F.col(id_column).cast("string"), F.lit("-"))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        text.alias("text"),
        F.concat_ws(" ", name, F.hex(F.xxhash64(text))).alias("key"),
    )
    known = rows.groupBy("doc_id", "key").agg((F.max(F.length("text")) / 2).cast("long").alias("half"))
    order = stage(numbered(known, ["doc_id", "key"], "syncmers-ids"), "syncmers-order")
    n = order.count()
    # whom a document follows: the one numbered one higher, the first after the last
    before = order.select(
        ((F.col("at") + (n - 1)) % max(n, 1)).alias("at"),
        F.col("key").alias("to_key"),
        "doc_id",
        F.col("half").alias("wanted"),
    )
    links = order.select("key", "at").join(before, "at").drop("at")
    # both uses take the same columns, so that there is one shuffle of texts
    dealt = rows.select("key", "text").repartition("key")
    heads = (
        dealt.join(links, "key")
        .select(
            F.col("to_key").alias("key"),
            "doc_id",
            F.expr("substring(text, 1, wanted)").alias("head"),
            anchors(F.col("text")).alias("next"),
        )
        .groupBy("key")
        .agg(F.max(F.struct("head", "next", "doc_id")).alias("found"))
    )
    kept = F.expr("substring(text, 1, length(text) - length(text) DIV 2)")
    return (
        dealt.join(heads, "key")
        .select("found.doc_id", "text", F.concat(kept, F.col("found.head")).alias("edited"), "found.next")
        .select(
            "*",
            anchors(F.col("text")).alias("fingerprint"),
            anchors(F.col("edited")).alias("edited_fingerprint"),
        )
        .select(
            "doc_id",
            "text",
            "edited",
            "fingerprint",
            "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
        )
    )
