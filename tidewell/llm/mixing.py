"""Mixing sources to target weights by entropy balancing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import join_by_key, numbered, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3  # copies of a document, and times a source's size
ROUNDS, NEAR = 80, 1e-7
FIXES = 12


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))  # "~" sorts behind every "=..."


def targets(sources: DataFrame, weights: tuple[int, ...], share: float) -> DataFrame:
    """Add target: the weighted share of all sizes, cut at MOST times a source's own size.

    What is cut off goes to the other sources by weight, until no target is above its limit.
    """
    order = numbered(sources, ["key"], "mix-sources")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = stage(
        order.withColumn("weight", F.element_at(cycle, (F.col("at") % len(weights) + 1).cast("int"))),
        "mix-weights",
    )
    whole = float(weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    limit = F.col("source_size") * MOST
    level, known = 0.0, None
    while True:
        full = F.col("weight") * F.lit(level) > limit
        row = weighed.agg(
            F.sum(F.when(full, limit).otherwise(0)).alias("taken"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
            F.count_if(full).alias("n"),
        ).first()
        if row["n"] == known or not row["weight"]:
            break
        known, level = row["n"], (whole - row["taken"]) / row["weight"]
    return weighed.withColumn(
        "target", F.least(limit.cast("double"), F.col("weight") * F.lit(float(level)))
    ).drop("at")


def _solve(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, lam, scale, top): the dual of each source's token constraint, by Newton iterations.

    A document's rate is min(MOST, exp(lam * size / scale)): of all rates that bring the source to
    its target, the closest to 1 in relative entropy. The dual is convex in lam. Every round is
    one aggregation of the cells and one step for all sources; a step that leaves the known
    bracket is replaced by its middle. Only the largest relative error reaches the driver.
    """
    state = stage(
        sources.filter("source_size > 0").select(
            "key",
            "target",
            (F.col("target") >= F.col("source_size") * MOST).alias("top"),
            F.lit(0.0).alias("lam"),
            F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("high"),
            (F.col("square") / F.col("source_size")).alias("scale"),
        ),
        "mix-dual",
    )
    size = F.col("size").cast("double")
    x = size / F.col("scale")
    rate = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
    capped = rate >= MOST
    for _ in range(ROUNDS):
        sums = (
            cells.join(state, "key")
            .groupBy("key")
            .agg(
                F.sum(F.col("n") * size * F.least(rate, F.lit(float(MOST)))).alias("value"),
                F.sum(F.when(capped, 0.0).otherwise(F.col("n") * size * x * rate)).alias("slope"),
            )
        )
        gap = F.col("value") - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        reach = F.greatest(F.lit(2.0), F.abs("lam"))
        step = F.col("lam") - F.least(
            F.greatest(F.try_divide(gap, F.col("slope")), -reach), reach
        )
        wide = F.when(gap < 0, F.col("lam") + reach).otherwise(F.col("lam") - reach)
        inside = F.coalesce(step > F.col("low2"), F.lit(True)) & F.coalesce(
            step < F.col("high2"), F.lit(True)
        )
        moved = (
            state.join(sums, "key")
            .withColumn("error", F.when(F.col("top"), 0.0).otherwise(F.abs(gap) / F.col("target")))
            .withColumn("low2", low)
            .withColumn("high2", high)
            .withColumn(
                "next",
                F.when(F.col("error") <= NEAR, F.col("lam"))
                .when(inside & step.isNotNull(), step)
                .otherwise(F.coalesce((F.col("low2") + F.col("high2")) / 2, wide)),
            )
            .select(
                "key",
                "target",
                "top",
                F.col("next").alias("lam"),
                F.col("low2").alias("low"),
                F.col("high2").alias("high"),
                "scale",
                "error",
            )
        )
        moved = stage(moved, "mix-dual")
        state = moved.drop("error")
        if (moved.agg(F.max("error")).first()[0] or 0.0) <= NEAR:
            break
    return state


def _copies(cells: DataFrame) -> DataFrame:
    """Whole copies per cell whose words come within the smallest document of the target.

    First the fractions are summed over the cells by falling size and rounded as a running total,
    so that no more than about two of the largest documents are missing or too many. Each of the
    passes that follow gives (or takes back) copies where they still fit, at least halving the
    difference. A source's cells are as many as its documents have different sizes.
    """
    by_size = Window.partitionBy("key").orderBy(F.desc("size"))
    running = by_size.rowsBetween(Window.unboundedPreceding, 0)
    earlier = by_size.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    out = (
        cells.withColumn("fraction", F.col("n") * (F.col("rate") - F.floor("rate")))
        .withColumn("total", F.floor(F.sum("fraction").over(running) + 0.5))
        .withColumn("copies", F.coalesce(F.col("total") - F.lag("total").over(by_size), F.col("total")))
        .withColumn(
            "copies",
            F.least(F.col("n") * MOST, F.col("copies") + F.col("n") * F.floor("rate")).cast("long"),
        )
    )
    for _ in range(FIXES):
        out = (
            out.withColumn(
                "gap", F.round(F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole)).cast("long")
            )
            .withColumn("room", F.when(F.col("gap") > 0, F.col("n") * MOST - F.col("copies")).otherwise(F.col("copies")))
            .withColumn("room", F.when((F.col("size") > 0) & (F.col("size") <= F.abs("gap")), F.col("room")).otherwise(0))
            .withColumn("used", F.coalesce(F.sum(F.col("room") * F.col("size")).over(earlier), F.lit(0)))
            .withColumn(
                "give",
                F.greatest(
                    F.lit(0),
                    F.least(
                        F.col("room"),
                        F.coalesce(
                            F.floor(F.try_divide(F.abs("gap") - F.col("used"), F.col("size"))), F.lit(0)
                        ),
                    ),
                ),
            )
            .withColumn("copies", F.col("copies") + F.signum("gap").cast("long") * F.col("give"))
            .drop("gap", "room", "used", "give")
        )
    return out.select("key", "size", "start", "n", "rate", "copies")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """How often to take each document so that sources come to their target weights.

    Size is the number of words (null text: 0). Sources by code point, null last, weigh 5, 2, 1,
    repeating. Returns one row per input row: doc_id, source, size, source_size, target, rate,
    copies (0 to 3) and taken (size times copies). Documents of one source and size share a rate;
    which of them get the odd copy depends on a hash of the id, so reruns agree. Repeated rows
    count each. Empty documents get one copy and add nothing. No rows give no rows. Other columns
    are ignored.
    """
    rows = stage(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).alias("source"),
            _source_key(F.col(source_column)).alias("key"),
            F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-rows",
    )
    totals = rows.groupBy("key").agg(
        F.sum("size").alias("source_size"),
        F.sum(F.col("size").cast("double") * F.col("size")).alias("square"),
        F.count("*").alias("rows"),
    )
    sources = stage(targets(totals, weights, share), "mix-targets")
    lined = stage(
        numbered(
            rows.withColumn("hash", F.xxhash64("doc_id")), ["key", "size", "hash", "doc_id"], "mix-lined"
        ),
        "mix-order",
    )
    plain = stage(
        lined.groupBy("key", "size").agg(F.count("*").alias("n"), F.min("at").alias("start")), "mix-cells"
    )
    dual = _solve(plain, sources)
    rate = F.when(F.col("size") == 0, 1.0).otherwise(
        F.when(F.col("top"), float(MOST)).otherwise(
            F.least(
                F.lit(float(MOST)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0)))
            )
        )
    )
    cells = (
        plain.join(sources.select("key", "target"), "key")
        .join(dual.select("key", "lam", "scale", "top"), "key", "left")
        .withColumn("rate", rate)
    )
    counted = stage(
        _copies(cells)
        .join(sources.select("key", "source_size", "target"), "key")
        .select(F.struct("key", "size").alias("cell"), "start", "n", "rate", "copies", "source_size", "target"),
        "mix-copies",
    )
    total = lined.count()
    odd = F.col("at") - F.col("start") < F.col("copies") % F.col("n")
    return (
        join_by_key(lined.withColumn("cell", F.struct("key", "size")), counted, "cell", "n", total)
        .withColumn("per_row", F.floor(F.col("copies") / F.col("n")) + odd.cast("long"))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            "rate",
            F.col("per_row").alias("copies"),
            (F.col("size") * F.col("per_row")).alias("taken"),
        )
    )


def remix(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as ``mix`` says, with their own columns.

    Rows that share an id are told apart by size and source; of rows alike in these any may
    get any of their copies, which have the same rate.
    """
    plan = mix(docs, **options)
    alike = Window.partitionBy("_id").orderBy("_size", "_source")
    ranked = plan.select(
        F.col("doc_id").alias("_id"),
        F.col("size").alias("_size"),
        _source_key(F.col("source")).alias("_source"),
        F.col("copies").alias("_copies"),
    ).withColumn("_nth", F.row_number().over(alike)).select("_id", "_nth", "_copies")
    columns = docs.columns
    own = docs.select(
        F.struct(*[docs[c] for c in columns]).alias("_doc"),
        docs[options.get("id_column", "doc_id")].alias("_id2"),
        F.coalesce(
            F.regexp_count(docs[options.get("text_column", "text")], F.lit(WORD)), F.lit(0)
        ).cast("long").alias("_size"),
        _source_key(docs[options.get("source_column", "source")]).alias("_source"),
    ).withColumn(
        "_nth2", F.row_number().over(Window.partitionBy("_id2").orderBy("_size", "_source"))
    )
    met = own.join(
        ranked, own["_id2"].eqNullSafe(ranked["_id"]) & (own["_nth2"] == ranked["_nth"])
    )
    return (
        met.filter(F.col("_copies") > 0)
        .withColumn("_one", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))))
        .select("_doc.*")
    )
