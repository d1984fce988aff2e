"""Allow and block rules for urls by a sort-merge range join; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import partitions, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by a dot: a host and its subdomains share a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _edges(rules: DataFrame) -> DataFrame:
    """Per rule host, the key where it opens and the one where it closes, with the active rules.

    A host's interval holds the keys that start with its own. Intervals of hosts either nest or
    are apart, so the rules active behind an opening are those of the host and of all hosts
    around it, and behind a closing those of the hosts around it. The hosts around a host are
    its own suffixes, found by an equality join of the rules with themselves.
    """
    hosts = (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .withColumn("key", host_key(F.translate(F.col("host"), UPPER, LOWER)))
        .groupBy("key", F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("verdict"), F.min("host").alias("rule_host"))
        .groupBy("key")
        .agg(
            F.collect_list(
                F.struct(
                    (F.length("rule_host") + F.length("rule_path")).alias("length"),
                    F.length("rule_host").alias("host_length"),
                    F.concat("rule_host", "rule_path").alias("rule"),
                    "rule_path",
                    "verdict",
                )
            ).alias("own")
        )
    )
    labels = F.split("key", r"\.", -1)
    around = hosts.select(
        "key",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels) - 1),
                lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")),
            )
        ).alias("outer_key"),
    )
    stacks = (
        around.join(
            hosts.select(F.col("key").alias("outer_key"), F.col("own").alias("outer_own")), "outer_key"
        )
        .groupBy("key")
        .agg(
            F.flatten(F.collect_list("outer_own")).alias("with_own"),
            F.flatten(
                F.collect_list(F.when(F.col("outer_key") != F.col("key"), F.col("outer_own")))
            ).alias("without"),
        )
    )
    closing = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    return stacks.select("key", F.lit(1).alias("kind"), F.col("with_own").alias("stack")).unionByName(
        stacks.select(closing.alias("key"), F.lit(0).alias("kind"), F.col("without").alias("stack"))
    )


def judge(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """The longest rule that fits each url, and its verdict; ``default`` where none fits.

    A rule fits its host and all subdomains if the path starts with the rule's path. Longest is
    by characters of host and path, then of the host; ``block`` wins between equal rules. Urls
    and rule edges are sorted together by reversed host. Going through them in that order, the
    last edge passed names the stack of active rules. Ranges are cut at page level, so that a
    host with a third of all pages spreads over many tasks; a task whose first pages come before
    any edge of its own takes over the last edge of the tasks before it.

    Null urls and urls without ``://`` have an empty host and path, and no rule. Repeated rows
    stay. Null ids are kept. Rules with a null part are ignored. Empty tables give no rows. Other
    columns are ignored.
    """
    spark = pages.sparkSession
    url = F.col(url_column)
    visits = pages.select(
        F.col(id_column).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")
    )
    edges = _edges(rules)
    kind_of_stack = edges.schema["stack"].dataType
    page_id = visits.schema["page_id"].dataType
    events = visits.select(
        host_key(F.col("host")).alias("key"),
        F.lit(2).alias("kind"),
        "page_id",
        "host",
        "path",
        F.lit(None).cast(kind_of_stack).alias("stack"),
    ).unionByName(
        edges.select(
            "key",
            "kind",
            F.lit(None).cast(page_id).alias("page_id"),
            F.lit(None).cast("string").alias("host"),
            F.lit(None).cast("string").alias("path"),
            "stack",
        )
    )
    order = ["key", "kind", "page_id"]
    swept = stage(
        events.repartitionByRange(partitions(spark), *order, "path")
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("task", F.spark_partition_id()),
        "url-events",
    )
    in_task = Window.partitionBy("task").orderBy("place")
    local = swept.withColumn("active", F.last("stack", ignorenulls=True).over(in_task))
    # One row per task: the stack it leaves behind, and through a window over these, the one it finds.
    left = (
        swept.filter(F.col("stack").isNotNull())
        .groupBy("task")
        .agg(F.max_by("stack", "place").alias("left"))
    )
    tasks = swept.select("task").distinct().join(left, "task", "left")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    found = tasks.select("task", F.last("left", ignorenulls=True).over(before).alias("found"))
    fitting = F.filter(
        F.coalesce("active", "found"), lambda r: F.startswith(F.col("path"), r["rule_path"])
    )
    best = F.array_max(fitting)
    return (
        local.filter("kind = 2")
        .join(F.broadcast(found), "task")
        .withColumn("best", best)
        .select(
            "page_id",
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
        )
    )
