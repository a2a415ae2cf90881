"""First containment match between two sets of texts, without comparing all pairs of a large task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAM = 3
#: A task with at most this many pairs of a name and a target compares them one by one; larger ones go by
#: grams. It decides the route, never a result.
PAIRS = 1 << 14


def _windows(text: Column, size: int) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(size))
    )


def _host_grams(text: Column) -> Column:
    """All distinct substrings of at most 3 characters."""
    return F.array_distinct(F.concat(*[_windows(text, n) for n in range(1, _GRAM + 1)]))


def _pattern_grams(text: Column) -> Column:
    """What a host of this pattern must hold: the pattern itself if short, else its 3-grams."""
    grams = F.filter(_windows(text, _GRAM), lambda g: F.length(g) == _GRAM)
    return F.when(F.length(text) <= _GRAM, F.array(text)).otherwise(F.array_distinct(grams))


def containing(patterns: DataFrame, hosts: DataFrame) -> DataFrame:
    """Pairs (task_id, pattern, host) where the host contains the pattern.

    A pattern looks up only the hosts that hold its rarest gram; a pattern with a gram no host
    holds is dropped at once. Inputs hold distinct, non-empty texts. Gram rows are many times their
    texts, which Spark's estimates don't show, so they are never broadcast.
    """
    posted = hosts.select("task_id", "host", F.explode(_host_grams(F.col("host"))).alias("gram"))
    frequency = posted.groupBy("task_id", "gram").agg(F.count("*").alias("hosts"))
    needed = patterns.select(
        "task_id", "pattern", F.explode(_pattern_grams(F.col("pattern"))).alias("gram")
    )
    counted = needed.join(frequency.hint("merge"), ["task_id", "gram"], "left")
    rarest = counted.groupBy("task_id", "pattern").agg(
        F.min(F.struct(F.coalesce("hosts", F.lit(0)).alias("hosts"), "gram")).alias("probe")
    )
    probes = rarest.where("probe.hosts > 0").select("task_id", "pattern", "probe.gram")
    found = probes.join(posted.hint("merge"), ["task_id", "gram"])
    return found.where(F.contains("host", "pattern")).select("task_id", "pattern", "host")


def _by_grams(names: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of `targets` with each name they contain or are contained in, looked up by grams."""
    texts = targets.select("task_id", "text").distinct()
    inside = containing(
        names.withColumnRenamed("name", "pattern"), texts.withColumnRenamed("text", "host")
    ).select("task_id", F.col("pattern").alias("name"), F.col("host").alias("text"))
    around = containing(
        texts.withColumnRenamed("text", "pattern"), names.withColumnRenamed("name", "host")
    ).select("task_id", F.col("host").alias("name"), F.col("pattern").alias("text"))
    return inside.unionByName(around).join(targets.hint("merge"), ["task_id", "text"])


def first_match(names: DataFrame, targets: DataFrame) -> DataFrame:
    """For each name the first target, by (kind, pos), that contains it or is contained in it.

    names(task_id, name), targets(task_id, kind, pos, text, target); texts are lower-cased.
    """
    names = names.where("name <> ''").distinct()
    targets = targets.where("text <> ''")
    sizes = names.groupBy("task_id").agg(F.count("*").alias("names")).join(
        targets.groupBy("task_id").agg(F.count("*").alias("targets")).hint("merge"), "task_id"
    )
    large = sizes.where(F.col("names") * F.col("targets") > PAIRS).select("task_id").hint("merge")

    def held(df: DataFrame, kind: str) -> DataFrame:
        return df.join(large, "task_id", kind)

    meets = F.contains("text", "name") | F.contains("name", "text")
    pairs = held(names, "left_anti").join(targets.hint("merge"), "task_id").where(meets)
    pairs = pairs.unionByName(_by_grams(held(names, "left_semi"), held(targets, "left_semi")))
    return pairs.groupBy("task_id", "name").agg(F.min_by("target", F.struct("kind", "pos")).alias("target"))
