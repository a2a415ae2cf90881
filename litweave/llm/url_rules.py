"""URL rules by a sort-merge range join over reversed hosts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Verdict of a url that no rule fits.
DEFAULT = "allow"
#: Keys looked at for each splitter.
SAMPLE_PER_PART = 40
HOST = "^.*?://([^/?#]*)"
PATH = "^.*?://[^/?#]*([^?#]*)"

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), f"(?s){HOST}", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), f"(?s){PATH}", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by a dot: a host and its subdomains are the keys that start
    with the host's key, so a rule is the interval from its key to the key with a slash (the
    character after the dot) for the last dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _parts(cuts: list[bytes]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Give each url the range its key falls into. A key that is several splitters at once may go
    to any range between them: those rows are spread by their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = []
            for n, key in enumerate(batch["key"]):
                key = key.encode()
                low, high = bisect_left(cuts, key), bisect_right(cuts, key)
                part.append(low + n % (high - low + 1))
            yield batch.assign(part=np.array(part, np.int32))

    return run


class _Host:
    """One host of the stack with its path rules."""

    __slots__ = ("key", "rules", "lengths")

    def __init__(self, key: str) -> None:
        self.key, self.rules, self.lengths = key, {}, set()

    def add(self, path: str, rule: tuple) -> None:
        # of two rules with the same host and path, block counts
        if path not in self.rules or rule[1] == "block":
            self.rules[path] = rule
        self.lengths.add(len(path))

    def fitting(self, path: str) -> tuple | None:
        for n in sorted(self.lengths, reverse=True):
            if n <= len(path) and path[:n] in self.rules:
                return self.rules[path[:n]]
        return None


def _sweep(default: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rules and urls in order of (range, key), rules first: a stack holds the nested hosts whose
    intervals contain the key at hand."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, stack = None, []
        for batch in batches:
            rules, verdicts, urls = [], [], batch["rule"].isna().to_numpy()
            columns = (batch[c] for c in ("part", "key", "host", "path", "rule", "verdict"))
            for at, key, host, path, rule, verdict in zip(*columns):
                if at != part:
                    part, stack = at, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if rule is not None:
                    if not stack or stack[-1].key != key:
                        stack.append(_Host(key))
                    stack[-1].add(path, (rule, verdict))
                    continue
                best = None
                for open_host in reversed(stack):
                    found = open_host.fitting(path)
                    if found and (best is None or len(found[0]) > len(best[0])):
                        best = found
                rules.append(best[0] if best else None)
                verdicts.append(best[1] if best else default)
            out = batch.loc[urls, ["page_id", "host", "path"]]
            yield out.assign(rule=pd.Series(rules, out.index, dtype=object), verdict=pd.Series(verdicts, out.index, dtype=object))

    return run


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judged(
    df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT
) -> DataFrame:
    """Each row's (page_id, host, path, rule, verdict) under rules(verdict, host, path).

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule
    (host and path together) wins; between equal lengths the one with the longer host; between
    equal rules `block`. `rule` is host + path of the winner, null if none fits; then the verdict is
    `default`.

    Urls are dealt out by sampled splitters of their host keys; a host that is several splitters
    fills several ranges, so a hot one is spread. Every rule goes to each range that its interval
    meets, and each range is one sorted sweep in constant memory besides the stack. The sample
    decides the balance only.

    Defined results: null urls and those without `://` have an empty host and path; a path may be
    empty, which only rules with an empty path fit; rules with a null in any column are ignored;
    repeated rows are each judged; empty tables of urls or rules give no rows or only defaults.
    """
    spark = df.sparkSession
    n = partitions(spark)
    url = F.col(url_col)
    urls = df.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    rows = urls.count()
    keys: list[bytes] = []
    if rows:
        wanted = n * SAMPLE_PER_PART
        sample = urls.select("key").sample(min(1.0, 1.2 * wanted / rows), seed=11).limit(2 * wanted)
        keys = sorted(r["key"].encode() for r in sample.collect())
    cuts = [keys[k * len(keys) // n] for k in range(1, n)] if keys else []

    dealt = urls.mapInPandas(_parts(cuts), "page_id long, host string, path string, key string, part int")
    clean = rules.dropna().select("host", "path", "verdict", host_key(F.lower("host")).alias("key")).distinct()

    spread = clean.mapInPandas(_covered(cuts), "host string, path string, verdict string, key string, part int")
    events = dealt.select(
        "part", "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")
    ).union(
        spread.select("part", "key", F.lit(0), F.lit(None).cast("long"), "host", "path", F.concat("host", "path"), "verdict")
    )
    swept = events.repartition(n, "part").sortWithinPartitions("part", "key", "kind")
    return swept.mapInPandas(_sweep(default), "page_id long, host string, path string, rule string, verdict string")


def _covered(cuts: list[bytes]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Copy each rule to every range that its interval of keys meets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = []
            for key in batch["key"]:
                low = key.encode()
                after = low[:-1] + b"/"
                spans.append(list(range(bisect_left(cuts, low), bisect_left(cuts, after) + 1)))
            yield batch.assign(part=spans).explode("part").dropna().astype({"part": np.int32})

    return run
