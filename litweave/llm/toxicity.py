"""Toxicity of a text: two Kneser-Ney models, one per class."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, partitions, released, seeded_rank, written

#: Words and pairs of words are counted under hashes of so many values, which bounds the model.
WORDS, PAIRS = 1 << 16, 1 << 20
#: What has fewer different contexts in both classes together is rare: it gets no mass of its own.
LEAST = 5
#: The discount of a count: DISCOUNT, and what the shared counts would let expect, MARGIN times and
#: DOUBT standard deviations more. Only what a class has beyond that is its own.
DISCOUNT, MARGIN, DOUBT = 0.75, 3.0, 3.0
#: Pairs are dealt out by their first word's hash into so many groups.
GROUPS = 256
#: Fewer numbers than this are not merged into those of a group by themselves.
MERGED = 1 << 16
#: A text's score is that of its worst stretch of so many words.
STRETCH = 128
#: Bound of the calibration sample.
CALIBRATION_ROWS = 20_000
#: The score of every text where nothing could be learned: no text is rejected.
UNKNOWN = 0.25
START = 0

_SPACED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)


def word_ids(text: str | None) -> np.ndarray:
    """Hashes of the words of a text: lower-cased, cut at ASCII white space and punctuation."""
    found = [] if text is None else text.encode("utf-8", "surrogatepass").translate(_SPACED).split()
    crc = np.fromiter(map(zlib.crc32, found), np.uint64, len(found))
    return ((crc * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def _pair_ids(ids: np.ndarray) -> np.ndarray:
    return np.concatenate(([START], ids[:-1])) * WORDS + ids


def _pair_slots(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)


def _discount(expected: np.ndarray) -> np.ndarray:
    return DISCOUNT + MARGIN * expected + DOUBT * np.sqrt(expected)


def _triples(ids: np.ndarray) -> np.ndarray:
    """Each word with the two before it: (second to last before, word, first before) as a number."""
    pairs = _pair_ids(ids)
    return pairs * WORDS + np.concatenate(([START], pairs[:-1] // WORDS))


def _gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labelled texts → their different (triple, class) numbers, packed by group of words before."""
    for batch in batches:
        numbers = [_triples(word_ids(t)) * 2 + int(y) for t, y in zip(batch["text"], batch["toxic"])]
        flat = np.unique(np.concatenate([np.empty(0, np.int64), *numbers]))
        group = flat // (2 * WORDS * WORDS * (WORDS // GROUPS))
        bounds = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(flat))
        yield pd.DataFrame(
            {
                "part": group[bounds[:-1]].astype(np.int32),
                "packed": [zlib.compress(np.diff(flat[a:b], prepend=0).tobytes(), 1) for a, b in zip(bounds[:-1], bounds[1:])],
            }
        )


class _Different:
    """The different numbers of packets that come one by one. Packets wait until they are half as many as what is
    held, so a number is sorted about log(packets) times and not once per packet."""

    def __init__(self) -> None:
        self.held, self.waiting, self.n = np.empty(0, np.int64), [], 0

    def add(self, numbers: np.ndarray) -> None:
        self.waiting.append(numbers)
        self.n += len(numbers)
        if self.n >= max(MERGED, len(self.held) // 2):
            self.all()

    def all(self) -> np.ndarray:
        """Sorted."""
        if self.waiting:
            flat = np.concatenate([self.held, *self.waiting])
            self.held, self.waiting, self.n = flat[:0], [], 0
            flat.sort()
            self.held = flat[_begins(flat)]
        return self.held


def _begins(ascending: np.ndarray) -> np.ndarray:
    """Whether a number is the first of its value."""
    new = np.ones(len(ascending), bool)
    np.not_equal(ascending[1:], ascending[:-1], out=new[1:])
    return new


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed numbers sorted by group → sums per word, per context and per pair. Memory: about three times the
    different triples of one group, and the fixed tables."""
    word = np.zeros((4, WORDS))  # different words before: toxic, ordinary
    context = np.zeros((4, WORDS))  # toxic, ordinary, and the mass of their own
    pair = np.zeros((4, PAIRS))
    current, keys = None, _Different()

    def close(keys: np.ndarray) -> None:
        start = np.flatnonzero(_begins(keys // (2 * WORDS)))
        pairs = keys[start] // (2 * WORDS)
        toxic = np.add.reduceat(keys & 1, start)
        counts = np.stack([toxic, np.diff(start, append=len(keys)) - toxic]).astype(float)
        before, after = pairs // WORDS, pairs % WORDS
        n = np.stack([np.bincount(before, c, WORDS) for c in counts])
        share = counts.sum(0) / n.sum(0)[before]
        mass = np.maximum(counts - _discount(n[:, before] * share), 0) * (counts.sum(0) >= LEAST)
        for k in (0, 1):
            word[k] += np.bincount(after, counts[k] > 0, WORDS)
            context[k] += n[k]
            context[2 + k] += np.bincount(before, mass[k], WORDS)
            own = mass[k] > 0
            np.add.at(pair[k], _pair_slots(pairs[own]), mass[k][own])

    for batch in batches:
        for part, packed in zip(batch["part"].tolist(), batch["packed"]):
            if part != current and current is not None:
                close(keys.all())
                keys = _Different()
            current = part
            keys.add(np.cumsum(np.frombuffer(zlib.decompress(packed), np.int64)))
    if current is not None:
        close(keys.all())
    for kind, table in (("word", word), ("context", context), ("pair", pair)):
        at = np.flatnonzero(table.any(0))
        yield pd.DataFrame({"kind": kind, "at": at, **{f"v{k}": table[k, at] for k in range(4)}})


@dataclass
class Models:
    """p(w|h) = mass(h w) / n(h) + rest(h) · p(w) for each class; p(w) in the same way backs off to
    p(w) of both classes together.

    Counts are those of Kneser and Ney's lower orders: not how often, but after how many different
    words, so that copies of a text add nothing.
    """

    word: np.ndarray  # 2 × WORDS, p(w)
    inverse: np.ndarray  # 2 × WORDS, 1 / n(h)
    rest: np.ndarray  # 2 × WORDS
    pair: np.ndarray  # 2 × PAIRS, mass(h w)

    @staticmethod
    def of(counts: pd.DataFrame) -> Models:
        def table(kind: str, size: int) -> np.ndarray:
            rows = counts[counts["kind"] == kind]
            out = np.zeros((4, size))
            out[:, rows["at"].to_numpy()] = rows[["v0", "v1", "v2", "v3"]].to_numpy().T
            return out

        word, context, pair = table("word", WORDS)[:2], table("context", WORDS), table("pair", PAIRS)
        both, n = word.sum(0), np.maximum(word.sum(1, keepdims=True), 1)
        shared = (both + 0.5) / (both + 0.5).sum()
        own = np.maximum(word - _discount(n * both / max(1.0, both.sum())), 0) * (both >= LEAST) / n
        p = own + (1 - own.sum(1, keepdims=True)) * shared
        inverse = 1 / np.maximum(context[:2], 1)
        rest = np.maximum(1 - context[2:] * inverse, 1e-3)
        return Models(*(x.astype(np.float32) for x in (p, inverse, rest, pair[:2])))

    def ratio(self, text: str | None) -> float:
        """Log-likelihood ratio per word (toxic over ordinary) of the worst stretch; 0 for no words."""
        ids = word_ids(text)
        if not len(ids):
            return 0.0
        pairs = _pair_ids(ids)
        before, slot = pairs // WORDS, _pair_slots(pairs)
        # A slot may be shared by other pairs, so its mass is held to what the context has.
        p = np.minimum(self.pair[:, slot] * self.inverse[:, before], 1 - self.rest[:, before]) + self.rest[:, before] * self.word[:, ids]
        p = np.log(np.maximum(p, 1e-30))
        sums = np.concatenate(([0.0], np.cumsum(p[0] - p[1], dtype=np.float64)))
        n = min(len(ids), STRETCH)
        return float((sums[n:] - sums[:-n]).max() / n)


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from ratio to probability.

    It crosses one half at the cut with the fewest errors (between equal cuts, at the one with most
    room around it), so wrong labels far from the cut don't move it; the slope is the likeliest. The
    cut lies above 0: what is no likelier in toxic texts, or has no words, is not toxic.
    """
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    below = np.concatenate(([0], np.cumsum(y)))  # toxic below the cut
    errors = below + (len(y) - y.sum()) - (np.arange(len(y) + 1) - below)
    edges = np.concatenate(([x[0] - 1], x, [max(x[-1], 0) + 1]))
    room = np.diff(edges)
    cuts = (edges[:-1] + edges[1:]) / 2
    cuts[-1] = max(cuts[-1], 0.5)
    errors = np.where((room > 0) & (cuts > 0), errors, len(y) + 1)
    best = np.flatnonzero(errors == errors.min())
    k = best[np.argmax(room[best])]
    cut = cuts[k]
    slopes = np.geomspace(1, 1e4, 81)
    z = np.clip(slopes[:, None] * (x - cut), -30, 30)
    likely = (y * z - np.log1p(np.exp(z))).sum(1)
    slope = float(slopes[np.argmax(likely)])
    return slope, -slope * float(cut)


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Models, float, float] | None:
    """docs(doc_id, text), labels(doc_id, toxic) → models, slope and offset; nothing without
    labelled texts of both classes.

    Of each class the same share of the labelled texts, one at least, is scored to fit the curve from
    ratio to probability: a quarter, CALIBRATION_ROWS at most. All others are counted, and so is the
    only text of a class. Texts move once, to meet their labels; pairs travel packed and sorted; the
    driver gets tables of fixed size.
    """
    n = partitions(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int")).distinct()
    # Labels grow with the texts, so both are always dealt out by identifier.
    known = written(docs.select("doc_id").distinct().join(known.hint("merge"), "doc_id"), "toxicity-labels")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    share = min(0.25, CALIBRATION_ROWS / sum(sizes.values()))
    some = [
        known.where(F.col("toxic") == y).orderBy(seeded_rank(F.col("doc_id"), 22), "doc_id").limit(max(1, int(size * share)))
        for y, size in sizes.items()
    ]
    some = written(some[0].union(some[1]), "calibration-labels")
    single = [y for y, size in sizes.items() if size == 1]
    others = known.join(some.where(~F.col("toxic").isin(single)), ["doc_id", "toxic"], "left_anti")
    counted = docs.join(others.hint("merge"), "doc_id").select("text", "toxic").mapInPandas(released(_gather), "part int, packed binary")
    sums = counted.repartition(n, "part").sortWithinPartitions("part").mapInPandas(
        released(_count), "kind string, at long, v0 double, v1 double, v2 double, v3 double"
    )
    total = sums.groupBy("kind", "at").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(4)])
    models = Models.of(total.toPandas())

    pairs = docs.join(some, "doc_id").select(ratios(models)("text").alias("x"), "toxic").toPandas()
    slope, offset = calibrated(pairs["x"].to_numpy(float), pairs["toxic"].to_numpy(float))
    return models, slope, offset


def ratios(models: Models) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        found = pd.Series([models.ratio(t) for t in texts], dtype=float)
        give_back()
        return found

    return of


def with_toxicity(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with a column `toxicity` from 0 to 1, learned from labels(doc_id, toxic) and the rows of
    `df` for which `learn` holds.

    Both models count after how many different words a word, and a pair of words, occurs in their
    class. What is rare, or no more frequent than the classes together let expect, has no mass of its
    own: its probability comes from the backoff counts that the classes share, and the ratio stays. The ratio of log-likelihoods is taken per word, over the worst stretch of
    STRETCH words of the whole text, and turned into a probability on texts that were not counted.

    Defined results: null, empty and wordless texts have ratio 0; labels that are null or not 0 or 1
    and rows with a null identifier teach nothing; an identifier with both labels counts for both;
    without labelled texts of both classes all scores are UNKNOWN, below one half; rows come back as often as they are given.
    """
    docs = df.where(learn).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = fitted(docs, labels)
    if found is None:
        return df.withColumn("toxicity", F.lit(UNKNOWN))
    models, slope, offset = found
    x = ratios(models)(F.col(text_col))
    return df.withColumn("toxicity", 1 / (1 + F.exp(-(x * F.lit(slope) + F.lit(offset)))))
