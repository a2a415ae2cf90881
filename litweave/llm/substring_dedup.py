"""Repeated passages: windows of words counted in super-k-mer buckets."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, marked, partitions, row_of, sliced, slices, words, written

WINDOW = 13
#: Words of the short grams among which a window's minimiser is chosen.
GRAM = 3
#: Buckets for each shuffle partition; a task holds one bucket at a time.
BUCKETS_PER_PARTITION = 16
#: Bytes of super-k-mers gathered before they are packed, and of a text that is cut into words at a time.
GATHERED, SLICE = 1 << 23, 1 << 20
#: Minimisers are classed by this many values to find heavy ones.
CLASSES = 1 << 16
#: Documents looked at to find heavy minimisers and frequent words. It decides the route of a window and how
#: words are written, never a result.
SAMPLE_ROWS = 4000
#: Frequent words that travel as a number of two bytes, and the most bytes of such a word: 4 MB at most in all.
#: Every other word travels as it is, behind the number RARE.
VOCABULARY, LONGEST = (1 << 16) - 1, 64
RARE = VOCABULARY

_PACKED = "bucket int, packed binary"
_RANGES = "doc_id long, text_key long, first int, after int"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def minimisers(found: list[bytes], window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The smallest gram hash of each window of `found`; windows are at least a gram long."""
    n = len(found)
    if n < window:
        return np.empty(0, np.uint64)
    word = _mixed(np.fromiter(map(zlib.crc32, found), np.uint64, n))
    gram = min(gram, window)
    low = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        low = low * _MIX + word[k : n - gram + 1 + k]
    low = _mixed(low)
    span, done = window - gram + 1, 1
    while done < span:
        step = min(done, span - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    return low


def _classes(low: np.ndarray) -> np.ndarray:
    return (low >> np.uint64(40)) % np.uint64(CLASSES)


def _sampled(docs: DataFrame, window: int, share: float) -> tuple[np.ndarray, list[bytes]]:
    """From a sample of documents: minimiser classes that hold more than `share` of the windows, and
    the most frequent words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, often = np.zeros(CLASSES, np.int64), Counter()
        for batch in batches:
            for text in batch["text"]:
                for _, found in _slices(text, window):
                    total += np.bincount(_classes(minimisers(found, window)).astype(np.int64), minlength=CLASSES)
                    often.update(w for w in found if len(w) <= LONGEST)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"class": some, "word": None, "n": total[some]})
        yield pd.DataFrame({"class": -1, "word": list(often.keys()), "n": list(often.values())})

    rows = docs.count()
    if not rows:
        return np.empty(0, np.uint64), []
    sample = docs.select("text").sample(min(1.0, SAMPLE_ROWS / rows), seed=7)
    fields = "class long, word binary, n long"
    counted = sample.mapInArrow(sliced(count, fields), fields).groupBy("class", "word").agg(F.sum("n").alias("n"))
    counted = written(counted, "substring-sample")
    classes = counted.where("word is null").toPandas()
    heavy = classes.loc[classes["n"] > share * classes["n"].sum(), "class"].to_numpy(np.uint64)
    frequent = counted.where("word is not null and n > 1").orderBy(F.desc("n"), "word").limit(VOCABULARY)
    return heavy, [bytes(r["word"]) for r in frequent.select("word").collect()]


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compress better."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes()


def _from_planes(raw: bytes, at: int, n: int, kind: type) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel(), at + n * width


class _Packer:
    """Super-k-mers of some documents, gathered as columns and packed by bucket."""

    def __init__(self, numbers: dict[bytes, int]) -> None:
        self.numbers = numbers
        self.words = 0  # of all super-k-mers
        self.total = 0  # of the slices of texts they come from
        self.rare: list[bytes] = []  # words without a number, in order
        self.codes: list[np.ndarray] = []
        self.slices: list[tuple[int, int]] = []  # document and key
        self.columns: list[tuple[np.ndarray, ...]] = []  # bucket, slice, first word, its place in the slices, size

    @property
    def bytes(self) -> int:
        return max(4 * self.words, 8 * self.total)

    def add(self, doc: int, key: int, at: int, found: list[bytes], bucket, first, last, window: int) -> None:
        n, size = len(first), last - first + window
        number = self.numbers.get
        codes = np.fromiter((number(w, RARE) for w in found), np.uint16, len(found))
        self.codes.append(codes)
        self.rare += [found[i] for i in np.flatnonzero(codes == RARE).tolist()]
        columns = (bucket, np.full(n, len(self.slices)), first + at, first + self.total, size)
        self.columns.append(tuple(c.astype(np.int32) for c in columns))
        self.slices.append((doc, key))
        self.total += len(found)
        self.words += int(size.sum())

    def rows(self) -> pd.DataFrame:
        if not self.words:
            return pd.DataFrame({"bucket": np.empty(0, np.int32), "packed": []})
        bucket, owner, first, place, size = (np.concatenate(x) for x in zip(*self.columns))
        self.columns = []
        doc, key = np.array(self.slices, np.int64).T
        codes = np.concatenate(self.codes)
        rank = np.cumsum(codes == RARE, dtype=np.int32) - 1  # of a word among the rare ones
        order = np.argsort(bucket, kind="stable")
        bounds = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
        packed, shrink = [], zstandard.ZstdCompressor(level=6).compress
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = order[a:b]
            n = size[own]
            before = np.cumsum(n) - n
            at = np.repeat(place[own] - before, n) + np.arange(int(n.sum()))
            code = codes[at]
            rare = b" ".join([self.rare[i] for i in rank[at[code == RARE]].tolist()])
            head = np.array([b - a, len(at)], np.int64).tobytes()
            steps = np.diff(doc[owner[own]], prepend=0)  # documents come in order, so these are small
            columns = (steps, key[owner[own]], first[own], n, code)
            packed.append(shrink(b"".join([head, *map(_planes, columns), rare])))
        return pd.DataFrame({"bucket": bucket[order[bounds[:-1]]].astype(np.int32), "packed": packed})


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    raw = zstandard.decompress(packed)
    n, n_words = np.frombuffer(raw, np.int64, 2).tolist()
    at, columns = 16, []
    for kind, size in ((np.int64, n), (np.int64, n), (np.int32, n), (np.int32, n), (np.uint16, n_words)):
        column, at = _from_planes(raw, at, size, kind)
        columns.append(column)
    steps, *others = columns
    return np.cumsum(steps), *others, raw[at:].split(b" ") if at < len(raw) else []


def _offsets(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    return np.concatenate(([0], ends[:-1] + 1)), ends


def _slices(text: str | None, window: int) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text a slice at a time, each after the last window - 1 words of the one before,
    so that every window lies in one slice; and the number of the slice's first word."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    at, first, found = 0, 0, []
    while at < len(raw):
        cut = _SPACE.search(raw, at + SLICE) if at + SLICE < len(raw) else None
        end = cut.start() if cut else len(raw)
        held = found[-(window - 1) :] if window > 1 else []
        first += len(found) - len(held)
        found = held + raw[at:end].split()
        at = end
        yield first, found


def _documents(batch: pd.DataFrame, window: int):
    """(doc, key, number of the first word, words, minimisers) of the slices of long enough texts."""
    for doc, key, text in zip(batch["doc_id"].tolist(), batch["text_key"].tolist(), batch["text"]):
        for at, found in _slices(text, window):
            if len(found) >= window:
                yield doc, key, at, found, minimisers(found, window)


def _super_kmers(buckets: int, heavy: np.ndarray, frequent: list[bytes], window: int) -> Callable:
    """Texts → packed super-k-mers by bucket. Windows with a heavy minimiser are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = {w: i for i, w in enumerate(frequent)}
        packer = _Packer(numbers)
        for batch in batches:
            for doc, key, at, found, low in _documents(batch, window):
                begin = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
                last = np.append(begin[1:], len(low)) - 1
                light = ~np.isin(_classes(low[begin]), heavy)
                begin, last = begin[light], last[light]
                bucket = (_mixed(low[begin]) % np.uint64(buckets)).astype(np.int64)
                packer.add(doc, key, at, found, bucket, begin, last, window)
                if packer.bytes >= GATHERED:
                    rows = packer.rows()
                    packer = _Packer(numbers)
                    yield rows
        yield packer.rows()

    return run


def _ranges(doc: np.ndarray, key: np.ndarray, at: np.ndarray, window: int) -> pd.DataFrame:
    """Window starts → the word ranges they cover, neighbouring ones put together."""
    order = np.lexsort((at, key, doc))
    doc, key, at = doc[order], key[order], at[order]
    begins = np.ones(len(at), bool)
    begins[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (at[1:] > at[:-1] + window)
    begin = np.flatnonzero(begins)
    last = np.append(begin[1:], len(at)) - 1 if len(at) else begin
    return pd.DataFrame(
        {"doc_id": doc[begin], "text_key": key[begin], "first": at[begin].astype(np.int32), "after": (at[last] + window).astype(np.int32)}
    )


def _repeated(doc: np.ndarray, windows: list[bytes]) -> np.ndarray:
    """Which windows also start in a smaller document. Sorted by hash and document; neighbours of
    equal hash are compared in full, and a run that holds different windows is sorted by them."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, windows), np.uint64, len(windows))
    order = np.lexsort((doc, hashes))
    sorted_hashes = hashes[order]
    same = np.concatenate(([False], sorted_hashes[1:] == sorted_hashes[:-1]))
    where = np.flatnonzero(same)
    mine, before = order[where].tolist(), order[where - 1].tolist()
    differ = np.fromiter((windows[i] != windows[k] for i, k in zip(mine, before)), bool, len(mine))
    for h in np.unique(sorted_hashes[where[differ]]):
        a, b = np.searchsorted(sorted_hashes, h, "left"), np.searchsorted(sorted_hashes, h, "right")
        run = sorted(order[a:b].tolist(), key=lambda i: (windows[i], doc[i]))
        order[a:b] = run
        same[a + 1 : b] = [windows[i] == windows[k] for i, k in zip(run[1:], run[:-1])]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    out = np.zeros(len(order), bool)
    out[order] = doc[order] > doc[order[head]]
    return out


def _count_buckets(frequent: list[bytes], window: int) -> Callable:
    """Rows sorted by bucket → word ranges to remove; one bucket is held at a time."""

    def count(parts: list[bytes], known: np.ndarray) -> pd.DataFrame:
        doc, key, first, size, code, rare = zip(*map(_unpacked, parts))
        doc, key, first, size, code = (np.concatenate(x) for x in (doc, key, first, size, code))
        found = known[code]
        found[code == RARE] = list(chain.from_iterable(rare))
        found = found.tolist()
        joined = b" ".join(found)
        starts, ends = _offsets(found)
        n = size.astype(np.int64) - window + 1
        own = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        word = np.repeat(np.cumsum(size.astype(np.int64)) - size, n) + step
        windows = [joined[a:b] for a, b in zip(starts[word].tolist(), ends[word + window - 1].tolist())]
        gone = _repeated(doc[own], windows)
        own = own[gone]
        return _ranges(doc[own], key[own], first[own].astype(np.int64) + step[gone], window)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.full(RARE + 1, b"", object)
        known[: len(frequent)] = frequent
        current, held = None, []
        for batch in batches:
            for bucket, packed in zip(batch["bucket"].tolist(), batch["packed"]):
                if bucket != current and held:
                    yield count(held, known)
                    held = []
                current = bucket
                held.append(packed)
        if held:
            yield count(held, known)

    return run


def _heavy_windows(heavy: np.ndarray, window: int) -> Callable:
    """Texts → one row per heavy window and batch: the window, its smallest document, and all its
    places in the batch, packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[at : at + 1000] for b in batches for at in range(0, len(b), 1000)):
            places: dict[bytes, list[tuple[int, int, int]]] = {}
            for doc, key, first, found, low in _documents(batch, window):
                at = np.flatnonzero(np.isin(_classes(low), heavy))
                for i in at.tolist():
                    places.setdefault(b" ".join(found[i : i + window]), []).append((doc, key, first + i))
            yield pd.DataFrame(
                {
                    "words": list(places),
                    "least": np.fromiter((min(p)[0] for p in places.values()), np.int64, len(places)),
                    "places": [zlib.compress(np.array(p, np.int64).tobytes(), 1) for p in places.values()],
                }
            )

    return run


def _heavy_ranges(window: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for least, packed in zip(batch["least_of_all"].tolist(), batch["places"]):
                p = np.frombuffer(zlib.decompress(packed), np.int64).reshape(-1, 3)
                p = p[p[:, 0] > least]
                if len(p):
                    yield _ranges(p[:, 0], p[:, 1], p[:, 2], window)

    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text_key, text) → word ranges [first, after) that are to be removed.

    Consecutive windows with the same minimiser travel as one packed string to the minimiser's
    bucket, frequent words as numbers. Minimisers so frequent that a bucket would be several times the usual one (found on a
    sample of documents) go another way: their windows are put together per batch, the smallest
    document of each comes from a combined aggregate, and it is joined back to the batches' rows, of
    which Spark may split a skewed key. Both ways are exact.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    heavy, frequent = _sampled(docs, window, 1 / (4 * n))
    known = docs.where("doc_id is not null and text is not null")
    packed = known.mapInArrow(sliced(_super_kmers(n * BUCKETS_PER_PARTITION, heavy, frequent, window), _PACKED), _PACKED)
    sorted_buckets = packed.repartition(n, "bucket").sortWithinPartitions("bucket")
    found = sorted_buckets.mapInArrow(sliced(_count_buckets(frequent, window), _RANGES), _RANGES)
    if len(heavy):
        fields = "words binary, least long, places binary"
        rows = written(known.mapInArrow(sliced(_heavy_windows(heavy, window), fields), fields), "heavy-windows")
        least = rows.groupBy("words").agg(F.min("least").alias("least_of_all"))
        met = rows.join(least, "words").select("least_of_all", "places")
        found = found.union(met.mapInArrow(sliced(_heavy_ranges(window), _RANGES), _RANGES))
    return found


_CUT = T.StructType().add("kept", "string").add("n_words", "long").add("n_removed", "long")
_CUT_ARROW = pa.struct([("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])


def _kept(text: str | None, a: np.ndarray | None, b: np.ndarray | None) -> dict:
    found = words(text)
    n = len(found)
    if a is not None and len(a):
        gone = np.zeros(n + 1, np.int64)
        np.add.at(gone, a, 1)
        np.add.at(gone, b, -1)
        found = [w for w, k in zip(found, np.cumsum(gone[:n]).tolist()) if not k]
    return {"kept": b" ".join(found).decode("utf-8", "surrogatepass"), "n_words": n, "n_removed": n - len(found)}


def _numbers(items: pa.ListScalar) -> np.ndarray | None:
    return items.values.to_numpy(zero_copy_only=False) if items.is_valid else None


@F.arrow_udf(_CUT)
def _without(texts: pa.Array, first: pa.Array, after: pa.Array) -> pa.Array:
    done = [pa.array([], _CUT_ARROW)]
    for at, n in slices(len(texts), texts.nbytes):
        some = (x.slice(at, n) for x in (texts, first, after))
        done.append(pa.array([_kept(t.as_py(), _numbers(a), _numbers(b)) for t, a, b in zip(*some)], _CUT_ARROW))
    out = pa.concat_arrays(done)
    give_back()
    return out


def _may_be(bits: np.ndarray, slots: int) -> Callable[[Column], Column]:
    """Whether an identifier's slot is marked; never for null."""

    @F.pandas_udf("boolean")
    def of(ids: pd.Series) -> pd.Series:
        slot = ids.fillna(0).astype(np.int64).to_numpy() % slots
        return pd.Series((bits[slot >> 3] >> (slot & 7) & 1).astype(bool) & ids.notna().to_numpy())

    return of


def _text_key(text: Column, repeated: bool) -> Column:
    """Tells rows of one identifier apart; it need not travel where no identifier repeats."""
    return F.xxhash64(text) if repeated else F.lit(0).cast("long")


def without_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Each row of `df` with the words that no repeated window covers.

    Returns `row` (the input row as a struct), `kept_text` (kept words joined by one space),
    `n_words` and `n_removed`. A window of `window` consecutive words is repeated if the same words
    also start somewhere in a document with a smaller identifier; windows are those of the input.

    Defined results: null text has no words; texts shorter than a window and rows with a null
    identifier lose nothing and make nothing repeated; rows with the same identifier count as the
    same document, so repeats among them stay; a window that occurs twice in one document only
    stays; an empty table gives no rows. Only the two named columns are read.
    """
    rows = df.select(row_of(df).alias("row"))
    text = F.col(f"row.`{text_col}`")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    repeated = not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    docs = docs.withColumn("text_key", _text_key(F.col("text"), repeated))
    # A row that is there many times has the same ranges each time.
    ranges = repeated_ranges(docs, window).groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("first", "after")).alias("ranges")
    )
    ranges = written(ranges, "ranges")
    may_lose = _may_be(*marked(ranges.select("doc_id"), "doc_id"))(F.col("id"))
    keyed = rows.withColumns({"id": F.col(f"row.`{id_col}`").cast("long"), "key": _text_key(text, repeated)})
    # Texts that surely lose nothing are not shuffled.
    met = keyed.where(may_lose).join(ranges, (F.col("id") == F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left")
    cut = met.select("row", _without(text, F.col("ranges.first"), F.col("ranges.after")).alias("cut"))
    none = F.lit(None).cast("array<int>")
    cut = cut.union(keyed.where(~may_lose).select("row", _without(text, none, none).alias("cut")))
    return cut.select("row", F.col("cut.kept").alias("kept_text"), F.col("cut.n_words").alias("n_words"), F.col("cut.n_removed").alias("n_removed"))
