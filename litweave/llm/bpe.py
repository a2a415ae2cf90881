"""Byte-pair encoding with an index from pairs to their places."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: How byte-level tokenizers cut text before merging (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Different pieces of text that a task remembers; then it starts afresh.
REMEMBERED = 300_000
#: Pieces that are indexed together.
INDEXED = 100_000
#: Texts of more characters are cut piece by piece, so that their pieces are never held at once.
LONG = 50_000
#: Texts of a batch that are put together, or taken apart, at a time.
SLICE = 250


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else one of
    the letters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens as bytes, merges as ascending pair keys, from a tokenizer file."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {letter: b for b, letter in enumerate(byte_letters())}
        ids = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max([*ids.values(), *special.values()]))
        for token, i in ids.items():
            self.tokens[i] = bytes(to_byte[c] for c in token)
        for token, i in special.items():
            self.tokens[i] = token.encode()
        self.special = special
        self.split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.of_byte = np.array([ids[c] for c in byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left, self.right, self.made = (
            np.array([ids[t] for t in side], np.int64)
            for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs])
        )
        keys = (self.left << 32) | self.right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        # Each token is made by one merge, before any that uses it: so a merge never brings up a pair
        # of a lower rank, and a rank can be applied at all its places at once.
        first = np.full(len(self.tokens), -1)
        first[self.made[::-1]] = np.arange(len(pairs))[::-1]
        later = np.arange(len(pairs))
        if len(np.unique(self.made)) < len(pairs) or not ((first[self.left] < later) & (first[self.right] < later)).all():
            raise ValueError("a token is made by two merges, or used before it is made")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for pairs that never merge."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], -1)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces one after the other, and their number per piece.

        The index holds, for each rank that occurs, the places of its pair over all pieces. Ranks
        are applied in ascending order, each at all its places at once; the pairs that this makes at
        both sides enter the lists of their ranks. Places whose pair has changed since are skipped.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbol = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.int32)
        n = len(symbol)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        edge = np.cumsum(sizes)
        after[edge[sizes > 0] - 1] = n  # n: nothing follows
        before[(edge - sizes)[sizes > 0]] = n
        symbol, after, before = (np.append(x, np.int32(v)) for x, v in ((symbol, -1), (after, n), (before, n)))
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray) -> None:
            places = places[(places < n) & (after[places] < n)]
            rank = self.ranks(symbol[places], symbol[after[places]])
            places, rank = places[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            bounds = np.append(np.flatnonzero(np.diff(rank, prepend=-1)), len(rank)).tolist()
            for a, b in zip(bounds[:-1], bounds[1:]):
                r = int(rank[a])
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(places[a:b])

        enter(np.arange(n, dtype=np.int32))
        while active:
            r = heapq.heappop(active)
            places = np.sort(np.concatenate(index.pop(r)))
            places = places[np.diff(places, prepend=-1) > 0]
            left, right, made = self.left[r], self.right[r], self.made[r]
            places = places[(symbol[places] == left) & (symbol[after[places]] == right)]
            if left == right and len(places) > 1:
                # of a chain a a a …, every second place merges
                chained = np.concatenate(([False], after[places[:-1]] == places[1:]))
                start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(places))))
                places = places[(np.arange(len(places)) - start) % 2 == 0]
            if not len(places):
                continue
            gone = after[places]
            symbol[places], symbol[gone] = made, -1
            follows = after[gone]
            after[places] = follows
            before[follows] = places
            before[n] = n
            enter(np.concatenate([places, before[places]]))
        alive = np.flatnonzero(symbol[:n] >= 0)
        return symbol[alive], np.bincount(np.searchsorted(edge, alive, "right"), minlength=len(pieces))


class _Numbers(dict):
    """Pieces by number, in the order in which they were first asked for."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n


class Encoder:
    """Whole texts to token ids. Pieces met before are remembered."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.pattern = regex.compile(PATTERN)
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.ids, self.sizes, self.starts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Append the ids of new pieces, which follow the known ones."""
        special = self.vocabulary.special
        plain = [b"" if p in special else p.encode("utf-8", "surrogatepass") for p in pieces]
        parts = [self.vocabulary.merged(plain[at : at + INDEXED]) for at in range(0, len(plain), INDEXED)]
        ids, sizes = (np.concatenate(x) for x in zip(*parts))
        for k in [k for k, p in enumerate(plain) if not p]:
            ids = np.insert(ids, int(sizes[:k].sum()), special[pieces[k]])
            sizes[k] = 1
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _cut(self, text: str) -> Iterable[str]:
        if len(text) <= LONG:
            return self.pattern.findall(text)
        return (found[0] for found in self.pattern.finditer(text))

    def pieces(self, text: str) -> Iterable[str]:
        split = self.vocabulary.split
        return self._cut(text) if split is None or not split.search(text) else self._between(text, split)

    def _between(self, text: str, split: regex.Pattern) -> Iterator[str]:
        at = 0
        for found in split.finditer(text):
            yield from self._cut(text[at : found.start()])
            yield found[0]
            at = found.end()
        yield from self._cut(text[at:])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their number per text; null is empty."""
        if len(self.known) > REMEMBERED:
            self._forget()
        known, done = self.known, len(self.known)
        numbers = [np.fromiter(map(known.__getitem__, self.pieces(text or "")), np.int32) for text in texts]
        if len(known) > done:
            self._learn(list(islice(known, done, None)))
        done = [self._ids(numbers[at : at + SLICE]) for at in range(0, len(numbers), SLICE)]
        return tuple(np.concatenate([np.empty(0, t), *x]) for t, x in zip((np.int32, np.int64), zip(*done) if done else ((), ())))

    def _ids(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number per text of texts given by the numbers of their pieces."""
        number = np.concatenate(numbers)
        sizes = self.sizes[number]
        ends = np.cumsum(sizes)
        step = np.arange(len(number) and int(ends[-1])) - np.repeat(ends - sizes, sizes)
        ids = self.ids[np.repeat(self.starts[number], sizes) + step]
        bounds = np.concatenate(([0], np.cumsum([len(c) for c in numbers], dtype=np.int64)))
        return ids, np.diff(np.concatenate(([0], ends))[bounds])


def _local(file: str) -> str:
    return SparkFiles.get(file.rsplit("/", 1)[-1])


def shipped(spark: SparkSession, file: str) -> str:
    """Send the tokenizer file to all executors; returns the name to give to `encoder`, `decoder`."""
    spark.sparkContext.addFile(file)
    return file


#: Texts that are encoded together.
TOGETHER = 4_000


def encoder(file: str) -> Callable[[Column], Column]:
    """Column function text → array<int> of token ids, special tokens in a text recognised.

    Null and empty texts have no ids; texts and pieces of any length are encoded whole.
    """

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = Encoder(Vocabulary(_local(file)))
        for texts in batches:
            done = [tool.encode(texts[at : at + TOGETHER].to_pylist()) for at in range(0, len(texts), TOGETHER)]
            ids = np.concatenate([np.empty(0, np.int32), *[d[0] for d in done]])
            ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *[d[1] for d in done]]))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

    return encode


def decoder(file: str) -> Callable[[Column], Column]:
    """Column function array<int> → text. Special tokens are written out; bytes that are no UTF-8
    become the replacement character; null gives the empty text; an unknown id fails."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = Vocabulary(_local(file)).tokens
        for lists in batches:
            texts = []
            for part in (lists.slice(at, SLICE) for at in range(0, len(lists), SLICE)):
                flat = part.flatten().to_numpy(zero_copy_only=False).tolist()
                at = 0
                for n in part.value_lengths().to_pylist():
                    texts.append(b"".join([tokens[i] for i in flat[at : at + (n or 0)]]).decode("utf-8", "replace"))
                    at += n or 0
            yield pa.array(texts, pa.string())

    return decode
