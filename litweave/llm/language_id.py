"""Language of a text: a bidirectional gated recurrent network over its bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import seeded_rank

#: Bound of the training sample: texts per language, pieces per text, characters per piece.
SAMPLE_TEXTS, PIECES, PIECE = 1000, 3, 96
#: States per direction; bytes read at a time when labelling; windows advanced together.
HIDDEN, SPAN, LANES = 8, 96, 2048
#: Bytes of texts that are labelled together.
TOGETHER = 2_000_000
STEPS, BATCH, RATE = 300, 192, 0.02
PAD = 256
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """Two recurrent layers, one per reading direction, and a readout per position.

    A state h moves by z·(c - h), where the gate z = sigmoid(a₁) and the candidate c = tanh(a₂) come
    from a = table[byte] + U·h. The padding byte closes the gate.
    """

    languages: list[str]
    table: np.ndarray  # 2 × 2H × 257
    inner: np.ndarray  # 2 × 2H × H
    out: np.ndarray  # L × 2H
    bias: np.ndarray  # L

    @staticmethod
    def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.5, (2, 2 * hidden, PAD + 1)).astype(np.float32)
        inner = rng.normal(0, 0.5 / np.sqrt(hidden), (2, 2 * hidden, hidden)).astype(np.float32)
        out = rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32)
        net = Network(languages, table, inner, out, np.zeros(len(languages), np.float32))
        net.close()
        return net

    def close(self) -> None:
        """Padding leaves the state as it is."""
        self.table[:, : self.inner.shape[2], PAD] = -1e4

    def states(self, x: np.ndarray, direction: int) -> np.ndarray:
        """States after each of x (time × lanes), read from that side: time × H × lanes."""
        hidden = self.inner.shape[2]
        table, inner = self.table[direction].copy(), self.inner[direction].copy()
        table[:hidden] *= 0.5  # sigmoid(a) = (1 + tanh(a / 2)) / 2
        inner[:hidden] *= 0.5
        h = np.zeros((hidden, x.shape[1]), np.float32)
        a, add = (np.empty((2 * hidden, x.shape[1]), np.float32) for _ in range(2))
        out = np.empty((len(x), hidden, x.shape[1]), np.float32)
        for t in range(len(x)) if direction == 0 else range(len(x) - 1, -1, -1):
            np.take(table, x[t], axis=1, out=add, mode="clip")
            np.matmul(inner, h, out=a)
            a += add
            np.tanh(a, out=a)
            gate, step = a[:hidden], a[hidden:]
            step -= h
            gate += 1
            gate *= step
            gate *= 0.5
            h += gate
            out[t] = h
        return out

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each language at each position: time × L × lanes."""
        hidden = self.inner.shape[2]
        p = np.matmul(self.out[:, :hidden], self.states(x, 0))
        p += np.matmul(self.out[:, hidden:], self.states(x, 1))
        p += self.bias[:, None]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities of each text over all its bytes: texts × L; zeros for no byte."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        spans = -(-sizes // SPAN)
        flat = np.full(int(spans.sum()) * SPAN, PAD, np.uint16)
        every = np.frombuffer(b"".join(texts), np.uint8)
        starts = (np.cumsum(spans) - spans) * SPAN
        flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(every))] = every
        windows = flat.reshape(-1, SPAN)
        sums = np.zeros((len(windows), len(self.languages)))
        for at in range(0, len(windows), LANES):
            x = windows[at : at + LANES].T.astype(np.intp, order="C")
            p = self.labels(x)
            p *= (x != PAD)[:, None, :]
            sums[at : at + LANES] = p.sum(0).T
        owner = np.repeat(np.arange(len(texts)), spans)
        out = np.stack([np.bincount(owner, sums[:, k], len(texts)) for k in range(sums.shape[1])], 1)
        return out / np.maximum(sizes, 1)[:, None]

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 2) -> None:
        """Adam on the mean cross-entropy of all positions, by backpropagation through time.

        x: pieces × time (bytes or PAD), y: the language of each piece.
        """
        rng = np.random.default_rng(seed)
        params = [self.table, self.inner, self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            own = rng.integers(0, len(x), batch)
            grads = self._gradients(np.ascontiguousarray(x[own].T), y[own])
            rate = RATE * min(1.0, step / 20) * (1 - step / (steps + 1)) ** 0.5
            for p, g, m, v in zip(params, grads, first, second):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            self.close()

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        time, lanes = x.shape
        hidden = self.inner.shape[2]
        runs = [self._forward(x, d) for d in (0, 1)]
        both = np.concatenate([runs[0][0], runs[1][0]], 1)  # time × 2H × lanes
        p = np.matmul(self.out, both) + self.bias[:, None]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        known = (x != PAD).astype(np.float32)
        p[:, y, np.arange(lanes)] -= 1
        p *= (known / max(1.0, known.sum()))[:, None, :]
        d_out = np.einsum("tlb,thb->lh", p, both, optimize=True)
        d_both = np.matmul(self.out.T, p)
        d_table, d_inner = np.zeros_like(self.table), np.zeros_like(self.inner)
        for d in (0, 1):
            state, gate, candidate = runs[d]
            carried, none = np.zeros((hidden, lanes), np.float32), np.zeros((1, hidden, lanes), np.float32)
            before = np.concatenate([none, state[:-1]] if d == 0 else [state[1:], none])
            # what a change of the state costs each of the two inputs, for all positions at once
            to_gate, to_candidate = (candidate - before) * gate * (1 - gate), gate * (1 - candidate * candidate)
            keep, own = 1 - gate, d_both[:, d * hidden : (d + 1) * hidden]
            da = np.empty((time, 2 * hidden, lanes), np.float32)
            back = np.ascontiguousarray(self.inner[d].T)
            for t in range(time - 1, -1, -1) if d == 0 else range(time):
                dh = carried + own[t]
                np.multiply(dh, to_gate[t], out=da[t, :hidden])
                np.multiply(dh, to_candidate[t], out=da[t, hidden:])
                carried = dh * keep[t] + back @ da[t]
            d_inner[d] = np.matmul(da, before.transpose(0, 2, 1)).sum(0)
            for k in range(2 * hidden):
                d_table[d, k] = np.bincount(x.ravel(), da[:, k].ravel(), PAD + 1)
        return [d_table, d_inner, d_out, p.sum((0, 2))]

    def _forward(self, x: np.ndarray, direction: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hidden = self.inner.shape[2]
        state, gate, candidate = (np.empty((len(x), hidden, x.shape[1]), np.float32) for _ in range(3))
        h = np.zeros((hidden, x.shape[1]), np.float32)
        for t in range(len(x)) if direction == 0 else range(len(x) - 1, -1, -1):
            a = self.table[direction][:, x[t]] + self.inner[direction] @ h
            gate[t] = 0.5 + 0.5 * np.tanh(0.5 * a[:hidden])
            candidate[t] = np.tanh(a[hidden:])
            h = h + gate[t] * (candidate[t] - h)
            state[t] = h
        return state, gate, candidate


def training_pieces(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """labelled(doc_id, text, lang) → pieces × time, their languages, the language names.

    At most SAMPLE_TEXTS texts per language, in a fixed pseudo-random order, and PIECES pieces of
    PIECE characters of each, from pseudo-random places of the whole text.
    """
    some = labelled.where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    room = F.greatest(F.length("text") - PIECE, F.lit(0)) + 1
    place = [1 + F.pmod(seeded_rank(F.col("doc_id"), 100 + k), room).cast("int") for k in range(PIECES)]
    cut = F.array(*[F.substring(F.col("text"), p, F.lit(PIECE)) for p in place])
    # Pieces are cut first, so that whole texts don't travel.
    ranked = some.select("lang", "doc_id", cut.alias("pieces"), F.xxhash64("text").alias("key"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(seeded_rank(F.col("doc_id"), 5), "doc_id", "key"))
    chosen = ranked.withColumn("nth", rank).where(F.col("nth") <= SAMPLE_TEXTS)
    pieces = chosen.select("lang", F.explode("pieces").alias("piece"))
    rows = sorted((r["lang"], r["piece"]) for r in pieces.collect())
    names = sorted({r[0] for r in rows})
    x = np.full((len(rows), PIECE), PAD, np.intp)
    for row, (_, piece) in zip(x, rows):
        data = np.frombuffer(piece.encode()[:PIECE], np.uint8)
        row[: len(data)] = data
    return x, np.array([names.index(r[0]) for r in rows], np.int64), names


def trained(labelled: DataFrame) -> Network | None:
    """A network for the languages of labelled(doc_id, text, lang); None without any."""
    x, y, names = training_pieces(labelled)
    if not names:
        return None
    # languages weigh the same however many texts they have
    rng = np.random.default_rng(3)
    most = np.bincount(y).max()
    own = np.concatenate([rng.permutation(np.resize(np.flatnonzero(y == k), most)) for k in range(len(names))])
    net = Network.fresh(names)
    net.train(x[own], y[own])
    return net


def _slices(data: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in order, some TOGETHER bytes at a time."""
    part, size = [], 0
    for text in data:
        part.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def predictor(net: Network | None):
    """Column function text → struct(lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0}, index=range(len(texts)), dtype=object)
            some = [] if net is None else [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)]
            if some:
                data = [texts.iloc[i].encode("utf-8", "surrogatepass") for i in some]
                p = np.concatenate([net.pooled(part) for part in _slices(data)])
                out.loc[some, "lang_pred"] = np.array(net.languages, object)[p.argmax(1)]
                out.loc[some, "score"] = np.minimum(1.0, p.max(1))
            yield out.astype({"score": float})

    return predict


def with_language(df: DataFrame, labelled: DataFrame, text: Column) -> DataFrame:
    """`df` with a struct column `language` (lang_pred, score), learned from labelled(doc_id, text,
    lang).

    The network reads whole texts, 96 bytes at a time with both states at zero at the ends, gives
    each byte a probability of each language and takes the mean over all bytes of the text.

    Defined results: `und` with score 0 for a null text, one without any letter, or if nothing is
    labelled; equal probabilities go to the language first in the alphabet; null languages and
    texts are not learned from; rows come back as often as they are given.
    """
    return df.withColumn("language", predictor(trained(labelled))(text))
