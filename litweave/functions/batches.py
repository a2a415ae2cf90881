"""Streams of pandas batches inside a task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd


def grouped(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Batches sorted by `keys` → one frame per key. One key and one batch are held at a time."""
    held: list[pd.DataFrame] = []
    keys = list(keys)
    for batch in batches:
        if not len(batch):
            continue
        values = batch[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and (held[-1][keys].iloc[0].to_numpy() != values[a]).any():
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(batch.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True)
