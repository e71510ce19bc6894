"""Vectorised walks of finite automata over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Code points of text that are worked on at a time; bounds a worker's memory however long texts are together.
BATCH_POINTS = 1_000_000


def batches(frames: Iterator[pd.DataFrame], column: str = "text") -> Iterator[pd.DataFrame]:
    """The frames cut so that each has about BATCH_POINTS code points (or one row), null texts made empty."""
    for frame in frames:
        frame = frame.assign(**{column: frame[column].fillna("")})
        ends = frame[column].str.len().cumsum().to_numpy()
        low = 0
        while low < len(frame):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BATCH_POINTS, side="right")))
            yield frame.iloc[low:high]
            low = high


def pieces(starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut the ranges into pieces of at most `length`: owner, start and size of each, the longest first."""
    counts = -(-(ends - starts) // length)
    owner = np.repeat(np.arange(len(starts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = starts[owner] + nth * length
    size = np.minimum(length, ends[owner] - start)
    order = np.argsort(-size, kind="stable")
    return owner[order], start[order], size[order]


def active(size: np.ndarray, step: int) -> int:
    """How many of the pieces (longest first) are longer than step."""
    return int(np.searchsorted(-size, -step, side="left"))
