"""Exact integers of any size as scores: two columns that Spark can sort.

A score that fits a long is that long with empty digits.  One that does not is cut to the end of the
long's range, and its digits hold it in full, written so that texts compare as the numbers do.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Sums of products below this are worked out in 64 bits.
FITS = 1 << 62
_LENGTH = 5
_NINES = str.maketrans("0123456789", "9876543210")


def floors(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of all components, one after another: longs, or Python integers if one is too large.

    ``scale`` is a power of two, so nothing is rounded: from 2^53 on every double is a whole number.
    """
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if np.abs(x).max(initial=0.0) < FITS / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array([int(v) * scale if abs(v) >= 2**53 else int(np.floor(v * scale)) for v in x.tolist()], dtype=object)


def digits(score: int) -> str:
    """Empty for a score within a long, else a text in the order of the scores it stands for."""
    if LOWEST < score <= HIGHEST:
        return ""
    text = str(abs(score))
    if score > 0:
        return f"{len(text):0{_LENGTH}d}{text}"
    return f"{10**_LENGTH - 1 - len(text):0{_LENGTH}d}{text.translate(_NINES)}"


def number(score: int, text: str) -> int:
    """The score of a pair of columns."""
    if not text:
        return score
    return int(text[_LENGTH:]) if score > 0 else -int(text[_LENGTH:].translate(_NINES))


def columns(scores: Sequence[int] | np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The two columns of a list of scores."""
    if isinstance(scores, np.ndarray) and scores.dtype != object:
        return pa.array(scores, pa.int64()), pa.array([""] * len(scores), pa.string())
    whole = [int(s) for s in scores]
    cut = [min(max(s, LOWEST), HIGHEST) for s in whole]
    return pa.array(cut, pa.int64()), pa.array([digits(s) for s in whole], pa.string())


def falling(score: str = "score", text: str = "digits") -> list[Column]:
    """Sort order: the highest score first."""
    return [F.desc(score), F.desc(text)]
