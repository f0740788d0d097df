"""Spans found in texts: their text form and digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Span = tuple[int, int, int]  # start, rank of the kind, end


def joined(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """`kind:start:end` by start, then kind; code points, end exclusive."""
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows_matching(column: pa.Array, pattern: str) -> np.ndarray:
    """Rows whose text has a match, by a linear-time engine."""
    return np.flatnonzero(pc.match_substring_regex(column, pattern).fill_null(False).to_numpy(zero_copy_only=False))
