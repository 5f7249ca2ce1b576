"""Failures in a row of many keys at once, for stateful steps that hold the keys of a bucket.

State by key costs a call of Python and several of the state store for each key
and batch; by bucket these are as many as there are buckets, and the keys of a
bucket are counted together in numpy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets that keys are dealt out to: state lies by bucket, so a stream that goes on from a checkpoint needs the same number.
BUCKETS = 1024


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def key_starts(codes: np.ndarray) -> np.ndarray:
    """Which of the rows, ordered by key, are the first of their key."""
    first = np.ones(len(codes), dtype=bool)
    first[1:] = codes[1:] != codes[:-1]
    return first


def streaks(codes: np.ndarray, ok: np.ndarray, before: np.ndarray, broke: np.ndarray | None = None) -> np.ndarray:
    """Failures since a key's last success, behind each row; rows go by key and then by time.

    ``before`` is each row's streak of its key before its first row; a row that
    ``broke`` begins a streak anew.
    """
    failed = np.cumsum(~ok)
    first = key_starts(codes)
    fresh = ok if broke is None else ok | broke
    base = failed - ~ok - np.where(first & ~fresh, before, 0)  # of a row where a streak begins
    begins = np.maximum.accumulate(np.where(first | fresh, np.arange(len(codes)), 0))
    return failed - base[begins]
