"""Smoothed character n-gram model with a fixed number of counters.

Counts of 1-, 2- and 3-grams of all clean lines are hashed into ``SLOTS``
counters, so the model has one size whatever the corpus holds, and may be broadcast.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.codepoints import to_points
from textloom.runtime import spread

#: Counters of the model: 4 MB.
SLOTS = 1 << 19
SMOOTH = 2.0
# Letters beyond ASCII of the languages that the corpus is known to hold.
EXEMPLARS = "абвгдежзийклмнопрстуфхцчшщьюя" + "іїєґ" + "ъыэё" + "ў" + "ąćęłńóśźż" + "äöüß"
MARKS = "—–‐«»„“”’‘…№°§€•▪◦×¬\xad"
_M = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def char_classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: belongs to clean text, lower-case letter, upper-case letter."""
    ok = np.zeros(0x110000, bool)
    ok[32:127] = True
    ok[[9, 10, 13]] = True
    for c in EXEMPLARS + EXEMPLARS.upper() + MARKS:
        ok[ord(c[0])] = True
    # scripts without an 8-bit code among those tried
    for a, b in ((0x590, 0x1E00), (0x3000, 0xD800), (0x20000, 0x30000)):
        ok[a:b] = True
    low, up = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for p in range(0x530):
        low[p], up[p] = chr(p).islower(), chr(p).isupper()
    return ok, low, up


def _slot(a: np.ndarray, b: np.ndarray, c: np.ndarray, order: int) -> np.ndarray:
    h = c.astype(np.uint64) + np.uint64(order << 60)
    if order > 1:
        h = h + (b.astype(np.uint64) << np.uint64(20))
    if order > 2:
        h = h + (a.astype(np.uint64) << np.uint64(40))
    h = (h ^ (h >> np.uint64(31))) * _M
    return ((h ^ (h >> np.uint64(29))) * _M >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def padded(points: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row with two blanks before it; where the rows' characters stand."""
    n = np.diff(offs)
    at = np.arange(len(points)) + 2 * np.repeat(np.arange(1, len(n) + 1), n)
    out = np.full(len(points) + 2 * len(n), 32, np.uint32)
    out[at] = points
    return out, at


def clean_chars(points: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per character: whether its line is clean, that is, holds nothing but known
    characters, and no upper-case letter follows a lower-case one."""
    ok, low, up = char_classes()
    bad = ~ok[points]
    if len(points) > 1:
        bad[1:] |= low[points[:-1]] & up[points[1:]]
    new = points == 10
    starts = offs[:-1][offs[:-1] < len(points)]
    line = np.cumsum(new)
    row = np.zeros(len(points) + 1, np.int64)
    np.add.at(row, starts, 1)
    line = line + np.cumsum(row[:-1])
    dirty = np.bincount(line, bad, minlength=line[-1] + 1 if len(line) else 0) > 0
    return ~dirty[line] if len(line) else np.empty(0, bool)


def _count(batches):
    total = np.zeros(SLOTS, np.int64)
    for b in batches:
        points, offs = to_points(b.column(0))
        if not len(points):
            continue
        keep = clean_chars(points, offs)
        points = np.where(np.isin(points, (9, 10, 13)), 32, points).astype(np.uint32)
        p, at = padded(points, offs)
        at = at[keep]
        for order in (1, 2, 3):
            total += np.bincount(_slot(p[at - 2], p[at - 1], p[at], order), minlength=SLOTS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["slot", "n"])


class CharModel:
    """Interpolated 3-gram log-probabilities over the hashed counters."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.float32)
        # every character was counted once for each order
        self.n = max(1.0, float(counts.sum()) / 3)

    def logp(self, points: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Natural log-probability of each character after the two before it."""
        p, at = padded(points, offs)
        a, b, c = p[at - 2], p[at - 1], p[at]
        n = self.counts
        one = (n[_slot(a, b, c, 1)] + 0.01) / (self.n + 1e4)
        two = (n[_slot(a, b, c, 2)] + SMOOTH * one) / (np.maximum(n[_slot(a, b, b, 1)], n[_slot(a, b, c, 2)]) + SMOOTH)
        three = (n[_slot(a, b, c, 3)] + SMOOTH * two) / (np.maximum(n[_slot(a, a, b, 2)], n[_slot(a, b, c, 3)]) + SMOOTH)
        return np.log(three)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-probability of each string, with the blank that follows it."""
        points, offs = to_points(pa.array([t + " " for t in texts], pa.large_string()))
        return np.add.reduceat(self.logp(points, offs), offs[:-1]) if texts else np.empty(0)


def train(df: DataFrame, text_col: str = "text") -> CharModel:
    """The model of all clean lines of ``df``; at most ``SLOTS`` counters come back."""
    texts = spread(df.select(F.col(text_col).alias("text")).filter("text is not null"))
    rows = texts.mapInArrow(_count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return CharModel(counts)
