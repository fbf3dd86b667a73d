"""Ordered rule lists by incremental reduced-error pruning, and their SQL form.

For each class in turn, rules are grown on two thirds of the remaining examples
(the condition with the largest gain in information comes next) and pruned on
the other third; a class ends when on several splits in turn the rule errs on half of what
it covers there.
"""

from __future__ import annotations

import numpy as np

#: Splits on which no good rule was found after which a class ends.
FAILURES = 4
#: Bins of a feature; candidate thresholds lie between two of them.
BINS = 250

Condition = tuple[int, bool, float]  # feature, is "at least", threshold
Rule = tuple[str, list[Condition]]


def covers(x: np.ndarray, conditions: list[Condition]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, least, t in conditions:
        hit &= x[:, f] >= t if least else x[:, f] < t
    return hit


class Binned:
    """Features in bins: codes of all examples, least and largest value of each bin."""

    def __init__(self, x: np.ndarray):
        n, self.k = x.shape
        self.codes = np.empty(x.shape, np.int64)
        self.low, self.high = np.full((self.k, BINS), np.inf), np.full((self.k, BINS), -np.inf)
        for f in range(self.k):
            v = np.unique(x[:, f])
            cuts = (v[1:] + v[:-1]) / 2
            if len(cuts) >= BINS:
                # a threshold in the widest gaps first, then spread evenly
                wide = np.argsort(v[:-1] - v[1:], kind="stable")[: BINS // 4]
                even = np.linspace(0, len(cuts) - 1, BINS * 3 // 4 - 1).astype(int)
                cuts = cuts[np.unique(np.concatenate([wide, even]))]
            code = np.searchsorted(cuts, x[:, f], side="right")
            np.minimum.at(self.low[f], code, x[:, f])
            np.maximum.at(self.high[f], code, x[:, f])
            self.codes[:, f] = code + f * BINS


def _best(bins: Binned, at: np.ndarray, y: np.ndarray) -> Condition | None:
    """The condition with the largest gain on the examples ``at``; among equals the one in
    the widest gap. All thresholds of all features are weighed together by sums over bins."""
    codes, shape = bins.codes[at], (bins.k, BINS)
    count = lambda c: np.bincount(c.ravel(), minlength=bins.k * BINS).reshape(shape)
    pos, neg = count(codes[y]), count(codes[~y])
    p_all, n_all = y.sum(), (~y).sum()
    base = np.log2(p_all / (p_all + n_all))
    p_low, n_low = np.cumsum(pos, 1), np.cumsum(neg, 1)
    full = pos + neg > 0
    # the next bin above each that holds examples
    place = np.where(full, np.arange(BINS), BINS)
    after = np.minimum.accumulate(np.concatenate([place[:, 1:], np.full((bins.k, 1), BINS)], 1)[:, ::-1], 1)[:, ::-1]
    edge = full & (after < BINS)
    above = np.take_along_axis(bins.low, np.minimum(after, BINS - 1), 1)
    spread = np.where(full, bins.high, -np.inf).max(1) - np.where(full, bins.low, np.inf).min(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = np.where(edge, (above - bins.high) / np.maximum(spread, 1e-300)[:, None], -np.inf)
        found = (1e-9, 0.0, None)
        for least, p, n in ((True, p_all - p_low, n_all - n_low), (False, p_low, n_low)):
            gain = np.where(edge & (p > 0), np.round(p * (np.log2(p / (p + n)) - base), 6), -np.inf)
            top = gain.max()
            f, b = np.unravel_index(np.argmax(np.where(gain == top, gap, -np.inf)), shape)
            if (top, gap[f, b]) > found[:2]:
                found = (float(top), float(gap[f, b]), (int(f), least, float((above[f, b] + bins.high[f, b]) / 2)))
    return found[2]


def _grow(x: np.ndarray, bins: Binned, at: np.ndarray, y: np.ndarray) -> list[Condition]:
    conditions: list[Condition] = []
    hit = np.ones(len(at), bool)
    while (hit & ~y).any() and len(conditions) < 6:
        c = _best(bins, at[hit], y[hit])
        if c is None:
            break
        conditions.append(c)
        hit = covers(x[at], conditions)
    return conditions


def _prune(x: np.ndarray, y: np.ndarray, conditions: list[Condition]) -> list[Condition]:
    def worth(k: int) -> float:
        hit = covers(x, conditions[:k])
        p, n = (hit & y).sum(), (hit & ~y).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return conditions[: max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))]


def induce(x: np.ndarray, shapes: np.ndarray, order: list[str], seed: int = 3) -> list[Rule]:
    """The rules, most specific classes first; what none covers has the default shape."""
    rng, bins = np.random.default_rng(seed), Binned(x)
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    for shape in order:
        failed = 0
        while failed < FAILURES:
            at = rng.permutation(np.flatnonzero(left))
            y = shapes[at] == shape
            grow = np.arange(len(at)) % 3 != 0
            if y[grow].sum() < 3 or not (~y[grow]).any():
                break
            conditions = _grow(x, bins, at[grow], y[grow])
            if conditions:
                conditions = _prune(x[at[~grow]], y[~grow], conditions)
                hit = covers(x[at[~grow]], conditions)
                p, n = (hit & y[~grow]).sum(), (hit & ~y[~grow]).sum()
            if not conditions or p <= n:
                failed += 1
                continue
            failed = 0
            rules.append((shape, conditions))
            left &= ~covers(x, conditions)
    return rules


def decide(x: np.ndarray, rules: list[Rule], default: str) -> np.ndarray:
    """The class of each example: that of the first rule that covers it."""
    out = np.full(len(x), default, object)
    left = np.ones(len(x), bool)
    for shape, conditions in rules:
        hit = left & covers(x, conditions)
        out[hit] = shape
        left &= ~hit
    return out


def to_sql(rules: list[Rule], features: list[str], default: str, values: dict[str, str] | None = None) -> str:
    """A CASE expression over the feature columns, of class names or the SQL ``values`` that
    stand for them."""
    value = lambda shape: values[shape] if values else f"'{shape}'"
    when = " ".join("WHEN " + " AND ".join(f"{features[f]} {'>=' if least else '<'} {t!r}D" for f, least, t in conditions) + f" THEN {value(shape)}" for shape, conditions in rules)
    return f"CASE {when} ELSE {value(default)} END" if rules else value(default)
