"""Periodic runs of words: maximal stretches in which words `period` apart are identical.

Method. A run is reported if it is at least three periods and MIN_WORDS words long; its period is its smallest one.
Periods below SHORT are found by direct lag scans. Longer ones are taken in scales: at scale w (8, 16, 32, ...) those
from 2w to 4w. Every position has the hash of the w words that start there, every window of w positions selects its
minimum (leftmost among equals). Inside a run the windows repeat at the distance of the period, and so do their minima;
so pairs of equal minima 2w to 4w apart are the seeds. Each seed is extended word by word to both sides, which
decides.

Blocks of w words with a period of w/3 or less take no part in the minima; they lie in runs found at smaller scales.
Other equal blocks are more than w/3 apart, so a minimum has a dozen partners at most and the work is linear per scale.
No run is lost: at scale w a run of period 2w or more, three periods long, holds more than a full period of windows
whose copy one period later lies in it too; if all blocks in a full period had small periods, so would the whole run.
Stretches found at several lags have the same bounds; the smallest lag is their period.

Many texts are worked off as one array of word numbers with a separator of its own after each text, so a scale is a
few array operations for all of them; only texts long enough for a scale go on to it.

Defined results: null and empty texts and texts without words have no runs and an empty collapsed text. Equal rows have
equal results, rows keep their other columns; columns named like the results are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import compress, count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP, U64, map_lists, mixed

MIN_WORDS = 24
#: Least number of periods in a run.
TIMES = 3
#: Periods below this are found by lag scans; the first scale is a quarter of twice that.
SHORT = 16
FIXED = U64(0x100000001B3)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def stretches(x: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal stretches of `least` words or more with x[i] == x[i + lag]."""
    if len(x) <= lag:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(len(x) - lag + 2, np.int8)
    same[1:-1] = x[lag:] == x[:-lag]
    turns = np.flatnonzero(same[1:] != same[:-1])
    start, end = turns[::2], turns[1::2] + lag
    long = end - start >= least
    return start[long], end[long]


def reach(x: np.ndarray, p: int, lag: int) -> tuple[int, int]:
    """Bounds of the stretch of period `lag` around the words p and p + lag."""
    end, size = p, 256
    while end + lag < len(x):
        differ = x[end : end + size][: len(x) - lag - end] != x[end + lag : end + lag + size]
        k = int(differ.argmax())
        if differ[k]:
            end += k
            break
        end += len(differ)
        size *= 2
    start, size = p, 256
    while start > 0:
        low = max(0, start - size)
        differ = (x[low:start] != x[low + lag : start + lag])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            start -= k
            break
        start = low
        size *= 2
    return start, end + lag


def seeds(h: np.ndarray, hidden: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions p and distances d (2w <= d < 4w) of equal window minima of the block hashes h."""
    bits = U64(len(h).bit_length())
    low = (h >> bits << bits) | np.arange(len(h), dtype=U64)
    low[hidden] = U64(0xFFFFFFFFFFFFFFFF)
    step = 1
    while step < w and len(low) > step:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = low[np.concatenate([[True], low[1:] != low[:-1]])] if len(low) else low
    at = (low[low != U64(0xFFFFFFFFFFFFFFFF)] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    at = at[np.lexsort((at, h[at]))]
    value, found, k = h[at], [], 1
    while k < len(at):
        d = at[k:] - at[:-k]
        near = (value[k:] == value[:-k]) & (d < 4 * w)
        if not near.any():
            break
        far = near & (d >= 2 * w)
        found.append((at[:-k][far], d[far]))
        k += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, d = (np.concatenate(z) for z in zip(*found, strict=True))
    # Of the two periods around p, one lies on one side of p: its last or first block must repeat as well.
    right, left, last = p + d - w, p - d + 1, len(h) - 1
    holds = (right + d <= last) & (h[np.minimum(right, last)] == h[np.minimum(right + d, last)])
    holds |= (left >= 0) & (p + 1 <= last) & (h[np.maximum(left, 0)] == h[np.minimum(p + 1, last)])
    p, d = p[holds], d[holds]
    order = np.lexsort((p, d))
    return p[order], d[order]


def scaled(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
    """Adds the runs of periods from SHORT on to `found` (starts, ends, periods). x: the numbers of all words, a text's
    from `starts` on, with a separator after each."""
    w, size = SHORT // 2, 1
    h, place = mixed(x.astype(np.int64).view(U64) * STEP), np.arange(len(x))
    total, longest = len(x), int(sizes.max(initial=0))
    while 2 * w * TIMES <= longest:
        live = np.repeat(sizes >= 2 * w * TIMES, sizes + 1)
        if not live[place].all():
            stay = live[place]
            x, place, h = x[stay], place[stay], h[stay[: len(h)]]
        while size < w:
            h = mixed(h[:-size] * FIXED + h[size:])
            size *= 2
        if not len(h):
            break
        edge = np.zeros(total + 1, np.int32)
        for s, e, d in found:
            small = (d * 3 <= w) & (e - s >= w)
            np.add.at(edge, s[small], 1)
            np.add.at(edge, e[small] - w + 1, -1)
        hidden = np.cumsum(edge)[place[: len(h)]] > 0
        ps, ds = seeds(h, hidden, w)
        new, i = [], 0
        while i < len(ps):
            p, d = int(ps[i]), int(ds[i])
            start, end = reach(x, p, d)
            if end - start >= TIMES * d:
                new.append((place[start], place[end - 1] + 1, d))
            # Seeds of this distance up to the end of the stretch lie in it.
            upto = int(np.searchsorted(ds, d, "right"))
            i = max(i + 1, i + int(np.searchsorted(ps[i:upto], end - d)))
        if new:
            found.append(tuple(np.array(z, np.int64) for z in zip(*new, strict=True)))
        w *= 2


def located(words: list[list[bytes]], least: int = MIN_WORDS) -> tuple[list[list[dict]], list[bytes]]:
    """For every text, given as its words, the runs and the text without the words after each run's first period."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    number = defaultdict(count().__next__)
    x = np.empty(int(sizes.sum()) + len(words), np.int32)
    for i, (at, each) in enumerate(zip(starts.tolist(), words, strict=True)):
        x[at : at + len(each)] = np.fromiter(map(number.__getitem__, each), np.int32, len(each))
        x[at + len(each)] = -1 - i
    found = []
    for lag in range(1, SHORT):
        s, e = stretches(x, lag, TIMES * lag)
        found.append((s, e, np.full(len(s), lag, np.int64)))
    scaled(x, starts, sizes, found)
    s, e, d = (np.concatenate(z) for z in zip(*found, strict=True))
    long = e - s >= least
    s, e, d = s[long], e[long], d[long]
    order = np.lexsort((d, e, s))
    s, e, d = s[order], e[order], d[order]
    first = np.concatenate([[True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])]) if len(s) else np.zeros(0, bool)
    s, e, d = s[first], e[first], d[first]
    order = np.lexsort((d, s))
    runs: list[list[dict]] = [[] for _ in words]
    edge = np.zeros(len(x) + 1, np.int32)
    np.add.at(edge, s + d, 1)
    np.add.at(edge, e, -1)
    dropped = np.cumsum(edge[:-1]) > 0
    owner = np.searchsorted(starts, s, "right") - 1
    for i in order.tolist():
        doc = int(owner[i])
        runs[doc].append({"start": int(s[i] - starts[doc]), "length": int(e[i] - s[i]), "period": int(d[i])})
    short = []
    for at, each, here in zip(starts.tolist(), words, runs, strict=True):
        short.append(b" ".join(compress(each, (~dropped[at : at + len(each)]).tolist()) if here else each))
    return runs, short


def periodic_runs(docs: DataFrame, text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """All columns but the text, with `runs` (by start, then period) and `collapsed` (the text's words, without
    those after the first period of a run, joined by a space)."""
    keep = [c for c in docs.columns if c not in (text, "runs", "collapsed")]

    def run(texts):
        runs, short = located([t.encode().split() if t else [] for t in texts], least)
        return {"runs": runs, "collapsed": [c.decode() for c in short]}

    return map_lists(docs, run, f"runs {RUNS}, collapsed string", keep=keep, read=[text])


def strongest(runs: Column) -> Column:
    """The run of greatest exact length/period; of equals the first by start, then period. Null without runs."""
    better = lambda a, b: (
        (b["length"] * a["period"] > a["length"] * b["period"])
        | ((b["length"] * a["period"] == a["length"] * b["period"]) & (F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"])))
    )
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda a, b: F.when(better(a, b), b).otherwise(a))
