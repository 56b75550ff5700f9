"""Stretches of words that repeat with a period, and texts without the repetitions.

A run is a stretch of consecutive words with smallest period q and at least ``max(6, 4 * q)`` words
that cannot be made longer on either side. Each of its words is there four times at least. So

* words that a segment holds fewer than four times split it, and again in every part, until no
  segment changes any more (recursive frequency splitting);
* only the segments that are left are scanned at each lag. A long segment is not compared with
  itself at every lag: a run of period q in [Q, 2Q) repeats the Q words at one of the multiples of
  Q, so that only lags at which such a block comes back are followed. Work and memory grow with
  n log n, whatever the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.llm.common import prepare, text_or_empty

#: A run has at least so many periods, and so many words.
PERIODS = 4
WORDS = 6
#: Words of a segment that is compared with itself at every lag.
PLAIN = 400
#: Pairs of blocks that are looked at together.
CELLS = 1 << 16

Run = tuple[int, int, int]  # start, length, period


def segments(words: list[int]) -> Iterator[tuple[int, int]]:
    """Start and end of the segments that hold each of their words four times or more."""
    todo = [(0, len(words))]
    while todo:
        start, end = todo.pop()
        if end - start < WORDS:
            continue
        part = words[start:end]
        rare = {w for w, n in Counter(part).items() if n < PERIODS}
        if not rare:
            yield start, end
            continue
        first = start
        for i, word in enumerate(part, start):
            if word in rare:
                if i - first >= WORDS:
                    todo.append((first, i))
                first = i + 1
        if end - first >= WORDS:
            todo.append((first, end))


def scan_lags(words: np.ndarray) -> dict[tuple[int, int], int]:
    """Smallest period by (start, end) of the runs, from every lag."""
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // PERIODS + 1):
        least = max(WORDS, PERIODS * q) - q
        same = np.zeros(n - q + 2, dtype=np.int8)
        same[1:-1] = words[:-q] == words[q:]
        if np.count_nonzero(same) < least:
            continue
        edges = np.diff(same)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        for i in np.flatnonzero(ends - starts >= least).tolist():
            found.setdefault((int(starts[i]), int(ends[i]) + q), q)
    return found


class _Blocks:
    """Names of all blocks of 1, 2, 4, ... words, so that equal blocks have equal names."""

    def __init__(self, words: np.ndarray):
        self.names = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
        size = 1
        while 2 * size <= len(words):
            old = self.names[-1]
            pairs = old[:-size] * (len(words) + 1) + old[size:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
            size *= 2

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words from a and from b on (a < b) that are the same."""
        length = np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            names = self.names[level]
            inside = np.flatnonzero(b + length < len(names))
            same = inside[names[a[inside] + length[inside]] == names[b[inside] + length[inside]]]
            length[same] += 1 << level
        return length

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words before a and before b (a < b) that are the same."""
        length = np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            names, size = self.names[level], 1 << level
            inside = np.flatnonzero(a - length - size >= 0)
            same = inside[names[a[inside] - length[inside] - size] == names[b[inside] - length[inside] - size]]
            length[same] += size
        return length


def _inside(found: dict[tuple[int, int], int], places: np.ndarray, length: int) -> np.ndarray:
    """Whether one of the runs holds ``length`` words from each place on."""
    if not found:
        return np.zeros(len(places), dtype=bool)
    starts, ends = np.array(sorted(found)).T
    last = np.searchsorted(starts, places, "right") - 1
    return (last >= 0) & (np.maximum.accumulate(ends)[last] >= places + length)


def scan_blocks(words: np.ndarray) -> dict[tuple[int, int], int]:
    """What ``scan_lags`` finds, from the lags at which blocks come back."""
    found: dict[tuple[int, int], int] = {}
    blocks, n = _Blocks(words), len(words)
    for level, names in enumerate(blocks.names):
        size = 1 << level
        if PERIODS * size > n:
            break
        # A run of period q in [size, 2 size) has a multiple of size within its first period, the
        # block there comes back q words later, and the run goes on for 3 q words at least. Where a
        # run of a smaller period goes on for 3 sizes, the longer lags are multiples of its period.
        anchors = np.arange(0, len(names), size)
        anchors = anchors[~_inside(found, anchors, 3 * size)]
        # Blocks of one name, in order of place: the following ones are the lags to look at.
        order = np.lexsort((np.arange(len(names)), names))
        rank = np.empty(len(names), dtype=np.int64)
        rank[order] = np.arange(len(names))
        step = 1
        while len(anchors) and step < 2 * size:
            wide = min(2 * size - step, max(1, CELLS // len(anchors)))
            place = rank[anchors][:, None] + np.arange(step, step + wide)
            later = order[np.minimum(place, len(names) - 1)]
            lag = later - anchors[:, None]
            near = (place < len(names)) & (names[later] == names[anchors][:, None]) & (lag < 2 * size)
            row, column = np.nonzero(near & (lag >= size))
            a, q = anchors[row], lag[row, column]
            start = a - blocks.behind(a, a + q)
            end = a + q + blocks.ahead(a, a + q)
            long = end - start >= np.maximum(WORDS, PERIODS * q)
            for s, e, p in set(zip(start[long].tolist(), end[long].tolist(), q[long].tolist())):
                found[s, e] = min(p, found.get((s, e), p))
            anchors = anchors[near[:, -1]]
            step += wide
    return found


def find_runs(words: list) -> list[Run]:
    """All runs of a list of words, by start and period."""
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    runs = []
    for start, end in segments(ids):
        part = np.array(ids[start:end], dtype=np.int64)
        scan = scan_lags if len(part) <= PLAIN else scan_blocks
        runs += [(start + s, e - s, q) for (s, e), q in scan(part).items()]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def without_repetitions(words: list, runs: list[Run]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int32)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def periodic_runs(rows: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` (the columns ``carry``), ``runs`` (array of start, length, period; by start, then
    period) and ``collapsed`` (the words left, joined by one space) of every row.

    Words are what white space separates; a run is counted in words from 0. A null or empty text has
    no runs and an empty ``collapsed``. Rows are independent of each other, so repeated rows and ids
    give one row each; other columns are not read. Texts are worked on one at a time as they are:
    memory is bounded by the longest text, and no row is shuffled.
    """
    prepare(rows.sparkSession)
    chosen = rows.select(F.struct(*carry).alias("carried"), text_or_empty(text).alias("text"))
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, collapsed = [], []
            for value in batch.column(1).to_pylist():
                words = value.encode().split()  # at ASCII white space, as the words are defined
                runs = find_runs(words)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                collapsed.append(b" ".join(without_repetitions(words, runs)))
            columns = [batch.column(0), pa.array(found, pa.list_(struct)), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["carried", "runs", "collapsed"])

    runs = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))
    schema = chosen.select("carried").schema.add("runs", runs).add("collapsed", "string")
    return chosen.mapInArrow(run, schema)
