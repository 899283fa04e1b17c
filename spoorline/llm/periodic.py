"""Periodic runs of words by power-of-two names (operator 12).

Level k names the stretch of 2^k words at each place, after the name of level k - 1 and the one half a stretch on: equal
names mean equal stretches, exactly. A run is a maximal stretch of words with smallest period q, of max(6, 4 q) words at
least, so the places i where word i equals word i + q reach over 3 q places or more. With 2^k <= q < 2^(k + 1) they hold a
whole stretch of level k that starts on the grid of step 2^(k + 1): only the grid's places are compared, and what agrees
is extended both ways by the names, from the top level down.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose words are named together; a longer text is a batch of its own. Comparisons held at a time.
BATCH_BYTES, BLOCK = 1 << 20, 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def rewritten(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by checksum ends in a period of its own words, so that runs of many lengths occur."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[: n - a]


def names(words: np.ndarray) -> list[np.ndarray]:
    """Names by level, each the first place of its stretch. A stretch that occurs once, or passes the end, is named by
    its own place and marked in no other; the levels end before the one where all stretches occur once."""
    n = len(words)
    size = np.bincount(words, minlength=n)
    level, twice = words.astype(np.int32), size[words] > 1
    out, half = [], 1
    while twice.any():
        out.append(level)
        at = np.flatnonzero(twice[: max(0, n - half)])
        at = at[twice[at + half]]
        key = level[at].astype(np.int64) * n + level[at + half]
        order = np.argsort(key)
        key, place = key[order], at[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        count = np.diff(np.append(start, len(key)))
        level, twice = np.arange(n, dtype=np.int32), np.zeros(n, bool)
        if len(start):
            first = np.repeat(np.minimum.reduceat(place, start), count)
            more = np.repeat(count > 1, count)
            level[place[more]] = first[more]
            twice[place[more]] = True
        half *= 2
    return out


def _ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i and from j on agree (i < j), by descending levels."""
    n, i, j = len(levels[0]), i.copy(), j.copy()
    length = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        on = np.flatnonzero(j < n)
        on = on[levels[k][i[on]] == levels[k][j[on]]]
        i[on] += 1 << k
        j[on] += 1 << k
        length[on] += 1 << k
    return length


def _behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i and before j agree (i < j)."""
    i, j = i.copy(), j.copy()
    length = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        on = np.flatnonzero(i >= step)
        on = on[levels[k][i[on] - step] == levels[k][j[on] - step]]
        i[on] -= step
        j[on] -= step
        length[on] += step
    return length


def runs(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period. ``words``: first place of each word, as ``names`` has it;
    no text has over ``longest`` words, and words that occur once part the texts."""
    levels, n = names(words), len(words)
    found = []
    for k, level in enumerate(levels):
        step, periods = 2 << k, np.arange(1 << k, min(2 << k, longest // 4 + 1))
        if not len(periods):
            break
        grid = np.arange(0, n, step)
        grid = grid[np.bincount(level, minlength=n)[level[grid]] > 1]
        above = levels[k + 1] if k + 1 < len(levels) else None
        rows = max(1, BLOCK // len(periods))
        for b in range(0, len(grid), rows):
            i = grid[b : b + rows, None] + np.zeros(len(periods), np.int64)
            j = i + periods
            same = (j < n) & (level[i] == level[np.minimum(j, n - 1)])
            i, j = i[same], j[same]
            if above is not None and len(i):
                # What also agrees from one grid step before on is found from there.
                back = np.maximum(i - step, 0)
                known = (i >= step) & (above[back] == above[back + (j - i)])
                i, j = i[~known], j[~known]
            if len(i):
                before = _behind(levels, i, j)
                length = before + _ahead(levels, i, j) + (j - i)
                enough = length >= np.maximum(6, 4 * (j - i))
                if enough.any():
                    found.append(np.stack([i - before, length, j - i])[:, enough])
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, length, period = np.concatenate(found, axis=1)
    # A stretch that several periods give has the smallest.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _groups(texts: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    group, size = [], 0
    for row in texts:
        if group and size + len(row[1] or b"") > most:
            yield group
            group, size = [], 0
        group.append(row)
        size += len(row[1] or b"")
    if group:
        yield group


def _found(batches: Iterator[pa.RecordBatch], rewrite: Callable | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        column = batch.column("text").cast(pa.binary())
        for group in _groups(zip(ids, (x.as_py() for x in column), strict=True), BATCH_BYTES):
            lists = [(text or b"").split() for _, text in group]
            if rewrite is not None:
                lists = [rewrite(i, w) for (i, _), w in zip(group, lists, strict=True)]
            sizes = np.array([len(w) for w in lists])
            # Behind each text stands an object that equals no word and no other such object.
            flat = list(chain.from_iterable(chain(w, (object(),)) for w in lists))
            known: dict = {}
            words = np.array(list(map(known.setdefault, flat, range(len(flat)))), np.int64)
            start, length, period = runs(words, int(sizes.max()))
            first = np.concatenate([[0], np.cumsum(sizes + 1)])
            gone = np.zeros(len(flat) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            kept = np.cumsum(gone)[:-1] == 0
            at = np.searchsorted(start, first)
            texts = [b" ".join([flat[k] for k in (a + np.flatnonzero(kept[a : b - 1])).tolist()]) if y > x else b" ".join(w) for w, a, b, x, y in zip(lists, first[:-1].tolist(), first[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
            own = start - first[np.searchsorted(first, start, "right") - 1]
            listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(own), pa.array(length), pa.array(period)], fields=list(RUN)))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in group], pa.int64()), pa.array(sizes, pa.int64()), listed, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, rewrite: Callable | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text); no row is shuffled.

    ``runs``: array of (start, length, period) in words from 0, by start and period. ``collapsed``: the words that no run
    holds after its first period, with one space between. ``rewrite`` (doc_id, words) changes the words first.

    Words are what ASCII whitespace parts. A null or empty text has no words and no runs, a null doc_id stays; repeated
    rows give repeated results; other columns are ignored; an empty table gives an empty result. A text is one piece of work
    of O(n log n) memory in its words; it cannot be parted, as a run may reach over all of it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda it: _found(it, rewrite), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
