"""Benchmark decontamination by winnowing (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._scratch import Scratch, fresh

WINDOW, GRAM = 13, 5
#: Fingerprints of a winnowing span: 9 consecutive 5-word hashes lie in each 13 words.
SPAN = WINDOW - GRAM + 1
#: Words of a benchmark up to which its fingerprints and windows are broadcast (about 20 bytes each); a larger one is joined.
BROADCAST_WORDS = 4_000_000


def winnow(g: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``span`` hashes its smallest, the rightmost of equals: window starts and positions."""
    n = len(g) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for o in range(1, span):
        lower = g[o : o + n] <= best
        best = np.where(lower, g[o : o + n], best)
        at[lower] = o
    start = np.arange(n)
    return start, start + at


def _rows_of(at: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.searchsorted(at, p, "right") - 1


def fingerprints(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed 5-word hashes of the rows that start at ``at`` in ``h``, and their places."""
    g = _text.grams(h, GRAM)
    start, pos = winnow(g)
    pos = np.unique(pos[start + WINDOW <= at[_rows_of(at, start) + 1]]) if len(start) else pos
    return g[pos], pos


def _starts(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Where ``k`` words of one row start."""
    p = np.arange(max(0, n - k + 1))
    return p[p + k <= at[_rows_of(at, p) + 1]]


class Index:
    """Winnowed fingerprints of benchmark items, and their distinct windows, each with the number of its set of items.

    Items are places in ``ids``, which is sorted. Windows that the same items hold, such as a passage that all share, have one set.
    """

    def __init__(self, items: list[tuple[str, np.ndarray]]) -> None:
        self.ids = sorted({x[0] for x in items})
        place = {x: k for k, x in enumerate(self.ids)}
        prints, windows = [np.empty(0, np.uint64)], {}
        for name, w in items:
            if len(w) >= WINDOW:
                prints.append(fingerprints(w, np.array([0, len(w)]))[0])
            n = min(WINDOW, len(w))
            if n:
                windows.setdefault(n, []).append((np.unique(_text.grams(w, n)), place[name]))
        self.prints = np.unique(np.concatenate(prints))
        self.windows, self.sets, known = {}, [], {}
        for n, own in windows.items():
            h, item = np.concatenate([x[0] for x in own]), np.concatenate([np.full(len(x[0]), x[1], np.int32) for x in own])
            order = np.lexsort((item, h))
            keys, first = np.unique(h[order], return_index=True)
            item, edges, numbers = item[order], np.append(first, len(h)).tolist(), []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                held = item[i:j].tobytes()
                if held not in known:
                    known[held] = len(self.sets)
                    self.sets.append(np.unique(item[i:j]))
                numbers.append(known[held])
            self.windows[n] = (keys, np.array(numbers, np.int64))

    def items(self, sets: np.ndarray) -> list[str]:
        """The sorted ids of items of any of the sets."""
        return [self.ids[k] for k in np.unique(np.concatenate([self.sets[s] for s in sets.tolist()])).tolist()]

    def hits(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window size: starts in ``h`` of the windows that items hold, and their places among the keys."""
        for n, (keys, _) in self.windows.items():
            if n == WINDOW:
                g, pos = fingerprints(h, at)
                pos = pos[_known(self.prints, g)[0]]
                p = np.unique((pos[:, None] - np.arange(SPAN)).ravel())
                p = p[p >= 0]
                p = p[p + n <= at[_rows_of(at, p) + 1]]
            else:
                p = _starts(len(h), at, n)
            found, place = _known(keys, _text.grams_at(h, p, n))
            yield n, p[found], place


def _known(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the hashes that are among the sorted keys, and their places there."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    on = np.flatnonzero(keys[place] == h)
    return on, place[on]


def _spans(start: np.ndarray, size: np.ndarray) -> list[dict]:
    """Maximal ranges of covered words."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate((start + size)[order])
    cut = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return [{"s": int(a), "e": int(b)} for a, b in zip(s[cut], np.append(e[cut[1:] - 1], e[-1]), strict=True)]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, _, data, offsets in _text.chunks(batch.column("text")):
            h, at = _text.words(data, offsets)
            out += [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(out, pa.binary())], names=["item_id", "w"])


_HIT = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_KEYS = pa.list_(pa.int64())


def _scanned(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    """Words, covered spans and items of each document, from the broadcast index."""
    ix = index.value
    for batch in batches:
        n, spans, items = [], [], []
        for i, j, data, offsets in _text.chunks(batch.column("text")):
            h, at = _text.words(data, offsets)
            n += np.diff(at).tolist()
            start, size, row, held = ([np.empty(0, np.int64)] for _ in range(4))
            for k, p, place in ix.hits(h, at):
                start.append(p)
                size.append(np.full(len(p), k))
                row.append(_rows_of(at, p))
                held.append(ix.windows[k][1][place])
            start, size, row, held = (np.concatenate(x) for x in (start, size, row, held))
            order = np.argsort(row, kind="stable")
            edge = np.searchsorted(row[order], np.arange(j - i + 1))
            for r, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                on = order[a:b]
                spans.append(_spans(start[on] - at[r], size[on]))
                items.append(ix.items(np.unique(held[on])) if b > a else [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(spans, _HIT), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "th", "n_words", "spans", "items"])


def _item_keys(batches: Iterator[pa.RecordBatch], windows: bool) -> Iterator[pa.RecordBatch]:
    """Per item its distinct fingerprints (an item of fewer words than a window: its one hash), or its distinct windows."""
    for batch in batches:
        out, sizes = [], []
        for w in batch.column("w"):
            w = np.frombuffer(w.as_buffer(), np.uint64)
            n = min(WINDOW, len(w))
            sizes.append(n)
            out.append((np.unique(_text.grams(w, n)) if windows or n < WINDOW else np.unique(fingerprints(w, np.array([0, len(w)]))[0])).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(sizes, pa.int32()), pa.array(out, _KEYS)], names=["item_id", "k", "keys"])


def _doc_prints(batches: Iterator[pa.RecordBatch], short: list[int]) -> Iterator[pa.RecordBatch]:
    """Per document its words and distinct fingerprints, with the hashes of all windows of the short sizes."""
    for batch in batches:
        n, keys = [], []
        for i, j, data, offsets in _text.chunks(batch.column("text")):
            h, at = _text.words(data, offsets)
            n += np.diff(at).tolist()
            g, pos = fingerprints(h, at)
            every, where = [g], [pos]
            for k in short:
                p = _starts(len(h), at, k)
                every.append(_text.grams_at(h, p, k))
                where.append(p)
            g, row = np.concatenate(every), _rows_of(at, np.concatenate(where))
            order = np.argsort(row, kind="stable")
            edge = np.searchsorted(row[order], np.arange(j - i + 1))
            keys += [np.unique(g[order[a:b]]).view(np.int64) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(keys, _KEYS)], names=["doc_id", "th", "n_words", "keys"])


_WINDOW = pa.list_(pa.struct([("k", pa.int32()), ("key", pa.int64()), ("at", _HIT)]))


def _near_windows(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Per document the distinct windows around its fingerprints that hit, and those of short sizes that hit, with the ranges
    that each covers."""
    for batch in batches:
        out = []
        for i, j, data, offsets in _text.chunks(batch.column("text")):
            h, at = _text.words(data, offsets)
            hit = [np.sort(np.asarray(x, np.int64).view(np.uint64)) for x in batch.column("hit").slice(i, j - i).to_pylist()]
            for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                own, w, ends = [], h[a:b], np.array([0, b - a])
                for k in sizes:
                    if k == WINDOW:
                        g, pos = fingerprints(w, ends)
                        p = np.unique((pos[_known(hit[r], g)[0]][:, None] - np.arange(SPAN)).ravel())
                        p = p[(p >= 0) & (p + k <= b - a)]
                        g = _text.grams_at(w, p, k)
                    else:
                        p = _starts(len(w), ends, k)
                        g = _text.grams_at(w, p, k)
                        on = _known(hit[r], g)[0]
                        p, g = p[on], g[on]
                    order = np.argsort(g, kind="stable")
                    edge = np.flatnonzero(np.r_[True, g[order][1:] != g[order][:-1], True]) if len(g) else np.empty(0, np.int64)
                    own += [{"k": k, "key": int(g[order[s]].view(np.int64)), "at": _spans(p[order[s:e]], np.full(e - s, k))} for s, e in zip(edge[:-1], edge[1:], strict=True)]
                out.append(own)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(out, _WINDOW)], names=["doc_id", "th", "w"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for own in batch.column("spans").to_pylist():
            s = np.array([(x["s"], x["e"]) for x in own], np.int64).reshape(-1, 2)
            spans.append(_spans(s[:, 0], s[:, 1] - s[:, 0]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_th", "sets")), pa.array(spans, _HIT)], names=["_id", "_th", "sets", "spans"])


_SPANS = "array<struct<s:int,e:int>>"


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As the scan with a broadcast index, for a benchmark of any size.

    Fingerprints of documents are joined with those of items; a document's hits go back to its text, and only the windows
    around them are joined with the items' windows. A window knows its set of items by number of members and two sums of
    their hashes; sets meet documents, each once, before their members are listed.
    """
    scratch = Scratch(docs.sparkSession)
    windows = scratch.write(items.mapInArrow(lambda it: _item_keys(it, True), "item_id string, k int, keys array<long>").select("item_id", "k", F.explode("keys").alias("key")).distinct())
    sizes = sorted(r.k for r in windows.select("k").distinct().collect())
    prints = items.mapInArrow(lambda it: _item_keys(it, False), "item_id string, k int, keys array<long>").select(F.explode("keys").alias("key")).distinct()
    total = lambda h: F.sum(h.cast("decimal(38,0)"))
    held = windows.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n"), total(F.xxhash64("item_id")).alias("a"), total(F.xxhash64(F.lit(1), "item_id")).alias("b"))
    held = scratch.write(held.select("k", "key", F.struct("n", "a", "b").alias("set")))
    members = held.groupBy("set").agg(F.min(F.struct("k", "key")).alias("w")).select("set", "w.*").join(windows, ["k", "key"]).select("set", "item_id")
    seen = docs.mapInArrow(lambda it: _doc_prints(it, [k for k in sizes if k < WINDOW]), "doc_id long, th long, n_words long, keys array<long>")
    same = lambda d, h: d.doc_id.eqNullSafe(h._id) & d.th.eqNullSafe(h._th)
    hit = seen.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", F.explode("keys").alias("key")).join(prints, "key", "left_semi")
    hit = scratch.write(hit.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list("key").alias("hit")))
    own = docs.join(hit, same(docs, hit)).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "text", "hit")
    own = own.mapInArrow(lambda it: _near_windows(it, sizes), "doc_id long, th long, w array<struct<k:int,key:long,at:array<struct<s:int,e:int>>>>")
    own = own.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.explode("w").alias("w")).select("_id", "_th", "w.*").join(held, ["k", "key"])
    own = own.groupBy("_id", "_th").agg(F.flatten(F.collect_list("at")).alias("spans"), F.collect_set("set").alias("sets"))
    own = scratch.write(own.mapInArrow(_merged, f"_id long, _th long, sets array<struct<n:long,a:decimal(38,0),b:decimal(38,0)>>, spans {_SPANS}"))
    listed = own.select("_id", "_th", F.explode("sets").alias("set")).join(members, "set").groupBy("_id", "_th").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    listed = listed.withColumnsRenamed({"_id": "_i", "_th": "_t"})
    own = own.join(listed, own._id.eqNullSafe(listed._i) & own._th.eqNullSafe(listed._t)).select("_id", "_th", "spans", "items")
    counts = docs.mapInArrow(lambda it: _doc_prints(it, []), "doc_id long, th long, n_words long, keys array<long>").select("doc_id", "th", "n_words")
    out = counts.join(own, same(counts, own), "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select("doc_id", "th", "n_words", none("spans", _SPANS), none("items", "array<string>"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, items, n_hit, contaminated) of every row of ``docs`` (doc_id, text).

    ``spans`` are the maximal ranges of words covered by windows of 13 consecutive words of an item of ``benchmark``
    (item_id, text; an item of fewer words is one window), ``items`` the sorted ids of items with such a window,
    ``n_hit`` the words covered; a document is contaminated when they are a twentieth of its words or more.

    Items are winnowed: of each 9 consecutive 5-word hashes the smallest stays, so any 13 shared words share
    a fingerprint. Documents are winnowed alike; a fingerprint that hits is extended to the windows around it, whose
    hashes are looked up, so a text that repeats itself costs no more than another of its length.

    The fingerprints and windows of up to 4,000,000 benchmark words are broadcast, and documents are scanned once
    without a shuffle. A larger benchmark is joined: distinct fingerprints of documents with those of items, then the
    windows around the fingerprints that hit. Both ways give the same rows; in both, items that share a passage are
    one set of its windows, and a set meets a document once.

    Null and wordless texts have no words and no hits. Items without an id or words are ignored; rows that
    repeat an id add up to one item. An empty benchmark leaves every document clean. Each row of ``docs`` gives one
    row, repeated ones too. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    hashed = Scratch(spark).write(items.mapInArrow(_hashed, "item_id string, w binary").where("length(w) > 0"))
    total = hashed.agg(F.sum(F.length("w"))).first()[0] or 0
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    if total // 8 <= BROADCAST_WORDS:
        index = spark.sparkContext.broadcast(Index([(r.item_id, np.frombuffer(bytes(r.w), np.uint64)) for r in hashed.collect()]))
        out = docs.mapInArrow(lambda it: _scanned(it, index), f"doc_id long, th long, n_words long, spans {_SPANS}, items array<string>")
    else:
        out = _joined(docs, hashed)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    out = out.withColumn("n_hit", covered)
    return out.select("doc_id", "n_words", "spans", "items", "n_hit", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "th")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows; all columns stay, whatever their names.

    Null and empty texts stay; repeated rows stay or go together; an empty table stays empty.
    """
    i, t = fresh(docs, "_id", "_th")
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias(i), F.col("th").alias(t)).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad[i]) & (F.xxhash64(docs["text"].cast("string")) == bad[t]), "left_anti")
