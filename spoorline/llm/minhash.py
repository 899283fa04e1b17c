"""Near-duplicate documents by DartMinHash signatures and banded joining (operator 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._scratch import Scratch, components, fresh

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
K = BANDS * ROWS
MARGIN = 0.18  # a pair at the threshold estimates this much lower once in ten million
#: Texts and shingles of a block of a large bucket; two blocks meet in one task.
BLOCK, BLOCK_SHINGLES = 256, 1 << 21


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int = K) -> np.ndarray:
    """``k`` dart ids of a weighted set; two sets agree in a coordinate with probability of their weighted Jaccard.

    Each element owns weight regions [0,1), [1,2), [2,4), ...; in each, darts fall as a Poisson process over
    (weight, rank) that hashes of element and region fix. Darts below the element's weight and below a
    rank limit theta count: about ``k ln k + 3k`` whatever the set's size. A coordinate keeps its earliest
    dart; if one has none, theta doubles.
    """
    theta = (k * math.log(k) + 3 * k) / float(weights.sum())
    while True:
        sig, found = np.zeros(k, np.uint64), []
        for region in range(max(0, math.ceil(math.log2(float(weights.max())))) + 1):
            low, width = (0.0, 1.0) if region == 0 else (2.0 ** (region - 1), 2.0 ** (region - 1))
            own = np.flatnonzero(weights > low)
            seed = _text.mix(elements[own] + np.uint64((region * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
            top = weights[own]
            rank, j0 = np.zeros(len(own)), 0
            step = max(1, math.ceil(theta * width * 1.2) + 1) if theta * width > 0.3 else 1
            while len(seed):
                ids = _text.mix(seed[:, None] ^ ((np.arange(j0, j0 + step, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)))
                ranks = rank[:, None] + np.cumsum(-np.log(_unit(_text.mix(ids + np.uint64(1)))), axis=1) / width
                height = low + width * _unit(_text.mix(ids + np.uint64(2)))
                r, c = np.nonzero((ranks < theta) & (height < top[:, None]))
                found.append((ranks[r, c], ids[r, c]))
                on = ranks[:, -1] < theta
                seed, top, rank, j0 = seed[on], top[on], ranks[on, -1], j0 + step
        ranks, ids = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        late_first = np.argsort(-ranks, kind="stable")
        ids = ids[late_first]
        coordinate = (_text.mix(ids + np.uint64(3)) % np.uint64(k)).astype(np.int64)
        sig[coordinate] = ids  # of darts in one coordinate the last written, the earliest, stays
        if len(np.unique(coordinate)) == k:
            return sig
        theta *= 2


def _signed(batches: Iterator[pa.RecordBatch], weighted: bool) -> Iterator[pa.RecordBatch]:
    mult = _text.mix(np.arange(1, ROWS + 1, dtype=np.uint64))
    for batch in batches:
        n, total, bands, sigs = [], [], [], []
        for _, _, data, offsets in _text.chunks(batch.column("text")):
            for s, count in _text.shingle_sets(data, offsets, SHINGLE):
                n.append(len(s))
                total.append(int(count.sum()) if weighted else len(s))
                if not len(s):
                    bands.append([])
                    sigs.append(b"")
                    continue
                sig = dart_signature(s, count.astype(float) if weighted else np.ones(len(s)))
                rows = (_text.mix(sig).reshape(BANDS, ROWS) * mult).sum(axis=1, dtype=np.uint64)
                bands.append(_text.mix(rows + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).view(np.int64))
                sigs.append(sig.astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h1"), batch.column("h2"), pa.array(n, pa.int32()), pa.array(total, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
            names=["doc_id", "h1", "h2", "n", "w", "bands", "sig"],
        )


def _close(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, K) for c in ("a", "b"))
        ok = pa.array((a == b).mean(axis=1) >= least)
        yield batch.select(["u", "v"]).filter(ok)


def _counted(s: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each shingle once per occurrence, numbered: the Jaccard similarity of these sets is the weighted one."""
    more = np.repeat(s, count)
    nth = np.arange(len(more)) - np.repeat(np.cumsum(count) - count, count)
    return np.sort(np.where(nth > 0, _text.mix(more + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), more))


def _shingled(batches: Iterator[pa.RecordBatch], weighted: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(_counted(s, n) if weighted else s).tobytes() for _, _, data, offsets in _text.chunks(batch.column("text")) for s, n in _text.shingle_sets(data, offsets, SHINGLE)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "s"])


def _exact(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            ok.append(same >= least * (len(both) - same) - 1e-9)
        yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _block_links(g: pd.DataFrame, least: float) -> pd.DataFrame:
    """A spanning forest of the links between different components in one pair of blocks."""
    g = g.drop_duplicates("id")
    sets = [np.frombuffer(x, np.uint64) for x in g["s"]]
    size = np.array([len(x) for x in sets])
    doc = np.repeat(np.arange(len(sets)), size)
    _, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[code] > 1
    doc, code = doc[shared], code[shared]
    code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    doc, code = doc[order], code[order]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, b = np.searchsorted(code, [lo, lo + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[doc[a:b], code[a:b] - lo] = 1
        inter += m @ m.T
    union = size[:, None] + size[None, :] - inter
    link = (inter >= least * union - 1e-6) & (g["comp"].to_numpy()[:, None] != g["comp"].to_numpy()[None, :])
    ids, seen_doc, out = g["id"].to_numpy(), np.zeros(len(sets), bool), []
    for root in range(len(sets)):
        stack = [] if seen_doc[root] else [root]
        seen_doc[root] = True
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(link[i] & ~seen_doc):
                seen_doc[j] = True
                out.append((ids[i], ids[j]))
                stack.append(int(j))
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _grouped(docs: DataFrame, weighted: bool, similarity: float) -> DataFrame:
    """(doc_id, h1, h2, n, component_id) of every row; h1 and h2 are hashes of its text."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    feats = scratch.write(keyed.mapInArrow(lambda it: _signed(it, weighted), "doc_id long, h1 long, h2 long, n int, w long, bands array<long>, sig binary"))
    texts = feats.where("n > 0 and doc_id is not null")
    reps = texts.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.first("w").alias("w"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps = scratch.write(reps.withColumn("id", F.monotonically_increasing_id()))
    bands = reps.select("id", "w", F.explode("bands").alias("bh"))
    shingles: list[DataFrame] = []

    def shingles_of(ids: DataFrame) -> DataFrame:
        """Of texts whose shingles are not yet written."""
        for have in shingles:
            ids = ids.join(have.select("id"), "id", "left_anti")
        own = keyed.join(reps.select("h1", "h2", "id", "doc").join(ids, "id"), ["h1", "h2"]).where("doc_id = doc").select("id", "text")
        new = scratch.write(own.mapInArrow(lambda it: _shingled(it, weighted), "id long, s binary").dropDuplicates(["id"]))
        shingles.append(new)
        out = shingles[0]
        for have in shingles[1:]:
            out = out.union(have)
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        sig = reps.select("id", "sig")
        close = pairs.join(sig.toDF("u", "a"), "u").join(sig.toDF("v", "b"), "v").select("u", "v", "a", "b")
        close = scratch.write(close.mapInArrow(lambda it: _close(it, similarity - MARGIN), "u long, v long"))
        s = shingles_of(close.select(F.col("u").alias("id")).union(close.select("v")).distinct())
        full = close.join(s.toDF("u", "a"), "u").join(s.toDF("v", "b"), "v").select("u", "v", "a", "b")
        out = scratch.write(full.mapInArrow(lambda it: _exact(it, similarity), "u long, v long"))
        scratch.drop(close)
        return out

    def open_buckets(comp: DataFrame) -> DataFrame:
        """Members (bh, id, w, comp) of buckets that hold several components; buckets of equal members count once."""
        member = bands.join(comp.withColumnRenamed("component_id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        several = member.groupBy("bh").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"))
        several = several.where("n > 2 and lo <> hi").groupBy("n", "lo", "hi", "mark").agg(F.min("bh").alias("bh"))
        return scratch.write(member.join(several.select("bh"), "bh"))

    def complete(rest: DataFrame) -> DataFrame:
        """Links within open buckets, block by block.

        Similar texts differ in size by the similarity at most, so a bucket falls into size classes of that ratio and
        a class meets itself and the next. Blocks of a class have about 256 texts, or about ``BLOCK_SHINGLES`` shingles if these are fewer texts.
        """
        ranked = rest.withColumn("k", F.floor(F.log("w") / -math.log(similarity)).cast("int"))
        size = ranked.groupBy("bh", "k").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("w") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        size = size.groupBy("bh").agg(F.map_from_entries(F.collect_list(F.struct("k", "blocks"))).alias("blocks"))  # a few classes a bucket
        ranked = ranked.join(size, "bh").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")[F.col("k")]).cast("int"))
        every = """concat(
            transform(sequence(0, blocks[k] - 1), o -> struct(k as k, false as up, least(own, o) as i, greatest(own, o) as j)),
            case when map_contains_key(blocks, k + 1) then transform(sequence(0, blocks[k + 1] - 1), o -> struct(k as k, true as up, own as i, o as j)) else array() end,
            case when map_contains_key(blocks, k - 1) then transform(sequence(0, blocks[k - 1] - 1), o -> struct(k - 1 as k, true as up, o as i, own as j)) else array() end)"""
        dealt = ranked.select("bh", "id", "comp", F.explode(F.expr(every)).alias("t")).select("bh", "id", "comp", "t.*")
        s = shingles_of(rest.select("id").distinct())
        return scratch.write(dealt.join(s, "id").groupBy("bh", "k", "up", "i", "j").applyInPandas(lambda g: _block_links(g, similarity), "u long, v long"))

    centre = bands.groupBy("bh").agg(F.min("id").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = verified(bands.join(centre, "bh").where("id <> u").select("u", F.col("id").alias("v")).distinct())
    comp = components(scratch, links)
    rest = open_buckets(comp)
    if not rest.isEmpty():
        degree = links.select(F.col("u").alias("id")).union(links.select("v")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
        hub = rest.join(degree, "id", "left").groupBy("bh").agg(F.max(F.struct(F.coalesce("d", F.lit(0)).alias("d"), F.col("id").alias("u"), F.col("comp").alias("c"))).alias("x"))
        more = verified(rest.join(hub.select("bh", "x.u", "x.c"), "bh").where("comp <> c").select("u", F.col("id").alias("v")).distinct())
        links = links.union(more)
        comp = components(scratch, links)
        rest = open_buckets(comp)
        if not rest.isEmpty():
            comp = components(scratch, links.union(complete(rest)))
    linked = comp.join(reps.select("id", "doc"), "id")
    low = linked.groupBy("component_id").agg(F.min("doc").alias("c"))
    group = reps.select("h1", "h2", "id", "doc").join(linked.select("id", "component_id").join(low, "component_id").select("id", "c"), "id", "left")
    group = group.select("h1", "h2", F.coalesce("c", "doc").alias("c"))
    out = feats.select("doc_id", "h1", "h2", "n").join(group, ["h1", "h2"], "left")
    return out.withColumn("component_id", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))).drop("c")


def near_duplicates(docs: DataFrame, weighted: bool = True, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Documents link when the Jaccard similarity of their five-word shingles reaches ``similarity``: shingles are
    weighted by their counts (smaller counts over larger ones), or with ``weighted`` off taken as sets. A component_id
    is the smallest doc_id that links reach; rows whose doc_id it is are kept.

    Byte-equal texts meet first, in one aggregation, so a group of copies counts as one text. Signatures of
    distinct texts go into 30 bands of 5 rows (a pair at 0.8 is missed once in 150,000 times). Texts of a
    bucket are compared with one centre each, first the first text, then the text with most links; buckets
    that still hold several components are compared completely, in size classes and blocks of about 256 by 256 texts (fewer
    of long texts) of which only a spanning forest leaves the task. So no group is emitted as pairs and no pair of a bucket is skipped.

    Null and wordless texts link with nothing and are kept; texts under five words have one shingle, all
    their words. Repeated rows give repeated results. Rows of one doc_id and several texts each have the component of
    their own text, and are kept where it is their doc_id. Rows without a doc_id have no component, link nothing and are
    kept. n_shingles counts distinct shingles. Other columns are ignored. An empty table gives an empty result.
    """
    out = _grouped(docs, weighted, similarity)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the near copies of another row; all columns stay, whatever their names.

    Rows go by doc_id and text, so another text of the same id stays; null and wordless texts, rows without an id and
    repeated rows of a kept document stay; an empty table stays empty.
    """
    i, a, b = fresh(docs, "_id", "_h1", "_h2")
    gone = _grouped(docs, True, SIMILARITY).where("doc_id <> component_id").select(F.col("doc_id").alias(i), F.col("h1").alias(a), F.col("h2").alias(b)).distinct()
    text = docs["text"].cast("string")
    return docs.join(gone, (docs["doc_id"].cast("long") == gone[i]) & (F.xxhash64(text) == gone[a]) & (F.xxhash64(F.lit(1), text) == gone[b]), "left_anti")
