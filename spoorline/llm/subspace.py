"""Near-duplicate vectors by a subspace pigeonhole join (operator 5)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch, components

COSINE = 0.98
#: Blocks a vector is split into, leading dimensions of a block that its grid has, and vectors of a task's side.
BLOCKS, GRID, CHUNK = 8, 5, 512
#: Pairs whose block distances are held at once, and what rounding may add to a squared distance of unit vectors.
SLAB, SLACK = 1 << 19, 1e-6


def _rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _units(packed: list[bytes], d: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the same rotated; each row's result depends on that row alone."""
    x = np.frombuffer(b"".join(packed), "<f8").reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x, np.einsum("ij,kj->ik", x, _rotation(d), optimize=False)


def _parts(d: int) -> list[np.ndarray]:
    return np.array_split(np.arange(d), min(BLOCKS, d))


def _budget(part: np.ndarray, d: int, cosine: float) -> float:
    """A block's share of the squared distance 2 - 2 cosine is its share of the dimensions."""
    return (max(0.0, 2 - 2 * cosine) + SLACK) * len(part) / d


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes of doubles."""
    for batch in batches:
        column = batch.column("v")
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f8")
        end = np.cumsum(size)
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])
        bad, on = sums(~np.isfinite(flat)), sums(flat != 0)
        ok = (bad[end] == bad[end - size]) & (on[end] > on[end - size])
        out = [flat[e - n : e].tobytes() for e, n in zip(end[ok].tolist(), size[ok].tolist(), strict=True)]
        rows = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(rows), batch.column("label").filter(rows), pa.array(size[ok], pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "label", "d", "x"])


def _grid(d: int, cosine: float) -> tuple[list[float], int, int]:
    """Width of each block's cells, how many dimensions cells have, and bits a dimension: keys of cells are exact longs."""
    parts = _parts(d)
    widths = [2 * float(np.sqrt(_budget(p, d, cosine))) for p in parts]
    bits = int(np.ceil(np.log2(2 * np.ceil(1 / min(widths)) + 4)))
    return widths, max(1, min(GRID, min(map(len, parts)), 58 // bits)), bits


def _block(cell: np.ndarray, d: int, cosine: float) -> np.ndarray:
    _, lead, bits = _grid(d, cosine)
    return cell >> (lead * bits)


def _placed(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Each vector's home cell in each block, the later cells that its ball meets, and its coordinates in the block."""
    for batch in batches:
        dims, packed = batch.column("d").to_numpy(), batch.column("x").to_pylist()
        rows, cells, homes, sub = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)], []
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            rot = _units([packed[i] for i in own], int(d))[1]
            widths, lead, bits = _grid(int(d), cosine)
            for b, part in enumerate(_parts(int(d))):
                at = rot[:, part[:lead]] / widths[b]
                cell = np.floor(at).astype(np.int64)
                inside = at - cell
                low, high = inside**2, (1 - inside) ** 2
                coordinates = rot[:, part].astype("<f4")
                for step in itertools.product((-1, 0, 1), repeat=lead):
                    if next((s for s in step if s), 1) < 0:
                        continue
                    gap = sum((low[:, k] if s < 0 else high[:, k] for k, s in enumerate(step) if s), np.zeros(len(own)))
                    on = np.flatnonzero(gap <= 0.25)
                    key = np.full(len(on), b, np.int64)
                    for c in (cell[on] + np.array(step)).T:
                        key = (key << bits) + (c + (1 << (bits - 1)))
                    rows.append(own[on])
                    cells.append(key)
                    homes.append(np.full(len(on), not any(step)))
                    sub += [x.tobytes() for x in coordinates[on]]
        at = pa.array(np.concatenate(rows))
        columns = [batch.column(c).take(at) for c in ("id", "label", "d")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(cells)), pa.array(np.concatenate(homes)), pa.array(sub, pa.binary())], names=["id", "label", "d", "cell", "home", "s"])


def _near_rows(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by task (label, d, cell, i, j) those that have another of their task within the block's budget.

    In a task rows of side a (homes of chunk i) meet each other if i = j, and all rows of side b.
    """
    keys = ["label", "d", "cell", "i", "j"]

    def flagged(t: pa.Table) -> pa.Table:
        new = np.zeros(len(t), bool)
        for k in keys:
            c = pc.dictionary_encode(t.column(k)).combine_chunks().indices.to_numpy() if k == "label" else t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        task = np.cumsum(new)
        side = ~(t.column("home").to_numpy(zero_copy_only=False) & (t.column("chunk").to_numpy() == t.column("i").to_numpy()))
        order = np.lexsort((side, task))
        task, side = task[order], side[order]
        end = np.searchsorted(task, task, "right")
        first_b = np.searchsorted(task * 2 + side, task * 2 + 1, "left")
        begin = np.where((t.column("i").to_numpy() == t.column("j").to_numpy())[order], np.arange(len(task)) + 1, first_b)
        a = np.flatnonzero(~side)
        n = np.maximum(0, end[a] - begin[a])
        dims = t.column("d").to_numpy()[order]
        cells = t.column("cell").to_numpy()[order]
        packed, hit = t.column("s").to_pylist(), np.zeros(len(task), bool)
        for d in np.unique(dims):
            which = np.where(dims == d, _block(cells, int(d), cosine), -1)
            for b, part in enumerate(_parts(int(d))):
                own = np.flatnonzero(which == b)
                if not len(own):
                    continue
                x = np.zeros((len(task), len(part)), np.float32)
                x[own] = np.frombuffer(b"".join(packed[k] for k in order[own]), "<f4").reshape(-1, len(part))
                mine = np.flatnonzero(which[a] == b)
                limit, at = _budget(part, int(d), cosine) + SLACK, 0
                upto = np.cumsum(n[mine])
                while at < len(mine):
                    stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLAB, "right")))
                    r, c = mine[at:stop], n[mine[at:stop]]
                    u = np.repeat(a[r], c)
                    v = np.repeat(begin[a[r]] - (np.cumsum(c) - c), c) + np.arange(len(u))
                    gap = x[u] - x[v]
                    ok = np.einsum("ij,ij->i", gap, gap) <= limit
                    hit[u[ok]] = hit[v[ok]] = True
                    at = stop
        return t.take(pa.array(np.sort(order[hit]))).select(["id", *keys, "home", "chunk"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        last = [batch.column(k)[-1] for k in keys]
        if held and all(held[0].column(k)[0] == x for k, x in zip(keys, last, strict=True)):
            held.append(batch)  # still one task
            continue
        same = np.ones(len(batch), bool)
        for k, x in zip(keys, last, strict=True):
            same &= pc.equal(batch.column(k), x).to_numpy(zero_copy_only=False)
        cut = len(batch) - int(same.sum())
        yield from flagged(pa.Table.from_batches([*held, batch.slice(0, cut)])).to_batches()
        held = [batch.slice(cut)]
    if held:
        yield from flagged(pa.Table.from_batches(held)).to_batches()


def _compared(g: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of one task: what they add to each vector's count, a spanning forest of them, and the pairs compared in full.

    A pair counts in the first block whose budget it keeps, so it counts once however many blocks find it.
    """
    d, i, j = int(g["d"].iloc[0]), g["i"].iloc[0], g["j"].iloc[0]
    parts = _parts(d)
    block = int(_block(g["cell"].iloc[0], d, cosine))
    budget = np.array([_budget(p, d, cosine) for p in parts])
    unit, rot = _units(list(g["x"]), d)
    ids, mult = g["id"].to_numpy(), g["m"].to_numpy()
    a = np.flatnonzero(g["home"].to_numpy() & (g["chunk"] == i).to_numpy())
    b = np.setdiff1d(np.arange(len(g)), a, assume_unique=True)
    count, parent, full = np.zeros(len(g), np.int64), np.arange(len(g)), 0

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    own_block = rot[:, parts[block]]
    for others, upper in ((a, True), (b, False)):
        if upper and i != j or not len(others):
            continue
        for s in range(0, len(a), 64):
            own = a[s : s + 64]
            gap = own_block[own][:, None, :] - own_block[others][None, :, :]
            r, c = np.nonzero(np.einsum("abk,abk->ab", gap, gap) <= budget[block])
            if upper:
                r, c = r[c > r + s], c[c > r + s]
            full += len(r)
            u, v = own[r], others[c]
            on = np.einsum("ij,ij->i", unit[u], unit[v]) >= cosine
            u, v = u[on], v[on]
            if not len(u):
                continue
            gap = (rot[u] - rot[v]) ** 2
            on = (np.stack([gap[:, p].sum(axis=1) for p in parts], axis=1) <= budget).argmax(axis=1) == block
            u, v = u[on], v[on]
            np.add.at(count, u, mult[v])
            np.add.at(count, v, mult[u])
            for x, y in zip(u.tolist(), v.tolist(), strict=True):
                p, q = root(x), root(y)
                if p != q:
                    parent[p] = q
                    edges.append((ids[x], ids[y]))
    linked = np.flatnonzero(count)
    out = [pd.DataFrame({"id": ids[linked], "n": count[linked], "u": -1, "v": -1, "full": 0}), pd.DataFrame({"id": -1, "n": 0, "u": [e[0] for e in edges], "v": [e[1] for e in edges], "full": 0})]
    return pd.concat([*out, pd.DataFrame({"id": [-1], "n": [0], "u": [-1], "v": [-1], "full": [full]})]).astype("int64")


def linked(reps: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """(id, n, u, v, full) of distinct vectors ``reps`` (id, m, label, d, x): counts of links, links, comparisons in full."""
    key = ["label", "d", "cell"]
    placed = scratch.write(reps.select("id", "label", "d", "x").mapInArrow(lambda it: _placed(it, cosine), "id long, label string, d int, cell long, home boolean, s binary"))
    crowd = placed.groupBy(*key).agg(F.ceil(F.sum(F.col("home").cast("int")) / CHUNK).cast("int").alias("hb"), F.ceil(F.sum((~F.col("home")).cast("int")) / CHUNK).cast("int").alias("vb"))
    crowd = scratch.write(crowd.where("hb > 1 or (hb = 1 and vb > 1)"))
    dealt = placed.join(crowd, key, "left").withColumns({"hb": F.coalesce("hb", F.lit(1)), "vb": F.coalesce("vb", F.lit(1))})
    chunk = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("hb")).otherwise(F.greatest("vb", F.lit(1)))).cast("int")
    dealt = dealt.withColumn("chunk", chunk)
    mates = F.expr("case when home then concat(sequence(0, hb - 1), case when vb > 1 then sequence(hb, hb + vb - 1) else cast(array() as array<int>) end) else sequence(0, hb - 1) end")
    dealt = dealt.withColumn("o", F.explode(mates))
    i = F.expr("case when home then least(chunk, o) else o end")
    j = F.expr("case when home then greatest(chunk, o) when vb > 1 then hb + chunk else o end")
    task = [*key, "i", "j"]
    dealt = dealt.select("id", *key, "home", "chunk", i.alias("i"), j.alias("j"), "s").repartition(*task).sortWithinPartitions(*task)
    near = dealt.mapInArrow(lambda it: _near_rows(it, cosine), "id long, label string, d int, cell long, i int, j int, home boolean, chunk int")
    near = scratch.write(near)
    scratch.drop(placed)
    full = near.join(reps.select("id", "m", "x"), "id").groupBy(*task).applyInPandas(lambda g: _compared(g, cosine), "id long, n long, u long, v long, full long")
    return scratch.write(full)


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Vectors of equal, non-null label and equal length link when their cosine, in doubles, reaches ``cosine``:
    for unit vectors, when their squared distance is 2 - 2 cosine at most. A fixed rotation spreads that over 8
    blocks; in one block at least it is at most the block's share. Each block is range-joined over a grid on its
    leading 5 dimensions with cells of twice the radius: a vector is at home in one cell and visits the later
    cells that its ball meets. Rows carry the block's coordinates only; those within the budget of another in the
    whole block fetch their vectors, and pairs within the block's budget are verified on these.

    Equal vectors are one, with a multiplicity. Crowded cells are dealt out as pairs of chunks of about 512 vectors,
    and a task returns counts and a spanning forest, not pairs.

    Null, zero and non-finite vectors, and rows without a label or id, link with nothing: 0 links, their own id
    as component. Rows of one vec_id are one vector (of several, the smallest by label, length and bytes) and give
    repeated results. Other columns are ignored; an empty table gives an empty result. A ``cosine`` of 1 links
    vectors whose cosine is 1 in doubles.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    usable = rows.where("vec_id is not null and label is not null and v is not null").mapInArrow(_packed, "vec_id long, label string, d int, x binary")
    one = usable.groupBy("vec_id").agg(F.min(F.struct("label", "d", "x")).alias("r"))
    member = scratch.write(one.select("vec_id", "r.*"))
    reps = scratch.write(member.groupBy("label", "d", "x").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("m")))
    found = linked(reps, cosine, scratch)
    links = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    comp = components(scratch, found.where("u <> v").select("u", "v")).withColumnRenamed("component_id", "c")
    known = reps.join(links, "id", "left").join(comp, "id", "left").select("label", "d", "x", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("c", "id").alias("c"))
    known = member.join(known, ["label", "d", "x"]).groupBy("vec_id").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    out = rows.select("vec_id").join(known, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
