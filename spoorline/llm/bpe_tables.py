"""BPE encoding and decoding by a table of distinct words (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._pieces import piece_bytes, splitter
from ._scratch import Scratch

#: A bundle of documents ends at so many distinct words or characters of text.
BUNDLE_WORDS, BUNDLE_CHARS = 200_000, 24_000_000
#: Text behind one part of the distinct words (their lists are about a fifteenth of it), fewest and most parts, most buckets.
PART_CHARS, FEWEST_PARTS, MOST_PARTS, MOST_BUCKETS = 512_000_000, 64, 65_536, 65_536


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def pack(codes: np.ndarray) -> bytes:
    """Little-endian base-128 digits, the last of each number below 128."""
    size = 1 + (codes >= 1 << 7).astype(np.int64) + (codes >= 1 << 14) + (codes >= 1 << 21) + (codes >= 1 << 28)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for d in range(int(size.max()) if len(size) else 0):
        on = size > d
        out[at[on] + d] = ((codes[on] >> (7 * d)) & 127) | np.where(size[on] > d + 1, 128, 0)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    last = b < 128
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    digit = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * digit), first)


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def loosen(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _offsets(packed: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(unpack(packed))]).astype(np.int64)


_STAGE = pa.schema([("bundle", pa.int64()), ("part", pa.int32()), ("size", pa.binary()), ("body", pa.binary()), ("doc_id", pa.int64()), ("codes", pa.binary())])


def _listed(bundle: int, codes: _Codes, parts: int) -> pa.RecordBatch:
    """A bundle's words dealt by hash into parts: lengths, bytes and codes (as differences) of each part's words."""
    words = [w.encode() for w in codes]
    size = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(words), np.uint8)
    part = (_text.run_hashes(data, ends - size, ends) % np.uint64(parts)).astype(np.int64)
    rows = []
    for p in np.unique(part).tolist():
        own = np.flatnonzero(part == p)
        rows.append((p, pack(size[own]), squeeze(b"".join(words[i] for i in own.tolist())), pack(np.diff(own, prepend=0))))
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, bundle)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.nulls(n, pa.int64()), pa.array([r[3] for r in rows], pa.binary())], schema=_STAGE)


def _split(batches: Iterator[pa.RecordBatch], spec, parts: int) -> Iterator[pa.RecordBatch]:
    """Documents as positions in a word list of their bundle, and the lists."""
    split = splitter(spec.value)
    bundle, codes, chars = TaskContext.get().partitionId() << 32, _Codes(), 0
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        rows: list[tuple] = []
        for doc_id, text in zip(ids, texts, strict=True):
            t = text.as_py() or ""
            rows.append((bundle, doc_id, squeeze(pack(np.fromiter(map(codes.__getitem__, split(t)), np.int64)))))
            chars += len(t)
            if len(codes) >= BUNDLE_WORDS or chars >= BUNDLE_CHARS:
                yield _listed(bundle, codes, parts)
                bundle, codes, chars = bundle + 1, _Codes(), 0
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], schema=_STAGE)
    if codes:
        yield _listed(bundle, codes, parts)


def _encoded(g: pd.DataFrame, spec) -> pd.DataFrame:
    """Ids of one part's words: each distinct word is encoded once, and its ids join every list that has it."""
    split, lists = splitter(spec.value), []
    for size, body in zip(g["size"], g["body"], strict=True):
        at, data = _offsets(size).tolist(), loosen(body)
        lists.append([data[a:b] for a, b in zip(at, at[1:], strict=False)])
    which, words = pd.factorize(np.array([w for x in lists for w in x] + [None], object)[:-1])
    ids: list[list[int]] = []
    for a in range(0, len(words), 4096):
        ids += split.encode([w.decode() for w in words[a : a + 4096]])
    n = np.array([len(x) for x in ids], np.int64)
    first, flat = np.cumsum(n) - n, np.array([i for x in ids for i in x], np.int64)
    out, at = [], 0
    for own in lists:
        k = which[at : at + len(own)]
        at += len(own)
        out.append((pack(n[k]), squeeze(pack(flat[np.repeat(first[k] - (np.cumsum(n[k]) - n[k]), n[k]) + np.arange(n[k].sum())]))))
    return pd.DataFrame({"of": g["bundle"], "size": [x[0] for x in out], "ids": [x[1] for x in out], "at": g["codes"]})


def _joined(docs: pd.DataFrame, table: pd.DataFrame, pieces, digest: bool) -> pd.DataFrame:
    """The ids of each document of a bundle, by position, and the text that their pieces spell."""
    size = [unpack(x) for x in table["size"]]
    code = np.concatenate([*(np.cumsum(unpack(x)) for x in table["at"]), np.empty(0, np.int64)])
    size, flat = np.concatenate([*size, np.empty(0, np.int64)]), np.concatenate([*(unpack(loosen(x)) for x in table["ids"]), np.empty(0, np.int64)])
    start = np.cumsum(size) - size
    order = np.argsort(code)
    size, at = size[order], start[order]
    piece = pieces.value
    spelled = [b"".join(map(piece.__getitem__, flat[a : a + n].tolist())) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
    out = []
    for doc_id, packed in zip(docs["doc_id"], docs["codes"], strict=True):
        codes = unpack(loosen(packed))
        n = size[codes]
        own = flat[np.repeat(at[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype("<u4")
        text = b"".join(map(spelled.__getitem__, codes.tolist())).decode("utf-8", "replace")
        out.append((doc_id, len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) if digest else (doc_id, len(own), own.astype(np.int32), text))
    frame = pd.DataFrame(out, columns=["doc_id", "n_tokens", "a", "b"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def layout(chars: int, tasks: int) -> tuple[int, int]:
    """Parts of the distinct words, and buckets of the bundles, for so many characters of text.

    Beyond the most parts and buckets each holds more, not fewer: a bundle's list has at most 200,000 words, and at
    65,536 parts a row of it still carries some of them; a bucket holds several bundles, which are joined one by one.
    """
    parts = min(MOST_PARTS, max(FEWEST_PARTS, -(-chars // PART_CHARS)))
    return parts, min(MOST_BUCKETS, max(tasks, -(-chars // BUNDLE_CHARS)))


def encode_and_decode(docs: DataFrame, tokenizer_path: str, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row of ``docs`` (doc_id, text), as the tokenizers library gives them.

    With ``digest``: (doc_id, n_tokens, ids_sha256, decoded_sha256) instead of ids and text.

    Each task splits its documents into words and writes, for bundles of at most about 24,000,000 characters,
    the list of distinct words, dealt by hash into parts, and each document as positions in the list. A part
    brings together its words of all bundles (about 512,000,000 characters of text stand behind one), encodes each
    distinct word once and sends the ids back to the lists; each bundle's ids then meet its documents by position.
    Documents are written in buckets by bundle, so their positions are not shuffled; the catalog has to take a table
    for that moment. Pieces come through a broadcast table of the vocabulary (50,257 entries), by which each distinct
    word of a bundle is spelled once. Shuffles carry packed words, ids and positions, not texts.

    Null encodes as empty. Repeated rows give repeated results; other columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = Path(tokenizer_path).read_text(encoding="utf-8")
    spec, pieces = spark.sparkContext.broadcast(text), spark.sparkContext.broadcast(piece_bytes(text))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts, buckets = layout(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    staged = scratch.write_bucketed(docs.mapInArrow(lambda it: _split(it, spec, parts), "bundle long, part int, size binary, body binary, doc_id long, codes binary"), "bundle", buckets)
    lists = staged.where("part is not null").select("bundle", "part", "size", "body", "codes")
    table = lists.groupBy("part").applyInPandas(lambda g: _encoded(g, spec), "of long, size binary, ids binary, at binary")
    rows = staged.where("part is null").select("bundle", "doc_id", "codes")
    last = "a string, b string" if digest else "a array<int>, b string"
    out = rows.groupBy("bundle").cogroup(table.groupBy("of")).applyInPandas(lambda d, t: _joined(d, t, pieces, digest), f"doc_id long, n_tokens long, {last}")
    return out.toDF("doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")))
