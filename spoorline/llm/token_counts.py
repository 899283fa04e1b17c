"""Token counts by a map-side two-tier lookup (operator 6)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pieces import splitter
from ._sample import sampled

#: Entries and longest entry of the broadcast table, about 8 MB in a worker; and documents it is drawn from.
TABLE, LONGEST, SAMPLE = 65_536, 32, 4_000
#: Entries of a worker's own cache.
CACHE = 200_000


class _Lengths(dict):
    """Pre-token -> number of tokens; a miss is encoded and, while there is room, remembered."""

    def __init__(self, table: dict[str, int], split) -> None:
        super().__init__(table)
        self.room, self.encode = len(table) + CACHE, split.encode

    def __missing__(self, word: str) -> int:
        n = len(self.encode([word])[0])
        if len(word) <= LONGEST and len(self) < self.room:
            self[word] = n
        return n


def _counted(batches: Iterator[pa.RecordBatch], spec, table) -> Iterator[pa.RecordBatch]:
    split = splitter(spec.value)
    lengths = _Lengths(table.value, split)
    get = lengths.__getitem__
    for batch in batches:
        n = [0 if t is None else sum(map(get, split(t))) for t in (x.as_py() for x in batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def _frequent(batches: Iterator[pa.RecordBatch], spec) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for t in batch.column("text"):
            seen.update(w for w in splitter(spec.value)(t.as_py()) if len(w) <= LONGEST)
    words = list(seen)
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], names=["w", "n"])


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text), as the tokenizers library counts.

    ``tokenizer_path``: a byte-level BPE JSON file that the driver can read. The lengths of the 65,536 most
    frequent pre-tokens (of a hashed sample of about 4,000 documents; the table saves work and cannot change a
    count) are broadcast. Other pre-tokens are encoded where they occur, through a cache in each worker. No text
    or pre-token of the corpus is shuffled.

    Null counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated results; other columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = Path(tokenizer_path).read_text(encoding="utf-8")
    spec = spark.sparkContext.broadcast(text)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    share = min(1.0, SAMPLE / max(1, docs.count()))
    sample = docs.where(F.col("text").isNotNull() & sampled("doc_id", share)).select("text")
    top = sample.mapInArrow(lambda it: _frequent(it, spec), "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(TABLE)
    words = [r.w for r in top.select("w").collect()]
    table = spark.sparkContext.broadcast(dict(zip(words, map(len, splitter(text).encode(words)), strict=True)))
    counted = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).mapInArrow(lambda it: _counted(it, spec, table), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
