"""Language of every word by a linear-chain conditional random field (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._sample import sampled
from .quality import held_out

#: Hashed n-gram and affix features; lexicon words a language; training documents a language, and the words at which they are enough.
BITS, LEXICON, DOCS_PER_LANG, WORDS_PER_LANG = 17, 2_000, 250, 120_000
EPOCHS = 25
_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1


def _spelled(text: Column) -> Column:
    """In lower case, with a space for all beyond ASCII that is neither a letter nor a mark on one."""
    low = F.lower(text.cast("string"))
    # As many bytes as characters: all ASCII, nothing to replace.
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.regexp_replace(low, r"[^\p{L}\p{M}\x00-\x7F]+", " "))


@dataclass
class Words:
    """Distinct words of some rows (``which``: of each word in order), with row and line of each word."""

    hashes: np.ndarray
    features: np.ndarray
    owner: np.ndarray
    which: np.ndarray
    row: np.ndarray
    line: np.ndarray


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of letters (of text as ``_spelled`` leaves it) and the features of the distinct ones.

    Features: all 2-, 3- and 4-byte grams of the word between two boundary marks; those with a mark are its
    affixes.
    """
    starts, ends, at = _text.runs(data, offsets, _LETTER[data])
    h = _text.run_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, starts) + row
    hashes, first, which = np.unique(h, return_index=True, return_inverse=True)
    size = ends[first] - starts[first] + 2
    edge = np.cumsum(size) - size
    total = int(size.sum())
    owner = np.repeat(np.arange(len(first)), size)
    inner = np.arange(total) - np.repeat(edge, size)
    chars = data[np.minimum(np.repeat(starts[first], size) + np.maximum(inner - 1, 0), max(0, len(data) - 1))].astype(np.uint64) if total else np.empty(0, np.uint64)
    chars[inner == 0] = 1
    chars[inner == np.repeat(size, size) - 1] = 2
    left = np.repeat(size, size) - inner
    feats, owners = [], []
    gram = chars.copy()
    for n in range(2, 5):
        if total < n:
            break
        gram = gram[: total - n + 1] | (chars[n - 1 :] << np.uint64(8 * (n - 1)))
        ok = left[: len(gram)] >= n
        feats.append((_text.mix(gram[ok] * np.uint64(8) + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[: len(gram)][ok])
    f = np.concatenate(feats) if feats else np.empty(0, np.int64)
    o = np.concatenate(owners) if owners else np.empty(0, np.int64)
    order = np.argsort(o, kind="stable")
    return Words(hashes, f[order], o[order], which, row, line)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # feature, language
    lexicon: np.ndarray  # sorted word hashes
    lex_weights: np.ndarray  # word, language
    moves: np.ndarray  # language, language

    def emissions(self, w: Words) -> np.ndarray:
        """Of each distinct word, per language."""
        out = np.zeros((len(w.hashes), len(self.langs)))
        if len(w.features):
            edge = np.flatnonzero(np.r_[True, w.owner[1:] != w.owner[:-1]])
            out[w.owner[edge]] = np.add.reduceat(self.weights[w.features], edge, axis=0)
        known, at = self.find(w.hashes)
        out[known] += self.lex_weights[at]
        return out

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.lexicon):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        known = np.flatnonzero(self.lexicon[at] == hashes)
        return known, at[known]


def forward_backward(scores: np.ndarray, chain: np.ndarray, moves: np.ndarray, expect: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each position, chain by chain (``chain``: non-decreasing ids), and expected moves if asked for.

    All chains step together, longest first, each message scaled to sum to one.
    """
    n, k = scores.shape
    if not n:
        return scores, np.zeros((k, k))
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    t = np.exp(moves - moves.max())
    first = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
    size = np.diff(np.r_[first, n])
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # chains of at least so many positions
    alpha, beta = np.empty_like(e), np.ones_like(e)
    a = e[first]
    alpha[first] = a / a.sum(axis=1, keepdims=True)
    for s in range(1, int(size[0])):
        at = first[: alive[s]] + s
        a = (alpha[at - 1] @ t) * e[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    for s in range(int(size[0]) - 2, -1, -1):
        at = first[: alive[s + 1]] + s
        b = (e[at + 1] * beta[at + 1]) @ t.T
        beta[at] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    moved = np.zeros((k, k))
    if expect:
        inner = np.flatnonzero(np.r_[False, chain[1:] == chain[:-1]])
        pair = alpha[inner - 1][:, :, None] * t[None] * (e[inner] * beta[inner])[:, None, :]
        moved = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p, moved


def fit(docs: DataFrame, folds: int = 5, fold: int = 0) -> Model:
    """A model from text and non-null lang of ``docs`` outside the held-out fold.

    A hashed sample of about 250 documents a language trains it (in random order, as many as are needed to reach
    120,000 words, always whole texts): words take their document's language, and lines of the sample are joined two
    and two at random, so chains switch languages as mixed texts do. Weights follow the likelihood's gradient, observed less expected features and
    moves, by AdaGrad.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    size = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(size)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)), np.empty(0, np.uint64), np.zeros((0, 0)), np.zeros((0, 0)))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, DOCS_PER_LANG / size[lang]))])
    sample = known.where(sampled("doc_id", share[F.col("lang")])).withColumn("text", _spelled(F.col("text"))).distinct().collect()
    sample.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    data, offsets = np.frombuffer(b"".join(r.text.encode() for r in sample), np.uint8), np.cumsum([0] + [len(r.text.encode()) for r in sample])
    w = read_words(data, offsets)
    label = np.array([langs.index(r.lang) for r in sample])[w.row]
    rng = np.random.default_rng(11)
    shuffled = rng.permutation(len(sample))
    size_of, lang_of = np.bincount(w.row, minlength=len(sample)), np.array([langs.index(r.lang) for r in sample])
    used = np.zeros(len(sample), bool)
    for y in range(len(langs)):
        own = shuffled[lang_of[shuffled] == y]
        used[own[np.cumsum(size_of[own]) - size_of[own] < WORDS_PER_LANG]] = True
    on = np.flatnonzero(used[w.row])
    lines = np.unique(w.line[on])
    place = rng.permutation(len(lines))
    chain = place[np.searchsorted(lines, w.line[on])]
    order = np.argsort(chain, kind="stable")
    on, chain = on[order], chain[order] // 2
    which, label, k = w.which[on], label[on], len(langs)
    count = np.zeros((len(w.hashes), k))
    np.add.at(count, (which, label), 1)
    top = np.unique(np.concatenate([np.argsort(-count[:, y], kind="stable")[:LEXICON] for y in range(k)]))
    top = top[count[top].sum(axis=1) > 1]
    model = Model(langs, np.zeros((1 << BITS, k)), w.hashes[top], np.zeros((len(top), k)), np.zeros((k, k)))
    inner = np.flatnonzero(chain[1:] == chain[:-1])
    seen = np.zeros((k, k))
    np.add.at(seen, (label[inner], label[inner + 1]), 1)
    known_words, at = model.find(w.hashes)
    sums = [np.full_like(x, 1e-6) for x in (model.weights, model.lex_weights, model.moves)]
    n = len(label)
    for _ in range(EPOCHS):
        p, moved = forward_backward(model.emissions(w)[which], chain, model.moves, expect=True)
        of_word = np.stack([count[:, y] - np.bincount(which, p[:, y], len(w.hashes)) for y in range(k)], axis=1)
        grad = np.stack([np.bincount(w.features, of_word[w.owner, y], 1 << BITS) for y in range(k)], axis=1)
        lex = np.zeros_like(model.lex_weights)
        lex[at] = of_word[known_words]
        for x, g, s in zip((model.weights, model.lex_weights, model.moves), (grad, lex, seen - moved), sums, strict=True):
            g = g / n - 1e-6 * x
            s += g * g
            x += 0.3 * g / np.sqrt(s)
    return model


def _labelled(batches: Iterator[pa.RecordBatch], model, words_out: bool) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        has = batch.column("letters").to_pylist()
        lang, score, per_word = [], [], []
        for i, j, data, offsets in _text.chunks(batch.column("text")):
            w = read_words(data, offsets)
            k = len(m.langs)
            p, _ = forward_backward(m.emissions(w)[w.which], w.line, m.moves) if k else (np.zeros((len(w.which), 0)), None)
            mean = np.zeros((j - i, k))
            n = np.maximum(1, np.bincount(w.row, minlength=j - i))
            for y in range(k):
                mean[:, y] = np.bincount(w.row, p[:, y], j - i) / n
            best = mean.argmax(axis=1) if k else np.zeros(j - i, np.int64)
            edge = np.searchsorted(w.row, np.arange(j - i + 1))
            for r in range(j - i):
                ok = bool(has[i + r]) and k > 0
                lang.append(m.langs[best[r]] if ok else "und")
                score.append(min(1.0, float(mean[r, best[r]])) if ok else 0.0)
                if words_out:
                    per_word.append([m.langs[y] for y in p[edge[r] : edge[r + 1]].argmax(axis=1)] if ok else [])
        columns, names = [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
        if words_out:
            columns, names = [*columns, pa.array(per_word, pa.list_(pa.string()))], [*names, "word_langs"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def identify(docs: DataFrame, model: Model, words_out: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text); with ``words_out`` also word_langs.

    Words are labelled line by line by forward-backward; a document's language has the largest mean of its
    words' marginals, which is the score. Null text and text without a letter give ``und`` with score 0, as does
    a model without languages. Repeated rows give repeated results; other columns are ignored; an empty table
    gives an empty result. Very long lines are one chain each, in memory of a few bytes a word and language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _spelled(text).alias("text"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("letters"))
    return docs.mapInArrow(lambda it: _labelled(it, sent, words_out), "doc_id long, lang_pred string, score double" + ", word_langs array<string>" * words_out)
