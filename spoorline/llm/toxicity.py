"""Toxicity by a weighted finite-state pattern grammar (operator 11).

Words become symbols: insults from a lexicon of words and word beginnings that labelled texts teach with weights, threats,
targets, negation and reported speech from small fixed lists. Four transducers over these symbols are composed into one
automaton, which runs over each clause that holds an insult or a threat. A clause's weight is that of its insults and
threats, each times what negation, report and target make of it; a text's score is a logistic function of its clauses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._scratch import Scratch
from .quality import BROADCAST_ROWS, held_out

#: Labelled rows of each class in the sample; entries of the lexicon; parts of the sample that cross-fit each other.
PER_CLASS, ENTRIES, PARTS = 2_000, 5_000, 3
#: Characters of the word beginnings that may be entries, beside whole words.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: An entry's least texts of the class, log of rates and standard errors; the rate added to both before their log.
LEAST_TEXTS, LEAST_LOG, LEAST_ERRORS, SMOOTH = 3, 1.5, 5.0, 2e-5
THREAT_WEIGHT = 4.0
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
SEEDS = {
    THREAT: "kill murder hurt stab shoot strangle beat destroy töten umbringen verprügeln erschießen tuer frapper égorger étrangler matar golpear apuñalar",
    TARGET: "you your yours he she him her they them du dich dir ihr euch er ihn sie tu te toi vous il elle lui eux tú ti usted él ella ellos ellas",
    NEGATION: "not no never neither nor isn aren wasn don doesn didn cannot nicht kein keine keinen nie niemals ne pas jamais aucun aucune nunca jamás ningún ninguna tampoco",
    REPORT: "said says say called calls wrote writes claimed reported quoted according sagte sagt schrieb nannte dit disait écrit appelait selon dijo dice escribió llamó según",
}

Arcs = dict[tuple[int, int], tuple[int, int, float]]


def negation(scope: int = 3, factor: float = 0.2) -> Arcs:
    """What follows a negation within ``scope`` words counts ``factor``. State: words of scope left."""
    arcs: Arcs = {}
    for left in range(scope + 1):
        for s in range(7):
            weight = float(np.log(factor)) if left and s in (INSULT, THREAT) else 0.0
            arcs[left, s] = (scope if s == NEGATION else max(0, left - 1), s, weight)
    return arcs


def reported(factor: float = 0.5) -> Arcs:
    """What follows a verb of saying, or stands in quotes, counts ``factor``. States: direct, reported, in quotes."""
    arcs: Arcs = {}
    for state in range(3):
        for s in range(7):
            then = (2 if state != 2 else 0) if s == QUOTE else (1 if s == REPORT and state == 0 else state)
            arcs[state, s] = (then, s, float(np.log(factor)) if state and s in (INSULT, THREAT) else 0.0)
    return arcs


def insulted(factor: float = 1.25) -> Arcs:
    """An insult after a target counts ``factor``. States: no target yet, target."""
    return {(state, s): (int(state or s == TARGET), s, float(np.log(factor)) if state and s == INSULT else 0.0) for state in range(2) for s in range(7)}


def threatened(alone: float = 0.1) -> Arcs:
    """A threat counts in full once its target has come; until then ``alone``. States: nothing, target, threat, both."""
    arcs: Arcs = {}
    for state in range(4):
        for s in range(7):
            then = state | (1 if s == TARGET else 2 if s == THREAT else 0)
            if s == THREAT:
                arcs[state, s] = (then, s, 0.0 if state & 1 else float(np.log(alone)))
            elif s == TARGET and state == 2:
                arcs[state, s] = (then, THREAT, float(np.log1p(-alone)))
            else:
                arcs[state, s] = (then, s, 0.0)
    return arcs


def compose(a: Arcs, b: Arcs) -> Arcs:
    """The transducer that feeds what ``a`` writes to ``b``; weights add as logs. States that 0 reaches, numbered as found."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        p, q = todo.pop()
        for s in range(7):
            p2, between, w = a[p, s]
            q2, out, v = b[q, between]
            if (p2, q2) not in number:
                number[p2, q2] = len(number)
                todo.append((p2, q2))
            arcs[number[p, q], s] = (number[p2, q2], out, w + v)
    return arcs


def grammar() -> Arcs:
    return reduce(compose, (negation(), reported(), insulted(), threatened()))


@dataclass
class Words:
    """The words of some texts: hashes, first word of each text, clause of each word, whether a quote mark stands before it."""

    forms: np.ndarray
    at: np.ndarray
    clause: np.ndarray
    quoted: np.ndarray


_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?;:\n"]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """``forms``: a row for whole words and one for each length of beginnings, 0 where a word is no longer than that."""
    low = _text._LOWER[data]
    if len(low) > 1:  # capital letters of Latin-1
        capital = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[capital] += 0x20
    starts, ends, at = _text.runs(low, offsets, _text._WORD[low].view(np.uint8))
    n = len(starts)
    letters = np.flatnonzero((low & 0xC0) != 0x80)
    first = np.searchsorted(letters, starts)
    size = np.searchsorted(letters, ends) - first
    longer = [np.flatnonzero(size > k) for k in BEGINNINGS]
    stops = [letters[first[on] + k] for on, k in zip(longer, BEGINNINGS, strict=True)]
    h = _text.run_hashes(low, np.concatenate([starts, *[starts[on] for on in longer]]), np.concatenate([ends, *stops])) if n else np.empty(0, np.uint64)
    forms = np.zeros((1 + len(BEGINNINGS), n), np.uint64)
    forms[0], a = h[:n], n
    for row, on in enumerate(longer, 1):
        forms[row, on] = _text.mix(h[a : a + len(on)] + np.uint64(row))
        a += len(on)
    breaks, quotes = np.cumsum(_BREAK[low]), np.cumsum(low == 34)
    clause = breaks[starts] if n else np.empty(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = clause[1:] != clause[:-1]
    new[at[:-1][at[:-1] < n]] = True
    quoted = np.zeros(n, bool)
    if n:
        quoted[1:] = (quotes[starts[1:]] - quotes[ends[:-1] - 1]) % 2 == 1
        quoted[0] = quotes[starts[0]] % 2 == 1
    return Words(forms, at, np.cumsum(new) - 1, quoted)


def _hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(_text.run_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


class Lexicon:
    """Weights of hashed words and beginnings; of several entries that a word has, that of most standard errors counts."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, errors: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.weights, self.errors = keys[order], weights[order], errors[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, forms: np.ndarray) -> np.ndarray:
        """The weight of each word, 0 where none of its forms is an entry."""
        weight, best = np.zeros(forms.shape[1]), np.zeros(forms.shape[1])
        for h in forms:
            on = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
            if not len(on) or not len(self.keys):
                continue
            place = np.minimum(np.searchsorted(self.keys, h[on]), len(self.keys) - 1)
            hit = self.keys[place] == h[on]
            on, place = on[hit], place[hit]
            better = self.errors[place] > best[on]
            on, place = on[better], place[better]
            weight[on], best[on] = self.weights[place], self.errors[place]
        return weight


@dataclass
class Model:
    """Lexicon, composed grammar, and the logistic function of a text's clauses (see ``described``)."""

    lexicon: Lexicon
    coefficients: np.ndarray
    arcs: Arcs = field(default_factory=grammar)

    def __post_init__(self) -> None:
        states = max(p for p, _ in self.arcs) + 1
        self.then = [[self.arcs[p, s][0] for s in range(7)] for p in range(states)]
        self.gain = [[float(np.exp(w)) if out in (INSULT, THREAT) else 0.0 for _, out, w in (self.arcs[p, s] for s in range(7))] for p in range(states)]
        seeds = {_hash_of(word): s for s, listed in SEEDS.items() for word in listed.split()}
        self.seed_keys = np.array(sorted(seeds), np.uint64)
        self.seed_symbols = np.array([seeds[k] for k in sorted(seeds)])

    def symbols(self, h: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.seed_keys, h), len(self.seed_keys) - 1)
        return np.where(self.seed_keys[place] == h, self.seed_symbols[place], OTHER)

    def clauses(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, end and weight of each clause that holds an insult or a threat."""
        weight = self.lexicon.find(w.forms)
        symbol = self.symbols(w.forms[0])
        symbol[weight > 0] = INSULT
        hit = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        which = np.unique(w.clause[hit])
        first, end = np.searchsorted(w.clause, which, "left"), np.searchsorted(w.clause, which, "right")
        total = np.zeros(len(which))
        for k, (a, b) in enumerate(zip(first.tolist(), end.tolist(), strict=True)):
            state, sum_ = 0, 0.0
            for s, own, quoted in zip(symbol[a:b].tolist(), weight[a:b].tolist(), w.quoted[a:b].tolist(), strict=True):
                if quoted:
                    state = self.then[state][QUOTE]
                g = self.gain[state][s]
                if g:
                    sum_ += g * (own if s == INSULT else THREAT_WEIGHT)
                state = self.then[state][s]
            total[k] = sum_
        return first, end, total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + x @ self.coefficients[1:], -500, 500)))


def described(first: np.ndarray, total: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text: logs of one more than the sum, the largest, and the density of its clauses' weights."""
    n = len(at) - 1
    text = np.searchsorted(at, first, "right") - 1
    sums, top = np.bincount(text, total, n), np.zeros(n)
    np.maximum.at(top, text, total)
    return np.log1p(np.stack([sums, top, 200 * sums / (np.diff(at) + 20)], axis=1))


def _rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per form, class and part: texts that have it, and sums of its share of a text's words and of the share's square."""
    for batch in batches:
        y, part = batch.column("y").to_numpy(), batch.column("part").to_numpy()
        keys, codes, shares = [], [], []
        for i, _, data, offsets in _text.chunks(batch.column("text")):
            w = words(data, offsets)
            for r, (a, b) in enumerate(zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)):
                h, n = np.unique(w.forms[:, a:b], return_counts=True)
                n = n[h != 0]
                h = h[h != 0]
                keys.append(h)
                codes.append(np.full(len(h), y[i + r] * PARTS + part[i + r], np.int32))
                shares.append(n / max(1, b - a))
        if not keys:
            continue
        h, code, share = np.concatenate(keys), np.concatenate(codes), np.concatenate(shares)
        order = np.lexsort((code, h))
        h, code, share = h[order], code[order], share[order]
        if not len(h):
            continue
        at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (code[1:] != code[:-1])]))
        columns = [pa.array(h[at].view(np.int64)), pa.array(code[at]), pa.array(np.diff(np.append(at, len(h)))), pa.array(np.add.reduceat(share, at)), pa.array(np.add.reduceat(share * share, at))]
        yield pa.RecordBatch.from_arrays(columns, names=["h", "code", "n", "s", "q"])


def _entry(counts: dict[int, int], left_out: int | None) -> tuple[Column, Column]:
    """Log weight of a form and its standard errors, NULL where it is no entry, from all parts but one."""
    codes = [[y * PARTS + p for p in range(PARTS) if p != left_out] for y in (0, 1)]
    size = [max(1, sum(counts.get(c, 0) for c in own)) for own in codes]
    n, s, q = ([sum((F.coalesce(F.col(f"{name}{c}"), F.lit(0)) for c in own), F.lit(0.0)) for own in codes] for name in "nsq")
    rate = [s[y] / size[y] for y in (0, 1)]
    spread = sum((F.greatest(q[y] / size[y] - rate[y] * rate[y], F.lit(0.0)) / size[y] for y in (0, 1)), F.lit(SMOOTH**2))
    share = (n[0] + n[1]) / sum(size)
    by_texts = (n[1] / size[1] - n[0] / size[0]) / F.sqrt(share * (1 - share) * (1 / size[0] + 1 / size[1]) + F.lit(SMOOTH**2))
    weight = F.log((rate[1] + SMOOTH) / (rate[0] + SMOOTH))
    errors = F.greatest((rate[1] - rate[0]) / F.sqrt(spread), by_texts)
    good = (n[1] >= LEAST_TEXTS) & (weight >= LEAST_LOG) & (errors >= LEAST_ERRORS)
    return F.when(good, weight), F.when(good, errors)


def _features(batches: Iterator[pa.RecordBatch], models: list[Model]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part, x = batch.column("part").to_numpy(), np.zeros((batch.num_rows, 3))
        for i, j, data, offsets in _text.chunks(batch.column("text")):
            w = words(data, offsets)
            for p, model in enumerate(models):
                own = part[i:j] == p
                if own.any():
                    first, _, total = model.clauses(w)
                    x[i:j][own] = described(first, total, w.at)[own]
        yield pa.RecordBatch.from_arrays([batch.column("y"), *[pa.array(c) for c in x.T]], names=["y", "a", "b", "c"])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Intercept and coefficients by damped Newton steps; coefficients below 0 are not wanted and held at 0."""
    x = np.column_stack([np.ones(len(x)), x])
    on = np.ones(x.shape[1], bool)
    while True:
        b = np.zeros(x.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
            penalty = ridge * np.concatenate([[0.001], b[1:]])
            grad = (x.T @ (weight * (p - y)) + penalty)[on]
            h = (x.T * (weight * np.maximum(p * (1 - p), 1e-9))) @ x + np.diag([1e-3] + [ridge] * (len(b) - 1))
            step = np.linalg.solve(h[np.ix_(on, on)], grad)
            b[on] -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
            if float(np.abs(step).max()) < 1e-7:
                break
        below = on & (b < 0)
        below[0] = False
        if not below.any():
            return b
        on &= ~below


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> Model:
    """A model from rows of ``labels`` (doc_id, toxic 0 or 1) outside the held-out fold.

    The sample: about ``PER_CLASS`` labelled rows of each class, by a hash of doc_id and text; equal texts of a class count
    once. Spark counts words and beginnings in it; at most ``ENTRIES`` of them and three numbers per sampled text reach
    the driver. The logistic function is fitted on texts that their part's lexicon has not seen. Without rows of both
    classes every score is the share of class 1, or near 0 if there are no labels.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    scratch = Scratch(spark)
    known = scratch.write(known.where(~held_out(F.col("doc_id"), folds, fold)))
    sent = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    size = {r.y: r.n for r in docs.select("doc_id").join(sent, "doc_id").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Lexicon(np.empty(0, np.uint64), np.empty(0), np.empty(0))
    if len(size) < 2:
        return Model(none, np.array([6.9 if 1 in size else -6.9, 0.0, 0.0, 0.0]))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 52)).cast("double") / float(1 << 52)
    part = F.when(F.col("y") == 1, min(1.0, PER_CLASS / size[1])).otherwise(min(1.0, PER_CLASS / size[0]))
    picked = docs.join(sent, "doc_id").where(place < part).groupBy("y", F.xxhash64("text").alias("h")).agg(F.any_value("text").alias("text"))
    sample = scratch.write(picked.select("y", F.pmod(F.hash("h"), F.lit(PARTS)).alias("part"), "text"))
    counts = {r.y * PARTS + r.part: r.n for r in sample.groupBy("y", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    codes = range(2 * PARTS)
    sums = [F.sum(F.when(F.col("code") == c, F.col(name))).alias(f"{name}{c}") for c in codes for name in "nsq"]
    forms = sample.mapInArrow(_rates, "h long, code int, n long, s double, q double").groupBy("h").agg(*sums)
    entries = [_entry(counts, p) for p in (*range(PARTS), None)]
    made = forms.select("h", *[c.alias(f"{n}{k}") for k, e in enumerate(entries) for c, n in zip(e, "wz", strict=True)])
    strongest = F.greatest(*[F.coalesce(f"z{k}", F.lit(0.0)) for k in range(PARTS + 1)])
    rows = made.withColumn("z", strongest).where("z > 0").orderBy(F.desc("z"), "h").limit(ENTRIES).toPandas()
    lexicons = []
    for k in range(PARTS + 1):
        own = rows[rows[f"w{k}"].notna()]
        lexicons.append(Lexicon(own.h.to_numpy(np.int64).view(np.uint64), own[f"w{k}"].to_numpy(float), own[f"z{k}"].to_numpy(float)))
    models = spark.sparkContext.broadcast([Model(x, np.zeros(4)) for x in lexicons[:PARTS]])
    x = sample.mapInArrow(lambda it: _features(it, models.value), "y int, a double, b double, c double").toPandas()
    y = x.y.to_numpy(float)
    in_class = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y == 1, size[1] / in_class[1], size[0] / in_class[0])
    return Model(lexicons[PARTS], logistic(x[["a", "b", "c"]].to_numpy(), y, weight / weight.mean()))


_CLAUSE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())])


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in _text.chunks(batch.column("text")):
            w = words(data, offsets)
            first, end, total = model.clauses(w)
            base = w.at[np.searchsorted(w.at, first, "right") - 1] if len(first) else first
            listed = pa.StructArray.from_arrays([pa.array(first - base), pa.array(end - base), pa.array(total)], fields=list(_CLAUSE))
            at = np.searchsorted(first, w.at).astype(np.int32)
            columns = [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(w.at)), pa.array(model.score(described(first, total, w.at))), pa.ListArray.from_arrays(pa.array(at), listed)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "score", "clauses"])


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, score, clauses, predicted) of every row of ``docs`` (doc_id, text); no row is shuffled.

    ``clauses``: (start, end, weight) of those with an insult or a threat, in words from 0, end excluded. Null and empty texts
    and texts without such a clause have the score of no clauses, a null doc_id stays; repeated rows score alike; other
    columns are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.mapInArrow(lambda it: _scored(it, sent.value), "doc_id long, n_words long, score double, clauses array<struct<start: long, end: long, weight: double>>")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
