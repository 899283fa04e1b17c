"""Personal data by patterns and a skip-chain conditional random field (operator 2)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import sampled

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the field labels: those of the patterns, and secrets, which only it has.
LABELS = (*KINDS, "secret")
#: Documents with digits or @ that train the field; hashed observation features; marginal that makes a span.
SAMPLE, FEATURES, SURE = 2_000, 1 << 12, 0.9
#: Rounds of messages; training texts that are read as one; observations that a masked token keeps, from the last: its bias.
ROUNDS, TOGETHER, KEPT = 12, 6, 1
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
#: What trains the field on secrets: a value that is assigned to a name of one.
_SECRET = re.compile(r"(?i)\b(?:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd)\b[\"']?\s{0,4}[:=]\s{0,4}[\"']?([^\s\"']+)")
_BEFORE = re.compile(r"([A-Za-z_-]{2,30})[\"']?\s{0,4}([:=]?)\s{0,4}[\"']?\Z")
_TRIM = " \t\r\n.,;:!?\"'()[]{}<>*&%$#|"


def _luhn(digits: list[str]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the patterns: leftmost non-overlapping per kind, in the order of KINDS, then by start.

    Each pattern is applied so that its time grows with the text's length only: an address is sought from its @
    outwards, and digit runs are never re-entered.
    """
    out: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGIT.findall(m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _shape(token: str) -> str:
    """Digits as 0, letters as a or A, runs of letters shortened."""
    s = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"[0-9]", "0", token))
    return re.sub(r"(a|A)\1+", r"\1", s)


@dataclass
class Graph:
    """Tokens of a text that hold a digit or @, their observations, neighbours in the chain and over skips."""

    spans: list[tuple[int, int]]
    feats: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int, int]]  # 0: equal tokens, 1: equal shapes


def graph(text: str) -> Graph:
    """Each occurrence of a token is tied to the next equal one and to the next of its shape, however far off."""
    spans, feats, chain, skip = [], [], [], []
    last: dict[tuple[int, str], int] = {}
    for i, m in enumerate(_TOKEN.finditer(text)):
        token = m[0]
        a, b = m.start() + len(token) - len(token.lstrip(_TRIM)), m.end() - (len(token) - len(token.rstrip(_TRIM)))
        core = text[a:b] if a < b else token
        a, b = (a, b) if a < b else (m.start(), m.end())
        shape, n = _shape(core), sum("0" <= c <= "9" for c in core)
        before = _BEFORE.search(text, max(0, a - 40), a)
        context = [f"w{before[1].lower()}", f"={before[2]}"] if before else ["w", "="]
        names = [*context, f"s{shape}", f"n{min(n, 20)}", f"@{core.count('@')}", f".{min(core.count('.'), 5)}", f"l{min(len(core), 40) // 2}", f"all{n == len(core)}", f"p{core[:1] if not core[:1].isalnum() else 'x'}", "1"]
        feats.append([zlib.crc32(x.encode()) % FEATURES for x in names])
        if spans and text[spans[-1][1] : a].strip(_TRIM) == "" and a - spans[-1][1] <= 3:
            chain.append((i - 1, i))
        for kind, value in ((0, core), (1, shape)):
            if (twin := last.get((kind, value))) is not None and (kind == 0 or text[slice(*spans[twin])] != core):
                skip.append((twin, i, kind))
            last[kind, value] = i
        spans.append((a, b))
    return Graph(spans, feats, chain, skip)


def silver(text: str, g: Graph, base: list[tuple[str, int, int]]) -> np.ndarray:
    """0: none, else 1 + the label whose span covers a token's middle; patterns go before assigned secrets."""
    y = np.zeros(len(g.spans), np.int64)
    middle = np.array([(s + e) // 2 for s, e in g.spans])
    for kind, a, b in [*(("secret", *m.span(1)) for m in _SECRET.finditer(text)), *base]:
        y[(a <= middle) & (middle < b)] = 1 + LABELS.index(kind)
    return y


@dataclass
class Model:
    observe: np.ndarray  # feature, label
    chain: np.ndarray  # label, label
    skip: np.ndarray  # skip kind: what equal labels of both ends gain, never a loss


def train(texts: list[str]) -> Model:
    """Weights by pseudo-likelihood on the pattern spans and assigned secrets: each token given its neighbours in chain and
    skips. Skip weights are kept at 0 or more, so that equal and similar tokens draw together.

    A token's own looks and the word that announces it mostly settle its label, so little is left for its twins to tell. So
    each token with a skip also counts once with its observations masked, and ``TOGETHER`` texts are read as one, in
    which similar tokens meet: the weights learn what twins tell where nothing else does.
    """
    k = len(LABELS) + 1
    masked = zlib.crc32(b"masked") % FEATURES
    feats, ys, left, right, same = [], [], [], [], []
    for text in ("\n".join(texts[i : i + TOGETHER]) for i in range(0, len(texts), TOGETHER)):
        g = graph(text)
        y = silver(text, g, base_spans(text))
        lft, rgt, sm = np.zeros((len(y), k)), np.zeros((len(y), k)), np.zeros((len(y), 2, k))
        for a, b in g.chain:
            lft[b, y[a]] += 1
            rgt[a, y[b]] += 1
        for a, b, kind in g.skip:
            sm[a, kind, y[b]] += 1
            sm[b, kind, y[a]] += 1
        tied = np.flatnonzero(sm.any(axis=(1, 2)))
        feats += g.feats + [[masked] * (len(g.feats[i]) - KEPT) + g.feats[i][-KEPT:] for i in tied]
        for out, own in ((ys, y), (left, lft), (right, rgt), (same, sm)):
            out += [own, own[tied]]
    model = Model(np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(2))
    if not feats:
        model.observe[:, 0] = 1.0
        return model
    f, y = np.array(feats), np.concatenate(ys)
    lft, rgt, sm = np.concatenate(left), np.concatenate(right), np.concatenate(same)
    sums = [np.full_like(x, 1e-6) for x in (model.observe, model.chain, model.skip)]
    one = np.eye(k)[y]
    for _ in range(80):
        s = model.observe[f].sum(axis=1) + lft @ model.chain + rgt @ model.chain.T + np.einsum("nck,c->nk", sm, model.skip)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (one - p) / len(y)
        g_obs = np.zeros_like(model.observe)
        for c in range(f.shape[1]):
            np.add.at(g_obs, f[:, c], d)
        for x, g, q in zip((model.observe, model.chain, model.skip), (g_obs, lft.T @ d + d.T @ rgt, np.einsum("nck,nk->c", sm, d)), sums, strict=True):
            g = g - 1e-5 * x
            q += g * g
            x += 0.3 * g / np.sqrt(q)
        np.maximum(model.skip, 0.0, out=model.skip)
    return model


def marginals(g: Graph, model: Model) -> np.ndarray:
    """Label probabilities of each token by loopy sum-product messages over chain and skip edges."""
    k = len(LABELS) + 1
    own = np.array([model.observe[f].sum(axis=0) for f in g.feats])
    edges = [(a, b) for a, b in g.chain] + [(a, b) for a, b, _ in g.skip]
    if not edges:
        p = np.exp(own - own.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    a, b = np.array(edges).T
    tie = np.concatenate([np.repeat(model.chain[None], len(g.chain), axis=0), np.eye(k)[None] * np.array([model.skip[kind] for _, _, kind in g.skip]).reshape(-1, 1, 1)])
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    tie = np.exp(np.concatenate([tie, tie.transpose(0, 2, 1)]))
    back = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
    msg = np.full((len(src), k), -np.log(k))
    for _ in range(ROUNDS):
        total = own.copy()
        np.add.at(total, dst, msg)
        out = total[src] - msg[back]
        out = np.einsum("ek,ekl->el", np.exp(out - out.max(axis=1, keepdims=True)), tie)
        new = np.log(out / out.sum(axis=1, keepdims=True) + 1e-300)
        moved = float(np.abs(np.exp(new) - np.exp(msg)).max())
        msg = np.log(0.5 * np.exp(new) + 0.5 * np.exp(msg))
        if moved < 1e-4:
            break
    total = own.copy()
    np.add.at(total, dst, msg)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def all_spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and these with the field's own: sure tokens that touch no base span."""
    base = base_spans(text)
    g = graph(text)
    added = []
    if g.spans:
        p = marginals(g, model)
        taken = sorted((a, b) for _, a, b in base)
        starts = np.array([a for a, _ in taken])
        ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.empty(0)
        for (a, b), q in zip(g.spans, p, strict=True):
            y = int(q.argmax())
            before = int(np.searchsorted(starts, b))  # spans that start before this token ends
            if y and q[y] >= SURE and not (before and ends[before - 1] > a):
                added.append((LABELS[y - 1], a, b))
    return base, sorted(base + added, key=lambda s: (LABELS.index(s[0]), s[1], s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _found(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
    for batch in batches:
        base, spans = [], []
        for text in batch.column("text"):
            one, every = all_spans(text.as_py(), model.value) if text.is_valid else ([], [])
            base.append(as_rows(one))
            spans.append(as_rows(every))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, _SPANS), pa.array(spans, _SPANS)], names=["doc_id", "base", "spans"])


def fit(docs: DataFrame) -> Model:
    """Trains on a hashed sample of about 2,000 texts that hold a digit or @; none gives a model that adds nothing."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, SAMPLE / max(1, texts.count()))
    rows = texts.where(sampled("text", share)).distinct().collect()
    return train(sorted(r.text for r in rows))


def personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, base, spans) of every row of ``docs`` (doc_id, text); spans are arrays of (kind, start, end) in code points.

    ``base`` are the pattern spans, ``spans`` these and the tokens that the field labels: repeated or similar
    tokens share potentials, so one that stands without the context its twin has is labelled alike. The field also
    labels secrets, which it learns from values assigned to a token, key or password. Only tokens
    with a digit or @ can be entities, so a text without either is settled at once; messages run within one
    document over at most three edges a token.

    Null counts as empty. Repeated rows give repeated results; other columns are ignored; an empty table gives an
    empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike("[0-9@]"), F.col("text").cast("string")).alias("text"))
    kind = "array<struct<kind:string,start:int,end:int>>"
    return docs.mapInArrow(lambda it: _found(it, sent), f"doc_id long, base {kind}, spans {kind}")
