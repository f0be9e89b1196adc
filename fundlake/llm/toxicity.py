"""Toxicity: a linear-chain conditional random field tags toxic spans; marginals aggregate to document scores.

Labels are for documents, so the training tokens get their tags from the sample: a word that stands in far more toxic than
clean documents is tagged toxic where it occurs in a toxic document. The field has a weight for each known word and tag and
for each pair of neighbouring tags, is fitted by gradient steps on the log-likelihood, and marginals come from the
forward-backward recursions, here of odds, since there are two tags. A logistic layer turns a document's marginals into its score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import slices
from .common import held_out, labelled_sample


def tokens(text: str) -> list[str]:
    """White-space words, lower-cased, as the field sees them."""
    return text.lower().split()


@dataclass
class Field:
    """emission: word -> log-odds of the toxic tag, ``other`` for words that aren't in it; pair[i, j]: weight of tag j
    after tag i; head: intercept and weights of the logistic layer."""

    emission: dict[str, float]
    other: float
    pair: np.ndarray
    head: np.ndarray

    def marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        """P(toxic) of every token of every document, by forward-backward over all documents at once."""
        lengths = np.array([len(d) for d in docs])
        order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate([[0], lengths[order].cumsum()]).astype(np.int64)
        e, get, other = np.empty(starts[-1]), self.emission.get, self.other
        for k, d in enumerate(order):
            e[starts[k] : starts[k + 1]] = [get(w, other) for w in docs[d]]
        m = odds(e, starts[:-1], lengths[order], self.pair)
        m = m / (1 + m)
        out: list = [None] * len(docs)
        for k, d in enumerate(order):
            out[d] = m[starts[k] : starts[k + 1]]
        return out

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        x = np.array([summary(m) for m in marginals]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(self.head[0] + x @ self.head[1:], -30, 30)))


def odds(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Odds of tag 1 for ragged sequences, longest first: forward messages times backward messages."""
    x, w = np.exp(np.clip(e, -12, 12)), np.exp(np.clip(pair, -12, 12))
    forward, backward = np.empty(len(e)), np.ones(len(e))
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # sequences longer than t
    for t in range(longest):
        at = starts[: active[t]] + t
        if t:
            r = forward[at - 1]
            forward[at] = x[at] * (w[0, 1] + r * w[1, 1]) / (w[0, 0] + r * w[1, 0])
        else:
            forward[at] = x[at]
    for t in range(longest - 1, 0, -1):
        at = starts[: active[t]] + t
        r = x[at] * backward[at]
        backward[at - 1] = (w[1, 0] + r * w[1, 1]) / (w[0, 0] + r * w[0, 1])
    return forward * backward


def summary(m: np.ndarray) -> list[float]:
    """A document's marginals in three numbers: expected toxic tokens (as a logarithm), the largest, and their share."""
    return [float(np.log1p(m.sum())), float(m.max()), float(m.mean())] if len(m) else [0.0, 0.0, 0.0]


def fit(docs: list[list[str]], y: np.ndarray, min_docs: int = 3, steps: int = 20, l2: float = 1e-2, reach: int = 64) -> Field:
    """The field and its logistic layer from tokenised documents and their labels; a class or all tokens absent: the prior alone.

    Every token of every document counts. Texts enter as stretches of ``reach`` tokens, so that recursions run over many at once.
    """
    prior = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    head = np.array([np.log(prior / (1 - prior)), 0, 0, 0])
    if len(np.unique(y)) < 2:
        return Field({}, 0.0, np.zeros((2, 2)), head)
    seen = [Counter(), Counter()]
    for d, k in zip(docs, y, strict=True):
        seen[int(k)].update(set(d))
    n1, n0 = y.sum(), len(y) - y.sum()
    vocab = sorted(w for w in seen[1].keys() | seen[0].keys() if seen[1][w] + seen[0][w] >= min_docs)
    # log-likelihood ratio of the word's documents being toxic more often than documents are
    share = n1 / (n1 + n0)

    def surprise(w: str) -> float:
        a, b = seen[1][w], seen[0][w]
        q = a / (a + b)
        return 2 * (a * np.log(q / share) + (b * np.log((1 - q) / (1 - share)) if b else 0.0)) if q > share else 0.0

    least = 20 + 2 * np.log(max(1, len(vocab)))  # the more words are looked at, the more stand out by chance
    toxic = {w for w in vocab if seen[1][w] * n0 > 8 * (seen[0][w] + 0.1) * n1 and surprise(w) > least}
    index = {w: k + 1 for k, w in enumerate(vocab)}  # 0: any other word
    # whole texts, in stretches of ``reach`` tokens
    ids, tags = [], []
    for d, k in zip(docs, y, strict=True):
        for t in range(0, len(d), reach):
            ids.append([index.get(w, 0) for w in d[t : t + reach]])
            tags.append([int(bool(k) and w in toxic) for w in d[t : t + reach]])
    if not ids:
        return Field({}, 0.0, np.zeros((2, 2)), head)
    order = sorted(range(len(ids)), key=lambda k: -len(ids[k]))
    lengths = np.array([len(ids[k]) for k in order])
    starts = np.concatenate([[0], lengths.cumsum()])[:-1].astype(np.int64)
    flat, tag = np.concatenate([ids[k] for k in order]).astype(np.int64), np.concatenate([tags[k] for k in order])
    first = np.zeros(len(flat), bool)
    first[starts] = True
    emission, pair = np.zeros(len(vocab) + 1), np.zeros((2, 2))
    size, speed_e, speed_p = len(order), np.full(len(vocab) + 1, 1e-8), np.full((2, 2), 1e-8)
    follow = np.flatnonzero(~first)
    for _ in range(steps):
        e = emission[flat]
        m = odds(e, starts, lengths, pair)
        p = m / (1 + m)
        grad_e = np.bincount(flat, tag - p, len(emission)) - l2 * emission
        both = pair_marginals(e, p, starts, lengths, pair, follow)
        true = np.bincount(2 * tag[follow - 1] + tag[follow], minlength=4).reshape(2, 2)
        grad_p = true - both - l2 * size * 0.01 * pair
        speed_e += grad_e**2
        speed_p += grad_p**2
        emission += 0.7 * grad_e / np.sqrt(speed_e)
        pair += 0.3 * grad_p / np.sqrt(speed_p)
    field = Field({w: float(emission[k]) for w, k in index.items()}, float(min(emission[0], 0.0) - 2.0), pair, head)
    x = np.array([summary(m) for part in slices(docs) for m in field.marginals(part)])
    field.head = logistic(x, y)
    return field


def pair_marginals(e: np.ndarray, p: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pair: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Expected counts of neighbouring tags: P(prev = i, tag = j) from the chain's conditional P(tag | prev)."""
    x, w = np.exp(np.clip(e, -12, 12)), np.exp(np.clip(pair, -12, 12))
    back = np.ones(len(e))
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    for t in range(longest - 1, 0, -1):
        at = starts[: active[t]] + t
        r = x[at] * back[at]
        back[at - 1] = (w[1, 0] + r * w[1, 1]) / (w[0, 0] + r * w[0, 1])
    r = x[follow] * back[follow]
    one = [r * w[i, 1] / (w[i, 0] + r * w[i, 1]) for i in (0, 1)]
    q = p[follow - 1]
    return np.array([[((1 - q) * (1 - one[0])).sum(), ((1 - q) * one[0]).sum()], [(q * (1 - one[1])).sum(), (q * one[1]).sum()]])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Intercept and weights of a ridge logistic regression by Newton's method."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + l2 * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, z.T @ (y - p) - l2 * w), -5, 5)
    return w


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4_000) -> Field:
    """The field from about ``max_rows`` labelled documents at most, none of the held-out fold."""
    rows = sorted(labelled_sample(docs, labels, "toxic", max_rows).select("doc_id", "text", "y").toLocalIterator(), key=lambda r: (r.doc_id, r.y, r.text or ""))
    return fit([tokens(r.text or "") for r in rows], np.array([r.y for r in rows], float))


def offsets(text: str, marginals: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Spans (start, end in code points of ``text``) of neighbouring tokens with marginals of ``least`` or more."""
    out: list[tuple[int, int]] = []
    at, was = 0, False
    for w, hit in zip(text.split(), (marginals >= least).tolist(), strict=True):
        at = text.index(w, at)
        if hit:
            out[-1:] = [(out[-1][0], at + len(w))] if was else [*out[-1:], (at, at + len(w))]
        was, at = hit, at + len(w)
    return out


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 4_000, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans), one row for each row of ``docs``; spans: array of (start, end) of
    toxic tokens in code points, end exclusive. With other columns to ``carry`` they are a struct ``row`` in place of doc_id.

    Null and empty texts have no tokens and get the score of a document without toxic marginals. Repeated rows are scored
    alike; other columns are not read; without labels of both classes the score is the smoothed share of toxic ones.
    """
    field = train(docs, labels, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # its words come from the bounded sample
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            scores, spans = [], []
            for part in slices(b["text"].to_pylist()):
                texts = [t or "" for t in part]
                words = [tokens(t) for t in texts]
                marginals = model.marginals(words)
                scores += model.scores(marginals).tolist()
                spans += [[{"start": s, "end": e} for s, e in offsets(t, m)] if len(m) and m.max() >= 0.5 and len(t.split()) == len(m) else [] for t, m in zip(texts, marginals, strict=True)]
            yield pa.RecordBatch.from_arrays([b[name], b["held_out"], pa.array(scores, pa.float64()), pa.array(spans, span)], [name, "held_out", "score", "spans"])

    name = "doc_id" if tuple(carry) == ("doc_id",) else "row"
    rows = docs.select(F.col("doc_id") if name == "doc_id" else F.struct(*carry).alias("row"), held_out().alias("held_out"), "text")
    out = rows.mapInArrow(scored, f"{name} {rows.schema[name].dataType.simpleString()}, held_out boolean, score double, spans array<struct<start:int,end:int>>")
    return out.select(name, "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "spans")
