"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts with numpy inside Arrow batches; trees are fitted on the driver on a bounded,
documented sample of labelled rows and flattened into arrays, so that a batch is scored level by level by indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample

FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "symbol", "bang", "pipe", "stop", "comma", "non_ascii",
    "newline", "distinct_words", "short_words", "long_words", "dup_lines", "mean_line", "distinct_triples",
)

_CLASSES = np.zeros((256, 9))
for _k, _chars in enumerate((range(65, 91), range(48, 58), b"#*$%&<>@^~{}[]\\_=+", b"!", b"|", b".?", b",;:", range(128, 256), b"\n")):
    _CLASSES[list(_chars), _k] = 1


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES for one text; null and empty texts give zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, w = len(raw), len(words)
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / n
    lengths = np.fromiter(map(len, words), np.int64, w)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    return [
        np.log1p(n), np.log1p(w), float(lengths.mean()), *share, len(set(words)) / w, float((lengths <= 3).mean()), float((lengths >= 12).mean()),
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), triples / max(1, w - 2),
    ]


@dataclass
class Trees:
    """Complete trees of one depth: node k of a tree has the children 2k+1 and 2k+2; the leaves are apart."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 2.0) -> Trees:
    """Boosted trees on the log-loss by histograms of gradients. Without both classes: the smoothed share of ones."""
    prior = (y.sum() + 1) / (len(y) + 2)
    base, nodes = float(np.log(prior / (1 - prior))), 2**depth - 1
    feature, threshold, leaf = [], [], []
    if len(np.unique(y)) > 1:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)  # bin b: edge[b-1] < x <= edge[b]
        raw = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            node, f_t, t_t = np.zeros(len(y), np.int64), np.zeros(nodes, np.int64), np.full(nodes, np.inf)
            for level in range(depth):
                width, first = 2**level, 2**level - 1
                at, best = node - first, np.full(width, 1e-6)
                for j, e in enumerate(edges):
                    k = len(e) + 1
                    gs, hs = (np.bincount(at * k + binned[:, j], v, width * k).reshape(width, k).cumsum(1) for v in (g, h))
                    gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                    gain[(hl < 1) | (ha - hl < 1)] = 0
                    if gain.shape[1]:
                        cut = gain.argmax(1)
                        won = gain[np.arange(width), cut] > best
                        best[won] = gain[np.arange(width), cut][won]
                        f_t[first : first + width][won], t_t[first : first + width][won] = j, e[cut[won]]
                node = 2 * node + 1 + (x[np.arange(len(y)), f_t[node]] > t_t[node])
            at = node - nodes
            values = -rate * np.bincount(at, g, nodes + 1) / (np.bincount(at, h, nodes + 1) + l2)
            raw += values[at]
            feature.append(f_t), threshold.append(t_t), leaf.append(values)
    return Trees(np.array(feature, np.int64).reshape(-1, nodes), np.array(threshold).reshape(-1, nodes), np.array(leaf).reshape(-1, nodes + 1), base)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Trees:
    """Trees from about ``max_rows`` labelled rows at most, none of the held-out fold."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([statistics(t) for t in b["text"].to_pylist()], pa.list_(pa.float64())), b["y"]], ["x", "y"])

    sample = labelled_sample(docs, labels, "quality", max_rows).select("text", "y").mapInArrow(measured, "x array<double>, y int").collect()
    sample.sort()
    return fit(np.array([r.x for r in sample]).reshape(-1, len(FEATURES)), np.array([r.y for r in sample], float))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 12_000) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``.

    Null and empty texts are scored like a text without words. Rows that repeat are scored alike; other columns of
    ``docs``, whatever their names, are not read. An empty table gives no rows; without labels the score is 0.5.
    """
    model = train(docs, labels, max_rows)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b["text"].to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(model.score(x))], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
