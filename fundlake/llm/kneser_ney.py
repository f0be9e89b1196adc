"""Language-model scores: an interpolated modified Kneser-Ney n-gram model, counted in Spark, in sorted hash arrays.

The training texts' n-grams are counted in each task, packed by ranges of their keys and merged by range, so that no key's rows
meet in one place but as sums. From each level's distinct n-grams follow the next lower one's continuation counts and the sums
that contexts need. Each range writes its part of the model as sorted arrays in the shared folder, which workers map into memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import shared_dir, ship
from .hash_arrays import PACK, HashArrays, WordHashes, combine, merged, of_group, packs, pieces, save, smallest, table, unpacked

#: What stands before the first token and what ends a text: no words, since words have a character and no white space.
BOS, END = b"\n", b""
#: Packs, or a level's sums: level, n-grams counted once, twice, three and four times, all n-grams, their counts, training tokens.
_ROWS = PACK + ", sums array<long>"


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and each level's sums."""

    folder: str
    order: int
    shards: int
    sums: dict[int, tuple[int, ...]]

    @property
    def tokens(self) -> int:
        return self.sums[1][6]

    @property
    def vocabulary(self) -> int:
        return self.sums[1][4]

    def discounts(self, level: int) -> np.ndarray:
        """What is taken from counts of 0, 1, 2 and 3 or more: the modified estimates, or 0.5, 1 and 1.5 where a small table
        doesn't give them."""
        n1, n2, n3, n4 = (self.sums[level][k] for k in range(4))
        if not min(n1, n2, n3, n4):
            return np.array([0, 0.5, 1, 1.5])
        y = n1 / (n1 + 2 * n2)
        d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        return np.clip(d, 0, [0, 1, 2, 3]) if min(d[1:]) > 0 else np.array([0, 0.5, 1, 1.5])


def _tokens(texts: list[bytes], pad: int) -> list[bytes]:
    """Each text's words, A-Z in lower case, with ``pad`` marks before and the end after: bytes.lower() and bytes.split() know
    ASCII letters and the six white-space characters alone."""
    out: list[bytes] = []
    for t in texts:
        out += [BOS] * pad
        out += t.lower().split()
        out.append(END)
    return out


def _counted(batches: Iterator[pa.RecordBatch], order: int, shards: int, schema: pa.Schema, flush: int = 2_500_000) -> Iterator[pa.RecordBatch]:
    """Packs of the distinct n-grams of about ``flush`` tokens each."""
    hashes = WordHashes()
    bos = hashes.of([BOS])[0]

    def emit(flat: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(flat != bos)
        found = merged([flat[at - k] for k in range(order - 1, -1, -1)])
        yield from table(list(packs(*found, shards)), schema).to_batches()

    held, size = [], 0
    for b in batches:
        for part in pieces(b, "text"):
            held.append(hashes.of(_tokens(part["text"].to_pylist(), order - 1)))
            size += len(held[-1])
            if size >= flush:
                flat, held, size = np.concatenate(held), [], 0
                yield from emit(flat)
    if held:
        yield from emit(np.concatenate(held))


def _level(group: pa.Table, level: int, order: int, shards: int, folder: str, schema: pa.Schema) -> pa.Table:
    """Merges a range of a level's n-grams, writes its arrays and gives the packs of the level below and the sums so far.

    Counts: of the highest level how often an n-gram occurs; of lower ones its distinct left neighbours, its occurrences, and as a
    context the sum of the counts that follow it and how many of these are 1, 2 and more.
    """
    rows = group.to_pylist()
    out = [r for r in rows if r["sums"] is not None]
    rows = [r for r in rows if r["sums"] is None]
    if not rows:
        return table(out, schema)
    key, cols, counts = merged(*unpacked(rows, level))
    left, raw = (counts[0], counts[0]) if level == order else counts[:2]
    # what begins a text has no left neighbour to tell apart: it counts as often as it occurs
    a = np.where(cols[0] == WordHashes().of([BOS])[0], raw, left) if 1 < level else left
    arrays = {"key": key, "a": smallest(a)}
    if level < order:
        arrays |= {n: smallest(x) for n, x in zip(("total", "n1", "n2", "n3"), counts[2:], strict=True)}
    if level == 1:
        arrays["raw"] = smallest(raw)
    bucket = rows[0]["bucket"]
    save(folder, f"{level}-{bucket}", arrays)
    sums = [level, *(int((a == k).sum()) for k in (1, 2, 3, 4)), int((a > 0).sum()), int(a.sum()), int(raw.sum())]
    out.append({"bucket": bucket, "m": 0, "words": None, "at": None, "counts": None, "sums": sums})
    if level > 1:
        some = a > 0
        cols, a, raw, zero = [c[some] for c in cols], a[some], raw[some], np.zeros(some.sum(), np.int64)
        shorter = [np.concatenate(x) for x in zip(cols[1:], cols[:-1], strict=True)]
        suffix, context = (zero + 1, raw, zero, zero, zero, zero), (zero, zero, a, *((np.minimum(a, 3) == k).astype(np.int64) for k in (1, 2, 3)))
        out += [p | {"sums": None} for p in packs(*merged(shorter, [np.concatenate(x) for x in zip(suffix, context, strict=True)]), shards)]
    return table(out, schema)


def train(docs: DataFrame, order: int = 2, shard_bytes: int = 8 << 20) -> Model:
    """The model of all texts of ``docs``, a null text being empty. One shard for each ``shard_bytes`` of text bounds what a task
    merges. The model is written to the shared folder; what the driver gets is a row of sums for each level."""
    if order < 2:
        raise ValueError("a model has two words to an n-gram at least")
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    schema = to_arrow_schema(StructType.fromDDL(_ROWS))
    pack_schema = to_arrow_schema(StructType.fromDDL(PACK))
    texts = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = texts.mapInArrow(partial(_counted, order=order, shards=shards, schema=pack_schema), PACK).withColumn("sums", F.lit(None).cast("array<long>"))
    for level in range(order, 0, -1):
        rows = rows.groupBy("bucket").applyInArrow(of_group(_level, level=level, order=order, shards=shards, folder=folder, schema=schema), _ROWS)
    sums = rows.groupBy(F.get("sums", F.lit(0)).alias("level")).agg(*(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(1, 8))).collect()
    found = {r.level: tuple(r[1:]) for r in sums}
    return Model(folder, order, shards, {k: found.get(k, (0,) * 7) for k in range(1, order + 1)})


def _log10_p(flat: np.ndarray, model: Model, tables: list[HashArrays]) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of each token's probability, how often it was seen); ``flat`` has order - 1 marks before each text."""
    key, lower = flat, {}
    for level in range(1, model.order + 1):
        if level > 1:
            key = combine(np.concatenate([flat[:1], key[:-1]]), flat)
        distinct, at = np.unique(key, return_inverse=True)
        names = ("a", *(("total", "n1", "n2", "n3") if level < model.order else ()), *(("raw",) if level == 1 else ()))
        x = {n: v[at] for n, v in tables[level - 1].find(distinct, names)[1].items()}
        d = model.discounts(level)
        taken = x["a"] - d[np.minimum(x["a"], 3)]
        if level == 1:
            n1, n2, _, _, types, total, _ = model.sums[1]
            spread = d[1] * n1 + d[2] * n2 + d[3] * (types - n1 - n2)
            p = taken / total + spread / total / (model.vocabulary + 1) if total else np.full(len(flat), 1 / (model.vocabulary + 1))
            raw = x["raw"]
        else:
            of = {n: np.concatenate([v[:1], v[:-1]]) for n, v in lower.items() if n not in ("a", "raw")}
            total = np.maximum(of["total"], 1)
            p = np.where(of["total"] > 0, taken / total + (d[1] * of["n1"] + d[2] * of["n2"] + d[3] * of["n3"]) / total * p, p)
        lower = x
    return np.log10(p), raw


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    tables = [HashArrays(model.folder, str(k), model.shards) for k in range(1, model.order + 1)]
    hashes = WordHashes()
    bos = hashes.of([BOS])[0]
    for b in batches:
        for part in pieces(b, "text"):
            flat = hashes.of(_tokens(part["text"].to_pylist(), model.order - 1))
            log_p, raw = _log10_p(flat, model, tables)
            own = flat != bos
            doc = (np.cumsum(~own) - 1)[own] // (model.order - 1)  # each text has as many marks
            base = np.log10((raw + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))
            sums = [np.bincount(doc, w, part.num_rows) for w in (np.ones(len(doc)), raw[own] > 0, base[own], log_p[own])]
            columns = [part["doc_id"], *(pa.array(x.astype(np.int64)) for x in sums[:2]), *map(pa.array, sums[2:])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity), one row for each row of ``docs``.

    ``score``: the log10 probability of the text and its end; ``base_score``: that of smoothed single tokens. A null text is
    empty, its only token the end. Whole texts are scored, repeated rows alike; columns besides doc_id and text aren't read. With
    a model of no texts every token has the probability 1.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    out = rows.mapInArrow(partial(_scored, model=model), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))
