"""Best-fit packing of documents into sequences: best-two-fit.

Tokenising and cutting happen in one pass over the texts; only (document, piece, length) rows go further. They are dealt
by hash into groups of bounded expected size and each group is packed on its own, which costs at most about one part-filled
sequence for each group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe, slices, tokenizer_path
from .common import written

PIECES = ("piece int", "start long", "length long", "ids_crc32 long")


def pieces(docs: DataFrame, size: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids followed by ``end_id``, cut if longer than ``size``.

    The remainder is the first piece, all later ones are full. A null text is like an empty one: one piece of one id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last = byte_bpe(path or tokenizer_path("byte_bpe_50k.json")), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for part in slices(list(zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True))):
                for (doc_id, _), ids in zip(part, bpe.ids([t or "" for _, t in part]), strict=True):
                    ids += last
                    n = len(ids) // 4
                    at, k = 0, 0
                    while at < n:
                        to = at + ((n - 1) % size + 1 if k == 0 else size)
                        rows.append((doc_id, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                        at, k = to, k + 1
            types = [b.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, ", ".join((f"doc_id {kind}", *PIECES)))


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, all of them from 1 to ``size``.

    A bin takes the longest unpacked length that fits until none does. Then its smallest length is taken out if two
    unpacked ones fit its gap, so expanded, more tightly, which is repeated until no pair does better. In the end the loosest
    twentieth of the bins, which took what the others had left, is emptied and packed anew, longest length first, each into the
    fullest bin that holds it, if that needs fewer bins.
    """
    order = np.argsort(-lengths, kind="stable")
    stock: list[list[int]] = [[] for _ in range(size + 1)]
    for k in order[::-1].tolist():
        stock[lengths[k]].append(k)
    count = np.array([len(x) for x in stock], np.int64)
    values = np.arange(size + 1)
    fits = np.maximum.accumulate(np.where(count > 0, values, 0))  # the longest unpacked length up to each value
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def move(length: int, step: int) -> None:
        count[length] += step
        if count[length] == (0 if step < 0 else 1):
            np.maximum.accumulate(np.where(count > 0, values, 0), out=fits)

    n = 0
    while fits[size]:
        held, gap = [], size
        while fits[gap]:
            held.append(int(fits[gap]))
            gap -= held[-1]
            move(held[-1], -1)
        while gap and held:
            room = gap + held[-1]
            a = np.flatnonzero(count[: room // 2 + 1])
            b = fits[room - a]
            sums = np.where((b > a) | ((b == a) & (count[a] > 1)), a + b, 0)
            if not len(a) or sums.max() <= held[-1]:
                break
            k = int(sums.argmax())
            move(held.pop(), 1)
            held += sorted((int(a[k]), int(b[k])), reverse=True)
            move(held[-1], -1), move(held[-2], -1)
            held.sort(reverse=True)
            gap = size - sum(held)
        at = 0
        for length in held:
            k = stock[length].pop()
            bins[k], offsets[k] = n, at
            at += length
        n += 1
    return _repacked(bins, lengths, offsets, size)


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each length, longest first, each into the fullest bin that holds it."""
    bins, gaps = np.zeros(len(lengths), np.int64), [[] for _ in range(size + 1)]
    some, n = np.zeros(size + 1, bool), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        gap = length + int(some[length:].argmax())
        if some[gap]:
            bins[k] = gaps[gap].pop()
            some[gap] = bool(gaps[gap])
        else:
            gap, bins[k], n = size, n, n + 1
        gaps[gap - length].append(int(bins[k]))
        some[gap - length] = True
    return bins


def _repacked(bins: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, size: int, share: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """``bins`` and ``offsets`` with the loosest bins packed by ``best_fit``, if fewer come out of it."""
    n = int(bins.max(initial=-1)) + 1
    loose = np.argsort(np.bincount(bins, lengths, n), kind="stable")[: int(np.ceil(n * share))]
    rows = np.flatnonzero(np.isin(bins, loose))
    new = best_fit(lengths[rows], size)
    if int(new.max(initial=-1)) + 1 >= len(loose):
        return bins, offsets
    bins = bins.copy()
    bins[rows] = loose[new]
    by = np.argsort(bins, kind="stable")
    ends, first = lengths[by].cumsum(), np.r_[True, np.diff(bins[by]) > 0]
    starts = ends - lengths[by]
    out = np.empty(len(bins), np.int64)
    out[by] = starts - starts[first][first.cumsum() - 1]
    return bins, out


def pack(docs: DataFrame, size: int = 2048, group_rows: int = 40_000, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    Rows that repeat are packed each; a null id is kept. An empty table gives no rows; other columns are not read.
    ``group_rows``: expected pieces packed together. The number of groups follows the data, so no task grows with it.
    """
    cut = written(pieces(docs, size, path=path))
    groups = max(1, -(-cut.count() // group_rows))
    # by each row's place in the stored table, not by what it holds: rows that are alike are dealt out too
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = best_two_fit(rows["length"].to_numpy(np.int64), size)
        return rows.drop(columns="grp").assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("grp").applyInPandas(packed, ", ".join((f"doc_id {kind}", *PIECES, "sequence_id long", "offset long")))
