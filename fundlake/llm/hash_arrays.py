"""Sorted arrays of 64-bit hashes: n-grams counted by key, packed for shuffles, stored in shards by range, memory-mapped.

Keys are uniform, so that equal ranges of them are equal shares of the distinct n-grams, whatever is frequent. Two n-grams of a
corpus share a key with a chance of about the square of their number over 2^65.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs

#: A pack: ``m`` n-grams of one bucket, as places ``at`` in its own distinct ``words``, with columns of counts.
PACK = "bucket long, m int, words binary, at binary, counts array<binary>"


class WordHashes(dict):
    """Hashes of words (bytes), computed once each; forgets them all when it holds ``limit``."""

    def __init__(self, seed: int = 0, limit: int = 200_000) -> None:
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def combine(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The keys of n-grams, from those of their first n - 1 words and the last words' hashes."""
    x = context >> np.uint64(29)
    x ^= context
    x *= np.uint64(0x9E3779B97F4A7C15)
    x += word
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def key_of(cols: list[np.ndarray]) -> np.ndarray:
    """The keys of n-grams given by columns of word hashes; a single word's key is its hash."""
    key = cols[0]
    for c in cols[1:]:
        key = combine(key, c)
    return key


def merged(cols: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(keys, cols, counts) with each n-gram once, by rising key, counts added up; without ``counts``, how often it is there."""
    key = key_of(cols)
    if not len(key):
        return key, cols, counts or [np.zeros(0, np.int64)]
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sums = [np.diff(starts, append=len(key))] if counts is None else [np.add.reduceat(c[order], starts) for c in counts]
    key, order = key[starts], order[starts]
    return key, [c[order] for c in cols], sums


def pieces(batch: pa.RecordBatch, column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts with about ``size`` bytes of a binary column each, so that no more of it becomes Python objects at once."""
    end = np.cumsum(np.asarray(pc.binary_length(batch[column]))) // size
    cuts = [0, *(np.flatnonzero(end[1:] != end[:-1]) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def edges(buckets: int) -> np.ndarray:
    """The smallest key of each bucket: buckets are equal ranges of the keys' upper halves."""
    return (np.arange(buckets, dtype=object) * (1 << 32) + buckets - 1) // buckets * (1 << 32)


def cells(keys: np.ndarray, buckets: int, bits: int = 24) -> np.ndarray:
    """Keys with fewer bits: that of the bucket's beginning and the last ``bits`` of each. As buckets grow in number with the
    n-grams, so do cells, and few n-grams share one."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return edges(buckets).astype(np.uint64)[bucket.astype(np.int64)] | (keys & np.uint64((1 << bits) - 1))


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of the sorted ``keys`` begins, and the end."""
    return np.append(np.searchsorted(keys, edges(buckets).astype(np.uint64)), len(keys))


def in_bytes(x: np.ndarray) -> bytes:
    """Unsigned numbers, each in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes() if len(x) else b""


def numbers(data: bytes, n: int) -> np.ndarray:
    """What in_bytes() made of ``n`` numbers."""
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def packs(keys: np.ndarray, cols: list[np.ndarray], counts: list[np.ndarray], buckets: int) -> Iterator[dict]:
    """A row of PACK for each bucket that has some of the sorted n-grams."""
    at = bounds(keys, buckets)
    for b in np.flatnonzero(at[1:] > at[:-1]):
        lo, hi = at[b], at[b + 1]
        part = [c[lo:hi] for c in cols]
        words, places = (part[0], np.zeros(0, np.int64)) if len(part) == 1 else np.unique(np.concatenate(part), return_inverse=True)
        yield {"bucket": int(b), "m": int(hi - lo), "words": words.tobytes(), "at": in_bytes(places), "counts": [in_bytes(c[lo:hi]) for c in counts]}


def unpacked(rows: list[dict], width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(cols, counts) of packs of n-grams of ``width`` words, one after another."""
    cols, counts = [], []
    for r in rows:
        words, m = np.frombuffer(r["words"], np.uint64), r["m"]
        cols.append([words] if width == 1 else list(words[numbers(r["at"], m * width)].reshape(width, m)))
        counts.append([numbers(c, m) for c in r["counts"]])
    return [np.concatenate(x) for x in zip(*cols, strict=True)], [np.concatenate(x) for x in zip(*counts, strict=True)]


def of_group(f: Callable[..., pa.Table], **fixed: object) -> Callable[[pa.Table], pa.Table]:
    """``f`` of a group's table alone, as applyInArrow takes it."""
    return lambda group: f(group, **fixed)


def table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, which is a path or a URI that Arrow knows."""
    if folder.startswith("file:") or "://" not in folder:
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", folder)
    return fs.FileSystem.from_uri(folder)


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Each array as ``name-column.npy``. Files appear whole and under a name of their own first, so that a repeated or speculative
    task writes the same again without harm."""
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    for column, x in arrays.items():
        data, part = io.BytesIO(), f"{path}/.{uuid.uuid4().hex}"
        np.save(data, x)
        with store.open_output_stream(part) as f:
            f.write(data.getbuffer())
        try:
            store.move(part, f"{path}/{name}-{column}.npy")
        except OSError:  # some stores don't replace a file: another attempt has written it
            store.delete_file(part)


def smallest(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


class HashArrays:
    """The arrays under ``folder`` named ``prefix-<bucket>``: opened when first needed, and memory-mapped where the folder is a
    mounted one; from other stores a shard is read once for each worker."""

    def __init__(self, folder: str, prefix: str, buckets: int) -> None:
        self.store, self.path = opened(folder)
        self.prefix, self.buckets = prefix, buckets
        self.files = {f.base_name for f in self.store.get_file_info(fs.FileSelector(self.path, allow_not_found=True))}
        self.held: dict[str, np.ndarray] = {}

    def column(self, bucket: int, name: str) -> np.ndarray | None:
        file = f"{self.prefix}-{bucket}-{name}.npy"
        if file not in self.files:
            return None
        if file not in self.held:
            if isinstance(self.store, fs.LocalFileSystem):
                self.held[file] = np.load(f"{self.path}/{file}", mmap_mode="r")
            else:
                with self.store.open_input_file(f"{self.path}/{file}") as f:
                    self.held[file] = np.load(io.BytesIO(f.read()))
        return self.held[file]

    def find(self, keys: np.ndarray, names: tuple[str, ...] = ()) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(whether each of the sorted ``keys`` is there, its values by name, 0 where it isn't)."""
        there, out = np.zeros(len(keys), bool), {n: np.zeros(len(keys), np.int64) for n in names}
        at = bounds(keys, self.buckets)
        for b in np.flatnonzero(at[1:] > at[:-1]):
            stored = self.column(b, "key")
            if stored is None or not len(stored):
                continue
            lo, hi = at[b], at[b + 1]
            place = np.minimum(np.searchsorted(stored, keys[lo:hi]), len(stored) - 1)
            hit = stored[place] == keys[lo:hi]
            there[lo:hi] = hit
            for n, x in out.items():
                x[lo:hi][hit] = self.column(b, n)[place[hit]]
        return there, out
