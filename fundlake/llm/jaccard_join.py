"""N-gram Jaccard join: sets of 5-word shingles, exact links, by T-occurrence search.

Equal sets are one class from the start. Two sets that link share one of the first shingles of each in any common order (a fifth
of a set and one more), so only those are dealt out, as inverted lists. The order goes by how many texts have a shingle, counted
over all texts in cells of shortened hashes, which keeps common passages out of the lists at every size; that changes the work,
never the result, and so does no cell that two shingles share. Lists with the same members
are one. Members of a list become candidates where sizes, places and parity bitmaps leave room for a link: two sets differ in at
least as many members as their bitmaps do in bits. Candidates are dealt into blocks of sets. A block's inverted lists are built
once and searched with each of its queries: the short lists are merged by a heap, the long ones probed by bisection (DivideSkip).

Candidates come in two rounds. The first takes from each list what connects its members, the second, of the lists that this
leaves open, the members that the links found so far have not connected.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial, reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import components, shared_dir, ship, with_hot, written
from .hash_arrays import HashArrays, bounds, cells, edges, in_bytes, numbers, of_group, pieces, save, smallest, table

WIDTH = 5
#: Sets in a block of a search, as expected; bytes of a word up to which it is hashed along with others; sets that a task remembers
#: to have emitted.
BLOCK, LONG, SEEN = 256, 64, 100_000
#: Bytes of text that a task turns into sets together.
PIECE = 1 << 18
#: Members of one list in a block, as expected, and those up to which bitmaps are compared one by one.
LIST_BLOCK, FEW = 1024, 8
#: What a step of a bisection costs against one of a merge.
PROBE = 0.01
#: A range's cells, ``m`` of them, by the steps from one to the next, and how many texts have each.
_CELLS = "bucket long, m int, steps binary, n binary"
_LOW = np.uint64(0xFFFFFFFF)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: The first 0 to 8 bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hashes ``h`` carried on by ``x``: one to one in each of the two."""
    h = (h ^ x) * _M1
    h ^= h >> np.uint64(31)
    h *= _M2
    h ^= h >> np.uint64(29)
    return h


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of ``text``, where they begin). ``text`` begins with white space and ends with eight bytes of it. Words
    of up to LONG bytes are hashed together, eight bytes at a time, all others one by one."""
    raw = np.frombuffer(text, np.uint8)
    inside = (raw != 32) & (raw - np.uint8(9) > 4)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, length = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(raw) - 7,), "<u8", text, 0, (1,))  # the eight bytes from each place on
    h = _mixed(length.astype(np.uint64) * _M2, eight[start] & _FIRST[np.minimum(length, 8)])
    more, done = np.flatnonzero(length > 8), 8
    while len(more) and done < LONG:
        h[more] = _mixed(h[more], eight[start[more] + done] & _FIRST[np.minimum(length[more] - done, 8)])
        done += 8
        more = more[length[more] > done]
    for k in more.tolist():
        h[k] = xxhash.xxh64_intdigest(text[start[k] : start[k] + length[k]])
    return h, start


def _chained(words: np.ndarray, width: int) -> np.ndarray:
    """The hashes of all runs of ``width`` words."""
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = _mixed(h, words[k : n + k])
    return h


def all_shingles(texts: list[bytes | None]) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its 5-word shingles (one of all words if there are fewer; none without words)."""
    joined = b"".join((b"\n", b"\n".join(t or b"" for t in texts).lower(), b" " * 8))  # of bytes: A-Z and ASCII white space only
    words, start = _words(joined)
    cut = np.searchsorted(start, np.cumsum([1, *(len(t or b"") + 1 for t in texts)])).tolist()
    every, out = _chained(words, WIDTH) if len(words) >= WIDTH else None, []
    for lo, hi in zip(cut, cut[1:], strict=False):
        if hi - lo >= WIDTH:
            h = np.sort(every[lo : hi - WIDTH + 1])
            new = np.empty(len(h), bool)
            new[0] = True
            np.not_equal(h[1:], h[:-1], out=new[1:])
            out.append(h[new])
        else:
            out.append(_chained(words[lo:hi], hi - lo) if hi > lo else np.empty(0, np.uint64))
    return out


def shingles(text: str | None) -> np.ndarray:
    """all_shingles() of one text."""
    return all_shingles([(text or "").encode("utf-8", "surrogatepass")])[0]


def required(n: int | np.ndarray, m: int | np.ndarray, percent: int = 80):
    """The least overlap of sets of n and m that link: 100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int = 80) -> int:
    """Members of a set of n, first in the common order, of which one is shared with any set that links."""
    return n - -(-percent * n // 100) + 1


def bitmap(members: np.ndarray) -> bytes:
    """Whether an odd number of members falls on each bit; at least as many bits as members, a power of two."""
    bits = 1 << max(6, int(len(members) - 1).bit_length())
    counts = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _counted(batches: Iterator[pa.RecordBatch], shards: int, schema: pa.Schema, flush: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """How many texts have each cell, by ranges of cells; a row for each range and about ``flush`` shingles."""
    held, size, seen = [], 0, set()

    def emit() -> pa.Table:
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        ends = bounds(cell, shards)
        rows = [
            {"bucket": k, "m": int(hi - lo), "steps": in_bytes(np.diff(cell[lo:hi] & _LOW, prepend=np.uint64(0))), "n": in_bytes(n[lo:hi])}
            for k, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)) if hi > lo
        ]
        return table(rows, schema)

    for b in (p for whole in batches for p in pieces(whole, "text", PIECE)):
        new = []
        for members in all_shingles(b["text"].to_pylist()):
            name = xxhash.xxh3_64_intdigest(members)
            if not len(members) or name in seen:  # a set that the task has met counts once
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(name)
            new.append(members)
        if new:
            held.append(cells(np.concatenate(new), shards))
            size += len(held[-1])
        if size >= flush:
            yield from emit().to_batches()
            held, size = [], 0
    if held:
        yield from emit().to_batches()


def _added_up(group: pa.Table, folder: str, least: int) -> pa.Table:
    """Writes the cells of a range that count ``least`` or more, and their counts."""
    rows = group.to_pylist()
    cell, place = np.unique(np.concatenate([np.cumsum(numbers(r["steps"], r["m"])) for r in rows]), return_inverse=True)
    n = np.bincount(place, np.concatenate([numbers(r["n"], r["m"]) for r in rows])).astype(np.int64)
    bucket, some = group["bucket"][:1], n >= least
    if some.any():
        shards = rows[0]["shards"]
        save(folder, f"often-{bucket[0]}", {"key": edges(shards).astype(np.uint64)[bucket[0].as_py()] | cell[some].astype(np.uint64), "n": smallest(n[some])})
    return pa.table({"bucket": bucket})


def _bytes(column: str) -> Column:
    """A text's bytes; of a null text none."""
    return F.coalesce(column, F.lit("")).cast("binary").alias(column)


def frequencies(docs: DataFrame, least: int = 8, shard: int = 1 << 24) -> tuple[str, int]:
    """(folder, number of ranges) of how many texts have a shingle, for cells that ``least`` or more have: ``HashArrays`` in the
    shared folder, which workers map. A range takes about ``shard`` bytes of text, so ranges and cells grow with the input. A list of
    fewer than ``least`` members costs little wherever it comes in the order."""
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark)
    shards = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard))
    schema = to_arrow_schema(StructType.fromDDL(_CELLS))
    counts = docs.select(_bytes("text")).mapInArrow(partial(_counted, shards=shards, schema=schema), _CELLS).withColumn("shards", F.lit(shards))
    stored = counts.groupBy("bucket").applyInArrow(of_group(_added_up, folder=folder, least=least), "bucket long")
    stored.write.format("noop").mode("overwrite").save()
    return folder, shards


#: The columns that ``sets`` makes on request, and their types.
_KINDS = {"members": "array<long>", "bits": "binary", "prefix": "array<long>"}


def sets(
    docs: DataFrame, *cols: str, order: tuple[str, int] | None = None, percent: int = 80, carry: tuple[Column, ...] = ()
) -> DataFrame:
    """(doc_id, n, sig, short, the columns ``carry``) of every row, and of ``cols`` what is asked: members, bits (``bitmap``),
    prefix (first members in the common order, which ``order`` from frequencies() gives). sig: 128-bit digest of the set, short: its first half; both null without
    members. A set that a task has met before has its other columns null from then on.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", _bytes("text"), *carry)
    kept = rows.columns[2:]
    more = [c for c in _KINDS if c in cols]

    def first(some: list[np.ndarray], stored: HashArrays | None) -> list[np.ndarray]:
        if stored is None or not some:
            often = [np.zeros(len(s), np.int64) for s in some]
        else:
            cell, place = np.unique(cells(np.concatenate(some), order[1]), return_inverse=True)
            often = np.split(stored.find(cell, ("n",))[1]["n"][place], np.cumsum([len(s) for s in some])[:-1])
        return [s[np.argsort(n, kind="stable")][: prefix_length(len(s), percent)] for s, n in zip(some, often, strict=True)]

    types = {"members": pa.list_(pa.int64()), "bits": pa.binary(), "prefix": pa.list_(pa.int64())}

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        stored = order and HashArrays(order[0], "often", order[1])
        make = {"members": lambda some: some, "bits": lambda some: list(map(bitmap, some)), "prefix": lambda some: first(some, stored)}
        for whole in batches:
            for b in pieces(whole, "text", PIECE):
                all_sets = all_shingles(b["text"].to_pylist())
                sig = [xxhash.xxh3_128_digest(s) if len(s) else None for s in all_sets]
                short = [None if d is None else int.from_bytes(d[:8], "little", signed=True) for d in sig]
                new = []
                for d in sig:
                    new.append(d is not None and d not in seen)
                    if new[-1]:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(d)
                sizes = pa.array([len(s) for s in all_sets], pa.int64())
                out = [b["doc_id"], sizes, pa.array(sig, pa.binary()), pa.array(short, pa.int64())]
                some = [s for s, x in zip(all_sets, new, strict=True) if x]
                for c in more:
                    values = (v if c == "bits" else v.view(np.int64) for v in make[c](some))
                    out.append(pa.array([next(values) if x else None for x in new], types[c]))
                yield pa.RecordBatch.from_arrays([*out, *(b[c] for c in kept)], ["doc_id", "n", "sig", "short", *more, *kept])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made_cols = "".join(f", {c} {_KINDS[c]}" for c in more) + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(made, f"doc_id {kind}, n long, sig binary, short long{made_cols}")


class InvertedLists:
    """The inverted lists of some sets: for each member the sets, by number, that hold it."""

    def __init__(self, members: list[np.ndarray], percent: int = 80):
        self.percent = percent
        self.sizes = np.array([len(s) for s in members], np.int64)
        flat, owner = np.concatenate(members), np.repeat(np.arange(len(members)), self.sizes)
        by = np.argsort(flat, kind="stable")  # so owners ascend in each list
        self.owner = owner[by].tolist()
        self.keys, start = np.unique(flat[by], return_index=True)
        self.start, self.end = start, np.append(start[1:], len(flat))

    def search(self, query: np.ndarray) -> list[int]:
        """The sets that link with ``query`` (sorted), itself too if it is one of them."""
        n, need = len(query), required(len(query), self.sizes, self.percent)
        fits = 100 * np.minimum(n, self.sizes) >= self.percent * np.maximum(n, self.sizes)
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        least = int(need[fits].min()) if fits.any() else n + 1
        if len(at) < least:
            return []
        length = self.end[at] - self.start[at]
        by = np.argsort(length, kind="stable")
        lists = list(zip(self.start[at[by]].tolist(), self.end[at[by]].tolist(), strict=True))
        n_long = min(least - 1, int(least / (PROBE * math.log2(int(length.max()) + 1) + 1)))
        cut = len(lists) - n_long
        out = []
        for k, count in self._merged(lists[:cut], least - n_long):
            enough, left = int(need[k]), n_long
            for start, end in lists[cut:]:
                if count >= enough or count + left < enough:
                    break
                place = bisect_left(self.owner, k, start, end)
                count += place < end and self.owner[place] == k
                left -= 1
            if count >= enough:
                out.append(k)
        return out

    def _merged(self, lists: list[tuple[int, int]], least: int) -> Iterator[tuple[int, int]]:
        """(set, count) of those in ``least`` of ``lists`` or more. Where the lists in front hold a set less often, as many as
        can't reach ``least`` alone skip to the set in front of the others."""
        owner, place = self.owner, [start for start, _ in lists]
        heap = [(owner[start], k) for k, (start, _) in enumerate(lists)]
        heapify(heap)
        while len(heap) >= least:
            front, popped = heap[0][0], []
            while heap and heap[0][0] == front:
                popped.append(heappop(heap)[1])
            if len(popped) >= least:
                yield front, len(popped)
                to = front + 1
            else:
                while heap and len(popped) < least - 1:
                    popped.append(heappop(heap)[1])
                if not heap:
                    return
                to = heap[0][0]
            for k in popped:
                place[k] = bisect_left(owner, to, place[k], lists[k][1])
                if place[k] < lists[k][1]:
                    heappush(heap, (owner[place[k]], k))


def linked(docs: DataFrame, names: DataFrame, pairs: DataFrame, percent: int = 80) -> DataFrame:
    """(src, dst): nodes of ``names`` (sig, short, rep, node) that link, of ``pairs`` (src, dst: shorts) or met on the way; of
    the links of a block no more than connect what its links connect.

    Each pair's dst is held in one block, by the least of its sources, and asked for by its sources there; the many of one
    source are dealt into blocks of about BLOCK.
    """
    hubs = pairs.groupBy("dst").agg(F.min("src").alias("hub"))
    many = hubs.groupBy("hub").agg(F.count("*").alias("k"))
    units = max(1, -(-hubs.count() // BLOCK))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("k") / BLOCK))
    home = written(hubs.join(many, "hub").select("dst", F.pmod(F.xxhash64("hub", part), F.lit(units)).alias("unit")))
    rows = home.select("unit", F.lit(0).alias("role"), F.col("dst").alias("short"))
    rows = rows.unionByName(pairs.join(home, "dst").select("unit", F.lit(1).alias("role"), F.col("src").alias("short")).distinct())
    wanted = names.join(rows.select("short").distinct(), "short")  # each set of that short
    texts = docs.join(wanted.select("rep").distinct(), docs["doc_id"].eqNullSafe(F.col("rep")), "left_semi")
    found = sets(texts.select("doc_id", "text"), "members").where("members is not null").select("sig", "members")
    members = wanted.select("sig", "short", "node").join(found, "sig").groupBy("node", "short").agg(F.first("members").alias("members"))
    rows = rows.join(written(members), "short").select("unit", "role", "node", "members")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, held, index, up = None, [], [], None, {}

        def root(node: int) -> int:
            while up.setdefault(node, node) != node:
                up[node] = node = up[up[node]]
            return node

        for b in batches:
            flat, cut = b["members"].flatten().to_numpy().view(np.uint64), b["members"].offsets.to_numpy()
            cut, src, dst = cut - cut[0], [], []
            for k, (at, role, node) in enumerate(zip(*(b[c].to_pylist() for c in ("unit", "role", "node")), strict=True)):
                if at != unit:
                    unit, nodes, held, index, up = at, [], [], None, {}
                s = flat[cut[k] : cut[k + 1]]
                if role == 0:
                    nodes.append(node), held.append(s.copy())
                    continue
                index = index or InvertedLists(held, percent)
                for other in (nodes[i] for i in index.search(s)):
                    if root(other) != root(node):
                        up[root(other)] = root(node)
                        src.append(node), dst.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return rows.repartition("unit").sortWithinPartitions("unit", "role").mapInArrow(searched, "src long, dst long")


class _Members:
    """Members of a list (short, n, rest: from the place on, part: the component, bitmap, whether it asks)."""

    def __init__(self, rows: list[tuple], percent: int):
        self.percent = percent
        self.short, n, rest, part, self.bits, asks = (list(c) for c in zip(*rows, strict=True))
        self.asks = np.array(asks, bool)
        self.n, self.rest, self.part = (np.array(c, np.int64) for c in (n, rest, part))
        size = np.array([len(x) for x in self.bits])
        self.widths = {int(w): np.flatnonzero(size == w) for w in np.unique(size)} if len(rows) > FEW else {}
        self.maps = {w: np.frombuffer(b"".join(self.bits[k] for k in at), np.uint64).reshape(len(at), -1) for w, at in self.widths.items()}

    def near(self, n: int, rest: int, bits: bytes, open_: np.ndarray) -> np.ndarray:
        """Those of ``open_`` (bool) whose sizes, places and bitmaps leave room for a link; numbers, ascending."""
        could = open_ & ((100 + self.percent) * np.minimum(rest, self.rest) >= self.percent * (n + self.n))
        if not self.widths:
            return np.array([k for k in np.flatnonzero(could).tolist() if apart(bits, self.bits[k]) <= self.room(n, int(self.n[k]))], np.int64)
        out, mine = [], np.frombuffer(bits, np.uint64)
        for w, at in self.widths.items():
            rows = np.flatnonzero(could[at])
            if len(rows):
                a, b = mine, self.maps[w][rows]
                while a.shape[-1] > b.shape[-1]:
                    a = folded(a)
                while b.shape[-1] > a.shape[-1]:
                    b = folded(b)
                out.append(at[rows[np.bitwise_count(a ^ b).sum(-1) <= self.room(n, self.n[at[rows]])]])
        return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)

    def room(self, n: int, m: int | np.ndarray):
        """In how many members linked sets of n and m differ at most."""
        return n + m - 2 * required(n, m, self.percent)

    def others(self, part: int) -> np.ndarray:
        """Who isn't of the component ``part``; none is of the component -1."""
        return (self.part != part) | (self.part < 0)

    def pairs(self, connect: bool) -> list[tuple[int, int]]:
        """Candidates among the members. With ``connect`` only until all are connected that can be: ``label`` is then the same for
        connected members, ``skipped`` holds the labels of those of which pairs are left out."""
        found, number = [], np.arange(len(self.n))
        self.label, left = number.copy(), []
        for i in number[:-1].tolist():
            other = self.others(self.part[i]) & (number > i)
            if connect:
                if (self.label[i + 1 :] == self.label[i]).any():
                    left.append(i)
                other &= self.label != self.label[i]
            for j in self.near(int(self.n[i]), int(self.rest[i]), self.bits[i], other).tolist():
                if connect and self.label[j] == self.label[i]:
                    left.append(i)
                    continue
                if connect:
                    self.label[self.label == self.label[j]] = self.label[i]
                found.append((self.short[i], self.short[j]))
        self.skipped = set(self.label[left].tolist())
        return found


def folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps at half their width."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def apart(a: bytes, b: bytes) -> int:
    """In how many bits two bitmaps differ, the wider one folded."""
    if len(a) < len(b):
        a, b = b, a
    x, y, width = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a)
    while width > 8 * len(b):
        width //= 2
        x = (x & ((1 << width) - 1)) ^ (x >> width)
    return (x ^ y).bit_count()


#: The name of a list: how many members it has, and two numbers made of them.
_LIST = ["k", "s", "x"]


def strong(n: Column, pos: Column, percent: int = 80) -> Column:
    """Whether a set of n may link, from its place on, with one of its own size. The smaller set of a link, or either of two of one
    size, always is strong where the two first meet."""
    return (100 + percent) * (n - pos) >= 2 * percent * n


def inverted(rows: DataFrame, percent: int = 80) -> DataFrame:
    """(k, s, x, short, place, many, head): the members of each list of two or more, of ``rows`` (short, n, prefix), but for members that
    can link with no other one from their places on. Lists with the same members are one, with each member's earliest place
    (n << 32 | place in the prefix). many: whether more than LIST_BLOCK members are ``strong``; head: one member of each."""
    posts = rows.where("prefix is not null").select("short", "n", F.posexplode("prefix").alias("pos", "h"))
    posts = posts.select("h", "short", F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("pos").cast("long")).alias("place"))
    posts = posts.repartition("h").groupBy("h", "short").agg(F.min("place").alias("place"))  # tasks repeat equal sets
    n, pos = _size(F.col("place")), _pos(F.col("place"))
    held = F.bit_or(F.when(strong(n, pos, percent), _bit(_bucket(n)))).alias("sizes")
    sizes = posts.groupBy("h").agg(F.count("*").alias("all"), held).where("all > 1 and sizes is not null")
    # the sizes that a member's partner can have, in four buckets at most
    low, high = F.ceil(n * percent / 100), F.floor(((100 + percent) * (n - pos) - percent * n) / percent)
    first, last = _bucket(low), _bucket(high)
    wanted = reduce(Column.bitwiseOR, (_bit(F.least(first + k, last)) for k in range(4)))
    could = (high >= low) & (F.col("sizes").bitwiseAND(wanted) != 0)
    posts = posts.join(sizes.hint("shuffle_hash"), "h").where(strong(n, pos, percent) | could)
    name = F.count("*").alias("k"), F.bit_xor(F.xxhash64("short", F.lit(1))).alias("s"), F.bit_xor(F.xxhash64("short", F.lit(2))).alias("x")
    names = posts.groupBy("h").agg(*name, (F.count_if(strong(n, pos, percent)) > LIST_BLOCK).alias("many"), F.min("short").alias("first")).where("k > 1")
    members = posts.select("h", "short", "place").join(names.hint("shuffle_hash"), "h")
    return members.groupBy(*_LIST, "short").agg(F.min("place").alias("place"), F.max("many").alias("many"), F.max(F.col("short") == F.col("first")).alias("head"))


def _bucket(n: Column) -> Column:
    """Sizes that differ by less than a fifth, as a number from 0."""
    return F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) * 4).cast("int")


def _bit(bucket: Column) -> Column:
    """One of 64 bits; buckets far from each other share them."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bucket % 64)


def _size(place: Column) -> Column:
    return F.shiftright(place, 32)


def _pos(place: Column) -> Column:
    return place.bitwiseAND(F.lit(0xFFFFFFFF))


def candidates(lists: DataFrame, bits: DataFrame, connect: bool, percent: int = 80) -> DataFrame:
    """(k, s, x, grp, src, dst), src before dst: candidates among the members of each list (k, s, x, short, place, part, asks).

    With ``connect``: in each block what connects its members as far as they can be; of connected members pairs may be left out:
    these have rows with the number ``grp`` of their group, their short as src and their place as dst. Without: all pairs of
    members of different components (``part``, -1: of none). ``bits``: (short, bits).

    A list is dealt into blocks of about LIST_BLOCK members, so that none is held whole by a task. Members that ``ask`` meet
    those of other blocks, too.
    """
    cols = [*_LIST, "short", "place", "part", "asks"]
    blocks = F.ceil(F.col("k") / LIST_BLOCK).cast("int")
    rows = lists.withColumn("own", F.pmod(F.xxhash64("short"), blocks).cast("int"))
    held = rows.select(*cols, "own", F.col("own").alias("block"), F.lit(0).alias("role"))
    asked = rows.where((F.col("k") > LIST_BLOCK) & F.col("asks")).select(*cols, "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("role"))
    dealt = held.unionByName(asked.where("own <> block")).join(bits, "short")
    order = [*_LIST, "block", "role", "short", "place", "part", "bits", "own", "asks"]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, members, out = None, [], None, []

        def add(found: list[tuple[int, int]]) -> None:
            out.extend((*key[:3], None, min(a, b), max(a, b)) for a, b in found if a != b)

        def close() -> None:
            nonlocal members
            members = _Members(held, percent)
            add(members.pairs(connect))

        def end() -> None:
            if members is None and held:
                close()
            if connect and members is not None:
                for h, label in zip(held, members.label.tolist(), strict=True):
                    if label in members.skipped:
                        leave(label, h[0], h[1], h[2])

        def leave(label: int, short: int, n: int, rest: int) -> None:
            out.append((*key[:3], key[3] << 32 | label, short, n << 32 | (n - rest)))

        for whole in batches:
            for at in range(0, len(whole), 1024):
                b = whole.slice(at, 1024)
                for r in zip(*(b[c].to_pylist() for c in order), strict=True):
                    if r[:4] != key:
                        if key is not None:
                            end()
                        key, held, members = r[:4], [], None
                    short, n, rest, part, mine = r[5], r[6] >> 32, (r[6] >> 32) - (r[6] & 0xFFFFFFFF), r[7], r[8]
                    if r[4] == 0:
                        held.append((short, n, rest, part, mine, r[10]))
                        continue
                    if not held:
                        continue
                    if members is None:
                        close()
                    other = members.others(part)
                    if r[9] > r[3]:  # two that both ask meet once
                        other &= ~members.asks
                    near = members.near(n, rest, mine, other)
                    if connect:  # one of each group; what is left out of a group is noted once
                        labels, one, many = np.unique(members.label[near], return_index=True, return_counts=True)
                        near = near[one]
                        for label in labels[many > 1].tolist():
                            members.skipped.add(label)
                            leave(label, short, n, rest)
                    add([(short, members.short[j]) for j in near.tolist()])
                if len(out) > 5_000:
                    yield batch(out)
                    out.clear()
        if key is not None:
            end()
        yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        made = list(zip(*out, strict=True)) if out else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], [*_LIST, "grp", "src", "dst"])

    dealt = dealt.repartition(*_LIST, "block").sortWithinPartitions(*_LIST, "block", "role")
    return dealt.select(*order).mapInArrow(searched, "k long, s long, x long, grp long, src long, dst long")


def join(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``.

    component_id: the smallest doc_id that links reach. Null and empty texts and those without words have no shingles and link
    with nothing, each its own component. Each row is looked at by its own text, whatever rows share its id. A null id is kept,
    its component is the smallest id that links reach, if any. Other columns are not read; an empty table gives no rows.
    """
    rows, classes = _classes(docs, percent)
    out = with_hot(rows.select("doc_id", "n", "sig"), classes, ["sig"], ["component", "component_id"])
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def distinct(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, whole, and all rows without words: the one with the smallest (doc_id, md5 of the
    text, other columns), null ids last."""
    key = F.md5(F.col("text").cast("binary")).alias("_key")
    rows, classes = _classes(docs.select("doc_id", "text"), percent, key)
    rows = rows.where("n > 0").groupBy("sig", "doc_id", "_key").agg(F.count("*").alias("m"))
    rows = with_hot(rows, classes, ["sig"], ["component", "component_id"]).groupBy("component", "doc_id", "_key").agg(F.sum("m").alias("m"))
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key", "m")).alias("x")
    best = rows.groupBy("component").agg(lowest).select(F.col("x.doc_id").alias("best_id"), F.col("x._key").alias("best_key"), F.col("x.m").alias("best_m"))
    nested = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), key)  # so that no name clashes
    hit = nested.join(best, F.col("id").eqNullSafe(F.col("best_id")) & (F.col("_key") == F.col("best_key")))
    once = hit.where("best_m = 1").select("row.*")
    more = hit.where("best_m > 1").groupBy("best_id", "best_key").agg(F.min("row").alias("row")).select("row.*")
    empty = docs.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return once.unionByName(more).unionByName(empty)


def _classes(docs: DataFrame, percent: int, *carry: Column) -> tuple[DataFrame, DataFrame]:
    """(``sets`` of all rows with ``carry``; sig, hot, component, component_id of each set with members). hot: a thousandth of all
    rows or more have the set, so that a thousand sets at most are.

    A class of equal sets is a node with a number of its own, since rows with one id may have other texts and null ids none.
    Lists and candidates go by the digest's first half; sets that share it, if there are any, are compared each.
    """
    rows = written(sets(docs, "bits", "prefix", order=frequencies(docs), percent=percent, carry=carry))
    names = rows.where("sig is not null").groupBy("sig").agg(F.min("short").alias("short"), F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    names = written(names.withColumn("node", F.monotonically_increasing_id()))
    lists = written(inverted(rows, percent))
    members = lists.select("short").distinct()
    bits = written(rows.where("bits is not null").join(members, "short", "left_semi").groupBy("sig", "short").agg(F.first("bits").alias("bits")).drop("sig"))

    is_strong = strong(_size(F.col("place")), _pos(F.col("place")), percent)
    # of lists with too many that are strong, the head first connects what it can
    asks = F.when(F.col("many"), F.col("head")).otherwise(is_strong)
    alone = lists.select("*", F.lit(-1).cast("long").alias("part"), asks.alias("asks"))
    first = written(candidates(alone, bits, True, percent))
    tried = written(first.where("grp is null").select("src", "dst").distinct())
    edges = written(linked(docs, names, tried, percent))
    found = components(edges)
    # what was left out, by components so far
    mixed = [F.col(c).bitwiseXOR(F.xxhash64(F.col("grp"), F.lit(c))).alias(c) for c in ("s", "x")]
    groups = first.where("grp is not null").select("k", *mixed, F.col("src").alias("short"), F.col("dst").alias("place")).distinct()
    parts = names.join(found, "node").groupBy("short").agg(F.when(F.count("*") == 1, F.min("component")).alias("part"))
    lists = groups.unionByName(lists.where("many").drop("many", "head")).join(parts, "short", "left")
    lists = written(lists.withColumn("part", F.coalesce("part", F.lit(-1).cast("long"))))
    heads = lists.groupBy(*_LIST).agg(F.max("part").alias("main"), F.min("part").alias("low")).where("low < main or low < 0")
    lists = written(lists.join(heads.drop("low"), _LIST))
    # a pair has one that is strong, and one that isn't of the component ``main``: the fewer ask
    other = (F.col("part") != F.col("main")) | (F.col("part") < 0)
    fewer = lists.groupBy(*_LIST).agg((F.count_if(is_strong) <= F.count_if(other)).alias("by_strong"))
    lists = lists.join(fewer, _LIST).withColumn("asks", F.when(F.col("by_strong"), is_strong).otherwise(other))
    if not lists.isEmpty():
        rest = written(candidates(lists, bits, False, percent).select("src", "dst").distinct().join(tried, ["src", "dst"], "left_anti"))
        if not rest.isEmpty():
            more = written(linked(docs, names, rest, percent))
            if not more.isEmpty():
                found = components(edges.unionByName(more))
    total = rows.count()
    whole = names.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    return rows, written(whole.select("sig", (F.col("n") * 1000 >= total).alias("hot"), "component").join(lowest, "component"))
