"""Collocations: frequent phrases mined from positional inverted lists and scored by how much more often they occur than chance has.

Texts become blocks of inverted lists: for each word of a block the sorted positions where it stands. Level by level the lists of
frequent phrases are merge-joined with the postings of adjacent frequent words; the length of a list is the phrase's exact
frequency in the block. Frequencies are added up over blocks by ranges of the phrases' keys, and the keys of frequent phrases,
sorted arrays in the shared folder, tell the blocks which lists to extend further. Most phrases occur once: before phrases are
shuffled, their shortened keys are, two bytes or so each, and only phrases whose cell counts often enough follow. A cell counts
all that share it, so that no frequent phrase is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import shared_dir, ship, written
from .hash_arrays import PACK, HashArrays, bounds, cells, combine, edges, in_bytes, key_of, merged, numbers, of_group, packs, pieces, save, table, unpacked

#: Between pieces; no byte of UTF-8.
_GAP = b"\xff"
_PIECES = bytes(32 if c == 9 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
#: A block: its languages and their word counts; for each word its language, bytes, key and list length; all positions, list by list.
_BLOCK = "langs array<string>, n array<long>, lang binary, words binary, keys binary, lengths binary, positions binary"

#: ``m`` counts of the cells of a range, which are given by the steps from one to the next.
_CELLS = "bucket long, m int, steps binary, n binary"

#: Blocks in a file. A file is one row group, which is written, read and sent to Python whole: with 2 MB or so a block, all blocks of
#: a task would fill the heap and the buffers beside it.
PER_FILE = 12


class _Ids(dict):
    """Places of a language's words among all words of a block; the gap is 0 for every language."""

    def __init__(self, lang: int, words: list[tuple[int, bytes]]) -> None:
        super().__init__({_GAP: 0})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self.words)
        self.words.append((self.lang, word))
        return value


def _blocks(batches: Iterator[pa.RecordBatch], size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    langs, words, held, filled = {}, [(0, _GAP)], [], 0

    def emit() -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(held)
        lengths = np.bincount(flat, minlength=len(words))
        positions = np.argsort(flat, kind="stable")[lengths[0] :]
        lang = np.array([w[0] for w in words[1:]], np.uint32)
        n = np.bincount(lang, lengths[1:], len(langs)).astype(np.int64)
        keys = _keys(list(langs), words[1:])
        row = {"langs": list(langs), "n": n.tolist(), "lang": lang.tobytes(), "words": b"\n".join(w[1] for w in words[1:]), "keys": keys.tobytes(), "lengths": lengths[1:].astype(np.uint32).tobytes(), "positions": positions.astype(np.uint32).tobytes()}
        yield from table([row], schema).to_batches()

    for name, text in (x for b in batches for p in pieces(b, "text") for x in zip(p["lang"].to_pylist(), p["text"].to_pylist(), strict=True)):
        ids = langs.get(name)
        if ids is None:
            ids = langs[name] = _Ids(len(langs), words)
        tokens = text.lower().translate(_PIECES).replace(_GAP, b" \xff ").split()
        tokens.append(_GAP)
        held.append(np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens)))
        filled += len(tokens)
        if filled >= size:
            if len(words) > 1:
                yield from emit()
            langs, words, held, filled = {}, [(0, _GAP)], [], 0
    if len(words) > 1:
        yield from emit()


def blocks(docs: DataFrame, size: int = 1 << 18) -> DataFrame:
    """The texts as blocks of inverted lists, of about ``size`` words each, written to the shared folder."""
    schema = to_arrow_schema(StructType.fromDDL(_BLOCK))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return written(rows.mapInArrow(partial(_blocks, size=size, schema=schema), _BLOCK), PER_FILE)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The blocks one by one."""
    return (row for b in batches for k in range(b.num_rows) for row in b.slice(k, 1).to_pylist())


def _single(batches: Iterator[pa.RecordBatch], flush: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """(lang, word, f) of the words of several blocks, each once for about ``flush`` distinct words of a block."""

    def emit(parts: list[tuple]) -> pa.RecordBatch:
        keys, lengths = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(keys)
        starts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        one = pa.array(order[starts])
        lang, word = (pa.chunked_array([p[k] for p in parts]).take(one).combine_chunks() for k in (2, 3))
        return pa.RecordBatch.from_arrays([lang, word, pa.array(np.add.reduceat(lengths[order], starts))], ["lang", "word", "f"])

    held, size = [], 0
    for r in _rows(batches):
        keys, lang = np.frombuffer(r["keys"], np.uint64), pa.array(np.frombuffer(r["lang"], np.uint32))
        held.append((keys, np.frombuffer(r["lengths"], np.uint32).astype(np.int64), pa.array(r["langs"]).take(lang), pa.array(r["words"].split(b"\n"), pa.binary())))
        size += len(keys)
        if size >= flush:
            yield emit(held)
            held, size = [], 0
    if held:
        yield emit(held)


def _keys(langs: list[str], words: list[tuple[int, bytes]]) -> np.ndarray:
    """The hashes of (place of its language, word), seeded by the language."""
    seeds = [xxhash.xxh3_64_intdigest(x.encode()) for x in langs]
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seeds[k]) for k, w in words), np.uint64, len(words))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, key, f) of (lang, word, f)."""
    for b in batches:
        langs = b["lang"].dictionary_encode()
        keys = _keys(langs.dictionary.to_pylist(), list(zip(langs.indices.to_pylist(), b["word"].to_pylist(), strict=True)))
        yield pa.RecordBatch.from_arrays([b["lang"], b["word"], pa.array(keys.view(np.int64)), b["f"]], ["lang", "word", "key", "f"])


def _extended(batches: Iterator[pa.RecordBatch], level: int, folder: str, shards: int, schema: pa.Schema, counting: bool, flush: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The phrases of ``level`` words whose parts are frequent, each once for about ``flush`` occurrences: the counts of their
    cells if ``counting``, else packs of those whose cells count often enough.

    All postings of a block's frequent words lie in the order of their positions. A phrase's occurrence is the place of its first
    word there; as the list of occurrences has that order too, the merge with adjacent words looks at the posting that follows.
    """
    known = [HashArrays(folder, str(k), shards) for k in range(1, level)]
    heavy = None if counting else HashArrays(folder, f"cells{level}", shards)

    def among(keys: np.ndarray, stored: HashArrays) -> np.ndarray:
        distinct, place = np.unique(keys, return_inverse=True)
        return stored.find(distinct)[0][place]

    def occurrences(r: dict) -> list[np.ndarray]:
        keys, lengths, positions = np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["lengths"], np.uint32), np.frombuffer(r["positions"], np.uint32)
        order = np.argsort(keys)
        frequent = np.zeros(len(keys), bool)
        frequent[order] = known[0].find(keys[order])[0]
        position, word = positions[np.repeat(frequent, lengths)], np.repeat(keys[frequent], lengths[frequent])
        order = np.argsort(position)
        position, word = position[order], word[order]
        at, key = np.arange(len(word)), word
        for k in range(1, level):  # from occurrences of k words to such of k + 1
            alive = np.zeros(len(word) + 1, bool)
            alive[at] = True
            nxt = np.minimum(at + k, len(word) - 1)
            adjacent = (at + k < len(word)) & (position[nxt] == position[at] + k) & alive[at + 1]
            at, key = at[adjacent], combine(key[adjacent], word[nxt[adjacent]])
            if k + 1 < level:
                seen = among(key, known[k])
            elif not counting:
                seen = among(cells(key, shards), heavy)
            else:
                return [cells(key, shards)]
            at, key = at[seen], key[seen]
        return [word[at + k] for k in range(level)]

    def emit(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if not counting:
            return iter(table(list(packs(*merged(cols), shards)), schema).to_batches())
        cell, n = np.unique(cols[0], return_counts=True)
        ends = bounds(cell, shards)
        rows = ({"bucket": int(b), "m": int(hi - lo), "steps": in_bytes(np.diff(cell[lo:hi] & np.uint64(0xFFFFFFFF), prepend=np.uint64(0))), "n": in_bytes(n[lo:hi])} for b, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)) if hi > lo)
        return iter(table(list(rows), schema).to_batches())

    held, size = [], 0
    for r in _rows(batches):
        held.append(occurrences(r))
        size += len(held[-1][0])
        if size >= flush:
            yield from emit(held)
            held, size = [], 0
    if held:
        yield from emit(held)


def _heavy(group: pa.Table, level: int, least: int, folder: str, shards: int) -> pa.Table:
    """Writes the cells of a range that count ``least`` or more."""
    rows = group.to_pylist()
    cell = np.concatenate([np.cumsum(numbers(r["steps"], r["m"])) for r in rows])
    cell, place = np.unique(cell, return_inverse=True)
    n = np.bincount(place, np.concatenate([numbers(r["n"], r["m"]) for r in rows]))
    bucket = rows[0]["bucket"]
    save(folder, f"cells{level}-{bucket}", {"key": edges(shards).astype(np.uint64)[bucket] | cell[n >= least].astype(np.uint64)})
    return pa.table({"bucket": pa.array([bucket], pa.int64())})


def _frequent(group: pa.Table, level: int, least: int, schema: pa.Schema) -> pa.Table:
    """The frequent phrases of a range: key, word keys, frequency, keys of what stands before and after each cut."""
    key, cols, (f,) = merged(*unpacked(group.to_pylist(), level))
    some = f >= least
    key, cols, f = key[some], [c[some] for c in cols], f[some]
    lists = lambda xs: pa.array(list(np.stack(xs, 1).view(np.int64)) if len(key) else [], pa.list_(pa.int64()))
    firsts, rests = [key_of(cols[:k]) for k in range(1, level)], [key_of(cols[k:]) for k in range(1, level)]
    return pa.Table.from_arrays([pa.array(key.view(np.int64)), lists(cols), pa.array(f), lists(firsts), lists(rests)], schema=schema)


def _stored(group: pa.Table, level: int, folder: str) -> pa.Table:
    """Writes a range's keys."""
    keys = np.sort(group["key"].to_numpy().view(np.uint64))
    save(folder, f"{level}-{group['bucket'][0].as_py()}", {"key": keys})
    return pa.table({"bucket": group["bucket"].slice(0, 1)})


def _share(df: DataFrame, level: int, folder: str, shards: int) -> int:
    """Writes the keys of ``df`` as arrays for the workers; their number."""
    bucket = F.expr(f"shiftright(shiftrightunsigned(key, 32) * {shards}L, 32)")
    df.select("key", bucket.alias("bucket")).groupBy("bucket").applyInArrow(of_group(_stored, level=level, folder=folder), "bucket long").write.format("noop").mode("overwrite").save()
    return df.count()


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100, block: int = 1 << 18) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, sizes): the frequent words (lang, word, key, f); the frequent phrases of two words or more (key, words, f,
    firsts, rests), all by keys; the number of words of each language (lang, n). All are written to the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark)
    lists = blocks(docs, block)
    sizes = written(lists.select(F.explode(F.arrays_zip("langs", "n")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.n").alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // 1_000_000))
    single = lists.select("langs", "lang", "words", "keys", "lengths").mapInArrow(_single, "lang string, word binary, f long")
    single = single.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    words = written(single.mapInArrow(_keyed, "lang string, word binary, key long, f long").withColumn("word", F.col("word").cast("string")))
    left = _share(words, 1, folder, shards)
    kind = "key long, words array<long>, f long, firsts array<long>, rests array<long>"
    row = F.array("id")
    phrases = spark.range(0).select(F.col("id").alias("key"), row.alias("words"), F.col("id").alias("f"), row.alias("firsts"), row.alias("rests"))
    pack_schema, cell_schema, schema = (to_arrow_schema(StructType.fromDDL(x)) for x in (PACK, _CELLS, kind))
    for level in range(2, longest + 1):
        if not left:
            break
        step = lambda counting, kind, schema, level=level: lists.select("keys", "lengths", "positions").mapInArrow(partial(_extended, level=level, folder=folder, shards=shards, schema=schema, counting=counting), kind)
        counts = step(True, _CELLS, cell_schema).groupBy("bucket").applyInArrow(of_group(_heavy, level=level, least=least, folder=folder, shards=shards), "bucket long")
        counts.write.format("noop").mode("overwrite").save()
        candidates = step(False, PACK, pack_schema)
        found = written(candidates.groupBy("bucket").applyInArrow(of_group(_frequent, level=level, least=least, schema=schema), kind))
        phrases = phrases.unionByName(found)
        left = _share(found, level, folder, shards)
    return words, phrases, sizes


def mine(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, block: int = 1 << 18) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to ``longest`` words.

    Texts, A-Z in lower case, are split at ``.,;:!?`` and line ends into pieces, these at spaces and tabs into words; a null text
    is empty, a null language ``und``. A phrase occurs a >= ``least`` times within pieces, overlaps included. For each cut,
    floor(1000 * a * n / (l * r)) compares it with its parts; the lowest counts, ties to the first cut. Phrases that a longer one
    holds as often go. Ranks go by score, a and the phrase's bytes. Every occurrence of every row counts, repeated rows too;
    columns besides lang and text aren't read; an empty table has no phrases.
    """
    words, phrases, sizes = frequent_phrases(docs, longest, least, block)
    parts = words.select("key", "f").union(phrases.select("key", "f"))
    by = lambda name: parts.select(F.col("key").alias(name), F.col("f").alias(name[0]))
    # a phrase is as frequent as one around it only if it is as one with a word more
    around = phrases.where(F.size("words") > 2).select(F.explode(F.array(F.element_at("firsts", -1), F.element_at("rests", 1))).alias("key"), F.col("f").alias("around")).groupBy("key").agg(F.max("around").alias("around"))
    kept = phrases.join(around, "key", "left").where(F.col("around").isNull() | (F.col("around") < F.col("f"))).select("key", "words", F.col("f").alias("a"), "firsts", "rests")
    # the words' texts, and through them the language
    spelt = kept.select("key", F.posexplode("words").alias("pos", "word_key")).join(words.select(F.col("key").alias("word_key"), "lang", "word"), "word_key")
    text = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]))
    spelt = spelt.groupBy("key").agg(F.first("lang").alias("lang"), text.alias("phrase"))
    cuts = kept.select("key", "a", F.posexplode(F.arrays_zip("firsts", "rests")).alias("cut", "x")).select("key", "a", "cut", F.col("x.firsts").alias("l_key"), F.col("x.rests").alias("r_key"))
    scored = cuts.join(by("l_key"), "l_key").join(by("r_key"), "r_key").join(spelt, "key").join(sizes, "lang")
    scored = scored.withColumn("score", F.expr("cast(1000 * cast(a as decimal(38,0)) * cast(n as decimal(38,0)) as decimal(38,0)) div cast(cast(l as decimal(38,0)) * cast(r as decimal(38,0)) as decimal(38,0))"))
    best = scored.groupBy("key").agg(F.min_by(F.struct("lang", "phrase", "a", "l", "r", "n", "score"), F.struct("score", "cut")).alias("x")).select("x.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
