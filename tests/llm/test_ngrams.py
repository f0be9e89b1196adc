"""Operators 11 to 13 against brute force on small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundlake.llm import collocations, fill_in_middle, hash_arrays, kneser_ney, queries

RND = random.Random(11)
VOCABULARY = ["the", "The", "of", "été", "日本", "x1", "a-b", "😀k", "Ünder", "zz"]


def _text(n):
    return "".join(RND.choices(VOCABULARY, weights=range(10, 0, -1))[0] + RND.choice([" ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(n))


TEXTS = [None, "", " \n", "one", "é", "a<P>b", "x <M>", "<S", "日本<" + "語" * 50] + [_text(n) for n in (1, 2, 3, 40, 40, 300, 9000)]
ROWS = [(k, t, ["en", None, "de"][k % 3], "clash", 1.5) for k, t in enumerate(TEXTS)]
ROWS += [ROWS[12], (None, "no id the of", "en", "c", None), (99, TEXTS[14], "en", None, 0.0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, output string, score double").cache()


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fill_in_middle.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle(docs):
    """Each form, texts of one and of many runs, marks in texts; what is restored is the text."""
    more = docs.select("doc_id", "text", "output").union(docs.crossJoin(docs.sparkSession.range(12).withColumnRenamed("id", "k")).select(F.col("doc_id") * 100 + F.col("k"), "text", "output"))
    out = fill_in_middle.transform(more)
    got = _rows(out)
    assert got == sorted(((r.doc_id, *_fim(r.doc_id, r.text)) for r in more.collect()), key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    back = out.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("t"))
    assert _rows(back) == sorted(((r.doc_id, r.text or "") for r in more.collect()), key=str)
    assert fill_in_middle.transform(docs.limit(0)).count() == 0


def test_fill_in_middle_other_marks(docs):
    """Marks that are patterns elsewhere, and none or all rows plain."""
    marks = ("[(", "|)", "^.")
    out = fill_in_middle.transform(docs, seed=7, plain_from=100, spm_below=50, marks=marks)
    assert _rows(out.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form"), marks))) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    assert out.where("form = 'plain' and n > 0").isEmpty() and not out.where("form = 'spm'").isEmpty()
    assert fill_in_middle.transform(docs, plain_from=0).where("form <> 'plain'").isEmpty()


def test_runs():
    for text in ("", "abc", "éé日日ab😀", "日" * 9 + "a" * 9 + "é" * 9):
        runs = fill_in_middle.Runs(text.encode())
        assert runs.n == len(text) and [runs.offset(k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert len(fill_in_middle.Runs(("日" * 9 + "a" * 9).encode()).units) == 2


def _words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


class BruteForce:
    """The same model with dictionaries of tuples."""

    def __init__(self, texts, order):
        self.order, self.seen = order, Counter()
        grams = [Counter() for _ in range(order + 1)]
        for t in texts:
            words = [*_words(t), ""]
            self.seen.update(words)
            row = ["\n"] * (order - 1) + words
            for i in range(order - 1, len(row)):
                for k in range(1, order + 1):
                    grams[k][tuple(row[i - k + 1 : i + 1])] += 1
        self.a = [None] * (order + 1)
        self.a[order] = grams[order]
        for k in range(order - 1, 0, -1):
            left = Counter(g[1:] for g in grams[k + 1])
            self.a[k] = {g: grams[k][g] if k > 1 and g[0] == "\n" else left[g] for g in grams[k]}
        self.d = [None] + [self._discounts(Counter(a.values())) for a in self.a[1:]]
        self.after = [None] + [defaultdict(list) for _ in range(order)]
        for k in range(1, order + 1):
            for g, n in self.a[k].items():
                self.after[k][g[:-1]].append(n)

    @staticmethod
    def _discounts(n):
        if not min(n[1], n[2], n[3], n[4]):
            return [0, 0.5, 1, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0, *(k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3))]
        return [min(max(x, 0), k) for k, x in enumerate(d)] if min(d[1:]) > 0 else [0, 0.5, 1, 1.5]

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.seen) + 1)
        counts, d = self.after[k].get(gram[:-1], []), self.d[k]
        if not counts:
            return self.p(gram[1:])
        n = self.a[k].get(gram, 0)
        return (n - d[min(n, 3)] + sum(d[min(c, 3)] for c in counts) * self.p(gram[1:])) / sum(counts)

    def score(self, text):
        row = ["\n"] * (self.order - 1) + [*_words(text), ""]
        return sum(math.log10(self.p(tuple(row[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(row)))


@pytest.mark.parametrize(("order", "shard_bytes"), [(2, 1 << 20), (2, 3000), (3, 20000)])
def test_kneser_ney(docs, order, shard_bytes):
    """Equal to the model of tuples, in one shard and in many; unknown words, texts not learnt from, extra columns."""
    learnt = docs.where("doc_id is not null and doc_id % 2 = 0")
    model = kneser_ney.train(learnt, order, shard_bytes)
    brute = BruteForce([r.text for r in learnt.collect()], order)
    n, v = sum(brute.seen.values()), len(brute.seen)
    assert (model.tokens, model.vocabulary) == (n, v)
    for k in range(1, order + 1):
        assert list(model.discounts(k)) == pytest.approx(brute.d[k])
    got = kneser_ney.score(docs, model).collect()
    assert len(got) == len(ROWS)
    text = {(r[0], len(_words(r[1])) + 1): r[1] for r in ROWS}
    for r in got:
        words = [*_words(text[r.doc_id, r.n_tokens]), ""]
        assert (r.n_known, r.train_tokens) == (sum(w in brute.seen for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((brute.seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), abs=1e-9)
        assert r.score == pytest.approx(brute.score(text[r.doc_id, r.n_tokens]), rel=1e-9, abs=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    for context in (("\n",), ("the",), ("never",)):  # probabilities of all words and the unknown one add up
        assert sum(brute.p((*context, w)) for w in brute.seen) + brute.p((*context, "?")) == pytest.approx(1)


def test_kneser_ney_without_texts(docs):
    none = docs.limit(0)
    model = kneser_ney.train(none)
    rows = kneser_ney.score(docs, model).collect()
    assert model.tokens == 0 and all(r.score == r.base_score == r.n_known == 0 for r in rows) and len(rows) == len(ROWS)
    assert kneser_ney.score(none, model).count() == 0
    with pytest.raises(ValueError, match="two words"):
        kneser_ney.train(none, 1)


def test_kneser_ney_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op12_kneser_ney(spark, str(tmp_path)).collect()
    fold = {r[0]: r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in ROWS}
    assert {r.doc_id: r.held_out for r in rows} == fold and {r.train_tokens for r in rows} == {sum(len(_words(r[1])) + 1 for r in ROWS if not fold[r[0]])}


def _collocations(rows, longest, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {q[i : i + k] for q, b in found.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= 100 * found[q[i : i + k]]}
        best = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("longest", "least", "top", "block"), [(5, 2, 2000, 1 << 20), (5, 3, 25, 97), (3, 9, 2000, 1000), (2, 1, 50, 500)])
def test_collocations(docs, longest, least, top, block):
    """Equal to counting all phrases, with one block and with many, ties at the last rank, phrases inside others."""
    assert _rows(collocations.mine(docs, longest, least, top, block)) == _collocations(ROWS, longest, least, top)


def test_collocations_repeats_and_limits(spark):
    """Overlaps count, a phrase as frequent as one around it goes, nothing crosses a piece; empty tables and no frequent word."""
    rows = [(1, "a a a a b. b c\td c d", None), (1, "a a a a b. b c\td c d", None), (2, "New York, new york", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = _rows(collocations.mine(df, 5, 2, 10))
    assert got == _collocations(rows, 5, 2, 10) and ("en", 1, "new york", 2, 2, 2, 4, 2000) in got
    assert "york new" not in {r[2] for r in got} and "a a a a" not in {r[2] for r in got}
    assert collocations.mine(df.limit(0)).count() == 0 and collocations.mine(df, least=1000).count() == 0


def test_collocation_scores_are_exact(spark):
    """Products beyond 64 bits, quotients near whole numbers: the same integers as Python's."""
    for a, n, x, y in ((3_000_000_007, 9_000_000_000_037, 4_000_000_009, 5_000_000_021), (10**6, 10**12, 10**9, 10**9), (999, 10**12 - 1, 10**9 + 7, 999)):
        score = spark.sql(f"select cast(1000 * cast({a}L as decimal(38,0)) * cast({n}L as decimal(38,0)) as decimal(38,0)) div cast(cast({x}L as decimal(38,0)) * cast({y}L as decimal(38,0)) as decimal(38,0)) as s").first().s
        assert score == 1000 * a * n // (x * y)


def test_hash_arrays(tmp_path):
    """Ranges of keys, numbers of every width, keys that are absent, shards that are absent."""
    rng = np.random.default_rng(5)
    cols = [rng.integers(0, 1 << 64, 5000, np.uint64)[rng.integers(0, 300, 5000)] for _ in range(2)]
    key, distinct, counts = hash_arrays.merged(cols, [np.ones(5000, np.int64), rng.integers(0, 1 << 40, 5000)])
    assert (np.diff(key.astype(object)) > 0).all() and counts[0].sum() == 5000
    for buckets in (1, 7, 64):
        rows = list(hash_arrays.packs(key, distinct, counts, buckets))
        back, sums = hash_arrays.unpacked(rows, 2)
        assert all((x == y).all() for x, y in zip([*back, *sums], [*distinct, *counts], strict=True))
        assert [r["bucket"] for r in rows] == sorted({(int(k) >> 32) * buckets >> 32 for k in key})
    at = hash_arrays.bounds(key, 7)
    for b in (0, 2, 6):
        part = slice(at[b], at[b + 1])
        hash_arrays.save(f"file://{tmp_path}/m", f"x-{b}", {"key": key[part], "n": hash_arrays.smallest(counts[1][part])})
    asked = np.sort(np.concatenate([key, rng.integers(0, 1 << 64, 100, np.uint64)]))
    there, out = hash_arrays.HashArrays(f"{tmp_path}/m", "x", 7).find(asked, ("n",))
    stored = {int(k): int(n) for b in (0, 2, 6) for k, n in zip(key[at[b] : at[b + 1]], counts[1][at[b] : at[b + 1]], strict=True)}
    assert there.tolist() == [int(k) in stored for k in asked] and out["n"].tolist() == [stored.get(int(k), 0) for k in asked]
    assert not hash_arrays.HashArrays(f"{tmp_path}/none", "x", 7).find(asked)[0].any()
