"""Quality rules: a learnt decision list over word statistics, as ordered Spark conditional expressions.

Statistics are DataFrame functions only. Sequential covering on a bounded sample of labelled statistics grows conjunctions of
thresholds, prunes each on rows apart, and emits ``when(rule, False)`` in the order found, ``True`` for the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, let

#: Statistics that conditions may use; all are columns of ``statistics``.
RULE_COLUMNS = ("mean_word", "symbol_share", "upper_share", "digit_share", "bang_share", "pipe_share", "stop_share", "dup_line_share", "repeat_share", "distinct_share", "words_per_line")
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def _count(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _repeated(words: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more.

    Windows are compared by 64-bit hashes within one text, sorted with their places; the union of the windows' words is then
    one pass over the sorted places: each adds as many words as it lies beyond the one before, three at most.
    """
    places = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(pairs, lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])))
        # get() gives null outside the array, and a filter drops what is neither true nor false
        at = F.array_sort(F.transform(again, lambda x: x["i"]))
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        return F.aggregate(at, zero, step, lambda a: a["n"])

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(words) < 3, 0).otherwise(counted)


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and RULE_COLUMNS for one text; null is empty.

    One expression, each part of which is computed once, also where a filter on it moves below other steps.
    """

    def counted(t: Column) -> Column:
        inner = F.btrim(t, F.lit(_SPACES))
        words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, _SPACES, "") != "")
        in_lines = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("dup"), F.size(x).alias("all")))
        in_words = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("again"), F.size(F.array_distinct(w)).alias("distinct")))
        kinds = (("symbols", _SYMBOLS), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("bang", "!"), ("pipe", "|"), ("stop", ".?"))
        return F.struct(in_words.alias("w"), in_lines.alias("l"), F.char_length(F.translate(t, _SPACES, "")).alias("chars"), *(_count(t, c).alias(k) for k, c in kinds))

    def shares(m: Column) -> Column:
        over = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y), F.lit(0.0))
        w, lines = m["w"], m["l"]
        return F.struct(
            w["n"].cast("long").alias("n_words"), m["chars"].cast("long").alias("word_chars"), m["symbols"].cast("long").alias("n_symbols"),
            lines["dup"].cast("long").alias("n_dup_lines"), w["again"].cast("long").alias("n_repeat_words"),
            over(m["chars"], w["n"]).alias("mean_word"), *(over(m[k], m["chars"]).alias(f"{n}_share") for k, n in (("symbols", "symbol"), ("upper", "upper"), ("digit", "digit"), ("bang", "bang"), ("pipe", "pipe"))),
            over(m["stop"], w["n"]).alias("stop_share"), over(lines["dup"], lines["all"]).alias("dup_line_share"), over(w["again"], w["n"]).alias("repeat_share"),
            over(w["distinct"], w["n"]).alias("distinct_share"), over(w["n"], lines["all"]).alias("words_per_line"),
        )

    return let(let(F.coalesce(text, F.lit("")), counted), shares)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (column, True for > or False for <=, threshold); a row that meets it is rejected."""

    terms: tuple[tuple[str, bool, float], ...]

    def matches(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for column, above, cut in self.terms:
            out &= (x[column] > cut) == above
        return out

    def column(self, m: Column) -> Column:
        """The rule over the struct of measures."""
        out = F.lit(True)
        for column, above, cut in self.terms:
            out &= m[column] > cut if above else m[column] <= cut
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c} {'>' if above else '<='} {cut:.6g}" for c, above, cut in self.terms)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, least: int = 8, max_terms: int = 4, max_rules: int = 24, cuts: int = 40) -> list[Rule]:
    """Rules for rejecting rows, in the order found, by sequential covering.

    Two thirds of the rows that no rule has met grow a conjunction by information gain, the others prune its last terms. A rule
    counts if it meets ``least`` bad rows and ``precision`` of all rows that it meets, those apart included, are bad.
    """
    rules: list[Rule] = []
    n = len(bad)
    grow = np.arange(n) % 3 != 2
    left = np.ones(n, bool)
    edges = {c: np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1))[:-1]) for c, v in x.items()} if n else {}
    for c, v in x.items():
        if n and bad.any():
            edges[c] = np.unique(np.concatenate([edges[c], np.quantile(v[bad], np.linspace(0, 1, cuts + 1))]))
    while len(rules) < max_rules and (left & bad & grow).sum() >= least:
        terms: list[tuple[str, bool, float]] = []
        met = left & grow
        while len(terms) < max_terms and (met & ~bad).any():
            p0, n0 = (met & bad).sum(), (met & ~bad).sum()
            best, gained = None, 1e-9
            for c, v in x.items():
                at = np.searchsorted(edges[c], v[met], side="left")  # v <= edges[k] for at <= k
                pos = np.bincount(at, bad[met], len(edges[c]) + 1).cumsum()[:-1]
                neg = np.bincount(at, ~bad[met], len(edges[c]) + 1).cumsum()[:-1]
                for above, p, q in ((False, pos, neg), (True, p0 - pos, n0 - neg)):
                    gain = p * (np.log2((p + 1e-9) / (p + q + 1e-9) + 1e-12) - np.log2(p0 / (p0 + n0)))
                    k = int(gain.argmax())
                    if p[k] >= least and gain[k] > gained:
                        best, gained = (c, above, float(edges[c][k])), gain[k]
            if best is None:
                break
            terms.append(best)
            met = met & Rule((best,)).matches(x)
        apart = left & ~grow

        def worth(rule: Rule, rows: np.ndarray = apart) -> float:
            m = rule.matches(x) & rows
            return (m & bad).sum() / m.sum() if m.any() else 0.0

        options = [Rule(tuple(terms[:k])) for k in range(len(terms), 0, -1)]
        if not options:
            break
        rule = max(options, key=worth)
        m = rule.matches(x) & left
        if (m & bad).sum() < least or (m & bad).sum() < precision * m.sum():
            rule = options[0]
            m = rule.matches(x) & left
            if (m & bad).sum() < least or (m & bad).sum() < precision * m.sum():
                break
        rules.append(rule)
        left &= ~m
    return rules


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4_000) -> list[Rule]:
    """Rules from the statistics of about ``max_rows`` labelled rows at most, none of the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", max_rows).select("doc_id", "y", measures(F.col("text")).alias("m"))
    rows = sorted((r for r in sample.collect() if r.m.n_words), key=lambda r: (r.doc_id, r.y, *r.m))
    return learn({c: np.array([r.m[c] for r in rows], float) for c in RULE_COLUMNS}, np.array([r.y == 0 for r in rows], bool))


def verdict(text: Column, rules: list[Rule]) -> Column:
    """The struct of measures with base_failed, the number of the first rule met (0: none) and kept."""

    def judged(m: Column) -> Column:
        met = F.lit(0)
        for k, rule in reversed(list(enumerate(rules, 1))):
            met = F.when(rule.column(m), k).otherwise(met)
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        base = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return F.struct(*base, failed.alias("base_failed"), met.alias("rule"), (~failed & (met == 0)).alias("kept"))

    return let(measures(text), judged)


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = 4_000) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept), one row for each row.

    Null texts have no words and so fail the base; repeated rows are judged alike; no labels: no rules, the base alone. Only
    doc_id and text are read.
    """
    return docs.select("doc_id", verdict(F.col("text"), train(docs, labels, max_rows)).alias("v")).select("doc_id", "v.*")


def keep(docs: DataFrame, labels: DataFrame, max_rows: int = 4_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that judge() keeps."""
    return docs.where(verdict(F.col("text"), train(docs, labels, max_rows))["kept"])
