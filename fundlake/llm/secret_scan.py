"""Secret scans: patterns, and character Markov models of random strings and ordinary identifiers.

DataFrame functions only. Places come from splitting a text at a pattern's matches and adding up lengths. The models are
tables of transitions between characters, counted in Spark over samples that the patterns label: what they match is random,
other identifiers are ordinary. A candidate's score is its mean log-likelihood ratio.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Kind -> (pattern, group that has to be long enough, its least length), in the order of ties (fixed values). A run of access
#: or hex that is long enough is found whole, and one that isn't hides no other, so their least length is in the pattern.
BASE = {
    "assign": (r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: A cheap pattern that is found where a kind's may match with the least length.
_HINT = {"assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Characters of candidates; any other counts as one more state.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
_STATES = len(ALPHABET) + 1
SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"


def _spans(text: Column, pattern: str, group: int, kind: str) -> Column:
    """The leftmost, non-overlapping matches of ``pattern`` with their places in code points, and the group's text."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    items = F.arrays_zip(parts.alias("skip"), whole.alias("whole"), value.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["skip"]
        end = begin + F.coalesce(F.char_length(x["whole"]), F.lit(0))
        one = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["whole"].isNull(), a["found"]).otherwise(F.concat(a["found"], F.array(one))).alias("found"))

    return F.aggregate(items, start, step, lambda a: a["found"])


def base_spans(text: Column) -> Column:
    """Spans (start, end, kind, value) of all base kinds by start, then kind in the order of BASE."""
    found = []
    for kind, (pattern, group, least) in BASE.items():
        hits = _long(_spans(text, pattern, group, kind), least)
        found.append(F.when(text.rlike(_HINT[kind]), hits).otherwise(F.array().cast(SPAN)))
    return _sorted(F.concat(*found))


def _long(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda x: F.char_length(x["value"]) >= least)


def _sorted(spans: Column) -> Column:
    """By start, then in the order assign, access, hex, markov."""
    rank = F.transform(spans, lambda x: F.struct(x["start"].alias("a"), F.array_position(F.array(*map(F.lit, (*BASE, "markov"))), x["kind"]).alias("b"), x.alias("x")))
    return F.transform(F.array_sort(rank), lambda x: x["x"])


def _pairs(value: Column) -> Column:
    """The transitions of a string as numbers, the one from the start state (0) into its first character included."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    codes = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c))
    return let(codes, lambda s: F.transform(s, lambda x, i: F.coalesce(F.get(s, i - 1), F.lit(0)) * _STATES + x))


def train(docs: DataFrame, max_docs: int = 20_000, alpha: float = 0.5) -> list[float]:
    """The log-likelihood ratio (random over ordinary) of each transition, row by row.

    Labelled samples come from about ``max_docs`` documents, chosen by a hash of the text: what the base patterns match is
    random; in a tenth of them, other identifiers of six characters or more are ordinary. Counts are smoothed by ``alpha``, so that without
    matches the random model is the uniform one. The table has a fixed size, whatever the input.
    """
    n = docs.count()
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    if n > max_docs:
        rows = rows.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 20)) < int(max_docs / n * (1 << 20)))
    secret = rows.select(F.explode(base_spans(F.col("text"))).alias("x")).select(F.lit(1).alias("y"), F.col("x.value").alias("v"))
    plain = rows.where(~F.greatest(*(F.col("text").rlike(h) for h in _HINT.values())))
    if n * 10 > max_docs:
        plain = plain.where(F.pmod(F.xxhash64("text", F.lit(12)), F.lit(1 << 20)) < int(max_docs / 10 / min(n, max_docs) * (1 << 20)))
    words = plain.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))).alias("v")).select(F.lit(0).alias("y"), "v")
    counts = secret.union(words).select("y", F.explode(_pairs(F.col("v"))).alias("pair")).groupBy("y", "pair").count().collect()
    table = [[alpha / 8] * _STATES**2, [alpha / 8] * _STATES**2]
    for y, pair, k in counts:
        table[y][pair] += k
    # a transition's share of its row; rows that were hardly seen lean to the uniform
    share = [[(t[i * _STATES + j] + alpha) / (sum(t[i * _STATES : (i + 1) * _STATES]) + alpha * _STATES) for i in range(_STATES) for j in range(_STATES)] for t in table]
    return [math.log(r / o) for r, o in zip(share[1], share[0], strict=True)]


def scan(docs: DataFrame, *keep: str, table: list[float] | None = None, least: float = 0.8, name: str = "spans") -> DataFrame:
    """``keep`` and as column ``name`` the spans (start, end, kind, value), one row for each row of ``docs``; places in code points of the text.

    All base spans, and as kind markov each candidate of 16 characters or more with a digit and a letter that overlaps none
    and whose mean log-likelihood ratio is ``least`` or more. Null texts are empty and have none. Repeated rows are scanned
    alike. ``table``: from train(), which is called if it isn't given.
    """
    table = table if table is not None else train(docs)
    llr = F.split(F.lit(",".join(f"{x:.6g}" for x in table)), ",").cast("array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))

    def random(value: Column) -> Column:
        total = F.aggregate(_pairs(value), F.lit(0.0), lambda a, p: a + F.get(llr, p))
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (total / F.char_length(value) >= least)

    rows = docs.select(F.struct(*keep).alias("row"), text.alias("text"))  # nested, so that no name of ``keep`` clashes
    likely = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}"), F.lit(0))
    found = rows.select("*", base_spans(F.col("text")).alias("base"), F.exists(likely, random).alias("some"))
    more = F.filter(_spans(F.col("text"), CANDIDATE, 0, "markov"), lambda x: random(x["value"]))
    apart = F.filter(more, lambda x: ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    spans = F.when(F.col("some"), _sorted(F.concat("base", apart))).otherwise(F.col("base"))
    return found.select("row", spans.alias("found")).select(*(F.col("row").getField(c).alias(c) for c in keep), F.col("found").alias(name))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each span, or each union of overlapping ones, in place of ``mark``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, x["start"] - a["at"])
        fresh = x["start"] >= a["at"]
        return F.struct(F.when(fresh, F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"]).alias("out"), F.greatest(a["at"], x["end"]).alias("at"))

    rest = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.lit(2**31 - 1))))
    return F.when(F.size(spans) == 0, text).otherwise(rest)


def summary(found: DataFrame) -> DataFrame:
    """The digest columns of a scan: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), n("markov"))
