"""Vectors of any length in norm, keys with any quotes, integers by value, repeated rows over several groups."""

import json

import numpy as np
from pyspark.sql import functions as F

from fundlake.llm import chat_format, embedding_dedup, packing


def test_norms_of_any_size(spark):
    """Vectors whose squares a double can't hold link as others do, and spoil nothing for the rest of the table."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    rows, k = [], 0
    for b in base:
        for factor in (1.0, 1e-200, 1e200, 3e-308, 1e300):
            rows.append((k, (b * factor).tolist(), "a"))
            k += 1
    rows += [(k, [1e-200, 1e-200], "a"), (k + 1, [1.0, 1.0], "a"), (k + 2, [5e-324, 0.0], "a"), (k + 3, [2.0, 0.0], "a"), (k + 4, [0.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    want = {5 * i + j: (4, 5 * i) for i in range(6) for j in range(5)}
    assert got == want | {k: (1, k), k + 1: (1, k), k + 2: (1, k + 2), k + 3: (1, k + 2), k + 4: (0, k + 4)}


def test_scaling_is_exact():
    x = np.array([[3.0, -7.0, 1e-3], [1e-310, 2e-310, 0.0]])
    y = embedding_dedup.scaled(x)
    assert (np.abs(y).max(1) < 1).all() and (np.abs(y).max(1) >= 0.5).all() and (y[0] * 8 == x[0]).all()


def test_keys_and_integers(spark):
    """Apostrophes, quotes, both and dots in keys; whole numbers however written."""
    keys = ["it's", 'a"b', "a'b\"c", "a.b", "$['x']", "n"]
    schema = {"t": {"properties": {k: {"type": "integer"} for k in keys}, "required": keys}}
    good = {k: 1 for k in keys}
    texts = [json.dumps(good), json.dumps(good)[:-2] + "1e3}", json.dumps(good)[:-2] + "1.0}", json.dumps(good)[:-2] + "1" * 41 + "}", json.dumps(good)[:-2] + "1.5}", json.dumps(good | {"it's": "x"}), json.dumps({k: 1 for k in keys[1:]}), json.dumps({k: 1 for k in keys if k != keys[2]})]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, a string")
    got = {r.i: list(r.p) for r in df.select("i", chat_format.problems(F.col("a"), F.lit("t"), schema).alias("p")).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [], 4: ["n is no integer"], 5: ["it's is no integer"], 6: ["it's is missing"], 7: [keys[2] + " is missing"]}


def test_equal_rows_are_packed_in_several_groups(spark):
    """A load repeated thousands of times doesn't end in one group; every row is packed once, gapless."""
    df = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same words again and again").alias("text"))
    rows = packing.pack(df, 64, group_rows=400).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.sequence_id >> 32, []).append(r)
    assert len(rows) == 4000 and len(groups) == 10 and max(map(len, groups.values())) < 600
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(v)] == np.r_[0, np.cumsum([n for _, n in sorted(v)])[:-1]].tolist() and sum(n for _, n in v) <= 64 for v in held.values())
