"""Counts of shingles over all texts, and ranges of cells of which none counts often."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fundlake.llm import collocations, jaccard_join
from fundlake.llm.hash_arrays import HashArrays, cells


def test_frequencies(spark):
    """Each shingle counts once for each distinct text that has it; those of fewer texts aren't kept; ranges of any number."""
    common = " ".join(f"c{k}" for k in range(30))
    texts = [None, "", " "] + [f"{common} " + " ".join(f"t{k % 9}.{j}" for j in range(40)) for k in range(20)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    want = Counter(h for t in set(texts) for h in jaccard_join.shingles(t).tolist())
    keys = np.array(sorted(want), np.uint64)
    for shard in (1 << 24, 500):
        folder, shards = jaccard_join.frequencies(df, least=3, shard=shard)
        assert (shards > 5) == (shard == 500)
        cell, place = np.unique(cells(keys, shards), return_inverse=True)
        got = HashArrays(folder, "often", shards).find(cell, ("n",))[1]["n"][place].tolist()
        assert got == [want[k] if want[k] >= 3 else 0 for k in keys.tolist()]
    folder, shards = jaccard_join.frequencies(df.limit(0))
    assert shards == 1 and not HashArrays(folder, "often", shards).find(cells(keys, 1))[0].any()


def test_no_phrase_counts_often(spark):
    """Words are frequent, but no range has a phrase that is."""
    pairs = [("a", "c"), ("b", "c"), ("c", "b"), ("b", "a"), ("c", "a")]
    rows = [(0, "a b a. c a b", "en")] + [(k, f"{x} {y}", "en") for k, (x, y) in enumerate(pairs, 1)]
    assert collocations.mine(spark.createDataFrame(rows, "doc_id long, text string, lang string"), least=4).count() == 0


def test_blocks_in_files(spark):
    """No file holds more than a few blocks, whatever a task has; phrases start from no rows of Python's, which take workers of their own."""
    docs = spark.createDataFrame([(k, "a b c d e f g h", "en") for k in range(100)], "doc_id long, text string, lang string").coalesce(1).cache()
    lists = collocations.blocks(docs, 10)
    files = [r["count"] for r in lists.groupBy(F.input_file_name()).count().collect()]
    assert sum(files) > 3 * collocations.PER_FILE and max(files) <= collocations.PER_FILE
    phrases = collocations.frequent_phrases(docs)[1]
    assert phrases.count() == phrases.where("f = 100").count() == 22
    assert "ExistingRDD" not in phrases._jdf.queryExecution().toString()
