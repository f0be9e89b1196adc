"""Token counts with the whole-token shortcut: strings proven to be one token are counted, only the rest is merged."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe, slices, tokenizer_path


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of ``docs``.

    A null text counts as empty: 0 bytes and 0 tokens. Whole texts are counted, however long; special strings inside
    texts count as the library has them by default. Other columns are not read; an empty table gives no rows.
    ``path``: the tokenizer's file, which each executor opens.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path or tokenizer_path("byte_bpe_50k.json"))
        for b in batches:
            n = [k for part in slices(b["text"].to_pylist()) for k in bpe.counts([t or "" for t in part])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
