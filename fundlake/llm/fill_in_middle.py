"""Fill-in-the-middle: texts cut twice and put in another order, with cuts found in runs of equally wide characters.

A text is kept as maximal runs of one character class, the number of bytes of a code point in UTF-8, with the counts of units
(code points) and bytes before each run. The run that holds a cut is found by binary search; its place in bytes follows by
arithmetic, so that no list of all characters is kept and a text of one class has a single run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import slices

MARKS = ("<P>", "<S>", "<M>")
#: Bytes of the character that a byte begins; 0 within one.
_WIDTH = np.array([1] * 0x80 + [0] * 0x40 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10, np.uint8)


class Runs:
    """The runs of a text in UTF-8: ``units`` and ``bytes`` before each, its ``width``; ``n`` units in all."""

    def __init__(self, text: bytes) -> None:
        if text.isascii():
            self.units, self.bytes, self.width, self.n = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64), len(text)
            return
        widths = _WIDTH[np.frombuffer(text, np.uint8)]
        widths = widths[widths > 0]
        self.n = len(widths)
        self.units = np.concatenate([[0], np.flatnonzero(widths[1:] != widths[:-1]) + 1])
        self.width = widths[self.units].astype(np.int64)
        length = np.diff(np.append(self.units, self.n))
        self.bytes = np.concatenate([[0], np.cumsum(length * self.width)[:-1]])

    def offset(self, cut: int) -> int:
        """The place in bytes after ``cut`` units."""
        run = int(np.searchsorted(self.units, cut, side="right")) - 1
        return int(self.bytes[run] + (cut - self.units[run]) * self.width[run])


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the sha256 of ``seed:id``; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row for each row of ``docs``.

    A text of n units is cut after h1 and h2 of them, h modulo n + 1, the smaller first. It stays plain if it is empty (null texts
    are) or holds a mark, or where h3 % 100 >= ``plain_from``; else h4 % 100 < ``spm_below`` gives marked suffix, prefix, middle
    and the rest marked prefix, suffix, middle. Equal rows have equal results, whole texts are used however long, columns besides
    doc_id and text aren't read, and an empty table has no rows.
    """
    p, s, m = (x.encode() for x in marks)

    def one(text: bytes, h: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
        runs = Runs(text)
        if not text or any(x in text for x in (p, s, m)) or h[2] % 100 >= plain_from:
            return runs.n, "plain", None, None, text
        low, high = sorted((h[0] % (runs.n + 1), h[1] % (runs.n + 1)))
        a, b = runs.offset(low), runs.offset(high)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h[3] % 100 < spm_below:
            return runs.n, "spm", low, high - low, b"".join((s, suffix, p, prefix, m, middle))
        return runs.n, "psm", low, high - low, b"".join((p, prefix, s, suffix, m, middle))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(list(range(batch.num_rows))):
                part = batch.slice(rows[0], len(rows))
                drawn = zip(*(part[f"h{k}"].to_pylist() for k in range(4)), strict=True)
                n, form, low, middle, out = zip(*(one(t, h) for t, h in zip(part["text"].to_pylist(), drawn, strict=True)), strict=True)
                columns = [part["doc_id"], pa.array(n, pa.int64()), pa.array(form), pa.array(low, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed))))
    out = rows.mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that transform() made ``output`` of: no cut text holds a mark, so that the marks of the output part it."""

    def joined(parts: Column) -> Column:
        first, second, middle = (F.get(parts, k) for k in (1, 2, 3))
        return F.when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))

    parts = F.split(output, "|".join(map(re.escape, marks)), -1)
    return F.when(form == "plain", output).otherwise(F.transform(F.array(parts), joined)[0])
