"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the text's bytes picks places between words; equal passages are so cut alike wherever they stand. A chunk
that a worker has seen is not encoded again. Where a run without white space has to be cut, the join is repaired: text around
it is re-encoded and the cut moves on until the parts agree exactly with the whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import slices, tokenizer_path

#: Bytes that the rolling hash sees; a place between words is a cut when the hash's low bits are 0.
WINDOW, BITS = 24, 6
#: Runs without white space longer than this are cut inside.
LONG = 20_000
#: What a worker remembers before it forgets: chunks and words.
CHUNKS, WORDS = 60_000, 400_000
#: Characters that the splitting of str knows as white space and the tokenizer does not (fixed values).
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

_ENDS = frozenset(",.!?;:")

Part = tuple[int, str, str]


def cuts(raw: bytes) -> list[int]:
    """The places of ``raw`` (UTF-8) at which a chunk ends: spaces or new lines before which the rolling hash hits."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) <= WINDOW:
        return []
    mixed = (b.astype(np.uint64) + np.uint64(1)) * _BASE
    mixed ^= mixed >> np.uint64(29)
    # sum over the window of mixed[i] * BASE**(position in the window), by Horner's rule on strides of powers of two
    h, step, power = mixed, 1, int(_BASE)
    while 2 * step <= WINDOW:
        h = h[:-step] * np.uint64(power) + h[step:]
        step, power = 2 * step, power * power % 2**64
    at = np.flatnonzero((b[step:] == 32) | (b[step:] == 10))
    hit = (h[at] * _BASE >> np.uint64(40)) & np.uint64((1 << BITS) - 1)
    return (at[hit == 0] + step).tolist()


class ReusingEncoder:
    """Encodes as the tokenizers library does with the file at ``path`` (a vocabulary that drops white space)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.token = {i: t for t, i in vocab.items()}
        self.final = frozenset(i for t, i in vocab.items() if t.endswith("</w>"))
        self.mark = {m: self._part(self.whole(m)) for m in _ENDS}
        self.words: dict[str, Part] = {}
        self.chunks: dict[bytes, Part] = {}
        self.reused = self.encoded = 0

    def _part(self, ids: list[int]) -> Part:
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.token.__getitem__, ids))

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def agrees(self, left: str, right: str, reach: int = 64) -> bool:
        """True if encoding across the join gives the ids of both sides, on wider and wider windows up to both wholes."""
        while True:
            a, b = left[-reach:], right[:reach]
            if self.whole(a + b) == self.whole(a) + self.whole(b):
                return True  # a narrow window agrees; a wider one only adds text that the pattern splits off before
            if reach >= max(len(left), len(right)):
                return False
            reach *= 4

    def run(self, text: str) -> list[int]:
        """The ids of a long run without white space: cut between a letter and another character, then repaired."""
        ids: list[int] = []
        begin, at = 0, LONG
        while at < len(text):
            a, b = text[at - 1], text[at]
            special = any(text.find(s, max(0, at - len(s)), at + len(s)) >= 0 for s in ("<|startoftext|>", "<|endoftext|>"))
            if a.isascii() and b.isascii() and a.isalpha() and not b.isalpha() and b != "'" and not special and self.agrees(text[begin:at], text[at : at + LONG]):
                ids += self.whole(text[begin:at])
                begin, at = at, at + LONG
            else:
                at += 1
        return ids + self.whole(text[begin:])

    def _chunks(self, new: set[bytes]) -> None:
        """Encodes chunks that the worker doesn't know: first their new words together, then each from its words."""
        words = {k: k.decode("utf-8").split() for k in new}
        known = self.words
        if len(known) >= WORDS:
            known.clear()
        if todo := set().union(*words.values()).difference(known):
            self._learn(todo)
        for k, ws in words.items():
            parts = [x for x in map(known.__getitem__, ws) if x[0]]
            n, ids, tokens = zip(*parts, strict=True) if parts else ((), (), ())
            self.chunks[k] = sum(n), " ".join(ids), " ".join(tokens)

    def _learn(self, new: set[str]) -> None:
        """Encodes words that the worker doesn't know. Letters, with a mark behind them at most, go in one call."""
        known, marked, rest = self.words, [], []
        letters: set[str] = set()
        for w in new:
            core = w[:-1] if w[-1] in _ENDS else w
            if len(w) > LONG:
                known[w] = self._part(self.run(w))
            elif core.isalpha() and core[-1].lower().isalpha():
                if core not in known:
                    letters.add(core)
                if core is not w:
                    marked.append(w)
            else:
                rest.append(w)
        alone = list(letters)
        ids = self.library.encode_batch_fast([" ".join(alone)], add_special_tokens=False)[0].ids if alone else []
        ends = [k + 1 for k, i in enumerate(ids) if i in self.final]
        if len(ends) == len(alone):  # as many pre-tokens as words, so each word is one
            known.update((w, self._part(ids[a:b])) for w, a, b in zip(alone, [0, *ends], ends, strict=False))
        else:
            rest += alone
        for w, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False) if rest else (), strict=True):
            known[w] = self._part(e.ids)
        for w in marked:
            (n, a, b), (k, c, d) = known[w[:-1]], self.mark[w[-1]]
            known[w] = n + k, f"{a} {c}", f"{b} {d}"

    def encode(self, texts: list[str]) -> list[Part]:
        """For each text the number of ids, the decimal ids joined by a space, and the decoded text."""
        if len(self.chunks) >= CHUNKS:
            self.chunks.clear()
        keys: list[list[bytes] | None] = []
        new: set[bytes] = set()
        for t in texts:
            if any(c in t for c in _ODD):
                keys.append(None)
                continue
            raw = t.encode("utf-8")
            ends = cuts(raw)
            keys.append([raw[a:b] for a, b in zip([0, *ends], [*ends, len(raw)], strict=True)])
            new.update(k for k in keys[-1] if k not in self.chunks)
        self.encoded += len(new)
        self.reused += sum(map(len, filter(None, keys))) - len(new)
        self._chunks(new)
        out = []
        for t, ks in zip(texts, keys, strict=True):
            if ks is None:
                out.append(self._part(self.whole(t)))
                continue
            parts = [x for x in map(self.chunks.__getitem__, ks) if x[0]]
            n, ids, tokens = zip(*parts, strict=True) if parts else ((), (), ())
            out.append((sum(n), " ".join(ids), " ".join(tokens)))
        return out


@lru_cache(1)
def reusing_encoder(path: str) -> ReusingEncoder:
    """One encoder for each worker."""
    return ReusingEncoder(path)


def encode_documents(docs: DataFrame, path: str | None = None, texts: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), or with texts=False their digests (ids_sha256, decoded_sha256) in place of the texts.

    ``ids``: the decimal ids joined by one space. A null text is encoded like an empty one: no ids, empty strings. One row
    for each row of ``docs``, repeated ones too; other columns are not read.
    """
    names = ("ids", "decoded") if texts else ("ids_sha256", "decoded_sha256")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = reusing_encoder(path or tokenizer_path("word_bpe_49k.json"))
        for b in batches:
            for k, part in enumerate(slices(b["text"].to_pylist())):
                out = enc.encode([t or "" for t in part])
                if not texts:
                    out = [(n, *(hashlib.sha256(x.encode("utf-8")).hexdigest() for x in rest)) for n, *rest in out]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(512 * k, len(part)), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])], ["doc_id", "n_tokens", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encoded, f"doc_id {kind}, n_tokens long, {names[0]} string, {names[1]} string")
