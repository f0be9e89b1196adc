"""Byte-level BPE inside tasks: whole-token shortcuts, and units of text that are encoded once for a worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np

#: The splitting pattern of the byte-level pre-tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units that a worker remembers before it forgets them all.
KEPT = 500_000
_ENDS = frozenset(",.!?;:")
#: What the pattern knows as white space, but spaces and new lines (fixed values).
_OTHER = "\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space, single characters of it but spaces and new lines, and those at an end of a text.
_RUNS = re.compile(f"([ \n{_OTHER}]{{2,}}|[{_OTHER}]|^[ \n]|[ \n]\\Z)")
#: Characters that the splitting of str knows as white space and the pattern does not (fixed values).
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


class ByteBpe:
    """Encodes as the tokenizers library does with the file at ``path`` and add_special_tokens=False.

    No pre-token crosses the place before a single space or new line between other characters, so a text is cut
    there. A run of white space is a pre-token up to its last character, which, if it is a space, leads the next one;
    at the end of a text all of it is one. Each unit of a batch that the worker doesn't know yet is encoded once, all
    in one call. Texts that hold a special string are encoded by the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        chars = byte_chars()
        ranks = {bytes(chars[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.encode = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.newline = ranks[b"\n"]
        self.ranks = ranks
        self._ids: dict[str, bytes] = {"\n": np.array([self.newline], np.uint32).tobytes()}
        self._counts: dict[str, int] = {"\n": 1}

    @cached_property
    def whole(self) -> frozenset[str]:
        """The vocabulary strings proven to be one token when encoded alone: the library must give their ids for each."""
        texts = [(raw.decode("utf-8"), i) for raw, i in self.ranks.items() if raw.decode("utf-8", "ignore").encode() == raw]
        found = self.library.encode_batch_fast([s for s, _ in texts], add_special_tokens=False)
        return frozenset(s for (s, i), e in zip(texts, found, strict=True) if e.ids == [i])

    def _units(self, texts: list[str]) -> list[list[str] | list[int] | tuple]:
        """For each text its units, each after one space or beginning with a new line, or its ids in an int list, or a tuple
        of such lists of units and of ids."""
        out: list = []
        for t in texts:
            if any(s in t for s in self.special):
                out.append(self.library.encode(t, add_special_tokens=False).ids)
            elif t and " ".join(t.split()) == t.replace("\n", " "):  # single spaces and new lines only, none at an end
                out.append(_cut(t))
            elif any(c in t for c in _ODD):
                out.append(self.encode(t))
            else:
                out.append(tuple(self._stretches(t)))
        return out

    def _stretches(self, t: str) -> Iterator[list[str] | list[int]]:
        """Units of the stretches between runs of white space, and ids of the runs."""
        at, parts = 0, _RUNS.split(t)
        for stretch, run in zip(parts[::2], [*parts[1::2], None], strict=True):
            lead, at = t[at - 1 : at] if at and t[at - 1] in " \n" else "", at + len(stretch) + len(run or "")
            if stretch:
                yield _cut(lead + stretch)
            if run:
                led = run[-1] in " \n" and at < len(t)
                inner = run[:-1] if at < len(t) else run
                if inner:
                    yield self.encode(inner)
                if at < len(t) and not led:
                    yield self.encode(run[-1])

    def _merged(self, units: list[str]) -> list[bytes]:
        """The ids of each unit; all are encoded in one call, each behind a new line, which is a token of its own."""
        ids = np.array(self.encode("".join(u if u[0] == "\n" else "\n " + u for u in units)), np.uint32)
        at = np.flatnonzero(ids == self.newline)
        raw, starts, ends = ids.tobytes(), at.tolist(), [*at[1:].tolist(), len(ids)]
        return [raw[4 * (a + (u[0] != "\n")) : 4 * b] for u, a, b in zip(units, starts, ends, strict=True)]

    @staticmethod
    def _pending(units: list, known: dict) -> list[str]:
        if len(known) >= KEPT:
            kept = known["\n"]
            known.clear()
            known["\n"] = kept
        new = set()
        for x in units:
            for part in x if isinstance(x, tuple) else (x,):
                if part and isinstance(part[0], str):
                    new.update(part)
        new.discard("\n")  # alone only behind white space; it would form a run with the next unit
        return list(new.difference(known))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        units, out, known = self._units(texts), [], self._ids
        # a mark after letters is a pre-token of its own: the letters are looked up alone
        pending = self._pending(units, known)
        cut = [u for u in pending if u[-1] in _ENDS and u[:-1].isalpha()]
        plain = set(pending).difference(cut)
        plain.update(x for x in (u[:-1] for u in cut) if x not in known)
        if plain:
            plain = list(plain)
            known.update(zip(plain, self._merged(plain), strict=True))
        marks = {m: np.array(self.encode(m), np.uint32).tobytes() for m in _ENDS} if cut else {}
        known.update((u, known[u[:-1]] + marks[u[-1]]) for u in cut)
        def raw(x: list) -> bytes:
            return b"".join(map(known.__getitem__, x))[4:] if x and isinstance(x[0], str) else np.array(x, np.uint32).tobytes()

        for x in units:
            out.append(b"".join(map(raw, x)) if isinstance(x, tuple) else raw(x))
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text. Pre-tokens in ``whole`` count one each, only the rest is merged."""
        units, known, whole, rest = self._units(texts), self._counts, self.whole, []
        for u in self._pending(units, known):
            lead = u[0] == "\n"
            head, mark = (u, 0) if u[-1] not in _ENDS else (u[:-1], 1)
            word = head[1:] if lead else head
            if word.isalpha() and (word if lead else " " + word) in whole:
                known[u] = lead + 1 + mark
            else:
                rest.append(u)
        if rest:
            known.update(zip(rest, (len(x) // 4 for x in self._merged(rest)), strict=True))

        def size(x: list) -> int:
            return sum(map(known.__getitem__, x)) - 1 if x and isinstance(x[0], str) else len(x)

        return [sum(map(size, x)) if isinstance(x, tuple) else size(x) for x in units]


def _cut(t: str) -> list[str]:
    """The units of a text with single spaces and new lines only, behind the unit of a new line."""
    return ("\n" + t).replace("\n", " \n").split(" ")[1:]


def byte_chars() -> dict[str, int]:
    """Character -> byte of the printable form of byte-level vocabularies: printable bytes stand for themselves,
    the others for U+0100 onwards in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each worker and file."""
    return ByteBpe(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(values: list, size: int = 512) -> list[list]:
    """A batch's values in runs of ``size``, which bounds what a task holds at once."""
    return [values[k : k + size] for k in range(0, len(values), size)]
