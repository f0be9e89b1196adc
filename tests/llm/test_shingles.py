"""Shingles of many texts together: as many as there are distinct runs of words, in less time than words take one by one."""

import random
import re
import time

import numpy as np

from fundlake.llm import jaccard_join

RND = random.Random(9)


def _runs(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text or b"")
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def test_all_shingles():
    """Words of every length, with equal beginnings, NULs and bytes that aren't letters; texts of no, one and few words; any company."""
    words = [b"a" * k for k in range(1, 200)] + [b"b" * k + b"a" for k in range(1, 200)] + [b"a\0", b"\0", b"\0\0", b"b\0", b"\0a", "é日😀".encode(), b"\x0e", b"\x1c\x85\xa0", b"A" * 64, b"A" * 65]
    space = [b" ", b"\t", b"\n", b"\r\n", b"\x0b\x0c", b"   "]
    texts = [None, b"", b" \n", *words, *(w + b" x" for w in words), *(b"".join(RND.choice(words) + RND.choice(space) for _ in range(n)) for n in (2, 4, 5, 6, 9, 300, 3000))]
    texts += [b" ".join([b"same words here again now"] * 9), b"\n" + texts[-1].upper() + b"\n", b"One two three four", b"one TWO three  four"]
    got, want = jaccard_join.all_shingles(texts), [_runs(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    assert all((np.diff(s.astype(object)) > 0).all() for s in got)
    one = {h for s in got for h in s.tolist()}
    assert len(one) == len(set().union(*want))
    for k in (0, 1, 2, 7, 150, len(texts) - 1):
        assert (jaccard_join.shingles((texts[k] or b"").decode("utf-8", "surrogateescape")) == got[k]).all() or b"\x85" in (texts[k] or b"")
    assert (got[-1] == got[-2]).all() and jaccard_join.all_shingles([]) == []


def test_shingles_take_little_time():
    """Less than three times what it takes to make an object of each word, which used to be the smaller part."""
    texts = [" ".join(f"{RND.getrandbits(30):x}" for _ in range(20_000)) for _ in range(10)]

    def seconds(f):
        out = []
        for _ in range(5):
            at = time.thread_time()
            for t in texts:
                f(t)
            out.append(time.thread_time() - at)
        return min(out)

    assert seconds(jaccard_join.shingles) < 3 * seconds(lambda t: t.encode().lower().split())
