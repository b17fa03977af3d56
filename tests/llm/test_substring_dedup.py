import random
import re

import numpy as np
import pytest

from gridloom.llm import common, substring_dedup
from gridloom.llm.queries import QUERIES
from tests.llm.helpers import awkward, documents, rows, sha, write


def brute(texts, width=20):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in texts]
    starts = {}
    for (i, _), words in zip(texts, split):
        for k in range(len(words) - width + 1):
            if i is not None:
                key = tuple(words[k : k + width])
                starts[key] = min(starts.get(key, (i, k)), (i, k))
    out = []
    for (i, _), words in zip(texts, split):
        own, gone = {}, set()
        for k in range(len(words) - width + 1):
            key = tuple(words[k : k + width])
            first = starts[key] if i is not None else own.setdefault(key, (i, k))
            if first != (i, k):
                gone.update(range(k, k + width))
        out.append((i, len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    return sorted(out, key=repr)


def corpus(seed, n=80):
    """Random documents with shared passages of all lengths around the window, copies and periodic stretches."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(30)}"
    passages = [[f"p{r.randrange(10**5)}" for _ in range(m)] for m in (10, 15, 19, 20, 21, 25, 40, 80, 200)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(r.randrange(1, 6)):
            kind = r.randrange(4)
            if kind == 0:
                words += [word() for _ in range(r.randrange(40))]
            elif kind == 1:
                p = r.choice(passages)
                a = r.randrange(len(p))
                words += p[a : a + r.randrange(1, len(p) + 1)]
            elif kind == 2:
                words += r.choice(passages)
            else:
                words += [word(), word()] * r.randrange(1, 30)
        out.append(r.choice([" ", "  ", "\n"]).join(words))
    return out + out[:10] * 3


def test_query_against_brute_force(spark, tmp_path):
    texts = [*enumerate(corpus(1), 1000), *awkward()]
    got = rows(QUERIES["op9_substring_dedup"](spark, write(documents(spark, texts), tmp_path)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute(texts)


@pytest.mark.parametrize("width", [1, 2, 7, 9, 41])
def test_other_widths(spark, width):
    texts = list(enumerate(corpus(2, 25)))
    got = substring_dedup.remove_repeats(documents(spark, texts), width=width).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, sha(r.kept)) for r in got), key=repr) == brute(texts, width)


def test_empty(spark):
    assert substring_dedup.remove_repeats(documents(spark, ["x"]).limit(0)).count() == 0
    assert substring_dedup.remove_repeats(documents(spark, [None, "", "a b"])).count() == 3


def test_sliding_min_and_anchors():
    r = np.random.default_rng(1)
    for width in range(1, 40):
        x = r.integers(0, 50, 100).astype(np.uint64) << np.uint64(40)
        want = [min(x[i : i + width]) for i in range(len(x) - width + 1)]
        assert common.sliding_min(x, width).tolist() == want
        assert common.anchors(x, width).tolist() == [i + int(np.argmin(x[i : i + width])) for i in range(len(x) - width + 1)]


def thue_morse(swap=False):
    """A word of 1024 letters and its complement: a polynomial modulo a power of two can't tell them apart."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(1024))


def test_no_word_stands_for_another(spark):
    tail = " ".join(f"t{i}" for i in range(19))
    docs = [(1, f"{thue_morse()} {tail}"), (2, f"{thue_morse(True)} {tail}")]
    assert [r.n_removed for r in substring_dedup.remove_repeats(documents(spark, docs)).collect()] == [0, 0]
    # The same as a sequence of two words.
    words = [" ".join(thue_morse(swap)) for swap in (False, True)]
    got = substring_dedup.remove_repeats(documents(spark, list(enumerate(words))), width=1024).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(0, 0), (1, 0)]
    w = common.Words(["a aa aaaaaaaa aaaaaaaaa " + " ".join("x" * n + y for n in (7, 8, 15, 16, 511, 512, 513, 5000) for y in "pq"), "aaaaaaaa aa a"])
    for lane in (0, 1):
        names = dict(zip([w.bytes[s:e] for s, e in zip(w.start, w.end)], w.keys(lane)))
        assert len(set(names.values())) == len(names) and w.keys(lane)[-3:].tolist() == w.keys(lane)[[2, 1, 0]].tolist()


def test_levels():
    assert substring_dedup.levels(20) == [5, 10, 20] and substring_dedup.levels(1) == [1] and substring_dedup.levels(9) == [5, 9]


def test_word_hashes_depend_on_the_words_alone():
    a, b = common.Words(["x yy zzz", None, "", "yy  zzz\tx"]), common.Words(["zzz x", "yy"])
    h = dict(zip([a.bytes[s:e] for s, e in zip(a.start, a.end)], a.hashes()))
    for s, e, v in zip(b.start, b.end, b.hashes()):
        assert h[b.bytes[s:e]] == v
    assert a.counts.tolist() == [3, 0, 0, 3]
