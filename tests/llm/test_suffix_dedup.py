import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import suffix_dedup
from gridloom.llm.queries import QUERIES
from tests.llm.helpers import awkward, documents, rows, sha, write


def brute(texts, width=400):
    raw = [(t or "").encode() for _, t in texts]
    seen = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for (i, _), r in zip(texts, raw):
        gone = np.zeros(len(r) + 1, int)
        for k in range(len(r) - width + 1):
            if seen[r[k : k + width]] > 1:
                gone[k : k + width] = 1
        spans = int((np.diff(gone, prepend=0) == 1).sum())
        out.append((i, len(r), int(gone.sum()), spans, sha(bytes(b for b, g in zip(r, gone) if not g))))
    return sorted(out, key=repr)


def corpus(seed, n, width):
    """Documents with passages cut anywhere, around the width in length; periodic stretches; copies."""
    r = random.Random(seed)
    text = lambda m: "".join(r.choice("abcdeé \n") for _ in range(m))
    passages = [text(m) for m in (width // 2, width - 1, width, width + 1, width + 30, 2 * width, 5 * width)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(1, 6)):
            kind = r.randrange(5)
            p = r.choice(passages)
            if kind == 0:
                parts.append(text(r.randrange(2 * width)))
            elif kind == 1:
                a = r.randrange(len(p))
                parts.append(p[a : a + r.randrange(1, len(p) + 1)])
            elif kind == 2:
                parts.append(p)
            elif kind == 3:
                a = r.randrange(len(p))
                parts.append(p[:a] + "#" + p[a + 1 :])
            else:
                parts.append(r.choice(["ab", "x", "abc"]) * r.randrange(1, width))
        out.append("".join(parts))
    return out + out[:3] * 2


@pytest.mark.parametrize("largest", [200, 3, 0])
def test_small_width_against_brute_force(spark, largest):
    texts = [*enumerate(corpus(1, 60, 40)), *awkward()]
    got = suffix_dedup.remove_repeats(documents(spark, texts), width=40, gram=10, largest_group=largest).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in got), key=repr) == brute(texts, 40)


def test_query_against_brute_force(spark, tmp_path):
    texts = [*enumerate(corpus(2, 40, 400), 1000), *awkward()]
    got = rows(QUERIES["op1_suffix_dedup"](spark, write(documents(spark, texts), tmp_path)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute(texts)


def test_one_long_text_of_one_line(spark):
    """Longer than a step; its lines are all one segment, of which one occurrence stands for the others."""
    line = "this very line stands here again and again, and over again; "
    texts = [(1, "begin " + line * 20000 + "end"), (2, "x" * 300 + line * 3 + "y" * 300), (3, "z" * 30)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(documents(spark, texts), width=100, gram=24).collect()}
    assert len(texts[0][1]) > 1 << 20
    assert bytes(got[1].kept) == b"beginend" and got[1].n_spans == 1
    assert got[2].n_removed == 3 * len(line) + 600 and got[3].n_removed == 0


def test_radix_passes():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    data[2000:2300] = data[100:400]
    starts = np.arange(len(data) - 30)
    seen = Counter(data[i : i + 30].tobytes() for i in starts)
    want = [i for i in starts if seen[data[i : i + 30].tobytes()] > 1]
    assert sorted(suffix_dedup.equal_suffixes(data, starts, 30, digit=7).tolist()) == want


def test_steps_are_bounded():
    """Two tasks of an executor, with its heap, have to fit: a step of the local sort held over 100 MB."""
    data = np.random.default_rng(5).integers(97, 105, suffix_dedup.SORT_BYTES).astype(np.uint8)
    data[-50_000:] = data[:50_000]
    texts = [bytes(d).decode() for d in np.array_split(data, 64)]
    for step in (
        lambda: suffix_dedup.equal_suffixes(data, np.arange(len(data) - 200), 200),
        lambda: suffix_dedup._Segments(texts, 200, 48),
    ):
        tracemalloc.start()
        step()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 48 << 20


def test_empty(spark):
    assert suffix_dedup.remove_repeats(documents(spark, ["x"]).limit(0)).count() == 0
    assert suffix_dedup.remove_repeats(documents(spark, [None, "", "a b"])).count() == 3
