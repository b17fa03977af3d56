import random
import re

import numpy as np
import pytest

from gridloom.llm import near_dedup
from gridloom.llm.components import components
from gridloom.llm.queries import QUERIES
from tests.llm.helpers import awkward, documents, rows, write


def brute_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(texts, without=frozenset()):
    """Components by comparing everything with everything (but for the pairs of ids in ``without``)."""
    sets = [brute_sets(t) for _, t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if frozenset((texts[i][0], texts[j][0])) in without:
                continue
            if x and y and texts[i][0] is not None and texts[j][0] is not None:
                if texts[i][0] == texts[j][0] or 100 * len(x & y) >= 75 * len(x | y):
                    a, b = sorted((find(i), find(j)), key=lambda k: texts[k][0])
                    label[b] = a
    return [(i, len(s), texts[find(k)][0] if i is not None else None, i is None or texts[find(k)][0] == i) for k, ((i, _), s) in enumerate(zip(texts, sets))]


def family(n, size, edits, seed):
    """Copies of one text, each with words changed at random: near copies at all distances around the threshold."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randrange(edits)):
            words[r.randrange(size)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_query_against_all_pairs(spark, tmp_path):
    texts = [*family(120, 80, 9, 1), *family(40, 300, 30, 2), *family(30, 12, 4, 3), *["same text in many rows of this table"] * 15, "one two", "one two", "One TWO"]
    r = random.Random(4)
    r.shuffle(texts)
    texts = [*enumerate(texts, 1000), *awkward()]
    got = rows(QUERIES["op7_near_dedup"](spark, write(documents(spark, texts), tmp_path)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute(texts), key=repr)


def test_leftovers_are_found(spark, monkeypatch):
    """Stars that verify nothing leave every link to the exact join."""
    real, calls = near_dedup._verify, []

    def first_finds_nothing(pairs, sets, percent):
        calls.append({frozenset(r) for r in pairs.select("a", "b").collect()})
        return real(pairs, sets, percent) if len(calls) > 1 else real(pairs, sets, percent).limit(0)

    monkeypatch.setattr(near_dedup, "_verify", first_finds_nothing)
    texts = list(enumerate(dict.fromkeys(family(60, 80, 9, 5))))
    got = rows(near_dedup.near_duplicates(documents(spark, texts)))
    # What a star has compared isn't compared again.
    assert got == sorted(brute(texts, calls[0] - calls[1]), key=repr) and len(calls) == 2


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    for common, other in ((300, 100), (30, 10), (3, 1), (2000, 700)):
        x = r.integers(0, 2**63, common + 2 * other).astype(np.uint64)
        a, b = x[: common + other], np.concatenate([x[:common], x[common + other :]])
        sig = near_dedup.super_min_hash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 144)
        assert abs((sig[0] == sig[1]).mean() - common / (common + 2 * other)) < 0.13
        assert (sig != near_dedup.EMPTY).all()


def test_super_min_hash_against_one_by_one():
    r, size = np.random.default_rng(2), 12
    elements = r.integers(0, 2**63, 40).astype(np.uint64)
    owner = np.sort(r.integers(0, 5, 40))
    want = np.full((5, size), near_dedup.EMPTY, np.uint64)
    for e, o in zip(elements, owner):
        order = list(range(size))
        for step in range(size):
            u = int(near_dedup.mix(np.array([e], np.uint64) + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))[0])
            k = step + (u >> 32) % (size - step)
            order[step], order[k] = order[k], order[step]
            want[o, order[step]] = min(want[o, order[step]], np.uint64(step << 32 | u & 0xFFFFFFFF))
    assert (near_dedup.super_min_hash(elements, owner, 5, size) == want).all()


@pytest.mark.parametrize("links, want", [
    ([(i + 1, i) for i in range(40)], {(i, 0) for i in range(41)}),
    ([(9, 5), (5, 7), (2, 3), (3, 2), (4, 4)], {(5, 5), (7, 5), (9, 5), (2, 2), (3, 2)}),
    ([], set()),
])
def test_components(spark, links, want):
    assert {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want


def test_empty(spark):
    assert near_dedup.near_duplicates(documents(spark, ["x"]).limit(0)).count() == 0


def test_no_word_stands_for_another(spark):
    """Words that a polynomial hash can't tell apart don't link."""
    texts = ["".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(1024)) for swap in (0, 1)]
    got = near_dedup.near_duplicates(documents(spark, texts)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 1)]
