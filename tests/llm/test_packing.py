import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gridloom.llm import packing
from gridloom.llm.queries import QUERIES
from tests.llm.helpers import awkward, documents, write

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit_decreasing(lengths, capacity):
    """One piece after the other into the bin with the least room that is enough."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if fitting:
            rooms[min(fitting)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_against_one_by_one():
    r = random.Random(5)
    for trial in range(60):
        capacity = r.choice([7, 10, 64, 100])
        lengths = [r.randrange(1, capacity + 1) if trial % 2 else r.choice([1, 2, 3, capacity // 2, capacity]) for _ in range(r.randrange(0, 200))]
        ranges, bins = packing.plan(Counter(lengths), capacity)
        filled = defaultdict(list)
        for length, _, n, per, first, offset in ranges.tolist():
            for j in range(n):
                filled[first + j // per].append((offset + j % per * length, length))
        rooms = []
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            rooms.append(capacity - at)
        assert len(filled) == bins
        assert sorted(rooms) == best_fit_decreasing(lengths, capacity)


def test_tree():
    tree = packing.TightestBin(100)
    assert tree.at_least(1) is None
    for c in (5, 17, 100):
        tree.set(c, True)
    assert [tree.at_least(c) for c in (1, 5, 6, 17, 18, 100)] == [5, 5, 17, 17, 100, 100]
    tree.set(17, False)
    assert tree.at_least(6) == 100


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(2048) == [(0, 2048)]
    assert packing.cut(2049) == [(0, 1), (1, 2048)] and packing.cut(4096) == [(0, 2048), (2048, 2048)]


def test_query(spark, tmp_path):
    texts = [*awkward(), *[(100 + i, "lorem ipsum dolor " * n) for i, n in enumerate(random.Random(6).choices(range(1, 900), k=60))]]
    out = QUERIES["op5_packing"](spark, write(documents(spark, texts), tmp_path)).collect()
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            want[(i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == len(best_fit_decreasing([r.length for r in out], 2048))


def test_sequences_and_odd_lengths(spark):
    docs = documents(spark, ["one two", "three", None, "four " * 3000])
    placed = packing.pack_documents(docs, PATH)
    library = Tokenizer.from_file(PATH)
    got = Counter(tuple(sorted(r.ids)) for r in packing.sequences(docs, placed, PATH).collect())
    assert sum(len(k) * n for k, n in got.items()) == sum(
        len(library.encode(t or "").ids) + 1 for t in ("one two", "three", None, "four " * 3000))
    odd = spark.createDataFrame([(1, None), (2, 0), (3, 11), (4, 10), (5, 5)], "x int, length int")
    rows = {r.x: (r.sequence_id, r.offset) for r in packing.pack(odd, capacity=10).collect()}
    assert rows[1] == rows[2] == rows[3] == (None, None) and rows[4][1] == rows[5][1] == 0 and rows[4][0] != rows[5][0]
    assert packing.pack(odd.limit(0), capacity=10).count() == 0
