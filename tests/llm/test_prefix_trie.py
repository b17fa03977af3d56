import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import prefix_trie
from gridloom.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import sha, write
from tests.llm.test_chat import CONVERSATIONS, _duck, awkward_turns
from tools.check import compare


def brute(rows):
    """Nodes by their sequences of turns themselves."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    def key(t):
        return (*t[:2], sha(f"{len(t[2].encode())}:{t[2]}{t[3]}"))
    own = {c: [t[2:] for t in sorted(ts, key=key)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, (abs(c) // 20 * 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, cs in members.items():
        kids = [n for n in members if len(n) == len(node) + 1 and n[: len(node)] == node]
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in cs if whole[c] == node)))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), len(leaves), saved, sha(ends)))
    return sorted(out, key=repr)


def made():
    """Shared first turns, copies of a conversation, bases that are missing or short, chains, turnless ones, negative ids."""
    out = [(c, t, ("user", "assistant")[t % 2], f"{'common words' if t < c % 4 else c} turn {t}") for c in range(60) for t in range(c % 6)]
    out += [(c, t, "user", f"copy  of\t{t}") for c in range(100, 160) for t in range(3)]
    out += [(c, t, "user", "same") for c in (-1, -20, -41, 205, 311) for t in range(2 + abs(c) % 3)]
    return [*out, (400, None, None, None), (401, 1, "user", ""), (401, 1, "user", ""), (401, 1, "assistant", "tie")]


@pytest.mark.parametrize("shard,piece", [(100_000, 200_000), (20, 50), (1, 7)])
def test_against_sequences(spark, tmp_path, monkeypatch, shard, piece):
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard)
    monkeypatch.setattr(prefix_trie, "PIECE_ROWS", piece)
    rows = made() + [r for r in awkward_turns() if r[0] != 9] + [(9, t, "user", f"deep {t}") for t in range(60)]
    folder = write(spark.createDataFrame(rows, CONVERSATIONS).withColumns({c: F.lit("x") for c in ("conv", "piece", "p1", "depth", "zone")}), tmp_path, "conversations")
    got = QUERIES["op13_prefix_trie"](spark, folder)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert compare(got, _duck(folder), ORACLES["op13_prefix_trie"]) is None


def test_empty_tables(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], CONVERSATIONS)).count() == 0


def test_perfect_hash():
    r = np.random.default_rng(5)
    a, b = r.integers(0, 2**63, 5000, dtype=np.uint64), r.integers(0, 3, 5000, dtype=np.uint64)
    a[:2500] = a[2500:]  # halves of keys in common
    b[:2500] = b[2500:] + np.uint64(3)
    table = prefix_trie.PerfectHash(a, b)
    assert sorted(table.slots(a, b)) == list(range(5000))
    assert (table.slots(a, b + np.uint64(9)) == -1).all()
    assert len(prefix_trie.PerfectHash(a[:0], b[:0]).slots(a[:2], b[:2])) == 2
