import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import bpe
from gridloom.llm.queries import QUERIES
from tests.llm.helpers import awkward, documents, rows, sha, write

BITS = ["hello", "HELLO", "Rethor", " ", "  ", "\n", "\t", "'s", "'LL", "é", "É", "漢字", "😀", "ΑΣ", "İ", "ß", "123", "４", "<|endoftext|>",
        "<|startoftext|>", "<|", "\xa0", "\x1c", "\x85", "　", "!!!", "...", "a" * 50, "​", "ſ", "K", "\r\n", "ǅ", "½", "é",
        "don't", "\x00", "aaaa", "ababab", " ", "nowhereness", "?!"]


def generated(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randrange(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_same_ids_as_the_library(name):
    own, library = bpe.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    texts = generated(1500, 11) + [t or "" for _, t in awkward()]
    ids, counts = own.encode(texts)
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        at += n


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_CHUNKS", 10)
    own = bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text in generated(60, 12):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_one_very_long_text(name):
    """Longer than a step, with a chunk that is longer than the hash's blocks reach."""
    own, library = bpe.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    text = " ".join(generated(40000, 15)) + " " + "abc" * 20000 + "\u3000 tail"
    assert own.encode([None, text, ""])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_tables():
    import numpy as np

    r = np.random.default_rng(2)
    keys, second = r.integers(1, 50, 300, dtype=np.uint64), np.arange(300, dtype=np.uint64)
    table = bpe.Table(4, verified=True)
    for lo in range(0, 300, 100):
        table.put(keys[lo : lo + 100], np.arange(lo, lo + 100), second[lo : lo + 100])
    assert table.find(keys, second).tolist() == list(range(300)) and table.find(keys, second + np.uint64(300)).max() == -1


def test_merging_and_pairs_agree():
    """A pair stays apart exactly if merging its symbols gives the pair back."""
    vocab = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(13)
    spell = {}

    def symbols(t):
        if t not in spell:
            left = int(vocab.merges.left[t])
            spell[t] = [t] if left < 0 else symbols(left) + symbols(int(vocab.merges.right[t]))
        return spell[t]

    import numpy as np

    tokens = [r.randrange(50256) for _ in range(4000)]
    x, y = np.array(tokens[::2]), np.array(tokens[1::2])
    apart = vocab.merges.pairs_apart(x, y)
    flat = [symbols(int(a)) + symbols(int(b)) for a, b in zip(x, y)]
    ids, word = vocab.merges.merge(np.array(sum(flat, [])), np.repeat(np.arange(len(flat)), [len(f) for f in flat]))
    for i, (a, b) in enumerate(zip(x, y)):
        assert (ids[word == i].tolist() == [a, b]) == apart[i]


def test_query(spark, tmp_path):
    texts = [*enumerate(generated(200, 14), 100), *awkward()]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = rows(QUERIES["op6_bpe"](spark, write(documents(spark, texts), tmp_path)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=repr)
    assert bpe.encode_and_decode(documents(spark, ["x"]).limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0
