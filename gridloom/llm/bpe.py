"""Byte-pair encoding by speculation: greedy longest matches propose tokens, pairs are verified, the rest is merged exactly.

A sequence of tokens is what merging gives if and only if every token encodes to itself and no adjacent pair would have
merged across its border. Both are properties of the vocabulary, so a pair is decided once and remembered. Words with a
pair that fails are merged rule by rule. Text is cut into chunks at blanks, by masks over the bytes of many texts at once; a
chunk is known by a 128-bit hash and encoded once per worker.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - binary_join
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gridloom.llm.common import list_array, map_documents, mix, range_hashes, worker_state

#: Chunks and token ids kept per worker before the memory starts anew: about 80 MB with the table that finds them.
MEMORY_CHUNKS, MEMORY_IDS = 1 << 20, 1 << 22
BETWEEN = "\xff"
NEVER = np.int64(1) << np.int64(40)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Table:
    """Numbers by 64-bit keys (not 0), many at once: open addressing, at most half full. A second key can verify the first."""

    def __init__(self, entries: int = 1 << 10, verified: bool = False):
        size = 1 << max(4, (2 * entries - 1).bit_length())
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.second = np.zeros(size, np.uint64) if verified else None
        self.n = 0

    def find(self, keys: np.ndarray, second: np.ndarray | None = None, missing: int = -1) -> np.ndarray:
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(keys), missing, np.int64)
        at, left = mix(keys) & mask, np.arange(len(keys))
        while len(left):
            there = self.keys[at]
            hit = there == keys[left] if second is None else (there == keys[left]) & (self.second[at] == second[left])
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (there != 0)
            left, at = left[go], (at[go] + np.uint64(1)) & mask
        return out

    def put(self, keys: np.ndarray, values: np.ndarray, second: np.ndarray | None = None) -> None:
        """Add distinct keys that aren't there."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = np.flatnonzero(self.keys)
            kept = self.keys[old], self.values[old], self.second[old] if self.second is not None else None
            self.__init__(2 * (self.n + len(keys)), self.second is not None)
            self.put(*kept)
        mask = np.uint64(len(self.keys) - 1)
        at, left = mix(keys) & mask, np.arange(len(keys))
        while len(left):
            free = self.keys[at] == 0
            # Of those that meet at a free place the last one stands there.
            self.keys[at[free]] = keys[left[free]]
            if second is not None:
                self.second[at[free]] = second[left[free]]
            mine = free & (self.keys[at] == keys[left])
            if second is not None:
                mine &= self.second[at] == second[left]
            self.values[at[mine]] = values[left[mine]]
            left, at = left[~mine], (at[~mine] + np.uint64(1)) & mask
        self.n += len(keys)


class Merges:
    """The merge rules of a vocabulary: exact merging, and the test of adjacent pairs."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        size = max(vocab.values()) + 1
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        birth = np.full(size, -1, np.int64)
        keys = np.zeros(len(pairs), np.int64)
        self.made = np.zeros(len(pairs), np.int64)
        for rank, (a, b) in enumerate(pairs):
            x, y = vocab[a], vocab[b]
            made = vocab[a + b]
            keys[rank] = (x << 32) | y
            self.made[rank] = made
            if birth[made] < 0:
                left[made], right[made], birth[made] = x, y, rank
        # A rule that is listed twice counts where it is listed first.
        first = np.unique(keys, return_index=True)[1]
        self.rules = Table(2 * len(first) + 1)
        self.rules.put(keys[first].view(np.uint64) + np.uint64(1), first)
        self.left, self.right, self.birth = left, right, birth
        self.known = Table()
        # A token stands for itself if both halves do and nothing merges across them earlier.
        made = np.flatnonzero(birth >= 0)
        fine = np.ones(size, bool)
        fine[made] = self._apart(left[made], right[made], birth[made])
        for token in made[np.argsort(birth[made])]:
            fine[token] &= fine[left[token]] and fine[right[token]]
        self.fine = fine

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.rules.find(((x << 32) | y).view(np.uint64) + np.uint64(1), missing=NEVER)

    def _apart(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether x and y, side by side, stay apart before rule ``until``.

        Walks back in time along the right edge of x and the left edge of y: at every moment one piece of each
        touches the border, and a rule for those two pieces must not come before either piece is used up.
        """
        x, y = x.copy(), y.copy()
        end_x = np.broadcast_to(np.asarray(until, np.int64), x.shape).copy()
        end_y = end_x - 1  # the rule that uses up y itself comes later in the text, so it doesn't come first
        apart, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            rank = self._rank(x, y)
            joined = (rank < end_x) & (rank <= end_y)
            apart[live[joined]] = False
            bx, by = self.birth[x], self.birth[y]
            go = ~joined & ((bx >= 0) | (by >= 0))
            live, x, y, end_x, end_y, bx, by = (v[go] for v in (live, x, y, end_x, end_y, bx, by))
            back_x, back_y = bx >= by, by >= bx
            end_x, end_y = np.where(back_x, bx, end_x), np.where(back_y, by, end_y)
            x, y = np.where(back_x, self.right[x], x), np.where(back_y, self.left[y], y)
        return apart

    def pairs_apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The same for tokens of a proposal; every distinct pair is decided once per worker."""
        keys = ((x << 32) | y).view(np.uint64) + np.uint64(1)
        result = self.known.find(keys)
        new = np.flatnonzero(result < 0)
        if len(new):
            fresh, where = np.unique(keys[new], return_inverse=True)
            pair = (fresh - np.uint64(1)).view(np.int64)
            apart = self._apart(pair >> 32, pair & 0xFFFFFFFF).astype(np.int64)
            if self.known.n > MEMORY_CHUNKS:
                self.known = Table()
            self.known.put(fresh, apart)
            result[new] = apart[where]
        return result > 0

    def merge(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: in each the earliest rule first, all its places from left to right.

        ``word`` numbers the word of each symbol, in rising order; returns the same for the tokens.
        """
        done_ids, done_word = [], []
        while len(ids):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            rank = np.full(len(ids), NEVER)
            inner = np.flatnonzero(word[1:] == word[:-1])
            rank[inner] = self._rank(ids[inner], ids[inner + 1])
            sizes = np.diff(starts, append=len(ids))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = best == NEVER
            done_ids.append(ids[over])
            done_word.append(word[over])
            ids, word, rank, best = (v[~over] for v in (ids, word, rank, best))
            hit = rank == best
            # In a row of hits that share symbols every second one counts.
            at = np.arange(len(ids))
            since = at - np.maximum.accumulate(np.where(hit, -1, at))
            hit &= since % 2 == 1
            ids = np.where(hit, self.made[np.where(hit, rank, 0)], ids)
            keep = np.ones(len(ids), bool)
            keep[np.flatnonzero(hit) + 1] = False
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate(done_ids or [ids]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return ids[order], word[order]


class Vocabulary:
    """One tokenizer file: words of a chunk, special tokens, merges, the matcher."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.merges = Merges(vocab, model["merges"])
        letters = byte_alphabet()
        self.lowers = spec["normalizer"] is not None
        # Inside, a word is a string of the characters 0..255 (bytes); the last one is moved up by 256 where the
        # vocabulary marks word ends, so that no match can end in the middle of a marked letter or cross words.
        self.shift = 256 if suffix else 0
        number = {c: chr(b) for b, c in enumerate(letters)}
        self.base = np.full(512, -1, np.int64)
        matcher = ahocorasick.Automaton()
        for token, i in vocab.items():
            ends = bool(suffix) and token.endswith(suffix) and token != suffix
            body = token.removesuffix(suffix) if ends else token
            if not body or any(c not in number for c in body):
                continue
            own = "".join(number[c] for c in body)
            if ends:
                own = own[:-1] + chr(ord(own[-1]) + self.shift)
            if len(own) == 1:
                self.base[ord(own)] = i
            # Byte 255 is in no UTF-8 text; between words it keeps matches from crossing.
            if self.merges.fine[i] and BETWEEN not in own:
                matcher.add_word(own, i)
        matcher.make_automaton()
        self.matcher = matcher

    def words(self, chunk: str) -> list[bytes]:
        """The words of a chunk after normalisation, as bytes."""
        if self.lowers:
            if chunk.isascii():
                return [w.encode() for w in _ASCII_WORDS.findall(chunk.lower())]
            text = _WHITE.sub(" ", unicodedata.normalize("NFC", chunk))
            # Letters are lowered one by one, so a sigma at the end of a word is an ordinary one.
            text = text.replace("Σ", "σ").lower()
            found = _WORDS.findall(text)
        else:
            found = _ASCII_PIECES.findall(chunk) if chunk.isascii() else _PIECES.findall(chunk)
        return [w.encode("utf-8", "surrogatepass") for w in found]

    def encode_words(self, data: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words (none of them empty) one after another, and how many each word has.

        A word is ``sizes`` bytes of ``data`` from its start.
        """
        n = len(sizes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gap = 0 if self.shift else 1
        bounds = np.cumsum(sizes + gap) - gap  # ends of words
        begin = bounds - sizes
        total = int(bounds[-1])
        symbols = np.full(total, ord(BETWEEN), np.uint16)
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbols[np.repeat(begin, sizes) + inside] = data[np.repeat(start, sizes) + inside]
        symbols[bounds - 1] += np.uint16(self.shift)
        text = symbols.astype("<u2").tobytes().decode("utf-16-le") if self.shift else symbols.astype(np.uint8).tobytes().decode("latin-1")
        flat = np.fromiter(chain.from_iterable(self.matcher.iter_long(text)), np.int64)
        ends, ids = flat[::2], flat[1::2]
        word_at = np.repeat(np.arange(n), np.diff(np.append(begin, total)))
        word = word_at[ends]
        counts = np.bincount(word, minlength=n)
        inner = np.flatnonzero(word[1:] == word[:-1])
        bad = np.zeros(n, bool)
        bad[word[inner[~self.merges.pairs_apart(ids[inner], ids[inner + 1])]]] = True
        # A proposal must cover its word; a byte without a token of its own would leave a hole.
        first = np.append(True, word[1:] != word[:-1])[: len(word)]
        token_sizes = ends - np.where(first, begin[word] - 1, np.concatenate([[0], ends[:-1]]))
        bad |= np.bincount(word, weights=token_sizes, minlength=n).astype(np.int64) != sizes
        if not bad.any():
            return ids, counts
        failed = np.flatnonzero(bad)
        inside = np.arange(int(sizes[failed].sum())) - np.repeat(np.cumsum(sizes[failed]) - sizes[failed], sizes[failed])
        spelled = self.base[symbols[np.repeat(begin[failed], sizes[failed]) + inside]]
        merged, owner = self.merges.merge(spelled, np.repeat(failed, sizes[failed]))
        keep = ~bad[word]
        ids, word = np.concatenate([ids[keep], merged]), np.concatenate([word[keep], owner])
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=n)


# The patterns that split words in the two kinds of vocabularies, and white space as they mean it.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_WHITE = re.compile(f"[{_SPACE}]+")
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t\n\x0b\x0c\r a-z0-9]+")
_PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_ASCII_PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t\n\x0b\x0c\r A-Za-z0-9]+"
    r"|[\t\n\x0b\x0c\r ]+(?![^\t\n\x0b\x0c\r ])|[\t\n\x0b\x0c\r ]+"
)
# White space beyond ASCII as the patterns mean it, by the bytes that it ends with in UTF-8.
_WHITE_ENDS = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _white_before(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether white space ends right before each place (which is not the first of ``data``)."""
    white = _ASCII_WHITE[data[places - 1]]
    odd = np.flatnonzero(data[places - 1] >= 128)
    for end in _WHITE_ENDS:
        at = places[odd]
        same = at >= len(end)
        for k, byte in enumerate(end):
            same &= data[np.maximum(at - len(end) + k, 0)] == byte
        white[odd[same]] = True
    return white


class Encoder:
    """Texts to token ids, with the chunks seen so far kept as one flat array."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.splits = re.compile("(" + "|".join(map(re.escape, self.vocab.special)) + ")") if self.vocab.special else None
        self.clear()

    def clear(self) -> None:
        self.table = Table(1 << 12, verified=True)
        self.ids, self.n_ids = np.zeros(1 << 12, np.int32), 0
        self.first, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def _put(self, keys: np.ndarray, second: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Remember the ids of distinct new chunks."""
        base, m = self.table.n, len(keys)
        self.table.put(keys, np.arange(base, base + m), second)
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while base + m > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.first[base : base + m] = self.n_ids + np.cumsum(counts) - counts
        self.count[base : base + m] = counts
        self.n_ids += len(ids)

    def _parts(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Texts cut at special tokens: the bytes of each part, its text, and its special token (-1: none)."""
        parts, owner, special = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.splits is None or not any(name in text for name in self.vocab.special):
                parts.append(text.encode("utf-8", "surrogatepass"))
                owner.append(i)
                special.append(-1)
                continue
            for part in self.splits.split(text):
                if part:
                    parts.append(part.encode("utf-8", "surrogatepass"))
                    owner.append(i)
                    special.append(self.vocab.special.get(part, -1))
        return parts, np.array(owner, np.int64), np.array(special, np.int64)

    def _chunks(self, data: np.ndarray, bounds: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of the chunks and the part of each. No word reaches across; special tokens are whole.

        Chunks start with their blank where the vocabulary has blanks in its words, and leave white space out where it has not.
        """
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        if self.vocab.lowers:
            apart = (data == 32) | (data == 10)
            inside = np.repeat(special >= 0, np.diff(bounds))
            apart &= ~inside
            edge[:-1] |= apart
            edge[1:] |= apart
        else:
            blank = np.flatnonzero(data == 32)
            blank = blank[~edge[blank]]
            blank = blank[~_white_before(data, blank)]
            part = np.searchsorted(bounds, blank, side="right") - 1
            edge[blank[special[part] < 0]] = True
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        if self.vocab.lowers:
            real = ~apart[start]
            start, end = start[real], end[real]
        return start, end, np.searchsorted(bounds, start, side="right") - 1

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        if self.table.n > MEMORY_CHUNKS or self.n_ids > MEMORY_IDS:
            self.clear()
        parts, owner, special = self._parts(texts)
        data = np.frombuffer(b"".join(parts), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        start, end, part = self._chunks(data, bounds, special)
        keys, second = (range_hashes(data, start, end, lane) for lane in (0, 1))
        # A special token is not the same as its spelling; 0 is no key.
        keys = np.maximum(keys ^ (special[part] + 1).astype(np.uint64), np.uint64(1))
        codes = self.table.find(keys, second)
        unknown = np.flatnonzero(codes < 0)
        if len(unknown):
            fresh, where = np.unique(keys[unknown], return_index=True)
            chunk = unknown[where]
            self._learn(data, start[chunk], end[chunk], special[part[chunk]], fresh, second[chunk])
            codes[unknown] = self.table.find(keys[unknown], second[unknown])
        first, n = self.first[codes], self.count[codes].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(first - (ends - n), n)]
        return ids, np.bincount(owner[part], weights=n, minlength=len(texts)).astype(np.int64)

    def _learn(self, data, start, end, special, keys, second) -> None:
        """Encode new chunks: those that are one word of plain letters at once, the others by the patterns."""
        is_special = special >= 0
        if is_special.any():
            self._put(keys[is_special], second[is_special], special[is_special], np.ones(int(is_special.sum()), np.int64))
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        leads = _LETTER[data[start]] | ((data[start] == 32) & (end - start > 1) if not self.vocab.lowers else False)
        plain = leads & (letters[end] - letters[start + 1] == end - start - 1) & ~is_special
        if self.vocab.lowers:
            data = np.where(_LETTER[data], data | 32, data)
        ids, counts = self.vocab.encode_words(data, start[plain], (end - start)[plain])
        self._put(keys[plain], second[plain], ids, counts)
        other = np.flatnonzero(~plain & ~is_special)
        if not len(other):
            return
        raw = data.tobytes()
        words = [self.vocab.words(raw[s:e].decode("utf-8", "surrogatepass")) for s, e in zip(start[other].tolist(), end[other].tolist())]
        flat = list(chain.from_iterable(words))
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        ids, counts = self.vocab.encode_words(np.frombuffer(b"".join(flat), np.uint8), np.cumsum(sizes) - sizes, sizes)
        per_chunk = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), per_chunk)
        self._put(keys[other], second[other], ids, np.bincount(owner, weights=counts, minlength=len(words)).astype(np.int64))


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    state = worker_state()
    state.setdefault("used", set()).add(("encoder", path))
    if ("encoder", path) not in state:
        state[("encoder", path)] = Encoder(path)
    return state[("encoder", path)]


def encode_and_decode(
    docs: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, ``ids`` (token ids of the whole text), ``decoded`` (their texts, joined by blanks).

    ``path`` names a vocabulary file that every executor has, or is a function that gives it there. Special tokens
    that stand in a text are recognised; none are added. Null and empty texts have no ids and decode to an empty
    text; a null id stays null; repeated rows get a row each; other columns are left alone; an empty table gives an
    empty result; very long texts are a step of their own. No shuffle; a worker's memory starts anew at ``MEMORY_CHUNKS`` chunks or
    ``MEMORY_IDS`` of their ids.
    """
    schema = StructType([
        docs.schema[id_col], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType()),
    ])

    def start():
        tokens = encoder(path if isinstance(path, str) else path())
        size = max(tokens.vocab.text_of) + 1
        names = [tokens.vocab.text_of.get(i, "") for i in range(size)]
        texts = pa.array(names)

        def work(rows):
            ids, counts = tokens.encode(rows[text_col])
            flat = list_array(counts, ids, pa.int32())
            words = pa.ListArray.from_arrays(flat.offsets, texts.take(pa.array(ids)))
            return {id_col: rows[id_col], "ids": flat, "decoded": pa.compute.binary_join(words, " ")}

        return work

    return map_documents(docs, [id_col, text_col], text_col, schema, start)
