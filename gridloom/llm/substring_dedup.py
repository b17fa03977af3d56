"""Repeated word windows by level-wise doubling, first occurrence kept.

A window of ``width`` words can only be repeated if every shorter window inside it is. Levels go through windows of a quarter,
a half and all of the width (or more levels for wider ones), each twice as long as the one before. A level looks at few windows
of its length: of those inside a full window the one with the least hash, a choice that equal windows make alike. Windows seen
once die; the full windows around the survivors are the next level's candidates, until none survive or the full length is
reached, where windows that start in an earlier document (or earlier in their own) are removed. Equal texts are one text: all
but the first are removed as a whole, and don't take part in the levels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from gridloom.llm.common import Words, anchors, list_array, map_documents, ready, runs_of_words, signed, text_key
from gridloom.session import settle

WIDTH = 20
#: Words of the shortest windows at least, where the width has room for several levels.
SHORTEST = 5
LONG, INT, BOOL = pa.int64(), pa.int32(), pa.bool_()


def levels(width: int) -> list[int]:
    """Lengths of the windows from the shortest to ``width``, each twice the one before (give or take one)."""
    out = [width]
    while (out[0] + 1) // 2 >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


class _Windows:
    """The full windows in several texts at once, and of each the anchor among its windows of one length.

    Places count words over all texts.
    """

    def __init__(self, texts: list[str | None], width: int, length: int | None = None):
        self.words = words = Words(texts)
        keys = words.keys()
        n = max(0, len(keys) - width + 1)
        self.at = np.flatnonzero(words.doc[:n] == words.doc[width - 1 : width - 1 + n])
        self.doc = words.doc[self.at]
        self.width = width
        if length is None:
            self.full = runs_of_words(keys, width)
        else:
            self.short = runs_of_words(keys, length)
            self.anchor = anchors(self.short, width - length + 1)[self.at] if len(self.at) else self.at

    def second(self) -> np.ndarray:
        """Another hash of the full windows, independent of the first."""
        return runs_of_words(self.words.keys(1), self.width)


def _first_in_text(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each entry is the first of its hash in its text (entries in order of place)."""
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    first = np.empty(len(order), bool)
    first[order] = new
    return first


def _level(docs: DataFrame, width: int, length: int, narrowed: int | None) -> DataFrame:
    """id, x1 and of each chosen window of one length: hash, place, whether its text holds the hash twice.

    ``narrowed`` is the length of the level before; the full windows around its survivors (``alive``) are the candidates.
    """
    schema = StructType([
        docs.schema["id"], StructField("x1", LongType()), StructField("hashes", ArrayType(LongType())),
        StructField("places", ArrayType(IntegerType())), StructField("twice", ArrayType(BooleanType())),
    ])

    def start():
        def work(cols):
            w = _Windows(cols["text"], width, length)
            anchor = w.anchor
            if narrowed is not None:
                anchor = anchor[_around(_Windows(cols["text"], width, narrowed), cols["alive"])]
            # Anchors don't move back, so equal ones are neighbours.
            chosen = anchor[np.flatnonzero(np.diff(anchor, prepend=-1))]
            doc, hashes = w.words.doc[chosen], w.short[chosen]
            order = np.lexsort((hashes, doc))
            same = (doc[order][1:] == doc[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
            twice = np.zeros(len(chosen), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            counts = np.bincount(doc, minlength=len(cols["text"]))
            return {
                "id": cols["id"], "x1": cols["x1"], "hashes": list_array(counts, signed(hashes), LONG),
                "places": list_array(counts, (chosen - w.words.first[doc]).astype(np.int32), INT),
                "twice": list_array(counts, twice, BOOL),
            }

        return work

    out = map_documents(docs, ["id", "x1", "text", *(["alive"] if narrowed is not None else [])], "text", schema, start)
    if narrowed is not None:
        # Read twice, and texts were joined for it; the first level, which is the largest, is computed twice instead.
        out = settle(out)
    each = out.select("id", "x1", F.explode(F.arrays_zip("hashes", "places", "twice")).alias("w"))
    return each.select("id", "x1", *[F.col(f"w.{n}").alias(m) for n, m in (("hashes", "hash"), ("places", "place"), ("twice", "twice"))])


def _around(w: _Windows, alive: list) -> np.ndarray:
    """Which full windows have their anchor at one of the places that are alive (counted in each text)."""
    marks = np.zeros(len(w.words.start) + 1, bool)
    for first, places in zip(w.words.first, alive):
        marks[first + np.asarray(places, np.int64)] = True
    return marks[w.anchor]


def _windows(candidates: DataFrame, width: int, narrowed: int | None) -> DataFrame:
    """id, x1 and of each candidate window: two hashes, place; of equal ones in a text the first."""
    schema = StructType([
        candidates.schema["id"], StructField("x1", LongType()), StructField("hashes", ArrayType(LongType())),
        StructField("seconds", ArrayType(LongType())), StructField("places", ArrayType(IntegerType())),
    ])

    def start():
        def work(cols):
            w = _Windows(cols["text"], width)
            at, doc = w.at, w.doc
            if narrowed is not None:
                go = _around(_Windows(cols["text"], width, narrowed), cols["alive"])
                at, doc = at[go], doc[go]
            hashes = w.full[at]
            first = _first_in_text(doc, hashes)
            at, doc, hashes = at[first], doc[first], hashes[first]
            counts = np.bincount(doc, minlength=len(cols["text"]))
            return {
                "id": cols["id"], "x1": cols["x1"], "hashes": list_array(counts, signed(hashes), LONG),
                "seconds": list_array(counts, signed(w.second()[at]), LONG),
                "places": list_array(counts, (at - w.words.first[doc]).astype(np.int32), INT),
            }

        return work

    return map_documents(candidates, ["id", "x1", "text", *(["alive"] if narrowed is not None else [])], "text", schema, start)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, x1, x2 (hashes of the text), whole, places: the windows that start in an earlier document.

    ``places`` are window starts in words; ``whole`` marks a later copy of a whole text. Only texts with either have a
    row. Windows repeated inside one text are not listed: the text alone shows them.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (F.length("text") > 0))
    docs = docs.select("id", "text", *text_key(F.col("text")))
    texts = docs.select("id", "x1", "x2")
    firsts = settle(texts.groupBy("x1", "x2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last"))
    copies = settle(texts.join(firsts, ["x1", "x2"]).where("id <> first").select("id", "x1", "x2").distinct())
    candidates, narrowed = docs.select("id", "x1", "text"), None
    for length in levels(width)[:-1]:
        chosen = _level(candidates, width, length, narrowed)
        seen = chosen.groupBy("hash").agg(F.min("x1").alias("lo"), F.max("x1").alias("hi"), F.max("twice").alias("twice"))
        live = settle(seen.where("lo <> hi or twice").select("hash"))
        alive = chosen.join(live, "hash").groupBy("id", "x1").agg(F.collect_set("place").alias("alive"))
        alive = settle(alive.join(copies.select("id", "x1"), ["id", "x1"], "left_anti"))
        candidates, narrowed = docs.select("id", "x1", "text").join(alive, ["id", "x1"]), length
        if alive.isEmpty():
            break
    if narrowed is None:
        candidates = candidates.join(copies.select("id", "x1"), ["id", "x1"], "left_anti")
    windows = settle(_windows(candidates, width, narrowed))
    each = windows.select("id", "x1", F.explode(F.arrays_zip("hashes", "seconds", "places")).alias("w")).select(
        "id", "x1", F.col("w.hashes").alias("hash"), F.col("w.seconds").alias("second"), F.col("w.places").alias("place"))
    origin = each.groupBy("hash", "second").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    origin = settle(origin.where("first <> last").select("hash", "second", "first"))
    later = each.join(origin, ["hash", "second"]).where("id <> first").groupBy("id", "x1").agg(F.collect_set("place").alias("places"))
    whole = copies.select("id", "x1", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("places"))
    return later.select("id", "x1", F.lit(False).alias("whole"), "places").unionByName(whole)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: id, n_words, n_removed and ``kept`` (the words left, joined by one blank).

    Words are split at ASCII blanks and compared as they are. A word goes if a window of ``width`` words around it also
    starts earlier: in a document with a smaller id, or further left in its own. Texts that are null, empty or shorter than a
    window keep their words; very long texts are a step of their own, in whole. Rows without an id are compared with themselves alone; rows that repeat an id are one
    document and don't remove each other. Other columns are left alone; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    found = settle(repeated_windows(docs, id_col, text_col, width))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("x1", F.xxhash64("text")).join(found, ["id", "x1"], "left").select("id", "text", "whole", "places")
    schema = StructType([
        StructField(id_col, docs.schema[id_col].dataType), StructField("n_words", LongType()),
        StructField("n_removed", LongType()), StructField("kept", StringType()),
    ])

    def start():
        def work(cols):
            w = _Windows(cols["text"], width)
            words = w.words
            # Later windows of a text that are equal to an earlier one of the same text.
            again = w.at[~_first_in_text(w.doc, w.full[w.at])] if len(w.at) else w.at
            edges = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(edges, again, 1)
            np.add.at(edges, again + width, -1)
            for first, n, whole, places in zip(words.first, words.counts, cols["whole"], cols["places"]):
                if whole and n >= width:
                    edges[first] += 1
                    edges[first + n] -= 1
                elif places:
                    at = first + np.asarray(places, np.int64)
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + width, -1)
            gone = np.cumsum(edges)[:-1] > 0
            removed = np.bincount(words.doc[gone], minlength=len(words.counts))
            kept = []
            for k, text in enumerate(cols["text"]):
                a, b = words.first[k], words.first[k + 1]
                left = np.flatnonzero(~gone[a:b]) + a
                kept.append(b" ".join([words.bytes[s:e] for s, e in zip(words.start[left].tolist(), words.end[left].tolist())]).decode("utf-8", "surrogatepass"))
            return {id_col: cols["id"], "n_words": words.counts, "n_removed": removed, "kept": kept}

        return work

    return map_documents(rows, ["id", "text", "whole", "places"], "text", schema, start)
