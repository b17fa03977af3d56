"""Repeated byte strings by a depth-limited radix sort of suffixes, most significant digits first.

Only the order of suffixes through ``width`` bytes matters: suffixes that are still equal there start a repeated string.
Passes go from coarse to fine, and a group of one suffix drops out:

1. Every suffix is represented by an anchor inside its first ``width`` bytes: the place of the least hash of ``gram``
   bytes, a choice that equal strings make alike. Suffixes with one anchor form a segment. First digit: the anchor's gram.
2. Second digit: the whole segment. Segments seen twice are repeated throughout; one of them stays as a partner.
3. The other segments of a gram meet in one task, where their suffixes are sorted digit by digit (``DIGIT`` bytes each,
   compared by hash) through ``width`` bytes.
4. Grams with more than ``LARGEST_GROUP`` different segments would crowd a task. Their suffixes are taken in blocks of
   neighbours, and Spark counts two keys of each block: the bytes that all its suffixes have in common (seen once: none of
   them is repeated) and all their bytes (seen twice: all are). Only blocks in between are split and go on, down to single
   suffixes.

Texts are known by two hashes, so that copies of a text are one text here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from gridloom.llm.common import Rolling, anchors, list_array, map_documents, mix, numbered, ready, signed, text_key, tidy
from gridloom.session import settle

WIDTH, GRAM, DIGIT = 400, 96, 50
LARGEST_GROUP = 200
#: Bytes that one local sort works on, whole groups at a time; some twenty numbers are held for each.
SORT_BYTES = 1 << 18
#: Characters of text whose segments are found in one step.
SEGMENT_BYTES = 1 << 18
TEXT = [StructField("x1", LongType()), StructField("x2", LongType())]


class _Segments:
    """Segments of several texts: runs of suffixes that share an anchor. Places are offsets in the joined bytes."""

    def __init__(self, texts: list[str | None], width: int, gram: int):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.hashes = Rolling(self.data)
        starts = np.arange(max(0, len(self.data) - width + 1))
        doc = np.repeat(np.arange(len(raw)), sizes)[: len(starts)]
        at = starts[starts + width <= self.bounds[doc + 1]]
        grams = self.hashes.windows(gram)
        anchor = anchors(grams, width - gram + 1)[at] if len(at) else at
        doc = doc[at]
        first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        last = np.append(first[1:], len(at)) - 1
        self.lo, self.hi, self.doc = at[first], at[last] if len(at) else at, doc[first]
        place = anchor[first]
        self.gram = grams[place] if len(at) else place.astype(np.uint64)
        # Equal segments must also have their anchor at the same place.
        self.key = mix(self.hashes.ranges(self.lo, self.hi + width) + (place - self.lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _segments(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """One row per segment: x1, x2, id, gram, key, start, suffixes, twice (its text holds it twice)."""
    schema = StructType([
        *TEXT, docs.schema["id"], *[StructField(n, ArrayType(LongType())) for n in ("grams", "keys")],
        *[StructField(n, ArrayType(IntegerType())) for n in ("starts", "counts")], StructField("twice", ArrayType(BooleanType())),
    ])

    def start():
        def work(cols):
            s = _Segments(cols["text"], width, gram)
            order = np.lexsort((s.key, s.doc))
            same = (s.doc[order][1:] == s.doc[order][:-1]) & (s.key[order][1:] == s.key[order][:-1])
            twice = np.zeros(len(order), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            n = np.bincount(s.doc, minlength=len(cols["text"]))
            return {
                "x1": cols["x1"], "x2": cols["x2"], "id": cols["id"], "grams": list_array(n, signed(s.gram), pa.int64()),
                "keys": list_array(n, signed(s.key), pa.int64()),
                "starts": list_array(n, (s.lo - s.bounds[s.doc]).astype(np.int32), pa.int32()),
                "counts": list_array(n, (s.hi - s.lo + 1).astype(np.int32), pa.int32()), "twice": list_array(n, twice, pa.bool_()),
            }

        return work

    out = map_documents(docs, ["x1", "x2", "id", "text"], "text", schema, start, limit=SEGMENT_BYTES)
    each = out.select("x1", "x2", "id", F.explode(F.arrays_zip("grams", "keys", "starts", "counts", "twice")).alias("s"))
    return each.select("x1", "x2", "id", *[F.col(f"s.{n}").alias(m) for n, m in (
        ("grams", "gram"), ("keys", "key"), ("starts", "start"), ("counts", "n"), ("twice", "twice"))])


def _contents(docs: DataFrame, width: int) -> DataFrame:
    """Of every wanted segment: gram, x1, x2, start, single, crowded and its bytes."""
    schema = StructType([
        StructField("gram", LongType()), *TEXT, StructField("start", IntegerType()), StructField("single", BooleanType()),
        StructField("crowded", BooleanType()), StructField("bytes", BinaryType()),
    ])

    def start():
        def work(cols):
            out = {f.name: [] for f in schema}
            for x1, x2, text, wanted in zip(cols["x1"], cols["x2"], cols["text"], cols["wanted"]):
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    s, n = w["start"], w["n"]
                    for name, v in zip(out, (w["gram"], x1, x2, s, w["single"], w["crowded"], raw[s : s + n - 1 + width])):
                        out[name].append(v)
            return out

        return work

    return map_documents(docs, ["x1", "x2", "text", "wanted"], "text", schema, start)


def equal_suffixes(data: np.ndarray, starts: np.ndarray, width: int, digit: int = DIGIT) -> np.ndarray:
    """Indices into ``starts`` of the suffixes that equal another one through ``width`` bytes.

    A radix sort, most significant digit first: each pass orders every group by its next digit and splits it; groups of
    one are finished. ``starts`` are offsets in ``data`` with ``width`` bytes behind each.
    """
    hashes = Rolling(data)
    live, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in range(0, width, digit):
        if not len(live):
            break
        at = starts[live] + depth
        key = hashes.ranges(at, at + min(digit, width - depth))
        order = np.lexsort((key, group))
        live, group, key = live[order], group[order], key[order]
        new = np.ones(len(live) + 1, bool)
        new[1:-1] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        several = ~(new[:-1] & new[1:])
        group = np.cumsum(new[:-1])
        live, group = live[several], group[several]
    return live


def _sorted_locally(segments: DataFrame, width: int) -> DataFrame:
    """x1, x2, start, end of the strings found by sorting the suffixes of whole grams in one task."""
    schema = StructType([*TEXT, StructField("start", IntegerType()), StructField("end", IntegerType())])

    def solve(part):
        sizes = np.array([len(b) for b in part["bytes"]], np.int64)
        begin = np.cumsum(sizes) - sizes
        n = sizes - width + 1
        owner = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        found = np.sort(equal_suffixes(np.frombuffer(b"".join(part["bytes"]), np.uint8), begin[owner] + offset, width))
        found = found[np.asarray(part["single"])[owner[found]]]
        # Neighbouring suffixes of a segment are one range.
        cut = np.flatnonzero((np.diff(owner[found], prepend=-1) != 0) | (np.diff(offset[found], prepend=-9) != 1))
        last = np.append(cut[1:], len(found)) - 1
        seg = owner[found[cut]]
        base = np.asarray(part["start"], np.int64)[seg]
        pick = pa.array(seg)
        return pa.RecordBatch.from_arrays([
            pa.array(part["x1"], pa.int64()).take(pick), pa.array(part["x2"], pa.int64()).take(pick),
            pa.array((base + offset[found[cut]]).astype(np.int32)),
            pa.array((base + offset[found[last]] + width).astype(np.int32) if len(cut) else np.zeros(0, np.int32)),
        ], names=schema.names)

    def run(batches):
        names = ("gram", "x1", "x2", "start", "single", "bytes")
        part, size = {n: [] for n in names}, 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(names)))):
                if size >= SORT_BYTES and row[0] != part["gram"][-1]:
                    yield solve(part)
                    part, size = {n: [] for n in names}, 0
                for n, v in zip(names, row):
                    part[n].append(v)
                size += len(row[-1])
        if part["gram"]:
            yield solve(part)
        part.clear()
        tidy(set())

    rows = segments.select("gram", "x1", "x2", "start", "single", "bytes").repartition(F.col("gram"))
    return rows.sortWithinPartitions("gram").mapInArrow(run, schema)


def block_sizes(width: int) -> list[int]:
    """Sizes of blocks of suffixes from coarse to single ones; suffixes of one block always share bytes."""
    sizes = [1]
    while sizes[0] * 8 <= width // 4:
        sizes.insert(0, sizes[0] * 8)
    return sizes


def _block_keys(segments: DataFrame, width: int, gram: int, size: int) -> DataFrame:
    """x1, x2, start, single, block, first, n, core, full: the blocks of each segment that lie in one of its ``open`` ranges.

    Blocks are aligned to the anchor, so equal suffixes are in equal blocks. ``first`` counts suffixes from the segment's start.
    """
    schema = StructType([
        *TEXT, StructField("start", IntegerType()), StructField("single", BooleanType()), StructField("first", IntegerType()),
        StructField("n", IntegerType()), StructField("core", LongType()), StructField("full", LongType()),
    ])

    def run(batches):
        for batch in batches:
            parts = []
            for x1, x2, s, single, content, ranges in zip(*(batch.column(i).to_pylist() for i in range(6))):
                hashes = Rolling(np.frombuffer(content, np.uint8))
                anchor = int(anchors(hashes.windows(gram)[: width - gram + 1], width - gram + 1)[0])
                count = len(content) - width + 1
                at = np.arange(count)
                if ranges is not None:
                    inside = np.zeros(count, bool)
                    for r in ranges:
                        inside[r["first"] : r["first"] + r["n"]] = True
                    at = at[inside]
                block = (anchor - at) // size
                edge = np.flatnonzero(np.diff(block, prepend=block[0] + 1)) if len(at) else at
                first, last = at[edge], at[np.append(edge[1:], len(at)) - 1] if len(at) else at
                block = block[edge]
                # What every suffix of the whole block has, wherever this segment starts.
                low, high = anchor - block * size, anchor - (block + 1) * size + 1 + width
                place = (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                full = mix(hashes.ranges(first, last + width) + place)
                core = mix(hashes.ranges(low, high) + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                parts.append((np.full(len(block), x1), np.full(len(block), x2), np.full(len(block), s, np.int32), np.full(len(block), single),
                              first.astype(np.int32), (last - first + 1).astype(np.int32), signed(core), signed(full)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=schema.names)
        tidy(set())

    return segments.select("x1", "x2", "start", "single", "bytes", "open").mapInArrow(run, schema)


def _counted(segments: DataFrame, width: int, gram: int) -> DataFrame:
    """x1, x2, start, end of the strings found in crowded grams: no group ever meets in a task."""
    key = ["x1", "x2", "start"]
    nothing = F.lit(None).cast("array<struct<first:int,n:int>>")
    todo, found = segments.withColumn("open", nothing), None
    for size in block_sizes(width):
        keys = settle(_block_keys(todo, width, gram, size))
        fulls = keys.groupBy("full").agg(F.count("*").alias("seen"), F.min("x1").alias("partner"))
        cores = keys.groupBy("core").agg((F.min("full") != F.max("full")).alias("mixed"), F.count("*").alias("sharing")).where("sharing > 1")
        keys = keys.join(settle(cores.select("core", "mixed")), "core").join(settle(fulls.where("seen > 1")), "full", "left")
        keys = settle(keys.select(*key, "single", "first", "n", "mixed", "seen", "partner"))
        begin = F.col("start") + F.col("first")
        done = keys.where("seen > 1 and single").select("x1", "x2", begin.alias("start"), (begin + F.col("n") - 1 + width).alias("end"))
        found = done if found is None else found.union(done)
        if size > 1:
            # Blocks that differ under a common core are split; of equal ones a partner for the others is enough.
            left = keys.where("mixed and (seen is null or x1 = partner)")
            left = settle(left.groupBy(*key).agg(F.collect_list(F.struct("first", "n")).alias("open")))
            todo = segments.join(left, key)
    return found


def repeated_strings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM,
    largest_group: int | None = None,
) -> DataFrame:
    """x1, x2 (hashes of the text), whole, ranges: the bytes covered by strings of ``width`` bytes that start twice.

    ``whole`` marks texts that several rows have. Ranges are (start, end) in UTF-8 bytes and may overlap. Only texts with
    either have a row.
    """
    largest_group = LARGEST_GROUP if largest_group is None else largest_group
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") >= width)
    docs = docs.select("id", *text_key(F.col("text")), "text")
    segments = _segments(docs, width, gram)
    seen = segments.groupBy("gram", "key").agg(F.min("x1").alias("lo"), F.max("x1").alias("hi"), F.max("twice").alias("twice"))
    seen = settle(seen.select("gram", "key", (F.col("twice") | (F.col("lo") != F.col("hi"))).alias("repeated")))
    grams = seen.groupBy("gram").agg(F.count("*").alias("kinds"), F.max("repeated").alias("some")).where("kinds > 1 or some")
    grams = settle(grams.select("gram", "kinds"))
    live = settle(seen.join(grams, "gram").select("gram", "key", "repeated", "kinds"))
    marked = settle(segments.join(live, ["gram", "key"]).select("x1", "x2", "id", "gram", "start", "n", "repeated", "kinds", "key"))
    # Of a repeated segment in a gram with others one is enough as a partner, also where one text holds it many times.
    partner = marked.where("repeated and kinds > 1").groupBy("gram", "key").agg(F.min(F.struct("x1", "start")).alias("p"))
    partner = settle(partner.select("gram", "key", "p.*"))
    wanted = marked.where("not repeated and kinds > 1").select("x1", "x2", "id", "gram", "start", "n", "kinds", F.lit(True).alias("single")).union(
        marked.where("repeated and kinds > 1").join(partner, ["gram", "key", "x1", "start"]).select("x1", "x2", "id", "gram", "start", "n", "kinds", F.lit(False)))
    item = F.struct("gram", "start", "n", "single", (F.col("kinds") > largest_group).alias("crowded"))
    lists = settle(wanted.groupBy("x1", "x2").agg(F.min("id").alias("first"), F.collect_set(item).alias("wanted")))
    texts = docs.join(lists, ["x1", "x2"]).where(F.col("id").eqNullSafe(F.col("first"))).select("x1", "x2", "text", "wanted")
    contents = settle(_contents(texts, width))
    local = _sorted_locally(contents.where("not crowded"), width)
    resolved = marked.where("repeated").select("x1", "x2", "start", (F.col("start") + F.col("n") - 1 + width).alias("end"))
    found = resolved.union(local)
    if not contents.where("crowded").isEmpty():
        found = found.union(_counted(contents.where("crowded"), width, gram))
    ranges = found.groupBy("x1", "x2").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    copies = docs.groupBy("x1", "x2").agg(F.count("*").alias("n")).where("n > 1").select("x1", "x2", F.lit(True).alias("whole"))
    return ranges.join(copies, ["x1", "x2"], "full").select("x1", "x2", F.coalesce("whole", F.lit(False)).alias("whole"), "ranges")


def _joined(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """The rows with ``_whole`` and ``_ranges`` of their text."""
    x1, x2 = text_key(F.col(text_col))
    found = found.select(*[F.col(c).alias(f"_{c}") for c in ("x1", "x2", "whole", "ranges")])
    return docs.join(found, (x1 == F.col("_x1")) & (x2 == F.col("_x2")), "left").drop("_x1", "_x2")


def _cut(raw: bytes, whole: bool | None, ranges: list | None) -> tuple[list[bytes], int]:
    """What is left of the bytes between the spans, and the number of spans (ranges that touch are one)."""
    if whole:
        return [], 1
    parts, last, spans = [], 0, 0
    for s, e in sorted((r["start"], r["end"]) for r in ranges or ()):
        if s > last or not spans:
            parts.append(raw[last:s])
            spans += 1
        last = max(last, e)
    return [*parts, raw[last:]], spans


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM,
    largest_group: int | None = None,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans and ``kept`` (the bytes left, as binary).

    A byte of the UTF-8 text goes if a string of ``width`` bytes around it also starts anywhere else, in the same text or
    another; every occurrence goes. Strings don't cross rows. Null texts are empty; rows that repeat a text, with whatever
    id, are copies of each other; null ids stay null. Other columns are left alone; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    found = settle(repeated_strings(docs, id_col, text_col, width, gram, largest_group))
    rows = _joined(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), found, "text")
    schema = StructType([
        StructField(id_col, docs.schema[id_col].dataType), StructField("n_bytes", LongType()),
        StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept", BinaryType()),
    ])

    def start():
        def work(cols):
            out = {name: [] for name in ("n_bytes", "n_removed", "n_spans", "kept")}
            for text, whole, ranges in zip(cols["text"], cols["_whole"], cols["_ranges"]):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                parts, spans = _cut(raw, whole, ranges)
                kept = b"".join(parts)
                for name, value in zip(out, (len(raw), len(raw) - len(kept), spans, kept)):
                    out[name].append(value)
            return out | {id_col: cols["id"]}

        return work

    return map_documents(rows, ["id", "text", "_whole", "_ranges"], "text", schema, start)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The same rows and columns with repeated strings cut out of the text.

    A character that a cut would split goes as a whole. Null texts stay null, null ids are ids like others, rows that repeat a
    text are copies of each other, other columns may have any name; very long texts are a step of their own; an empty table
    gives an empty result.
    """
    ready(docs.sparkSession)
    schema, names = docs.schema, docs.columns
    plain, (own_id, own_text) = numbered(docs, id_col, text_col)
    own = plain.columns
    rows = _joined(plain, settle(repeated_strings(plain, own_id, own_text, width, gram)), own_text)

    def start():
        def work(cols):
            texts = []
            for text, whole, ranges in zip(cols[own_text], cols["_whole"], cols["_ranges"]):
                if text and (whole or ranges):
                    parts, _ = _cut(text.encode("utf-8", "surrogatepass"), whole, ranges)
                    text = "".join(p.decode("utf-8", "ignore") for p in parts)
                texts.append(text)
            return {n: cols[n] for n in own} | {own_text: texts}

        return work

    kept = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(own, schema)])
    return map_documents(rows, [*own, "_whole", "_ranges"], own_text, kept, start).toDF(*names)
