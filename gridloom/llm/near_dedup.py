"""Near-duplicates: SuperMinHash signatures, banding, verification on the full sets, union-find grouping.

Equal sets are one class from the start. In every bucket of a band each class is compared with the bucket's least class
(a star, not all pairs). Buckets that still hold classes of different components are settled exactly: their classes
are joined on the rarest shingles of each, which any pair over the threshold must share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from gridloom.llm.common import Words, list_array, map_documents, mix, numbered, ready, runs_of_words, signed, text_key
from gridloom.llm.components import components
from gridloom.session import settle

WIDTH = 5
#: 36 bands of 4: a pair at similarity 0.75 shares no band with probability 1.1e-6.
BANDS, ROWS = 36, 4
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def super_min_hash(elements: np.ndarray, owner: np.ndarray, n_owners: int, size: int) -> np.ndarray:
    """Signatures [owner, slot] of sets given as hashes and their owners.

    Every element visits all slots in an order of its own (a permutation drawn step by step) and offers its rank in that
    order plus a random fraction; a slot keeps the least offer. An owner stops as soon as every slot has an offer of a
    lower rank than the next step could make.
    """
    sig = np.full(n_owners * size, EMPTY, np.uint64)

    def draw(hashes, step):
        u = mix(hashes + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = step + ((u >> np.uint64(32)) % np.uint64(size - step)).astype(np.int64)
        return pick, (np.uint64(step) << np.uint64(32)) | (u & np.uint64(0xFFFFFFFF))

    def open_owners():
        return (sig.reshape(n_owners, size) == EMPTY).any(axis=1)

    pick, offer = draw(elements, 0)
    np.minimum.at(sig, owner * size + pick, offer)
    live = open_owners()[owner]
    elements, owner, pick = elements[live], owner[live], pick[live]
    order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(elements), 1))
    order[np.arange(len(elements)), pick] = 0
    for step in range(1, size):
        if not len(elements):
            break
        at = np.arange(len(elements))
        pick, offer = draw(elements, step)
        slot = order[at, pick]
        order[at, pick] = order[at, step]
        np.minimum.at(sig, owner * size + slot, offer)
        live = open_owners()[owner]
        if live.sum() < 0.8 * len(live):
            elements, owner, order = elements[live], owner[live], order[live]
    return sig.reshape(n_owners, size)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles of each text, sorted; fewer words than the width are one shingle."""
    words = Words(texts, lower=True)
    hashes = words.keys()
    runs = runs_of_words(hashes, width)
    inside = np.flatnonzero(words.doc[: len(runs)] == words.doc[width - 1 : width - 1 + len(runs)])
    owner, found = [words.doc[inside]], [runs[inside]]
    for n in range(1, width):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            owner.append(short)
            found.append(runs_of_words(hashes, n)[words.first[short]])
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    return owner[new], found[new]


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """id, n (size of the set), d1 and d2 (a 128-bit digest of the set), keys (one per band)."""
    schema = StructType([
        docs.schema[id_col], StructField("n", LongType()), StructField("d1", LongType()), StructField("d2", LongType()),
        StructField("keys", ArrayType(LongType())),
    ])

    def start():
        def work(cols):
            texts = cols[text_col]
            owner, found = shingle_sets(texts, width)
            counts = np.bincount(owner, minlength=len(texts))
            some = np.flatnonzero(counts)
            digests = np.zeros((2, len(texts)), np.uint64)
            keys = np.zeros((0, bands), np.uint64)
            if len(some):
                starts = np.searchsorted(owner, some)
                for k, salt in enumerate((0x51ED270B, 0xA24BAED4963EE407)):
                    digests[k, some] = np.add.reduceat(mix(found ^ np.uint64(salt)), starts)
                sig = super_min_hash(found, np.searchsorted(some, owner), len(some), bands * rows)
                sig = sig.reshape(len(some), bands, rows)
                keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(some), bands)).copy()
                for r in range(rows):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            return {
                id_col: cols[id_col], "n": counts, "d1": signed(digests[0]), "d2": signed(digests[1]),
                "keys": list_array(np.where(counts > 0, bands, 0), signed(keys.ravel()), pa.int64()),
            }

        return work

    return map_documents(docs, [id_col, text_col], text_col, schema, start, limit=1 << 19)


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, hashes (the sorted set as bytes)."""
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("hashes", BinaryType())])

    def start():
        def work(cols):
            owner, found = shingle_sets(cols[text_col], width)
            bounds = np.searchsorted(owner, np.arange(len(cols[text_col]) + 1))
            return {"id": cols[id_col], "hashes": [found[s:e].tobytes() for s, e in zip(bounds, bounds[1:])]}

        return work

    return map_documents(docs, [id_col, text_col], text_col, schema, start)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("of_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("hashes").alias("of_b")), "b").select("a", "b", "of_a", "of_b")
    schema = both.select("a", "b").schema

    def check(batches):
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                same = np.searchsorted(x, y, side="right") - np.searchsorted(x, y)
                common = int(same.sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(good, pa.int64()))

    return both.mapInArrow(check, schema)


def _leftover_pairs(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that could still reach the similarity; none of them is left out.

    Two sets over the threshold share one of the (size - least overlap + 1) rarest shingles of each, whatever order
    rarity gives them, and the first one that they share leaves enough of both behind it. Shingles common to a whole group
    of copies come last, so they rarely take part.
    """
    schema = StructType([*groups.schema, StructField("n", LongType()), StructField("shingle", LongType())])
    joined = groups.join(sets, "id").select(*groups.columns, "hashes")

    def spread(batches):
        for batch in batches:
            ids = np.arange(batch.num_rows)
            found = [np.frombuffer(h.as_buffer(), np.int64) for h in batch.column(batch.num_columns - 1)]
            for lo in range(0, len(ids), 256):
                part = found[lo : lo + 256]
                sizes = np.array([len(f) for f in part])
                rows = pa.array(np.repeat(ids[lo : lo + 256], sizes))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(rows) for c in range(batch.num_columns - 1)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(part))],
                    names=schema.names)

    items = settle(joined.mapInArrow(spread, schema))
    seen = items.groupBy("shingle").agg(
        F.count("*").alias("df"), (F.min("component") != F.max("component")).alias("mixed"))
    # Unique shingles are never joined back: they are first in the order, and only their number counts.
    shared = items.join(settle(seen.where("df > 1")), "shingle")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "shingle"))
    total = F.count("*").over(Window.partitionBy("id"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1
    kept = shared.select("id", "component", "n", "shingle", "mixed", (rank + F.col("n") - total).alias("rank")).where(
        (F.col("rank") <= prefix) & F.col("mixed"))
    kept = settle(kept.select("id", "component", "n", "shingle", (F.col("n") - F.col("rank") + 1).alias("left")))
    other = kept.select(*[F.col(c).alias(f"{c}_b") for c in kept.columns])
    # If this is the first shingle that both share, they share at most what is left of the shorter rest.
    reachable = (100 + percent) * F.least("left", "left_b") >= percent * (F.col("n") + F.col("n_b"))
    met = kept.join(other, (F.col("shingle") == F.col("shingle_b")) & (F.col("component") < F.col("component_b")) & reachable)
    return met.select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
    bands: int = BANDS, rows: int = ROWS, width: int = WIDTH,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept (its id is the component's least).

    Words are split at ASCII blanks, A-Z in lower case; a set is the distinct runs of ``width`` words. Sets are linked if
    100 * intersection >= percent * union. Texts that are null or without words have an empty set and link with nothing.
    Rows without an id are linked with nothing either: component null, kept. Rows that repeat an id are one document.
    Other columns are left alone; an empty table gives an empty result.
    """
    spark = ready(docs.sparkSession)
    if {"n", "d1", "d2", "keys"} & {id_col, text_col}:
        docs, id_col, text_col = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text"
    docs = docs.select(id_col, text_col)
    sigs = settle(signatures(docs, id_col, text_col, bands, rows, width))
    linkable = sigs.where((F.col("n") > 0) & F.col(id_col).isNotNull())
    classes = settle(linkable.groupBy("d1", "d2", "n").agg(F.min(id_col).alias("class")))
    # Only a class's first document goes on; its copies are looked up at the end.
    firsts = linkable.join(classes.withColumnRenamed("class", id_col), [id_col, "d1", "d2", "n"], "left_semi")
    keyed = settle(firsts.select(F.col(id_col).alias("id"), F.explode("keys").alias("key")))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a <> last").select("key", "a")
    members = settle(keyed.join(settle(buckets), "key"))
    pairs = settle(members.where("id <> a").select("a", F.col("id").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("_wanted")).union(pairs.select("b")).distinct()
    # Always by shuffle: the wanted ids grow with the table.
    wanted = wanted.hint("merge")
    sets = settle(_sets(docs.join(wanted, F.col(id_col) == F.col("_wanted"), "left_semi"), id_col, text_col, width))
    links = settle(_verify(pairs, sets, percent))
    labels = components(links)
    # Of a bucket everything was compared with its least class; only the others can hide a link from each other.
    placed = members.where("id <> a").select("id", "key").join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "id", "key", F.coalesce("component", "id").alias("component"))
    placed = settle(placed)
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    open_ = settle(placed.join(settle(mixed.select("key")), "key", "left_semi").select("id", "component").distinct())
    if not open_.isEmpty():
        more = settle(_verify(_leftover_pairs(sets, open_, percent), sets, percent))
        if not more.isEmpty():
            # Components found so far act as single nodes: their links to their least class replace all others.
            known = labels.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b")
            labels = components(known.union(more.select("a", "b")))
    grouped = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").select(
        "d1", "d2", "n", F.coalesce("component", "class").alias("component_id"))
    out = sigs.join(grouped, ["d1", "d2", "n"], "left")
    own = F.col(id_col)
    component = F.when((F.col("n") > 0) & own.isNotNull(), F.col("component_id")).otherwise(own)
    return out.select(own, F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(own == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows, with all their columns, of the document with the least id of each group of near-copies.

    Rows that link with nothing stay, those with a null or empty text or a null id included. Of rows that repeat an id (or have
    none) and a text, one stays, the least in the other columns. Other columns may have any name; texts of any length; an empty
    table gives an empty result.
    """
    names = docs.columns
    plain, (own_id, own_text) = numbered(docs, id_col, text_col)
    found = near_duplicates(plain.select(F.col(own_id).alias("doc_id"), F.col(own_text).alias("text")), percent=percent)
    gone = settle(found.where("not kept").select(F.col("doc_id").alias(own_id)).distinct())
    return _once(plain, own_id, own_text).join(gone, own_id, "left_anti").select(*plain.columns).toDF(*names)


def _once(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per id and text, the least in the other columns."""
    key = ["_id", "_x1", "_x2"]
    keyed = docs.where(F.col(text_col).isNotNull()).select(
        "*", F.col(id_col).alias("_id"), *[c.alias(n) for c, n in zip(text_key(F.col(text_col)), key[1:])])
    again = settle(keyed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in key]))
    if again.isEmpty():
        return docs
    same = F.col("_id").eqNullSafe(F.col("__id")) & (F.col("_x1") == F.col("__x1")) & (F.col("_x2") == F.col("__x2"))
    least = F.min(F.struct(*docs.columns)).alias("row")
    one = keyed.join(again, same, "left_semi").groupBy(*key).agg(least).select("row.*")
    single = keyed.join(again, same, "left_anti").select(*docs.columns)
    return docs.where(F.col(text_col).isNull()).union(single).union(one)
