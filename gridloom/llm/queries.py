"""The registered queries: each applies one operator to its whole table and derives digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import ann, bpe, chat, exact_topk, near_dedup, packing, pii, prefix_trie, quality, secrets, substring_dedup, suffix_dedup, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str):
    def put(fn):
        QUERIES[key] = fn
        return fn

    return put


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts per base kind, the hash of the base spans and the list of all spans."""
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in kinds]
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
    )


def vocabulary(name: str):
    """Where a worker finds a public vocabulary file."""

    def find() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return find


@register("op4_secrets")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return span_digest(secrets.find_secrets(table(spark, folder, "documents")), secrets.BASE_KINDS)


@register("op6_bpe")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode_and_decode(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register("op10_pii")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return span_digest(pii.find_pii(table(spark, folder, "documents")), pii.BASE_KINDS)


@register("op5_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("op7_near_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@register("op9_substring_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op1_suffix_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op3_quality")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit_quality(docs, table(spark, folder, "labels"))
    return quality.score_quality(docs, model).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op2_ann")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, top=10)


@register("op8_exact_topk")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return exact_topk.largest_products(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, top=5)


@register("op12_chat_format")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    given = chat.table_turns(table(spark, folder, "conversations"), "conv_id", "turn")
    # One more conversation, in another layout, that says what the template must not take for its own.
    said = F.lit("</s>[INST] ok [/INST]").alias("content")
    messages = F.array(*[F.struct(F.lit(role).alias("role"), said) for role in ("user", "assistant")])
    more = chat.table_turns(spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), messages.alias("messages")), "conv_id")
    turns = given.withColumn("extra", F.lit(False)).unionByName(more.withColumn("extra", F.lit(True)))
    made = chat.format_chats(turns, ("conv_id", "extra"))
    back = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                       F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "").alias("learned"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_length_sql(text: str) -> str:
    """Code points of an escaped text: one more for each backslash and each control string."""
    controls = "|".join("".join("\\" + c if not c.isalnum() else c for c in s) for s in chat.CONTROLS)
    return f"length({text}) + length({text}) - length(replace({text}, '\\', '')) + len(regexp_extract_all({text}, '{controls}'))"


ORACLES["op12_chat_format"] = f"""
WITH turns AS (
    SELECT conv_id, false AS extra, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -1, true, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), whole AS (
    SELECT conv_id, extra, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS listed,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
           sum({len(chat.START + chat.SEPARATOR + chat.END)} + {_escaped_length_sql("role")} + {_escaped_length_sql("text")}) AS n
    FROM turns GROUP BY conv_id, extra
)
SELECT conv_id, n_turns, sha256(listed) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(n AS BIGINT) AS formatted_chars
FROM whole
"""

@register("op11_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    made = whitening.whiten(table(spark, folder, "embeddings"))
    return made.withColumn("deviation", F.col("deviation").try_cast("long"))


@register("op13_prefix_trie")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


# The checksum byte by byte and bit by bit, since DuckDB has no function for it.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))))"""

ORACLES["op13_prefix_trie"] = f"""
WITH given AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT c, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text) AS t, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, turn FROM given
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, t) AS k FROM own
), ids AS (
    SELECT c, c - c % 20 AS base, {_CRC_SQL.format("c")} % 4 AS h FROM (SELECT DISTINCT c FROM own)
), rebuilt AS (
    SELECT i.c, 0 AS zone, p.k, p.t, p.words FROM ids i JOIN placed p ON p.c = i.base AND p.k <= i.h
    UNION ALL
    SELECT i.c, 1, p.k, p.t, p.words FROM ids i JOIN placed p ON p.c = i.c AND p.k > i.h
), turns AS (
    SELECT c, t, words, row_number() OVER (PARTITION BY c ORDER BY zone, k) AS d FROM rebuilt
), paths AS (
    SELECT c, d, words, sha256(string_agg(t, '') OVER (PARTITION BY c ORDER BY d)) AS p FROM turns
    UNION ALL
    SELECT c, 0, 0, '' FROM ids
), nodes AS (
    SELECT d, p, min(c) AS conv_id, count(*) AS n, min(words) AS words FROM paths GROUP BY d, p
), parents AS (
    SELECT n.d, n.p, o.p AS parent, m.conv_id AS parent_conv_id
    FROM nodes n JOIN paths o ON o.c = n.conv_id AND o.d = n.d - 1 JOIN nodes m ON m.d = o.d AND m.p = o.p
), children AS (
    SELECT d - 1 AS d, parent AS p, count(*) AS k FROM parents GROUP BY ALL
), sums AS (
    SELECT a.d, a.p, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (WHERE k.k IS NULL) AS leaves
    FROM nodes n JOIN paths a ON a.c = n.conv_id AND a.d <= n.d LEFT JOIN children k ON k.d = n.d AND k.p = n.p GROUP BY a.d, a.p
), ends AS (
    SELECT d, p, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ids
    FROM (SELECT c, d, p, max(d) OVER (PARTITION BY c) AS m FROM paths) WHERE d = m GROUP BY d, p
)
SELECT n.conv_id, n.d AS depth, r.parent_conv_id, n.n AS n_convs, coalesce(k.k, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ids, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN parents r ON r.d = n.d AND r.p = n.p LEFT JOIN children k ON k.d = n.d AND k.p = n.p
JOIN sums s ON s.d = n.d AND s.p = n.p LEFT JOIN ends e ON e.d = n.d AND e.p = n.p
"""

ORACLES["op8_exact_topk"] = """
WITH good AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM good q JOIN good c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# Words as the operators split them, from whole texts.
_WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES["op9_substring_dedup"] = f"""
WITH docs AS (
    SELECT doc_id, {_WORDS_SQL.format("coalesce(text, '')")} AS words FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS window_text
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM docs WHERE len(words) >= 20)
), later AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY window_text ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), removed AS (
    SELECT doc_id, list(DISTINCT place) AS places FROM (SELECT doc_id, unnest(range(i, i + 20)) AS place FROM later) GROUP BY doc_id
), split AS (
    SELECT d.doc_id, d.words, r.places,
           CASE WHEN r.places IS NULL THEN d.words
                ELSE list_transform(list_filter(range(1, len(d.words) + 1), lambda k: NOT list_contains(r.places, k)), lambda k: d.words[k]) END AS kept
    FROM docs d LEFT JOIN removed r ON d.doc_id = r.doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(kept) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM split
"""

ORACLES["op7_near_dedup"] = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, {_WORDS_SQL.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words
    FROM documents
), sets AS (
    SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM docs WHERE len(words) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id, doc_id AS other FROM docs
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a
), groups AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM docs d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN groups g ON d.doc_id = g.doc_id
"""
