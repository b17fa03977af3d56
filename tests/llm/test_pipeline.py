import random
from collections import Counter

import corpus_pipeline as pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import packing, pii
from tests.llm import test_near_dedup, test_suffix_dedup
from tests.llm.helpers import DOCS, awkward, documents, write
from tests.llm.test_quality import made


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def corpus():
    """Good and bad documents, near copies, shared passages, personal data."""
    r = random.Random(9)
    docs = made(150)
    passage = " ".join("".join(r.choice(["ba", "ke", "li", "mo", "tu", "sar"]) for _ in range(r.randrange(1, 4))) for _ in range(110))
    out = [(i, t) for i, t, _ in docs]
    out += [(1000 + i, t) for i, t in enumerate(test_near_dedup.family(20, 120, 8, 8))]
    out += [(2000 + i, f"call +44 20 7946 {1000 + i} {out[i][1]} {passage} {out[i][1][:9]} é{passage}") for i in range(1, 90, 6)]
    return out, [(i, y, 0) for i, _, y in docs]


def test_stages(spark, tmp_path):
    texts, labels = corpus()
    folder = write(documents(spark, [*texts, *[(5000 + (i or 0), t) for i, t in awkward()]]), tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    good = pipeline.keep_quality(spark, docs, folder).cache()
    assert good.columns == docs.columns and not as_rows(good) - as_rows(docs)
    kept = {r.doc_id for r in good.collect()}
    truth = {i: y for i, y, _ in labels}
    assert all((i in kept) == bool(y) for i, y in truth.items())

    one = pipeline.keep_one_of_near_copies(spark, good, folder).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    want = [x[0] for x in test_near_dedup.brute(rows) if x[3]]
    assert sorted(r.doc_id for r in one.collect()) == sorted(want) and not as_rows(one) - as_rows(good)

    cut = pipeline.cut_repeated_strings(spark, one, folder).cache()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    brute = {x[0]: x for x in test_suffix_dedup.brute(rows, pipeline.REPEAT_BYTES)}
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and len(got) == len(rows) and any(x[2] for x in brute.values())
    for i, t in rows:
        lost = len((t or "").encode()) - len((got[i].text or "").encode())
        assert brute[i][2] <= lost <= brute[i][2] + 6 * brute[i][3]
        assert (got[i].text is None) == (t is None) and got[i].n_chars == (None if t is None else len(got[i].text))

    clean = pipeline.redact_personal_data(spark, cut, folder).cache()
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert not any(s[3] >= pii.KEEP_AT for r in clean.collect() for s in pii.spans_of(r.text))
    assert any("[PHONE]" in (r.text or "") for r in clean.collect())

    packed = pipeline.pack_sequences(spark, clean, folder).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter((r.doc_id, k, s, n) for r in clean.collect()
                     for k, (s, n) in enumerate(packing.cut(len(library.encode(r.text or "").ids) + 1)))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in packed) == pieces

    whole = pipeline.run(spark, folder)
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_repeated_rows_stay_once(spark, tmp_path):
    """A long text delivered twice under one id, or under none, is no copy of itself."""
    texts, labels = corpus()
    # Good texts that only these rows hold.
    good = [t for i, t, y in made(400, 77) if y]
    one, two, three = (" ".join(good[i * 20 : i * 20 + 20]) for i in range(3))
    assert all(len(t.encode()) >= 400 for t in (one, two, three))
    extra = [(9000, one), (9000, one), (None, two), (None, two), (None, two), (9002, three), (None, None), (None, None)]
    folder = write(documents(spark, [*texts[:150], *extra]), tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = pipeline.keep_one_of_near_copies(spark, docs, folder)
    assert stage.columns == docs.columns and stage.where("doc_id is null and text is null").count() == 2
    for stage in (pipeline.keep_quality, pipeline.keep_one_of_near_copies):
        docs = stage(spark, docs, folder).cache()
    kept = Counter((r.doc_id, r.text) for r in docs.collect() if r.text in (one, two, three))
    assert kept == Counter([(9000, one), (None, two), (9002, three)])
    cut = Counter((r.doc_id, r.text) for r in pipeline.cut_repeated_strings(spark, docs, folder).collect())
    assert all(cut[x] == 1 for x in kept)


def test_no_base_span_goes_on(spark, tmp_path):
    texts = ["ann@mail7.example.com The of, onrely +1 (068) 555-2748", "example 10.0.0.1", "version +44 20 7946 0958", None, "clean"]
    docs = documents(spark, texts)
    clean = pipeline.redact_personal_data(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in clean) == list(range(len(texts)))
    assert not any(base for r in clean for *_, base in pii.spans_of(r.text))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in clean)


def test_stages_on_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    folder = write(empty, tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, folder).count() == 0
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "suffix-array dedup", "PII", "best-fit packing"]


def test_columns_with_clashing_names(spark, tmp_path):
    """Columns that the operators use for themselves pass through every stage untouched."""
    texts, labels = corpus()
    extra = ["_x1", "_x2", "_whole", "_ranges", "x1", "x2", "_doc_id", "_id", "row", "c0", "id", "n", "keys", "component", "kept", "score", "spans", "a.b"]
    docs = documents(spark, [*texts[:60], *texts[-30:], *awkward()])
    docs = docs.withColumns({name: F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for name in extra})
    folder = write(docs.select("doc_id", "text", "lang", "source", "n_chars"), tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns[5:] == extra and docs.count()
        for r in docs.collect():
            assert all(v == f"{name}{'-' if r[0] is None else r[0]}" for name, v in zip(extra, list(r)[5:]))
    assert pipeline.STAGES[-1][1](spark, docs, folder).count() >= docs.count()
