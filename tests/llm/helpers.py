"""Small documents that every operator must survive, and digests for the comparisons."""

import hashlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0):
    """A documents table; texts may be pairs (doc_id, text)."""
    rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, None, None, len(t) if t is not None else None) for i, t in rows], DOCS)


def awkward():
    """Null and empty texts, blanks, line ends, many scripts, null ids, repeated rows, one long text."""
    base = "the quick brown fox jumps over the lazy dog and runs away from all the others in the field "
    return [
        (0, None), (1, ""), (2, " "), (3, "\n\t \r"), (4, "a"), (5, "Ünïcödé ß 漢字 😀 é ΑΣ İ"), (6, base), (7, base),
        (8, base * 30), (8, base * 30), (None, base), (None, None), (9, "x" * 30000), (10, base.upper() + "tail words here"),
        (11, "one two three four"), (12, "one two three four"), (13, "0123456789" * 3000), (14, "  double  blanks \n and\r\nlines  "),
    ]


def sha(data):
    return hashlib.sha256(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data).hexdigest()


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def write(df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
