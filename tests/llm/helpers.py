"""Small document tables and plain re-implementations shared by the tests."""

import random

SF = "/root/testdata/sf0.001"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def documents(spark, rows, parts=None):
    """Rows ``(doc_id, text)`` as a table with the columns of ``documents``
    and extra ones named like operators' own columns."""
    full = [(i, t, "en", "src", len(t or ""), 7, "x", 1.5) for i, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                     "h long, body string, score double")
    return df.repartition(parts) if parts else df


def words(text):
    return (text or "").encode().translate(LOWER).split()


def prose(rng: random.Random, n: int, vocabulary: int = 40) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id at all"),
         (None, "no id at all"), (6, "Line a\nLine b\nLine c\n\nLine d"), (7, "x" * 30000),
         (8, "word " * 20000), (9, "日本語 テキスト ünïcödé 🙂")]
