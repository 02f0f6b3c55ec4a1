"""Small tables with what the text operators have to stand: nulls, ties, repeats, long texts, odd columns."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside; they must neither break nor be lost.
CLASHES = ("row", "_row", "h", "c", "fp", "key", "digest", "shard", "part", "size", "range", "taken", "kept", "n", "a", "b", "ref")

PROSE = "the cat sat on a mat and the dog ran to the sea while all of us were in town for a day"


def prose(n: int, salt: str = "") -> str:
    words = PROSE.split()
    return " ".join(f"{words[(i * 7 + i // 5) % len(words)]}{salt}{i % 97 if i % 3 else ''}" for i in range(n))


def edge_documents(spark):
    long_text = prose(60_000)
    rows = [
        (1, "Ab c", "en", "s1", 4),
        (2, "A\tb  c\n", "en", "s1", 7),
        (3, "Abc", "de", "s2", 3),
        (4, None, None, None, None),
        (5, "", "en", "s2", 0),
        (6, " \t\n\r\x0b\x0c", "en", None, 6),
        (7, prose(80), "en", "s1", None),
        (7, prose(80), "en", "s1", None),  # a repeated row
        (8, prose(80) + " end", "en", "s3", None),
        (None, prose(40, "x"), "fr", "s3", None),
        (None, None, "fr", "s3", None),
        (9, "ünïcödé   wörds \U0001f642   \x1c x", "??", "s1", None),
        (10, long_text, "en", "s1", len(long_text)),
        (11, "ab " * 400, "en", "s1", None),
        (12, "a" * 5000, "en", "s2", None),
        (13, "one <|endoftext|> two it's 12,5", "en", "s1", None),
    ]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


def with_clashes(df):
    from pyspark.sql import functions as F

    taken = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHES if c not in taken})


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
