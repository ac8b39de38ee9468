"""Small tables with the awkward cases every operator must handle."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])
# names that operators use inside, with other types
EXTRA = ["name", "level", "t", "h", "block", "sig", "id", "ids", "score", "lang_pred", "size", "k", "bucket", "row", "spans",
         "terms", "rid", "blob", "_doc", "_text", "set", "held_out", "weight", "n_words", "kept", "lines", "dropped", "skey"]

EN = "the cat sat on the mat and then it went home to sleep for the whole afternoon near the warm window of the house "
DE = "der hund lief schnell durch den wald und dann nach hause zu seiner familie, weil es spät wurde und schöne größe "
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))

ROWS = [
    (1, EN * 3, "en", "a", 1),
    (2, EN * 3, "en", "a", 1),
    (3, (EN * 3).replace("cat", "dog", 1), "en", "a", None),
    (4, None, "en", "a", 0),
    (5, "", None, None, 0),
    (6, " \t\n\x0b ", "en", "", 0),
    (7, DE * 3, "de", "b", 5),
    (7, DE * 3, "de", "b", 5),
    (None, DE + "ende", "de", "b", 5),
    (None, None, None, None, None),
    (8, LONG, "en", "c", None),
    (9, "one two three", "en", None, 3),
    (10, "One TWO three", "en", None, 3),
    (11, "12345 --- 67", None, "c", 3),
    (12, "\n".join(["same line of words here again"] * 4 + ["Another single line stands here alone"]), "en", "c", 3),
    (13, "é漢字 \U0001F600 ▁ x y", "fr", "c", 3),
    (14, "mail a.b@c.de.fg or +49 (30) 1234-567, card 4111 1111 1111 1111, ip 10.0.0.255 and 10.0.0.256, password = abcdef12", "en", "c", 3),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark, rows=ROWS):
    from pyspark.sql import functions as F
    return docs(spark, rows).withColumns({c: F.array(F.lit("x")) for c in EXTRA})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=repr)
