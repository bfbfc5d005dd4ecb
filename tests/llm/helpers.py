"""Small tables with awkward rows."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("fp", T.StringType()), T.StructField("removed", T.StringType()), T.StructField("score", T.StringType()),
                     T.StructField("lang_pred", T.StringType()), T.StructField("start", T.StringType()), T.StructField("shard", T.StringType()),
                     T.StructField("n", T.StringType())])
PASSAGE = " ".join(f"word{k}" for k in range(60))
TEXTS = [
    (3, "the cat sat on the mat and looked at the dog\nanother line of words to make up the second line", "en"),
    (1, None, "en"), (2, "", None), (7, "  \n\t ", "en"), (7, "  \n\t ", "en"), (None, "a text without an id, but with words", "en"),
    (5, "the cat sat on the mat and looked at the dog\nanother line of words to make up the second line", "en"),
    (8, "le chat est sur le tapis et regarde le chien\n" + PASSAGE, "fr"), (9, PASSAGE + "\nder hund sieht die katze auf der matte", "de"),
    (10, "12345 !!! ...", None), (11, "x", "en"), (12, "é́ ß ΑΣ 日本 <|endoftext|> don't \r\n\n  end ", None),
    (13, "long " * 30_000 + "tail", "en"), (14, "y" * 50_000, "en"), (15, "the dog looked at the cat " * 40, "en"),
]


def documents(spark, rows=None):
    """The awkward documents, with columns whose names operators use themselves."""
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f", "g") for r in rows], DOCS)


def tokens(text):
    return (text or "").encode().lower().split()
