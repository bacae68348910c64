"""Small tables with awkward rows."""

from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = {
    "en": "the quick brown fox jumps over the lazy dog and then they walked along the river with their friends until evening",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann gingen sie mit ihren freunden am fluss entlang bis zum abend",
    "fr": "le rapide renard brun saute par dessus le chien paresseux et puis ils marchaient le long de la rivière avec leurs amis",
}


def documents(spark, texts, langs=None, ids=None):
    rows = [(i if ids is None else ids[i], t, langs[i] if langs else "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, a repeated id, odd characters."""
    rows = [
        (1, "One sentence here. And another one, with more words.", "en", "a", 52),
        (1, "One sentence here. And another one, with more words.", "en", "a", 52),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (None, "A text without an id. It stays where it is.", "en", "a", 10),
        (4, "word " * 30_000, "en", "a", 150_000),
        (4, "another text under the same id", None, "a", 10),
        (5, "▁ marks ▁▁ and <|endoftext|> \U0001f600 日本語   \t\r\n ", "ja", "b", 10),
        (6, "1234 5678 !!! ½", "en", "b", 10),
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Extra columns whose names operators use themselves."""
    for name in ("ids", "score", "kept", "log_weight", "n_tokens", "removed_spans", "set_key", "_id", "payload"):
        df = df.withColumn(name, df["doc_id"].cast("string"))
    return df


def empty_documents(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCS))
