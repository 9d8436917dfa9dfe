"""A small table with the cases that every operator must stand."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 5000}" for i in range(30_000))
PROSE = "The quick brown fox jumps over the lazy dog and runs far away into the deep green forest"

ROWS = [
    (1, PROSE, "en", "a", 1),
    (2, PROSE, "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "en", "b", 4),
    (6, LONG, "en", "b", 9),
    (7, PROSE + " today", "en", None, 1),
    (7, PROSE + " today", "en", None, 1),
    (8, "one two", "en", "c", 7),
    (9, "Ein Überfluß 漢字 😀\nzweite Zeile\r\n\nEnde", "de", "c", 3),
    (None, "no id here, and some words more to read", "en", "a", 2),
    (11, "same", "en", "c", 4),
    (12, "same", "fr", "c", 4),
    (13, "same", "fr", "a", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark):
    """The rows, with columns whose names operators might use themselves."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("key", "size", "taken", "kept", "digest", "id", "node", "rep", "part", "words", "row", "n", "t1", "line", "lines", "normal", "__id", "__digest", "__lost", "__gone", "__row", "chunk", "payload", "label", "found"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return table(spark).limit(0)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda x: tuple((v is None, str(v)) for v in x))
