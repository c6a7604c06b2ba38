"""Small tables with everything that may go wrong in them."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_rows():
    """Null, empty, blank, long and repeated texts, null ids and sources, ties."""
    return [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \t\n ", None, "b", 4),
        (4, "word " * 30_000, "en", "a", 5), (5, "Same text here\nand again", "en", "a", 1),
        (5, "Same text here\nand again", "en", "a", 1), (6, "Same text here\nand again", "en", "a", 1),
        (None, "no id at all", "en", "b", 1), (None, None, None, None, None),
        (7, "É Ünï   <|endoftext|> 日本 🙂\x1c!", "fr", "ä", 9), (8, "x" * 20_000, "en", "a", 2),
    ]


def documents(spark, rows, clashing=False):
    """A documents table; ``clashing`` adds columns that equal inner names or differ in case."""
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        extra = ["TEXT", "Doc_Id", "pos", "size", "key", "keys", "n", "label", "doc_key", "found", "items",
                 "text_key", "code", "rank", "target", "score", "rows", "word", "keep_0", "lambda", "id", "unit"]
        df = df.toDF(*df.columns).selectExpr("*", *[f"n_chars AS x{i}" for i in range(len(extra))]).toDF(
            *df.columns, *extra)
    return df


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def duck_rows(folder, sql):
    import duckdb
    duck = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "labels", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    cursor = duck.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()
