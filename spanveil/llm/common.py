"""Helpers that the corpus operators share: column picking, words, row keys, lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.session import ensure_checkpoint_dir

# ASCII white space, U+0020 and U+0009 to U+000D, as a list and as regular expressions.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 8 * 1024 * 1024
# A key is hot if it holds more than one of so many equal shares of all rows.
HOT = 1_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The named columns under new names, whatever else ``df`` holds.

    Columns are found by position, so further columns whose names differ only in case,
    repeat, or equal a name used inside an operator do no harm.
    """
    at = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return at.select(*[F.col(f"_{df.columns.index(old)}").alias(new) for new, old in names.items()])


def kept(names: tuple[str, ...] | list[str]) -> dict[str, str]:
    """Columns to carry along unread: inner name -> given name."""
    return {f"keep_{i}": name for i, name in enumerate(names)}


def restored(names: tuple[str, ...] | list[str]) -> list[Column]:
    return [F.col(inner).alias(name) for inner, name in kept(names).items()]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; pure ASCII takes the quick way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The runs of characters between ASCII white space; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def digest(*parts: Column) -> Column:
    """16 bytes that stand for the parts; nulls differ from empty texts."""
    lengths = [F.coalesce(F.octet_length(p.cast("string")).cast("string"), F.lit("-")) for p in parts]
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.unhex(F.md5(F.concat_ws(":", *lengths, *texts).cast("binary")))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this holds, Python tasks get their rows in batches of few megabytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored in the folder of ``spark.checkpoint.dir`` and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that all executors reach."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The same rows as Parquet in the shared folder: columns that are not asked for stay unread.

    ``codec`` is how they are packed, as the session says if not given; zstd suits texts and words."""
    folder = shared_folder(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(folder, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread_join(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """All rows with the columns of their group, null where there is none; hot groups are not gathered.

    ``groups`` (stored: it is read twice) has one row per key, with the number ``n`` of its
    rows among ``total``.  Fewer than ``HOT`` keys can hold more than ``total / HOT`` rows
    each; these are sent to the rows, all others meet them in a shuffle.
    """
    hot = F.broadcast(groups.filter(F.col("n") * HOT > total))
    others = groups.filter(F.col("n") * HOT <= total)
    near = rows.join(hot, key)
    far = rows.filter(F.col(key).isNotNull()).join(hot.select(key), key, "left_anti").join(others, key, "left")
    found = near.unionByName(far)
    return found.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def batches(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The frames again, of at most ``rows`` rows each."""
    for frame in frames:
        for start in range(0, len(frame), rows):
            yield frame.iloc[start:start + rows]
