"""Exact dedup against an index of the digests seen before.

Method: distinct digests of the historical rows are dealt to shards; each shard gets a
minimal perfect hash (levels of bit arrays; a digest owns the first bit that no other digest
of its level hits, its slot is the rank of that bit).  Slots hold the whole digest and the
winner's locator, so a look-up compares all bytes and a digest that is not in the index is
never taken for one that is.  New digests that are members update their slot; the others are
grouped apart and become a second table of the shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import ascii_lower, pick, stored

DIGEST = 32
# Rows of a shard, and shards at most: beyond that shards grow, so their row counts can be sent.
SHARD_ROWS = 32_768
MOST_SHARDS = 100_000
# A digest with more than one of so many equal shares of all rows is resolved without its shard.
HOT = 1_000
GAMMA = 2
MASK = (1 << 64) - 1

TABLE = (
    "shard int, sizes array<long>, bits binary, digests binary, ids binary, known binary, places binary, "
    "counts binary, hot array<struct<digest:binary,keep_id:long,place:long,size:long>>"
)
TABLES = TABLE.replace("shard int", "shard int, generation int")
FOUND = (
    "place long, id long, known boolean, digest binary, keep_id long, keep_known boolean, keep_place long, size long"
)


def hashes(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each digest (four words), another one for each level."""
    found = np.full(len(keys), (level + 1) * 0x9E3779B97F4A7C15 & MASK, dtype=np.uint64)
    for word in keys.T:
        found ^= word
        found = (found ^ found >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        found = (found ^ found >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        found ^= found >> np.uint64(31)
    return found


class PerfectHash:
    """Distinct digests -> slots 0 to n - 1, without gaps."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits, self.ranks, below = sizes, bits, [], 0
        for own in bits:
            self.ranks.append(below + np.cumsum(own) - own)
            below += int(own.sum())

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, rest = [], [], keys
        while len(rest):
            size = max(8, GAMMA * len(rest))
            at = (hashes(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone.astype(np.int64))
            rest = rest[~alone[at]]
        return cls(sizes, bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; any slot or -1 for a key that was not hashed."""
        found = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = (hashes(keys[rest], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[level][at] == 1
            found[rest[hit]] = self.ranks[level][at[hit]]
            rest = rest[~hit]
        return found


def words_of(digests: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, DIGEST // 8)


class Table:
    """One shard's slots: digest, winner's id (with whether it has one) and place, rows seen."""

    def __init__(self, hashed: PerfectHash, digests: np.ndarray, ids, known, places, counts):
        self.hashed, self.digests = hashed, digests
        self.ids, self.known, self.places, self.counts = ids, known, places, counts

    @classmethod
    def of(cls, frame: pd.DataFrame) -> Table:
        """Table over rows ``digest, id, known, place, n`` with distinct digests."""
        keys = words_of(frame["digest"])
        hashed = PerfectHash.of(keys)
        order = np.argsort(hashed.slots(keys))
        return cls(hashed, keys[order], *[frame[c].to_numpy()[order] for c in ("id", "known", "place", "n")])

    @classmethod
    def read(cls, row: dict) -> Table:
        sizes = [int(s) for s in row["sizes"]]
        flat, bits, start = np.frombuffer(row["bits"], dtype=np.uint8), [], 0
        for size in sizes:
            bits.append(np.unpackbits(flat[start:start + -(-size // 8)], count=size).astype(np.int64))
            start += -(-size // 8)
        longs = (np.frombuffer(row[c], dtype=np.int64).copy() for c in ("ids", "places", "counts"))
        ids, places, counts = longs
        known = np.frombuffer(row["known"], dtype=np.bool_).copy()
        digests = np.frombuffer(row["digests"], dtype=np.uint64).reshape(-1, DIGEST // 8)
        return cls(PerfectHash(sizes, bits), digests, ids, known, places, counts)

    def row(self, least: int | None = None) -> dict:
        """The table as a row; ``hot`` lists the slots with more than ``least`` rows."""
        large = np.flatnonzero(self.counts > least) if least is not None else []
        return {
            "sizes": self.hashed.sizes,
            "bits": b"".join(np.packbits(own.astype(np.uint8)).tobytes() for own in self.hashed.bits),
            "digests": self.digests.tobytes(), "ids": self.ids.tobytes(), "known": self.known.tobytes(),
            "places": self.places.tobytes(), "counts": self.counts.tobytes(),
            "hot": [
                {
                    "digest": self.digests[i].tobytes(), "keep_id": int(self.ids[i]) if self.known[i] else None,
                    "place": int(self.places[i]), "size": int(self.counts[i]),
                } for i in large
            ],
        }

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each digest that is in the table byte for byte, otherwise -1."""
        found = self.hashed.slots(keys)
        maybe = np.flatnonzero(found >= 0)
        same = (self.digests[found[maybe]] == keys[maybe]).all(axis=1)
        found[maybe[~same]] = -1
        return found

    def add(self, frame: pd.DataFrame) -> pd.DataFrame:
        """Counts rows ``digest, id, known, place, n`` into their slots; the rows that have none."""
        at = self.find(words_of(frame["digest"]))
        for row, slot in zip(frame[at >= 0].itertuples(index=False), at[at >= 0].tolist()):
            own = (row.known, row.id, row.place)
            if own > (self.known[slot], self.ids[slot], self.places[slot]):
                self.known[slot], self.ids[slot], self.places[slot] = own
            self.counts[slot] += row.n
        return frame[at < 0]


def facts_of(docs: DataFrame, id_col: str, text_col: str, historical: Callable[[Column], Column]) -> DataFrame:
    """``place, id, known, digest, seen`` of every row, stored: texts are read once."""
    rows = pick(docs, id=id_col, text=text_col)
    text = ascii_lower(F.coalesce("text", F.lit("")))
    return stored(
        rows.select(
            F.monotonically_increasing_id().alias("place"),
            F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.col("id").isNotNull().alias("known"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
            F.coalesce(historical(F.col("id")), F.lit(False)).alias("seen"),
        ), "digests",
    )


def winners(facts: DataFrame, shards: int) -> DataFrame:
    """One row per distinct digest: its last row by id, then place, and how many it has.

    Rows of a digest fall together before the shuffle, so a hot one costs a row per task.
    """
    last = F.max(F.struct("known", "id", "place"))
    return facts.groupBy("digest").agg(last.alias("last"), F.count("*").alias("n")).select(
        shard_of(shards), "digest", "last.id", "last.known", "last.place", "n"
    )


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def history_index(facts: DataFrame, shards: int) -> DataFrame:
    """One row per shard that has rows: the hash and the slots of its distinct digests."""
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"shard": frame["shard"].iloc[0]} | Table.of(frame).row()])
    return winners(facts, shards).groupBy("shard").applyInPandas(build, TABLE)


def updated(index: DataFrame, facts: DataFrame, shards: int, least: int) -> DataFrame:
    """The index with new rows counted in: generation 0 has the digests it held before, 1 the others.

    Digests with more than ``least`` rows are also listed in ``hot``.
    """
    def add(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = (old if len(old) else new)["shard"].iloc[0]
        out = []
        if len(old):
            table = Table.read(old.to_dict("records")[0])
            new = table.add(new)
            out.append({"shard": shard, "generation": 0} | table.row(least))
        if len(new):
            out.append({"shard": shard, "generation": 1} | Table.of(new).row(least))
        return pd.DataFrame(out)
    return index.groupBy("shard").cogroup(winners(facts, shards).groupBy("shard")).applyInPandas(add, TABLES)


def resolved(facts: DataFrame, index: DataFrame, shards: int, most: int) -> DataFrame:
    """Columns of ``FOUND`` for every row, looked up in the index."""
    hot = F.broadcast(index.select(F.explode("hot").alias("h")).select(
        F.col("h.digest").alias("digest"), F.col("h.keep_id").alias("keep_id"),
        F.col("h.place").alias("keep_place"), F.col("h.size").alias("size"),
    ))
    near = facts.join(hot, "digest").withColumn("keep_known", F.col("keep_id").isNotNull()).drop("seen")
    cold = facts.join(hot.select("digest"), "digest", "left_anti").select(
        "place", "id", "known", "digest", shard_of(shards)
    )
    # A shard with many rows is read by several tasks; at most MOST_SHARDS rows are sent.
    split = F.broadcast(cold.groupBy("shard").count().select(
        "shard", F.ceil(F.col("count") / (2 * most)).cast("int").alias("tasks")
    ).filter("tasks > 1"))
    salted = cold.join(split, "shard", "left").withColumn(
        "salt", F.pmod(F.xxhash64("place"), F.coalesce("tasks", F.lit(1))).cast("int")
    ).drop("tasks")
    copies = index.drop("hot").join(split, "shard", "left").select(
        *[c for c in index.columns if c != "hot"],
        F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1)).alias("salt"),
    )

    def look_up(rows: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        keys = words_of(rows["digest"])
        size, place = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        keep = np.zeros(len(rows), dtype=np.int64)
        known = np.zeros(len(rows), dtype=np.bool_)
        for row in tables.sort_values("generation").to_dict("records"):
            table = Table.read(row)
            left = np.flatnonzero(size == 0)
            slot = table.find(keys[left])
            at, slot = left[slot >= 0], slot[slot >= 0]
            size[at], place[at] = table.counts[slot], table.places[slot]
            keep[at], known[at] = table.ids[slot], table.known[slot]
        return rows[["place", "id", "known", "digest"]].assign(
            keep_id=keep, keep_known=known, keep_place=place, size=size
        )

    far = salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(look_up, FOUND)
    return near.unionByName(far)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    historical: Callable[[Column], Column] = lambda _: F.lit(False),
    shard_rows: int = SHARD_ROWS,
    hot: int = HOT,
) -> DataFrame:
    """One row per input row: id, ``keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are the same after A-Z are lower-cased; ``text_sha256`` is the
    digest of that form, compared whole.  Of equal texts the row with the largest id stays,
    and of repeated rows of that id the last one in the table, so exactly one row of a group
    is kept.  ``historical`` tells by the id which rows the index is built over (none: all rows are
    new); it changes the way, not the result, as do ``shard_rows``, the digests of a shard,
    and ``hot``: digests with more than one of ``hot`` equal shares of all rows are sent.  Ids are whole numbers; a null id is smaller
    than all others and ``keep_id`` is null if no row of the group has one.  Null texts count
    as empty ones; texts of any length are read whole.  An empty table gives an empty result.
    Further columns, whatever their names, do no harm.
    """
    facts = facts_of(docs, id_col, text_col, historical)
    total = facts.count()
    shards = min(max(1, -(-total // shard_rows)), MOST_SHARDS)
    most = max(shard_rows, -(-total // shards))
    index = stored(history_index(facts.filter("seen"), shards), "history-index")
    now = stored(updated(index, facts.filter("not seen"), shards, total // hot), "digest-index")
    return resolved(facts, now, shards, most).select(
        F.when(F.col("known"), F.col("id")).alias(id_col), F.when(F.col("keep_known"), F.col("keep_id")).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("place") == F.col("keep_place")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
