"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a logarithmic scale; a gram of level q
is put into the filter q times, once with each number from 1 to q.  A count is read back
by probing with 1, 2, ... until a probe fails.  Probabilities are word-pair estimates
smoothed towards word estimates.

The filter is built in shards of fixed size, each by one task.  Its size follows the
number of grams.  Up to ``broadcast_bytes`` it goes to every worker; beyond that the
different grams of some megabytes of text go to the shards, one row for each, and one byte
for each gram comes back, with the same answers.

Exact word counts for the base score: words above a share of all tokens (at most
``1 / share`` of them) go to every worker, the others are joined by word.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from spanveil.llm.common import (
    SPACE_RUN, ascii_lower, digest, kept, pick, restored, stored,
)

# The end of a text is a token that no word can equal; so is what stands before the first word.
END = "\n"
START = "\n\n"
SHARD_BITS = 1 << 23
HASHES = 7
# Words whose hashes a worker remembers.
MEMO = 500_000
ROWS = 1_024
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
# The seed of Spark's xxhash64, and the primes of that hash.
SEED = 42
XXH = tuple(map(np.uint64, (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261,
)))
# Grams that go to the shards of the filter in one row per shard.
SENT = 1 << 20
# Bytes of text whose grams are told apart before they are sent.
TEXT = 1 << 24


@dataclass(frozen=True)
class Shape:
    """What the scores need to know besides the filter."""

    tokens: int
    types: int
    shards: int
    bases: tuple[float, float]
    prior: float


class Hashes(dict):
    """Word (bytes) -> 64 bits, as Spark's ``xxhash64`` of the word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= 64:
            self[word] = found
        return found


def turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashes_of(words: pa.Array) -> np.ndarray:
    """``Hashes`` of an array of words, one length of less than 32 bytes at a time."""
    _, offsets, data = words.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[words.offset:words.offset + len(words) + 1]
    text = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    starts, sizes = starts[:-1], np.diff(starts)
    out = np.empty(len(words), dtype=np.uint64)
    order = np.argsort(sizes, kind="stable")
    edges = np.searchsorted(sizes[order], np.arange(33))
    for size in np.flatnonzero(np.diff(edges)).tolist():
        own = order[edges[size]:edges[size + 1]]
        cells = np.ascontiguousarray(text[starts[own][:, None] + np.arange(size)])
        h = np.full(len(own), SEED + size, dtype=np.uint64) + XXH[4]
        at = 0
        for at in range(8, size + 1, 8):
            lane = np.ascontiguousarray(cells[:, at - 8:at]).view("<u8")[:, 0]
            h = turned(h ^ turned(lane * XXH[1], 31) * XXH[0], 27) * XXH[0] + XXH[3]
        if size - at >= 4:
            lane = np.ascontiguousarray(cells[:, at:at + 4]).view("<u4")[:, 0].astype(np.uint64)
            h = turned(h ^ lane * XXH[0], 23) * XXH[1] + XXH[2]
            at += 4
        for i in range(at, size):
            h = turned(h ^ cells[:, i].astype(np.uint64) * XXH[4], 11) * XXH[0]
        h = (h ^ (h >> np.uint64(33))) * XXH[1]
        h = (h ^ (h >> np.uint64(29))) * XXH[2]
        out[own] = h ^ (h >> np.uint64(32))
    for i in order[edges[32]:].tolist():
        out[i] = xxhash.xxh64_intdigest(text[starts[i]:starts[i] + sizes[i]].data, SEED)
    return out


def slices(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches again, of 1 to ``ROWS`` rows each."""
    for batch in given:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def gathered(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, so many in a batch that their ``text`` has ``TEXT`` bytes, if there are so many."""
    held, size = [], 0
    for part in slices(given):
        held.append(part)
        size += pc.sum(pc.binary_length(part["text"])).as_py()
        if size >= TEXT:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different tokens of the texts, the place there of every token, how many each text has.

    As ``tokens_of``, but only different words are handled one by one."""
    # Copied, as casts and splits go wrong on arrays that are a slice of another one.
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    listed = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = listed.flatten()
    distinct = words.dictionary_encode()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    n = np.bincount(pc.list_parent_indices(listed).to_numpy()[full], minlength=len(texts)) + 1
    at = np.full(n.sum(), len(distinct.dictionary), dtype=np.int64)
    inner = np.ones(len(at), dtype=bool)
    inner[np.cumsum(n) - 1] = False
    at[inner] = distinct.indices.to_numpy()[full]
    return pa.concat_arrays([distinct.dictionary, pa.array([END], pa.large_string())]), at, n


def before(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What stands before each token; ``first`` are the places of the first token of each text."""
    left = np.concatenate((tokens[:1], tokens[:-1]))
    left[first] = np.uint64(xxhash.xxh64_intdigest(START.encode(), SEED))
    return left


def tokens_of(text: str) -> list[bytes]:
    """Words between ASCII white space with A-Z in lower case, then the end."""
    found = text.encode().lower().split()
    found.append(END.encode())
    return found


def pairs_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left * GOLDEN ^ turned(right, 23)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(grams ^ GOLDEN) % np.uint64(shards)).astype(np.int64)


def walk_of(grams: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of a gram at ``level`` begin, and the step from one to the next."""
    h = mixed(grams + np.asarray(level, dtype=np.uint64) * GOLDEN)
    return h, (h >> np.uint64(32)) | np.uint64(1)


def bit_at(h: np.ndarray) -> np.ndarray:
    """The bit inside its shard that a probe looks at."""
    return (h & np.uint64(SHARD_BITS - 1)).astype(np.int64)


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def estimates(found: np.ndarray, base: float) -> np.ndarray:
    """The count that a level stands for: the middle of what falls on it, 0 for level 0."""
    low = np.ceil(base ** (found - 1.0) - 1e-6)
    high = np.maximum(low, np.ceil(base ** found.astype(float) - 1e-6) - 1)
    return np.where(found > 0, (low + high) / 2, 0.0)


def probed(bits: np.ndarray, grams: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The level of each gram; ``start`` is the first byte of its shard in ``bits``."""
    found = np.zeros(len(grams), dtype=np.int64)
    active, first, level = np.arange(len(grams)), start.astype(np.int64) * 8, 0
    while len(active):
        level += 1
        h, step = walk_of(grams, level)
        for _ in range(HASHES):
            bit = first + bit_at(h)
            there = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            if not there.all():
                active, first, grams, h, step = (x[there] for x in (active, first, grams, h, step))
            h = h + step
        found[active] = level
    return found


def looked_up(bits: np.ndarray, shards: int) -> Callable[[np.ndarray], np.ndarray]:
    def look(grams: np.ndarray) -> np.ndarray:
        own, back = np.unique(grams, return_inverse=True)
        return probed(bits, own, shard_of(own, shards) * (SHARD_BITS // 8))[back]
    return look


def log_probability(pair: np.ndarray, left: np.ndarray, word: np.ndarray, shape: Shape) -> np.ndarray:
    """log10 of the smoothed probability, from the levels of a pair, its left and its right word."""
    def read(level: np.ndarray, base: float) -> np.ndarray:
        return estimates(np.arange(level.max(initial=0) + 1), base)[level]

    right, context = read(word, shape.bases[0]), read(left, shape.bases[0])
    both = np.minimum(read(pair, shape.bases[1]), np.minimum(context, np.maximum(right, 1)))
    word_p = (right + 1) / (shape.tokens + shape.types + 1)
    return np.log10((both + shape.prior * word_p) / (context + shape.prior))


def pair_counts(train: DataFrame) -> DataFrame:
    """``gram, n`` of all word pairs of the texts, summed per batch before the shuffle."""
    def count(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(given):
            words, at, n = coded(batch["text"])
            own = hashes_of(words)[at]
            seen, times = np.unique(pairs_of(before(own, np.cumsum(n) - n), own), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(times)], ["gram", "n"])
    return train.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def filter_shards(grams: DataFrame, shards: int) -> DataFrame:
    """``shard, bits`` of the filter; ``grams`` has ``gram, level``. One task makes one shard.

    Grams go to their shard many in a row, as bytes.
    """
    def packed(frames: list[pd.DataFrame]) -> pd.DataFrame:
        own = pd.concat(frames)["gram"].to_numpy().view(np.uint64)
        top = pd.concat(frames)["level"].to_numpy().astype(np.uint8)
        shard = shard_of(own, shards)
        order = np.argsort(shard, kind="stable")
        own, top, shard = own[order], top[order], shard[order]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)])).tolist()
        parts = list(zip(edges, edges[1:], strict=False))
        return pd.DataFrame({
            "shard": shard[edges[:-1]], "grams": [own[i:j].tobytes() for i, j in parts],
            "levels": [top[i:j].tobytes() for i, j in parts],
        })

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for frame in frames:
            if len(frame):
                held.append(frame)
            if sum(map(len, held)) >= SENT:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SHARD_BITS // 8, dtype=np.uint8)
        grams = np.frombuffer(b"".join(frame["grams"]), dtype=np.uint64)
        top = np.frombuffer(b"".join(frame["levels"]), dtype=np.uint8)
        for level in range(1, int(top.max()) + 1):
            h, step = walk_of(grams[top >= level], level)
            for _ in range(HASHES):
                bit = bit_at(h)
                np.bitwise_or.at(bits, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
                h = h + step
        return pd.DataFrame({"shard": [int(frame["shard"].iat[0])], "bits": [bits.tobytes()]})

    return (
        grams.mapInPandas(place, "shard long, grams binary, levels binary")
        .groupBy("shard").applyInPandas(build, "shard long, bits binary")
    )


def score_batches(
    look: Callable[[np.ndarray], np.ndarray] | None, known: dict[str, float], shape: Shape, extra: list[str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per text: its tokens, what the common words (``known``) add to the base score, its rare words, its score."""
    def score(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = pa.array(list(known), pa.large_string())
        # The last entry is that of words that are not common.
        common_logs = np.append(np.fromiter(known.values(), dtype=np.float64, count=len(known)), math.nan)
        common_levels = np.append(look(hashes_of(common)), 0) if look else None
        for batch in slices(given):
            words, at, n = coded(batch["text"])
            first = np.cumsum(n) - n
            spot = pc.fill_null(pc.index_in(words, value_set=common), len(known)).to_numpy()
            logs = common_logs[spot][at]
            rare = np.isnan(logs)
            places = np.flatnonzero(rare)
            unknown = words.take(pa.array(at[places])).cast(pa.string())
            bounds = np.searchsorted(places, np.append(first, len(at))).astype(np.int32)
            scores = np.zeros(len(n))
            if look:
                hashes, level = hashes_of(words), common_levels[spot]
                level[spot == len(known)] = look(hashes[spot == len(known)])
                word, own = hashes[at], level[at]
                left = before(word, first)
                # What stands before the first word was seen once per text, as often as the end.
                context = np.concatenate(([0], own[:-1]))
                context[first] = own[-1]
                scores = np.add.reduceat(log_probability(look(pairs_of(left, word)), context, own, shape), first)
            found = {
                "n_tokens": pa.array(n), "common_sum": pa.array(np.add.reduceat(np.where(rare, 0.0, logs), first)),
                "common": pa.array(np.add.reduceat((~rare).astype(np.int64), first)),
                "rare": pa.ListArray.from_arrays(pa.array(bounds), unknown), "score": pa.array(scores),
            }
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in extra), *found.values()], [*extra, *found])
    return score


def asked_grams(texts: pa.Array, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different grams of some texts, by shard, and their shards; for every token where its pair and
    its word are among them; the places of the first token of each text."""
    words, at, n = coded(texts)
    own, first = hashes_of(words), np.cumsum(n) - n
    pair = pairs_of(before(own[at], first), own[at])
    grams, place = np.unique(np.concatenate((pair, own)), return_inverse=True)
    shard = shard_of(grams, shards)
    order = np.argsort(shard, kind="stable")
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    place = back[place]
    return grams[order], shard[order], place[:len(pair)], place[len(pair):][at], first


def routed_scores(docs: DataFrame, shards: DataFrame, shape: Shape) -> DataFrame:
    """``doc_key, routed``: the same scores, with the grams sent to the shards of the filter.

    Texts are stored in batches, each packed in one value, so that the levels which come back find the
    grams in the same order.
    """
    def gather(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = TaskContext.get().partitionId() << 33
        for i, batch in enumerate(gathered(given)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as out:
                out.write_batch(batch)
            packed = pa.array([sink.getvalue().to_pybytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([begin + i]), packed], ["batch", "texts"])

    def unpacked(texts: bytes) -> pa.RecordBatch:
        return pa.ipc.open_stream(texts).read_next_batch()

    def ask(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in given:
            for batch, texts in zip(rows["batch"].to_pylist(), rows["texts"], strict=True):
                grams, shard, *_ = asked_grams(unpacked(texts.as_py())["text"], shape.shards)
                edges = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)])).tolist()
                parts = [grams[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[edges[:-1]]), pa.array([batch] * len(parts)), pa.array(parts, pa.binary())],
                    ["shard", "batch", "grams"],
                )

    def probe(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        bits = np.frombuffer(own["bits"].iat[0], dtype=np.uint8) if len(own) else np.zeros(SHARD_BITS // 8, np.uint8)
        grams = np.frombuffer(b"".join(asked["grams"]), dtype=np.uint64)
        different, back = np.unique(grams, return_inverse=True)
        levels = probed(bits, different, np.zeros(len(different), dtype=np.int64)).astype(np.uint8)[back]
        ends = np.cumsum(asked["grams"].map(len).to_numpy() // 8).tolist()
        return asked[["batch", "shard"]].assign(
            levels=[levels[i:j].tobytes() for i, j in zip([0, *ends], ends, strict=False)])

    def score(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        batch = unpacked(texts["texts"].iat[0])
        _, _, pair, word, first = asked_grams(batch["text"], shape.shards)
        level = np.frombuffer(b"".join(found.sort_values("shard")["levels"]), dtype=np.uint8).astype(np.int64)
        own = level[word]
        context = np.concatenate(([0], own[:-1]))
        context[first] = own[-1]
        scores = np.add.reduceat(log_probability(level[pair], context, own, shape), first)
        return pd.DataFrame({"doc_key": batch["doc_key"].to_pylist(), "routed": scores})

    rows = stored(docs.select("doc_key", "text").mapInArrow(
        gather, "batch long, texts binary"), "batches")
    asked = rows.mapInArrow(ask, "shard long, batch long, grams binary")
    levels = stored(asked.groupBy("shard").cogroup(shards.groupBy("shard")).applyInPandas(
        probe, "batch long, shard long, levels binary").filter("batch is not null"), "levels", "zstd")
    found = rows.groupBy("batch").cogroup(levels.groupBy("batch")).applyInPandas(score, "doc_key binary, routed double")
    return stored(found.groupBy("doc_key").agg(F.sum("routed").alias("routed")), "routed")


def lm_scores(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_pairs: int = 1,
    bases: tuple[float, float] = (1.25, 2.0),
    prior: float = 300.0,
    bits_per_entry: int = 10,
    common_words: int = 400_000,
    broadcast_bytes: int = 128 * 1024 * 1024,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, kept columns, ``held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``held_out`` is an expression over the id column; its rows (true) are scored but not
    learned from, null counts as false.  Tokens are the words in ASCII lower case and one
    end per text; a null text is empty and has the end alone.  ``base_score`` is the sum
    of log10((c+1)/(N+V+1)) with exact counts; ``score`` is the model's log10 probability
    of the text.  Pairs of every count are stored; with ``least_pairs`` above 1, those seen
    fewer times are not and count as unseen.  Repeated rows are learned from each time and score the same.  Without
    training rows all words are unknown; an empty table gives an empty result.
    """
    rows = pick(docs, **{id_col: id_col}, text=text_col, **kept(keep)).withColumn(
        "held_out", F.coalesce(held_out, F.lit(False))
    ).withColumnRenamed(id_col, "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("doc_key", digest(F.col("doc_id"), F.col("text")))
    train = rows.filter(~F.col("held_out"))

    listed = F.split(ascii_lower(F.col("text")), SPACE_RUN)
    word = F.explode(F.concat(listed, F.array(F.lit(END)))).alias("word")
    counts = stored(train.select(word).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n")), "words", "zstd")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    entries = stored(
        pair_counts(train).filter(F.col("n") >= least_pairs)
        .select("gram", F.floor(1 + F.log("n") / math.log(bases[1]) + 1e-9).cast("long").alias("level"))
        .unionByName(counts.select(
            F.xxhash64("word").alias("gram"),
            F.floor(1 + F.log("n") / math.log(bases[0]) + 1e-9).cast("long").alias("level"),
        )), "entries",
    )
    size = entries.agg(F.coalesce(F.sum("level"), F.lit(0))).first()[0]
    shape = Shape(total[0], total[1], max(1, -(-size * bits_per_entry // SHARD_BITS)), bases, prior)
    shards = stored(filter_shards(entries, shape.shards), "filter")

    context = rows.sparkSession.sparkContext
    common = {
        row["word"]: math.log10(row["n"] + 1)
        for row in counts.filter(F.col("n") * common_words >= total[0]).toLocalIterator()
    }
    sent_common, sent_bits = context.broadcast(common), None
    if shape.shards * SHARD_BITS // 8 <= broadcast_bytes:
        bits = np.zeros((shape.shards, SHARD_BITS // 8), dtype=np.uint8)
        for row in shards.toLocalIterator():
            bits[row["shard"]] = np.frombuffer(row["bits"], dtype=np.uint8)
        sent_bits = context.broadcast(bits.reshape(-1))

    extra = [c for c in rows.columns if c != "text"]
    schema = StructType([rows.schema[c] for c in extra] + [
        StructField("n_tokens", LongType()), StructField("common_sum", DoubleType()), StructField("common", LongType()),
        StructField("rare", ArrayType(StringType())), StructField("score", DoubleType()),
    ])

    def score(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = looked_up(sent_bits.value, shape.shards) if sent_bits else None
        yield from score_batches(look, sent_common.value, shape, extra)(given)

    scored = stored(rows.mapInArrow(score, schema), "scored", "zstd")
    rare = scored.select("doc_key", F.explode("rare").alias("word")).join(counts, "word").groupBy("doc_key").agg(
        F.sum(F.log10(F.col("n") + 1)).alias("rare_sum"), F.count("*").alias("rare_known")
    )
    # Repeated rows have added their words once each.
    times = scored.groupBy("doc_key").agg(F.count("*").alias("times"))
    out = scored.drop("rare").join(times, "doc_key").join(rare, "doc_key", "left")
    result = F.col("score")
    if sent_bits is None:
        out, result = out.join(routed_scores(rows, shards, shape), "doc_key"), F.col("routed") / F.col("times")
    unit = math.log10(shape.tokens + shape.types + 1)
    return out.select(
        F.col("doc_id").alias(id_col), *restored(keep), "held_out", "n_tokens",
        (F.col("common") + F.coalesce(F.col("rare_known") / F.col("times"), F.lit(0))).cast("long").alias("n_known"),
        F.lit(shape.tokens).cast("long").alias("train_tokens"),
        (F.col("common_sum") + F.coalesce(F.col("rare_sum") / F.col("times"), F.lit(0.0))
         - F.col("n_tokens") * unit).alias("base_score"),
        result.alias("score"),
    )
