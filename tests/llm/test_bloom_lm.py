import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import LOWER, WORD, collected, documents, odd_rows
from spanveil.llm import bloom_lm as B
from spanveil.llm.bloom_lm import lm_scores
from spanveil.llm.queries import op8_lm_scoring, remainder, table


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), "\n"]


def base_scores(rows, held):
    seen = Counter()
    for r in rows:
        if not held(r[0]):
            seen.update(tokens(r[1]))
    total, types = sum(seen.values()), len(seen)
    return [
        (r[0], held(r[0]), len(tokens(r[1])), sum(seen[t] > 0 for t in tokens(r[1])), total,
         sum(math.log10((seen[t] + 1) / (total + types + 1)) for t in tokens(r[1])))
        for r in rows
    ]


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], rel=1e-9)


FIELDS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")


def test_base_scores_and_better_held_out_scores(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    found = op8_lm_scoring(spark, sf_dir).collect()
    same([tuple(r[c] for c in FIELDS) for r in found], base_scores(rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 2))
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in found)


def test_odd_rows_and_rare_words_by_join(spark):
    rows = odd_rows()
    want = base_scores(rows, lambda i: i == 5)
    for common in (10, 10**9):
        got = lm_scores(documents(spark, rows, clashing=True), F.col("doc_id") == 5, common_words=common)
        same(collected(got, *FIELDS), want)
    assert lm_scores(documents(spark, []), F.col("doc_id") == 5).count() == 0


def test_no_training_rows(spark):
    got = lm_scores(documents(spark, [(1, "a b", "en", "s", 1)]), F.lit(True)).first()
    assert (got["n_known"], got["train_tokens"], got["base_score"]) == (0, 0, 0.0)


def test_sent_filter_and_routed_grams_agree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("doc_id < 40")
    docs = docs.unionByName(docs.filter("doc_id < 3"))
    sent = collected(lm_scores(docs, remainder("doc_id", 7) == 2), "doc_id", "score")
    routed = collected(lm_scores(docs, remainder("doc_id", 7) == 2, broadcast_bytes=0), "doc_id", "score")
    assert [i for i, _ in sent] == [i for i, _ in routed]
    assert [s for _, s in sent] == pytest.approx([s for _, s in routed])


def test_pairs_seen_once_are_learned(spark):
    """The same words in the order of the only training text score better than in another."""
    rng, words = np.random.default_rng(3), [f"w{i}" for i in range(50)]
    other = [words[i] for i in rng.permutation(50)]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate((words, words, other))]
    got = {r["doc_id"]: r["score"] for r in lm_scores(documents(spark, rows), F.col("doc_id") > 0).collect()}
    assert got[0] == got[1] > got[2] + 1


def test_filter_gives_back_quantised_counts(spark):
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(-2**62, 2**62, 4000))
    counts = rng.integers(1, 2000, len(grams))
    level = B.levels(counts, 2.0)
    df = spark.createDataFrame([(int(g), int(q)) for g, q in zip(grams, level, strict=True)], "gram long, level long")
    shards = 1 + int(level.sum()) * 10 // B.SHARD_BITS
    bits = np.concatenate([np.frombuffer(r["bits"], np.uint8) for r in B.filter_shards(df, shards).orderBy("shard").collect()])
    found = B.looked_up(bits, shards)(grams.view(np.uint64))
    assert (found >= level).all() and (found == level).mean() > 0.97
    absent = B.looked_up(bits, shards)(rng.integers(2**62, 2**63 - 1, 20_000).view(np.uint64))
    assert (absent > 0).mean() < 0.02
    error = np.abs(B.estimates(level, 2.0) - counts) / counts
    assert error.max() <= 0.5


def test_hash_is_that_of_spark(spark):
    words = ["a", "größe", "\n", "x" * 100]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    own = B.Hashes()
    assert all(np.uint64(own[r["w"].encode()]).view(np.int64) == r["h"] for r in got)


def test_columns_give_the_tokens_and_their_hashes():
    rng = np.random.default_rng(2)
    texts = ["", " ", "a\x0bb\x0cC \x85É\x1c d e ", "\n x", "x", "İ ǅ Σ Kelvin K"]
    texts += [" ".join("aZé€😀_"[c] * (1 + i % 50) for c in rng.integers(0, 6, 40)) for i in range(120)]
    given = pa.array(["é", "two words"] * 40 + texts).slice(80)
    words, at, n = B.coded(given)
    listed = [B.tokens_of(t) for t in texts]
    own = [w.encode() for w in words.to_pylist()]
    assert [own[i] for i in at] == [t for tokens in listed for t in tokens] and list(n) == list(map(len, listed))
    assert B.hashes_of(words).tolist() == [B.Hashes()[w] for w in own] and max(map(len, own)) > 64
    assert B.hashes_of(words.slice(3)).tolist() == B.hashes_of(words).tolist()[3:]
    assert B.hashes_of(words.slice(0, 0)).tolist() == []


def test_all_pairs_are_counted_in_slices(monkeypatch):
    monkeypatch.setattr(B, "ROWS", 7)
    batch = pa.RecordBatch.from_arrays([pa.array([f"é{i} b c" for i in range(100)])], ["text"])
    found = [B.coded(part["text"]) for part in B.slices(iter([batch, batch.slice(0, 0)]))]
    assert sum(len(at) for _, at, _ in found) == 400 and sum(len(n) for _, _, n in found) == 100
    own = [w for words, at, _ in found for w in words.take(pa.array(at)).to_pylist()]
    assert own == [t for i in range(100) for t in (f"é{i}", "b", "c", "\n")]


def test_a_row_brings_many_grams_to_a_shard(spark):
    """Rows that meet at the shards do not grow with the grams."""
    grams = spark.range(30_000).select(F.xxhash64("id").alias("gram"), F.lit(1).cast("long").alias("level")).coalesce(1)
    sent = B.filter_shards(grams, 3)
    assert sorted(r["shard"] for r in sent.collect()) == [0, 1, 2]
    found = np.concatenate([np.frombuffer(r["bits"], np.uint8) for r in sent.orderBy("shard").collect()])
    own = np.array([r["gram"] for r in grams.collect()]).view(np.uint64)
    assert (B.looked_up(found, 3)(own) >= 1).all()
    assert "levels" in sent._jdf.queryExecution().analyzed().toString()


def test_routed_grams_move_many_in_a_row(spark, monkeypatch):
    """What is stored for the routed scores has a row for some texts and a shard, not one for each token."""
    rng, rows, plain = np.random.default_rng(4), {}, B.stored

    def noted(df, name, *more):
        found = plain(df, name, *more)
        rows[name] = found.count()
        return found

    monkeypatch.setattr(B, "stored", noted)
    texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3_000, 300)), "en", "s", 1) for i in range(100)]
    docs = documents(spark, texts + [(100, None, "en", "s", 1), (101, "", "en", "s", 1)])
    want = collected(lm_scores(docs, F.col("doc_id") % 7 == 2), "doc_id", "score")
    before = set(rows)
    got = collected(lm_scores(docs, F.col("doc_id") % 7 == 2, broadcast_bytes=0), "doc_id", "score")
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])
    assert set(rows) > before and max(rows[n] for n in set(rows) - before) <= 102
    assert lm_scores(docs.limit(0), F.col("doc_id") % 7 == 2, broadcast_bytes=0).count() == 0


def test_texts_are_gathered_by_bytes(monkeypatch):
    monkeypatch.setattr(B, "ROWS", 3)
    monkeypatch.setattr(B, "TEXT", 20)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["four"] * 50)], ["id", "text"])
    found = list(B.gathered(iter([batch, batch.slice(0, 0), batch.slice(7)])))
    assert [i for part in found for i in part["id"].to_pylist()] == [*range(50), *range(7, 50)]
    assert all(5 <= part.num_rows <= 6 for part in found[:-1]) and list(B.gathered(iter([]))) == []
