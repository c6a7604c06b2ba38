import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from spanveil.operators.changes import changes
from spanveil.operators.rules import catalog, only
from spanveil.streaming import monitor as M
from spanveil.streaming.ordered import changed_keys, slice_changes, with_texts
from spanveil.streaming.state import prepare

SCHEMA = "owner string, at timestamp, seq long, text string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def write(spark, path, rows, part):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, **more):
    prepare(spark)
    stream = M.read_texts(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    keys = changed_keys(stream, "owner", "at", "seq", "text", **more)
    query = (keys.writeStream.format("parquet").option("path", f"{out}/rows")
             .option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(keys.schema).parquet(f"{out}/rows")


def at(seconds):
    return START + timedelta(seconds=seconds)


def keys_of(df):
    return sorted((r["owner"] or "", r["at"], r["seq"]) for r in df.collect())


@pytest.mark.parametrize("emit_first", [False, True])
def test_late_rows_and_a_hot_owner(spark, tmp_path, emit_first):
    dice = random.Random(4)
    rows = [("hot" if i % 3 == 0 else dice.choice(["a", "b", None]), at(i * 2), i, dice.choice(["x", "y", None]))
            for i in range(1_500)]
    arrival = sorted(rows, key=lambda r: r[2] * 2 + dice.randrange(300))
    for part in range(4):
        write(spark, str(tmp_path / "in"), arrival[part * 375:(part + 1) * 375], part)
    write(spark, str(tmp_path / "in"), [("beat", at(10**8), 0, "z")], 9)
    found = run(spark, str(tmp_path / "in"), str(tmp_path / "out"), delay="10 minutes", step_seconds=120,
                emit_first=emit_first)
    batch = changes(spark.createDataFrame(rows, SCHEMA), "owner", "at", "seq", "text", emit_first=emit_first)
    assert keys_of(found.filter("coalesce(owner, '') <> 'beat'")) == keys_of(batch)
    texts = with_texts(found, spark.createDataFrame(rows, SCHEMA), "owner", "at", "seq")
    assert keys_of(texts) == keys_of(batch)


def test_open_slices_wait_and_rows_beyond_the_delay_are_left_out(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, path, [("a", at(0), 1, "x"), ("a", at(30), 2, "y"), ("a", at(61), 3, "x"), ("a", at(400), 4, "q")], 0)
    # The watermark stands at 400 - 60: the row of second 10 comes too late, that of 380 does not.
    found = run(spark, path, out, delay="60 seconds", step_seconds=60)
    assert {r["seq"] for r in found.collect()} == {2, 3}
    write(spark, path, [("a", at(10), 5, "late"), ("a", at(380), 6, "x"), ("a", at(10_000), 7, "x")], 1)
    found = run(spark, path, out, delay="60 seconds", step_seconds=60)
    assert {r["seq"] for r in found.collect()} == {2, 3, 4}


def test_monitor_in_event_time(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("u", at(0), 1, "a"), ("u", at(10), 2, "mail a@b.co"), ("u", at(20), 3, "mail a@b.co"), ("u", at(5), 4, "b")]
    write(spark, path, rows[:2], 0)
    write(spark, path, rows[2:], 1)
    write(spark, path, [("beat", at(10**7), 9, "z")], 2)
    stream = M.read_texts(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    M.monitor(stream, only(catalog(), "EMAIL_ADDRESS"), out, str(tmp_path / "cp"), "owner", "at", "seq", available_now=True,
              texts=lambda session: session.read.parquet(path), delay="10 minutes").awaitTermination()
    assert {r["seq"] for r in spark.read.parquet(f"{out}/changes").collect()} == {4, 2}
    assert [r["seq"] for r in spark.read.parquet(f"{out}/findings").collect()] == [2]


def test_history_shrinks_on_disk(spark, tmp_path):
    out = str(tmp_path / "out")

    def batch(number, rows):
        frame = spark.createDataFrame(rows, "owner string, timestamp string, seq long")
        frame.write.parquet(f"{out}/history/batch={number}")

    batch(0, [("a", f"2024-01-0{i}", i) for i in range(1, 6)] + [("b", "2024-01-01", 9)])
    batch(1, [("a", "2024-02-01", 10)])

    def kept():
        return sorted((r["owner"], r["seq"]) for r in M.all_history(spark, out).collect())

    M.compact_history(spark, out, "owner", "seq", limit=2)
    assert kept() == [("a", 5), ("a", 10), ("b", 9)] and not list((tmp_path / "out/history").glob("batch=*"))
    batch(2, [("a", "2024-03-01", 11), ("b", "2024-03-01", 12)])
    assert len(kept()) == 5
    # Broken off after the merged table stood: the micro-batch is still there, but not counted again.
    limits = spark.createDataFrame([("a", 1)], "owner string, history_limit int")
    M.compact_history(spark, out, "owner", "seq", limit=5, limits=limits, oldest="2024-01-02")
    batch(2, [("a", "2024-03-01", 11)])
    assert kept() == [("a", 11), ("b", 12)]
    M.compact_history(spark, out, "owner", "seq", limit=5)
    assert kept() == [("a", 11), ("b", 12)] and len(list((tmp_path / "out/kept").glob("save=*"))) == 1


def test_changes_of_a_slice_are_columns(spark):
    rows = [("a", 5, 2, b"x"), ("a", 1, 1, b"x"), ("a", 5, 1, b"y"), ("a", 9, 0, b"x"), ("b", 3, 0, b"z")]
    held = spark.createDataFrame(rows, "owner string, at long, tie long, digest binary").groupBy("owner").agg(
        F.collect_list(F.struct("at", "tie", "digest")).alias("held"))
    found = held.select("owner", F.inline(slice_changes(F.col("held")))).orderBy("owner", "at", "tie").collect()
    assert [(r["owner"], r["at"], r["tie"], bytes(r["digest"]), bytes(r["last"]), r["is_first"]) for r in found] == [
        ("a", 1, 1, b"x", b"x", True), ("a", 5, 1, b"y", b"x", False), ("a", 5, 2, b"x", b"x", False),
        ("b", 3, 0, b"z", b"z", True)]


def test_many_owners_share_few_groups(spark, tmp_path):
    rows = [(f"o{i % 700}", at(i), i, "xy"[i * 7 // 1_000 % 2]) for i in range(2_800)]
    for part in range(2):
        write(spark, str(tmp_path / "in"), rows[part * 1_400:(part + 1) * 1_400], part)
    write(spark, str(tmp_path / "in"), [("beat", at(10**8), 0, "z")], 9)
    found = run(spark, str(tmp_path / "in"), str(tmp_path / "out"), step_seconds=60)
    assert keys_of(found) == keys_of(changes(spark.createDataFrame(rows, SCHEMA), "owner", "at", "seq", "text"))
