"""Changes, alerts, dictionaries, evaluation, lookups under skew, and streams."""

import random

import pytest
from pyspark.sql import functions as F

from spanveil.operators import alerts as A
from spanveil.operators.changes import changes
from spanveil.operators.evaluate import evaluate
from spanveil.operators.gazetteer import gazetteer_detect
from spanveil.operators.joins import lookup_join
from spanveil.operators.rules import catalog, only
from spanveil.streaming import monitor as M
from spanveil.streaming.state import changed_rows, prepare


def events(spark, n=600, seed=3):
    """Owner 0 has most rows; some are null and some times are equal."""
    rng = random.Random(seed)
    rows = [(i, 0 if rng.random() < 0.7 else rng.choice([1, 2, 3, None]), rng.randint(0, 200),
             rng.choice(["a@b.co", "x", "y", None])) for i in range(n)]
    frame = spark.createDataFrame(rows, "id int, owner int, sec long, text string")
    return rows, frame.select("id", "owner", F.timestamp_seconds("sec").alias("ts"), "text")


def python_changes(rows, emit_first):
    out, last = set(), {}
    for i, owner, sec, text in sorted(rows, key=lambda r: (r[2], r[0])):
        if text is None:
            continue
        if owner not in last:
            if emit_first:
                out.add(i)
        elif last[owner] != text:
            out.add(i)
        last[owner] = text
    return out


@pytest.mark.parametrize("slices", [2, 7, 64])
@pytest.mark.parametrize("emit_first", [False, True])
def test_changes_across_slices(spark, slices, emit_first):
    rows, frame = events(spark)
    got = changes(frame, "owner", "ts", "id", "text", emit_first, slices)
    assert {r["id"] for r in got.collect()} == python_changes(rows, emit_first)


def test_stream_changes_equal_batch_over_two_batches(spark, tmp_path):
    prepare(spark)
    rows, frame = events(spark)
    cut = F.timestamp_seconds(F.lit(100))
    source = str(tmp_path / "in")
    frame.filter(F.col("ts") < cut).coalesce(1).write.mode("append").parquet(source)
    frame.filter(F.col("ts") >= cut).coalesce(1).write.mode("append").parquet(source)
    stream = M.read_texts(spark, source, frame.schema, files_per_batch=1)
    out = str(tmp_path / "out")
    query = M.monitor(stream, only(catalog(), "EMAIL_ADDRESS"), out, str(tmp_path / "cp"),
                      "owner", "ts", "id", available_now=True)
    query.awaitTermination()
    changed = {r["id"] for r in spark.read.parquet(f"{out}/changes").collect()}
    assert changed == python_changes(rows, False)
    found = {r["id"] for r in spark.read.parquet(f"{out}/findings").collect()}
    mail = {r[0] for r in rows if r[3] == "a@b.co"}
    assert found == changed & mail
    assert spark.read.parquet(f"{out}/alerts").count() == len(found)
    assert spark.read.parquet(f"{out}/summary").count() == len(changed)


@pytest.mark.parametrize("small", [True, False])
def test_pauses(spark, small, monkeypatch):
    import spanveil.operators.joins as J
    if not small:
        monkeypatch.setattr(J, "is_small", lambda *_: False)
    rng = random.Random(5)
    pauses = [(rng.randint(0, 3), rng.randint(0, 5000)) for _ in range(12)]
    raised = [(i, rng.randint(0, 3), rng.randint(0, 6000)) for i in range(400)]
    raised += [(1000 + i, u, t + d) for i, (u, t) in enumerate(pauses) for d in (0, 299, 300, -1)]
    p = spark.createDataFrame(pauses, "owner int, s long").select(
        "owner", F.timestamp_seconds("s").alias("ts"))
    a = spark.createDataFrame(raised, "id int, owner int, s long").select(
        "id", "owner", F.timestamp_seconds("s").alias("ts"), "s")
    got = sorted((r["id"], r["owner"], r["s"]) for r in
                 A.suppress_paused(a, p, "owner", "ts", ["id", "s"]).collect())
    want = sorted(r for r in raised
                  if not any(u == r[1] and t <= r[2] < t + 300 for u, t in pauses))
    assert got == want


def test_alert_text(spark):
    docs = spark.createDataFrame([(1, "x\na@b.co (555) 123-4567"), (2, "clean")], "id int, text string")
    rows = A.alerts(docs, only(catalog(), "EMAIL_ADDRESS", "PHONE_NUMBER")).collect()
    assert [(r["id"], r["span_count"], r["severity"]) for r in rows] == [(1, 2, "red")]
    assert rows[0]["body"] == ("Sensitive data detected!\n• Line 2: Email Address (100%)\n"
                               "• Line 2: Phone Number (75%)")


TERMS = [("New York", "LOCATION", 0.8), ("york", "PERSON", 0.7), ("New York  Times", "ORGANIZATION", 0.9),
         ("José", "PERSON", 0.6), ("Times New", "NRP", 0.5)]


@pytest.mark.parametrize("rows", [100, 0])
def test_dictionary(spark, rows):
    terms = spark.createDataFrame(TERMS, "term string, entity string, score double")
    text = "é the NEW york,\n\nnew York times new; JOSÉ's York"
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "id int, text string")
    got = gazetteer_detect(docs, terms, ["id"], broadcast_rows=rows, salts=3).orderBy("line_no", "start")
    assert [(r["line_no"], r["entity"], r["match"], r["start"]) for r in got.collect()] == [
        (1, "LOCATION", "NEW york", 6), (3, "ORGANIZATION", "new York times", 0),
        (3, "NRP", "times new", 9), (3, "PERSON", "York", 27)]


def test_evaluate(spark):
    found = spark.createDataFrame([(1, "A"), (2, "A"), (2, "A"), (3, "B")], "k int, entity string")
    gold = spark.createDataFrame([(1, "A"), (3, "C")], "k int, entity string")
    rows = {r["entity"]: (r["hits"], r["found"], r["gold"], r["p"], r["r"]) for r in
            evaluate(found, gold, ["k"]).collect()}
    assert rows["A"] == (1, 2, 1, 0.5, 1.0) and rows["B"] == (0, 1, 0, 0.0, None)
    assert rows[None] == (1, 3, 2, 1 / 3, 0.5)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_lookup_equals_broadcast(spark, how):
    rows = spark.range(500).selectExpr("id", "if(id % 3 > 0, 1, id) as k")
    table = spark.range(1, 400, 2).selectExpr("id as k", "id * 2 as v")
    small = lookup_join(rows, table, ["k"], how, ["id"])
    large = lookup_join(rows, table, ["k"], how, ["id"], broadcast_rows=0, salts=5)
    assert sorted(small.collect()) == sorted(large.select(*small.columns).collect())


def test_late_request_stream(spark, tmp_path):
    texts = spark.createDataFrame([(1, 10, "a@b.co"), (2, 10, "a@b.co"), (3, 10, "clean")],
                                  "id int, s long, text string")
    asked = spark.createDataFrame([(1, 20), (2, 9999), (3, 20)], "id int, s long")
    texts.withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(str(tmp_path / "t"))
    asked.withColumn("asked", F.timestamp_seconds("s")).drop("s").write.parquet(str(tmp_path / "r"))
    t = M.read_texts(spark, str(tmp_path / "t"), spark.read.parquet(str(tmp_path / "t")).schema)
    r = M.read_texts(spark, str(tmp_path / "r"), spark.read.parquet(str(tmp_path / "r")).schema)
    out = M.requested_redactions(r, t, ["id"], only(catalog(), "EMAIL_ADDRESS"), "asked", "ts")
    query = (out.writeStream.format("parquet").option("path", str(tmp_path / "o"))
             .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.schema(out.schema).parquet(str(tmp_path / "o")).collect()
    assert [(x["id"], x["redacted_text"]) for x in rows] == [(1, "<EMAIL_ADDRESS>")]


def test_changed_rows_keep_their_columns(spark, tmp_path):
    prepare(spark)
    _, frame = events(spark, 10)
    frame.write.parquet(str(tmp_path / "in"))
    stream = M.read_texts(spark, str(tmp_path / "in"), frame.schema)
    assert changed_rows(stream, "owner", "ts", "id", "text").columns == frame.columns


@pytest.mark.parametrize("lengths", [("b c",), ("b c", "d e f g h")])
def test_dictionary_moves_only_runs_that_may_be_listed(spark, lengths):
    from spanveil.operators import gazetteer as G

    texts = [(i, f"a{i} b c x{i} d e f g h\n" + " ".join(f"w{i}x{j}" for j in range(200))) for i in range(20)]
    docs = spark.createDataFrame([*texts, (None, "b C"), (99, None), (100, "")], "id int, text string")
    terms = spark.createDataFrame([(t, "X", 0.5) for t in lengths], "term string, entity string, score double")
    lines = G.explode_lines(docs, "text", skip_blank=True)
    heads = [(" ".join(t.split()[:G.HEAD]),) for t in lengths]
    kept = G._candidates(lines, ["id", "line_no"], spark.createDataFrame(heads, "term string"), [[1, 2, 3]])
    moved = kept.select("id", F.inline("runs"))
    assert kept.count() == 21 and moved.count() <= 21 * len(lengths) + 20
    got = G.gazetteer_detect(docs, terms, ["id"], broadcast_rows=0, salts=2)
    want = sorted([(i, t) for i in range(20) for t in lengths], key=str) + [(None, "b C")]
    assert sorted(((r["id"], r["match"]) for r in got.collect()), key=str) == sorted(want, key=str)
