"""History, pointers, policy tables and what a reviewer sees."""

import json

import pytest
from pyspark.sql import functions as F

from spanveil.functions import labels
from spanveil.operators import history, policy
from spanveil.operators.rules import CREDENTIAL, PII
from spanveil.plans import jobs
from spanveil.sources import history_store, policy_store, selection, text as texts


def good(i, **more):
    return {"id": f" r{i} ", "original_text": "a", "redacted_text": "b", "timestamp": f"2024-0{i}",
            "kind": "redaction", "source": "s", **more}


def test_tolerant_history_reader(spark):
    rows = [
        ("u1", json.dumps([good(1, line_numbers=[3, "2", -1, "x", None, 2.9, True, " 7 ", [], 3]),
                           good(2, line_numbers="no"), 5, {"id": " "}, good(3, original_text=4),
                           {"id": 3, "original_text": "", "redacted_text": ""},
                           {**good(4), "redacted_text": None}, good(5, original_text="")])),
        ("u2", "{\"a\": 1}"), ("u3", "not json ["), ("u4", None), ("u5", "[]"),
    ]
    frame = spark.createDataFrame(rows, "owner string, history string")
    valid, rejected = history_store.split_redactions(frame)
    got = valid.orderBy("position").collect()
    assert [(r["owner"], r["id"], r["line_numbers"]) for r in got] == [
        ("u1", "r1", [1, 2, 3, 7]), ("u1", "r2", []), ("u1", "r5", [])]
    assert {(r["position"], r["reason"]) for r in rejected.collect()} == {
        (2, "not an object"), (3, "no usable id"), (4, "original_text is not a string"),
        (5, "no usable id"), (6, "redacted_text is not a string")}


def test_history_tables(spark, tmp_path):
    path = str(tmp_path / "history")
    assert history_store.load(spark, path, history_store.REDACTION_SCHEMA).count() == 0
    docs = spark.createDataFrame([(1, "a@b.co"), (2, "x")], "doc_id int, text string")
    moment = F.lit("2024-05-01 10:00:00").cast("timestamp")
    records = history.redaction_records(jobs.redacted(docs), moment, F.lit("job"), "doc_id")
    assert records.first()["id"] == records.first()["id"]
    out = records.drop("doc_id")
    history_store.append(out, path, keep_history=False)
    assert history_store.load(spark, path, history_store.REDACTION_SCHEMA).count() == 0
    history_store.append(out, path)
    row = history_store.load(spark, path, history_store.REDACTION_SCHEMA).first()
    assert (row["redacted_text"], row["timestamp"], row["line_numbers"]) == (
        "<EMAIL_ADDRESS>", "2024-05-01T10:00:00.000000+00:00", [1])
    history_store.clear(spark, path, history_store.REDACTION_SCHEMA)
    assert history_store.load(spark, path, history_store.REDACTION_SCHEMA).count() == 0
    assert history_store.read_json_files(spark, str(tmp_path / "none")).count() == 0
    summary = history.scan_records(jobs.scan_summary(docs), moment, F.lit("job"), "doc_id")
    assert "text" not in summary.columns and summary.count() == 2


@pytest.mark.parametrize("limit", [-1, 0, 1, 3, 2000])
def test_newest_keeps_at_least_one(spark, limit):
    rows = spark.range(50).selectExpr("id % 3 as user", "id", "id div 6 as t")
    got = {(r["user"], r["id"]) for r in
           history.newest(rows, limit, ["user"], "t", "id").collect()}
    want = set()
    for user in range(3):
        ids = sorted((i for i in range(50) if i % 3 == user), key=lambda i: (-(i // 6), i))
        want |= {(user, i) for i in ids[:max(1, limit)]}
    assert got == want


POINTERS = {
    '{"id": " a "}': "a", '{"redaction_id": "b"}': "b", '"c"': "c", '{"id": 5, "redaction_id": "b"}': None,
    '{"id": null, "redaction_id": "b"}': None, '" "': None, "[1]": None, "broken": None, "{}": None,
    "7": None,
}


def test_pointer_shapes(spark):
    frame = spark.createDataFrame([(k,) for k in POINTERS], "pointer string")
    rows = frame.select("pointer", selection.selected_id(F.col("pointer")).alias("id")).collect()
    assert {r["pointer"]: r["id"] for r in rows} == POINTERS


def test_pointer_write(spark, tmp_path):
    path = str(tmp_path / "pointer")
    with pytest.raises(ValueError):
        selection.select_record(spark, path, "owner", "u", "  ")
    selection.select_record(spark, path, "owner", "u", " r1 ")
    row = selection.read_pointers(spark.read.parquet(path), "owner").first()
    assert (row["owner"], row["selected_id"]) == ("u", "r1")


def test_resolve_and_review(spark):
    records = spark.createDataFrame(
        [("u", "r1", "2024-01", "s", [2], "a\r\nb", "a\nX\nc"), ("u", "r2", "2024-02", "", [], "z", "z"),
         ("v", "q1", None, None, None, "k", "k"), ("w", "w1", "2024", "s", [1], "k", "k")],
        "owner string, id string, timestamp string, source string, line_numbers array<int>, "
        "original_text string, redacted_text string")
    pointers = spark.createDataFrame(
        [("u", "r1"), ("v", "gone"), ("w", None), ("nobody", "x")], "owner string, selected_id string")
    rows = {r["owner"]: r for r in history.resolve(records, pointers, "owner").collect()}
    assert (rows["u"]["id"], rows["u"]["mode"], rows["u"]["note"]) == ("r1", "Selected redaction", None)
    assert rows["v"]["id"] == "q1" and rows["v"]["note"].startswith("Selected ID was not found")
    assert rows["w"]["id"] == "w1" and rows["w"]["note"].startswith("No usable selection file")
    assert rows["nobody"]["id"] is None
    lines = jobs.review(records, pointers, "owner").filter("owner = 'u'").orderBy("line_no").collect()
    assert [(r["line_no"], r["original_line"], r["redacted_line"], r["flagged"]) for r in lines] == [
        (1, "a", "a", False), (2, "b", "X", True), (3, "", "c", False)]
    head = {r["owner"]: r for r in history.review_header(
        history.resolve(records, pointers, "owner"), "owner").collect()}
    assert head["u"]["subtitle"] == "Selected redaction  •  2024-01  •  1 flagged line"
    assert head["v"]["title"] == "Clipboard redaction" and "Unknown time" in head["v"]["subtitle"]


def test_wording(spark):
    row = spark.range(1).select(
        labels.entity_label(F.lit("US_SSN")).alias("label"),
        labels.percent(F.lit(0.29)).alias("percent"),
        labels.severity(F.lit(85)).alias("amber"), labels.severity(F.lit(86)).alias("red"),
        labels.masked_preview(F.lit("ghp_abc")).alias("preview"),
        labels.display_time(F.lit("2024-07-20T12:34:56+00:00")).alias("time"),
        labels.display_time(F.lit("nope")).alias("no_time"),
        labels.clean_line_numbers(F.array(*[F.lit(x) for x in ["3", "x", "-1", "3", "+2", "1_0", None]]))
        .alias("numbers"),
    ).first()
    assert tuple(row) == ("Us Ssn", int(0.29 * 100), "amber", "red", "ghp_...",
                          "20 Jul, 12:34 PM", "Unknown time", [2, 3, 10])


def test_policy_tables(spark, tmp_path):
    frame = spark.createDataFrame(
        [(1, '{"entities": {"URL": true, "NEW": true}, "credential_types": {"What": true}}'),
         (2, None), (3, "[]")], "tenant int, settings string")
    settings = policy.read_settings(frame)
    allowed = {(r["tenant"], r["entity"]) for r in policy.allow_list(settings, "tenant").collect()}
    assert {(1, "URL"), (1, "NEW"), (1, "SLACK"), (2, "US_SSN")} <= allowed
    assert (2, "URL") not in allowed and (1, "What") not in allowed
    counts = {(r["tenant"], r["category"]): (r["enabled"], r["known"]) for r in
              policy.enabled_counts(settings, "tenant").collect()}
    assert counts[(2, PII)] == (4, 12) and counts[(3, CREDENTIAL)] == (11, 11)
    edited = policy.set_category(settings, PII, False)
    assert all(r["enabled"] == 0 for r in policy.enabled_counts(edited, "tenant").collect()
               if r["category"] == PII)
    path = str(tmp_path / "settings")
    policy_store.save_settings(settings, path, "tenant")
    again = policy.read_settings(spark.read.parquet(path))
    assert sorted(map(str, policy.policy_rows(again, "tenant").collect())) == sorted(
        map(str, policy.policy_rows(settings, "tenant").collect()))
    (tmp_path / "one.json").write_text('{"language": "de"}')
    assert policy_store.load_settings(spark, str(tmp_path / "one.json")).first()["language"] == "de"
    assert policy_store.load_settings(spark, str(tmp_path / "none.json")).count() == 0


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny")
    (tmp_path / "b.txt").write_text(" \n\x1c")
    rows = texts.read_files(spark, str(tmp_path), "*.txt").collect()
    assert [r["text"] for r in rows] == ["x\ny"]
    with pytest.raises(ValueError):
        texts.from_text(spark, " \n")
    redacted = jobs.redacted(texts.from_text(spark, "a@b.co"))
    out = str(tmp_path / "out")
    with pytest.raises(ValueError):
        texts.write_redacted(redacted, out, "doc_id", source_path=out + "/")
    texts.write_redacted(redacted, out, "doc_id")
    assert spark.read.parquet(out).first()["redacted_text"] == "<EMAIL_ADDRESS>"


def test_switches_are_read_once(spark):
    frame = spark.createDataFrame(
        [("a", '{"entities": {"URL": true, "BADGE": true}, "credential_types": {"Unknown": true}}'),
         ("a", '{"entities": {"URL": false, "US_SSN": true}}'), (None, "broken"), (None, None)],
        "tenant string, settings string")
    settings = policy.read_settings(frame)
    plan = settings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.entities") == 1 and plan.count("$.credential_types") == 1
    allowed = policy.allow_list(settings, "tenant")
    assert "Union" not in allowed._jdf.queryExecution().optimizedPlan().toString()
    rows = policy.policy_rows(settings, "tenant").filter("enabled and entity is not null")
    wanted = rows.select("tenant", "entity").distinct().collect()
    assert sorted(map(str, allowed.collect())) == sorted(map(str, wanted))
    assert {"URL", "BADGE"} <= {r["entity"] for r in wanted if r["tenant"] == "a"}
