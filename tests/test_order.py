import random
import time

import pytest
from pyspark.sql import functions as F

from spanveil.operators import detect, history, redact
from spanveil.operators.order import with_place
from spanveil.operators.rules import catalog, only
from spanveil.sources import history_store
from spanveil.sources.text import read_lines
from spanveil.plans import jobs

MARKS = only(catalog(), "PRIVATE_KEY", "EMAIL_ADDRESS")
BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


@pytest.mark.parametrize("parts", [1, 7])
def test_places(spark, parts):
    dice = random.Random(parts)
    rows = [(dice.choice([None, 1, 2, 3]), dice.randrange(50), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "a int, b int, i int").repartition(parts)
    got = with_place(frame, F.col("a").desc(), F.col("b"), F.col("i")).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1], r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in got) == list(range(1, 501))


def test_places_of_ties_and_of_nothing(spark):
    got = with_place(spark.range(100).selectExpr("1 as k", "id"), F.col("k")).collect()
    assert sorted(r["place"] for r in got) == list(range(1, 101))
    assert with_place(spark.range(0).toDF("k"), F.col("k")).count() == 0


def one_text(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id int, text string")


@pytest.mark.parametrize(("text", "want"), [
    (f"a {BEGIN}\nx\n{END} b", "a <PRIVATE_KEY> b"),
    (f"a {BEGIN}\nx\ny", "a <PRIVATE_KEY>"),
    (f"a {BEGIN}\n{BEGIN}\n{END}\nb {BEGIN}", "a <PRIVATE_KEY>\nb <PRIVATE_KEY>"),
    (f"{END} a", f"{END} a"), (f"{BEGIN}{END}{BEGIN}{END}x", "<PRIVATE_KEY><PRIVATE_KEY>x"),
    ("-----BEGIN CERTIFICATE-----\nx", "-----BEGIN CERTIFICATE-----\nx"),
])
def test_blocks_between_marks(spark, text, want):
    row = redact.redact(one_text(spark, text), MARKS).first()
    assert row["redacted_text"] == want
    assert row["redacted"] == (want != text)


def test_begin_marks_without_end_take_linear_time(spark):
    def seconds(size):
        began = time.perf_counter()
        row = redact.redact(one_text(spark, (BEGIN + "\n") * (size // 32)), MARKS).first()
        assert row["redacted_text"] == "<PRIVATE_KEY>"
        return time.perf_counter() - began

    seconds(1_000)
    small, large = min(seconds(100_000) for _ in range(2)), seconds(1_000_000)
    assert large < 15 * max(small, 0.5)


def review(text, spark):
    row = redact.redact(one_text(spark, text), MARKS, with_folds=True).withColumnRenamed("text", "original_text")
    pairs = history.aligned_lines(row, "doc_id").orderBy("line_no").collect()
    return [(r["original_line"], r["redacted_line"], r["flagged"]) for r in pairs]


def test_lines_stay_beside_their_equals(spark):
    text = f"a\r\nb {BEGIN}\rk\r\n{END} c {BEGIN}\n{END}\nm x@y.co\n\nlast"
    assert review(text, spark) == [
        ("a", "a", False), (f"b {BEGIN}", "b <PRIVATE_KEY> c <PRIVATE_KEY>", True), ("k", "", True),
        (f"{END} c {BEGIN}", "", True), (END, "", True), ("m x@y.co", "m <EMAIL_ADDRESS>", True), ("", "", False),
        ("last", "last", False)]
    assert review("plain\ntext", spark) == [("plain", "plain", False), ("text", "text", False)]
    assert [r[0:2] for r in review(f"{BEGIN}\nk", spark)] == [(BEGIN, "<PRIVATE_KEY>"), ("k", "")]


def test_no_folds_where_breaks_are_kept(spark):
    row = redact.redact(one_text(spark, f"{BEGIN}\nk\n{END}\nz"), MARKS, preserve_newlines=True, with_folds=True).first()
    assert row["review_lines"]["folded"] == [] and row["redacted_text"] == "<PRIVATE_KEY>\n\n\nz"


def test_lines_of_split_files(spark, tmp_path):
    dice = random.Random(2)
    breaks = ["\n"] * 20 + ["\r\n"] * 3 + ["\x0b", " ", "\r", "\n\n"]
    for name, own in (("one", breaks), ("two", ["\n"]), ("three", ["\r\n"])):
        text = "".join(f"{name} {i} " + "é" * dice.randrange(30) + dice.choice(own) for i in range(4_000))
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    (tmp_path / "none.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = read_lines(spark, str(tmp_path), "*.txt")
        assert lines.rdd.getNumPartitions() > 8
        got = {(r["doc_id"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = set()
    for path in tmp_path.glob("*.txt"):
        with open(path, newline="", encoding="utf-8") as file:
            want |= {(path.name, n, x) for n, x in enumerate(file.read().splitlines(), 1) if x.strip()}
    assert got == want


def test_scan_of_files_equals_scan_of_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\nmail a@b.co\n" * 50 + "\x0bghp_" + "a" * 36)
    from spanveil.sources.text import read_files
    whole = jobs.scan(read_files(spark, str(tmp_path)))
    parts = jobs.scan_files(spark, str(tmp_path))
    assert sorted(map(str, whole.select(*parts.columns).collect())) == sorted(map(str, parts.collect()))
    assert whole.count() == 51


def test_unusable_histories(spark):
    texts = spark.createDataFrame([(1, None), (2, "{"), (3, '{"a": 1}'), (4, "[]"), (5, '"x"'), (6, "")], "id int, history string")
    assert {(r["id"], r["reason"]) for r in history_store.unusable(texts).collect()} == {
        (1, "missing"), (2, "invalid JSON"), (3, "history is not a JSON list"), (5, "history is not a JSON list"),
        (6, "invalid JSON")}


def test_limit_of_each_owner(spark):
    rows = spark.createDataFrame([(o, t, f"{o}{t}") for o in ("a", "b", "c", "d", None) for t in range(150)], "o string, t int, i string")
    settings = spark.createDataFrame([("a", 3, True), ("b", 0, True), ("c", 5, False)], "o string, history_limit int, keep_history boolean")
    got = history.newest_by_settings(rows, settings, "o", "o", "t", "i")
    assert {r["o"]: r["count"] for r in got.groupBy("o").count().collect()} == {"a": 3, "b": 1, "d": 100, None: 100}
    assert {r["t"] for r in got.filter("o = 'a'").collect()} == {147, 148, 149}
