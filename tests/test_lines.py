"""Line rules against plain Python."""

from pyspark.sql import functions as F

from spanveil.functions.lines import explode_lines, is_nonblank, split_lines

TEXTS = [
    "", "a", "a\n", "a\n\n", "\n", "\n\n", "a\r\nb\rc\nd", "a\vb\fc\x1cd\x1de\x1ef\x85g h i",
    "a\r\n\r\n", "\r", "é\U0001f600\nx", "a\x1fb", " \xa0\n\x1c\x1f\n　 x ",
]
BLANKS = ["", " ", "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0", "       　",
          "​", "᠎", "a", " b ", "\x00"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_split_lines_modes(spark):
    rows = frame(spark, TEXTS).select(
        "text", *[split_lines(F.col("text"), m).alias(m) for m in ("python", "lf", "normalized")]
    ).collect()
    for row in rows:
        assert row["python"] == row["text"].splitlines(), repr(row["text"])
        assert row["lf"] == row["text"].split("\n")
        assert row["normalized"] == row["text"].replace("\r\n", "\n").replace("\r", "\n").split("\n")


def test_null_text_has_no_lines(spark):
    rows = frame(spark, [None, "x"])
    assert [r["line"] for r in explode_lines(rows).collect()] == ["x"]


def test_nonblank_is_python_strip(spark):
    rows = frame(spark, BLANKS).select("text", is_nonblank(F.col("text")).alias("keep")).collect()
    assert {r["text"]: r["keep"] for r in rows} == {t: bool(t.strip()) for t in BLANKS}


def test_numbers_survive_blank_lines(spark):
    text = "a\n \n\xa0\nb\n\n"
    rows = explode_lines(frame(spark, [text]), skip_blank=True).orderBy("line_no").collect()
    want = [(i, x) for i, x in enumerate(text.splitlines(), 1) if x.strip()]
    assert [(r["line_no"], r["line"]) for r in rows] == want
