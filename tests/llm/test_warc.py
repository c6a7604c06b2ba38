import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from helpers import collected, duck_rows
from spanveil.llm.queries import SQL, op9_warc
from spanveil.llm.warc import base32_sha1, captures, read_captures, read_records, records, resolved, unpacked, write_archives

PAGES = "page_id long, url string, html string"


def round_trip(spark, folder, rows, **more):
    write_archives(spark.createDataFrame(rows, PAGES), str(folder), **more)
    return resolved(captures(read_records(spark, str(folder))))


def test_equals_sql(spark, sf_dir):
    names, want = duck_rows(sf_dir, SQL["op9_warc"])
    assert collected(op9_warc(spark, sf_dir), *names) == sorted(want, key=repr)


def test_round_trip_of_odd_pages(spark, tmp_path):
    trap = "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "z" * 2000 + "\r\n\r\n"
    big = "é🙂" * 600
    rows = [(1, "http://a/", trap), (2, "http://b/", trap), (3, None, big), (9, "u\r\nx", big), (4, "u", "short"),
            (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "n", big), (8, "long", "y" * 300_000)]
    got = round_trip(spark, tmp_path / "a", rows)
    digest = {h: hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in rows}
    last = {trap: 2, big: 9}
    want = [(i, len((h or "").encode()), digest[h], "revisit" if h in last and i != last[h] else "response",
             last[h] if h in last and i != last[h] else None) for i, _, h in rows]
    assert collected(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    payloads = {r["p"]: bytes(r["b"]).decode() for r in captures(read_records(spark, str(tmp_path / "a"))).filter(
        "response.type = 'response'").select(F.col("metadata.fields")["page_id"].alias("p"), F.col("response.payload").alias("b")).collect()}
    assert payloads["2"] == trap and payloads["9"] == big and payloads["6"] == ""


def test_repeated_rows_ties_and_empty_table(spark, tmp_path):
    same = "q" * 1500
    got = round_trip(spark, tmp_path / "a", [(1, "u", same)] * 3 + [(1, "v", same), (2, "w", "x")])
    # One record set per row: five rows in, five captures out.
    assert collected(got, "page_id", "record_type", "refers_to") == [
        (1, "response", None), (1, "revisit", 1), (1, "revisit", 1), (1, "revisit", 1), (2, "response", None)]
    small = round_trip(spark, tmp_path / "c", [(7, None, "z")] * 4 + [(None, "u", None)] * 2)
    assert collected(small, "page_id", "record_type", "payload_bytes") == sorted(
        [(7, "response", 1)] * 4 + [(None, "response", 0)] * 2, key=repr)
    assert round_trip(spark, tmp_path / "b", []).count() == 0


def test_lone_records_stay(spark, tmp_path):
    write_archives(spark.createDataFrame([(1, "u", "x"), (2, "v", "y")], PAGES), str(tmp_path / "a"))
    found = read_records(spark, str(tmp_path / "a"))
    alone = captures(found.filter("type <> 'request' AND NOT (type = 'metadata' AND fields['page_id'] = '1')"))
    assert collected(alone.selectExpr("request IS NULL AS r", "metadata IS NULL AS m"), "r", "m") == [(True, False), (True, True)]


def nested(df):
    return sorted(map(str, df.select("capture_id", "request", "response", "metadata").collect()))


@pytest.mark.parametrize("how", ["as written", "kinds apart", "twice", "some missing"])
def test_captures_of_one_and_of_several_archives(spark, tmp_path, how):
    rows = [(i, f"u{i}", "p" * (i * 400)) for i in range(8)] + [(8, "same", "p" * 2_800)]
    write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "a"), file_bytes=4_000)
    parts = [unpacked(p.read_bytes()) for p in sorted((tmp_path / "a").glob("*.gz"))]
    blocks = [b"WARC/1.1" + x for x in b"".join(parts).split(b"WARC/1.1")[1:]]
    files = {"as written": parts, "twice": parts * 2,
             "kinds apart": [b"".join(x for x in blocks if kind in x.split(b"\r\n")[1]) for kind in (b"request", b"re", b"metadata")],
             "some missing": [b"".join(blocks[1:-2])]}[how]
    if how == "kinds apart":
        files[1] = b"".join(x for x in blocks if x.split(b"\r\n")[1].endswith((b"response", b"revisit")))
    (tmp_path / "b").mkdir()
    for n, content in enumerate(files):
        (tmp_path / "b" / f"{n}.gz").write_bytes(gzip.compress(content))
    got = read_captures(spark, str(tmp_path / "b"))
    assert nested(got) == nested(captures(read_records(spark, str(tmp_path / "b"))))
    whole = got.filter("request is not null and response is not null and metadata is not null").count()
    assert whole == (9 if how != "some missing" else 7)


def test_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 1_200, 5), (2, "v", "x" * 1_200, 6)], PAGES + ", n long")
    pages = pages.selectExpr("*", "n as a", "n as b", "n as c", "n as d").toDF(
        "page_id", "url", "html", "first", "PAGE", "times", "turn", "Html")
    write_archives(pages, str(tmp_path / "a"))
    got = resolved(read_captures(spark, str(tmp_path / "a")))
    assert collected(got, "page_id", "record_type", "refers_to") == [(1, "revisit", 2), (2, "response", None)]


def test_parser():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 8\r\n\r\nA: b\r\n\r\n\r\n\r\n"
    assert len(list(records(one + one))) == 2
    assert unpacked(gzip.compress(one) + gzip.compress(one)) == one + one and unpacked(one) == one
    with pytest.raises(ValueError):
        list(records(one[:-9]))


def test_base32(spark):
    texts = ["", "a", "spam" * 99]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", base32_sha1(F.sha1(F.col("t").cast("binary"))).alias("d"))
    assert {r["t"]: r["d"] for r in df.collect()} == {t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts}
