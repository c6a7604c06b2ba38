import subprocess
import sys

import pytest

from spanveil.operators.gazetteer import gazetteer_detect
from spanveil.streaming.ingest import ledger_rows, take_in, take_in_waiting

SCHEMA = "id long, text string"


def test_a_broken_file_is_set_aside_and_read_when_mended(spark, tmp_path):
    source, out, ledger = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ledger")
    source.mkdir()

    def write(name, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "one"))
        (source / name).write_bytes(next((tmp_path / "one").glob("*.parquet")).read_bytes())

    def process(rows, name):
        rows.write.mode("overwrite").parquet(f"{out}/part={name}")

    def run():
        schema = spark.createDataFrame([], SCHEMA).schema
        take_in(spark, str(source), schema, process, ledger, str(tmp_path / "cp"), "*.parquet", files_per_batch=2,
                available_now=True).awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    for i in range(3):
        write(f"{i}.parquet", [(10 * i + j, "t") for j in range(3)])
    (source / "bad.parquet").write_bytes(b"PAR1 no parquet at all PAR1")
    assert run() == [0, 1, 2, 10, 11, 12, 20, 21, 22]
    waiting = ledger_rows(spark, ledger).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["done"]) for r in waiting] == [("bad.parquet", False)] and waiting[0]["reason"]
    write("3.parquet", [(30, "t")])
    assert run() == [0, 1, 2, 10, 11, 12, 20, 21, 22, 30]
    assert ledger_rows(spark, ledger).first()["attempts"] > waiting[0]["attempts"]
    write("bad.parquet", [(99, "mended")])
    schema = spark.createDataFrame([], SCHEMA).schema
    assert len(take_in_waiting(spark, schema, process, ledger)) == 1
    assert run() == [0, 1, 2, 10, 11, 12, 20, 21, 22, 30, 99]
    row = ledger_rows(spark, ledger).first()
    assert row["done"] and row["reason"] is None
    assert take_in_waiting(spark, schema, process, ledger) == []


def test_an_error_that_no_file_explains_is_raised(spark, tmp_path):
    from spanveil.streaming.ingest import take_in_files
    path = str(tmp_path / "a")
    spark.createDataFrame([(1, "x")], SCHEMA).write.parquet(path)

    def process(rows, name):
        raise ValueError("its own fault")

    with pytest.raises(ValueError, match="its own fault"):
        take_in_files(spark, [path], spark.createDataFrame([], SCHEMA).schema, process, str(tmp_path / "ledger"), "x")
    assert ledger_rows(spark, str(tmp_path / "ledger")).count() == 0


@pytest.mark.parametrize("rows", [200_000, 0])
def test_long_terms(spark, rows):
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a {long} b\nw0 w1 w2 w3\n{long}"), (2, "ab cd ef gh, AB-CD ef"), (None, "ab cd ef gh")],
                                 "id int, text string")
    terms = spark.createDataFrame([(long, "L", 0.5), ("w0 w1 w2", "S", 0.6), ("ab cd ef gh", "Q", 0.7), ("ab cd", "D", 0.7),
                                   ("ab cd ef gh ij", "N", 0.9)], "term string, entity string, score double")
    got = gazetteer_detect(docs, terms, ["id"], broadcast_rows=rows, salts=3)
    assert sorted((r["id"] or 0, r["line_no"], r["entity"], r["start"]) for r in got.collect()) == [
        (0, 1, "Q", 0), (1, 1, "L", 2), (1, 2, "S", 0), (1, 3, "L", 0), (2, 1, "Q", 0)]


def test_rows_do_not_grow_with_the_longest_term(spark):
    """A term of 40 words adds one look-up of three words, not forty runs a word."""
    docs = spark.createDataFrame([(1, " ".join(f"x{i}" for i in range(500)))], "id int, text string")
    terms = spark.createDataFrame([(" ".join(f"w{i}" for i in range(40)), "L", 0.5), ("y", "S", 0.5)],
                                  "term string, entity string, score double")
    from spanveil.operators import gazetteer as G
    lengths = []
    runs = G._runs
    G._runs = lambda tokens, own: lengths.append(own) or runs(tokens, own)
    try:
        assert gazetteer_detect(docs, terms, ["id"]).count() == 0
    finally:
        G._runs = runs
    assert lengths == [[1], [3]]


def test_entry_without_a_library_of_the_corpus_part():
    code = ("import sys, warnings; warnings.simplefilter('ignore'); sys.modules['xxhash'] = None; import __spark_entry__ as e; "
            "names = e.queries(); assert len(names) > 65 and not any(n.startswith('op') for n in names), len(names); "
            "assert set(e.oracle_sql()) <= set(names)")
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
