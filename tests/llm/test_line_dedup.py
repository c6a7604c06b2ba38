import hashlib
from collections import defaultdict

from helpers import LOWER, collected, documents, duck_rows, odd_rows
from spanveil.llm.line_dedup import drop_frequent_lines
from spanveil.llm.queries import SQL, op7_line_dedup

SPACES = " \t\n\x0b\x0c\r"


def brute(rows, min_docs):
    key = lambda line: line.strip(SPACES).translate(LOWER)
    held = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add((doc_id, text or ""))
    gone = {k for k, docs in held.items() if len(docs) >= min_docs and len(k) >= 1}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in gone]
        out.append((doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def test_equals_sql(spark, sf_dir):
    names, want = duck_rows(sf_dir, SQL["op7_line_dedup"])
    assert collected(op7_line_dedup(spark, sf_dir), *names) == sorted(want, key=repr)


def test_brute_force_and_odd_rows(spark):
    rows = odd_rows() + [(100 + i, f"own {i}\n  COMMON Line \t\nÄ line {i % 3}\n\nend", "en", "a", 1) for i in range(12)]
    rows += [(200, "common line\n" * 3 + "common line", "en", "a", 1)]
    got = drop_frequent_lines(documents(spark, rows, clashing=True), min_docs=4)
    assert collected(got, "doc_id", "n_lines", "n_dropped", "text") == brute(rows, 4)
    assert {r["doc_id"]: r["dropped"] for r in got.collect()}[200] == [0, 1, 2, 3]


def test_repeated_rows_are_one_document(spark):
    got = drop_frequent_lines(documents(spark, [(1, "a\nb", "en", "s", 1)] * 5), min_docs=2)
    assert collected(got, "n_dropped", "text") == [(0, "a\nb")] * 5


def test_all_lines_gone_and_empty_table(spark):
    got = drop_frequent_lines(documents(spark, [(i, "x\nX", "en", "s", 1) for i in range(3)]), min_docs=3, keep=["lang"])
    assert collected(got, "lang", "text", "n_lines", "n_dropped") == [("en", "", 2, 2)] * 3
    assert drop_frequent_lines(documents(spark, [])).count() == 0


def test_digest_of_the_query(spark, sf_dir):
    rows = op7_line_dedup(spark, sf_dir).filter("n_lines = n_dropped").limit(1).collect()
    assert all(r["kept_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
