from helpers import collected, documents, odd_rows
from spanveil.llm.queries import op4_substring_dedup, table
from spanveil.llm.unit_dedup import UNITS, drop_repeated_units, normal_words


def brute(rows, unit, least_words):
    """Walk all texts in rank order and drop what was seen before."""
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "", r[0]) for r in rows}, key=lambda x: x[:2])
    seen, out = {}, {}
    for _, _, text, doc_id in order:
        spans = [m.span() for m in UNITS[unit].finditer(text)]
        keys = [" ".join(normal_words(text[a:b])) for a, b in spans]
        again = []
        for i, key in enumerate(keys):
            again.append(key in seen)
            seen.setdefault(key, (doc_id, i))
        gone, i = [], 0
        while i < len(spans):
            j = i
            while j < len(spans) and again[j]:
                j += 1
            if j > i and sum(len(k.split()) for k in keys[i:j]) >= least_words:
                gone.append((spans[i][0], spans[j][0] if j < len(spans) else len(text)))
            i = max(j, i + 1)
        left, at = "", 0
        for a, b in gone:
            left, at = left + text[at:a], b
        out[doc_id, text] = (left + text[at:], len(spans), gone)
    return out


def check(got, rows, unit, least_words):
    want = brute(rows, unit, least_words)
    for r in got:
        text, n, gone = want[r["doc_id"], r["old"] or ""]
        assert r["text"] == text and r["n_units"] == n
        assert [(x["start"], x["end"]) for x in r["removed"]] == gone


def test_whole_table_as_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("text", "old")
    rows = [(r["doc_id"], r["old"]) for r in docs.collect()]
    for unit, least in (("sentence", 20), ("line", 5), ("paragraph", 1)):
        got = drop_repeated_units(docs, text_col="old", unit=unit, least_words=least, keep=["old"]).collect()
        assert len(got) == len(rows)
        check(got, rows, unit, least)
    assert op4_substring_dedup(spark, sf_dir).filter("n_removed > 0").count() > 0


def test_long_passage_inside_a_line_is_cut(spark):
    passage = " ".join(f"Sentence number {i} has some more words." for i in range(8))
    rows = [(1, f"Begin one. {passage} Then one.", "en", "s", 1), (2, f"Begin two. {passage} Then two.", "en", "s", 1), (3, "Begin one. Clean.", "en", "s", 1)]
    got = {r["doc_id"]: r for r in drop_repeated_units(documents(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "Begin two. Then two." and got[3]["text"] == "Begin one. Clean."
    cut = got[2]["removed"][0]
    assert rows[1][1][cut["start"]:cut["end"]] == passage + " "


def test_odd_rows_ranks_and_empty_table(spark):
    rows = odd_rows()
    got = drop_repeated_units(documents(spark, rows, clashing=True), unit="line", least_words=1, keep=["lang"]).collect()
    texts = sorted((r["doc_id"] or -1, r["text"], r["n_units"]) for r in got if r["doc_id"] in (5, 6))
    assert texts == [(5, rows[4][1], 2), (5, rows[4][1], 2), (6, "", 2)]
    turned = drop_repeated_units(documents(spark, [(1, "a b c", "en", "s", 9), (2, "A b  c", "en", "s", 3)]), rank_col="n_chars", least_words=1)
    assert collected(turned, "doc_id", "text") == [(1, ""), (2, "A b  c")]
    assert drop_repeated_units(documents(spark, [])).count() == 0
