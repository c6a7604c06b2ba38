import random

from helpers import collected, documents, odd_rows
from spanveil.llm import decontaminate as D
from spanveil.llm.decontaminate import decontaminate
from spanveil.llm.queries import op10_decontamination, table

ITEMS = "item_id long, text string"


def brute(text, items, least=0.8, k=5):
    """Items whose question and answer shingles the whole text holds, without index or passages."""
    words = [w for w in map(D.normal, (text or "").split()) if w]
    out = []
    for item, body in items:
        question, answer = D.split_item(body or "")
        parts = [p for p in (question, answer) if p]
        ok = bool(parts)
        for part in parts:
            size = min(k, len(part))
            seen = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}
            wanted = D.shingles(part, k)
            ok = ok and len(wanted & seen) >= least * len(wanted) - 1e-9
        if ok and item is not None:
            out.append(item)
    return sorted(set(out))


def test_whole_table_as_brute_force(spark, sf_dir):
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    got = {r["doc_id"]: list(r["items"]) for r in op10_decontamination(spark, sf_dir).collect()}
    assert got == {i: brute(t, items) for i, t in texts.items()}


def test_plain_copies_are_all_found(spark):
    folder = "/root/testdata/sf0.01"
    items = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
    texts = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    got = {r["doc_id"]: set(r["items"]) for r in op10_decontamination(spark, folder).collect()}
    held = {i: {n for n, x in items if x in t} for i, t in texts.items()}
    assert any(held.values()) and all(held[i] <= got[i] for i in texts)


def test_question_alone_is_no_leak_and_long_items(spark):
    rng = random.Random(4)
    word = lambda: f"t{rng.randrange(10**6)}"
    question, answer = " ".join(word() for _ in range(30)) + "?", " ".join(word() for _ in range(8)) + "."
    long_item = ". ".join(" ".join(word() for _ in range(20)) for _ in range(30)) + "."
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [
        (1, f"{filler(77)} {question} {answer} {filler(200)}", "en", "s", 1), (2, f"{filler(50)} {question} {filler(99)}", "en", "s", 1),
        (3, f"{filler(50)} {answer} {filler(99)}", "en", "s", 1), (4, f"{filler(333)}\n{long_item.upper()}\n{filler(10)}", "en", "s", 1),
        (5, filler(500), "en", "s", 1), (6, f"{answer} {filler(1000)} {question}", "en", "s", 1),
    ]
    bench = spark.createDataFrame([(7, f"{question} {answer}"), (7, f"{question} {answer}"), (8, long_item), (9, None), (10, " "), (None, filler(20))], ITEMS)
    for size in (D.INDEX_BYTES, 100):
        got = decontaminate(documents(spark, rows, clashing=True), bench, index_bytes=size)
        assert {r["doc_id"]: list(r["items"]) for r in got.collect()} == {1: [7], 2: [], 3: [], 4: [8], 5: [], 6: []}


def test_infix_distance_as_cell_by_cell():
    rng = random.Random(3)
    for _ in range(300):
        part = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        region = [rng.randrange(-1, 4) for _ in range(rng.randrange(0, 30))]
        row = list(range(len(part) + 1))
        best = row[-1]
        for word in region:
            before, row[0] = row[0], 0
            for j, x in enumerate(part, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != word))
            best = min(best, row[-1])
        assert D.infix_distance(part, region) == best


def test_items_with_one_edited_word_are_found(spark):
    """Every item of five words or more, with each of its words in turn replaced or left out."""
    bench = table(spark, "/root/testdata/sf0.01", "benchmark")
    rng, rows, want = random.Random(9), [], {}
    for item in bench.collect():
        words = item["text"].split()
        if len([w for w in words if D.normal(w)]) < 5:
            continue
        for at in range(len(words)):
            for put in ([f"zz{rng.randrange(10**6)}"], []):
                filler = [f"f{rng.randrange(10**6)}" for _ in range(60)]
                want[len(rows)] = item["item_id"]
                rows.append((len(rows), " ".join(filler[:30] + words[:at] + put + words[at + 1:] + filler[30:]), "en", "s", 1))
    got = {r["doc_id"]: list(r["items"]) for r in decontaminate(documents(spark, rows), bench).collect()}
    missed = [i for i in want if want[i] not in got[i]]
    assert len(want) > 1000 and not missed, (len(missed), [rows[i][1] for i in missed[:3]])


def test_odd_rows_and_empty_tables(spark):
    rows = odd_rows()
    bench = spark.createDataFrame([(1, "Same text here and again")], ITEMS)
    got = collected(decontaminate(documents(spark, rows, clashing=True), bench, keep=["lang"]), "doc_id", "contaminated")
    assert got == sorted(((r[0], r[0] in (5, 6)) for r in rows), key=repr)
    none = decontaminate(documents(spark, rows), spark.createDataFrame([], ITEMS))
    assert none.filter("contaminated").count() == 0 and none.count() == len(rows)
    assert decontaminate(documents(spark, []), bench).count() == 0


def test_split():
    assert D.split_item("Who? Me now.") == (["who"], ["me", "now"])
    assert D.split_item("one two\nthree") == (["one", "two"], ["three"])
    assert D.split_item("a b c d e f g h") == (list("abcdef"), list("gh"))
    assert D.split_item("word") == (["word"], []) or D.split_item("word") == ([], ["word"])
