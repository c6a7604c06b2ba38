import random

from pyspark.sql import functions as F

from helpers import collected, duck_rows
from spanveil.llm.hamming_search import top_k
from spanveil.llm.queries import SQL, op2_hamming_topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, asks, k, bits):
    codes = {i: sum(1 << b for b in range(bits) if v and b < len(v) and (v[b] or 0) > 0) for i, v, _ in rows if i is not None}
    out = []
    for q in codes:
        if asks(q):
            near = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:k]
            out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return sorted(out, key=repr)


FIELDS = ("query_id", "rank", "neighbor_id", "distance")


def test_equals_sql(spark, sf_dir):
    names, want = duck_rows(sf_dir, SQL["op2_hamming_topk"])
    assert collected(op2_hamming_topk(spark, sf_dir), *names) == sorted(want, key=repr)


def test_ties_hot_codes_and_odd_vectors(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, 1.0]) for _ in range(20)], 0) for i in range(60)]
    rows += [(100 + i, [1.0] * 20, 0) for i in range(50)] + [(200, None, None), (201, [], 0), (202, [None, 1.0], 0), (203, [1.0] * 5, 0), (None, [1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.select("*", *[F.lit(i).alias(f"x{i}") for i in range(4)]).toDF(*df.columns, "id", "CODE", "Vec_ID", "n")
    asks = lambda i: i % 10 == 0
    for k, segments in ((3, 4), (12, 3)):
        got = top_k(df, F.col("vec_id") % 10 == 0, k=k, bits=20, segments=segments)
        assert collected(got, *FIELDS) == brute(rows, asks, k, 20)


def test_few_rows_and_empty_table(spark):
    two = spark.createDataFrame([(0, [1.0], 0), (1, [-1.0], 0), (1, [-1.0], 0)], SCHEMA)
    assert collected(top_k(two, F.col("vec_id") == 0, k=5, bits=8, segments=2), *FIELDS) == [(0, 1, 1, 1)]
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0
