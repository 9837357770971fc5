"""Vector code compression against a brute-force form, and on awkward rows."""

import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paneltide.llm import codes

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=codes.ROUNDS):
    """{vec_id: (code, error)} and the digest, entry by entry and component by component."""
    good = sorted((i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    n = len(good[0][1]) // 4
    cut = lambda v, p: v[p * n : p * n + n]
    books = [[cut(v, p) for _, v, _ in good[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(4):
            own = defaultdict(list)
            for _, v, _ in good:
                own[near(v, p)[1]].append(cut(v, p))
            new.append([[sum(c) // len(c) for c in zip(*own[k])] if own[k] else e for k, e in enumerate(books[p])])
        books = new
    out, labels = {}, defaultdict(int)
    for i, v, lab in good:
        best = [near(v, p) for p in range(4)]
        out[i] = ("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab)
        labels[lab] += out[i][1]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {i: (c, e, labels[lab], digest) for i, (c, e, lab) in out.items()}


def table(rng, n, size):
    rows = [(7 * i % 10007, [rng.choice([-1.5, 0.25, 0.0, 1e-4, rng.gauss(0, 1)]) for _ in range(size)], rng.choice([None, 1, 2, 2, 2])) for i in range(n)]
    rows += [(20_000, None, 1), (20_001, [None] * size, 1), (20_002, [float("nan")] + [0.0] * (size - 1), 2), (20_003, [0.0] * (size - 1) + [float("-inf")], None), (-5, rows[0][1], 9), (-4, rows[0][1], None)]
    return rows


@pytest.mark.parametrize("n,size", [(400, 8), (30, 4), (300, 12)])
def test_codes(spark, n, size):
    rows = table(random.Random(n), n, size)
    single = [(i, None if v is None else [x if x is None else float.fromhex(float(x).hex()) for x in v], lab) for i, v, lab in rows]
    df = spark.createDataFrame(single, KIND.replace("float", "double"))
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in codes.compress(df.repartition(5)).collect()}
    assert got == brute(rows)


def test_blocks_do_not_show(spark, monkeypatch):
    df = spark.createDataFrame(table(random.Random(2), 500, 8), KIND)
    a = {tuple(r) for r in codes.compress(df).collect()}
    monkeypatch.setattr(codes, "BLOCK_ROWS", 3)
    assert a == {tuple(r) for r in codes.compress(df.repartition(7, "label")).collect()}


def test_codes_awkward(spark):
    rows = [(1, [1.0] * 8, 1), (1, [1.0] * 8, 1), (None, [2.0] * 8, None), (3, [1.0] * 7, 1), (4, [], 5), (5, [1e30] + [0.0] * 7, 2), (6, [-1e30] * 8, 2), (7, None, 1)]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("clash") for c in ("code", "error", "of", "n", "ids", "values")})
    out = codes.compress(df).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in out] == [None, 1, 1, 3, 4, 5, 6]
    assert out[1] == out[2] and out[1]["error"] == 0 and out[1]["label"] == 1
    assert out[3]["code"] is None and out[3]["error"] is None and out[3]["label_error"] == 0 and out[4]["label_error"] is None
    assert out[0]["label_error"] == out[0]["error"] == 0
    assert codes.compress(spark.createDataFrame([], KIND)).count() == 0
    for rows in ([(2, [0.5] * 6, 1), (3, [0.25] * 6, 1)], [(2, [], 1)], [(None, [1.0, 2.0], None)]):
        assert codes.compress(spark.createDataFrame(rows, KIND)).where("error = 0").count() == len(rows)
