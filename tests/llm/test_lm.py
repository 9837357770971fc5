"""The language model: counts and scores against plain recursions, gradients against finite differences, held-out texts, awkward rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paneltide.llm import lm

from .helpers import awkward, corpus, prose, words


def lower(text):
    return words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows):
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*lower(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = [*lower(t), None]
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    return sorted(out, key=str)


def rows_of(out):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out), key=str)


def scored(df, known=None):
    return lm.score(df, known or lm.learn(df.where(lm.training()), (2, 2)))


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 30, 0])
def test_base_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = corpus() + [(3000, "only here"), (2, "Only HERE again É")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = lm.learn(df.where(lm.training()), (2, 2))
    out = scored(df, known).collect()
    assert rows_of(out) == brute(rows)
    assert all(r["score"] <= 0 for r in out)
    if frequent == 30:
        assert len(known["outcomes"].word) == 30


def test_scores_are_log_probabilities(spark, monkeypatch):
    """A text's score by a plain recursion over the model; probabilities of all outcomes of a context add up to one."""
    monkeypatch.setattr(lm, "WORDS", 12)
    rng = random.Random(1)
    rows = [(i, prose(rng, 20, bag=10)) for i in range(40)] + [(100, ""), (101, "never seen w1x1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = lm.learn(df.where(lm.training()), (2, 2))
    p, o = known["p"], known["outcomes"]
    seen = Counter(w for i, t in rows if not held(i) for w in lower(t))
    _, kind, _ = lm.tokens(pa.array([w for w in seen]))
    kinds = dict(zip(seen, kind[::2].tolist()))
    code = dict(zip(seen, lm.tokens(pa.array([w for w in seen]))[0][::2].tolist()))
    own = set(o.word.tolist())
    rest = [w for w in seen if code[w] not in own]
    probability = lambda one, two: np.exp(s := (p["R"][one] @ p["C"] + p["R"][two] @ p["D"]) @ p["Q"][:, :-1].T + p["Q"][:, -1]) / np.exp(s).sum()
    for r in scored(df, known).collect():
        one = two = o.size
        total = 0.0
        for w in [*lower(dict(rows)[r["doc_id"]]), None]:
            h, k, _ = lm.tokens(pa.array([w or ""]))
            out = int(o.of(h[:1], k[:1])[0])
            total += math.log10(probability(one, two)[out])
            if w is not None and out > o.end:
                same = [x for x in rest if kinds[x] == k[0]]
                total += math.log10((seen[w] + 1) / (sum(seen[x] for x in same) + len(same) + 1))
            one, two = out, one
        assert abs(total - r["score"]) < 1e-3 * max(1, abs(total))


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(3)
    o = lm.Outcomes(np.arange(5, dtype=np.int64), np.arange(5) + 1, 4, rng.integers(0, 5, lm.CLASSES))
    p = {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) for k, v in lm.start(o).items()}
    one, two, target, noise = (rng.integers(0, o.size, 30) for _ in range(4))
    args = (one, two, target, noise, np.log(o.noise()))
    g = lm.gradients(p, *args)
    for name in p:
        dense = np.zeros_like(p[name])
        if isinstance(g[name], tuple):
            rows, value = lm.summed(*g[name])
            dense[rows] = value
        else:
            dense = g[name]
        for at in zip(*(rng.integers(0, n, 12) for n in p[name].shape)):
            at = (int(rng.choice(one)), at[1]) if name == "R" else (int(rng.choice(target)), at[1]) if name == "Q" else at
            keep, eps = p[name][at], 1e-6
            p[name][at] = keep + eps
            up = lm.loss(p, *args)
            p[name][at] = keep - eps
            down = lm.loss(p, *args)
            p[name][at] = keep
            assert abs((up - down) / (2 * eps) - dense[at]) < 1e-6


def test_better_than_counts_on_held_out_texts(spark):
    """Words follow each other by a rule; counts alone do not know it."""
    rng = random.Random(2)

    def text():
        w = rng.randrange(30)
        out = []
        for _ in range(60):
            out.append(f"v{w}")
            w = (w * 7 + rng.choice([1, 2])) % 30
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(1500)], "doc_id long, text string").repartition(3)
    out = lm.score(df, lm.learn(df.where(lm.training()))).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (out[0] - out[1]) / out[2] > 0.3


def test_lm_awkward(spark):
    df = awkward(spark).withColumns({c: F.lit("clash") for c in ("word", "kind", "row", "held_out", "value")})
    out = scored(df).collect()
    assert rows_of(out) == brute([tuple(r) for r in awkward(spark).select("doc_id", "text").collect()])
    assert all(math.isfinite(r["score"]) for r in out)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert scored(empty).count() == 0
    nothing = lm.learn(empty)
    (r,) = scored(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), nothing).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] < 0
    rows = [(1, None), (3, ""), (None, ""), (4, "")]
    assert rows_of(scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)
