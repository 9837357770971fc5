"""Scores of texts by a log-bilinear language model, beside those of counts of words.

An outcome is one of the WORDS most frequent words, the end of a text, or a class of the other words (by their first two bytes). The model predicts
the vector of the next outcome from those of the last two, each through a matrix of its place; an outcome's score is the product with
its vector plus a bias. It is trained by noise-contrastive estimation: the next outcome is told from NOISE outcomes drawn by their frequency.
Every task trains a copy on its part of all training texts, row by row averages of the copies are the next round's model.
A word of a class has the class's probability times its own share of the class's words (counts and one more).

Since a context is two outcomes, the sums over all outcomes that normalise the probabilities are worked out once for every context, by matrix products.
Counts of words are of all training texts; those of FREQUENT words go to every task, those of others by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, save
from .text import LOWER, Rolling, mix, pieces, utf8, words

#: Words with a vector of their own, classes of other words, width of the vectors.
WORDS, CLASSES, WIDTH = 1023, 128, 32
#: Tokens and noise outcomes of a step, rate of the optimiser.
STEP, NOISE, RATE = 2048, 64, 0.1
#: Shares of the training texts (by a hash) that a round learns from: small ones first, so that the tasks' copies do not drift apart; all in all each text once.
SHARES = (64, 64, 32, 16, 8, 4, 4, 4)
#: Words whose counts are broadcast at most (16 bytes each); different words that a counting task holds.
FREQUENT, HELD = 1 << 17, 1 << 20
#: Stands for the end of a text among the words' hashes.
END = np.int64(-(1 << 63))


def training(doc_id: str = "doc_id") -> Column:
    """Not crc32 of the id as text mod 7 = 2; rows without an id are learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 != 2, F.lit(True))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of every token of a slice of texts, and where each text's begin and the last end. An end of text has class -1."""
    data, off = utf8(column)
    n = len(column)
    low = LOWER[data]
    start, end, row = words(low, off)
    code, kind = np.full(len(start) + n, END), np.full(len(start) + n, -1)
    at = np.arange(len(start)) + row
    code[at] = Rolling(low).span(start, end).view(np.int64)
    first = low[start].astype(np.uint64) << np.uint64(8)
    second = np.where(end - start > 1, low[np.minimum(start + 1, max(len(low) - 1, 0))] if len(low) else 0, 0).astype(np.uint64)
    kind[at] = (mix(first | second) % np.uint64(CLASSES)).astype(np.int64)
    return code, kind, np.searchsorted(row, np.arange(n + 1)) + np.arange(n + 1)


def counts(docs: DataFrame) -> DataFrame:
    """word (hash), kind (class) and n of all tokens of (text); ends of texts are tokens."""

    def table(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, kind, n = (np.concatenate(x) for x in zip(*parts))
        code, first, each = np.unique(code, return_index=True, return_inverse=True)
        return code, kind[first], np.bincount(each, weights=n).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["word", "kind", "n"])
        for batch in pieces(batches, "text"):
            code, kind, _ = tokens(batch.column("text"))
            held.append(table([(code, kind, np.ones(len(code), np.int64))]))
            if sum(len(x[0]) for x in held) > 2 * len(held[0][0]) or len(held) > 16:
                held = [table(held)]
                if len(held[0][0]) > HELD:
                    yield out()
        if held:
            held = [table(held)]
            yield out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, kind long, n long").groupBy("word", "kind").agg(F.sum("n").alias("n"))


class Outcomes:
    """Numbers of outcomes: words by their hash, the end, classes; one more stands for what is before a text."""

    def __init__(self, word: np.ndarray, n: np.ndarray, end: int, class_n: np.ndarray):
        order = np.argsort(word)
        self.word = word[order]
        self.end = len(word)
        self.size = len(word) + 1 + CLASSES
        self.n = np.concatenate([n[order], [end], class_n]).astype(np.float64)

    def of(self, code: np.ndarray, kind: np.ndarray) -> np.ndarray:
        out = self.end + 1 + kind
        if len(self.word):
            at = np.minimum(np.searchsorted(self.word, code), len(self.word) - 1)
            out = np.where(self.word[at] == code, at, out)
        out[kind < 0] = self.end
        return out

    def noise(self) -> np.ndarray:
        return (self.n + 1) / (self.n + 1).sum()

    def contexts(self, outcome: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The outcomes one and two before each; `size` before a text."""
        one, two = np.roll(outcome, 1), np.roll(outcome, 2)
        first = off[:-1]
        one[first] = two[first] = self.size
        second = first[np.diff(off) > 1] + 1
        two[second] = self.size
        return one, two


def start(outcomes: Outcomes, seed: int = 7) -> dict[str, np.ndarray]:
    """R: vectors of outcomes as context, Q: as the next with the bias in the last column, C and D: matrices of the places one and two before."""
    rng = np.random.default_rng(seed)
    q = np.column_stack([rng.normal(0, 0.1, (outcomes.size, WIDTH)), np.log(outcomes.noise())])
    near = lambda scale: np.eye(WIDTH) * scale + rng.normal(0, 0.02, (WIDTH, WIDTH))
    return {k: v.astype(np.float32) for k, v in {"R": rng.normal(0, 0.1, (outcomes.size + 1, WIDTH)), "Q": q, "C": near(1.0), "D": near(0.5)}.items()}


def hidden(p: dict, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return p["R"][one] @ p["C"] + p["R"][two] @ p["D"]


def told(p: dict, one: np.ndarray, two: np.ndarray, target: np.ndarray, noise: np.ndarray, logq: np.ndarray) -> tuple:
    """For each place the log-odds that its outcome is no noise, those of all noise outcomes there, and what they come from."""
    r1, r2 = p["R"][one], p["R"][two]
    h = r1 @ p["C"] + r2 @ p["D"]
    qt, qn, shift = p["Q"][target], p["Q"][noise], logq + logq.dtype.type(np.log(len(noise)))
    return (h * qt[:, :-1]).sum(1) + qt[:, -1] - shift[target], h @ qn[:, :-1].T + (qn[:, -1] - shift[noise]), (r1, r2, h, qt, qn)


def loss(*args) -> float:
    """Of noise-contrastive estimation, a mean over the places."""
    own, of_noise, _ = told(*args)
    return float((np.logaddexp(0, -own).sum() + np.logaddexp(0, of_noise).sum()) / len(own))


def gradients(p: dict, one: np.ndarray, two: np.ndarray, target: np.ndarray, noise: np.ndarray, logq: np.ndarray) -> dict:
    """Of loss(): by matrix, or (rows, values) with rows that may repeat."""
    own, of_noise, (r1, r2, h, qt, qn) = told(p, one, two, target, noise, logq)
    dt = (-1 / (1 + np.exp(own)) / len(target))[:, None]
    np.exp(-of_noise, out=of_noise)
    of_noise += 1
    dn = np.reciprocal(of_noise, out=of_noise)
    dn /= len(target)
    dh = dt * qt[:, :-1] + dn @ qn[:, :-1]
    dq = np.concatenate([np.column_stack([dt * h, dt]), np.column_stack([dn.T @ h, dn.sum(0)])])
    return {"C": r1.T @ dh, "D": r2.T @ dh, "R": (np.concatenate([one, two]), np.concatenate([dh @ p["C"].T, dh @ p["D"].T])), "Q": (np.concatenate([target, noise]), dq)}


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[first], np.add.reduceat(values[order], first)


def no_squares(p: dict) -> dict:
    return {k: np.full((len(v), 1), 1e-6, np.float32) for k, v in p.items()}


class Trainer:
    """A task's copy of the model: steps of a gradient scaled by the root of the sum of its squares so far (for a row as a whole)."""

    def __init__(self, p: dict, squares: dict, outcomes: Outcomes, seed: int):
        self.p, self.squares = ({k: v.copy() for k, v in x.items()} for x in (p, squares))
        self.outcomes, self.rng = outcomes, np.random.default_rng(seed)
        self.uses = {k: np.zeros(len(v)) for k, v in p.items()}
        q = outcomes.noise()
        self.logq, self.below = np.log(q).astype(np.float32), np.cumsum(q)

    def slice(self, outcome: np.ndarray, off: np.ndarray) -> None:
        one, two = self.outcomes.contexts(outcome, off)
        order = self.rng.permutation(len(outcome))
        for at in range(0, len(order), STEP):
            k = order[at : at + STEP]
            noise = np.minimum(np.searchsorted(self.below, self.rng.random(NOISE)), self.outcomes.size - 1)
            g = gradients(self.p, one[k], two[k], outcome[k], noise, self.logq)
            weight = np.float32(len(k) / STEP)  # a step of few tokens counts less
            for name, x in g.items():
                rows, value = summed(*x) if isinstance(x, tuple) else (slice(None), x)
                value = value * weight
                self.squares[name][rows] += (value * value).mean(1, keepdims=True)
                self.p[name][rows] -= RATE * weight * value / np.sqrt(self.squares[name][rows])
                self.uses[name][rows] += len(k)


def averaged(docs: DataFrame, outcomes: Outcomes, p: dict, squares: dict, round_: int) -> tuple[dict, dict]:
    """Model and sums of squares after a round: each row is the mean over the tasks that used it, by how often they did."""
    given = docs.sparkSession.sparkContext.broadcast((p, squares, outcomes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Trainer(*given.value, seed=1_000_003 * round_ + TaskContext.get().partitionId())
        for batch in pieces(batches, "text"):
            code, kind, off = tokens(batch.column("text"))
            t.slice(t.outcomes.of(code, kind), off)
        for name in t.p:
            rows = np.flatnonzero(t.uses[name])
            value = np.column_stack([t.squares[name][rows], t.p[name][rows]]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(rows), pa.array(t.uses[name][rows]), pa.array(list(value), pa.list_(pa.float64()))], ["name", "at", "uses", "value"])

    rows = docs.mapInArrow(run, "name string, at long, uses double, value array<double>")
    mean = F.array(*(F.sum(F.col("uses") * F.get("value", F.lit(i))) / F.sum("uses") for i in range(WIDTH + 2)))
    p, squares = ({k: v.copy() for k, v in x.items()} for x in (p, squares))
    for r in rows.groupBy("name", "at").agg(mean.alias("value")).collect():  # the rows of one model
        squares[r["name"]][r["at"]] = r["value"][0]
        p[r["name"]][r["at"]] = r["value"][1 : 1 + p[r["name"]].shape[1]]
    return p, squares


def normalisers(spark: SparkSession, p: dict) -> np.ndarray:
    """Logarithms of the sums over all outcomes, for each context (one before x two before): a matrix product for each outcome one before."""
    given, n = spark.sparkContext.broadcast(p), len(p["R"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = given.value
        for batch in batches:
            ids = batch.column("id").to_numpy()
            rows = []
            for i in ids:
                s = hidden(p, np.full(n, i), np.arange(n)) @ p["Q"][:, :-1].T + p["Q"][:, -1]
                most = s.max(1)
                rows.append((np.log(np.exp(s - most[:, None]).sum(1)) + most).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.binary())], ["id", "z"])

    out = np.zeros((n, n), np.float32)
    for r in spark.range(n, numPartitions=16).mapInArrow(run, "id long, z binary").toLocalIterator():
        out[r["id"]] = np.frombuffer(r["z"], np.float32)
    return out


def learn(docs: DataFrame, shares: tuple[int, ...] = SHARES) -> dict:
    """What is known of the training texts (text): outcomes and model, counts of all words as a table and of the frequent ones, N and V."""
    table = save(counts(docs), "words")
    total = table.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    plain = table.where(F.col("kind") >= 0)
    top = plain.orderBy(F.col("n").desc(), "word").limit(FREQUENT).toArrow()
    word, n = (top[c].to_numpy() for c in ("word", "n"))
    own = min(WORDS, len(word))
    # at most CLASSES rows
    of_class = {r["kind"]: (r["n"], r["v"]) for r in plain.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    class_n, class_v = (np.array([of_class.get(k, (0, 0))[i] for k in range(CLASSES)], np.int64) for i in (0, 1))
    kind = top["kind"].to_numpy()[:own]
    class_n = class_n - np.bincount(kind, weights=n[:own], minlength=CLASSES).astype(np.int64)
    class_v = class_v - np.bincount(kind, minlength=CLASSES)
    ends = (total["n"] or 0) - int(sum(a for a, _ in of_class.values()))
    outcomes = Outcomes(word[:own], n[:own], ends, class_n)
    p = start(outcomes)
    squares, texts = no_squares(p), docs.select(F.col("text").cast("string").alias("text"))
    dealt, low = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(max(shares))), 0
    for i, share in enumerate(shares if ends else ()):
        high = low + max(shares) // share
        p, squares = averaged(texts.where((dealt >= low) & (dealt < high)), outcomes, p, squares, i)
        low = high
    order = np.argsort(word)
    return {"table": plain, "word": word[order], "n": n[order], "ends": ends, "N": total["n"] or 0, "V": total["v"], "outcomes": outcomes, "p": p, "z": normalisers(docs.sparkSession, p), "class_total": np.log10(class_n + class_v + 1.0)}


def score(docs: DataFrame, known: dict) -> DataFrame:
    """Per row of (doc_id, text): n_tokens, n_known, train_tokens, base_score and score, base 10 logarithms.

    A null or empty text is an end alone. Rows are independent, rows that repeat are scored alike, a null id is a row like any other, other
    columns are left out, an empty table gives none. If nothing was learned all base scores are 0 and no word is known.
    """
    sc = docs.sparkSession.sparkContext
    given = sc.broadcast({k: v for k, v in known.items() if k != "table"})
    base = float(np.log10(known["N"] + known["V"] + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = given.value
        o, p, word = g["outcomes"], g["p"], g["word"]
        before = [p["R"] @ p[k] for k in ("C", "D")]
        for batch in pieces(batches, "text"):
            code, kind, off = tokens(batch.column("text"))
            outcome = o.of(code, kind)
            one, two = o.contexts(outcome, off)
            q = p["Q"][outcome]
            own = ((before[0][one] + before[1][two]) * q[:, :-1]).sum(1) + q[:, -1] - g["z"][one, two]
            found, n = np.zeros(len(code), bool), np.zeros(len(code), np.int64)
            if len(word):
                at = np.minimum(np.searchsorted(word, code), len(word) - 1)
                found = word[at] == code
                n[found] = g["n"][at[found]]
            n[kind < 0] = g["ends"]
            log_n = np.log10(n + 1.0)
            in_class = outcome > o.end
            ours = own / np.log(10) + np.where(in_class, log_n - g["class_total"][kind], 0.0)
            total = lambda x: np.add.reduceat(x, off[:-1])  # noqa: E731  no text is without an end
            left = np.flatnonzero(~found & (kind >= 0))
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(left, off).astype(np.int32)), pa.array(code[left]))
            columns = [pa.array(np.diff(off)), pa.array(total((n > 0).astype(np.int64))), pa.array(total(log_n) - np.diff(off) * base), pa.array(total(ours)), rest]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out")), *columns], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~training()).alias("held_out"))
    rows = rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<long>")
    rows = save(rows.withColumn("row", F.monotonically_increasing_id()), "scores")
    # counts of words beyond the frequent ones: an unknown word adds nothing
    rest = rows.where("size(rest) > 0").select("row", F.explode("rest").alias("word")).join(known["table"], "word")
    rest = rest.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("log_n"))
    out = rows.drop("rest").join(rest, "row", "left")
    more = lambda c: F.col(c) + F.coalesce("log_n", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(known["N"]).cast("long").alias("train_tokens"), more("base_score").alias("base_score"), more("score").alias("score"))


def op13_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learn(docs.where(training())))
