"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages (runs of PASSAGE words). Every passage of the whole text is described by its words and byte 4-grams,
hashed, and by shares of kinds of characters and words; this is encoded by a small layer, weighted by gated attention, and the weighted
mean of the encodings is scored. Labels are of texts; which passages matter is learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, held_out
from .text import LOWER, Rolling, mix, pieces, ranges, utf8, words

#: Words of a passage; labelled texts that are learned from at most, about; passages of one of them at most.
PASSAGE, LEARN_TEXTS, LEARN_PASSAGES = 64, 2500, 256
#: Bytes of text that are described at once: every byte takes some hundred bytes meanwhile.
SLICE = 1 << 18
#: Places of the hashed words, and of the hashed 4-grams, of a passage.
HASHED = 128
#: Width of the encoding and of the attention, steps and rate of the optimiser, decay of weights and of those of hashed places.
WIDTH, GATE, STEPS, RATE, DECAY, HASHED_DECAY = 16, 8, 150, 0.03, 1e-4, 1e-3
#: A text with at least this score is predicted to be good.
THRESHOLD = 0.7

_GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:'\"()-", "!?", "#$%&*@^~+=<>/\\_", "|[]{}", " ", "\n")
_CLASS = np.full(256, len(_GROUPS) + 1, np.uint8)  # control characters
_CLASS[128:] = len(_GROUPS)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g.encode())] = _i
N_CLASSES = len(_GROUPS) + 2
N_SURFACE = N_CLASSES + 9
N_FEATURES = N_SURFACE + 2 * HASHED


def _hashed(passage: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Rows of unit length: for each passage how often (square root) its codes (32 bits) fall on each place, with a sign by the code."""
    place = (code >> np.uint32(24)) % np.uint32(HASHED)
    sign = 1.0 - (code >> np.uint32(15) & np.uint32(2))
    x = np.bincount(passage * HASHED + place, weights=sign, minlength=n * HASHED).reshape(n, HASHED)
    x = np.sign(x) * np.sqrt(np.abs(x))
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbers for all passages, and the n + 1 offsets of the texts. A text without words has one passage of zeros."""
    data, off = utf8(column)
    n = len(column)
    start, end, row = words(data, off)
    first = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(first)
    per = np.maximum(1, -(-count // PASSAGE))
    ends = np.cumsum(per)
    bounds = np.concatenate([[0], ends])
    text = np.repeat(np.arange(n), per)
    number = np.arange(len(text)) - np.repeat(ends - per, per)
    x = np.zeros((len(text), N_FEATURES), np.float32)
    full = count[text] > 0
    if len(start):
        w0 = (first[:-1][text] + number * PASSAGE)[full]
        w1 = np.minimum(w0 + PASSAGE, first[1:][text[full]])
        a, z = start[w0], end[w1 - 1]
        size = np.maximum(z - a, 1)
        nw = (w1 - w0).astype(np.float32)
        kinds = _CLASS[data]
        f = np.zeros((len(w0), N_FEATURES), np.float32)
        for k in range(N_CLASSES):
            c = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int32)])
            f[:, k] = (c[z] - c[a]) / size

        def share(flag: np.ndarray) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
            return (c[w1] - c[w0]) / nw

        code = Rolling(LOWER[data]).span(start, end)
        length = (end - start).astype(np.float32)
        same = np.zeros(len(code), bool)
        same[1:] = code[1:] == code[:-1]
        passage = np.repeat(np.arange(len(w0)), w1 - w0)
        order = np.lexsort((code, passage))
        again = np.zeros(len(code), bool)
        again[order[1:]] = (code[order[1:]] == code[order[:-1]]) & (passage[order[1:]] == passage[order[:-1]])
        last = kinds[end - 1]
        upper = np.concatenate([[0], np.cumsum(kinds == 0, dtype=np.int32)])
        lower = np.concatenate([[0], np.cumsum(kinds == 1, dtype=np.int32)])
        extra = [share(same), share(again), share((last == 4) | (last == 5)), share(last == 6), share((upper[end] - upper[start] > 1) & (lower[end] == lower[start])), np.log1p(nw), np.add.reduceat(length, w0)[: len(w0)] / nw, share(length > 20), share(last == 3)]
        f[:, N_CLASSES:N_SURFACE] = np.stack(extra, 1)
        f[:, N_SURFACE : N_SURFACE + HASHED] = _hashed(passage, (mix(code) >> np.uint64(32)).astype(np.uint32), len(w0))
        # 4-grams inside a passage
        low = LOWER[data].astype(np.uint32)
        gram = (low[:-3] << np.uint32(24) | low[1:-2] << np.uint32(16) | low[2:-1] << np.uint32(8) | low[3:]) * np.uint32(0x9E3779B1)
        gram = (gram ^ gram >> np.uint32(15)) * np.uint32(0x85EBCA6B)
        count = np.maximum(z - a - 3, 0)
        f[:, N_SURFACE + HASHED :] = _hashed(np.repeat(np.arange(len(w0)), count), gram[ranges(a, count)] if len(gram) else np.zeros(0, np.uint32), len(w0))
        x[full] = f
    return x, bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(x: np.ndarray, off: np.ndarray, p: dict) -> dict:
    """Encodings, attention and scores of bags off[i]:off[i + 1] of passages x, which are standardised already if p has no mean."""
    h = np.tanh(((x - p["mean"]) / p["scale"] if "mean" in p else x) @ p["W"] + p["b"])
    v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (v * u) @ p["w"]
    bag = np.repeat(np.arange(len(off) - 1), np.diff(off))
    e = np.exp(e - np.maximum.reduceat(e, off[:-1])[bag])
    a = e / np.add.reduceat(e, off[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, off[:-1], axis=0)
    return {"h": h, "v": v, "u": u, "a": a, "bag": bag, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}


def gradients(x: np.ndarray, off: np.ndarray, y: np.ndarray, p: dict) -> dict:
    """Of the mean cross-entropy of the bags' labels, by each weight; x is standardised."""
    f = forward(x, off, p)
    ds = ((f["score"] - y) / len(y)).astype(x.dtype)
    away = (ds[:, None] * p["c"])[f["bag"]]
    da = (f["h"] * away).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, off[:-1])[f["bag"]])
    dv = de[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2)
    du = de[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
    dh = (f["a"][:, None] * away + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ ds, "d": ds.sum()}


def start(rng: np.random.Generator, y: np.ndarray, n: int = N_FEATURES) -> dict:
    return {"W": rng.normal(0, n**-0.5, (n, WIDTH)), "b": np.zeros(WIDTH), "V": rng.normal(0, 0.3, (WIDTH, GATE)), "U": rng.normal(0, 0.3, (WIDTH, GATE)), "w": rng.normal(0, 0.3, GATE), "c": np.zeros(WIDTH), "d": np.array(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))}


def train(x: np.ndarray, off: np.ndarray, y: np.ndarray, seed: int = 7) -> dict:
    """Adam on the cross-entropy of the bags' labels, all bags in each step."""
    p = {k: v.astype(np.float32) for k, v in start(np.random.default_rng(seed), y).items()}
    fixed = {"mean": x.mean(0), "scale": x.std(0) + 1e-3}
    xs = (x - fixed["mean"]) / fixed["scale"]
    decay = np.full((N_FEATURES, 1), DECAY, np.float32)
    decay[N_SURFACE:] = HASHED_DECAY
    decay = {k: np.float32(DECAY) for k in p} | {"W": decay, "d": np.float32(0)}
    m, s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, STEPS + 1):
        g = gradients(xs, off, y, p)
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k in p:
            grad = g[k] + decay[k] * p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.99 * s[k] + 0.01 * grad**2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return p | fixed


def learn(docs: DataFrame, labels: DataFrame, limit: int = LEARN_TEXTS) -> dict | None:
    """A model from (doc_id, text) and (doc_id, quality); None without labels. About `limit` texts, chosen by a hash of the id, and
    of a longer one LEARN_PASSAGES evenly spaced passages, are described on the executors and fitted on the driver."""
    spark = docs.sparkSession
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    n = labels.count()
    if not n:
        return None
    share = min(1.0, limit / n)
    chosen = labels.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)) < share).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # about `limit` rows
    bags = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE):
            x, off = features(batch.column("text"))
            rows = [x[np.unique(np.linspace(a, z - 1, min(z - a, LEARN_PASSAGES)).astype(int))] for a, z in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "quality", "x"])

    rows = sorted(bags.mapInArrow(describe, "doc_id long, quality long, x binary").toLocalIterator(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    if not rows:
        return None
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    off = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
    return train(np.concatenate(xs), off, np.array([r["quality"] for r in rows], float))


def score(docs: DataFrame, model: dict | None, with_passages: bool = True) -> DataFrame:
    """Per row of (doc_id, text): score, predicted, and each passage's attention. Rows are independent: repeated rows have repeated results.

    Null and empty texts are a bag of one empty passage and are scored as such. Without a model all scores are 0.5. A null id is a row like any other,
    columns beside these two are left out whatever their names, and an empty table gives none.
    """
    model = docs.sparkSession.sparkContext.broadcast({k: np.asarray(v, np.float32) for k, v in model.items()} if model else None)
    labels = ["doc_id", "score", "predicted", "attention"][: 4 if with_passages else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE):
            x, off = features(batch.column("text"))
            if model.value is None:
                s, a = np.full(batch.num_rows, 0.5), np.repeat(1 / np.diff(off), np.diff(off)).astype(np.float32)
            else:
                f = forward(x, off, model.value)
                s, a = f["score"].astype(np.float64), f["a"].astype(np.float32)
            columns = [batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(a))]
            yield pa.RecordBatch.from_arrays(columns[: len(labels)], labels)

    schema = "doc_id long, score double, predicted int" + ", attention array<float>" * with_passages
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a score of THRESHOLD or more; all rows without a model."""
    if model is None:
        return docs
    model = docs.sparkSession.sparkContext.broadcast({k: np.asarray(v, np.float32) for k, v in model.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE):
            yield batch.filter(pa.array(forward(*features(batch.column("text")), model.value)["score"] >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out())
    return score(docs, learn(docs, labels), with_passages=False).select("doc_id", held_out().alias("held_out"), "score", "predicted")
