"""Language identification of mixed-language text.

The scripts of a word's letters (Unicode ranges) narrow the candidate languages; each word gets a score for each candidate
from hashed byte 4-grams; Viterbi with a penalty for each switch labels spans; the text's language is the one with most
letters. Scripts and 4-grams of each language are learned from labelled text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, held_out
from .text import characters, pieces, utf8, words

#: First code point, script of the letters from there on by Unicode block (fixed values); 0 for scripts without a number of their own.
SCRIPTS = (
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x00AB, 0), (0x00B5, 1), (0x00B6, 0), (0x00BA, 1), (0x00BB, 0), (0x00C0, 1), (0x00D7, 0), (0x00D8, 1), (0x00F7, 0), (0x00F8, 1),
    (0x02B0, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0B80, 10), (0x0C00, 11), (0x0E00, 12), (0x0E80, 0), (0x10A0, 13), (0x1100, 14), (0x1200, 15), (0x13A0, 0),
    (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x3040, 16), (0x3100, 0), (0x3400, 17), (0xA000, 0), (0xA640, 3), (0xA6A0, 0), (0xAC00, 14), (0xD7B0, 0), (0xF900, 17), (0xFB00, 0), (0x20000, 17), (0x32000, 0),
)
#: Letters of other scripts; no script, but inside words: combining marks.
N_SCRIPTS, REST, MARK = 19, 18, 255
#: Slots of the 4-gram table of each language (256 KB in the model); texts of each language that are learned from at most, about.
SLOTS, LEARN_TEXTS = 1 << 16, 1500
#: Share of a language's letters from which a script is one of its own; cost of a switch in nats; words of a block, with
#: FEW languages at most (a block is solved for each language that may come before it).
OWN_SCRIPT, SWITCH, BLOCK, FEW = 0.02, 14.0, 128, 16
#: Scores (words x languages) that are held at once, about, but for a single longer text.
SCORES = 1 << 22

_FOLD = np.full(256, 32, np.uint8)  # letters' bytes, lower case; all else is a border
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """The script of each code point that is a letter by its Unicode category, MARK for combining marks, 0 for all else."""
    out = np.zeros(0x110000, np.uint8)
    starts = [a for a, _ in SCRIPTS]
    for (a, kind), z in zip(SCRIPTS, [*starts[1:], len(out)]):
        out[a:z] = kind or REST
    kind = np.array([unicodedata.category(chr(c))[0] for c in range(len(out))])
    return np.where(kind == "L", out, np.where(kind == "M", MARK, 0)).astype(np.uint8)


def scripts(data: np.ndarray) -> np.ndarray:
    """The script at the first byte of each letter, MARK at that of each combining mark, 0 elsewhere."""
    out = np.zeros(len(data), np.uint8)
    out[(data | 0x20) - np.uint8(97) < 26] = 1
    at, point, _ = characters(data)
    out[at] = letters()[point]
    return out


def grams(data: np.ndarray, script: np.ndarray) -> np.ndarray:
    """The slot of the 4 bytes from one before each byte, with all that is no letter or mark as a border."""
    folded = _FOLD[data].astype(np.uint32)
    # bytes of other characters (dashes, quotation marks, symbols) are borders too
    inner = data >= 0x80
    if inner.any():
        lead = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0))
        folded[inner & (script[lead] == 0)] = 32
    x = np.full(len(data) + 3, 32, np.uint32)
    x[1:-2] = folded
    h = x[:-3] * np.uint32(0x01000193) ^ x[1:-2] * np.uint32(0x9E3779B1) ^ x[2:-1] * np.uint32(0x85EBCA6B) ^ x[3:] * np.uint32(0xC2B2AE35)
    return ((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


class Scanned:
    """Words with letters of a slice of texts: their scripts, letters and 4-grams."""

    def __init__(self, column: pa.Array):
        self.data, self.off = utf8(column)
        self.n = len(column)
        script = scripts(self.data)
        self.script = np.where(script == MARK, 0, script)  # of letters alone
        start, end, row = words(self.data, self.off)
        if len(start):
            letters = np.concatenate([[0], np.cumsum(self.script > 0)])
            count = letters[end] - letters[start]
            most = np.maximum.reduceat(self.script, start)  # bytes between words are no letters
            keep = count > 0
            self.start, self.end, self.row, self.letters, self.kind = start[keep], end[keep], row[keep], count[keep], most[keep]
        else:
            self.start = self.end = self.row = self.letters = np.zeros(0, np.int64)
            self.kind = np.zeros(0, np.uint8)
        self.gram = grams(self.data, script)
        self.live = _FOLD[self.data] != 32


def learn(docs: DataFrame, limit: int = LEARN_TEXTS) -> dict | None:
    """Scripts and 4-gram log frequencies of each language, from (lang, text, doc_id); None if there is nothing to learn from.

    Every language that occurs is learned. About `limit` texts of each are read, chosen by a hash of the id; the driver gets
    sums alone: SLOTS and N_SCRIPTS numbers for each language. That is bounded by the number of languages alone: `lang` must not hold junk values.
    """
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}  # a row for each language
    if not sizes:
        return None
    names = sorted(sizes)
    share = F.create_map(*(F.lit(x) for k in names for x in (k, min(1.0, limit / sizes[k]))))
    chosen = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)) < share[F.col("lang")])
    number = F.create_map(*(F.lit(x) for i, k in enumerate(names) for x in (k, i)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            s = Scanned(batch.column("text"))
            row = np.repeat(np.asarray(batch.column("number")).astype(np.int64) * (SLOTS + N_SCRIPTS), np.diff(s.off))
            live, letter = np.flatnonzero(s.live), np.flatnonzero(s.script)
            at, n = np.unique(np.concatenate([row[live] + s.gram[live], row[letter] + SLOTS + s.script[letter]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["at", "n"])

    counted = chosen.select("text", number[F.col("lang")].alias("number")).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(names), SLOTS + N_SCRIPTS))
    table.ravel()[counted["at"].to_numpy(np.int64)] = counted["n"].to_numpy(np.float64)
    seen, letters = table[:, :SLOTS], table[:, SLOTS:]
    used = max(1, int((seen.sum(0) > 0).sum()))
    logs = np.log((seen + 0.1) / (seen.sum(1, keepdims=True) + 0.1 * used))
    own = letters / np.maximum(letters.sum(1, keepdims=True), 1) >= OWN_SCRIPT
    return {"names": names, "logs": (logs - logs.mean(0)).T.astype(np.float32), "own": own.T.copy()}


def word_scores(s: Scanned, model: dict) -> np.ndarray:
    """A row for each word and a column for each language; languages without the word's script are far behind."""
    n = len(model["names"])
    gain = np.where(s.live, s.gram, np.uint32(SLOTS))
    logs = np.vstack([model["logs"], np.zeros((1, n), np.float32)])
    out = np.empty((len(s.start), n), np.float32)
    for k in range(n):
        sums = np.concatenate([[0.0], np.cumsum(logs[:, k][gain], dtype=np.float64)])
        out[:, k] = sums[s.end] - sums[s.start]
    allowed = model["own"][s.kind]
    allowed |= ~allowed.any(1, keepdims=True)
    return np.where(allowed, out, out - 60)


def viterbi(score: np.ndarray, off: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word, for many texts at once (text i has words off[i] to off[i + 1]).

    All texts take a step at a time. As each switch costs the same, a label is either kept or comes from the best one, so a
    word needs one bit for each label and the best label before it. With FEW labels texts are cut into blocks, every block is solved for
    each label that may come before it, and blocks are joined along each text and traced back. The labels are those of
    the plain recursion; of equal ones the first.
    """
    n, k = score.shape
    if n == 0:
        return np.zeros(0, np.int64)
    sizes = np.diff(off)
    block = BLOCK if k <= FEW else int(sizes.max())
    per = -(-sizes // block)
    text = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = off[:-1][text] + number * block
    size = np.minimum(block, off[1:][text] - first)
    order = np.argsort(-size, kind="stable")
    first_o, size_o = first[order], size[order]
    # labels that may come before a block: none where a text is one block
    away = (switch * (1 - np.eye(k))).astype(np.float32) if k <= FEW else np.zeros((1, k), np.float32)
    best = score[first_o][:, None, :] - away  # block, label before it, last label
    kept, source = np.zeros((n, *away.shape), bool), np.zeros((n, len(away)), np.int16)
    for t in range(1, int(size_o[0])):
        m = int(np.searchsorted(-size_o, -t, side="left"))  # blocks with more than t words
        b, at = best[:m], first_o[:m] + t
        top = b.argmax(2)
        change = np.take_along_axis(b, top[:, :, None], 2) - np.float32(switch)
        kept[at], source[at] = b >= change, top
        best[:m] = np.maximum(b, change) + score[at][:, None, :]
    whole = np.empty_like(best)
    whole[order] = best
    # join the blocks of each text, longest texts first
    start = np.cumsum(per) - per
    longest = np.argsort(-per, kind="stable")
    longest = longest[per[longest] > 0]
    v = np.zeros((len(longest), len(away)), np.float64)
    before = np.zeros((len(text), k), np.int16)
    for j in range(int(per[longest[0]])):
        m = int(np.searchsorted(-per[longest], -j, side="left"))
        at = start[longest[:m]] + j
        through = v[:m, :, None] + whole[at]
        before[at] = through.argmax(1)
        if j == 0:
            v = np.zeros((len(longest), k))
        v[:m] = through.max(1)
    last, prior = np.zeros(len(text), np.int16), np.zeros(len(text), np.int16)
    state = v.argmax(1).astype(np.int16)
    for j in range(int(per[longest[0]]) - 1, -1, -1):
        m = int(np.searchsorted(-per[longest], -j, side="left"))
        at = start[longest[:m]] + j
        last[at] = state[:m]
        state[:m] = prior[at] = before[at, state[:m]]
    out = np.empty(n, np.int64)
    now, given = last[order], prior[order]
    for t in range(int(size_o[0]) - 1, -1, -1):
        m = int(np.searchsorted(-size_o, -t, side="left"))
        at = first_o[:m] + t
        out[at] = now[:m]
        if t:
            now[:m] = np.where(kept[at, given[:m], now[:m]], now[:m], source[at, given[:m]])
    return out


def identify(docs: DataFrame, model: dict | None, with_spans: bool = True) -> DataFrame:
    """Per row of (doc_id, text): lang_pred, score (share of the letters in spans of that language) and the spans.

    A span is (lang, start, end) in bytes, from the first byte of its first word to the end of its last. `und` with score
    0 for a text that is null or has no letter (by Unicode category), and for all if there was nothing to learn from.
    Of languages with equal shares the first by name is taken. Rows are independent: repeated rows get the same result, an
    empty table gives none; columns of docs other than doc_id and text are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
    labels = ["doc_id", "lang_pred", "score", "spans"][: 4 if with_spans else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        # a word takes some six bytes of text
        for batch in pieces(batches, "text", 1 << 20 if m is None else min(1 << 20, 6 * SCORES // len(m["names"]))):
            if m is None:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(["und"] * batch.num_rows), pa.array([0.0] * batch.num_rows), pa.array([[]] * batch.num_rows, kinds[3])][: len(labels)], labels)
                continue
            s, k = Scanned(batch.column("text")), len(m["names"])
            off = np.searchsorted(s.row, np.arange(s.n + 1))
            lab = viterbi(word_scores(s, m), off)
            share = np.bincount(s.row * k + lab, weights=s.letters, minlength=s.n * k).reshape(s.n, k)
            total = share.sum(1)
            pick = share.argmax(1)
            names = np.array([*m["names"], "und"], object)
            pred = names[np.where(total > 0, pick, k)]
            score = share[np.arange(s.n), pick] / np.maximum(total, 1)
            columns = [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)]
            if with_spans:
                new = np.ones(len(lab), bool)
                new[1:] = (lab[1:] != lab[:-1]) | (s.row[1:] != s.row[:-1])
                a = np.flatnonzero(new)
                z = np.append(a[1:], len(lab))[: len(a)] - 1
                base = s.off[s.row[a]]
                flat = pa.StructArray.from_arrays([pa.array(names[lab[a]], pa.string()), pa.array(s.start[a] - base), pa.array(s.end[z] - base)], ["lang", "start", "end"])
                columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(s.row[a], np.arange(s.n + 1)), pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(columns, labels)

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang:string,start:long,end:long>>" * with_spans
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs.where(~held_out()).select("doc_id", "lang", "text"))
    return identify(docs, model, with_spans=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
