"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

Every window of LENGTH bytes is tied to an anchor inside it, its smallest hashed gram of GRAM bytes; equal windows have
equal anchors, so anchors whose gram occurs once need no further look. The others' suffixes, with what stands before
them, go to the partition of their gram in the order of the texts. There each batch gets a suffix array, is merge-scanned
against the levels of the index for matches of LENGTH bytes, and becomes a level; levels of equal size merge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, save
from .text import Rolling, pieces, utf8

#: Bytes of a repeated string, of an anchor's gram; bytes that may stand before an anchor.
LENGTH, GRAM = 100, 24
BEFORE = LENGTH - GRAM
#: Suffixes of one batch; bits of the map of repeated grams for each of them, and in all at most (32 MB).
BATCH, MAP_BITS, MAP_MOST = 40_000, 32, 1 << 28
#: A gram of more suffixes than this, and than a quarter of an average partition, is dealt out window by window.
HOT = 200_000
#: Repeated suffixes that a task of the scan holds on average, some 250 bytes each.
PER_TASK = 1 << 19

_INSIDE = 31  # low bits that hold a position


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: text, first start, number of windows, anchor (positions in data) and its gram's hash."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return none, none, none, none, np.zeros(0, np.uint64)
    at = np.arange(n - GRAM + 1)
    gram = Rolling(data).span(at, at + GRAM)
    low = gram >> np.uint64(_INSIDE) << np.uint64(_INSIDE) | at.astype(np.uint64)
    width, reach = 1, LENGTH - GRAM + 1
    while 2 * width <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < reach:
        low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
    anchor = (low & np.uint64((1 << _INSIDE) - 1)).astype(np.int64)  # one for each start
    # starts whose window crosses no border of texts
    sizes = np.diff(off)
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - LENGTH + 1, 0))
    first = np.cumsum(np.maximum(sizes - LENGTH + 1, 0)) - np.maximum(sizes - LENGTH + 1, 0)
    start = np.arange(len(text)) - first[text] + off[:-1][text]
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    return text[run], start[run], np.diff(np.append(run, len(start))), anchor[run], gram[anchor[run]]


class Suffixes:
    """Suffixes at anchors: the bytes from the anchor on and before it (backwards), the distances of the windows' starts, and their place in the order of texts."""

    def __init__(self, after: np.ndarray, before: np.ndarray, least: np.ndarray, most: np.ndarray, doc: np.ndarray, code: np.ndarray, at: np.ndarray):
        self.after, self.before, self.least, self.most, self.doc, self.code, self.at = after, before, least, most, doc, code, at

    def __len__(self) -> int:
        return len(self.at)

    def take(self, rows: np.ndarray) -> Suffixes:
        return Suffixes(*(x[rows] for x in self.parts()))

    def parts(self) -> tuple:
        return self.after, self.before, self.least, self.most, self.doc, self.code, self.at

    @staticmethod
    def join(many: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate(x) for x in zip(*(s.parts() for s in many))))

    def grams(self) -> np.ndarray:
        # a last byte that is not 0, for NumPy ignores zeros at the end of strings
        out = np.ones((len(self), GRAM + 1), np.uint8)
        out[:, :GRAM] = self.after[:, :GRAM]
        return out.view(f"S{GRAM + 1}").ravel()

    def places(self) -> np.ndarray:
        """Ranks in the order of texts; the same place in repeated rows has one rank."""
        order = np.lexsort((self.at, self.code, self.doc))
        new = np.ones(len(self), np.int64)
        d, c, a = self.doc[order], self.code[order], self.at[order]
        new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1]) | (a[1:] != a[:-1])
        out = np.empty(len(self), np.int64)
        out[order] = np.cumsum(new)
        return out


def cut(data: np.ndarray, anchor: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes after and before anchors, padded with zeros, and least and most distance of a window's start."""
    most, least = anchor - start, anchor - start - count + 1
    col = np.arange(LENGTH)
    after = data[np.minimum(anchor[:, None] + col, len(data) - 1)]
    after[col >= (LENGTH - least)[:, None]] = 0
    col = np.arange(BEFORE)
    before = data[np.maximum(anchor[:, None] - 1 - col, 0)]
    before[col >= most[:, None]] = 0
    return after, before, least.astype(np.int16), most.astype(np.int16)


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of rows of bytes and the common length of each with the one before it."""
    rows = np.ascontiguousarray(rows)
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    s = rows[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, np.concatenate([[0], common])


def repeated(s: Suffixes, place: np.ndarray) -> np.ndarray:
    """For each suffix and distance d: whether the window that starts d before the anchor occurs at an earlier place.

    Suffixes whose first LENGTH - d bytes agree are neighbours in the suffix array, those that agree in d bytes before the
    anchor are neighbours in the array of reversed prefixes; a window is known by both neighbourhoods.
    """
    n = len(s)
    out = np.zeros((n, BEFORE + 1), bool)
    if n < 2:
        return out
    by_after, same_after = _sorted(s.after)
    by_before, same_before = _sorted(s.before)
    at_after, at_before = np.empty(n, np.int64), np.empty(n, np.int64)
    at_after[by_after] = at_before[by_before] = np.arange(n)
    top = int(place.max()) + 1
    for d in range(BEFORE + 1):
        rows = np.flatnonzero((s.least <= d) & (d <= s.most))
        if len(rows) < 2:
            continue
        x, y = np.cumsum(same_after < LENGTH - d), np.cumsum(same_before < d)
        window = x[at_after[rows]] * (n + 1) + y[at_before[rows]]
        order = np.argsort(window * top + place[rows]) if n < 1 << 20 else np.lexsort((place[rows], window))
        w, p = window[order], place[rows][order]
        first = np.concatenate([[True], w[1:] != w[:-1]])
        earliest = p[np.maximum.accumulate(np.where(first, np.arange(len(w)), 0))]
        out[rows[order], d] = p > earliest
    return out


class Family:
    """Levels of suffix arrays, each about twice the size of the next or more."""

    def __init__(self):
        self.levels: list[tuple[Suffixes, np.ndarray]] = []  # sorted by the bytes after the anchor; their grams

    def related(self, batch: Suffixes) -> list[Suffixes]:
        """The suffixes of the levels whose gram occurs in the batch."""
        grams, out = np.unique(batch.grams()), []
        for level, keys in self.levels:
            lo, hi = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
            size = hi - lo
            if size.sum():
                out.append(level.take(np.repeat(hi - np.cumsum(size), size) + np.arange(size.sum())))
        return out

    def add(self, batch: Suffixes) -> np.ndarray:
        """Take a batch that comes after all earlier ones; its repeated windows as of repeated()."""
        old = self.related(batch)
        whole = Suffixes.join([*old, batch])
        n = len(whole) - len(batch)
        marks = repeated(whole, whole.places())[n:]
        d = np.arange(BEFORE + 1)
        windows = (d >= batch.least[:, None]) & (d <= batch.most[:, None])
        fresh = np.flatnonzero((windows & ~marks).any(1))
        if len(fresh):
            self.insert(batch.take(fresh))
        return marks

    def insert(self, new: Suffixes) -> None:
        while self.levels and len(self.levels[-1][0]) < 2 * len(new):
            new = Suffixes.join([self.levels.pop()[0], new])
        new = new.take(np.argsort(np.ascontiguousarray(new.after).view(f"S{LENGTH}").ravel(), kind="stable"))
        self.levels.append((new, new.grams()))


def spans(s: Suffixes, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end (in its text) of runs of marked windows; s.at is the anchor's position in the text."""
    padded = np.zeros((len(s), BEFORE + 3), np.int8)
    padded[:, 1:-1] = marks
    step = np.diff(padded, axis=1)
    row, low = np.nonzero(step == 1)
    high = np.nonzero(step == -1)[1] - 1
    return row, s.at[row] - high, s.at[row] - low + LENGTH


_FIELDS = ["gram", "sure", "doc_id", "code", "at", "least", "most", "bytes", "first", "end"]
_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary(), pa.int64(), pa.int64()]
_SCHEMA = "gram long, sure boolean, doc_id long, code long, at long, least short, most short, bytes binary, first long, end long"
#: Stands for a null id, before all others.
NULL_ID = -(1 << 63)


def _fixed(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * size, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _span_rows(s: Suffixes, marks: np.ndarray) -> pa.RecordBatch:
    row, first, end = spans(s, marks)
    empty = [pa.nulls(len(row), k) for k in _KINDS]
    return pa.RecordBatch.from_arrays([*empty[:2], pa.array(s.doc[row]), pa.array(s.code[row]), *empty[4:8], pa.array(first), pa.array(end)], _FIELDS)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: rows of one id and text are one place in the order of texts."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("code"))


def suffixes(docs: DataFrame, wanted, hot) -> DataFrame:
    """Suffixes of anchors whose gram is in the map `wanted`, and spans already found to repeat within a task's batch.

    `sure` marks the windows of grams in `hot`, which repeat: their `gram` is a hash of the whole window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, often = wanted.value, hot.value
        wait, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            s = Suffixes.join([x for x, _, _ in wait])
            gram, sure = (np.concatenate([w[k] for w in wait]) for k in (1, 2))
            marks = repeated(s, s.places())
            yield _span_rows(s, marks)
            d = np.arange(BEFORE + 1)
            rest = np.flatnonzero(((d >= s.least[:, None]) & (d <= s.most[:, None]) & ~marks).any(1))
            for a in range(0, len(rest), 5000):
                row = rest[a : a + 5000]
                x, g = s.take(row), gram[row]
                blank = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(sure[row]), pa.array(x.doc), pa.array(x.code), pa.array(x.at), pa.array(x.least), pa.array(x.most), _fixed(np.concatenate([x.after, x.before], 1)), blank, blank], _FIELDS)

        for batch in pieces(batches, "text"):
            data, off = utf8(batch.column("text"))
            doc, code = np.asarray(batch.column("doc_id")), np.asarray(batch.column("code"))
            text, start, count, anchor, gram = anchors(data, off)
            bit = gram % np.uint64(len(bitmap) * 64)
            keep = np.flatnonzero(bitmap[bit >> np.uint64(6)].view(np.uint64) >> (bit & np.uint64(63)) & np.uint64(1))
            text, start, count, anchor, gram = text[keep], start[keep], count[keep], anchor[keep], gram[keep]
            many = np.isin(gram, often)
            if many.any():
                # one row for each window, dealt out by all of its bytes
                n = np.where(many, count, 1)
                each = np.repeat(np.arange(len(n)), n)
                step = np.where(many[each], np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n), 0)
                start, count, gram = start[each] + step, np.where(many[each], 1, count[each]), np.where(many[each], Rolling(data).span(start[each] + step, start[each] + step + LENGTH), gram[each])
                text, anchor, many = text[each], anchor[each], many[each]
            for a in range(0, len(anchor), BATCH):
                z = slice(a, a + BATCH)
                wait.append((Suffixes(*cut(data, anchor[z], start[z], count[z]), doc[text[z]], code[text[z]], anchor[z] - off[text[z]]), gram[z], many[z]))
                size += len(wait[-1][1])
                if size >= BATCH:
                    yield from flush()
                    wait, size = [], 0
        if wait:
            yield from flush()

    return docs.mapInArrow(run, _SCHEMA)


def scan_levels(rows: DataFrame) -> DataFrame:
    """Spans of windows that occur at an earlier place, from suffixes dealt out by gram and sorted by place; rows that are spans already pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family()
        for batch in batches:
            known = np.asarray(batch.column("gram").is_null())
            if known.any():
                yield batch.filter(pa.array(known))
                batch = batch.filter(pa.array(~known))
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                raw = utf8(part.column("bytes"))[0].reshape(-1, LENGTH + BEFORE)
                s = Suffixes(raw[:, :LENGTH], raw[:, LENGTH:], *(np.asarray(part.column(c)) for c in ("least", "most", "doc_id", "code", "at")))
                yield _span_rows(s, family.add(s))

    return rows.mapInArrow(run, _SCHEMA)


def deal(found: DataFrame, counts: DataFrame, parts: int) -> DataFrame:
    """Suffixes dealt out by gram and sorted by place, without those whose gram does not repeat though the map let them through."""
    key = F.coalesce("gram", F.xxhash64("doc_id", "first"))
    known = counts.select(F.col("gram").alias("__key"), F.lit(True).alias("__known"))
    rows = found.withColumn("__key", key).repartition(parts, "__key").join(known, "__key", "left")
    return rows.where("__known OR sure OR gram IS NULL").select(*_FIELDS).sortWithinPartitions("doc_id", "code", "at")


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row of (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, and what is left with the removed spans.

    A byte goes if a string of LENGTH bytes over it also starts earlier: in a text of smaller id or earlier in the same.
    Null texts are empty; texts shorter than LENGTH stay whole. A null id comes before all others; texts of one id are
    ordered by a hash; repeated rows (same id and text) are one text and get the same result. Columns beside these two are left out whatever
    their names, and an empty table gives none. A null id counts as -2**63: a row that has this id shares its place.
    """
    spark = docs.sparkSession
    docs = keyed(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            gram, n = np.unique(anchors(*utf8(batch.column("text")))[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], ["gram", "n"])

    counts = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    counts = save(counts, "grams")
    total = counts.agg(F.count(F.lit(1)).alias("grams"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    bits = min(MAP_MOST, 1 << max(16, (total["grams"] * MAP_BITS).bit_length()))
    bitmap = np.zeros(bits >> 6, np.int64)
    at = F.pmod(F.col("gram"), F.lit(bits))  # bits is a power of 2: the same as of the unsigned number
    words = counts.select(at.alias("at")).groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("bits"))
    for batch in words.toArrow().to_batches():  # MAP_MOST / 64 numbers at most
        bitmap[np.asarray(batch.column("word"))] = np.asarray(batch.column("bits"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total["n"] // PER_TASK))
    # 4 * parts of them at most
    hot = np.array([r["gram"] for r in counts.where(F.col("n") > max(HOT, total["n"] / (4 * parts))).select("gram").toLocalIterator()], np.int64).view(np.uint64)
    found = suffixes(docs, spark.sparkContext.broadcast(bitmap), spark.sparkContext.broadcast(hot))
    spans = scan_levels(deal(found, counts, parts)).groupBy("doc_id", "code").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans"))
    joined = docs.withColumnRenamed("code", "c").join(spans.withColumnRenamed("doc_id", "d"), (F.col("doc_id") == F.col("d")) & (F.col("c") == F.col("code")), "left").select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text", F.transform("spans", lambda x: x["first"]).alias("first"), F.transform("spans", lambda x: x["end"]).alias("end"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"][: 7 if with_text else 5]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, off = utf8(batch.column("text"))
            rows = []
            for i in range(batch.num_rows):
                text, gone, kept, runs = data[off[i] : off[i + 1]], 0, [], []
                if (firsts := batch.column("first")[i].values) is not None and len(firsts):
                    first, end = np.asarray(firsts), np.maximum.accumulate(np.asarray(batch.column("end")[i].values))
                    new = np.concatenate([[True], first[1:] > end[:-1]])
                    first, end = first[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1]
                    gone, runs = int((end - first).sum()), list(zip(first.tolist(), end.tolist()))
                    for a, z in zip(np.append(0, end), np.append(first, len(text))):
                        kept.append(text[a:z].tobytes())
                else:
                    kept.append(text.tobytes())
                left = b"".join(kept)
                rows.append((len(text), gone, len(runs), hashlib.sha256(left).hexdigest(), left, [{"start": a, "end": z} for a, z in runs]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))][: len(names)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<struct<start:long,end:long>>" * with_text
    return joined.mapInArrow(apply, schema)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False)
