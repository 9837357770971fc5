"""Line deduplication with a tree of log templates.

A line's words with a digit are variable fields. Lines go down a tree of fixed depth (number of words, then the leading
words, as far as it has them); in a leaf a line joins the template most like it, and places where they differ become variable too. A template
found in many different texts is boilerplate: its lines stay in the first document and are dropped from the others.
So do long lines that a few different texts have word for word.

A leaf with many different lines is dealt to parts, each of which finds templates among its own. The lines that founded them then meet in bins
by the smallest hash of their (place, word) pairs, which lines that are alike mostly share, in rounds with different hashes. Those that are alike
and have not met are found by a join: of two lines that agree in LIKE of their places each has a common pair among its rarest ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .shared import documents, forget, save
from .text import Rolling, mix, pieces, utf8, words

#: Leading words of a leaf, words of a line that counts at least, likeness to join a template, texts that make one recur.
DEPTH, LEAST_WORDS, LIKE, TEXTS = 3, 1, 0.75, 10
#: A line of at least LONG words that is the same word for word recurs from AGAIN texts on: independent texts do not agree on so many by chance.
LONG, AGAIN = 8, 3
#: Different lines of a part of a leaf or bin, about: each is compared with the templates of its part. Rounds of bins.
SPLIT, ROUNDS = 128, 3
#: Stands for a null id, before all others; bits of the map of needed lines for each and in all at most (32 MB).
NULL_ID, MAP_BITS, MAP_MOST = -(1 << 63), 16, 1 << 28

_FIELD = np.uint64(0x5DEECE66D)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_K = np.uint64(0xA0761D6478BD642F)


class Lines:
    """Lines of a slice of texts that have a word: text, number, words (hashes, fields alike), leaf, hash of all words and hash without fields."""

    def __init__(self, column: pa.Array):
        data, off = utf8(column)
        self.n = len(column)
        start, end, text = words(data, off)
        code = Rolling(data).span(start, end)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int32)])
        plain = code.copy()
        code[digits[end] > digits[start]] = _FIELD
        breaks = np.flatnonzero(data == 10)
        before = np.searchsorted(breaks, start)  # line breaks before each word, and before each text
        number = before - np.searchsorted(breaks, off[:-1])[text]
        new = np.ones(len(start), bool)
        new[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(start)))
        keep = size >= LEAST_WORDS
        self.first, self.size = first[keep], size[keep]
        self.text, self.number, self.code = text[self.first], number[self.first], code
        leaf = self.size.astype(np.uint64)
        for i in range(DEPTH):
            deep = np.flatnonzero(self.size > i)  # a shorter line has the words it has
            leaf[deep] = mix(leaf[deep] * _K + code[self.first[deep] + i])
        self.leaf = leaf
        # the hash of all words: a polynomial over them
        line = np.repeat(np.arange(len(first)), size)
        place = (np.arange(len(code)) - first[line]).astype(np.uint64) * _K
        self.hash, self.plain = (self._whole(c, place) for c in (code, plain))

    def _whole(self, code: np.ndarray, place: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(code + place), dtype=np.uint64)])
        return mix(sums[self.first + self.size] - sums[self.first] + self.size.astype(np.uint64))


def keyed(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("code"), F.struct(F.lit(0).alias("_"), *carry).alias("rest"))


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, code, number, leaf and hash of every line that counts, and the hash without fields of long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x = Lines(batch.column("text"))
            doc, code = np.asarray(batch.column("doc_id")), np.asarray(batch.column("code"))
            yield pa.RecordBatch.from_arrays([pa.array(doc[x.text]), pa.array(code[x.text]), pa.array(x.number.astype(np.int32)), pa.array(x.leaf.view(np.int64)), pa.array(x.hash.view(np.int64)), pa.array(x.plain.view(np.int64), mask=x.size < LONG)], ["doc_id", "code", "number", "leaf", "hash", "plain"])

    return docs.select("doc_id", "code", "text").mapInArrow(run, "doc_id long, code long, number int, leaf long, hash long, plain long")


def line_words(docs: DataFrame, wanted) -> DataFrame:
    """leaf, hash and words of lines whose hash is in the map `wanted`, each once for a slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x = Lines(batch.column("text"))
            bit = x.hash % np.uint64(len(wanted.value) * 64)
            keep = np.flatnonzero(wanted.value[bit >> np.uint64(6)].view(np.uint64) >> (bit & np.uint64(63)) & np.uint64(1))
            keep = keep[np.unique(x.hash[keep], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(x.leaf[keep].view(np.int64)), pa.array(x.hash[keep].view(np.int64)), pa.array([x.code[x.first[i] : x.first[i] + x.size[i]].tobytes() for i in keep], pa.binary())], ["leaf", "hash", "words"])

    return docs.select("text").mapInArrow(run, "leaf long, hash long, words binary")


class Leaf:
    """Templates of one part of a leaf, in the order in which they were found. If they wear, places where lines differ become variable."""

    def __init__(self, wear: bool = True):
        self.rows, self.names, self.first = np.zeros((0, 0), np.uint64), [], []
        self.n, self.wear = 0, wear

    def add(self, line: np.ndarray, name: int) -> int:
        """The name of the template that the line joins, or founds. A variable place is like no word."""
        if self.n:
            like = (self.rows[: self.n] == line).sum(1)
            best = int(like.argmax())
            if like[best] >= LIKE * len(line):
                row = self.rows[best]
                if self.wear:
                    row[row != line] = 0
                return self.names[best]
        if self.n == len(self.rows):
            grown = np.zeros((max(8, 2 * self.n), len(line)), np.uint64)
            grown[: self.n] = self.rows[: self.n] if self.n else 0
            self.rows = grown
        self.rows[self.n] = line
        self.names.append(name)
        self.first.append(line)
        self.n += 1
        return name


def constants(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the (place, word) pairs of each line behind its leading words, and the line of each."""
    size = np.array([len(x) for x in rows], np.int64)
    code = np.concatenate([*rows, np.zeros(0, np.uint64)])
    row = np.repeat(np.arange(len(rows)), size)
    place = np.arange(len(code)) - (np.cumsum(size) - size)[row]
    keep = place >= DEPTH
    return mix(code[keep] + place[keep].astype(np.uint64) * _K), row[keep]


def bins(rows: list[np.ndarray]) -> np.ndarray:
    """For each line and round the smallest hash of its pairs."""
    pair, row = constants(rows)
    out = np.zeros((len(rows), ROUNDS), np.uint64)
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        for i in range(ROUNDS):
            out[row[first], i] = np.minimum.reduceat(mix(pair ^ mix(np.uint64([i + 1]))), first)
    return out.view(np.int64)


def found(lines: DataFrame, wear: bool) -> DataFrame:
    """hash and template (the hash of its founder) of lines (leaf, bin, part, hash, words, at), by bin and part in their order; then for each founder its words and bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, Leaf(wear)

        def ended() -> pa.RecordBatch:
            name, rows = pa.array(part.names, pa.int64()), part.first
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * part.n, pa.int64()), name, name, pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(list(bins(rows)), pa.list_(pa.int64()))], ["leaf", "hash", "template", "words", "bins"])

        for batch in batches:
            out = []
            for *key, name, raw in zip(*(batch.column(c).to_pylist() for c in ("leaf", "bin", "part", "hash", "words"))):
                if key != now:
                    if now is not None:
                        yield ended()
                    now, part = key, Leaf(wear)
                out.append(part.add(np.frombuffer(raw, np.uint64), name))
            yield pa.RecordBatch.from_arrays([batch.column("leaf"), batch.column("hash"), pa.array(out, pa.int64()), pa.nulls(len(out), pa.binary()), pa.nulls(len(out), pa.list_(pa.int64()))], ["leaf", "hash", "template", "words", "bins"])
        if now is not None:
            yield ended()

    dealt = lines.repartition("leaf", "bin", "part").sortWithinPartitions("leaf", "bin", "part", "at", "hash")
    return dealt.select("leaf", "bin", "part", "hash", "words").mapInArrow(run, "leaf long, hash long, template long, words binary, bins array<long>")


def alike(founders: DataFrame) -> DataFrame:
    """a, b (hashes) of all lines (leaf, hash, words) of a leaf that agree in LIKE of their places."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist()]
            pair, row = constants(rows)
            needed = np.array([int(np.ceil(LIKE * len(x) - 1e-9)) - DEPTH for x in rows], np.int64)
            first = np.bincount(row, minlength=len(rows)) - needed + 1  # so many rarest ones hold a common pair
            yield pa.RecordBatch.from_arrays([batch.column("leaf").take(pa.array(row)), batch.column("hash").take(pa.array(row)), pa.array(first[row]), pa.array(pair.view(np.int64))], ["leaf", "hash", "first", "pair"])

    every = save(founders.select("leaf", "hash", "words").mapInArrow(spread, "leaf long, hash long, first long, pair long").where("first > 0"), "pairs")
    often = every.groupBy("leaf", "pair").agg(F.count(F.lit(1)).alias("often"))
    by = F.struct("often", "pair")
    ranked = every.join(often, ["leaf", "pair"]).groupBy("leaf", "hash", "first").agg(F.sort_array(F.collect_list(by)).alias("x"))  # a line's places
    rarest = F.filter(F.slice("x", F.lit(1), F.col("first").cast("int")), lambda e: e["often"] > 1)
    probes = save(ranked.select("leaf", "hash", F.explode(rarest["pair"]).alias("pair")), "probes")
    met = probes.withColumnRenamed("hash", "a").join(probes.withColumnRenamed("hash", "b"), ["leaf", "pair"]).where("a < b").select("leaf", "a", "b").distinct()
    own = founders.select("leaf", "hash", "words")
    both = met.join(own.select("leaf", F.col("hash").alias("a"), F.col("words").alias("x")), ["leaf", "a"]).join(own.select("leaf", F.col("hash").alias("b"), F.col("words").alias("y")), ["leaf", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()))
            yield batch.select(["a", "b"]).filter(pa.array([(x == y).sum() >= LIKE * len(x) for x, y in rows], pa.bool_()))

    out = save(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "alike")
    for t in (every, probes):
        forget(t)
    return out


def templates(lines: DataFrame) -> DataFrame:
    """leaf, hash and template of lines (leaf, hash, words, at) that are different; the founders of a dealt leaf's parts are then compared by their own words."""
    todo, out = save(lines.withColumn("bin", F.lit(0)), "todo"), None
    for i in range(ROUNDS + 1):
        large = save(todo.groupBy("leaf", "bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT), "large")
        part = F.coalesce(F.pmod("hash", F.ceil(F.col("n") / SPLIT)), F.lit(0))
        here = save(found(todo.join(large, ["leaf", "bin"], "left").withColumn("part", part), wear=not i), "found")
        step = here.where("words IS NULL").select("leaf", "hash", "template")
        out = step if out is None else out.join(step.select("leaf", F.col("hash").alias("template"), F.col("template").alias("next")), ["leaf", "template"], "left").select("leaf", "hash", F.coalesce("next", "template").alias("template"))
        left = here.where("words IS NOT NULL")
        if not i:  # leaves of one part are done
            left = left.join(large.select("leaf"), "leaf", "left_semi")
        forget(todo)
        todo = save(left.select("leaf", "hash", "words", F.lit(0).alias("at"), "bins", F.get("bins", F.lit(i)).alias("bin")), "todo")
        if todo.isEmpty():
            return out
    links = alike(todo)
    if not links.isEmpty():
        out = out.join(components(links).select(F.col("node").alias("template"), F.col("component").alias("next")), "template", "left").select("leaf", "hash", F.coalesce("next", "template").alias("template"))
    return out


def recurring(lines: DataFrame, keys: tuple[str, ...], texts: int) -> DataFrame:
    """doc_id, code and number of lines (keys, doc_id, code, number) whose key `texts` different texts have, but for its first document."""
    # copies of a text have one code
    often = lines.groupBy(*keys, "code").agg(F.min("doc_id").alias("doc_id")).groupBy(*keys).agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("doc_id", "code")).alias("first")).where(F.col("texts") >= texts)
    return lines.join(save(often, "often"), [*keys]).where(F.struct("doc_id", "code") > F.col("first")).select("doc_id", "code", "number")


def dedup_lines(docs: DataFrame, texts: int = TEXTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of (doc_id, text), with the columns `carry` of docs: n_lines, n_dropped, the text that is left and its SHA-256.

    Lines end at \\n; those without a word are left alone. A template recurs if `texts` different texts have
    it (copies of a text count once), a line of at least LONG words also if AGAIN different texts have it word for word.
    Its lines stay in the document of the smallest id alone (a null id is before all
    others; of one id, the smaller hash of the text). A null text stays null with no lines; repeated rows (id and text)
    are one document. A line that is as like to two templates joins the one found first, by document and number of the line. Columns beside
    these and `carry` are left out whatever their names, and an empty table gives none. A null id counts as -2**63: a row that has
    this id shares its place.
    """
    spark = docs.sparkSession
    docs = keyed(docs, carry)
    rows = save(line_rows(docs), "lines")
    # leaves with enough lines; where all lines are alike the template is the line
    leaves = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high")).where(F.col("n") >= texts).select("leaf", (F.col("low") < F.col("high")).alias("mixed"))
    leaves = save(leaves, "leaves")  # a table of its own, so that the join can split the lines of a very common leaf
    lines = save(rows.join(leaves, "leaf"), "candidates")
    mixed = save(lines.where("mixed").groupBy("leaf", "hash").agg(F.min(F.struct("doc_id", "code", "number")).alias("at")), "mixed")
    bits = min(MAP_MOST, 1 << max(16, (mixed.count() * MAP_BITS).bit_length()))
    bitmap = np.zeros(bits >> 6, np.int64)
    at = F.pmod(F.col("hash"), F.lit(bits))  # a power of 2: the same as of the unsigned number
    marks = mixed.select(at.alias("at")).groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("bits"))
    for batch in marks.toArrow().to_batches():  # MAP_MOST / 64 numbers at most
        bitmap[np.asarray(batch.column("word"))] = np.asarray(batch.column("bits"))
    word_rows = line_words(docs, spark.sparkContext.broadcast(bitmap)).groupBy("leaf", "hash").agg(F.first("words").alias("words"))
    tree = save(templates(mixed.join(word_rows, ["leaf", "hash"])), "templates")
    named = lines.join(tree, ["leaf", "hash"], "left").select("doc_id", "code", "number", "leaf", F.coalesce("template", "hash").alias("template"))
    named = save(named, "named")
    same = rows.where("plain IS NOT NULL").groupBy("plain").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("low"), F.max("code").alias("high")).where((F.col("n") >= min(AGAIN, texts)) & (F.col("low") < F.col("high"))).select("plain")
    same = save(rows.join(save(same, "repeated"), "plain").select("plain", "doc_id", "code", "number"), "same")
    drops = recurring(named, ("leaf", "template"), texts).union(recurring(same, ("plain",), min(AGAIN, texts))).distinct()
    drops = drops.groupBy(F.col("doc_id").alias("d"), F.col("code").alias("c")).agg(F.sort_array(F.collect_list("number")).alias("drop"))  # lines of one text
    for t in (rows, lines):
        forget(t)
    joined = docs.join(drops, (F.col("doc_id") == F.col("d")) & (F.col("code") == F.col("c")), "left").select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text", "drop", "rest")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist()):
                parts = text.split("\n") if text is not None else []
                left = text
                if drop:
                    gone = set(drop)
                    left = "\n".join(x for i, x in enumerate(parts) if i not in gone)
                out.append((len(parts), len(drop or ()), left, hashlib.sha256((left or "").encode()).hexdigest()))
            n, dropped, left, sha = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(left, pa.string()), pa.array(sha), batch.column("rest")], ["doc_id", "n_lines", "n_dropped", "kept", "kept_sha256", "rest"])

    schema = T.StructType([*T._parse_datatype_string("doc_id long, n_lines long, n_dropped long, kept string, kept_sha256 string").fields, docs.schema["rest"]])
    return joined.mapInArrow(apply, schema).select("doc_id", "n_lines", "n_dropped", "kept", "kept_sha256", *(F.col("rest")[c].alias(c) for c in carry))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).drop("kept")
