"""Near-duplicate texts: a join on the Jaccard similarity of word shingles, exact, without comparing all pairs.

1. Texts with the same set of shingles are one class.
2. Large groups are joined first: within buckets of minimum hashes that hold more than LARGE classes each class is compared with
   the class of the bucket that shares most buckets with others. Verified links give first components.
3. The search: tokens (shingles) have several global orders, frequent ones last in all. Similar sets share a token
   in their prefixes under every order. Classes of different components that share a token of the first order's prefix
   and pass the size and position bounds are candidates; those without a common token in the prefixes of the other
   orders go; the rest are verified on the full sets.
Pairs inside a component found in step 2 need no search, so a large group of near copies costs its size, not its square; all
other links come from step 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import documents, forget, save
from .text import LOWER, Rolling, mix, per_row, pieces, utf8, words

#: Buckets of minimum hashes of step 2 and hashes of each, classes of a bucket that is not large; orders of tokens of step 3.
BANDS, ROWS, LARGE, ORDERS = 6, 4, 16, 3
#: Equal minimum hashes that make a pair of step 2 worth a look.
ALIKE = 16
#: A shingle in more than this share of the texts (and FEW texts) is ordered by its frequency. As a text has a number of
#: shingles that does not depend on the corpus, there are (mean size / FREQUENT) such shingles at most, and where these
#: are more than TABLE (32 MB), the share is doubled until they fit. Any order is right; this one is fast.
FREQUENT, FEW, TABLE = 1 / 20_000, 8, 1 << 21
#: Bits of the map that tells which classes' sets are needed, for each class at least and in all at most (32 MB).
MAP_BITS, MAP_MOST = 16, 1 << 28


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of every text, one after the other, and their n + 1 offsets.

    Words are runs of bytes other than white space, A-Z in lower case. A text of fewer than n words has one shingle, all
    its words; one without words has none.
    """
    data, off = utf8(column)
    data = LOWER[data]
    start, end, row = words(data, off)
    count = len(column)
    if len(start) == 0:
        return np.zeros(0, np.uint64), np.zeros(count + 1, np.int64)
    w = Rolling(data).span(start, end)
    first = per_row(row, count)
    have = np.diff(first)
    k = np.uint64(0xA0761D6478BD642F)
    acc = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for i in range(n):
        acc = acc * k + w[i : len(w) - n + 1 + i]
    acc = mix(acc)
    inside = row[: len(acc)] == row[n - 1 :] if len(acc) else np.zeros(0, bool)
    parts = acc[inside]
    of = row[: len(acc)][inside]
    short = np.flatnonzero((have > 0) & (have < n))
    if len(short):
        extra = np.array([_whole(w[first[i] : first[i + 1]]) for i in short], np.uint64)
        at = np.searchsorted(of, short)
        parts, of = np.insert(parts, at, extra), np.insert(of, at, short)
    bounds = per_row(of, count)
    for a, z in zip(bounds, bounds[1:]):
        parts[a:z].sort()
    new = np.ones(len(parts), bool)
    new[1:] = (parts[1:] != parts[:-1]) | (of[1:] != of[:-1])
    return parts[new], per_row(of[new], count)


def _whole(w: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(w.tobytes(), digest_size=8).digest(), "little")


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Frequent:
    """Counts of the shingles of one task, those under a running share of its texts forgotten (lossy counting)."""

    def __init__(self):
        self.texts, self.wait, self.size = 0, [], 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, s: np.ndarray, texts: int) -> None:
        self.texts += texts
        self.wait.append(s)
        self.size += len(s)
        if self.size > 1 << 20:
            self.settle()

    def settle(self) -> None:
        if self.wait:
            k, c = np.unique(np.concatenate(self.wait), return_counts=True)
            keys = np.concatenate([self.keys, k])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], np.concatenate([self.counts, c])[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.keys, self.counts = keys[starts], np.add.reduceat(counts, starts)
            self.wait, self.size = [], 0
        if len(self.keys) > 1 << 20:
            self.trim()

    def trim(self) -> None:
        keep = self.counts >= max(2, self.texts * FREQUENT / 2)
        self.keys, self.counts = self.keys[keep], self.counts[keep]


def scan(docs: DataFrame, n: int) -> DataFrame:
    """Rows of texts (n_shingles, digest of the set, bands) and rows of shingles that are frequent in a task (token, texts)."""
    seeds = _seeds(BANDS * ROWS)
    names = ["doc_id", "n_shingles", "digest", "bands", "hashes", "token", "texts"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent()
        for batch in pieces(batches, "text"):
            s, off = shingles(batch.column("text"), n)
            size = np.diff(off)
            least = np.zeros((batch.num_rows, BANDS * ROWS), np.uint64)
            full = size > 0
            if len(s):
                for k, seed in enumerate(seeds):
                    least[full, k] = np.minimum.reduceat(s * seed ^ (s * seed >> np.uint64(31)), off[:-1][full])
            keys = np.zeros((batch.num_rows, BANDS), np.uint64)
            for b in range(BANDS):
                for k in range(ROWS):
                    keys[:, b] = mix(keys[:, b] * np.uint64(31) + least[:, b * ROWS + k] + np.uint64(b))
            digests = [_digest(s[a:z]) if z > a else None for a, z in zip(off, off[1:])]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
            hashes = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * BANDS * ROWS, pa.int32()), pa.array((least >> np.uint64(32)).astype(np.uint32).view(np.int32).ravel()))
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digests, pa.binary()), bands, hashes, none, none], names)
            frequent.add(s, batch.num_rows)
        frequent.settle()
        frequent.trim()
        for a in range(0, len(frequent.keys), 10_000):
            part = frequent.keys[a : a + 10_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), k) for k in kinds[:5]] + [pa.array(part), pa.array(frequent.counts[a : a + 10_000])], names)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, hashes array<int>, token long, texts long")


def ranks(s: np.ndarray, tokens: np.ndarray, places: np.ndarray, order: int) -> np.ndarray:
    """Keys that sort tokens in a global order: frequent ones last by frequency, ties and others by a hash of that order's own."""
    key = mix(s ^ _seeds(ORDERS)[order]) >> np.uint64(24)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        key = np.where(tokens[at] == s, key | places[at] << np.uint64(40), key)
    return key


def prefix_size(size: int, percent: int) -> int:
    """A set of this size shares a token with any similar set among the first so many of an order."""
    return size - (-(-size * percent // 100)) + 1


def index(docs: DataFrame, n: int, percent: int, frequent) -> DataFrame:
    """digest and the prefix of the first order of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, places = frequent.value
        for batch in pieces(batches, "text"):
            s, off = shingles(batch.column("text"), n)
            key = ranks(s, tokens, places, 0)
            digests, lists, bounds = [], [], [0]
            for a, z in zip(off, off[1:]):
                if z > a:
                    digests.append(_digest(s[a:z]))
                    lists.append(s[a:z][np.argsort(key[a:z], kind="stable")[: prefix_size(z - a, percent)]])
                    bounds.append(bounds[-1] + len(lists[-1]))
            flat = np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(np.diff(off) > 0)), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))], ["doc_id", "digest", "prefix"])

    return docs.mapInArrow(run, "doc_id long, digest binary, prefix array<long>")


def bitmap_of(spark: SparkSession, hashes: DataFrame, column: str) -> np.ndarray:
    """A map of bits, one at each value of a column of hashes, modulo the number of bits: a power of 2, at most MAP_MOST."""
    bits = min(MAP_MOST, 1 << max(16, (hashes.count() * MAP_BITS).bit_length()))
    out = np.zeros(bits >> 6, np.int64)
    at = F.pmod(F.col(column), F.lit(bits))
    rows = hashes.select(at.alias("at")).groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("bits"))
    for batch in rows.toArrow().to_batches():  # MAP_MOST / 64 numbers at most
        out[np.asarray(batch.column("word"))] = np.asarray(batch.column("bits"))
    return out


def postings(prefixes: DataFrame, mixed: DataFrame) -> DataFrame:
    """token, place, node, n, component, size of the tokens of prefixes (node, n, component, size, prefix) that are in `mixed`."""
    wanted = prefixes.sparkSession.sparkContext.broadcast(bitmap_of(prefixes.sparkSession, mixed, "token"))
    names = ["token", "place", "node", "n", "component", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value
        for batch in batches:
            lists = batch.column("prefix")
            token, off = np.asarray(lists.values), np.asarray(lists.offsets)
            bit = token.view(np.uint64) % np.uint64(len(bitmap) * 64)
            keep = np.flatnonzero(bitmap[bit >> np.uint64(6)].view(np.uint64) >> (bit & np.uint64(63)) & np.uint64(1))
            keep = keep[(keep >= off[0]) & (keep < off[-1])]
            row = np.searchsorted(off, keep, side="right") - 1
            rest = [batch.column(c).take(pa.array(row)) for c in names[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array((keep - off[row]).astype(np.int32)), *rest], names)

    return prefixes.select("prefix", *names[2:]).mapInArrow(run, "token long, place int, node long, n long, component long, size long").join(mixed, "token", "left_semi")


def needed_sets(docs: DataFrame, nodes: DataFrame, n: int, percent: int, frequent=None) -> DataFrame:
    """node and parts of its set, for the texts whose id is in nodes: the whole set, or with `frequent` 16 bits of each
    shingle and of those in the prefixes of the other orders.

    A bitmap of fixed size keeps most other texts out before anything is shuffled; a join removes the rest.
    """
    spark = docs.sparkSession
    bitmap = bitmap_of(spark, nodes.select(F.xxhash64("node").alias("hash")), "hash")
    at = F.pmod(F.xxhash64("node"), F.lit(64 * len(bitmap)))
    wanted = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.asarray(batch.column("at"))
                yield batch.filter(pa.array((wanted.value[at >> 6] >> (at & 63) & 1).astype(bool)))

        for batch in pieces(kept(), "text"):
            s, off = shingles(batch.column("text"), n)
            if frequent is None:
                parts = [[s[a:z].tobytes()] for a, z in zip(off, off[1:])]
            else:
                prints = (s & np.uint64(0xFFFF)).astype(np.uint16)
                keys = [ranks(s, *frequent.value, order) for order in range(1, ORDERS)]
                parts = [[np.sort(prints[a:z]).tobytes(), *(np.unique(prints[a:z][np.argsort(key[a:z], kind="stable")[: prefix_size(int(z - a), percent)]]).tobytes() for key in keys)] for a, z in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(parts, pa.list_(pa.binary()))], ["node", "parts"])

    rows = docs.select(F.col("doc_id").alias("node"), "text").where("node IS NOT NULL").withColumn("at", at)
    return rows.mapInArrow(run, "node long, parts array<binary>").join(nodes, "node", "left_semi")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    if len(x) == 0 or len(y) == 0:
        return 0
    keys, cx = np.unique(x, return_counts=True)
    other, cy = np.unique(y, return_counts=True)
    at = np.minimum(np.searchsorted(other, keys), len(other) - 1)
    return int(np.minimum(cx, cy[at])[other[at] == keys].sum())


def verify(pairs: DataFrame, sets: DataFrame, percent: int, exact: bool = True) -> DataFrame:
    """The pairs (a, b) whose sets are similar; with 16 bits of each shingle, those that may be and whose other prefixes meet."""
    kind = np.uint64 if exact else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("parts_a").to_pylist(), batch.column("parts_b").to_pylist()):
                x, y = ([np.frombuffer(v, kind) for v in z] for z in (x, y))
                ok = all(len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x[1:], y[1:]))
                if ok:
                    both = _common(x[0], y[0])
                    ok = 100 * both >= percent * (len(x[0]) + len(y[0]) - both)
                keep.append(ok)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda k: sets.select(F.col("node").alias(k), F.col("parts").alias(f"parts_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "parts_a", "parts_b").mapInArrow(run, "a long, b long")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of (doc_id, text): the smallest id that links lead to.

    Rows link when 100 * common >= percent * union of their sets of n-word shingles. Null and empty texts have no
    shingles and link with nothing. Rows with one id are one node; a null id gets the component of its class, or null. Repeated rows give repeated
    results, columns beside these two are left out whatever their names, and an empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = save(scan(docs, n), "scan")
    rows = scanned.where("n_shingles IS NOT NULL").select("doc_id", "n_shingles", "digest", "bands", "hashes")
    classes = save(rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("hashes").alias("hashes")), "classes")
    # step 2: in each bucket, the class that shares most buckets is the centre
    bands = classes.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LARGE)
    # tables of their own, so that the joins can split a very large bucket
    buckets = save(bands.join(save(shared, "shared"), "band"), "buckets")
    degree = buckets.groupBy("node").agg(F.sum("size").alias("degree"))
    bands = buckets.join(degree, "node")
    centres = bands.groupBy("band").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("top")).select("band", (-F.col("top.minus")).alias("a"))
    centres = save(centres, "centres")
    stars = bands.join(centres, "band").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    hashes = lambda k: classes.select(F.col("node").alias(k), F.col("hashes").alias(f"h{k}"))
    alike = F.size(F.filter(F.zip_with("ha", "hb", lambda x, y: x == y), lambda x: x)) >= ALIKE
    stars = save(stars.join(hashes("a"), "a").join(hashes("b"), "b").where(alike).select("a", "b"), "stars")
    forget(buckets)
    first = components(verify(stars, needed_sets(docs, save(ends(stars), "nodes"), n, percent), percent))
    known = save(classes.join(first, "node", "left").select("digest", "node", "n", F.coalesce("component", "node").alias("component")), "known")
    forget(classes)
    # step 3
    total = rows.count()
    counts = save(scanned.where("token IS NOT NULL").groupBy("token").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= max(FEW, total * FREQUENT)), "counts")
    least = max(FEW, total * FREQUENT)
    while counts.where(F.col("texts") >= least).count() > TABLE:
        least *= 2
    counts = counts.where(F.col("texts") >= least).toArrow()
    often = np.asarray(counts.column("token").combine_chunks()).view(np.uint64) if counts.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(often)
    rank = np.zeros(len(often), np.uint64)
    rank[np.lexsort((often, np.asarray(counts.column("texts").combine_chunks()) if counts.num_rows else often))] = np.arange(1, len(often) + 1, dtype=np.uint64)
    frequent = spark.sparkContext.broadcast((often[order], rank[order]))
    sizes = known.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    member = known.join(save(sizes, "sizes"), "component").select("digest", F.col("node").alias("doc_id"), "n", "component", "size")
    prefixes = save(index(docs, n, percent, frequent).join(member, ["digest", "doc_id"]).select(F.col("doc_id").alias("node"), "n", "component", "size", "prefix"), "prefixes")
    # tokens of more than one component
    tokens = prefixes.select("component", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = save(tokens.where("low < high").select("token"), "mixed")
    found = save(postings(prefixes, mixed), "postings")
    forget(prefixes)
    # two classes of different components are not both in the token's largest one
    main = save(found.groupBy("token").agg(F.max(F.struct("size", "component"))["component"].alias("main")), "main")
    found = found.join(main, "token").withColumn("minor", F.col("component") != F.col("main"))
    x, y = (found.select(*(F.col(c).alias(f"{c}{k}") for c in ("token", "place", "node", "n", "component", "minor"))) for k in "xy")
    need = F.ceil(F.lit(percent) * (F.col("nx") + F.col("ny")) / F.lit(100 + percent))
    near = (F.col("tokenx") == F.col("tokeny")) & (F.col("componentx") != F.col("componenty")) & (~F.col("minory") | (F.col("nodex") < F.col("nodey")))
    near &= (100 * F.col("nx") >= percent * F.col("ny")) & (100 * F.col("ny") >= percent * F.col("nx")) & (F.least(F.col("nx") - F.col("placex"), F.col("ny") - F.col("placey")) >= need)
    pairs = save(x.where("minorx").join(y, near).select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct(), "pairs")
    light = save(needed_sets(docs, save(ends(pairs), "nodes"), n, percent, frequent), "light")
    maybe = save(verify(pairs, light, percent, exact=False), "maybe")
    links = verify(maybe, needed_sets(docs, save(ends(maybe), "nodes"), n, percent), percent)
    place = known.select("node", "component")
    links = links.join(place.withColumnsRenamed({"node": "a", "component": "ca"}), "a").join(place.withColumnsRenamed({"node": "b", "component": "cb"}), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = components(links)
    final = known.join(joined.select(F.col("component").alias("to"), F.col("node").alias("component")), "component", "left").select("digest", F.coalesce("to", "component").alias("component_id"))
    for t in (pairs, light):
        forget(t)
    out = rows.join(final, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), n=4, percent=85)
