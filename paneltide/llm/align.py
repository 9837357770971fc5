"""Alignment of two tokenizers' tokens, corpus-wide.

A slice of texts is encoded by both, and all its tokens lie in two flat Arrow columns. Ends of tokens are segmented cumulative sums of
their bytes; a token's key is its document and its end. A hash join of the keys of both sides gives the ends that both have (these
cut the text into groups) and those that one has alone. Between two neighbouring ends lies one token of each side: these are the links.
Documents keep their id pairs with the number of links of each.

Counts of pairs are partial for each slice and merged by Spark. The counts of FREQUENT pairs go to every task, those of all others by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Bpe, Memo, vocabulary_bytes
from .shared import documents, save
from .text import Rolling, pieces, ranges, utf8, words

#: Pairs whose counts are broadcast at most (16 bytes each).
FREQUENT = 1 << 20
#: Bits of a token id in a pair, and of a byte offset in a key.
ID_BITS, END_BITS = 31, 32
_BLANK = "▁"
#: Bytes inside a unit: all but a blank.
_SOLID = np.ones(256, bool)
_SOLID[32] = False


class ByteSide:
    """Byte-level BPE; special tokens' texts are plain text."""

    def __init__(self, spec: bytes):
        self.bpe = Bpe(spec)
        self.bpe.special, self.bpe.cut = {}, None

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, off = self.bpe.encode(column)
        return ids.astype(np.int64), off

    def sizes(self) -> np.ndarray:
        return np.diff(self.bpe.offsets)


class PieceSide:
    """A piece model with byte fallback. No piece goes over the start of a word, so the units of a text (blanks and what
    follows them) are encoded apart, each different one once; a model with such pieces encodes whole texts. A unit that its tokens do not spell gets
    a token without bytes, one more than the model has."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = lambda i, s: bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace(_BLANK, " ").encode()
        self.tokens = [plain(i, s) for i, s in enumerate(names)]
        self.whole = any(_BLANK in s.lstrip(_BLANK) for s in names)
        x = self.model.encode("x")
        self.blank = self.model.encode("x ")[len(x) :]  # of a blank at the end
        self.memo = Memo()

    def units(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts of the units of texts that each begin with a blank."""
        if self.whole:
            return off[:-1]
        start, end, _ = words(data, off, _SOLID)
        # a unit starts where the word before it ends, or with its text
        first = np.unique(np.concatenate([off[:-1], end]))
        return first[first < len(data)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts with a blank before each, and their offsets."""
        data, off = utf8(column)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        start = self.units(data, off)
        size = np.diff(np.append(start, len(data)))
        code = Rolling(data).span(start, start + size)
        _, one, each = np.unique(code, return_index=True, return_inverse=True)
        if (size != size[one][each]).any() or (data != data[ranges(start[one][each], size)]).any():
            one = each = np.arange(len(start))  # different units with one hash: each for itself
        first, n, ids = self.memo.find(code[one], data, start[one], size[one])
        new = np.flatnonzero(n < 0)
        if len(new):
            a, z = start[one][new], size[one][new]
            raw = data.tobytes()
            texts = [raw[i : i + k] for i, k in zip(a.tolist(), z.tolist())]
            found = self.model.encode([t[1:].decode() for t in texts], num_threads=1)  # the model puts a blank before what it encodes
            found = [f if len(t) > 1 else self.blank for f, t in zip(found, texts)]
            found = [f if b"".join(map(self.tokens.__getitem__, f)) == t else [len(self.tokens)] for f, t in zip(found, texts)]
            n[new] = [len(f) for f in found]
            first[new] = len(ids) + np.cumsum(n[new]) - n[new]
            ids = np.concatenate([ids, np.array([x for f in found for x in f], "<u4")])
            keep = new[z <= 64]
            if one is not each:
                self.memo.add(code[one][keep], data, start[one][keep], size[one][keep], ids, first[keep], n[keep])
        return ids[ranges(first[each], n[each])].astype(np.int64), np.concatenate([[0], np.cumsum(n[each])])[np.searchsorted(start, off)]

    def sizes(self) -> np.ndarray:
        return np.append([len(t) for t in self.tokens], 0)


@lru_cache(maxsize=2)
def sides(spec: bytes, model: bytes) -> tuple[ByteSide, PieceSide]:
    return ByteSide(spec), PieceSide(model)


def lists(ids: np.ndarray, off: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), pa.array(ids, pa.int64()))


def token_ends(tokens: pa.LargeListArray, sizes: pa.Array) -> pa.Table:
    """key (document and end) of every token, and its id: a cumulative sum of the bytes, less that before the document."""
    ids, doc = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    total = pc.cumulative_sum(pc.take(sizes, ids))
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), total]), tokens.offsets)  # at the start of each document
    end = pc.subtract(total, pc.take(before, doc))
    return pa.table({"key": pc.add(pc.shift_left(doc.cast(pa.int64()), END_BITS), end), "id": ids})


def links(a: pa.Table, b: pa.Table) -> pa.Table:
    """doc, a, b (ids), both (the ends agree), and number of its token on each side: a row for each stretch between neighbouring ends."""
    sides_ = [t.select(["key"]).append_column(f"in_{s}", pa.array(np.ones(t.num_rows, bool))) for s, t in (("a", a), ("b", b))]
    ends = sides_[0].join(sides_[1], "key", join_type="full outer", use_threads=False).combine_chunks()
    order = pc.sort_indices(ends["key"])  # a join gives its rows in any order
    key, in_a, in_b = (pc.take(ends[c].combine_chunks() if ends.num_rows else ends[c], order) for c in ("key", "in_a", "in_b"))
    in_a, in_b = (pc.is_valid(x) for x in (in_a, in_b))
    # the number of a token is that of the ends of its side before this one
    at = [pc.subtract(pc.cumulative_sum(x.cast(pa.int64())), x.cast(pa.int64())) for x in (in_a, in_b)]
    return pa.table({"doc": pc.shift_right(key, END_BITS), "a": pc.take(a["id"], at[0]), "b": pc.take(b["id"], at[1]), "both": pc.and_(in_a, in_b), "at_a": at[0], "at_b": at[1]})


@lru_cache(maxsize=2)
def decimal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below n, a row of bytes for each with room for a sign behind them, and how many there are."""
    width = len(str(n)) + 1
    return np.array([str(i).encode() for i in range(n)], f"S{width}").view(np.uint8).reshape(n, width), np.array([len(str(i)) for i in range(n)])


def spelled(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc: np.ndarray, n: int) -> list[str]:
    """SHA-256 of `a1,a2|b1;a3|b2,b3` for each of n documents; groups are numbered over all, doc is that of each group."""
    ends_a, ends_b = (np.searchsorted(g, np.arange(len(doc)), side="right") for g in (group_a, group_b))
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    # a token of A stands behind those of B of the groups before, one of B behind those of A up to its group
    ids[np.arange(len(ids_a)) + np.append(0, ends_b)[group_a]] = ids_a
    ids[np.arange(len(ids_b)) + ends_a[group_b]] = ids_b
    sign = np.full(len(ids), ord(","), np.uint8)
    sign[ends_a + np.append(0, ends_b[:-1])[: len(doc)] - 1] = ord("|")
    sign[ends_a + ends_b - 1] = ord(";")
    digits, size = decimal(1 << max(16, int(ids.max(initial=0)).bit_length()))
    size = size[ids]
    out = digits[ids]
    out[np.arange(len(ids)), size] = sign
    raw = out[np.arange(out.shape[1]) <= size[:, None]].tobytes()
    stop = np.concatenate([[0], np.cumsum(size + 1)])
    at = stop[np.concatenate([[0], ends_a + ends_b])[np.searchsorted(doc, np.arange(n + 1))]].tolist()
    return [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(at, at[1:])]


def aligned(column: pa.Array, a_side: ByteSide, b_side: PieceSide, with_groups: bool) -> pa.RecordBatch:
    """Per text of a slice: n_a, n_b, n_groups, n_links, groups_sha256, its id pairs (b << ID_BITS | a) with the number of links of each, and, if asked for, the groups."""
    n = len(column)
    texts = pc.fill_null(column, "")
    full = pc.greater(pc.binary_length(texts), 0)
    spaced = pc.if_else(full, pc.binary_join_element_wise(" ", texts, ""), "")
    tokens, sizes = [lists(*s.encode(spaced)) for s in (a_side, b_side)], [pa.array(s.sizes()) for s in (a_side, b_side)]
    # byte-level tokens always spell the text
    spelt = np.concatenate([[0], np.cumsum(sizes[1].to_numpy()[tokens[1].flatten().to_numpy()])])[tokens[1].offsets.to_numpy()]
    good = pc.equal(pa.array(np.diff(spelt)), pc.binary_length(spaced).cast(pa.int64()))
    if not pc.all(good).as_py():
        none = pa.nulls(n, tokens[0].type).fill_null([])
        tokens = [pc.if_else(good, t, none) for t in tokens]
    a, b = (token_ends(t, s) for t, s in zip(tokens, sizes))
    joined = links(a, b)
    doc, both = joined["doc"].to_numpy(), joined["both"].to_numpy(zero_copy_only=False)
    # pairs of each document
    pair = pc.add(pc.shift_left(joined["b"], ID_BITS), joined["a"])
    counted = pa.table({"doc": joined["doc"], "pair": pair, "one": pa.array(np.ones(len(doc), np.int64))}).group_by(["doc", "pair"], use_threads=False).aggregate([("one", "sum")])
    order = pc.sort_indices(counted, [("doc", "ascending"), ("pair", "ascending")])
    counted = counted.take(order)
    start = np.searchsorted(counted["doc"].to_numpy(), np.arange(n + 1)).astype(np.int32)
    per_doc = lambda c: pa.ListArray.from_arrays(pa.array(start), counted[c].combine_chunks() if counted.num_rows else pa.array([], pa.int64()))
    # groups: a token's is the number of common ends before it, that of any of its links
    group = np.cumsum(both) - both
    first_a, first_b = (np.flatnonzero(np.diff(joined[c].to_numpy(), prepend=-1)) for c in ("at_a", "at_b"))
    group_a, group_b = group[first_a], group[first_b]
    ids_a, ids_b = a["id"].to_numpy(), b["id"].to_numpy()
    sha = spelled(ids_a, ids_b, group_a, group_b, doc[both], n)
    count = lambda x: pa.array(np.bincount(x, minlength=n).astype(np.int64))
    columns = {"n_a": pc.list_value_length(tokens[0]).cast(pa.int64()), "n_b": pc.list_value_length(tokens[1]).cast(pa.int64()), "n_groups": count(doc[both]), "n_links": count(doc), "groups_sha256": pa.array(sha, pa.string()), "pairs": per_doc("pair"), "times": per_doc("one_sum")}
    if with_groups:
        of_doc = np.searchsorted(doc[both], np.arange(n + 1))
        cut = lambda ids, g: pa.ListArray.from_arrays(pa.array(np.searchsorted(g, np.arange(both.sum() + 1)).astype(np.int32)), pa.array(ids))
        columns["groups"] = pa.ListArray.from_arrays(pa.array(of_doc.astype(np.int32)), pa.StructArray.from_arrays([cut(ids_a, group_a), cut(ids_b, group_b)], ["a", "b"]))
    return pa.RecordBatch.from_pydict(columns)


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, with_groups: bool = False) -> DataFrame:
    """doc_id and the columns of aligned() for each row of (doc_id, text). Rows are independent; the vocabularies (3 MB, fixed) are broadcast."""
    import public_tokenizers

    sc = docs.sparkSession.sparkContext
    spec, model = sc.broadcast(vocabulary_bytes(a_path)), sc.broadcast(Path(b_path or public_tokenizers.path("piece_bpe_32k.model")).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = aligned(batch.column("text"), *sides(spec.value, model.value), with_groups)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out.columns], ["doc_id", *out.schema.names])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>" + ", groups array<struct<a: array<long>, b: array<long>>>" * with_groups
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(docs: DataFrame) -> DataFrame:
    """pair and n: links of the id pair over all alignments() rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.table({"pair": batch.column("pairs").flatten(), "n": batch.column("times").flatten()}).group_by("pair", use_threads=False).aggregate([("n", "sum")])
            yield from pa.table({"pair": t["pair"], "n": t["n_sum"]}).to_batches()

    return docs.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, with_groups: bool = False) -> DataFrame:
    """Per row of (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, the groups of ids.

    A null or empty text has no tokens (zeros and an empty text for the digest), nor has one that the tokens do not spell. n_best has the links
    whose pair is the most frequent of its B id, ties included; count_sum adds the pair's count for each link. Equal rows give equal results and all count; a null id is a
    row like any other, other columns are left out, an empty table gives none.
    """
    sc = docs.sparkSession.sparkContext
    rows = save(alignments(docs, a_path, b_path, with_groups).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = save(pair_counts(rows), "counts")
    # at most the tokens of B
    best = counts.groupBy(F.shiftright("pair", ID_BITS).alias("b")).agg(F.max("n").alias("most")).toArrow().sort_by("b")
    frequent = counts.orderBy(F.col("n").desc(), "pair").limit(FREQUENT).toArrow().sort_by("pair")
    known = sc.broadcast([x.to_numpy() for x in (best["b"], best["most"], frequent["pair"], frequent["n"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, most, pair, n = known.value
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            off = batch.column("pairs").offsets.to_numpy() - batch.column("pairs").offsets[0].as_py()
            at = np.searchsorted(pair, pairs)
            at[at == len(pair)] = 0
            found = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            mine = np.where(found, n[at] if len(n) else 0, 0)
            is_best = found & (mine == most[np.searchsorted(b, pairs >> ID_BITS)]) if len(b) else found
            total = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[off]))
            left = np.flatnonzero(~found)
            rest = lambda x: pa.ListArray.from_arrays(pa.array(np.searchsorted(left, off).astype(np.int32)), pa.array(x[left]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), total(times * is_best), total(times * mine), rest(pairs), rest(times)], ["row", "n_best", "count_sum", "pairs", "times"])

    some = save(rows.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long, pairs array<long>, times array<long>"), "some")
    rest = some.where("size(pairs) > 0").select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.*").withColumnRenamed("pairs", "pair")
    # a pair beyond the frequent ones is in few rows
    of_b = counts.groupBy(F.shiftright("pair", ID_BITS).alias("b")).agg(F.max("n").alias("most"))
    looked = rest.join(counts, "pair").join(of_b, F.shiftright("pair", ID_BITS) == F.col("b"))
    looked = looked.select("row", F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    both = some.select("row", "n_best", "count_sum").unionByName(looked).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("pairs", "times").join(both, "row")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
