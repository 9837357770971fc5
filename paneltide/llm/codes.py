"""Vector code compression: product quantisation of integer vectors by per-dimension value dictionaries.

Vectors are cut into PARTS equal parts, each of which is replaced by the index of the nearest of ENTRIES codebook entries of its position.
Vectors are kept as blocks: of each dimension a block has its different integers (a dictionary) and each row's code into
them. The squared differences of every different integer to all entries are tabulated once for a block and round; the distances of the
rows' parts are then gathered from these tables by the codes and added up.

Rounds of assignment and averaging are Spark jobs over the blocks. A task adds up the parts of each entry; what it sends does not depend
on the number of its rows. All numbers are integers, so that no order of summation shows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget, save, ship

#: Parts of a vector, entries of a codebook, rounds of assignment and averaging, integer steps of one unit.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Numbers of a block at most (at least one row), and rows: distances to all entries are held for a block's rows.
BLOCK, BLOCK_ROWS = 1 << 18, 4096


def bounds(size: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin, and its size: equal parts, or as equal as whole numbers can be."""
    return [size * i // parts for i in range(parts + 1)]


def limit(size: int) -> int:
    """The largest component that counts as it is; squared distances of whole vectors, summed over a vector, then fit 64 bits."""
    return 1 << (60 - max(1, size).bit_length()) // 2


def integers(values: np.ndarray, size: int) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -limit(size), limit(size)).astype(np.int64)


def kept(rows: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of rows whose vector is neither null nor holds a null or a number that is not finite."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & good)


def coded(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of kept() rows: ids, labels, and by dimension the different integers and each row's code.

    Rows of another length than `size` are blocks of their own without dictionaries.
    """

    def block(ids: pa.Array, labels: pa.Array, x: np.ndarray | None) -> pa.RecordBatch:
        values, ends, codes = [], [0], []
        for column in x.T if x is not None else ():
            v, c = np.unique(column, return_inverse=True)
            values.append(v)
            ends.append(ends[-1] + len(v))
            codes.append(c.astype(np.uint16))
        packed = [np.concatenate(values).tobytes(), np.array(ends, np.int64).tobytes(), np.concatenate(codes).tobytes()] if values else [b"", None if x is None else np.zeros(1, np.int64).tobytes(), b""]
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([one(ids), one(labels), *(pa.array([p], pa.binary()) for p in packed)], ["ids", "labels", "values", "ends", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(BLOCK_ROWS, BLOCK // max(1, size)))
        for batch in batches:
            ids, labels, vectors = (batch.column(c) for c in ("vec_id", "label", "embedding"))
            lengths = np.diff(vectors.offsets.to_numpy())
            for fits in (True, False):
                rows = np.flatnonzero((lengths == size) == fits)
                for at in range(0, len(rows), step):
                    pick = pa.array(rows[at : at + step])
                    x = integers(vectors.take(pick).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(pick), size), size) if fits else None
                    yield block(ids.take(pick), labels.take(pick), x)

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "embedding").mapInArrow(run, f"ids array<bigint>, labels array<{kind}>, values binary, ends binary, codes binary")


def distances(values: np.ndarray, ends: np.ndarray, codes: np.ndarray, books: list[np.ndarray], edges: list[int]) -> Iterator[np.ndarray]:
    """For each part rows x entries of squared distances: a gather from each dimension's table, added up."""
    for part, book in enumerate(books):
        out = np.zeros((codes.shape[1], len(book)), np.int64)
        for k, d in enumerate(range(edges[part], edges[part + 1])):
            table = np.square(values[ends[d] : ends[d + 1], None] - book[None, :, k])
            out += table[codes[d]]
        yield out


def nearest(row: dict, books: list[np.ndarray], edges: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes (rows x parts) of the nearest entries, the lower one of ties, squared distances summed over the parts, and integers by dimension."""
    values, ends = np.frombuffer(row["values"], np.int64), np.frombuffer(row["ends"], np.int64)
    n = len(row["ids"])
    codes = np.frombuffer(row["codes"], np.uint16).reshape(len(ends) - 1, n)
    index, error = np.zeros((n, len(books)), np.int64), np.zeros(n, np.int64)
    for part, far in enumerate(distances(values, ends, codes, books, edges)):
        index[:, part] = far.argmin(1)
        error += far[np.arange(n), index[:, part]]
    x = np.stack([values[a:z][c] for a, z, c in zip(ends, ends[1:], codes)]) if len(codes) else np.zeros((0, n), np.int64)
    return index, error, x


def averaged(blocks: DataFrame, books: list[np.ndarray], edges: list[int]) -> list[np.ndarray]:
    """Codebooks whose entries are the means (rounded down) of the parts nearest to them; an entry without parts stays."""
    given, width = blocks.sparkSession.sparkContext.broadcast(books), max(1, *(z - a for a, z in zip(edges, edges[1:])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(books), ENTRIES), np.int64)
        sums = np.zeros((len(books), ENTRIES, width), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                index, _, x = nearest(row, given.value, edges)
                for part in range(len(books)):
                    n[part] += np.bincount(index[:, part], minlength=ENTRIES)
                    order = np.argsort(index[:, part], kind="stable")
                    used, first = np.unique(index[order, part], return_index=True)
                    mine = x[edges[part] : edges[part + 1]][:, order]
                    if len(mine):
                        sums[part, used, : len(mine)] += np.add.reduceat(mine, first, axis=1).T
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    parts = blocks.where("ends IS NOT NULL").select("ids", "values", "ends", "codes").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    # a row for each entry comes to the driver
    rows = parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")).collect()
    out = [b.copy() for b in books]
    for r in rows:
        size = out[r["part"]].shape[1]
        out[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"][:size]]  # // goes down
    return out


def compress(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every kept row of (vec_id, label, embedding).

    A component x counts as floor(1024 * x); one beyond limit() (2**26 for 64 dimensions) counts as that. The codebooks start as the parts
    of the ENTRIES first vectors by vec_id (null ids last, of one id the smaller vector first). Vectors have the length of the first of these;
    rows of another length have null code and error. Parts of a length that four does not divide are as equal as can be. Rows with one id are
    rows like others, null labels are one label, an empty table gives none, other columns are left out. With fewer rows than ENTRIES the codebooks
    have as many entries. label_error is a sum over all rows of a label, null if none of them has an error.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = kept(rows)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()  # ENTRIES rows
    size = len(first[0]["embedding"]) if first else 0
    edges = bounds(size)
    same = [r["embedding"] for r in first if len(r["embedding"]) == size]
    x = integers(np.array(same, float).reshape(len(same), size), size)
    books = [x[:, a:z] for a, z in zip(edges, edges[1:])]
    blocks = save(coded(rows, size), "blocks")
    for _ in range(rounds if first else 0):
        books = averaged(blocks, books, edges)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    given, kind = spark.sparkContext.broadcast(books), rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ids, labels = one.column("ids").flatten(), one.column("labels").flatten()
                if one.column("ends").null_count:
                    codes, error = pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.int64())
                else:
                    index, error, _ = nearest(one.select(["ids", "values", "ends", "codes"]).to_pylist()[0], given.value, edges)
                    codes, error = pa.array([bytes(x).hex() for x in index.astype(np.uint8)], pa.string()), pa.array(error)
                yield pa.RecordBatch.from_arrays([ids, labels, codes, error], ["vec_id", "label", "code", "error"])

    out = save(blocks.mapInArrow(run, f"vec_id long, label {kind}, code string, error long"), "codes")
    forget(blocks)
    # one row for each label; the join can split the rows of a very common one
    of_label = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return out.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def _oracle() -> str:
    """Rounds as table expressions: integers by part and position, the nearest entry of each part, means rounded down."""
    cut = f"len(v) // {PARTS}"
    steps = [
        f"""good AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"parts AS MATERIALIZED (SELECT i, p, v[p * ({cut}) + 1 : (p + 1) * ({cut})] AS x FROM good, range({PARTS}) AS r(p))",
        "cells AS MATERIALIZED (SELECT i, p, generate_subscripts(x, 1) AS d, unnest(x) AS c FROM parts)",
        f"book0 AS MATERIALIZED (SELECT p, i - 1 AS e, x FROM parts WHERE i <= {ENTRIES})",
    ]
    near = lambda r: f"near{r} AS MATERIALIZED (SELECT i, p, min(struct_pack(far := list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(parts.x, book{r}.x)]), e := e)) AS n FROM parts JOIN book{r} USING (p) GROUP BY i, p)"
    for r in range(ROUNDS):
        steps += [near(r)]
        steps += [f"mean{r} AS (SELECT p, n.e AS e, d, CAST(floor(sum(c) / count(*)) AS BIGINT) AS c FROM near{r} JOIN cells USING (i, p) GROUP BY ALL)"]
        steps += [f"book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (SELECT p, e, list(c ORDER BY d) AS x FROM mean{r} GROUP BY p, e) m USING (p, e))"]
    steps += [near(ROUNDS)]
    steps += [f"coded AS (SELECT i, string_agg(printf('%02x', n.e), '' ORDER BY p) AS code, CAST(sum(n.far) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY i)"]
    steps += [f"digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS s FROM book{ROUNDS})"]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM good JOIN coded USING (i), digest"


ORACLE = _oracle()
