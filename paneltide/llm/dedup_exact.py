"""Exact deduplication as a streaming job with disk-backed keyed state.

The stream keeps, for each digest ever seen and without expiry, the best row's order key, stable identifier and content
locator and the number of rows; the state lives in RocksDB and in its checkpoint. Rows whose digest is shared are hits:
their whole normalised texts are compared with the content found by the locator. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_path, save

#: Bytes that do not count when texts are compared.
IGNORED = r"[\x20\x09-\x0D]"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a large group of copies that are compared with one replica of the content.
ROWS_PER_REPLICA = 2000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), IGNORED, "")


def keyed(docs: DataFrame, digest_bits: int = 256) -> DataFrame:
    """doc_id, text, digest of the normalised text and the order in which equal rows are preferred."""
    ntext = normalised(F.col("text"))
    digest = F.sha2(ntext.cast("binary"), 256)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), ntext.alias("ntext"), digest.alias("text_sha256"), F.substring(digest, 1, digest_bits // 4).alias("digest"),
        # the largest wins: more code points, then the smaller id; a null id comes last
        F.struct(F.char_length(F.coalesce("text", F.lit(""))).alias("points"), (-F.col("doc_id").cast("long")).alias("minus_id")).alias("rank"), F.col("locator"),
    )


def located(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("locator"))


def run_stream(source: DataFrame, checkpoint: str, digest_bits: int = 256) -> None:
    """Take what the source has not shown yet into the state under `checkpoint`; calling it again goes on from there."""
    spark = source.sparkSession
    # each store is closed once its part is committed: an executor does not hold the local files of all partitions at once
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        state = keyed(source, digest_bits).groupBy("digest").agg(F.max(F.struct("rank", "doc_id", "locator")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """digest, keep_id, locator, group_size of every digest seen so far."""
    value = spark.read.format("statestore").load(checkpoint)
    best, size = (F.col("value")[f.name] for f in value.schema["value"].dataType.fields)
    return value.select(F.col("key.digest").alias("digest"), best["doc_id"].alias("keep_id"), best["locator"].alias("locator"), size.alias("group_size"))


def exact_dedup(docs: DataFrame, state: DataFrame, digest_bits: int = 256) -> DataFrame:
    """One row per document of `docs` (doc_id, text, locator), given the stream's state over them.

    keep_id is the id of the row that stays among equal texts: most code points, then smallest id. Null text counts as
    empty, all empty texts are one group; a null id loses against any other; rows repeated with the same id are both
    counted and both kept if the id is. Different texts with one digest are told apart by their bytes; it is an error if a
    locator of the state leads to no row. Other columns are left out, an empty table gives no rows.
    """
    rows = keyed(docs, digest_bits)
    shared = state.where("group_size > 1").select("digest", F.col("locator").alias("at"), "group_size")
    hits = save(rows.join(shared, "digest").select("digest", "doc_id", "ntext", "rank", F.col("locator").eqNullSafe(F.col("at")).alias("is_content"), F.ceil(F.col("group_size") / ROWS_PER_REPLICA).cast("int").alias("replicas")), "hits")
    missing = shared.count() - hits.where("is_content").count()
    if missing:  # or copies would pass without a look at their bytes
        raise ValueError(f"{missing} digests have no row at the locator that the state has")
    # the content at the locator, as often as its group needs it
    content = hits.where("is_content").select("digest", F.col("ntext").alias("content"), F.explode(F.sequence(F.lit(0), F.col("replicas") - 1)).alias("replica"))
    pairs = hits.withColumn("replica", F.pmod(F.xxhash64("doc_id", "rank"), F.col("replicas")).cast("int")).join(content, ["digest", "replica"])
    clashes = save(pairs.where("ntext <> content").select("digest").distinct(), "clashes")
    out = rows.select("doc_id", "digest", "text_sha256", "rank").join(state.select("digest", "keep_id", "group_size"), "digest")
    if not clashes.isEmpty():
        # digests under which the bytes differ: group by the bytes themselves
        true = hits.join(clashes, "digest", "left_semi").groupBy("digest", F.sha2(F.col("ntext").cast("binary"), 512).alias("full"), "ntext").agg(F.max(F.struct("rank", "doc_id")).alias("best"), F.count(F.lit(1)).alias("n"))
        mine = rows.join(clashes, "digest", "left_semi").join(true, ["digest", "ntext"]).select("doc_id", "digest", "text_sha256", "rank", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"))
        out = out.join(clashes, "digest", "left_anti").unionByName(mine)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    checkpoint = new_path(spark, "exact-dedup")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    # as a pattern, since the table may be one file or a folder of them
    run_stream(located(spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")), checkpoint)
    return exact_dedup(located(spark.read.schema(schema).parquet(path)), save(read_state(spark, checkpoint), "state"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
"""
