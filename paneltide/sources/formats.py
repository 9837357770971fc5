"""Two formats of the Python data source API: bars in folders by symbol and year, and rows that a stream commits by batch.

`quotes` lists only the folders of the symbols that are asked for, where Spark's own file sources first list all of them: with many
symbols a query of a few reads a few folders. `committed` is a sink and a source. What a batch wrote counts from the
moment its list of files is there, so a batch that is tried again, or fails half-way, adds nothing twice. Paths are those
that PyArrow opens (local files, HDFS, object stores).
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.parquet
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .panels import BARS

#: A task of a scan reads about so many bytes of files.
TASK_BYTES = 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def packed(files: Iterable[tuple[str, int]]) -> list[list[str]]:
    """Files (path, bytes) in groups of about TASK_BYTES."""
    groups, size = [[]], 0
    for path, n in files:
        if groups[-1] and size + n > TASK_BYTES:
            groups.append([])
            size = 0
        groups[-1].append(path)
        size += n
    return groups


@dataclass
class Files(InputPartition):
    paths: list[str]


class QuoteReader(DataSourceReader):
    """Bars of some symbols (None: all) from one date to another, both included."""

    def __init__(self, path: str, symbols: list[str] | None = None, first: dt.date = dt.date.min, last: dt.date = dt.date.max):
        self.path, self.symbols, self.first, self.last = path, symbols, first, last

    def files(self) -> Iterator[tuple[str, int]]:
        """Files of the symbols and years that are asked for; a symbol without data has none."""
        store, root = opened(self.path)
        if self.symbols is None:
            folders = [i.path for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.Directory and "symbol=" in i.base_name]
        else:
            folders = [f"{root}/symbol={escaped(s)}" for s in sorted(set(self.symbols))]
        for folder in folders:
            for year in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if year.base_name.startswith("year=") and self.first.year <= int(year.base_name[5:]) <= self.last.year:
                    for i in store.get_file_info(fs.FileSelector(year.path)):
                        if i.is_file and i.base_name.endswith(".csv"):
                            yield i.path, i.size

    def partitions(self) -> list[Files]:
        return [Files(paths) for paths in packed(self.files())]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        store = opened(self.path)[0]
        want = to_arrow_schema(BARS)
        kinds = pyarrow.csv.ConvertOptions(column_types={"name": pa.string()} | dict(zip(want.names[1:], want.types[1:])), include_columns=["name", *want.names[1:]])
        for path in part.paths:
            with store.open_input_stream(path) as f:
                for batch in pyarrow.csv.open_csv(f, parse_options=pyarrow.csv.ParseOptions(newlines_in_values=True), convert_options=kinds):
                    ts = batch.column("ts")
                    batch = pa.RecordBatch.from_arrays(batch.columns, schema=want)
                    yield batch.filter(pc.and_(pc.greater_equal(ts, pa.scalar(self.first)), pc.less_equal(ts, pa.scalar(self.last))))


def escaped(symbol: str) -> str:
    """A symbol as part of a folder's name: a sign that is not a letter, figure or one of -_. as ~ and its UTF-8 bytes in hex."""
    return quote(symbol, safe="").replace("~", "%7E").replace("%", "~") or "~"


class Quotes(DataSource):
    """Bars as CSV files with a header: <path>/symbol=<symbol>/year=<year>/*.csv, the symbol also as column `name`.

    Options: path, symbols (a JSON list), first, last (dates). What is asked for is an option of one load and not a filter
    that Spark pushes down: in this release a Python source keeps the filters of an earlier scan, so that a frame that was
    counted with a filter and then without it gave 30 of 210 rows.
    """

    @classmethod
    def name(cls) -> str:
        return "quotes"

    def schema(self) -> StructType:
        return BARS

    def reader(self, schema: StructType) -> QuoteReader:
        symbols = self.options.get("symbols")
        first, last = self.options.get("first"), self.options.get("last")
        days = dt.date.fromisoformat(first) if first else dt.date.min, dt.date.fromisoformat(last) if last else dt.date.max
        return QuoteReader(self.options["path"].rstrip("/"), json.loads(symbols) if symbols else None, *days)


def write_quotes(df: DataFrame, path: str) -> None:
    """Bars as files of the format `quotes`, one for each symbol and year; rows without a symbol or date are left out."""
    rows = df.select(*BARS.names).where("symbol IS NOT NULL AND ts IS NOT NULL")
    # as escaped() does; Spark would escape only some of these signs
    name = F.replace(F.replace(F.url_encode("symbol"), F.lit("+"), F.lit("%20")), F.lit("%"), F.lit("~"))
    name = F.replace(name, F.lit("*"), F.lit("~2A"))
    name = F.when(F.col("symbol") == "", "~").otherwise(name)
    rows = rows.withColumns({"__symbol": name, "year": F.year("ts")}).repartition("__symbol", "year").sortWithinPartitions("__symbol", "year", "ts")
    rows.withColumnRenamed("symbol", "name").withColumnRenamed("__symbol", "symbol").write.partitionBy("symbol", "year").csv(path, header=True, escape='"')


def read_quotes(spark: SparkSession, path: str, symbols: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Bars of the format `quotes`, of some symbols and dates; other files are neither listed nor opened. A symbol without data has no rows."""
    spark.dataSource.register(Quotes)
    asked = {"symbols": None if symbols is None else json.dumps(symbols), "first": first, "last": last}
    return spark.read.format("quotes").options(**{k: v for k, v in asked.items() if v is not None}).load(path)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class CommittedReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.kinds = path, schema

    def partitions(self) -> list[Files]:
        store, root = opened(self.path)
        files = []
        for i in sorted(store.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True)), key=lambda i: i.path):
            if i.base_name.endswith(".json"):
                with store.open_input_stream(i.path) as f:
                    files += [(p, n) for p, n in json.loads(f.read())]
        return [Files([f"{root}/{p}" for p in paths]) for paths in packed(files)]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        store = opened(self.path)[0]
        for path in part.paths:
            with store.open_input_file(path) as f:
                for batch in pyarrow.parquet.ParquetFile(f).iter_batches(columns=self.kinds.names):
                    yield batch.cast(to_arrow_schema(self.kinds))


class CommittedWriter(DataSourceStreamArrowWriter):
    """Each task writes a file of its own; a batch's list of files, put in place by one move, makes them count."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.kinds = path, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        path, out = f"{uuid.uuid4().hex}.parquet", None
        kinds = to_arrow_schema(self.kinds)
        for batch in iterator:
            if out is None:
                store.create_dir(root)
                out = pyarrow.parquet.ParquetWriter(f"{root}/{path}", kinds, filesystem=store)
            out.write_batch(batch.cast(kinds))
        if out is None:
            return Written(None)
        out.close()
        return Written(path)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        store, root = opened(self.path)
        paths = [m.path for m in messages if m is not None and m.path is not None]
        target = f"{root}/_commits/{batchId:012d}.json"
        if store.get_file_info(target).type != fs.FileType.NotFound:  # an earlier try of this batch counts
            self.abort(messages, batchId)
            return
        store.create_dir(f"{root}/_commits")
        sizes = [(p, store.get_file_info(f"{root}/{p}").size) for p in paths]
        draft = f"{target}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps(sizes).encode())
        store.move(draft, target)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m is not None and m.path is not None:
                store.delete_file(f"{root}/{m.path}")


class Committed(DataSource):
    """Rows of a stream, written once for each batch; options: path. The reader needs a schema."""

    @classmethod
    def name(cls) -> str:
        return "committed"

    def reader(self, schema: StructType) -> CommittedReader:
        return CommittedReader(self.options["path"].rstrip("/"), schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options["path"].rstrip("/"), schema)


def read_committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of the batches that were committed."""
    spark.dataSource.register(Committed)
    return spark.read.format("committed").schema(schema).load(path)


def write_committed(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream until its source has no more; a batch that is tried again adds nothing."""
    stream.sparkSession.dataSource.register(Committed)
    stream.writeStream.format("committed").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
