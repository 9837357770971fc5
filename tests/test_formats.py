"""The formats of the Python data source API: what filters leave unread, and batches that count once."""

import datetime as dt
import json
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from paneltide.sources import formats, panels

NAMES = ["A", "B#1", "c d", "~%/", "é*", "", 'q"\n,']


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(s, dt.date(2019, 1, 1) + dt.timedelta(days=40 * i), 1.5 * i, 2.0 * i, None, 3.0 + k, 10.0) for k, s in enumerate(NAMES) for i in range(30)]
    rows += [(None, dt.date(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0), ("A", None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, panels.BARS)


@pytest.fixture(scope="module")
def quotes(bars, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("quotes"))
    formats.write_quotes(bars, f"{path}/in")
    return f"{path}/in"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quotes_round_trip(spark, bars, quotes):
    assert rows(formats.read_quotes(spark, quotes)) == rows(bars.where("symbol IS NOT NULL AND ts IS NOT NULL"))


@pytest.mark.parametrize("name", [*NAMES, "absent"])
def test_quotes_of_one_symbol(spark, bars, quotes, name):
    asked = F.col("symbol") == name
    assert rows(formats.read_quotes(spark, quotes, [name])) == rows(bars.where(asked & F.col("ts").isNotNull()))


def test_what_is_not_asked_for_is_not_listed(quotes):
    reader = formats.QuoteReader(quotes, ["A", "c d", "absent", "A"], dt.date(2020, 1, 1), dt.date(2021, 6, 1))
    found = [p for part in reader.partitions() for p in part.paths]
    assert {tuple(Path(p).parts[-3:-1]) for p in found} == {(f"symbol={s}", f"year={y}") for s in ("A", "c~20d") for y in (2020, 2021)}
    assert len(found) == len(set(found)) < sum(len(p.paths) for p in formats.QuoteReader(quotes).partitions())
    assert not sum(len(p.paths) for p in formats.QuoteReader(quotes, []).partitions())


def test_a_frame_of_quotes_with_and_without_a_filter(spark, bars, quotes):
    df, whole = formats.read_quotes(spark, quotes), rows(bars.where("symbol IS NOT NULL AND ts IS NOT NULL"))
    a, b = F.col("symbol") == "A", F.col("symbol") == "c d"
    assert rows(df.where(a).union(df.where(b))) == rows(bars.where((a | b) & F.col("ts").isNotNull()))
    assert rows(df) == whole


def test_a_broken_file_hurts_only_who_reads_it(spark, bars, tmp_path):
    path = f"{tmp_path}/in"
    formats.write_quotes(bars, path)
    next(Path(path, "symbol=B~231", "year=2020").glob("*.csv")).write_text("no,bars\n1,2\n")
    days = F.col("ts").between("2020-01-01", "2021-02-20")
    assert rows(formats.read_quotes(spark, path, ["A", "c d"], "2020-01-01", "2021-02-20")) == rows(bars.where(F.col("symbol").isin("A", "c d") & days))
    early = (F.col("symbol") == "B#1") & (F.col("ts") < F.lit("2020-01-01").cast("date"))
    assert rows(formats.read_quotes(spark, path, ["B#1"], last="2019-12-31")) == rows(bars.where(early))
    with pytest.raises(Exception, match="name"):
        formats.read_quotes(spark, path).collect()


def test_small_files_share_a_task(monkeypatch):
    files = [("a", 10), ("b", 100), ("c", 5), ("d", 5)]
    monkeypatch.setattr(formats, "TASK_BYTES", 20)
    assert formats.packed(files) == [["a"], ["b"], ["c", "d"]]
    assert formats.packed([]) == [[]]


IDS = StructType([StructField("id", LongType()), StructField("name", StringType())])


def batch(*ids):
    return iter([pa.RecordBatch.from_pydict({"id": list(ids), "name": [None if i % 3 else str(i) for i in ids]})])


def test_a_batch_counts_once(spark, tmp_path):
    sink = formats.CommittedWriter(str(tmp_path / "out"), IDS)
    sink.commit([sink.write(batch(1, 2)), sink.write(iter([])), None], 0)
    sink.commit([sink.write(batch(1, 2))], 0)  # tried again
    lost = sink.write(batch(7, 8))  # a task of a batch that fails
    sink.abort([lost, None], 1)
    sink.write(batch(9))  # a task whose message never came
    sink.commit([sink.write(batch(3))], 1)
    assert rows(formats.read_committed(spark, str(tmp_path / "out"), IDS)) == [(1, None), (2, None), (3, "3")]
    assert rows(formats.read_committed(spark, str(tmp_path / "none"), IDS)) == []


def test_a_stream_that_repeats_its_last_batch(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).select("id", F.col("id").cast("string").alias("name")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(IDS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    formats.write_committed(stream, out, state)
    lists = sorted(Path(out, "_commits").glob("*.json"))
    before = [json.loads(p.read_text()) for p in lists]
    assert len(lists) == 3
    last = max((p for p in Path(state, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()  # as if the driver had died between the sink's commit and its own
    for crc in Path(state, "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    formats.write_committed(stream, out, state)
    assert [json.loads(p.read_text()) for p in sorted(Path(out, "_commits").glob("*.json"))] == before
    assert rows(formats.read_committed(spark, out, IDS).select("id")) == sorted(((i,) for i in range(30)), key=repr)
    assert len(list(Path(out).glob("*.parquet"))) == sum(map(len, before))
