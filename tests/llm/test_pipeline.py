"""Each stage of the pipeline on its own input, on awkward input, and the whole."""

import pytest

import corpus_pipeline as P
from paneltide.llm.shared import new_path

from .helpers import awkward, corpus

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark):
    """A folder with labels and a benchmark beside which the awkward documents could stand."""
    path = new_path(spark, "tables")
    spark.createDataFrame([(i, i % 5 != 0, 0) for i in range(100)] + [(None, True, 0)], "doc_id long, quality boolean, toxic int").selectExpr("doc_id", "CAST(quality AS INT) AS quality", "toxic").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, corpus()[3][1]), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_and_empty_input(spark, sf_dir, stage):
    name, f = P.STAGES[stage]
    out = f(spark, awkward(spark), sf_dir)
    assert out.count() <= awkward(spark).count()
    if stage < 4:
        assert out.columns == list(P.COLUMNS)
    assert f(spark, awkward(spark, []), sf_dir).count() == 0


def test_stages_have_effect(spark, sf_dir):
    rows = awkward(spark).select(*P.COLUMNS)
    left = P.one_of_each(spark, rows, sf_dir)
    ids = sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None)
    assert 1006 in ids and 1007 not in ids and len(ids) < rows.count() - 20
    clean = P.uncontaminated(spark, rows, sf_dir)
    assert clean.where(clean.text == corpus()[3][1]).count() == 0 and clean.count() > 20


def test_run(spark):
    out = P.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert 0.5 * n < out.count() < n
