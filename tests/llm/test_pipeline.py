"""The pipeline, stage by stage and whole, and the registry of this subpackage."""

import __spark_entry__ as registry
import corpus_pipeline
import pytest
from compare import compare, connect

from kategora.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_edge_rows(spark, edges, docs_of):
    """Every stage takes NULLs, ties, repeated rows, no rows and odd columns; all but the last keep the columns."""
    for start in (edges, docs_of()):
        docs = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, FOLDER)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            out.count()
            docs = start


def test_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    ids = {r["doc_id"] for r in rows}
    assert 0 < len(ids) < docs.count() and ids <= {r["doc_id"] for r in docs.collect()}
    sizes = {}
    for r in rows:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert max(sizes.values()) <= 2048
    # Clean documents of the labelled sample that are no copies stay.
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1")
    clean = {r["doc_id"] for r in labels.collect()}
    assert len(clean & ids) >= 0.8 * len(clean)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    assert {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in queries.registered()}
    assert "pipeline" in registry.queries() and set(queries.sql()) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.registered()))
def test_query(spark, name):
    problem, rows, _, _ = compare(spark, queries.registered()[name], queries.sql().get(name), FOLDER, connect(FOLDER))
    assert problem is None and rows > 0
