import corpus_pipeline
from tests_llm_common import prose

import __spark_entry__ as entry


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_after_the_filter(spark, docs, tmp_path):
    """Planted copies go, clean documents stay, and every document that stays is packed whole."""
    texts = [prose(i, 120) for i in range(30)]
    rows = list(enumerate(texts)) + [(100, texts[3].replace(" ", "  ")), (101, texts[4] + " tail"), (102, texts[5])]
    out = corpus_pipeline.dissimilar(spark, corpus_pipeline.distinct(spark, docs(rows), str(tmp_path)), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == list(range(30)) and out.columns == docs([]).columns
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    mixed = corpus_pipeline.balanced(spark, out, str(tmp_path))
    assert {r.doc_id for r in mixed.collect()} == set(range(30)) and mixed.columns == out.columns
    pieces = corpus_pipeline.packed(spark, mixed, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(range(30))
    filled = {}
    for r in pieces:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= corpus_pipeline.SEQUENCE


def test_whole_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(got.columns)
