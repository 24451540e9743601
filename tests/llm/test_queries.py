"""The registered queries on the small tables, against DuckDB where SQL can express them, and the pipeline."""

import pytest

from pinweave.llm import registry

from test_jaccard import brute


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_same_rows(name, spark, sf_dir, matches):
    matches(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["op3_toxicity", "op7_wavelet_matrix", "op9_sentencepiece", "op10_simhash"])
def test_a_row_for_each_document(name, spark, sf_dir):
    n = registry.table(spark, sf_dir, "documents").count()
    rows = registry.QUERIES[name](spark, sf_dir).select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == list(range(n))


def test_pipeline_by_its_parts(spark, sf_dir):
    """Each stage against what its operator says of the stage's own input."""
    import corpus_pipeline as pipeline
    from pinweave.llm import decontamination, pii, toxicity
    from pinweave.llm.shared import stored

    docs = registry.table(spark, sf_dir, "documents")
    columns = docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    def first_of_groups(d):
        return {i for i, n, least in brute([(r.doc_id, r.text) for r in d.collect()], 5, 80) if n and i == least}

    kept = {
        "toxicity": lambda d: ids(toxicity.toxicity(d, registry.table(spark, sf_dir, "labels")).where("predicted = 0")),
        "simhash_near_dedup": first_of_groups,
        "benchmark_decontamination": lambda d: ids(decontamination.contamination(d, registry.table(spark, sf_dir, "benchmark")).where("not contaminated")),
        "pii": ids,
        "sentencepiece": ids,
    }
    assert [name for name, _ in pipeline.STAGES] == list(kept)
    for name, stage in pipeline.STAGES:
        expected = kept[name](docs)
        after = stored(stage(spark, docs, sf_dir))
        assert ids(after) == expected and after.count() == len(expected)
        if name != "sentencepiece":
            assert after.columns == columns
        if name == "pii":
            assert pii.pii(after).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
            assert after.where("n_chars <> length(text)").count() == 0
        docs = after
    assert docs.where("not round_trip").count() == 0
    assert ids(pipeline.run(spark, sf_dir)) == ids(docs)
