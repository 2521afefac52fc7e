"""The pipeline against its stages in plain Python and SQL."""

import corpus_pipeline
import pytest

from opinara.llm import toxicity
from opinara.llm.oracle import quality_sql
from tests.check_oracle import connect
from tests.llm.test_operators import FOLDER, brute_components, brute_fingerprint, brute_groups, check_packing, pairs


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_pipeline(spark, documents):
    columns, docs = documents.columns, documents
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, FOLDER)
        assert out.columns == columns
        rows = pairs(out)
        if name == "quality_rules":
            good = connect(FOLDER).execute(quality_sql("doc_id, kept")).fetchall()
            assert {d for d, _ in rows} == {d for d, k in good if k}
        elif name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            assert {d for d, _ in rows} == {d for d, t in pairs(docs) if model.score_text(t) < corpus_pipeline.TOXIC}
        elif name == "exact_dedup":
            assert {d for d, _ in rows} == {keep for _, keep, _ in brute_groups(pairs(docs))}
        else:
            nodes = sorted((d, brute_fingerprint(t)) for d, t in pairs(docs))
            assert {d for d, _ in rows} == set(brute_components(nodes, 2))
        kept[name] = rows
        docs = spark.createDataFrame(out.collect(), documents.schema)
    check_packing(kept["simhash_near_dedup"], stages["best_fit_packing"](spark, docs, FOLDER).collect(), 2048)
    assert corpus_pipeline.run(spark, FOLDER).count() >= len(kept["simhash_near_dedup"])
