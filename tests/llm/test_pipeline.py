import __spark_entry__ as entry
import corpus_pipeline
from motifspark.llm import token_store
from motifspark.llm.common import table
from motifspark.llm.queries import toxic_model
from motifspark.llm import decontaminate, mixing, simhash_dedup, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5
    docs = table(spark, DATA, "documents")
    kept = toxicity.filtered(docs, toxic_model(spark, docs, DATA)).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    one = simhash_dedup.deduplicated(kept).cache()
    assert one.count() == simhash_dedup.near_duplicates(kept).select("component_id").distinct().count()
    clean = decontaminate.clean(one, table(spark, DATA, "benchmark")).cache()
    bad = decontaminate.overlaps(one, table(spark, DATA, "benchmark")).select("doc_id").distinct().count()
    assert clean.count() == one.count() - bad
    mixed = mixing.mixed(clean)
    assert mixed.columns == docs.columns
    assert corpus_pipeline.run(spark, DATA).count() == mixed.count() == token_store.tokenised(mixed).count()
