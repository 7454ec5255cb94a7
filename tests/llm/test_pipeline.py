"""Each stage of the corpus pipeline against a plain version of what it decides."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

import corpus_pipeline  # noqa: E402
from lodestone.llm import quality_rules, toxicity  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = toxicity.training_labels(spark.read.parquet(f"{sf}/labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}

    model = toxicity.fit(docs, labels)
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, t in text.items() if model.score(t)[0] < toxicity.REJECT_FROM}

    good = stages["quality_rules"](spark, clean, sf)
    kept = {r["doc_id"] for r in quality_rules.judge(clean).filter("kept").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == kept

    one = stages["near_duplicates"](spark, good, sf)
    want = {c for _, c in H.jaccard_components([(d, text[d]) for d in sorted(kept)], 5, 80).values()}
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == want

    masked = {r["doc_id"]: r["text"] for r in stages["secrets"](spark, one, sf).collect()}
    assert masked.keys() == want
    for d, t in masked.items():
        spans = H.secret_spans(text[d])
        assert not H.secret_spans(t) and (t == text[d] or "[secret]" in t or not spans)


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    assert got and {"doc_id", "piece", "sequence_id", "offset"} <= set(got[0].asDict())
