"""The pipeline's stages on the smallest tables: each keeps what it should and its decisions take effect."""

import corpus_pipeline
import sentencepiece
from shelflight.llm import decontam, pii, simhash, zstd_quality
from shelflight.llm.queries import QUERIES


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        docs = spark.read.parquet(path)
        kept.append((name, before, docs))
        if name != "sentencepiece":
            assert docs.columns == columns
    by = {name: (before, after) for name, before, after in kept}
    before, after = by["quality_classifier"]
    model = zstd_quality.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r.doc_id: r.score for r in zstd_quality.score(before, model).collect()}
    assert {r.doc_id for r in after.collect()} == {d for d, s in scores.items() if s >= 0.7}
    before, after = by["simhash_near_dedup"]
    groups = simhash.simhash_groups(before).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted({r.component_id for r in groups})
    before, after = by["benchmark_decontamination"]
    leaked = {r.doc_id for r in decontam.find_leaks(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - leaked
    before, after = by["pii_surrogates"]
    new = {r.doc_id: r for r in after.collect()}
    assert after.count() == before.count()
    with_entities = before.where(pii.F.size(pii.entities(pii.F.col("text"))) > 0)
    changed = {r.doc_id for r in with_entities.collect()}
    for r in before.collect():
        assert (new[r.doc_id].text != r.text) == (r.doc_id in changed) and new[r.doc_id].n_chars == len(new[r.doc_id].text)
    before, after = by["sentencepiece"]
    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.ids == sp.encode(texts[r.doc_id]) and r.decoded == sp.decode(r.ids) and r.n_tokens == len(r.ids)


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
