"""Columns whose names clash with helpers, other id types, fitted lines, several index blocks, shared stores."""

import pyarrow.fs as pafs
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shelflight.llm import decontam, quality_rules, simhash, spm, token_frames, zstd_quality
from shelflight.llm.queries import QUERIES

ITEM = "Which river runs through the old city of the seven gates and what is the name of its longest bridge today"


def test_leaks_with_int_ids(spark):
    docs = spark.createDataFrame([(1, f"Intro words. {ITEM}. End."), (2, "Nothing here"), (None, ITEM)], "doc_id int, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id int, text string")
    found = decontam.find_leaks(docs, items)
    assert dict(found.dtypes)["doc_id"] == dict(found.dtypes)["item_id"] == "int"
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 7), (None, 7)}


def test_leaks_over_several_blocks(spark):
    texts = [f"{ITEM} number {w} of the whole list" for w in ("alpha", "beta", "gamma", "delta", "omega", "sigma")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    one, many = decontam.Limits(), decontam.Limits(block_bytes=200)
    want = sorted(map(tuple, decontam.find_leaks(docs, items, one).select("doc_id", "item_id").collect()))
    assert sorted(map(tuple, decontam.find_leaks(docs, items, many).select("doc_id", "item_id").collect())) == want and len(want) >= 6
    assert [r.doc_id for r in decontam.without_leaks(docs, items, many).collect()] == [99]


def test_keep_first_among_names_of_its_own(spark):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long, 5, "a"), (2, long, 6, "b"), (3, "other words of another text entirely", 7, "c"), (3, "other words of another text entirely", 7, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id int, text_hash string")
    kept = simhash.keep_first(df)
    assert kept.schema.names == df.schema.names
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_helper_names(spark):
    df = spark.createDataFrame([("x", 1, "hello world", "y")], "__text string, c0 int, text string, __source string")
    prints = simhash.fingerprints(df)
    assert prints.schema.names == ["__text", "c0", "__source", "fingerprint"] and prints.first()["__text"] == "x"
    scored = zstd_quality.score(df, zstd_quality.Model(b"", b"", zstd_quality.SAMPLE))
    assert scored.schema.names == [*df.schema.names, "score"] and scored.first()["c0"] == 1
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = spm.encode(df, model, decoded="back")
    row = coded.first()
    assert row["back"] == "hello world" and (row["__text"], row["c0"], row["__source"]) == ("x", 1, "y")
    assert spm.decode(coded.select("ids", "__source"), model).first().decoded == "hello world"


def test_fitted_recurring_lines(spark):
    """With lines fitted once, a document loses the same words whatever else is cleaned with it."""
    notice = "Share this page with all of your friends today."
    prose = "The {} of the day was {} and the {} went on for a long while after it had begun."
    reference = [f"{prose.format(i, i, i)}\n{notice}\n{prose.format(i + 1000, i, i)}" for i in range(30)]
    fitted = quality_rules.recurring_lines(spark.createDataFrame([(t,) for t in reference], "text string"))
    own = spark.createDataFrame([(1, f"{prose.format('a', 'b', 'c')}\n{notice}"), (2, prose.format("d", "e", "f"))], "doc_id long, text string")
    others = spark.createDataFrame([(100 + i, t) for i, t in enumerate(reference)], "doc_id long, text string")
    lost = lambda df: {r.doc_id: r.removed_words for r in quality_rules.clean_lines(df, recurring=fitted).where("doc_id < 100").collect()}
    assert lost(own) == lost(own.unionByName(others)) == {1: 9, 2: 0}
    joined = quality_rules.clean_lines(own, recurring=fitted, rules=quality_rules.LineRules(broadcast_lines=0))
    assert {r.doc_id: r.removed_words for r in joined.collect()} == {1: 9, 2: 0}


def test_quality_on_held_out_rows(spark):
    """Balanced accuracy and area under the curve, which a constant answer does not reach."""
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    scored = QUERIES["op6_zstd_quality"](spark, sf_dir).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    assert len(bad) >= 5
    right = [sum(r.predicted == q for r in scored if r.quality == q) / len(own) for q, own in ((1, good), (0, bad))]
    assert sum(right) / 2 > 0.9
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad) > 0.95


@pytest.mark.parametrize(
    ("settings", "options"),
    [
        ({}, {"scheme": "https"}),
        ({"fs.s3a.access.key": "k", "fs.s3a.secret.key": "s", "fs.s3a.endpoint": "http://store:9000", "fs.s3a.path.style.access": "true"},
         {"access_key": "k", "secret_key": "s", "endpoint_override": "store:9000", "force_virtual_addressing": False, "scheme": "http"}),
        ({"fs.s3a.endpoint": "store.example", "fs.s3a.endpoint.region": "r", "fs.s3a.connection.ssl.enabled": "false"},
         {"endpoint_override": "store.example", "region": "r", "force_virtual_addressing": True, "scheme": "http"}),
    ],
)
def test_settings_of_stores(settings, options):
    assert token_frames.s3_options(settings) == options


def test_stores_by_scheme(tmp_path):
    keys = {"fs.s3a.access.key": "k", "fs.s3a.secret.key": "s", "fs.s3a.endpoint": "http://localhost:1", "fs.s3a.endpoint.region": "r"}
    for scheme in ("s3", "s3a", "s3n"):
        store, at = token_frames.filesystem(f"{scheme}://bucket/some/path", keys)
        assert isinstance(store, pafs.S3FileSystem) and at == "bucket/some/path"
    store, at = token_frames.filesystem(f"file:{tmp_path}")
    assert isinstance(store, pafs.LocalFileSystem) and at == str(tmp_path)


def test_settings_from_the_session(spark):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.s3a.endpoint", "store.example")
    try:
        assert token_frames.store_settings(spark)["fs.s3a.endpoint"] == "store.example"
    finally:
        conf.unset("fs.s3a.endpoint")
