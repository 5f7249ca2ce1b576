"""Every registered corpus query and the pipeline, end to end: contract columns against brute force at the smallest scale."""

import collections
import hashlib
import re
import struct
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelflight.llm import decontam, quality_rules
from shelflight.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def _rows(spark, sf_dir, name):
    return {r.doc_id: r for r in QUERIES[name](spark, sf_dir).collect()}


def _jump(key, buckets):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_op1(spark, sf_dir, texts):
    rows = _rows(spark, sf_dir, "op1_jump_sharding")
    assert rows.keys() == texts.keys()
    slots = collections.defaultdict(set)
    for i, r in rows.items():
        content = texts[i].encode()
        assert (r.size, r.text_crc32, r.law) == (len(content) + 1, zlib.crc32(content), "key")
        assert (r.shard, r.grown_shard) == (_jump(i, 16), _jump(i, 17)) and r.grown_shard in (r.shard, 16)
        slots[r.shard].add(r.slot)
    assert all(s == set(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(rows)


def _base(text):
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def _brute_recurring(texts, rules=quality_rules.RULES):
    places = collections.defaultdict(set)
    for text in set(texts):
        lines = [None, *(x for x in (line.strip(" \t\r\v\f") for line in text.split("\n")) if x), None]
        for before, line, after in zip(lines, lines[1:], lines[2:]):
            places[line].add((text, before, after))
    found = set()
    for line, held in places.items():
        sides = [[p[k] for p in held if p[k] is not None] for k in (1, 2)]
        free = all(len(set(s)) >= rules.recurring_share * len(s) for s in sides)
        if free and max(len(set(s)) for s in sides) >= rules.recurring_contexts:
            found.add(line)
    return found


def test_op2(spark, sf_dir, texts):
    rows = _rows(spark, sf_dir, "op2_line_quality_rules")
    recurring = _brute_recurring(texts.values())
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        base = _base(texts[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        removed, seen = 0, set()
        for line in texts[i].split("\n"):
            words = WORD.findall(line)
            if words and (line in seen or quality_rules.line_fault(line, words) or line.strip(" \t\r\v\f") in recurring):
                removed += len(words)
            seen.add(line)
        assert (r.kept, r.removed_words) == (not base[-1] and removed <= 0.5 * base[0], removed)
    assert {r.kept for r in rows.values()} == {True, False}


def test_lines_that_recur_between_other_lines_are_boilerplate(spark):
    rng = np.random.default_rng(2)
    prose = lambda i, k: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(12)) + "."
    near = [prose(0, 0) for _ in range(8)]
    rows = [(i, f"{prose(i, 1)}\n {prose(i, 2)}\nShared by all who publish here.\t\n{prose(i, 3)}") for i in range(30)]
    rows += [(100 + i, "\n".join(near) + f"\nCopy {i}.") for i in range(30)]
    rows += [(200 + i, rows[-1][1]) for i in range(5)] + [(300, None), (301, "")]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, recurring string")
    found = {r.line for r in quality_rules.recurring_lines(docs).collect()}
    want = {quality_rules.line_hash(x) for x in _brute_recurring([t or "" for _, t in rows])}
    assert found == want == {quality_rules.line_hash("Shared by all who publish here.")}
    sent = {r.doc_id: r for r in quality_rules.clean_lines(docs).collect()}
    joined = {r.doc_id: r for r in quality_rules.clean_lines(docs, rules=quality_rules.LineRules(broadcast_lines=0)).collect()}
    assert sent == joined and len(sent) == len(rows)
    assert sent[0].removed_words == 6 and "Shared" not in sent[0].cleaned and sent[0].kept and sent[105].kept and sent[105].removed_words == 0


def test_op3(spark, sf_dir, texts):
    items = {r.item_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    rows = QUERIES["op3_benchmark_decontamination"](spark, sf_dir).collect()
    held = {(i, k) for k, t in items.items() for i, d in texts.items() if len(t.split()) >= 8 and t in d}
    assert {(r.doc_id, r.item_id) for r in rows} >= held and held


def test_repeated_items_cost_no_block(spark):
    item = "What is the capital city of the old northern kingdom by the grey sea? The capital is Helmsgard on the river."
    items = spark.createDataFrame([(i, item, "x") for i in range(50)], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(1, f"some words {item} more words", 3), (2, "nothing here", 4)], "doc_id long, text string, item_id int")
    rows = decontam.find_leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, i) for i in range(50)}


def _fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_op5(spark, sf_dir, texts):
    rows = _rows(spark, sf_dir, "op5_simhash_near_dedup")
    prints = {i: _fingerprint(t) for i, t in texts.items()}
    least = {i: i for i in prints}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_op6(spark, sf_dir, texts):
    rows = _rows(spark, sf_dir, "op6_zstd_quality")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    right = [rows[i].predicted == q for i, q in labels.items() if rows[i].held_out]
    assert np.mean(right) >= 0.85
    same = collections.defaultdict(set)
    for i, r in rows.items():
        same[texts[i]].add(r.score)
    assert all(len(s) == 1 for s in same.values())  # the text alone decides


def test_op7(spark, sf_dir, texts):
    rows = _rows(spark, sf_dir, "op7_pii_surrogates")
    assert rows.keys() == texts.keys()
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    mails = {m.lower() for t in texts.values() for m in mail.findall(t)}
    seen = {}
    for i, r in rows.items():
        old, new = mail.findall(texts[i]), mail.findall(r.text or "")
        assert len(old) == len(new) and (r.n_entities > 0 or r.text == texts[i] or not texts[i])
        for a, b in zip(old, new):
            assert seen.setdefault(a.lower(), b.lower()) == b.lower() and b.lower() not in mails
    assert len(set(seen.values())) == len(seen) == len(mails) > 0


def test_op8(spark, sf_dir, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, r in _rows(spark, sf_dir, "op8_sentencepiece").items():
        ids = sp.encode(texts[i])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_op10(spark, sf_dir, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, start = _rows(spark, sf_dir, "op10_token_frames"), 0
    assert rows.keys() == texts.keys()
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 0]
        r = rows[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_pipeline_runs_and_bears_odd_tables(spark, sf_dir, tmp_path):
    """run() over a small table with nulls, empty texts, repeated rows and further columns, and over an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).withColumn("decoded", F.col("lang"))
    odd = spark.createDataFrame(
        [(9001, None, None, None, None, "a"), (9002, "", "en", "s", 0, "b"), (None, "no id here, but a calm sentence.", None, None, 3, None)], docs.schema
    )
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    docs.unionByName(odd).unionByName(docs.limit(5)).write.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.n_tokens == len(r.ids) for r in rows)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
