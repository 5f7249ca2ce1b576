"""Alignment of two tokenizers against a plain recomputation with the libraries' own encodings."""

import bisect
import collections
import hashlib
import itertools

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelflight.llm import align
from shelflight.llm.queries import QUERIES

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  two  spaces ", "<|endoftext|> <s> </s>", "a▁b", "日本語のテキスト🙂🙂 \n\n\t x", "\x00z", "a b", "<unk> <0x41>",
    "x" * 3000, "a\r\nb", "it's I'll 12,345.67", "ﬁ Å é", "word " * 400,
]


@pytest.fixture(scope="module")
def coders():
    own = Tokenizer.from_file(BYTES)
    own.encode_special_tokens = True
    return own, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def _brute(text, coders):
    """(a ids, b ids, ends of a, ends of b, cuts) or None for a text without tokens."""
    own, sp = coders
    if not text:
        return None
    a, b = own.encode(f" {text}", add_special_tokens=False).ids, sp.encode(text)
    alphabet = align.byte_alphabet()
    in_a = [bytes(alphabet[c] for c in own.id_to_token(i)) for i in a]
    in_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(in_a) == b"".join(in_b) == f" {text}".encode():
        return None
    ends = [list(itertools.accumulate(map(len, side))) for side in (in_a, in_b)]
    return a, b, *ends, sorted(set(ends[0]) & set(ends[1]))


def _expected(texts, coders):
    coded = {i: _brute(t, coders) for i, t in texts.items()}
    links = {}
    for i, v in coded.items():
        at_b = dict(zip(v[3], v[1])) if v else {}
        links[i] = [(x, at_b[e]) for x, e in zip(v[0], v[2]) if e in at_b] if v else []
    counts = collections.Counter(x for own in links.values() for x in own)
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = {}
    for i, v in coded.items():
        if v is None:
            out[i] = (0, 0, 0, 0, 0, 0, "")
            continue
        groups = [([], []) for _ in v[4]]
        for side in (0, 1):
            for x, e in zip(v[side], v[2 + side]):
                groups[bisect.bisect_left(v[4], e)][side].append(x)
        spelled = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        own = links[i]
        n_best = sum(counts[x] == best[x[1]] for x in own)
        total = sum(counts[x] for x in own)
        out[i] = (len(v[0]), len(v[1]), len(v[4]), len(own), n_best, total, hashlib.sha256(spelled.encode()).hexdigest())
    return out


def _figures(rows):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows}


def test_query(spark, sf_dir, coders):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert _figures(QUERIES["op12_tokenizer_alignment"](spark, sf_dir).collect()) == _expected(texts, coders)


def test_odd_texts_and_clashing_columns(spark, coders):
    texts = dict(enumerate(ODD)) | {100: None}
    rows = [(i, t, 1, "x", 2) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id int, text string, row int, pairs string, n int").repartition(3)
    assert _figures(align.align_documents(df, BYTES, PIECES).collect()) == _expected(texts, coders)


def test_repeated_rows_count_each(spark, coders):
    df = spark.createDataFrame([(1, "one two")] * 3 + [(None, "one"), (None, None)], "doc_id long, text string")
    found = sorted(tuple(r) for r in align.align_documents(df, BYTES, PIECES).where("doc_id = 1").collect())
    want = _expected({i: t for i, t in enumerate(["one two"] * 3 + ["one"])}, coders)[0]
    assert len(found) == 3 and all(r[1:] == want for r in found)
    assert align.align_documents(df.limit(0), BYTES, PIECES).count() == 0


def test_pairs_of_any_frequency(spark, coders, monkeypatch):
    texts = {i: t for i, t in enumerate(["the cat", "the the the dog", "a catalogue of dogs, the end"] * 5)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for most in (1, 4, 1 << 16):  # all pairs shuffled, some sent, all sent
        monkeypatch.setattr(align, "HOT_PAIRS", most)
        assert _figures(align.align_documents(df, BYTES, PIECES).collect()) == _expected(texts, coders)


@pytest.mark.parametrize("kind", ["overlap", "end", "group"])
def test_links(spark, coders, kind, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 5)
    texts = {i: t for i, t in enumerate(ODD) if t is None or len(t) < 100}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = set()
    for i, t in texts.items():
        if (v := _brute(t, coders)) is None:
            continue
        starts = [[0, *v[2]], [0, *v[3]]]
        group = [[bisect.bisect_left(v[4], e) for e in v[2 + s]] for s in (0, 1)]
        for x, y in itertools.product(range(len(v[0])), range(len(v[1]))):
            common = min(v[2][x], v[3][y]) - max(starts[0][x], starts[1][y])
            linked = {"overlap": common > 0, "end": v[2][x] == v[3][y], "group": group[0][x] == group[1][y]}[kind]
            if linked:
                want.add((i, x, y, v[0][x], v[1][y], common if kind == "overlap" else None))
    rows = [tuple(r) for r in align.token_links(df, BYTES, PIECES, kind).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_pair_counts(spark):
    df = spark.createDataFrame([(1, "the the"), (2, "the")], "doc_id long, text string")
    assert {r["count"] for r in align.pair_counts(df, BYTES, PIECES).collect()} == {3}


def test_row_products():
    """Against dense products, for matrices that are no tokens at all."""
    rng = np.random.default_rng(5)
    for rows, inner, columns in ((4, 6, 5), (1, 1, 1), (3, 8, 2)):
        left, right = rng.random((rows, inner)) < 0.4, rng.random((inner, columns)) < 0.4
        sparse = [align.Csr(np.concatenate(([0], np.cumsum(m.sum(1)))), np.nonzero(m)[1], m.shape[1]) for m in (left, right)]
        got = align.row_products(*sparse)
        dense = np.zeros((rows, columns), int)
        dense[align.entry_rows(got), got.columns] = got.values
        assert (dense == left.astype(int) @ right.astype(int)).all()
