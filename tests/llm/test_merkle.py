"""Merkle proofs against a plain recomputation, over hot groups, nulls, ties and extra columns."""

import hashlib
import string
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from shelflight.llm import merkle
from shelflight.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, k int, hash string"


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    parts = ["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS]
    return _h("".join(parts))


def _climb(nodes):
    """The root of a list of digests, and each one's siblings on its way up as (before, behind)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            first = k // 8 * 8
            ways[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 8])))
        nodes = [_h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [k // 8 for k in at]
    return nodes[0], ways


def expected(rows, claim):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        members = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
        trees[g] = members, *_climb([_leaf(r) for r in members])
    if not order:
        return []
    root, tops = _climb([trees[g][1] for g in order])
    out = []
    for g, top in zip(order, tops):
        members, subroot, ways = trees[g]
        for r, way in zip(members, ways):
            folded = _leaf(r | {"text": claim(r)})
            for before, behind in way + top:
                folded = _h(before + folded + behind)
            proof = _h("".join(b + a for b, a in way + top))
            out.append((r["doc_id"], _leaf(r), subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def _claim(row):
    tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
    text = row["text"]
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) if tampered and text is not None else text


def _proved(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(3)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.when(tampered, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    found = merkle.prove(df, COLUMNS, "lang", "doc_id", {"text": lowered}).collect()
    return sorted(
        ((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found), key=repr
    )


def _row(i, text, lang, source="s", n=1):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": n, "tree": "t", "k": 1, "hash": "x"}


def test_query(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = QUERIES["op11_merkle_manifest"](spark, sf_dir)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in found.select(*names).collect()), key=repr)
    assert got == expected(rows, _claim)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op11_merkle_manifest']})").fetchall(), key=repr) == got


def test_groups_of_all_sizes(spark):
    rows = [_row(i, f"Text {i}", "hot") for i in range(150)]  # a hot group of three levels, the last run short
    rows += [_row(1000 + i, "T", "é") for i in range(9)] + [_row(2000 + i, None, "z" * 3) for i in range(8)]
    rows += [_row(3000 + i, "Aa", f"l{i}") for i in range(10)]  # lone leaves; more groups than a run holds
    rows += [_row(4000, "", ""), _row(4001, "X", None), _row(4002, "Ä" * 100_000, None, None, None)]
    assert _proved(spark, rows) == expected(rows, _claim)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [_row(None, "B", "a"), _row(None, "A", "a"), _row(7, "A", "a"), _row(7, "B", "a"), _row(-5, "C", "a")]
    rows += [_row(9, "Same", "a")] * 11 + [_row(None, None, None)] * 3
    assert _proved(spark, rows) == expected(rows, _claim)


def test_empty_and_single(spark):
    assert _proved(spark, []) == []
    one = _proved(spark, [_row(3, "Only", "en")])
    assert one == expected([_row(3, "Only", "en")], _claim) and one[0][4] == _h("")


def test_kept_columns(spark):
    df = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "y", 6)], "id int, hash string, text string, way int")
    found = merkle.prove(df, ["id", "text"], "hash", "id", keep=("way", "hash")).collect()
    assert {(r.id, r.way, r.hash, r.verified) for r in found} == {(1, 5, "a", True), (2, 6, "a", True)}


def test_a_plan_without_gathering(spark, sf_dir):
    plan = QUERIES["op11_merkle_manifest"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65])
def test_level_sizes(spark, n):
    rows = [_row(i, "t", "en") for i in range(n)]
    assert _proved(spark, rows) == expected(rows, _claim)
