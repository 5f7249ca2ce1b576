"""Benchmark decontamination: BM25 retrieval of test items for every training passage.

The test items are a stated query set; their inverted index is built per block
of bounded size and sent to the tasks that read the corpus once per block. A
posting's weight is its BM25 impact as a share of the item's own score, so one
threshold holds for all items. Passages are overlapping windows of a text, wide
enough that every item of the block fits into one whole. A window is skipped
when the upper bounds of its terms cannot reach the threshold; the others are
searched by block-max WAND, which returns every item at or above the threshold.
A retrieved item counts as leaked when both its question (all but the last
sentence) and its answer (the last sentence) are found again as word shingles.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelflight.llm.common import discard, materialise

K1, B = 1.2, 0.75
#: Postings to a block of the index, each with its greatest weight.
POSTINGS = 64
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACED = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class Limits:
    """What counts as found: BM25 share of the item's own score, and shares of its word shingles."""

    score: float = 0.6
    shingle: int = 5
    overlap: float = 0.8
    common_share: float = 0.25
    block_bytes: int = 16 << 20  # of test items per index

    def __post_init__(self) -> None:
        if self.common_share >= self.score:  # an item could then be found by words that are never looked up
            raise ValueError("common_share must be below score")


def tokens(text: str) -> list[bytes]:
    """Lower-case words, cut at white space and ASCII punctuation."""
    return text.lower().encode().translate(_SPACED).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words before the last sentence, and of it; an item of one sentence is halved."""
    sentences = [s for s in _SENTENCE_END.split(text.strip()) if tokens(s)]
    if len(sentences) < 2:
        words = tokens(text)
        half = len(words) - len(words) // 2
        return words[:half], words[half:]
    return tokens(" ".join(sentences[:-1])), tokens(sentences[-1])


def _shingles(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


class Index:
    """Inverted index of one block of items with block-max bounds."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], count: int, mean_length: float, limits: Limits):
        self.limits = limits
        self.ids = [i for i, _ in items]
        self.parts, lengths, need = [], [], []
        essential: dict[bytes, list[tuple[int, float]]] = {}
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for n, (_, text) in enumerate(items):
            words = tokens(text)
            lengths.append(len(words))
            weights = {}
            for term, tf in Counter(words).items():
                idf = math.log1p((count - df[term] + 0.5) / (df[term] + 0.5))
                weights[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / max(mean_length, 1)))
            own, rest = sum(weights.values()), 0.0
            for term, w in sorted(weights.items(), key=lambda x: (-df[x[0]], x[0])):
                postings.setdefault(term, []).append((n, w / own))
                if rest + w / own <= limits.common_share:
                    rest += w / own
                else:
                    essential.setdefault(term, []).append((n, w / own))
            need.append(limits.score - rest - 1e-9)
            both = []
            for part in question_and_answer(text):
                width = min(limits.shingle, len(part))
                both.append((width, _shingles(part, width)))
            self.parts.append(both)
        self.window = 2 * max(lengths, default=1)
        self.terms = {t: n for n, t in enumerate(postings)}
        self.items = [[i for i, _ in p] for p in postings.values()]
        self.weights = [[w for _, w in p] for p in postings.values()]
        self.bounds = [[max(w[at : at + POSTINGS]) for at in range(0, len(w), POSTINGS)] for w in self.weights]
        self.most = [max(b) for b in self.bounds]
        # essential postings, those of a term together; the last row is for words that are no term
        lists = [essential.get(t, []) for t in postings]
        self.counts = np.array([*map(len, lists), 0])
        self.firsts = np.concatenate(([0], np.cumsum(self.counts[:-1])))
        self.essential_items = np.array([i for own in lists for i, _ in own], np.int64)
        self.essential_weights = np.array([w for own in lists for _, w in own])
        self.need = np.array(need)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Every item whose score over the distinct ``terms`` reaches the threshold (block-max WAND)."""
        least = self.limits.score - 1e-9
        cursors = [[self.items[t][0], t, 0] for t in terms]  # item, term, place
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, (item, t, _) in enumerate(cursors):
                bound += self.most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            # the blocks that would hold the target: if their bounds fall short, no item up to their nearest end can
            shallow, end = 0.0, None
            for item, t, place in cursors[: pivot + 1]:
                block = bisect_left(self.items[t], target, place) // POSTINGS
                if block < len(self.bounds[t]):
                    shallow += self.bounds[t][block]
                    last = self.items[t][min((block + 1) * POSTINGS, len(self.items[t])) - 1]
                    end = last if end is None else min(end, last)
            if shallow >= least:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    place = bisect_left(self.items[c[1]], target, c[2])
                    if place < len(self.items[c[1]]) and self.items[c[1]][place] == target:
                        score += self.weights[c[1]][place]
                if score >= least:
                    found.append((target, score))
                ahead = target + 1
            else:
                ahead = max(target, end if end is not None else target) + 1
                if pivot + 1 < len(cursors):
                    ahead = max(target + 1, min(ahead, cursors[pivot + 1][0]))
            moved = []
            for c in cursors:
                if c[0] < ahead:
                    c[2] = bisect_left(self.items[c[1]], ahead, c[2])
                    if c[2] == len(self.items[c[1]]):
                        continue
                    c[0] = self.items[c[1]][c[2]]
                moved.append(c)
            cursors = moved
        return found

    def overlaps(self, item: int, words: list[bytes]) -> tuple[float, float]:
        """Shares of the question's and the answer's shingles found among ``words``; 1 for a part without words."""
        shares = []
        for width, wanted in self.parts[item]:
            if not wanted:
                shares.append(1.0)
                continue
            own = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
            shares.append(len(wanted & own) / len(wanted))
        return shares[0], shares[1]

    def _promising(self, ids: np.ndarray, step: int) -> list[int]:
        """Numbers of the windows that may hold a result; window k has the words from k * step on, two steps long."""
        places = np.flatnonzero(self.counts[ids])
        if not len(places):
            return []
        terms = ids[places]
        n = self.counts[terms]
        ends = np.cumsum(n)
        hits = np.arange(ends[-1]) + np.repeat(self.firsts[terms] - (ends - n), n)
        items, weights = self.essential_items[hits], self.essential_weights[hits]
        steps = np.repeat(places // step, n)
        # a step's words lie in the window that begins there and in the one before
        cells, inverse = np.unique(
            np.concatenate([steps * len(self.ids) + items, (steps - 1) * len(self.ids) + items]), return_inverse=True
        )
        sums = np.bincount(inverse, np.concatenate([weights, weights]))
        windows = np.unique(cells[sums >= self.need[cells % len(self.ids)]] // len(self.ids))
        return np.unique(np.maximum(windows, 0)).tolist()

    def leaks(self, text: str) -> list[tuple[int, float, float, float, int, int]]:
        """(item id, score, question share, answer share, first word, end word) for the best window of each item."""
        words = tokens(text)
        if not words or not self.ids:
            return []
        none = len(self.terms)
        get = self.terms.get
        ids = np.fromiter((get(w, none) for w in words), np.int32, len(words))
        step = max(1, self.window // 2)
        best: dict[int, tuple] = {}
        for at in self._promising(ids, step):
            s, e = at * step, min(at * step + self.window, len(words))
            terms = np.unique(ids[s:e])
            terms = terms[terms < none]
            for item, score in self.search(terms.tolist()):
                question, answer = self.overlaps(item, words[s:e])
                if min(question, answer) >= self.limits.overlap:
                    row = (self.ids[item], score, question, answer, s, e)
                    best[item] = max(best.get(item, row), row, key=lambda r: (r[2] + r[3], r[1], -r[4]))
        return list(best.values())


def _blocks(items: DataFrame, limits: Limits) -> Iterator[tuple[Index, bool]]:
    """The items' index in blocks of bounded size, with statistics over all items, and whether a block is the last."""
    size, count = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)), F.count("*")).first()
    n = max(1, -(-size // limits.block_bytes))
    placed = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    term = F.explode(F.array_distinct(_spark_tokens("text")))
    lengths = items.agg(F.avg(F.size(_spark_tokens("text")))).first()[0]
    frequency = items.select(term.alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for block in range(n):
        own = placed.where(F.col("block") == block)
        # both collects hold one block of items: block_bytes on average, by the hash of the item
        rows = [(r.item_id, r.text) for r in own.select("item_id", "text").orderBy("item_id", "text").collect()]
        terms = own.select(term.alias("term")).distinct().join(frequency.hint("merge"), "term")
        df = {r.term.encode(): r.df for r in terms.collect()}
        for _, text in rows:  # words whose lower case differs between the JVM and Python
            for w in set(tokens(text)) - df.keys():
                df[w] = 1
        yield Index(rows, df, count, lengths or 1.0, limits), block == n - 1


def _spark_tokens(text: str):
    """``tokens`` in Spark."""
    plain = F.regexp_replace(F.lower(F.col(text)), r"\p{Punct}+", " ")
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _distinct_items(items: DataFrame) -> DataFrame:
    """Items with a text, exactly repeated ones once, so that a block's share of items is what its hash says."""
    return items.select("item_id", "text").where(F.trim(F.coalesce("text", F.lit(""))) != "").distinct()


def find_leaks(
    docs: DataFrame, items: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word, end_word): one row per document and leaked item.

    ``items`` has item_id and text. Null and empty texts, and items without a
    word, give no rows; a repeated document gives rows of its own, an exactly
    repeated item counts once, and equal texts under several ids are all
    reported. Texts and items may be of any length. An empty table on either side
    gives no rows. An item that occurs more than once in a text is reported once, at its best
    window. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    items = _distinct_items(items)
    kinds = dict(rows.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = (
        f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, "
        "answer_overlap double, first_word int, end_word int"
    )
    found = None
    for index, last in _blocks(items, limits):
        sent = spark.sparkContext.broadcast(index)
        part = _search(rows, sent, schema)
        if not last:  # its hits are written before the next index is made, so that one is held at a time
            part = materialise(part, "leaks")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def _search(rows: DataFrame, index, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [f.type for f in to_arrow_schema(T.StructType.fromDDL(schema))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (batch.column(0)[i].as_py(), *leak)
                for i, t in enumerate(batch.column(1))
                for leak in index.value.leaks(t.as_py())
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return rows.mapInArrow(run, schema)


def without_leaks(docs: DataFrame, items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) in whose text no item is found.

    Null and empty texts stay, and so do repeated rows; without items all rows stay.
    """
    spark = docs.sparkSession
    if not docs.columns:
        return docs
    items = _distinct_items(items)
    used: list[str] = []
    for index, last in _blocks(items, limits):
        sent = spark.sparkContext.broadcast(index)
        docs = _drop(docs, sent)
        if not last:  # as in ``find_leaks``; what an earlier block left is read no more
            before, used = used, []
            docs = materialise(docs, "unleaked", used)
            discard(spark, before)
            sent.destroy()
    return docs


def _drop(docs: DataFrame, index) -> DataFrame:
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not (t.is_valid and index.value.leaks(t.as_py())) for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
