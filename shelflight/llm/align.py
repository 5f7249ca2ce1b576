"""Alignment of two tokenizers: which tokens of one cover the bytes of which tokens of the other.

Both tokenizers read the same bytes: a space and the text. A token is a row of a
sparse matrix over the byte offsets it covers, held in compressed sparse rows
(``Csr``: where each row starts, and the columns of its entries). Row i of the
product of one matrix with the other's transpose sums, over the bytes of token
i, the rows of these bytes: its entries are the tokens that overlap token i,
with the number of bytes in common. Offsets at which tokens of both end cut a
text into groups; the product of the two token-by-group matrices links all
tokens of a group.

Texts are multiplied a slice at a time, as blocks of one matrix; its columns are
the slice's bytes, so a product has no more entries than bytes. How often a pair
of ids is linked is counted over the whole corpus by Spark.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm import spm
from shelflight.llm.chunk_table import ChunkTable, chunks_by_space
from shelflight.llm.common import join_per_key, materialise

#: Pairs of ids with more than one in so many of all entries are sent to all tasks: fewer than this.
HOT_PAIRS = 1 << 16
#: Bytes of text that are multiplied at once, unless one text has more.
SLICE = 1 << 20
#: Entries of a product of groups that are worked out at once, unless one token has more.
BLOCK = 1 << 20


class Csr(NamedTuple):
    """A sparse matrix: row i has the columns[starts[i] : starts[i + 1]], with values or ones."""

    starts: np.ndarray
    columns: np.ndarray
    width: int
    values: np.ndarray | None = None


def byte_incidence(ends: np.ndarray) -> Csr:
    """Tokens by the bytes they cover, from the offset at which each token ends."""
    total = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate(([0], ends)), np.arange(total), total)


def byte_incidence_transposed(ends: np.ndarray) -> Csr:
    """Bytes by the token that covers each."""
    sizes = np.diff(ends, prepend=0)
    total = int(ends[-1]) if len(ends) else 0
    return Csr(np.arange(total + 1), np.repeat(np.arange(len(ends)), sizes), len(ends))


def group_incidence(groups: np.ndarray, width: int) -> Csr:
    """Tokens by their group."""
    return Csr(np.arange(len(groups) + 1), groups, width)


def group_incidence_transposed(groups: np.ndarray, width: int) -> Csr:
    """Groups by their tokens; ``groups`` ascends."""
    return Csr(np.searchsorted(groups, np.arange(width + 1)), np.arange(len(groups)), len(groups))


def row_products(left: Csr, right: Csr) -> Csr:
    """``left`` times ``right``, row by row: row i is the sum of the rows of ``right`` that row i of ``left`` names.

    All rows are expanded at once; equal columns of a row are then added up.
    """
    sizes = np.diff(right.starts)[left.columns]
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    at = np.arange(total) + np.repeat(right.starts[left.columns] - (stops - sizes), sizes)
    rows = np.repeat(np.repeat(np.arange(len(left.starts) - 1), np.diff(left.starts)), sizes)
    keys = rows * right.width + right.columns[at]
    if (keys[1:] < keys[:-1]).any():
        keys.sort()
    firsts = np.flatnonzero(np.diff(keys, prepend=-1))
    found = keys[firsts]
    counts = np.diff(np.append(firsts, total))
    starts = np.searchsorted(found, np.arange(len(left.starts)) * right.width)
    return Csr(starts, found % max(right.width, 1), right.width, counts)


def entry_rows(m: Csr) -> np.ndarray:
    """The row of each entry."""
    return np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts))


class Vocabulary(NamedTuple):
    """Bytes of each id, one after another, and where they start and how many they are."""

    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Vocabulary:
        sizes = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[ids] - (stops - sizes), sizes)]


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow at 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Side(NamedTuple):
    table: ChunkTable | None
    vocabulary: Vocabulary


@lru_cache(2)
def _byte_level(tokenizer: str) -> _Side:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one Spark task, one core
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer)
    own.encode_special_tokens = True  # their strings in a text are ordinary text
    alphabet = byte_alphabet()
    tokens = [own.id_to_token(i) or "" for i in range(own.get_vocab_size())]
    table = ChunkTable(
        lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)],
        np.array([t.startswith("Ġ") for t in tokens]),  # the space
        lambda text: chunks_by_space(f" {text}"),
        max_chunks=300_000,
        max_ids=3_000_000,
        marked=True,
    )
    return _Side(table, Vocabulary.of([bytes(alphabet[c] for c in t) if set(t) <= alphabet.keys() else t.encode() for t in tokens]))


@lru_cache(2)
def _pieces(model: str) -> _Side:
    sp = sentencepiece.SentencePieceProcessor(model_file=model)

    def content(i: int) -> bytes:
        piece = sp.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace(spm.MARK, " ").encode()

    return _Side(None, Vocabulary.of([content(i) for i in range(sp.get_piece_size())]))


def vocabulary_sizes(tokenizer: str, model: str) -> tuple[int, int]:
    return len(_byte_level(tokenizer).vocabulary.sizes), len(_pieces(model).vocabulary.sizes)


def _joined(slices: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all slices, and the end of each text."""
    ids, ends, done = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for _, part, stops in slices:
        ids.append(part)
        ends.append(np.asarray(stops, np.int64) + done)
        done += len(part)
    return np.concatenate(ids).astype(np.int64), np.concatenate(ends)


def _chosen(ids: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As given, but texts that are not kept have no ids."""
    sizes = np.diff(ends, prepend=0)
    return ids[np.repeat(keep, sizes)], np.cumsum(np.where(keep, sizes, 0))


class Aligned:
    """A slice of texts in both tokenizers: ids, the end of each text's ids, and the byte offset where each token ends.

    Texts that are null or empty, or whose tokens in either tokenizer do not join
    to a space and the text, have no tokens.
    """

    def __init__(self, texts: pa.Array, tokenizer: str, model: str):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        a, b = _byte_level(tokenizer), _pieces(model)
        marked = pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(""))
        stops = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1].astype(np.int64)
        own = np.frombuffer(marked.buffers()[2], np.uint8)[stops[0] : stops[-1]]
        lengths = np.diff(stops)
        ids_a, self.stops_a = _joined(a.table.encode_column(texts))
        ids_b, self.stops_b = _joined(spm.encode_column(texts, model))
        keep = lengths > 1
        for side, ids, ends in ((a, ids_a, self.stops_a), (b, ids_b, self.stops_b)):
            sizes = np.concatenate(([0], np.cumsum(side.vocabulary.sizes[ids])))
            keep &= np.diff(sizes[ends], prepend=0) == lengths
        self.ids_a, self.stops_a = _chosen(ids_a, self.stops_a, keep)
        self.ids_b, self.stops_b = _chosen(ids_b, self.stops_b, keep)
        wanted = own[np.repeat(keep, lengths)]
        odd = (a.vocabulary.bytes_of(self.ids_a) != wanted) | (b.vocabulary.bytes_of(self.ids_b) != wanted)
        if odd.any():
            texts_at = np.repeat(np.arange(len(keep)), np.where(keep, lengths, 0))
            same = np.ones(len(keep), bool)
            same[texts_at[odd]] = False
            self.ids_a, self.stops_a = _chosen(self.ids_a, self.stops_a, same)
            self.ids_b, self.stops_b = _chosen(self.ids_b, self.stops_b, same)
        self.ends_a = np.cumsum(a.vocabulary.sizes[self.ids_a])
        self.ends_b = np.cumsum(b.vocabulary.sizes[self.ids_b])

    def overlaps(self) -> Csr:
        """Tokens of one side by those of the other with bytes in common; values count the bytes."""
        return row_products(byte_incidence(self.ends_a), byte_incidence_transposed(self.ends_b))

    def ends_together(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of tokens that end at one byte: those of the overlapping pairs whose ends agree."""
        found = self.overlaps()
        rows = entry_rows(found)
        same = self.ends_a[rows] == self.ends_b[found.columns]
        return rows[same], found.columns[same]

    def groups(self, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token, counted over the slice; ``cuts`` are the offsets where both sides end."""
        return np.searchsorted(cuts, self.ends_a), np.searchsorted(cuts, self.ends_b)

    def shared_groups(self, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of tokens of one group, in blocks of bounded size."""
        in_a, in_b = self.groups(cuts)
        left, right = group_incidence(in_a, len(cuts)), group_incidence_transposed(in_b, len(cuts))
        sizes = np.cumsum(np.diff(right.starts)[left.columns])
        first = 0
        while first < len(in_a):
            done = int(sizes[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, done + BLOCK, "right")))
            part = row_products(Csr(np.arange(last - first + 1), left.columns[first:last], left.width), right)
            yield entry_rows(part) + first, part.columns
            first = last


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """Texts of a column by bounded numbers of bytes; one text at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column.cast(pa.string())), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < len(column):
        done = int(sizes[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + SLICE, "right")))
        yield column.slice(first, last - first)
        first = last


@lru_cache(2)
def _words(size_a: int, size_b: int) -> pa.Array:
    """Decimal ids with what may follow them: first-side ids with ``,`` and ``|``, then second-side ids with ``,``, ``;`` and nothing."""
    return pa.array([f"{i}{s}" for s in ",|" for i in range(size_a)] + [f"{i}{s}" for s in (",", ";", "") for i in range(size_b)])


def group_texts(found: Aligned, cuts: np.ndarray, size_a: int, size_b: int) -> pa.Array:
    """The groups of each text as ``a1,a2|b1;a3|b2,b3``: the ids of both sides in order."""
    in_a, in_b = found.groups(cuts)
    n = len(cuts)
    per_a, per_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
    before_a, before_b = np.cumsum(per_a), np.cumsum(per_b) - per_b
    last_a = np.zeros(len(in_a), bool)
    last_a[before_a - 1] = True
    end_b = np.zeros(len(in_b), np.int64)
    end_b[np.cumsum(per_b) - 1] = 1
    closing = found.stops_b[np.diff(found.stops_b, prepend=0) > 0] - 1  # the last token of each text
    end_b[closing] = 2
    words = np.empty(len(in_a) + len(in_b), np.int64)
    words[np.arange(len(in_a)) + before_b[in_a]] = found.ids_a + last_a * size_a
    words[np.arange(len(in_b)) + before_a[in_b]] = found.ids_b + 2 * size_a + end_b * size_b
    offsets = np.concatenate(([0], found.stops_a + found.stops_b)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), _words(size_a, size_b).take(pa.array(words))), "")


def _numbers_per_text(stops: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The text of each token."""
    return np.searchsorted(stops, rows, "right")


def _source(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )


def token_links(df: DataFrame, tokenizer: str, model: str, kind: str = "overlap", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a_at, b_at, a_id, b_id, shared): every link between tokens of a text, by their places in the two encodings.

    ``kind`` is ``overlap`` (bytes in common; shared is their number), ``end`` (ranges
    that end together) or ``group`` (both in one group; a group of many tokens on
    both sides has as many links as their product). shared is null but for overlaps.
    """
    if kind not in ("overlap", "end", "group"):
        raise ValueError(f"no such kind of links: {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(2)):
                ids = batch.column(1).slice(at, len(texts))
                at += len(texts)
                found = Aligned(texts, tokenizer, model)
                if kind == "overlap":
                    entries = found.overlaps()
                    blocks = [(entry_rows(entries), entries.columns, pa.array(entries.values, pa.int64()))]
                else:
                    rows, columns = found.ends_together()
                    parts = [(rows, columns)] if kind == "end" else found.shared_groups(found.ends_a[rows])
                    blocks = ((r, c, pa.nulls(len(r), pa.int64())) for r, c in parts)
                for rows, columns, shared in blocks:
                    own = _numbers_per_text(found.stops_a, rows)
                    first = lambda stops: np.concatenate(([0], stops))[own]  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(own)),
                            pa.array(rows - first(found.stops_a)),
                            pa.array(columns - first(found.stops_b)),
                            pa.array(found.ids_a[rows], pa.int32()),
                            pa.array(found.ids_b[columns], pa.int32()),
                            shared,
                        ],
                        names=["doc_id", "a_at", "b_at", "a_id", "b_id", "shared"],
                    )

    return _source(df, doc_id, text).mapInArrow(run, "doc_id long, a_at long, b_at long, a_id int, b_id int, shared long")


def _coded(df: DataFrame, tokenizer: str, model: str, doc_id: str, text: str) -> DataFrame:
    """A row for each text: its figures, its groups' digest, and its distinct linked pairs of ids with their numbers."""
    size_a, size_b = vocabulary_sizes(tokenizer, model)
    narrow = size_a * size_b < 1 << 31
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(2)):
                own = batch.slice(at, len(texts))
                at += len(texts)
                n = len(texts)
                found = Aligned(texts, tokenizer, model)
                rows, columns = found.ends_together()
                in_text = _numbers_per_text(found.stops_a, rows)
                cuts = found.ends_a[rows]  # ascending: a token ends together with one other at most
                n_links = np.bincount(in_text, minlength=n)
                # a text's last cut is its end
                n_groups = np.diff(np.searchsorted(cuts, np.concatenate(([0], found.ends_a))[found.stops_a], "right"), prepend=0)
                spelled = group_texts(found, cuts, size_a, size_b)
                sha = [hashlib.sha256(t.as_buffer()).hexdigest() if t.as_buffer().size else "" for t in spelled]
                pairs = found.ids_a[rows] * size_b + found.ids_b[columns]
                keys, times = np.unique(in_text * (size_a * size_b) + pairs, return_counts=True)
                offsets = pa.array(np.concatenate(([0], np.searchsorted(keys, np.arange(1, n + 1) * (size_a * size_b)))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0),
                        own.column(1),
                        pa.array(np.diff(found.stops_a, prepend=0)),
                        pa.array(np.diff(found.stops_b, prepend=0)),
                        pa.array(n_groups),
                        pa.array(n_links),
                        pa.array(sha, pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(keys % (size_a * size_b), pa.int32() if narrow else pa.int64())),
                        pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                    ],
                    names=names,
                )

    kinds = ["long"] * 6 + ["string", f"array<{'int' if narrow else 'long'}>", "array<int>"]
    return _source(df, doc_id, text).mapInArrow(run, ", ".join(f"{a} {k}" for a, k in zip(names, kinds)))


def _entries(coded: DataFrame) -> DataFrame:
    zipped = F.explode(F.arrays_zip("pairs", "times"))
    return coded.select("row", zipped.alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))


def _counted(entries: DataFrame) -> DataFrame:
    return entries.groupBy("pair").agg(F.sum("times").alias("count"), F.count("*").alias("n"))


def pair_counts(df: DataFrame, tokenizer: str, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a_id, b_id, count): how many pairs of tokens that end together hold each pair of ids, over the whole corpus."""
    _, size_b = vocabulary_sizes(tokenizer, model)
    counts = _counted(_entries(_coded(df, tokenizer, model, doc_id, text)))
    a_id = F.floor(F.col("pair") / F.lit(size_b)).cast("int").alias("a_id")
    return counts.select(a_id, (F.col("pair") % F.lit(size_b)).cast("int").alias("b_id"), "count")


def align_documents(df: DataFrame, tokenizer: str, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A byte-level tokenizer (a) reads a space and the text, a SentencePiece model (b)
    the text, each whole and without special tokens; such tokens' strings in a text
    are ordinary text. n_groups counts the groups between offsets where tokens of
    both end, n_links the pairs of tokens that end together. A pair of ids is
    counted over the whole corpus: count_sum adds the counts of a text's links, and
    n_best counts the links whose count is the greatest of their b id, ties
    included. groups_sha256 is the digest of the groups' ids (``group_texts``).
    Null and empty texts, and texts that either tokenizer does not give back byte
    by byte, have zeros and an empty groups_sha256. Repeated rows all stay and
    count each. An empty table gives no rows. Other columns are ignored.

    Entries of a text's distinct pairs meet the counts of the corpus in a join:
    frequent pairs, fewer than ``HOT_PAIRS`` by the share that makes them so, are
    sent to the tasks, the others are shuffled. The greatest count of each b id is a
    table no longer than the vocabulary.
    """
    _, size_b = vocabulary_sizes(tokenizer, model)
    coded = materialise(_coded(df, tokenizer, model, doc_id, text), "aligned")
    counts = materialise(_counted(_entries(coded)).withColumn("b", F.col("pair") % F.lit(size_b)), "pair-counts")
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    rated = counts.join(F.broadcast(best), "b").select("pair", "count", "n", (F.col("count") == F.col("most")).alias("best"))
    rated = materialise(rated, "pair-ratings")
    met = join_per_key(_entries(coded), rated, "pair", hot_keys=HOT_PAIRS)
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("count") * F.col("times")).alias("count_sum"),
    )
    whole = coded.drop("pairs", "times").join(sums.hint("merge"), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
