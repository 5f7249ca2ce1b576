"""SentencePiece encoding and decoding over DataFrame columns.

Encoding uses a distinct-chunk table (``chunk_table``): where the model's pieces
cannot cross a white-space mark, each distinct marked word is segmented once per
worker and ids are joined back by position. ``crosses_marks`` tests that on the
model itself; a model that fails the test is encoded text by text. The table is
one per Python worker and of bounded size, instead of a table of the whole
corpus: that would need a shuffle of every word position.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflight.llm.chunk_table import ChunkTable, chunks_by_space, slices

MARK = "▁"


@lru_cache(2)
def _processor(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


def crosses_marks(sp: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether a text may be segmented otherwise than word by marked word.

    So if a piece holds a mark behind another character, or if the normaliser
    does more than to put a mark in front and in place of each space.
    """
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    probe = "  AÄﬁ½ \t　Å ä\r\n b  c "
    return (
        any(MARK in p.lstrip(MARK) for p in pieces)
        or sp.normalize(probe) != MARK + probe.replace(" ", MARK)
        or sp.encode(" ") != sp.encode(MARK)
    )


@lru_cache(2)
def _table(model: str) -> ChunkTable | None:
    sp = _processor(model)
    if crosses_marks(sp):
        return None
    begins = np.array([sp.id_to_piece(i).startswith(MARK) for i in range(sp.get_piece_size())])
    # a text's leading space is the mark that the library puts in front
    return ChunkTable(
        lambda texts: sp.encode([t[1:] for t in texts], num_threads=1), begins, _marked_words, marked=True
    )


def _marked_words(text: str) -> list:
    """Chunks of a text: each word with its own mark, as if the text began with a space."""
    return chunks_by_space(f" {text}")


def encode_column(column: pa.Array, model: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of texts, their ids, each text's end) for slices of a column; equal to the library's ``encode`` of each."""
    table = _table(model)
    if table is not None:
        yield from table.encode_column(pc.replace_substring(column, MARK, " "))
        return
    texts = [t or "" for t in column.to_pylist()]
    for first, last in slices(texts):
        found = _processor(model).encode(texts[first:last], num_threads=1)
        yield last - first, np.fromiter((i for ids in found for i in ids), np.int32), np.cumsum([len(ids) for ids in found])


def _with_columns(df: DataFrame, source: str, outs: dict[str, T.DataType], drop_source: bool, run) -> DataFrame:
    """``df`` with columns made from ``source`` by ``run``, which gives arrays for slices of a batch in order."""
    taken = {o.lower() for o in outs}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken and not (drop_source and f.name == source)]
    # by place: no name of a column clashes with the source's
    wanted = df.select(F.col(f"`{source}`").alias("source"), *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)])
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in outs.items()]])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = 0
            for arrays in run(part.column(0)):
                columns = [c.slice(at, len(arrays[0])) for c in part.columns[1:]]
                yield pa.RecordBatch.from_arrays([*columns, *arrays], names=schema.names)
                at += len(arrays[0])

    return wanted.mapInArrow(batches, schema)


def encode(
    df: DataFrame, model: str, text: str = "text", out: str = "ids", decoded: str | None = None, drop_text: bool = False
) -> DataFrame:
    """``df`` with ``out``, the ids of each whole text, without begin or end ids and without sampling.

    With ``decoded`` named, that column has the library's decoding of the ids, in
    the same pass. Null and empty texts give an empty array. Equal rows stay as
    they are. Columns of these names are replaced.
    """
    outs: dict[str, T.DataType] = {out: T.ArrayType(T.IntegerType())}
    if decoded:
        outs[decoded] = T.StringType()

    def run(column: pa.Array) -> Iterator[list[pa.Array]]:
        for _, ids, ends in encode_column(column, model):
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            if not decoded:
                yield [arrays]
                continue
            for at in range(0, len(arrays), 64):
                part = arrays.slice(at, 64)
                yield [part, pa.array(_decoded(part, model), pa.string())]

    return _with_columns(df, text, outs, drop_text, run)


def _decoded(ids: pa.Array, model: str) -> list[str]:
    decode_ids = _processor(model).decode
    return [decode_ids(x) if x else "" for x in ids.to_pylist()]


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the library's decoding of each array of ids.

    Null and empty arrays give an empty text. A column of the name ``out`` is replaced.
    """

    def run(column: pa.Array) -> Iterator[list[pa.Array]]:
        for at in range(0, len(column), 64):
            yield [pa.array(_decoded(column.slice(at, 64), model), pa.string())]

    return _with_columns(df, ids, {out: T.StringType()}, False, run)
