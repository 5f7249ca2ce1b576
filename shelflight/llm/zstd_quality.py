"""Quality score from two zstandard dictionaries.

One dictionary is trained on texts labelled good, one on texts labelled bad. A
text is cut into pieces and each piece is compressed with both; text that looks
like the good class comes out smaller with the good dictionary. The difference
of the two sums over the text's size is the only feature; logistic regression on
labelled texts that the dictionaries have not seen turns it into a probability.

Fitting uses a bounded sample of the labelled rows: ``Sample`` has the bounds.
Texts of any length take part: only pieces of those for the dictionaries, and
one number of each of the others, reach the driver. Scoring reads every whole
text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import materialise


@dataclass(frozen=True)
class Sample:
    """Bounds of the labelled sample and of the dictionaries fitted on it."""

    rows: int = 1500  # of each class, those with the least hashes of their doc_id
    pieces: int = 6000  # of each class's texts for its dictionary, those with the least hashes
    dictionary_bytes: int = 32 << 10
    piece: int = 800  # bytes
    level: int = 3


SAMPLE = Sample()
#: Added to a text's size, so that an empty text has a feature too.
BASE = 40


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no fit may see: crc32 of the doc_id as text leaves 2 modulo 4. A null doc_id counts as ''."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _pieces(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


def _dictionary(pieces: list[bytes], sample: Sample) -> bytes:
    try:
        return zstandard.train_dictionary(sample.dictionary_bytes, pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples: their text itself
        return b"".join(pieces)[-sample.dictionary_bytes :]


@dataclass
class Model:
    """Dictionaries and calibration; small, and sent with the tasks."""

    good: bytes
    bad: bytes
    sample: Sample
    weights: tuple[float, float] = (0.0, 0.0)  # constant and slope of the log odds

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pair": None}

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if self._pair is None:
            self._pair = []
            for content in (self.good, self.bad):
                own = zstandard.ZstdCompressionDict(content)
                own.precompute_compress(level=self.sample.level)
                self._pair.append(
                    zstandard.ZstdCompressor(
                        level=self.sample.level, dict_data=own, write_content_size=False, write_dict_id=False
                    )
                )
        return self._pair

    def difference(self, text: str | None) -> float:
        """Compressed size with the bad dictionary less that with the good one, over the text's size."""
        content, total = (text or "").encode(), 0
        good, bad = (c.compress for c in self._compressors())
        for piece in _pieces(content, self.sample.piece):
            total += len(bad(piece)) - len(good(piece))
        return total / (len(content) + BASE)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of the good class for each text."""
        constant, slope = self.weights
        if not slope:  # fitted on one class or none: the prior
            return np.full(len(texts), 1 / (1 + np.exp(-constant)))
        z = constant + slope * np.array([self.difference(t) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Constant and slope of a slightly regularised fit by Newton steps."""
    mean, spread = x.mean(), x.std() + 1e-9
    rows = np.c_[np.ones(len(x)), (x - mean) / spread]
    w, ridge = np.zeros(2), 1e-2
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        hessian = (rows * (p * (1 - p) + 1e-6)[:, None]).T @ rows + ridge * np.eye(2)
        w += np.linalg.solve(hessian, rows.T @ (y - p) - ridge * w)
    return float(w[0] - w[1] * mean / spread), float(w[1] / spread)


def _sampled_pieces(texts: DataFrame, sample: Sample) -> list[bytes]:
    """Pieces of whole texts (turn, text), those with the least hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for turn, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                pieces = _pieces(text.as_py().encode(), sample.piece)
                turns = [xxhash.xxh64_intdigest(f"{turn} {i}") >> 1 for i in range(len(pieces))]
                yield pa.RecordBatch.from_arrays([pa.array(turns, pa.int64()), pa.array(pieces, pa.binary())], names=["turn", "piece"])

    found = texts.select("turn", "text").mapInArrow(run, "turn long, piece binary")
    return [bytes(r.piece) for r in found.orderBy("turn", "piece").limit(sample.pieces).collect()]


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = SAMPLE) -> Model:
    """A model from the labelled rows that are not held out.

    ``labels`` has doc_id and quality (1 good, 0 bad; other values and null are
    ignored, and so are ids labelled both ways). ``docs`` has doc_id and text;
    null texts are ignored. Two thirds of the sampled ids of each class are for
    its dictionary, one third for the calibration. Without texts of one class
    for either, every score is the share of the good class: 0.5 without labels.
    """
    marked = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .select("doc_id", "quality", F.xxhash64("doc_id").alias("turn"))
    )
    few = [marked.where(F.col("quality") == q).orderBy("turn", "doc_id").limit(sample.rows) for q in (1, 0)]
    # as many rows as the sample has: a bounded broadcast
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(few[0].unionByName(few[1])), "doc_id")
    texts = materialise(texts, "labelled")  # read three times
    calibrates = F.pmod("turn", F.lit(3)) == 0
    pieces = [_sampled_pieces(texts.where(~calibrates & (F.col("quality") == q)), sample) for q in (1, 0)]
    model = Model(*(_dictionary(p, sample) if p else b"" for p in pieces), sample)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.difference(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["quality", "x"])

    rest = texts.where(calibrates).select(F.col("quality").cast("int").alias("quality"), "text")
    held = rest.mapInArrow(differences, "quality int, x double").orderBy(F.xxhash64("x"), "quality").limit(2 * sample.rows).collect()
    y = np.array([r.quality for r in held], float)
    if not all(pieces) or len(set(y)) < 2:
        good = y.sum() + bool(pieces[0])
        share = good / (len(y) + bool(pieces[0]) + bool(pieces[1])) if len(y) or any(pieces) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        model.weights = (float(np.log(share / (1 - share))), 0.0)
    else:
        model.weights = _logistic(np.array([r.x for r in held]), y)
    return model


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep_text: bool = True) -> DataFrame:
    """``df`` with ``out``, the probability (0 to 1) that a text is good.

    Null and empty texts get the score of an empty text. Equal rows stay. A
    column of the name ``out`` is replaced.
    """
    kept = [f for f in df.schema.fields if f.name.lower() != out.lower() and (keep_text or f.name != text)]
    # by place: no name of a column clashes with the text's
    wanted = df.select(F.col(f"`{text}`").alias("text"), *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)])
    schema = df.select(*[F.col(f"`{f.name}`") for f in kept], F.lit(0.0).alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = model.scores(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found)], names=schema.names)

    return wanted.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7, sample: Sample = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score is ``least`` or more."""
    names = docs.columns
    scored = score(docs, fit(docs, labels, sample), out="__quality_score")
    return scored.where(F.col("__quality_score") >= least).select(*[F.col(f"`{n}`") for n in names])
