"""Repeated passages: MinHash banding of paragraphs, exact Jaccard, components.

A passage is a run of ``least_words`` words or more that two documents share,
anywhere in their lines. Two kinds of paragraphs find passages:

- Lines of ``least_words`` words or more. The minima of several hashes over a
  line's five-word shingles are its bands; distinct lines that meet in a band are
  compared by the exact Jaccard similarity of their shingles, so edited copies
  are found as well as equal ones.
- Runs of ``run`` words. Every window of ``least_words`` words gives its MinHash
  over runs: the run with the least hash (one band of one row). Windows that lie
  side by side mostly have the same one, which is kept once. Equal windows have
  equal minima, so a passage of ``least_words`` words shares a run wherever it
  stands: none is lost. Runs are short, so they link only if they are equal.

1. Each text gives its paragraphs: place, a hash of the words, and a line's bands.
2. Distinct lines meet in the buckets of their bands. A bucket above ``cell_rows``
   is cut into blocks, each pair of blocks a cell of its own. A cell returns a
   spanning forest of its links, not all pairs; their components, and else
   equal contents, are the groups. Groups found in two or more documents go on.
3. Neighbouring paragraphs of a document that go on form a chain. A chain of
   ``least_words`` words counts. In a shorter one a run counts if it stands in
   ``least_words`` words that another document has word by word: a heading or a
   licence line that many documents share is left alone.
4. A paragraph stays in the document with the least id of its group and is marked
   for removal elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelflight.llm.common import discard, join_per_key, materialise
from shelflight.llm.components import connected_components


@dataclass(frozen=True)
class Bands:
    """Sizes of passages and paragraphs, MinHash bands and the similarity that links two lines.

    At a Jaccard similarity of 0.8, ``bands`` of ``rows`` minima meet in one
    bucket at least with probability 1 - (1 - 0.8^rows)^bands: 0.992 here.
    """

    least_words: int = 23  # of a passage: 25 words with an edit at either end
    run: int = 8  # words; at most least_words
    shingle: int = 5
    rows: int = 1
    bands: int = 3
    similarity: float = 0.8
    cell_rows: int = 1 << 12
    few_rows: int = 16  # of a cell whose pairs are all counted
    cell_bytes: int = 1 << 18  # lines of whole cells that are compared in one go
    most_gap: int = 4  # words between neighbours of one chain: room for an edit
    slice_bytes: int = 1 << 18  # texts that are worked on in one go


BANDS = Bands()
_ODD = np.random.default_rng(20240229).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = ~np.uint64(0)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of each value."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _sliding(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The best (np.minimum or np.maximum) of each ``width`` values side by side."""
    out, done = values, 1
    while done < width:  # windows double
        step = min(done, width - done)
        out = best(out[:-step], out[step:])
        done += step
    return out


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(7).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RATIO = 0x9E3779B97F4A7C15


class Powers:
    """Powers of an odd ratio modulo 2^64 and their inverses, as far as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << n.bit_length()
            ratios = np.full(size, _RATIO, np.uint64), np.full(size, pow(_RATIO, -1, 1 << 64), np.uint64)
            for r in ratios:
                r[0] = 1
            self.up, self.down = (np.cumprod(r) for r in ratios)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def word_hashes(content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each word of UTF-8 bytes, and a hash of its bytes.

    A word's hash is its part of one running sum over the text, scaled back to
    the word's first byte: equal words have equal hashes wherever they stand.
    """
    inside = np.zeros(len(content) + 2, bool)
    np.logical_not(_SPACES[content], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _POWERS.upto(len(content))
    sums = np.zeros(len(content) + 1, np.uint64)
    np.cumsum(_BYTES[content] * up, out=sums[1:])
    return starts, ends, _mix((sums[ends] - sums[starts]) * down[starts])


def _sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums over hashed words, and the factors that scale a difference back to its first word."""
    up, down = _POWERS.upto(len(h) + 1)
    return np.concatenate(([np.uint64(0)], np.cumsum(h * up[:-1]))), down


def _run_places(runs: np.ndarray, owner: np.ndarray, bands: Bands) -> np.ndarray:
    """Places of the runs that are the least of a window of ``least_words`` words of one text.

    Of equal runs side by side (one word, many times) only the first takes part.
    """
    width = bands.least_words - bands.run + 1
    runs = runs.copy()
    runs[1:][(runs[1:] == runs[:-1]) & (owner[1 : len(runs)] == owner[: len(runs) - 1])] = _NONE
    least = _sliding(np.minimum, runs, width)
    whole = owner[: len(least)] == owner[bands.least_words - 1 :]  # first and last word are of one text
    least = np.where(whole & (least != _NONE), least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    # the greatest of the minima of all windows that a run stands in is the run itself, if it is one of them
    return np.flatnonzero(_sliding(np.maximum, np.concatenate([pad, least, pad]), width) == runs)


def paragraphs(h: np.ndarray, owner: np.ndarray, line: np.ndarray, bands: Bands = BANDS) -> tuple[np.ndarray, ...]:
    """First word, end word and content hash of each paragraph, and the band keys of the lines among them, which come last.

    ``h`` are hashed words of several texts in a row, ``owner`` and ``line``
    the numbers of each word's text and line, which grow from word to word.
    """
    n, k = len(h), bands.run
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, bands.bands), np.uint64)
    if n < bands.least_words:
        return empty
    sums, down = _sums(h)
    runs = _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    at = _run_places(runs, owner, bands)
    edges = np.flatnonzero(line[1:] != line[:-1]) + 1
    starts, ends = np.concatenate(([0], edges)), np.append(edges, n)
    long = ends - starts >= bands.least_words
    starts, ends = starts[long], ends[long]
    keys = np.zeros((len(starts), bands.bands), np.uint64)
    if len(starts):
        width = bands.shingle
        shingles = _mix((sums[width:] - sums[:-width]) * down[: n - width + 1])
        # minima over the shingles inside each line: every other slice of reduceat
        cuts = np.stack([starts, ends - width + 1], axis=1).ravel()
        if cuts[-1] == len(shingles):
            cuts = cuts[:-1]
        for b in range(bands.bands):
            key = np.full(len(starts), np.uint64(b), np.uint64)
            for r in range(bands.rows):
                minima = np.minimum.reduceat(shingles * _ODD[b * bands.rows + r], cuts)[::2]
                key = _mix(key * np.uint64(_RATIO) + minima)
            keys[:, b] = key
    return (
        np.concatenate([at, starts]),
        np.concatenate([at + k, ends]),
        np.concatenate([runs[at], _mix((sums[ends] - sums[starts]) * down[starts])]),
        keys,
    )


def _lowered(text: str) -> tuple[bytes, bytes]:
    """The UTF-8 bytes of a text, and as many bytes of it in lower case."""
    plain = text.encode()
    lower = text.lower().encode()
    if len(lower) != len(plain):  # a few letters change their size: then only A to Z are lowered
        lower = plain.lower()
    return plain, lower


def text_paragraphs(texts: list[str], bands: Bands = BANDS) -> tuple[np.ndarray, ...]:
    """Text number, first and end word, first and end character, content and band keys of the paragraphs of texts."""
    plain, lower = zip(*map(_lowered, texts))
    content = np.frombuffer(b"\n".join(lower), np.uint8)
    begins = np.cumsum([0, *(len(p) + 1 for p in plain[:-1])])
    first, end, h = word_hashes(content)
    owner = np.searchsorted(begins, first, "right") - 1
    lines = np.cumsum(content == 10)
    starts, ends, contents, keys = paragraphs(h, owner, lines[first] if len(first) else first, bands)
    if not len(starts):
        return owner[:0], starts, ends, starts, ends, contents, keys
    own = owner[starts]
    heads = np.frombuffer(b"\n".join(plain), np.uint8) & 0xC0 != 0x80
    chars = np.concatenate(([0], np.cumsum(heads)))
    words = np.searchsorted(first, begins)  # each text's first word
    begin = chars[begins][own]
    return own, starts - words[own], ends - words[own], chars[first[starts]] - begin, chars[end[ends - 1]] - begin, contents, keys


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """A column's texts, some at a time: as many as ``most`` bytes hold, one at least."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        text = t.as_py()
        held.append(text)
        size += len(text)
        if size >= most:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def paragraph_rows(df: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """(doc, doc_id, words, chars, content, band0, ...): the paragraphs of each text.

    ``df`` has longs doc and doc_id and no null text. words and chars hold the
    first and the end place in their upper and lower 32 bits. Bands are null for
    runs.
    """
    names = [f"band{b}" for b in range(bands.bands)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column(2), bands.slice_bytes):
                own, w0, w1, c0, c1, contents, keys = text_paragraphs(texts, bands)
                if len(own):
                    rows = pa.array(own + at)
                    no_bands = pa.nulls(len(own) - len(keys), pa.int64())
                    columns = [pa.array(np.ascontiguousarray(keys[:, b]).view(np.int64)) for b in range(bands.bands)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(rows),
                            batch.column(1).take(rows),
                            pa.array(w0 << 32 | w1),
                            pa.array(c0 << 32 | c1),
                            pa.array(contents.view(np.int64)),
                            *[pa.concat_arrays([no_bands, c]) for c in columns],
                        ],
                        names=["doc", "doc_id", "words", "chars", "content", *names],
                    )

    schema = ", ".join(f"{n} long" for n in ("doc", "doc_id", "words", "chars", "content", *names))
    return df.select("doc", "doc_id", "text").mapInArrow(run, schema)


def shingle_ids(texts: list[str], cell: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Id and row of each distinct shingle of each text, by id and then row.

    ``cell`` has the number of each text's cell; shingles of two cells have no id in common.
    """
    content = np.frombuffer("\n".join(texts).lower().encode(), np.uint8)
    first, _, h = word_hashes(content)
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.cumsum(content == 10)[first]
    sums, down = _sums(h)
    n = len(h) - width + 1
    inside = np.flatnonzero(owner[:n] == owner[width - 1 :])
    rows = owner[inside]
    keys = _mix(((sums[width:] - sums[:-width]) * down[:n])[inside] + cell[rows].astype(np.uint64) * _ODD[0])
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    other = np.append(True, keys[1:] != keys[:-1])
    once = other | np.append(True, rows[1:] != rows[:-1])
    return (np.cumsum(other) - 1)[once], rows[once]


def _near_pairs(ids: np.ndarray, rows: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows that reach the similarity, from the ids they share: for ids that few rows have."""
    one, two, lag = [rows[:0]], [rows[:0]], 1
    while len(same := np.flatnonzero(ids[lag:] == ids[:-lag])):
        one.append(rows[same])
        two.append(rows[same + lag])
        lag += 1
    pairs, shared = np.unique(np.concatenate(one) * len(sizes) + np.concatenate(two), return_counts=True)
    a, b = np.divmod(pairs, len(sizes))
    near = shared >= similarity * (sizes[a] + sizes[b] - shared)
    return a[near], b[near]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of some links that connect what all of them connect."""
    above: dict[int, int] = {}

    def top(i: int) -> int:
        while (up := above.get(i, i)) != i:
            above[i] = i = above.get(up, up)
        return i

    links = []
    for i, j in zip(a.tolist(), b.tolist()):
        if (x := top(i)) != (y := top(j)):
            above[x] = y
            links.append((i, j))
    return links


def _reaching_links(ids: np.ndarray, rows: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of rows that connect what the links at ``similarity`` connect; ``ids`` of each row, ``sizes`` how many it has.

    Two sets at a Jaccard similarity of s share one of their first n - ceil(s n) + 1
    members in any common order, so only sets that share one of those, the rarest
    first, are compared (prefix filtering: nothing is lost). Breadth first: a set
    that has been reached is not compared again as a target.
    """
    if not len(ids):
        return []
    often = np.bincount(ids)
    own = ids[np.lexsort((ids, often[ids], rows))]  # of row after row, the rarest first
    row, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    first = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    ahead = (np.arange(len(own)) - starts[row] < first[row]) & (often[own] > 1)
    prefixes = np.split(own[ahead], np.cumsum(np.bincount(row[ahead], minlength=len(sizes)))[:-1])
    by_id = np.argsort(own[ahead], kind="stable")
    names, at = np.unique(own[ahead][by_id], return_index=True)
    holders = dict(zip(names.tolist(), np.split(row[ahead][by_id], at[1:])))
    links, reached, mine = [], np.zeros(len(sizes), bool), np.zeros(len(often), np.uint8)
    for start in range(len(sizes)):
        frontier = [] if reached[start] else [start]
        reached[start] = True
        while frontier:
            i = frontier.pop()
            met = [sizes[:0]]
            for s in prefixes[i].tolist():
                holders[s] = holders[s][~reached[holders[s]]]
                met.append(holders[s])
            others = np.unique(np.concatenate(met))
            n = sizes[others]
            alike = np.minimum(n, sizes[i]) >= similarity * np.maximum(n, sizes[i])
            others, n = others[alike], n[alike]
            if not len(others):
                continue
            own_ids = own[starts[i] : starts[i] + sizes[i]]
            mine[own_ids] = 1
            ends = np.cumsum(n)
            members = own[np.arange(ends[-1]) + np.repeat(starts[others] - ends + n, n)]
            shared = np.add.reduceat(mine[members], ends - n, dtype=np.int64)
            mine[own_ids] = 0
            near = others[shared >= similarity * (sizes[i] + n - shared)]
            reached[near] = True
            links += [(i, j) for j in near.tolist()]
            frontier += near.tolist()
    return links


def spanning_links(sets: list[frozenset], similarity: float) -> list[tuple[int, int]]:
    """Index pairs that connect what the links at ``similarity`` connect."""
    number = {s: n for n, s in enumerate(sorted({s for own in sets for s in own}))}
    sizes = np.array([len(own) for own in sets], np.int64)
    ids = np.array([number[s] for own in sets for s in own], np.int64)
    return _reaching_links(ids, np.repeat(np.arange(len(sets)), sizes), sizes, similarity)


def cell_links(cells: np.ndarray, texts: list[str], bands: Bands = BANDS) -> list[tuple[int, int]]:
    """Pairs of texts that connect what the links at ``bands.similarity`` inside each cell connect; a cell's texts lie together."""
    starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    counts = np.diff(np.append(starts, len(cells)))
    ids, rows = shingle_ids(texts, np.repeat(np.arange(len(starts)), counts), bands.shingle)
    sizes = np.bincount(rows, minlength=len(cells))
    few = np.repeat(counts <= bands.few_rows, counts)[rows]
    links = _forest(*_near_pairs(ids[few], rows[few], sizes, bands.similarity))
    for start, n in zip(starts.tolist(), counts.tolist()):
        if n > bands.few_rows:
            inside = np.flatnonzero((rows >= start) & (rows < start + n))
            local = np.unique(ids[inside], return_inverse=True)[1]
            found = _reaching_links(local, rows[inside] - start, sizes[start : start + n], bands.similarity)
            links += [(start + i, start + j) for i, j in found]
    return links


def _whole_cells(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of whole cells, as many cells at a time as ``most`` bytes of words hold, one at least."""

    def parts(held: list[pa.RecordBatch]) -> Iterator[pa.Table]:
        table = pa.Table.from_batches(held)
        cells = table.column(0).to_numpy()
        size = np.cumsum(pc.binary_length(table.column(2)).to_numpy())
        starts = np.append(np.flatnonzero(np.append(True, cells[1:] != cells[:-1])), len(cells))
        at = 0
        while at < len(cells):
            before = size[at - 1] if at else 0
            fits = np.searchsorted(size, before + most, "right")
            end = max(starts[np.searchsorted(starts, fits, "right") - 1], starts[np.searchsorted(starts, at, "right")])
            yield table.slice(at, end - at)
            at = end

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(0).to_numpy()
        changes = np.flatnonzero(cells[1:] != cells[:-1]) + 1
        if held and held[-1].column(0)[-1].as_py() != cells[0]:
            yield from parts(held)
            held = []
        if len(changes):
            yield from parts([*held, batch.slice(0, changes[-1])])
            held = []
            batch = batch.slice(changes[-1])
        held.append(batch)
    if held:
        yield from parts(held)


def _linker(bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_cells(batches, bands.cell_bytes):
            links = cell_links(part.column(0).to_numpy(), part.column(2).to_pylist(), bands)
            if links:
                content = part.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(content[list(x)]) for x in zip(*links)], names=["a", "b"])

    return run


def runs_around(texts: list[str], owner: np.ndarray, places: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Index into ``places`` and hash of every run of ``words`` words that holds the paragraph at the place.

    ``owner`` has the number of each place's text. A place has the first word in its
    upper, the end word in its lower 32 bits. Of a paragraph of more words the runs
    inside it are taken.
    """
    lower = [_lowered(t)[1] for t in texts]
    begins = np.cumsum([0, *(len(t) + 1 for t in lower)])
    first, _, h = word_hashes(np.frombuffer(b"\n".join(lower), np.uint8))
    if len(h) < words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums, down = _sums(h)
    runs = _mix((sums[words:] - sums[:-words]) * down[: len(h) - words + 1])
    edges = np.searchsorted(first, begins)  # each text's first word
    last = np.diff(edges)[owner] - words  # first word of a text's last run, below 0 if it has none
    starts, ends = places >> 32, places & 0xFFFFFFFF
    low = np.maximum(np.minimum(starts, ends - words), 0)
    high = np.minimum(np.maximum(starts, ends - words), last)
    count = np.maximum(high - low + 1, 0)
    place = np.repeat(np.arange(len(places)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(edges[:-1][owner] + low, count)
    return place, runs[at]


def in_repeated_runs(texts: DataFrame, spots: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """(doc, place) of ``spots`` in a run of ``least_words`` words that another document holds at one of its spots.

    ``texts`` has doc, doc_id and text, ``spots`` doc and place. Runs meet by their
    hash, so a paragraph that many documents hold costs no pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column(2), bands.slice_bytes):
                asked = batch.column(3).slice(at, len(texts))
                owner = pc.list_parent_indices(asked).to_numpy()
                place, runs = runs_around(texts, owner, asked.flatten().to_numpy(), bands.least_words)
                if len(place):
                    rows = pa.array(owner[place] + at)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), asked.flatten().take(pa.array(place)), pa.array(runs.view(np.int64))],
                        names=["doc", "doc_id", "place", "run"],
                    )

    used: list[str] = []
    # written, so that their true size decides how they meet the texts
    places = materialise(spots.groupBy("doc").agg(F.collect_set("place").alias("places")), "run-places", used)
    runs = texts.join(places, "doc").select("doc", "doc_id", "text", "places")
    runs = materialise(runs.mapInArrow(run, "doc long, doc_id long, place long, run long"), "runs", used)
    ends = runs.groupBy("run").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = materialise(ends.where("least < most").select("run"), "shared-runs", used)
    found = materialise(runs.join(shared, "run", "left_semi").select("doc", "place").distinct(), "spots-in-runs")
    discard(texts.sparkSession, used)
    return found


def _first(packed: str):
    return F.shiftrightunsigned(F.col(packed), 32)


def _end(packed: str):
    return F.col(packed).bitwiseAND(F.lit(0xFFFFFFFF))


def line_groups(rows: DataFrame, texts: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """(content, root, n) of lines that are near another content: the least content of the component, and how many rows there are."""
    spark, used = rows.sparkSession, []
    keys = [f"band{b}" for b in range(bands.bands)]
    lines = rows.where("band0 is not null").groupBy("content").agg(
        F.min(F.struct("doc", "chars")).alias("place"), F.count("*").alias("n"), *[F.min(k).alias(k) for k in keys]
    )
    lines = materialise(lines, "lines", used)
    met = lines.select("content", F.explode(F.array(*keys)).alias("key"))
    sizes = materialise(met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "band-sizes", used)
    cells = (
        join_per_key(met, sizes, "key")
        .withColumn("blocks", F.ceil(F.col("n") / F.lit(bands.cell_rows)).cast("long"))
        .withColumn("own", F.pmod(F.xxhash64("content"), F.col("blocks")))
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "content")
    )
    cells = materialise(cells, "cells", used)
    wanted = lines.join(cells.select("content").distinct().hint("merge"), "content", "left_semi")
    wanted = materialise(wanted.select("content", "place.*"), "cell-lines", used)
    cut = F.substring(F.col("text"), _first("chars").cast("int") + F.lit(1), (_end("chars") - _first("chars")).cast("int"))
    # no hint: a written table has a true size, and a small one is sent to all tasks
    words = texts.join(wanted, "doc").select("content", F.lower(F.regexp_replace(cut, r"[\x20\x09-\x0D]+", " ")).alias("words"))
    words = materialise(words.dropDuplicates(["content"]), "line-words", used)
    links = (
        cells.join(words.hint("merge"), "content")
        .repartition("cell")
        .sortWithinPartitions("cell")
        .select("cell", "content", "words")
        .mapInArrow(_linker(bands), "a long, b long")
    )
    groups = connected_components(links, "a", "b").withColumnRenamed("node", "content")
    groups = materialise(groups.join(lines.select("content", "n").hint("merge"), "content"), "line-groups")
    discard(spark, used)
    return groups


def repeated_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: Bands = BANDS) -> DataFrame:
    """(doc_id, passage_id, first_char, end_char, n_documents, kept_in, removed).

    One row per paragraph (line or run) of a group that occurs in two or more
    documents, where it is part of a passage of ``least_words`` words. passage_id
    names the group, n_documents counts the documents that have rows of it,
    kept_in is the least doc_id among them, and removed is true in all others.
    Characters count from 0; runs of one passage overlap. Words are compared in
    lower case. Null and empty texts, and texts of fewer than ``least_words``
    words, have no passages. Rows without a doc_id cannot be named and are left
    out; rows that repeat a doc_id are one document, and exactly repeated rows
    are reported once. Repeats inside a single document are no repeated passage.
    An empty table gives no rows. Other columns are ignored.
    """
    texts = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    texts = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    texts = texts.withColumn("doc", F.xxhash64("doc_id", "text"))
    spark, used = df.sparkSession, []
    rows = materialise(paragraph_rows(texts, bands), "paragraphs", used)

    ends = [F.min("doc_id").alias("least"), F.max("doc_id").alias("most")]
    groups = line_groups(rows, texts, bands)
    near = join_per_key(rows.where("band0 is not null"), groups, "content").groupBy("root").agg(*ends).where("least < most")
    near = groups.join(near.hint("merge"), "root").select("content", F.col("root").alias("passage_id"), "n")
    equal = rows.groupBy("content").agg(*ends, F.count("*").alias("n")).where("least < most")
    equal = equal.join(groups.hint("merge"), "content", "left_anti").select("content", F.col("content").alias("passage_id"), "n")
    passages = materialise(equal.unionByName(near), "passage-contents", used)
    hits = join_per_key(rows, passages, "content").select("doc", "doc_id", "passage_id", "words", "chars")
    # rows of the table that repeat exactly: a key of one long is counted, and only their paragraphs made distinct
    again = materialise(texts.groupBy("doc").count().where("count > 1").select("doc"), "repeated-rows", used)
    if not again.isEmpty():
        hits = materialise(hits, "hits", used)
        twice = hits.join(again.hint("merge"), "doc", "left_semi").distinct()
        hits = hits.join(again.hint("merge"), "doc", "left_anti").unionByName(twice)

    in_order = Window.partitionBy("doc").orderBy("words")
    before = F.max(_end("words")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(_first("words") - before > F.lit(bands.most_gap), F.lit(True))
    chained = hits.withColumn("apart", apart.cast("int")).withColumn("chain", F.sum("apart").over(in_order))
    chain = Window.partitionBy("doc", "chain")
    length = F.max(_end("words")).over(chain) - F.min(_first("words")).over(chain)
    chained = chained.withColumn("long", length >= F.lit(bands.least_words)).drop("apart", "chain")
    done, used = used, []
    chained = materialise(chained, "chains", used)
    discard(spark, done)
    long, short = chained.where("long"), chained.where("not long")
    # a run of a short chain may stand in a long passage all the same: its group is looked at in every document
    short_groups = materialise(short.select("passage_id").distinct(), "short-groups", used)
    asked = chained.join(short_groups, "passage_id", "left_semi").select("doc", F.col("words").alias("place"))
    found = materialise(in_repeated_runs(texts, asked, bands).withColumnRenamed("place", "words"), "in-runs", used)
    kept = long.unionByName(short.join(found, ["doc", "words"], "left_semi"))
    kept = materialise(kept.select("doc_id", "passage_id", "chars"), "kept")
    discard(spark, used)

    members = kept.groupBy("passage_id", "doc_id").agg(F.count("*").alias("n"))
    named = members.groupBy("passage_id").agg(
        F.count("*").alias("n_documents"), F.min("doc_id").alias("kept_in"), F.sum("n").alias("n")
    )
    named = materialise(named.where("n_documents > 1"), "passage-groups")
    return join_per_key(kept, named, "passage_id").select(
        "doc_id",
        "passage_id",
        _first("chars").alias("first_char"),
        _end("chars").alias("end_char"),
        "n_documents",
        "kept_in",
        (F.col("doc_id") != F.col("kept_in")).alias("removed"),
    )
