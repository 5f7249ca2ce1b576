"""Distinct-chunk tables: segment each distinct chunk of text once, join ids back by position.

A tokenizer whose pieces never cross a cut gives the same ids for a text as for
its chunks one after another. Chunks repeat far more often than texts, so each
Python worker keeps a table of the chunks it has segmented: chunk -> row, and
the ids of all rows in one flat array. A text becomes an array of row numbers,
and its ids are one gather from the flat array. The table is bounded: above
``max_chunks`` rows or ``max_ids`` ids it forgets chunks that came once, or all,
which changes speed only.

Texts whose white space is even are cut and their chunks made distinct by Arrow,
a slice of texts at a time; only distinct chunks are looked up in Python. Other
texts are cut one by one, with the same result.

New chunks are segmented many at a time, joined by single spaces; an id whose
piece begins with the space (or its mark) begins a chunk. Where the numbers of
chunks and of such ids differ, the chunks are segmented one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A chunk with its leading space taken off, or a chunk that has none as a 1-tuple.
Key = str | tuple[str]

#: White space other than single spaces and line ends between two non-space characters.
_UNEVEN = re.compile(r"\s\s|[^\S \n]|^\s|\s$")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def chunks_by_space(text: str) -> list[Key]:
    """Chunks cut before each single space between two other characters."""
    if text[0] == " " or text[-1] == " " or "  " in text:
        head, *rest = _CUT.split(text)
        return [(head,), *[c[1:] for c in rest]]
    head, *rest = text.split(" ")
    return [(head,), *rest]


def chunks_by_line(text: str) -> list[Key]:
    """As ``chunks_by_space``, and cut before and behind single line ends, where white space is even."""
    if _UNEVEN.search(text):
        head, *rest = _CUT.split(text)
        return [(head,), *[c[1:] for c in rest]]
    keys: list[Key] = []
    for line in text.split("\n"):
        words: list[Key] = line.split(" ")
        words[0] = (words[0],)
        keys += words
        keys.append(("\n",))
    keys.pop()
    return keys


#: Put before a text's first chunk, which has no space of its own; texts that hold it are cut one by one.
HEAD = "\x02"
_WIDE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Spaces at an end of the text or beside other white space.
_ODD_SPACES = f"^ | $|{_WIDE} | {_WIDE}|{HEAD}"


#: Latin letters and digits, and ASCII marks: no version of Unicode counts any of them as the other.
_WORD = r"0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
_MARK = r"!-/:-@\[-`{-~"


def cuts_at_marks(whole: Sequence[str]) -> Callable[[pa.Array], pa.Array]:
    """Further cuts for byte-level pieces, which join no letter or digit with a mark or line end behind it.

    Single line ends are cut off on both sides. Chunks that hold one of the texts of ``whole`` stay as they are.
    """

    def finer(chunks: pa.Array) -> pa.Array:
        cut = pc.replace_substring_regex(chunks, f"([{_WORD}])([{_MARK}\\n])", f"\\1 {HEAD}\\2")
        cut = pc.replace_substring_regex(cut, f"([{_WORD}{_MARK}])\\n([{_WORD}{_MARK}])", f"\\1 {HEAD}\n {HEAD}\\2")
        for text in whole:
            cut = pc.if_else(pc.match_substring(chunks, text), chunks, cut)
        return cut

    return finer


def _taken(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of an array one after another, and where the first ``ends`` of them end."""
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    return flat[np.arange(total) + np.repeat(starts - (stops - sizes), sizes)], np.concatenate(([0], stops))[np.asarray(ends, np.int64)]


class ChunkTable:
    """Ids of texts by way of their distinct chunks.

    ``segment`` gives the ids of each of a list of texts; ``begins`` is true for
    the ids whose piece begins with a space; ``cut`` gives the chunks of a text.
    With ``marked`` every text counts as if it began with a space. ``finer`` may
    put further cuts, a space and ``HEAD`` each, into an array of distinct chunks.
    """

    def __init__(
        self,
        segment: Callable[[list[str]], Sequence[Sequence[int]]],
        begins: np.ndarray,
        cut: Callable[[str], list[Key]],
        group: int = 128,
        max_chunks: int = 200_000,
        max_ids: int = 2_000_000,
        marked: bool = False,
        finer: Callable[[pa.Array], pa.Array] | None = None,
    ):
        self.segment, self.begins, self.cut, self.group, self.marked = segment, begins, cut, group, marked
        self.finer = finer
        self.max_chunks, self.max_ids = max_chunks, max_ids
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[Key, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.uses = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _make_room(self) -> None:
        """Forget the chunks that came once; all of them where most came more often."""
        n = len(self.rows)
        often = np.flatnonzero(self.uses[:n] > 1)
        keys = list(self.rows)
        sizes, starts, flat = self.sizes[often], self.starts[often], self.flat
        self._clear()
        if 2 * len(often) <= self.max_chunks and 2 * int(sizes.sum()) <= self.max_ids:
            stops = np.cumsum(sizes)
            ids = flat[np.arange(int(sizes.sum())) + np.repeat(starts - (stops - sizes), sizes)]
            self._append([keys[i] for i in often.tolist()], ids, sizes)

    def _append(self, keys: list[Key], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, end = len(self.rows), len(self.rows) + len(keys)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while end > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[first:end] = sizes
        self.starts[first:end] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.rows.update(zip(keys, range(first, end)))

    def _add(self, new: list[Key]) -> None:
        odd = [c for c in new if not c or isinstance(c, tuple)]
        plain = [c for c in new if c and not isinstance(c, tuple)] if odd else new
        groups = [plain[at : at + self.group] for at in range(0, len(plain), self.group)]
        for own, found in zip(groups, self.segment([" " + " ".join(g) for g in groups])):
            ids = np.asarray(found, np.int32)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(own) and starts[0] == 0:
                self._append(own, ids, np.diff(np.append(starts, len(ids))))
            else:
                odd += own
        if odd:
            found = self.segment([c[0] if isinstance(c, tuple) else f" {c}" for c in odd])
            ids = np.fromiter((i for ids in found for i in ids), np.int32)
            self._append(odd, ids, np.fromiter(map(len, found), np.int64, len(found)))

    def _rows(self, keys: list[Key]) -> np.ndarray:
        """The row of each key; new keys are added."""
        rows = list(map(self.rows.get, keys))
        if missing := [i for i, r in enumerate(rows) if r is None]:
            self._add(list(dict.fromkeys(keys[i] for i in missing)))
            for i in missing:
                rows[i] = self.rows[keys[i]]
        return np.asarray(rows, np.int64)

    def _gather(self, at: np.ndarray, ends: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows one after another, and where those of the first ``ends`` rows end; a row counts as used ``times``."""
        self.uses[: len(self.rows)] += np.bincount(at, times, len(self.rows)).astype(np.int64)
        return _taken(self.flat, self.starts[at], self.sizes[at], ends)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the end of each text in it."""
        if len(self.rows) > self.max_chunks or self.used > self.max_ids:
            self._make_room()
        keys: list[Key] = []
        ends = []
        for text in texts:
            if text:
                keys += self.cut(text)
            ends.append(len(keys))
        return self._gather(self._rows(keys), np.asarray(ends))

    def _encode_even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for texts whose every space is a cut."""
        if len(self.rows) > self.max_chunks or self.used > self.max_ids:
            self._make_room()
        if not self.marked:
            texts = pc.binary_join_element_wise(pa.scalar(HEAD), texts, pa.scalar(""))
        chunks = pc.split_pattern(texts, " ")
        ends = np.cumsum(pc.list_value_length(chunks).to_numpy())
        distinct = chunks.flatten().dictionary_encode()
        at = distinct.indices.to_numpy()
        if self.finer is None:
            return self._gather(self._rows(self._keys(distinct.dictionary))[at], ends)
        # the ids of each distinct chunk by its own parts, then those of the texts by their chunks
        parts = pc.split_pattern(self.finer(distinct.dictionary), " ")
        counts = pc.list_value_length(parts).to_numpy()
        pieces = parts.flatten().dictionary_encode()
        rows = self._rows(self._keys(pieces.dictionary))[pieces.indices.to_numpy()]
        times = np.repeat(np.bincount(at, minlength=len(counts)), counts)
        ids, stops = self._gather(rows, np.cumsum(counts), times)
        sizes = np.diff(stops, prepend=0)
        return _taken(ids, (stops - sizes)[at], sizes[at], ends)

    def _keys(self, chunks: pa.Array) -> list[Key]:
        keys: list[Key] = chunks.to_numpy(zero_copy_only=False).tolist()
        return keys if self.marked else [(k[1:],) if k[:1] == HEAD else k for k in keys]

    def encode_column(self, column: pa.Array, most_chars: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of texts, their ids, the ends) for slices of a column of texts; null counts as empty."""
        column = pc.fill_null(column.cast(pa.string()), "")
        if not len(column):
            return
        odd = pc.match_substring_regex(column, _ODD_SPACES).to_numpy(zero_copy_only=False)
        size = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64) + 1)
        first = 0
        while first < len(column):
            # up to the next text of the other kind, and of bounded size
            other = np.flatnonzero(odd[first:] != odd[first])
            last = first + int(other[0]) if len(other) else len(column)
            before = int(size[first - 1]) if first else 0
            last = max(first + 1, min(last, int(np.searchsorted(size, before + most_chars, "right"))))
            part = column.slice(first, last - first)
            yield last - first, *(self.encode(part.to_pylist()) if odd[first] else self._encode_even(part))
            first = last


def slices(texts: Sequence[str], most_chars: int = 1 << 20):
    """(first, last) ranges of ``texts`` of bounded size; one text at least."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most_chars:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)
