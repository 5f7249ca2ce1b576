"""Line-first cleaning of documents.

Every line of a text meets three kinds of rules: punctuation (prose ends in a
sentence mark and holds few symbols), navigation (lists of short items behind
separators, shouting capitals) and boilerplate (licence and rights notices,
consent and script notices, lines seen before in the text, lines that recur in
the corpus between ever different neighbours). Lines that fail are taken out,
and a document that loses too much of its words is rejected. The counters of the
base rules are taken over the whole text, before any removal.

A line recurs if many different texts hold it and most of them between other
lines, before it as well as behind: copies and near copies of a text repeat its
lines with their neighbours, which is no boilerplate. Lines are counted by hash
over all distinct texts.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SEPARATORS = re.compile(r"\s[|»›>/·•]\s")
#: Notices found on pages (plain text, lower case).
NOTICES = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "subscribe to our newsletter",
    "terms of use",
    "is licensed under",
    "licensed under the",
    "licensed under cc",
    "released under the",
)
_NOTICE = re.compile("|".join(map(re.escape, NOTICES)))


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the document's verdict."""

    symbol_share: float = 0.10  # symbols to characters of a line
    upper_share: float = 0.6  # capitals to letters of a line with min_letters
    min_letters: int = 20
    separators: int = 3  # spaced separators in a line of short items
    exclaimed_share: float = 0.3  # words ending in two sentence marks
    run_share: float = 0.5  # words equal to the word before
    open_words: int = 4  # a line of this many words and more ends in a sentence mark
    recurring_contexts: int = 10  # different neighbours that a recurring line has on one side at least
    recurring_share: float = 0.5  # different neighbours to texts, on both sides
    max_removed_share: float = 0.5  # of the document's words
    broadcast_lines: int = 1 << 20  # recurring lines that are sent to all tasks; more are joined


RULES = LineRules()
_DOUBLED = re.compile(r"[!?.]{2}$")
#: Sentence marks, and what may stand behind one (fixed values).
_ENDED = re.compile("[.!?:;…。！？：；][\"'”’»)\\]]*$")
_BLANKS = " \t\r\v\f"


def line_fault(line: str, words: list[str], rules: LineRules = RULES) -> str | None:
    """The first rule that a line with words fails: punctuation, navigation or boilerplate; None if it is prose."""
    n = len(words)
    if len(_SYMBOL.findall(line)) > rules.symbol_share * len(line):
        return "punctuation"
    if sum(1 for w in words if _DOUBLED.search(w)) > rules.exclaimed_share * n:
        return "punctuation"
    if n >= 10 and sum(a == b for a, b in zip(words, words[1:])) > rules.run_share * n:
        return "punctuation"
    if len(_SEPARATORS.findall(line)) >= rules.separators:
        return "navigation"
    upper = sum(map(str.isupper, line))
    if upper > rules.min_letters / 2:
        letters = sum(map(str.isalpha, line))
        if letters >= rules.min_letters and upper > rules.upper_share * letters:
            return "navigation"
    if _NOTICE.search(line.lower()):
        return "boilerplate"
    if n >= rules.open_words and not _ENDED.search(words[-1]):
        return "punctuation"
    return None


def line_hash(line: str) -> int:
    """What ``recurring_lines`` counts a line by: XXH64 (seed 42) of its trimmed text, as a signed number."""
    h = xxhash.xxh64_intdigest(line.strip(_BLANKS).encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def recurring_lines(df: DataFrame, text: str = "text", rules: LineRules = RULES) -> DataFrame:
    """(line): hashes of the lines that recur in the corpus. Null texts have none; equal texts count once."""
    lines = F.filter(F.transform(F.split(F.col(f"`{text}`"), "\n"), lambda x: F.btrim(x, F.lit(_BLANKS))), lambda x: x != "")
    hashes = F.transform(lines, lambda x: F.xxhash64(x))
    own = df.select(F.xxhash64(F.col(f"`{text}`")).alias("held"), hashes.alias("h"))
    place = lambda x, i: F.struct(x.alias("line"), F.get("h", i - 1).alias("before"), F.get("h", i + 1).alias("after"))
    places = own.select("held", F.explode(F.array_distinct(F.transform("h", place))).alias("p")).select("held", "p.*").distinct()
    counted = places.groupBy("line").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("before", "after") for n, f in (("kinds", F.count_distinct), ("all", F.count))]
    )

    def free(c: str) -> Column:
        """Whether what stands on one side of a line is mostly something else, or nothing at all."""
        return (F.col(f"all_{c}") == 0) | (F.col(f"kinds_{c}") >= F.col(f"all_{c}") * rules.recurring_share)

    often = F.greatest("kinds_before", "kinds_after") >= rules.recurring_contexts
    return counted.where(often & free("before") & free("after")).select("line")


def repeated_words(words: list[str], window: int = 8) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text.

    Windows are compared exactly: ranks of pairs double from one word to eight.
    """
    n = len(words)
    if n < window + 1:
        return 0
    seen: dict[str, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        _, rank = np.unique(rank[:-step] * np.int64(n) + rank[step:], return_inverse=True)
        width += step
    often = np.bincount(rank)[rank] >= 2
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.flatnonzero(often), 1)
    np.subtract.at(edges, np.flatnonzero(often) + window, 1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def review(text: str | None, rules: LineRules = RULES, recurring: Container[int] = ()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, words removed, cleaned text."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines, seen, dup, removed, clean = text.split("\n"), set(), 0, 0, []
    for line in lines:
        own = WORD.findall(line)
        if not own:
            clean.append(line)
            continue
        if line in seen:
            dup += 1
            fault = "boilerplate"
        else:
            seen.add(line)
            fault = line_fault(line, own, rules) or ("boilerplate" if recurring and line_hash(line) in recurring else None)
        if fault:
            removed += len(own)
        else:
            clean.append(line)
    repeats = repeated_words(words)
    base_failed = n < 20 or 100 * repeats > 30 * n
    kept = not base_failed and removed <= rules.max_removed_share * n
    symbols = sum(map(text.count, SYMBOLS))
    return n, sum(map(len, words)), symbols, dup, repeats, base_failed, kept, removed, "\n".join(clean)


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, removed_words long, cleaned string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def clean_lines(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rules: LineRules = RULES,
    with_text: bool = True,
    recurring: DataFrame | None = None,
) -> DataFrame:
    """One row per input row: doc_id, the counters, both verdicts, removed_words and the cleaned text.

    Null and empty texts have no words: they fail the base rules and are not
    kept. Repeated rows stay. An empty table gives no rows. Other columns are
    ignored. ``with_text=False`` leaves the column ``cleaned`` out.

    ``recurring`` has the lines that recur in a corpus (``recurring_lines``, kept as
    a table): then what a document loses depends on itself and on that table only,
    not on what else is cleaned with it. For None they are found among ``df``.
    """
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    n = len(COLUMNS) - (not with_text)
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(SCHEMA.split(", ")[:n])
    if recurring is None:
        recurring = recurring_lines(rows, "text", rules)
    recurring = materialise(recurring.select("line").distinct(), "recurring-lines")
    known: frozenset = frozenset()
    if recurring.count() <= rules.broadcast_lines:
        known = frozenset(r.line for r in recurring.collect())  # bounded by the count
        rows = rows.withColumn("recurring", F.lit(None).cast("array<long>"))
    else:  # each text's own recurring lines, joined by the text's hash
        lines = F.transform(F.split("text", "\n"), lambda x: F.xxhash64(F.btrim(x, F.lit(_BLANKS))))
        rows = rows.withColumn("held", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
        places = rows.select("held", F.explode(F.array_distinct(lines)).alias("line")).distinct()
        own = places.join(recurring.hint("merge"), "line").groupBy("held").agg(F.collect_list("line").alias("recurring"))
        rows = rows.join(own.hint("merge"), "held", "left").select("doc_id", "text", "recurring")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = part.column(2).to_pylist()
                found = [review(t.as_py(), rules, known or frozenset(o or ()))[:n] for t, o in zip(part.column(1), own)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c) for c in zip(*found)]], names=["doc_id", *COLUMNS[:n]]
                )

    return rows.mapInArrow(run, schema)
