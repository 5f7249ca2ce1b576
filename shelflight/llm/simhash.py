"""SimHash near-duplicates found by bit-sliced comparison.

1. ``fingerprints``: 64-bit SimHash of the word shingles of each whole text.
2. Equal fingerprints collapse to one row (partial aggregation, so a group of
   copies with a third of all rows is one row after the map side).
3. ``candidate_cells``: with the 64 bits cut into ``radius + 2`` parts, two
   fingerprints at ``radius`` or fewer differing bits agree on two parts at
   least, so looking inside the buckets of every pair of parts misses nothing.
   A bucket above ``cell_rows`` is cut into blocks, and each pair of blocks is
   a task's cell of its own: the work of a hot bucket spreads, exactly.
4. Inside a cell fingerprints lie as vertical bit planes. A query's differing
   bits go plane by plane into carry-save counters (ones, twos, fours and an
   overflow flag) for all lanes at once; a block is abandoned as soon as every
   lane has overflowed the radius.
5. A cell returns a spanning forest of its links, never all pairs, and the
   forests are joined by ``connected_components``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import join_per_key, materialise
from shelflight.llm.components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
CELL_ROWS = 1 << 16
#: Runs up to this length are compared pair by pair, in one go for a whole batch.
SHORT_RUN = 8
#: Queries that one pass over a block's planes serves.
QUERIES = 128


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text; 0 for null and for texts without a word."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and \x20 \x09-\x0D
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[width - 1 :].tolist())),
        np.uint64,
        n,
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` without its text column, with the SimHash of the text as a signed long ``out``.

    Null and empty texts get 0. A column of the name ``out`` is replaced.
    """
    kept = [c for c in df.columns if c != text and c.lower() != out.lower()]
    # by place: no name of a column clashes with the text's
    wanted = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("text"))
    schema = df.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = np.fromiter((simhash(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*kept, out])

    return wanted.mapInArrow(run, schema)


# --- bit-sliced comparison ---------------------------------------------------


def bit_planes(values: np.ndarray, fill: int = 0) -> np.ndarray:
    """uint64 lanes as 64 rows of packed bits, 64 lanes to a word; the last word is padded with ``fill``."""
    padded = np.full(-(-len(values) // 64) * 64, fill, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _over(difference: Iterator[np.ndarray], radius: int) -> np.ndarray | None:
    """Lanes whose differing bits exceed ``radius`` (< 8), counted in carry-save form.

    None if the block was abandoned because all lanes did.
    """
    ones = twos = fours = over = None
    for plane, x in enumerate(difference):
        if ones is None:
            ones, twos, fours, over = x.copy(), np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
            continue
        carry = ones & x
        ones ^= x
        carry2 = twos & carry
        twos ^= carry
        over |= fours & carry2
        fours ^= carry2
        if plane % 8 == 7:
            if np.all(over | _above(ones, twos, fours, radius) == ~np.uint64(0)):
                return None
    return over | _above(ones, twos, fours, radius)


def _above(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter, 0 to 7, is above ``radius``."""
    above, equal = np.zeros_like(ones), np.full_like(ones, ~np.uint64(0))
    for digit, plane in ((4, fours), (2, twos), (1, ones)):
        if radius & digit:
            equal &= plane
        else:
            above |= equal & plane
            equal &= ~plane
    return above


def _lanes(packed: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(packed.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) differ in ``radius`` or fewer bits."""
    if not len(a):
        return np.zeros(0, bool)
    over = _over(iter(bit_planes(a ^ b, fill=(1 << 64) - 1)), radius)
    return np.zeros(len(a), bool) if over is None else ~_lanes(over, len(a))


def near_block(queries: np.ndarray, planes: np.ndarray, lanes: int, radius: int) -> np.ndarray:
    """A row of booleans for each query over the ``lanes`` of a block of bit planes."""
    full = ~np.uint64(0)
    masks = np.where((queries[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), full, np.uint64(0))
    over = _over((planes[p][None, :] ^ masks[p][:, None] for p in range(64)), radius)
    return np.zeros((len(queries), lanes), bool) if over is None else ~_lanes(over, lanes)


def _merge(labels: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """``labels`` with the two labels of each pair made one."""
    into: dict[int, int] = {}

    def find(x: int) -> int:
        while x in into:
            x = into[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            into[max(a, b)] = min(a, b)
    renamed = np.arange(len(labels))
    for old in into:
        renamed[old] = find(old)
    return renamed[labels]


def spanning_links(values: np.ndarray, radius: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect exactly what the links at ``radius`` connect.

    Every lane asks once, ``QUERIES`` at a time: lanes that were reached first,
    those of the largest component in front, then fresh ones. A query meets all
    lanes that have not asked yet, except where all queries and the lane are of
    one component already, so a dense group costs about as many comparisons as
    it has members.
    """
    n = len(values)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    labels = np.arange(n)  # component of each lane, named by one of its lanes
    rest = np.arange(n)  # not reached yet: each a component of its own
    waiting = np.zeros(0, np.int64)  # reached, still to ask

    def record(queries: np.ndarray, lanes: np.ndarray) -> None:
        """Keep one link for each two components that the pairs connect, and merge them."""
        nonlocal labels
        one, other = labels[queries], labels[lanes]
        codes, at = np.unique(np.minimum(one, other) * n + np.maximum(one, other), return_index=True)
        left.append(queries[at])
        right.append(lanes[at])
        labels = _merge(labels, np.stack([codes // n, codes % n], axis=1))

    while len(rest) or len(waiting):
        if len(waiting) > QUERIES:
            sizes = np.bincount(labels[waiting], minlength=n)[labels[waiting]]
            waiting = waiting[np.lexsort((labels[waiting], -sizes))]
        fresh = max(QUERIES - len(waiting), 0)
        asking = np.concatenate([waiting[:QUERIES], rest[:fresh]])
        waiting, rest = waiting[QUERIES:], rest[fresh:]
        if (labels[asking] != labels[asking[0]]).any():
            i, j = np.triu_indices(len(asking), 1)
            hit = near_pairs(values[asking[i]], values[asking[j]], radius) & (labels[asking[i]] != labels[asking[j]])
            if hit.any():
                record(asking[i[hit]], asking[j[hit]])
        others = waiting
        if (labels[asking] == labels[asking[0]]).all():
            others = waiting[labels[waiting] != labels[asking[0]]]
        reached, unseen = [waiting], []
        for lanes, new in ((others, False), (rest, True)):
            for at in range(0, len(lanes), block):
                part = lanes[at : at + block]
                near = near_block(values[asking], bit_planes(values[part]), len(part), radius)
                if new:
                    hit = near.any(axis=0)
                    first = asking[near.argmax(axis=0)[hit]]
                    left.append(first)
                    right.append(part[hit])
                    labels[part[hit]] = labels[first]
                    reached.append(part[hit])
                    unseen.append(part[~hit])
                # a lane near queries of several components connects them all
                apart = near & (labels[asking][:, None] != labels[part][None, :])
                if apart.any():
                    q, t = np.nonzero(apart)
                    record(asking[q], part[t])
        waiting = np.concatenate(reached)
        rest = np.concatenate(unseen) if unseen else rest
    return np.concatenate(left), np.concatenate(right)


def _links(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linking pairs of values inside the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    run = np.repeat(np.arange(len(starts)), sizes)
    short = sizes <= SHORT_RUN
    left, right = [], []
    for k in range(1, SHORT_RUN):
        i = np.flatnonzero((run[:-k] == run[k:]) & short[run[:-k]]) if len(keys) > k else np.zeros(0, np.int64)
        if len(i):
            hit = near_pairs(values[i], values[i + k], radius)
            left.append(values[i[hit]])
            right.append(values[i[hit] + k])
    for s, n in zip(starts[~short], sizes[~short]):
        own = values[s : s + n]
        i, j = spanning_links(own, radius)
        left.append(own[i])
        right.append(own[j])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            a, b = _links(k, v, radius) if len(k) else (v, v)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            keys = np.concatenate([keys, key])
            values = np.concatenate([values, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(keys) or keys[0] == keys[-1]:
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            yield out(keys[:whole], values[:whole])
            keys, values = keys[whole:], values[whole:]
        yield out(keys, values)

    return run


def _part_bounds(parts: int) -> list[tuple[int, int]]:
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:]))


def candidate_cells(distinct: DataFrame, radius: int, cell_rows: int) -> DataFrame:
    """(cell, fp): fingerprints that share two parts, in cells of bounded size."""
    fp = F.col("fp")
    parts = [
        F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in _part_bounds(radius + 2)
    ]
    keys = F.array(
        *[
            F.shiftleft(F.lit(n).cast("long"), 48) + F.shiftleft(parts[i], 24) + parts[j]
            for n, (i, j) in enumerate(combinations(range(len(parts)), 2))
        ]
    )
    rows = distinct.select("fp", F.explode(keys).alias("key"))
    sizes = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    blocks = F.ceil(F.col("n") / F.lit(cell_rows)).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    return (
        join_per_key(rows, sizes, "key")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .select(
            F.when(F.col("blocks") == 1, F.col("key"))
            .otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
            .alias("cell"),
            "key",
            F.least("own", "other").alias("lo"),
            F.greatest("own", "other").alias("hi"),
            "fp",
        )
    )


def near_duplicate_groups(
    prints: DataFrame, fingerprint: str = "fingerprint", radius: int = RADIUS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(fp, root) for fingerprints that have a link: the least fingerprint of the component.

    Fingerprints without a link are not listed. ``radius`` must be below 8.
    """
    if not 0 < radius < 8:
        raise ValueError("radius must be 1 to 7")
    distinct = materialise(
        prints.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("fp")).count().select("fp"),
        "fingerprints",
    )
    cells = candidate_cells(distinct, radius, cell_rows)
    # equal ``cell`` numbers of different cells only add comparisons, never links
    links = (
        cells.repartition("cell")
        .sortWithinPartitions("cell")
        .select("cell", "fp")
        .mapInArrow(_linker(radius), "a long, b long")
    )
    return connected_components(links, "a", "b")


def simhash_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (signed long), text_hash, component_id, root (least fingerprint).

    component_id is the least doc_id reachable over links between fingerprints
    at ``radius`` or fewer differing bits, the row's own included; rows without
    a doc_id take part, and a component in which no row has one gets null. Null,
    empty and word-less texts have fingerprint 0 and link like any other. Repeated
    rows stay. Other columns are ignored.
    """
    rows = df.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text")
    )
    prints = materialise(fingerprints(rows), "simhash")
    groups = near_duplicate_groups(prints, radius=radius)
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"))
    rooted = least.join(groups.hint("merge"), least["fingerprint"] == groups["node"], "left").select(
        "fingerprint", "first_id", "rows", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = materialise(rooted, "simhash-roots")
    named = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")), "simhash-ids")
    class_of = join_per_key(rooted, named, "root").select("fingerprint", "root", "component_id", F.col("rows").alias("n"))
    return join_per_key(prints, materialise(class_of, "simhash-class"), "fingerprint").select(
        "doc_id", "fingerprint", "text_hash", "component_id", "root"
    )


def keep_first(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``df`` with one document of each near-duplicate group: the one with the least doc_id.

    Of several rows with that doc_id the one with the least text hash stays, of
    exactly repeated rows one. A group without any doc_id keeps one row.
    """
    groups = simhash_groups(df, radius=radius)
    same = groups.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    chosen = same.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")).alias("row")
    )
    chosen = materialise(
        chosen.select(F.col("row.doc_id").alias("kept_id"), F.col("row.text_hash").alias("kept_hash"), "row.n"), "kept"
    )
    # columns by place, so that none clashes with those of the choice
    places = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*places)
    doc_id, text = (places[df.columns.index(c)] for c in ("doc_id", "text"))
    marked = plain.withColumn("text_hash", F.xxhash64(text))
    own = marked[doc_id].eqNullSafe(F.col("kept_id")) & (marked["text_hash"] == F.col("kept_hash"))
    kept = marked.join(chosen.where("n = 1").hint("merge"), own, "left_semi")
    repeated = chosen.where("n > 1")
    if not repeated.isEmpty():  # rows that repeat exactly
        again = marked.join(repeated.hint("merge"), own, "left_semi")
        kept = kept.unionByName(again.dropDuplicates([doc_id, "text_hash"]))
    return kept.select(*places).toDF(*df.columns)
