"""Fuzzy search of many texts at once: an inverted table of trigrams and joins by rare ones.

Two sets of trigrams with a Jaccard similarity of t or more share one among the
first n - ceil(t * n) + 1 of each, if both are sorted alike; sorted by rarity,
these are the trigrams that few names have. A name that holds a text holds each
run of three characters of the text, so its rarest run finds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions import fields
from shelflight.sources.tables import materialise

#: A list of search texts with no more rows than this in its own index is sent to the tasks; a longer one is shuffled.
FEW = 100_000


def trigram_index(names: DataFrame, key: str, name: str) -> DataFrame:
    """(key, gram, n) of every trigram of every name with the number of the name's trigrams; names without any have no rows."""
    grams = fields.trigrams(F.col(f"`{name}`"))
    sized = names.select(F.col(f"`{key}`").alias("key"), grams.alias("grams")).withColumn("n", F.size("grams"))
    return sized.select("key", "n", F.explode("grams").alias("gram"))


def _prefixes(index: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """The rows of an index whose trigram is among the rarest that one of a similar pair must share."""
    rated = index.join(frequency.hint("merge"), "gram", "left")
    each = rated.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("grams"))
    # of a bound that is a whole number the floating-point product may lie just above
    needed = F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)).cast("int")
    return each.select("key", "n", F.explode(F.slice("grams", F.lit(1), F.col("n") - needed + 1)).alias("g")).select("key", "n", "g.gram")


def _runs(text: Column, width: Column | int) -> Column:
    """Distinct runs of characters of a width; none of a shorter text."""
    low = F.lower(text)
    width = F.lit(width) if isinstance(width, int) else width
    last = F.length(low) - width + 1
    at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(low, i, width)))


def _sent(df: DataFrame) -> DataFrame:
    """A frame for the smaller side of a join: sent to the tasks if it is short, shuffled otherwise."""
    written = materialise(df, "searched")
    return F.broadcast(written) if written.count() <= FEW else written.hint("merge")


def _holding(named: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_key, key) of names that may hold a text: they have its rarest run of three characters, or all of a shorter one."""
    sized = texts.where("length(text) > 0").select("text_key", F.explode(_runs(F.col("text"), F.least(F.length("text"), F.lit(3)))).alias("run"))
    wanted = materialise(sized, "runs")
    runs = F.array_distinct(F.concat(*[_runs(F.col("name"), w) for w in (1, 2, 3)]))
    has = named.select("key", F.explode(runs).alias("run")).join(_sent(wanted.select("run").distinct()), "run", "left_semi")
    has = materialise(has, "held-runs")
    frequency = has.groupBy("run").agg(F.count("*").alias("df"))
    rarest = wanted.join(frequency.hint("merge"), "run", "left").groupBy("text_key")
    best = rarest.agg(F.min_by("run", F.struct(F.coalesce("df", F.lit(0)), "run")).alias("run"))
    return has.join(_sent(best), "run").select("text_key", "key")


def search_many(names: DataFrame, texts: DataFrame, key: str, name: str, text_key: str, text: str, least: float = 0.3) -> DataFrame:
    """(text_key, key, similarity) of each text with every name that holds it, or whose similarity is ``least`` or more.

    The similarity is that of trigrams; holding disregards case. Keys are unique.
    Null texts and names match nothing; an empty text is held by every name of the
    reference's search, but by none here. Pairs that share a rare enough trigram and
    fit by their numbers of trigrams are compared, each once; no pair else.
    """
    named = names.where(F.col(name).isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{name}`").alias("name"))
    asked = texts.where(F.col(text).isNotNull()).select(F.col(f"`{text_key}`").alias("text_key"), F.col(f"`{text}`").alias("text"))
    index = materialise(trigram_index(named, "key", "name"), "trigrams")
    frequency = materialise(index.groupBy("gram").agg(F.count("*").alias("df")), "trigram-frequency")
    ours = _prefixes(index, frequency, least)
    theirs = _prefixes(trigram_index(asked, "text_key", "text"), frequency, least)
    theirs = _sent(theirs.select(F.col("key").alias("text_key"), F.col("n").alias("m"), "gram"))
    fits = (F.col("n") * F.lit(1.0) >= F.col("m") * F.lit(least) - 1e-9) & (F.col("m") * F.lit(1.0) >= F.col("n") * F.lit(least) - 1e-9)
    met = ours.join(theirs, "gram").where(fits).select("text_key", "key")
    pairs = materialise(met.unionByName(_holding(named, asked)).distinct(), "pairs")
    texts_of = pairs.join(named.hint("merge"), "key").join(asked.hint("merge"), "text_key")
    score = fields.similarity(F.col("name"), F.col("text"))
    holds = F.lower("name").contains(F.lower("text"))
    scored = texts_of.select("text_key", "key", score.alias("similarity"), holds.alias("holds"))
    return scored.where(F.col("holds") | (F.col("similarity") >= least)).select("text_key", "key", "similarity")
