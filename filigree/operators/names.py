"""Company names: comparable forms and matching of name pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions.scalars import comparable_name

#: The shorter name needs this many words and characters to match inside a longer one.
LEAST_WORDS, LEAST_CHARS = 2, 8


def _windows(words, most):
    """All runs of 1 to ``most`` words, and the whole name."""
    n = F.size(words)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda a: F.transform(F.sequence(F.lit(1), F.greatest(F.least(n - a + 1, most), F.lit(1))), lambda k: F.array_join(F.slice(words, a, k), " "))))
    return F.array_distinct(F.concat(spans, F.array(F.array_join(words, " "))))


def match(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, other_id) of names that are equal, or the shorter of which is a run of words of the longer.

    Both are compared without punctuation and legal suffixes. Runs of words are
    joined by equality, so no pair of names is compared that shares none.
    """
    x = a.select("id", comparable_name(F.col("name")).alias("na")).where("na <> ''")
    y = b.select("other_id", comparable_name(F.col("other_name")).alias("nb")).where("nb <> ''")
    fits = lambda c: (F.size(F.split(c, " ")) >= LEAST_WORDS) & (F.length(c) >= LEAST_CHARS)
    longest = lambda names, c: F.broadcast(names.agg(F.coalesce(F.max(F.size(F.split(c, " "))), F.lit(1)).alias("_most")))
    wx = x.crossJoin(longest(y, "nb")).select("id", F.explode(_windows(F.split("na", " "), F.col("_most"))).alias("k"), "na")
    wy = y.crossJoin(longest(x, "na")).select("other_id", F.explode(_windows(F.split("nb", " "), F.col("_most"))).alias("k"), "nb")
    equal = x.join(y, F.col("na") == F.col("nb"))
    inside = wy.join(x.where(fits("na")), F.col("k") == F.col("na"))
    outside = wx.join(y.where(fits("nb")), F.col("k") == F.col("nb"))
    return equal.select("id", "other_id").union(inside.select("id", "other_id")).union(outside.select("id", "other_id")).distinct()
