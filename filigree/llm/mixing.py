"""Operator 4: mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key -ln(u) / q: u is a hash of its id, q its
quality weight. Within a source, whole epochs of all documents come first; the
rest of the target is taken in ascending key order until the prefix sum of
sizes comes nearest to it. The order is never built for a whole source: keys
fall into ``SPLIT`` ranges between approximate quantiles of the source's own
keys, whatever its weights; range sums are aggregated before the shuffle and
prefix-summed, and the range that holds the cut is split again until it has at
most ``RANGE_DOCS`` keys, which are sorted. The cut of each source (one row a
source) then decides every document without a shuffle of texts.

Defined results: a null source is a source of its own, last in order; null and
blank texts have size 0 and are never taken in the fraction; equal keys are
ordered by doc_id and text hash, and identical rows are taken together; rows
with a null doc_id draw by their text; an empty table gives no rows; other columns are kept, clashing ones replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.llm.frames import materialise, null_text, table

WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3
#: Different keys of a range that is sorted at once, and ranges that a larger one is split into.
RANGE_DOCS, SPLIT = 2000, 64
#: A table of one row a source is broadcast up to this many rows (under 10 MB).
BROADCAST_SOURCES = 100_000
SEED = 17

_BLANK = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null counts as empty."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANK))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, r"[\x20\x09-\x0D]+"))).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, falling towards 0 with the share of symbols and digits."""
    t = F.coalesce(text, F.lit(""))
    odd = F.length(t) - F.length(F.translate(t, "#*$%&|<>{}[]=_0123456789", ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * odd / F.greatest(F.length(t), F.lit(1)))


def with_keys(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """Adds _size, _key and _tie."""
    h = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(SEED), F.lit("null"), null_text())).otherwise(F.xxhash64(F.lit(SEED), F.col("doc_id")))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return docs.withColumn("_size", word_count(F.col("text"))).withColumn("_key", -F.log(u) / F.greatest(quality if quality is not None else quality_weight(F.col("text")), F.lit(1e-6))).withColumn("_tie", F.struct(F.col("doc_id"), F.xxhash64(F.lit(SEED), null_text())))


def targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size, ...): shares by weight of the sum of sizes, capped and reshared.

    The fixed point of capping and resharing is a water level: with sources in
    ascending order of cap / weight, those before the first whose cap reaches
    its share get their cap. One row a source, so one task suffices.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = sources.withColumn("_w", w).withColumn("_cap", F.lit(float(max_epochs)) * F.col("source_size"))
    level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rate = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    rated = capped.withColumn("_rate", rate).withColumn("_full", F.col("_cap") <= F.col("_rate") * F.col("_w"))
    final = F.coalesce(F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), F.col("_rate")))).over(everything)["_rate"], F.lit(0.0))
    return rated.withColumn("_final", final).withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("_w")))).drop("_w", "_cap", "_rate", "_full", "_final")


def plan(docs: DataFrame, quality: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The keyed rows (source, _size, _key, _tie), and one row a source: source, source_size, target, epochs, and the cut (_cut_key, _cut_tie) of the fraction."""
    keyed = materialise(with_keys(docs, quality).select("source", "_size", "_key", "_tie"), "mix-keys")
    stats = keyed.groupBy("source").agg(F.sum("_size").alias("source_size"))
    stats = targets(stats).withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.lit(MAX_EPOCHS), F.floor(F.col("target") / F.col("source_size") + 1e-9))).otherwise(F.lit(0)).cast("long"))
    stats = materialise(stats.withColumn("_rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))), "mix-sources")
    hint = F.broadcast if stats.count() <= BROADCAST_SOURCES else (lambda x: x)
    # Rows of equal key and tie are one; each range is (_s, _above < key <= _upto, size of all before it).
    one = keyed.where("_size > 0").groupBy("source", "_key", "_tie").agg(F.sum("_size").alias("_size"))
    held = stats.where("_rest > 0").select(F.col("source").alias("_s"), "_rest", F.lit(-1.0).alias("_above"), F.lit(float("inf")).alias("_upto"), F.lit(0).cast("long").alias("_before"))

    def within(ranges: DataFrame) -> DataFrame:
        return one.join(hint(ranges), F.col("source").eqNullSafe(F.col("_s"))).where((F.col("_key") > F.col("_above")) & (F.col("_key") <= F.col("_upto")))

    most = None
    while True:
        inside = within(held)
        marks = F.percentile_approx("_key", [i / SPLIT for i in range(1, SPLIT)], 100 * SPLIT)
        sizes = materialise(inside.groupBy("_s").agg(F.count("*").alias("_n"), marks.alias("_marks")), "mix-ranges")
        now = sizes.agg(F.max("_n")).first()[0] or 0
        if now <= RANGE_DOCS or now == most:
            break
        most = now
        split = inside.join(hint(sizes.withColumnRenamed("_s", "_m").select("_m", "_marks")), F.col("_s").eqNullSafe(F.col("_m")))
        split = split.withColumn("_range", F.size(F.filter("_marks", lambda x: x < F.col("_key"))))
        sums = split.groupBy("_s", "_range").agg(F.sum("_size").alias("_sum"), F.max("_key").alias("_last"), *[F.first(c).alias(c) for c in ("_rest", "_above", "_before")])
        order = Window.partitionBy("_s").orderBy("_range")
        sums = sums.withColumn("_below", F.col("_before") + F.sum("_sum").over(order) - F.col("_sum")).withColumn("_first", F.coalesce(F.lag("_last").over(order), F.col("_above")))
        # The range of the cut is the first whose sum reaches the rest, else the last.
        reached = F.struct((F.col("_below") + F.col("_sum") < F.col("_rest")).alias("short"), F.when(F.col("_below") + F.col("_sum") < F.col("_rest"), -F.col("_range")).otherwise(F.col("_range")).alias("at"))
        picked = sums.groupBy("_s").agg(F.min_by(F.struct("_rest", F.col("_first").alias("_above"), F.col("_last").alias("_upto"), F.col("_below").alias("_before")), reached).alias("_p"))
        held = materialise(picked.select("_s", "_p.*"), "mix-held")
    inside = within(held)
    byk = Window.partitionBy("_s").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = inside.withColumn("_gap", F.abs(F.col("_before") + F.sum("_size").over(byk) - F.col("_rest")))
    # The cut is the prefix nearest to the rest; where taking nothing of the range is nearer, keys up to ``_above`` are taken.
    best = gap.groupBy("_s").agg(F.min(F.struct("_gap", "_key", "_tie")).alias("_best"), F.first(F.abs(F.col("_rest") - F.col("_before"))).alias("_none"), F.first("_above").alias("_above"))
    some = F.col("_best._gap") <= F.col("_none")
    best = best.select("_s", "_above", F.when(some, F.col("_best._key")).alias("_cut_key"), F.when(some, F.col("_best._tie")).alias("_cut_tie"))
    return keyed, materialise(stats.join(best, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-plan")


def _decided(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with source, _size, _key and _tie, with source_size, target and _copies (how often the mix takes the document)."""
    hint = F.broadcast if cuts.count() <= BROADCAST_SOURCES else (lambda x: x)
    keyed = keyed.join(hint(cuts.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), "left")
    within = F.when(F.col("_cut_key").isNotNull(), (F.col("_key") < F.col("_cut_key")) | ((F.col("_key") == F.col("_cut_key")) & (F.col("_tie") <= F.col("_cut_tie")))).otherwise(F.coalesce(F.col("_key") <= F.col("_above"), F.lit(False)))
    fraction = (within & (F.col("_rest") > 0) & (F.col("_size") > 0)).cast("long")
    return keyed.withColumn("_copies", F.least(F.lit(MAX_EPOCHS), F.col("epochs") + F.coalesce(fraction, F.lit(0))).cast("long"))


def mix(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select("_row", *[F.col(f"_row.{c}").alias(c) for c in ("doc_id", "text", "source")])
    d = _decided(with_keys(rows, quality), plan(docs, quality)[1])
    return d.where("_copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def mix_report(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, key of every document; texts are read once."""
    d = _decided(*plan(docs, quality))
    return d.select(F.col("_tie.doc_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"), F.col("_key").alias("key"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
