"""Operator 13: audit of how filters interact, by a permutation trie.

All orders of the filters form a trie; what survives a prefix depends only on
the set of its filters, not on their order. The trie is walked depth first: a
state applies one filter to its parent's persisted survivor DataFrame, and an
unordered set that was reached before is taken from the memo. So ``2 ** n``
states serve ``n!`` orders. At every state one aggregation counts, for each part
and each filter not applied yet, the rows that this filter actually removes there
(an edge of the trie). Edges go to the shared folder; a state's survivors are
released once all states below it are done, so at most n + 1 are held at a time.
They are cached with their lineage, which ends at a table in the shared folder: a
lost executor costs recomputation, not the job.

Texts are read once, to rows of a few flags; equal texts meet by a 256-bit digest,
pre-aggregated to one row a text before the join. No text is shuffled.

Defined results: null text counts as empty, null part as the empty string; a row
given more than once counts each time; a row with a null id has no smaller id and
never fails E; ids may have several labels (one of them counts) or none; an empty
table gives no rows; other columns are ignored. Edges without removals count 0.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.frames import materialise, null_text, table

#: White space as the contract names it.
SPACE = "[\\x20\\x09-\\x0D]+"


def row_filters() -> dict[str, Column]:
    """Failure conditions A to D on the column ``text``."""
    t = null_text()
    words = F.filter(F.split(F.translate(t, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    n = F.size("words").cast("long")
    return {
        "words": words,
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct("words")).cast("long") < 80 * n,
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")).cast("long") > 10 * F.length(t).cast("long"),
        "D": t.rlike("[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic), one row a document, in the shared folder."""
    cols = row_filters()
    words = cols.pop("words")
    flags = docs.select("doc_id", "lang", "text").withColumn("words", words).select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), *[c.alias(k) for k, c in cols.items()], F.unhex(F.sha2(null_text(), 256)).alias("digest"))
    flags = materialise(flags, "flags")
    # One row for each text that several ids hold: both sides of the join are dealt by digest, so that Spark can split a hot one.
    firsts = materialise(flags.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("last_id > first_id").select("digest", "first_id"), "firsts")
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marks = materialise(marks.where("good OR toxic"), "marks")
    out = flags.join(firsts, "digest", "left").join(marks, "doc_id", "left")
    late = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return materialise(out.select("part", *cols, late.alias("E"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]), "judged")


def trie_edges(rows: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(part, state, filter, alive, removed, good_lost, toxic_lost) of every edge of the trie.

    ``rows`` has ``part``, a boolean column for each filter (True: fails), ``good``
    and ``toxic``; ``state`` is the bit set of the filters applied before.
    """
    bit = {f: 1 << i for i, f in enumerate(filters)}
    memo: dict[int, DataFrame] = {}

    def visit(state: int, survivors: DataFrame) -> None:
        rest = [f for f in filters if not state & bit[f]]
        if state in memo or not rest:
            return
        survivors = survivors.persist()
        edges = survivors.groupBy("part").agg(F.count("*").alias("alive"), *[F.count_if(F.col(f) & when).alias(f"{f}_{name}") for f in rest for name, when in (("removed", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))])
        each = F.explode(F.array(*[F.struct(F.lit(state).alias("state"), F.lit(f).alias("filter"), "alive", *[F.col(f"{f}_{k}").alias(n) for k, n in (("removed", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))]) for f in rest]))
        memo[state] = materialise(edges.select("part", each.alias("e")).select("part", "e.*"), f"edges-{state}")
        for f in rest:
            visit(state | bit[f], survivors.where(~F.col(f)))
        survivors.unpersist()

    visit(0, rows)
    out = None
    for edges in memo.values():
        out = edges if out is None else out.unionByName(edges)
    return out


def filter_audit(rows: DataFrame, filters: Sequence[str]) -> DataFrame:
    """One row for each part, order of all ``filters`` and step."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    edges = materialise(trie_edges(rows, filters), "edges")
    alone = rows.groupBy("part").agg(*[F.count_if(F.col(f) & (sum((F.col(g).cast("int") for g in filters), F.lit(0)) == 1)).alias(f) for f in filters])
    parts = alone.select("part", F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f).alias("unique_fails")) for f in filters])).alias("u")).select("part", "u.*")
    # What a filter removes over all orders: each state before it stands in (its size)! * (filters after it)! orders.
    applied = F.bit_count("state").cast("int")
    weight = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(len(filters) - 1 - k)) for k in range(len(filters))]), applied + 1).cast("long")
    totals = edges.groupBy("part", "filter").agg(F.sum(F.when(F.col("state") == 0, F.col("removed")).otherwise(0)).alias("fails"), F.sum(F.col("removed") * weight).alias("shapley"))
    per_filter = materialise(parts.join(totals, ["part", "filter"]), "per-filter")
    orders = ["".join(p) for p in itertools.permutations(filters)]
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(sum(bit[f] for f in o[:k])).alias("state")) for o in orders for k in range(len(o))])
    # Each (part, filter) row is met by the steps at which its filter stands; the array holds n! * n constants.
    at = per_filter.withColumn("s", F.explode(F.filter(steps, lambda s: F.substring(s["filter_order"], s["step"], F.lit(1)) == F.col("filter")))).select("part", "filter", "fails", "unique_fails", "shapley", "s.*")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = at.join(edges, ["part", "state", "filter"], "left")
    return out.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (zero("alive") - zero("removed")).alias("kept"), zero("removed").alias("removed"), (F.col("fails") - zero("removed")).cast("long").alias("redundant"),
        F.col("unique_fails").cast("long").alias("unique_fails"), zero("good_lost").alias("good_lost"), zero("toxic_lost").alias("toxic_lost"), F.col("shapley").cast("long").alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "ABCDE")


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS fails
  FROM w LEFT JOIN m USING (doc_id)),
p AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a JOIN l b ON a.b <> b.b JOIN l c ON c.b NOT IN (a.b, b.b) JOIN l d ON d.b NOT IN (a.b, b.b, c.b) JOIN l e ON e.b NOT IN (a.b, b.b, c.b, d.b)),
s AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS b, list_sum(bits[1:step - 1])::INTEGER AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, b, sum(n) FILTER ((fails & (coalesce(before, 0) | b)) = 0) AS kept, sum(n) FILTER ((fails & coalesce(before, 0)) = 0 AND (fails & b) > 0) AS removed,
  sum(n) FILTER ((fails & coalesce(before, 0)) > 0 AND (fails & b) > 0) AS redundant, sum(n) FILTER (fails = b) AS unique_fails,
  sum(n_good) FILTER ((fails & coalesce(before, 0)) = 0 AND (fails & b) > 0) AS good_lost, sum(n_toxic) FILTER ((fails & coalesce(before, 0)) = 0 AND (fails & b) > 0) AS toxic_lost
  FROM p, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, b))::BIGINT AS shapley FROM r
"""
