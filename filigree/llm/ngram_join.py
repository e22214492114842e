"""Operator 8: grouped prefix join on Jaccard similarity of word shingles.

A document is the set of its distinct five-word shingles (64-bit hashes). All
shingles have one global order, those known to be frequent last; two sets with
a Jaccard similarity of t or more share a shingle among their first
n - ceil(t * n) + 1. The steps:

1. Frequent shingles are counted per task and summed. The list only orders the
   prefixes, so its bound ``ORDERED`` (a few MB) changes cost, never results.
2. Equal sets become one, and sets of equal prefix and size one group.
3. Prefix tokens of group leaders are shuffled once; tokens of one group only
   are dropped, and lists of two that the size and position filters part.
4. Hubs: each list names two members that the others are compared with, the
   one with the fewest unshared prefix tokens (the text that copies were made
   of has none) and one by hash, another each round. Of the hubs of its rarest and most frequent
   tokens each set takes the closest by signature; those pairs are verified on
   whole texts, and linked sets joined into components. Sets look again, in
   lists that still hold several components, for the hubs of most links. So a
   group of k near copies costs about k pairs.
5. All remaining pairs of a list, of its groups' members, in different
   components pass the size and position filters and a bound on the overlap
   from parity signatures before they become rows, once for each run of common
   tokens; those left are verified. No link that matters to a component is
   lost. Of a list beyond ``CELL`` members the largest component is dealt over
   blocks and met by the others there; neither is held in one task.

Signatures: each bit tells whether an odd number of a set's shingles falls on
it. Two sets differ in at least as many shingles as their signatures in bits,
so a pair is only dropped when its overlap is surely too small.

Defined results: null, empty and blank texts have an empty set and are linked
with nothing; rows with a null doc_id get a null component and are not linked;
rows that share a doc_id count as one document when linked; ties and repeated
rows fall together; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.llm.components import components
from filigree.llm.frames import id_filter, map_arrow, map_batches, materialise, small_batches, table, with_filter
from filigree.llm.words import mix64, shingle_sets, text_slices

K, PERCENT = 5, 75
#: Frequent shingles that order the prefixes: local and total count, and how many at most.
LOCAL_COUNT, TOTAL_COUNT, ORDERED = 4, 8, 1 << 17
#: Shingles counted together in a task.
COUNTED = 1_000_000
#: Rarest and most frequent tokens of a set whose lists' hubs step 4 reads.
FIRST, LAST = 3, 3
#: Times that sets look for a hub of another component; later ones prefer the hubs of most links.
ROUNDS = 3
#: Members of a list compared in one piece.
CELL = 4096
#: Words of 64 bits of a signature's shortest form, and of its longest.
SHORT, LONG = 4, 1024
#: Pairs of a hub that one task verifies together.
SHARE = 64

_M1, _M2 = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64, copy=False).view(np.int64))


def frequent_shingles(docs: DataFrame, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of at most ``ORDERED`` frequent shingles."""

    def run(batches):
        held, size = [], 0

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= LOCAL_COUNT
            return pa.RecordBatch.from_arrays([_long(u[keep]), pa.array(c[keep].astype(np.int64))], names=["h", "c"])

        for b in batches:
            for _, _, t in text_slices(b.column(0)):
                v, _ = shingle_sets(t, k)
                held.append(v)
                size += len(v)
                if size >= COUNTED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    found = docs.select("text").transform(map_arrow, run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= TOTAL_COUNT)
    with small_batches(docs.sparkSession):
        rows = found.orderBy(F.desc("c"), "h").limit(ORDERED).toArrow()
    h = rows["h"].to_numpy().view(np.uint64)
    o = np.argsort(h)
    return h[o], rows["c"].to_numpy()[o]


SIG = "doc_id long, n long, s1 long, s2 long, g1 long, g2 long, prefix array<long>, parity array<long>, f0 long, f1 long, f2 long, f3 long"


def signatures(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], k: int = K, percent: int = PERCENT) -> DataFrame:
    """Per document: set size, fingerprints of the set (s) and of prefix and size (g), the prefix, and the parity signature."""
    fh, fc = frequent

    def run(batch: pa.RecordBatch):
        ids = batch.column(0)
        for i, j, t in text_slices(batch.column(1)):
            v, off = shingle_sets(t, k)
            n = np.diff(off)
            m = np.zeros(len(v), np.int64)
            if len(fh) and len(v):
                at = np.minimum(np.searchsorted(fh, v), len(fh) - 1)
                m = np.where(fh[at] == v, fc[at], 0)
            hot = np.concatenate([[0], np.cumsum(m > 0)])
            for d in np.flatnonzero(hot[off[1:]] > hot[off[:-1]]):
                a, b = off[d], off[d + 1]
                v[a:b] = v[a:b][np.argsort(m[a:b], kind="stable")]
            p = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
            poff = np.concatenate([[0], np.cumsum(p)])
            pre = v[np.arange(poff[-1]) - np.repeat(poff[:-1] - off[:-1], p)]

            def total(x, o):
                s = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
                return s[o[1:]] - s[o[:-1]]

            s1, s2 = total(mix64(v ^ _M1), off), total(mix64(v + _M2), off)
            nn = mix64(n.astype(np.uint64) + _M1)
            g1, g2 = total(mix64(pre ^ _M2), poff) ^ nn, total(mix64(pre + _M1), poff) + nn
            lists = pa.ListArray.from_arrays(pa.array(poff, pa.int32()), _long(pre))
            bits, boff = _parity(v, off)
            even = pa.ListArray.from_arrays(pa.array(boff, pa.int32()), _long(bits))
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), _long(s1), _long(s2), _long(g1), _long(g2), lists, even, *map(_long, _folded(bits, boff))], names=["doc_id", "n", "s1", "s2", "g1", "g2", "prefix", "parity", *SHORT_BITS])

    return map_batches(docs.select("doc_id", "text"), run, SIG)


SHORT_BITS = [f"f{i}" for i in range(SHORT)]


def _parity(v: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity signatures of sets, of about two bits a member, and their offsets; lengths are powers of two."""
    n = np.diff(off)
    words = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) / 32)).astype(np.int64).clip(0), SHORT, LONG)
    boff = np.concatenate([[0], np.cumsum(words)])
    at = (v >> np.uint64(40)).astype(np.int64) & (np.repeat(words, n) * 64 - 1)
    odd = np.bincount(np.repeat(boff[:-1] * 64, n) + at, minlength=int(boff[-1]) * 64).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64), boff


def _folded(bits: np.ndarray, boff: np.ndarray) -> list[np.ndarray]:
    """The signatures' shortest form: a signature of half the length is the xor of the two halves."""
    return [np.array([np.bitwise_xor.reduce(bits[a + i : b : SHORT]) for a, b in zip(boff[:-1], boff[1:], strict=True)], np.uint64) for i in range(SHORT)]


def _viable(tok: np.ndarray, n: np.ndarray, pos: np.ndarray, keep: np.ndarray, percent: int) -> np.ndarray:
    """False for the rows to keep that no other row of their token passes the size and position filters with.

    Looks at lists of up to 64 rows that do not reach a batch's ends; all others stay.
    """
    out = np.ones(len(tok), bool)
    at = np.flatnonzero(keep)
    if not len(at):
        return out
    t = tok[at]
    starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    size = np.diff(np.append(starts, len(t)))
    judged = (size <= 64) & (t[starts] != tok[0]) & (t[starts] != tok[-1])
    stop = np.repeat(np.where(judged, starts + size, starts), size)
    good = np.repeat(~judged, size)
    live, d = np.arange(len(t)), 0
    while True:
        d += 1
        live = live[live + d < stop[live]]
        if not len(live):
            break
        a, b = _filtered(live, live + d, n[at], pos[at], percent)
        good[a] = good[b] = True
    out[at[~good]] = False
    return out


def _repeated(percent: int):
    """Rows (token, id, n, pos) sorted by token, without those whose token occurs once, or in too unlike sets only."""

    def run(batches):
        held, done = None, None
        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
                held = None
            if not b.num_rows:
                continue
            tok, n, pos = (b.column(i).to_numpy() for i in (0, 2, 3))
            same = tok[1:] == tok[:-1]
            keep = np.zeros(len(tok), bool)
            keep[1:] = same
            keep[:-1] |= same
            keep[0] |= done is not None and tok[0] == done
            keep &= _viable(tok, n, pos, keep, percent)
            if not keep[-1]:
                held = b.slice(b.num_rows - 1)
            done = int(tok[-1])
            if keep.any():
                yield b.filter(pa.array(keep))

    return run


def _runs(batches, width: int):
    """Batches cut so that rows of equal first ``width`` columns stay together."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(i).to_numpy() for i in range(width)]
        new = np.zeros(b.num_rows, bool)
        for x in keys:
            new[1:] |= x[1:] != x[:-1]
        if held:
            last = held[-1]
            new[0] = any(last.column(i)[last.num_rows - 1].as_py() != b.column(i)[0].as_py() for i in range(width))
        cuts = np.flatnonzero(new)
        if len(cuts) and (held or cuts[-1] > 0):
            whole = pa.Table.from_batches([*held, b.slice(0, int(cuts[-1]))]).combine_chunks()
            if whole.num_rows:
                yield whole
            held = [b.slice(int(cuts[-1]))]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _filtered(a, b, n, pos, percent):
    """Pairs (by row index) that the size and position filters let pass."""
    na, nb = n[a].astype(np.int64), n[b].astype(np.int64)
    need = (percent * (na + nb) + 99 + percent) // (100 + percent)
    ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(na - pos[a], nb - pos[b]) >= need)
    return a[ok], b[ok]


def _all_pairs(starts: np.ndarray, stops: np.ndarray, comp: np.ndarray):
    """Index pairs of rows of one piece, a bounded number at a time: all of small pieces, those outside its largest component with all of a large one."""
    size = stops - starts
    mixed = np.maximum.reduceat(comp, starts) != np.minimum.reduceat(comp, starts)
    small = size <= 64
    stop = np.repeat(np.where(small & mixed, stops, starts), size)
    live = np.arange(len(comp))
    d = 0
    while True:
        d += 1
        live = live[live + d < stop[live]]
        if not len(live):
            break
        yield live, live + d
    large = mixed & ~small
    for a, b in zip(starts[large].tolist(), stops[large].tolist(), strict=True):
        values, counts = np.unique(comp[a:b], return_counts=True)
        for i in a + np.flatnonzero(comp[a:b] != values[counts.argmax()]):
            yield np.full(b - a, i), np.arange(a, b)


def _pairs(percent: int):
    """Candidate pairs of rows (token, lo, hi, block, id, n, pos, comp, prev, short signature), sorted by their first three columns.

    Pairs are of different components and of the blocks lo and hi, and not of
    sets that share the token before this one: they have met there.
    """

    def run(batches):
        for t in _runs(batches, 3):
            tok, lo, hi, block, ids, n, pos, comp, prev, *bits = (t.column(i).to_numpy() for i in range(9 + SHORT))
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            starts = np.flatnonzero(new)
            stops = np.append(starts[1:], len(tok))
            bits = [x.view(np.uint64) for x in bits]  # bits of signed numbers would be those of their absolute value
            out_a, out_b = [], []
            for a, b in _all_pairs(starts, stops, comp):
                ok = (comp[a] != comp[b]) & (prev[a] != prev[b]) & ((lo[a] == hi[a]) | (block[a] != block[b]))
                a, b = _filtered(a[ok], b[ok], n, pos, percent)
                if len(a):
                    differ = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in bits)
                    ok = differ <= _slack(n[a], n[b], percent)
                    a, b = a[ok], b[ok]
                    out_a.append(np.minimum(ids[a], ids[b]))
                    out_b.append(np.maximum(ids[a], ids[b]))
            if out_a:
                u = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(u[1])], names=["a", "b"])

    return run


def _slack(na, nb, percent: int):
    """Members in which two linked sets may differ at most."""
    total = na.astype(np.int64) + nb
    return total - 2 * ((percent * total + 99 + percent) // (100 + percent))


def _slack_sql(na, nb, percent: int):
    return na + nb - 2 * F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))


def _close(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets need not differ in too many members by their whole signatures."""
    one = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    two = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))

    def half(x, other):
        """The signature at the other's length, if that is half of its own; sizes of a pair never lie further apart."""
        k = F.size(other)
        return F.when(F.size(x) > k, F.zip_with(F.slice(x, 1, k), F.slice(x, k + 1, k), lambda u, v: u.bitwiseXOR(v))).otherwise(x)

    x, y = F.col("pa"), F.col("pb")
    differ = F.aggregate(F.zip_with(half(x, y), half(y, x), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, u: s + u)
    return pairs.join(one, "a").join(two, "b").where(differ <= _slack_sql(F.col("na"), F.col("nb"), percent)).select("a", "b").distinct()


def _closest_hubs(rows: DataFrame, tried: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """(a, b): each set of the rows (token, id, n, short signature, unshared, comp, links) with the closest hub b of its lists that is in another component, was not tried, and may be near enough."""
    me = F.struct("id", "n", "comp", *SHORT_BITS)
    hubs = rows.groupBy("token").agg(F.min(F.struct((-F.col("links")).alias("l"), "unshared", F.xxhash64("id").alias("h"), me.alias("me")))["me"].alias("one"), F.min(F.struct(F.xxhash64("id", "token", F.lit(turn)).alias("h"), me.alias("me")))["me"].alias("two"))
    met = rows.join(hubs, "token").select("id", "n", "comp", *SHORT_BITS, F.explode(F.array("one", "two")).alias("hub")).where("comp <> hub.comp")
    differ = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"hub.{f}"))) for f in SHORT_BITS), F.lit(0))
    met = met.where(differ <= _slack_sql(F.col("n"), F.col("hub.n"), percent)).where(F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent)
    met = met.select(F.col("id").alias("a"), F.col("hub.id").alias("b"), (differ / (F.col("n") + F.col("hub.n"))).alias("gap"))
    if tried is not None:
        met = met.join(tried, ["a", "b"], "left_anti")
    return met.groupBy("a").agg(F.min_by("b", F.struct("gap", F.xxhash64("b"), "b")).alias("b"))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the ids and of few others: a filter of fixed size drops most where they are read."""
    return with_filter(docs.select(F.col("doc_id").alias("id"), "text"), id_filter(ids, "id"), "id").where("_may").drop("_may")


def verify(docs: DataFrame, pairs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose whole texts' shingle sets are similar enough.

    Texts a are sent to their b, at most ``SHARE`` to one of its shares or so, so
    that a text of many pairs is read once for a share and none meets all in one task.
    The pairs are written first: four branches of the plan read them.
    """
    pairs = materialise(pairs, "ngram-pairs")
    parts = pairs.groupBy("b").count().where(F.col("count") > SHARE).select("b", F.ceil(F.col("count") / SHARE).alias("parts"))
    dealt = pairs.join(parts, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1)))).select("a", "b", "part")
    hubs = dealt.select("b", "part").distinct()
    left = dealt.join(_texts(docs, dealt.select(F.col("a").alias("id"))), F.col("a") == F.col("id")).select("b", "part", "a", "text")
    right = hubs.join(_texts(docs, hubs.select(F.col("b").alias("id"))), F.col("b") == F.col("id")).select("b", "part", F.lit(None).cast("long").alias("a"), "text")

    def run(batches):
        key, sets = None, []
        for batch in batches:
            b, part, a = (batch.column(i).to_pylist() for i in range(3))
            out_a, out_b = [], []
            for i, j, t in text_slices(batch.column(3)):
                v, off = shingle_sets(t, k)
                for r in range(i, j):
                    x = v[off[r - i] : off[r - i + 1]]
                    if (b[r], part[r]) != key:
                        key, sets = (b[r], part[r]), []
                    if a[r] is None:  # comes first; a doc_id of several rows has several texts
                        sets.append(x.copy())
                        continue
                    for y in sets:
                        both = np.concatenate([x, y])
                        both.sort()
                        common = int((both[1:] == both[:-1]).sum())
                        if 100 * common >= percent * (len(x) + len(y) - common) and common:
                            out_a.append(a[r])
                            out_b.append(b[r])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    rows = left.union(right).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return rows.transform(map_arrow, run, "a long, b long").distinct()


def _cells(rows: DataFrame) -> DataFrame:
    """Rows (with ``all``, the members of their list) under (token, lo, hi): a list in one cell, a long one in cells of two blocks.

    The blocks of a long list's largest component are met by the others' only.
    """
    of = rows.where(F.col("all") > CELL).groupBy("token", "comp").agg(F.count("*").alias("count"), F.first("all").alias("all"))
    of = of.groupBy("token").agg(F.first("all").alias("all"), F.max("count").alias("most"), F.max_by("comp", "count").alias("top"))
    long = of.select("token", "top", F.ceil((F.col("all") - F.col("most")) / CELL).cast("int").alias("minor"), F.ceil(F.col("most") / CELL).cast("int").alias("major"))
    whole, main, h = F.col("top").isNull(), F.col("comp") == F.col("top"), F.xxhash64("id")
    r = rows.join(long, "token", "left")
    r = r.withColumn("block", F.when(whole, 0).when(main, F.col("minor") + F.pmod(h, F.col("major"))).otherwise(F.pmod(h, F.col("minor"))).cast("int"))
    last = F.when(whole, 0).when(main, F.col("minor") - 1).otherwise(F.col("minor") + F.col("major") - 1)
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    r = r.select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "n", "pos", "comp", "prev", *SHORT_BITS)
    return r.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")


def _towards_hubs(pairs: DataFrame) -> DataFrame:
    """The pairs with the member of more pairs as b."""
    of = pairs.select(F.col("a").alias("u")).union(pairs.select("b")).groupBy("u").count()
    both = pairs.join(of.select(F.col("u").alias("a"), F.col("count").alias("na")), "a").join(of.select(F.col("u").alias("b"), F.col("count").alias("nb")), "b")
    turn = F.col("na") > F.col("nb")
    return both.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))


def link(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = docs.select("doc_id", "text")
    sig = materialise(signatures(docs, frequent_shingles(docs, k), k, percent), "ngram-signatures")
    named = sig.where("doc_id IS NOT NULL AND n > 0")
    sets = materialise(named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("g1", "g2", "parity", *SHORT_BITS)]), "ngram-sets")
    groups = sets.groupBy("n", "g1", "g2").agg(F.min("rep").alias("gid"), F.count("*").alias("members"))
    # Leaders' prefixes; those alone with their prefix and size pass by without a shuffle.
    of = ["n", "g1", "g2"]
    again = named.groupBy(*of).count().where("count > 1").select(F.xxhash64(*of).alias("_key"))
    rows = with_filter(named.select("doc_id", *of, "prefix").withColumn("_key", F.xxhash64(*of)), id_filter(again, "_key"), "_key").drop("_key")
    led = rows.where("_may").join(groups.select(F.col("gid").alias("doc_id"), *of), ["doc_id", *of], "left_semi").dropDuplicates(["doc_id", *of])
    postings = rows.where("NOT _may").select("doc_id", "n", "prefix").union(led.select("doc_id", "n", "prefix"))
    postings = postings.select("doc_id", "n", F.posexplode("prefix").alias("pos", "token")).select("token", F.col("doc_id").alias("id"), F.col("n").cast("int").alias("n"), F.col("pos").cast("int").alias("pos"))
    lists = postings.repartition("token").sortWithinPartitions("token").transform(map_arrow, _repeated(percent), "token long, id long, n int, pos int")
    lists = materialise(lists, "ngram-lists")
    # A group of several sets is a list of its own, under its fingerprint.
    shared = sets.join(groups.where("members > 1"), of).select("gid", "rep", F.col("n").cast("int").alias("n"), F.xxhash64("g1", "g2", F.lit("group")).alias("token"))
    shared = materialise(shared, "ngram-groups")
    short = sets.select(F.col("rep").alias("id"), F.col("n").cast("int").alias("n"), *SHORT_BITS)
    by_set = Window.partitionBy("id").orderBy("pos", "token")
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    first = lists.select("*", F.row_number().over(by_set).alias("k"), F.count("*").over(Window.partitionBy("id")).alias("of")).where((F.col("k") <= FIRST) | (F.col("k") > F.col("of") - LAST))
    first = first.select("token", "id", "n", (prefix - F.col("of")).cast("long").alias("unshared"))
    first = first.join(short.withColumnRenamed("n", "size"), "id").where("n = size").drop("size")
    first = first.union(shared.select("token", F.col("rep").alias("id"), "n", F.lit(0).cast("long").alias("unshared")).join(short, ["id", "n"]).select(*first.columns))
    first = materialise(first, "ngram-first")
    near = edges = comp = None
    for turn in range(ROUNDS):
        if comp is None:
            rows = first.select("*", F.col("id").alias("comp"), F.lit(0).cast("long").alias("links"))
        else:
            links = edges.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("links"))
            rows = first.join(comp.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left").withColumn("comp", F.coalesce("comp", "id")).withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
        found = materialise(_closest_hubs(rows, near, turn, percent), "ngram-hubs")
        linked = materialise(verify(docs, _close(found, sets, percent), k, percent), "ngram-edges")
        near = found if near is None else near.union(found)
        edges = linked if edges is None else edges.union(linked)
        comp = components(edges)
    members = shared.select(F.col("gid").alias("id"), "rep")
    rest = lists.join(members, "id", "left").select("token", F.coalesce("rep", "id").alias("id"), "n", "pos").union(shared.select("token", "rep", "n", F.lit(-1)))
    rest = rest.join(comp, rest["id"] == comp["node"], "left").select("token", "id", "n", "pos", F.coalesce("comp", "id").alias("comp"))
    mixed = rest.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("all")).where("x < y").select("token", "all")
    before = F.coalesce(F.lag("token").over(by_set), F.bitwise_not("id")).alias("prev")
    rest = rest.join(mixed, "token").select("*", before).join(short.withColumnRenamed("n", "size"), "id").where("n = size").drop("size").withColumn("pos", F.greatest("pos", F.lit(0)))
    tried = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    far = _cells(materialise(rest, "ngram-rest")).transform(map_arrow, _pairs(percent), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    far = materialise(_close(far, sets, percent), "ngram-far")
    edges = edges.union(materialise(verify(docs, _towards_hubs(far), k, percent), "ngram-edges"))
    comp = components(edges)
    of = sets.select("n", "s1", "s2", "rep").join(comp, sets["rep"] == comp["node"], "left").select("n", "s1", "s2", F.coalesce("comp", "rep").alias("comp"))
    return sig.select("doc_id", "n", "s1", "s2").join(of, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


#: All pairs with a common shingle, then everything reachable: right at test sizes only, which is what the query is compared at.
OP8_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i, w FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM u),
c AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN c p ON p.doc_id = a JOIN c q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce((SELECT MIN(seen) FROM r WHERE r.id = d.doc_id), d.doc_id) AS component_id FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id"""
