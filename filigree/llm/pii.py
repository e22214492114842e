"""Operator 6: personal data, with DataFrame functions only.

Regular expressions propose spans; validators confirm them (Luhn for cards,
the country's length and mod-97 for IBANs, ranges for addresses, digit counts for telephones); the score
of a proposal rises with context words in the text just before it. The four
base kinds are reported whatever their score; the added kinds (iban, ssn,
phone_local) when the score reaches ``THRESHOLD`` and the span overlaps no base
span.

The patterns are written so that Java's engine needs neither deep recursion
nor quadratic time on long runs: a search starts at the head of a run or right
after the last match, and loops are possessive where nothing can follow. Start
offsets are prefix sums over pieces and matches, in blocks of ``BLOCK``, so the
work is linear in the number of matches.

Defined results: null text counts as empty and has no spans; offsets are code
points, end exclusive; repeated rows give repeated results; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.frames import null_text, table

#: Countries by the length of their account numbers, as registered or in use.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?+[A-Z0-9]){{{n - 4}}}+" for n, names in IBAN_LENGTHS.items())

#: Java patterns equal to the contract's leftmost, non-overlapping matches.
PATTERNS = {
    "email": r"(?=[A-Za-z0-9._%+-])(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone_local": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: A cheap test that a text can match at all.
_HINT = {"email": "@", "phone": "+", "ssn": "-"}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address",
    "card": "card|visa|master|pay|credit|debit",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank",
    "ssn": "ssn|social|security",
    "phone_local": "phone|tel|call|mobile|fax|contact",
}
#: Score of a confirmed proposal before its context is read.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "phone_local": 0.3}
CONTEXT_GAIN, CONTEXT_CHARS, THRESHOLD = 0.3, 48, 0.5
BLOCK = 256


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn check."""

    def add(acc, i):
        d = F.ascii(F.substr(digits, F.length(digits) - i + F.lit(1), F.lit(1))) - F.lit(48)
        return acc + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """True if the account number, spaces aside, has the remainder 1 of ISO 7064 mod 97-10."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(acc, i):
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _part_fits(p: Column) -> Column:
    short = F.regexp_replace(p, "^0+(?=[0-9])", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(999)) <= 255)


def valid(kind: str, hit: Column) -> Column:
    n = F.length(digits_of(hit))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: F.forall(F.split(hit, r"\."), _part_fits),
        "card": lambda: n.between(14, 19) & luhn(digits_of(hit)),
        "phone": lambda: n.between(10, 15),
        "iban": lambda: mod97(hit),
        "ssn": lambda: ~hit.rlike("^(000|666|9)") & ~hit.rlike("-00-|-0000$"),
        "phone_local": lambda: n == 10,
    }[kind]()


def _starts(pieces: Column, hits: Column) -> Column:
    """Code point offsets of the hits; ``pieces`` are the texts between them."""
    step = F.transform(hits, lambda h, i: F.length(F.get(pieces, i)) + F.length(h))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(step, b * BLOCK + 1, F.lit(BLOCK))))
    before = F.aggregate(sums, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    return F.transform(hits, lambda h, i: F.get(before, block(i)) + total(F.slice(step, block(i) * BLOCK + 1, i % BLOCK)) + F.length(F.get(pieces, i)))


def _scored(kind: str):
    """The span and score of hit ``h``, the i-th of its kind."""
    starts, pieces = F.col(f"_s_{kind}"), F.col(f"_p_{kind}")

    def span(h, i):
        near = F.lower(F.right(F.get(pieces, i), F.lit(CONTEXT_CHARS)))
        score = F.when(valid(kind, h), F.lit(PRIOR[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
        return F.struct(F.get(starts, i).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), (F.get(starts, i) + F.length(h)).alias("end"), score.alias("score"))

    return span


def find_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and ``_added``: arrays of (start, rank, kind, end, score)."""
    kind_of = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"
    df = docs.withColumn("_t", null_text())
    none = F.array().cast("array<string>")
    for kind, p in PATTERNS.items():
        found = F.regexp_extract_all(F.col("_t"), F.lit(p), F.lit(0))
        df = df.withColumn(f"_h_{kind}", F.when(F.contains(F.col("_t"), F.lit(_HINT[kind])), found).otherwise(none) if kind in _HINT else found)
    for kind, p in PATTERNS.items():
        hits = F.col(f"_h_{kind}")
        df = df.withColumn(f"_p_{kind}", F.when(F.size(hits) > 0, F.split(F.col("_t"), p, -1)))
    for kind in PATTERNS:
        hits = F.col(f"_h_{kind}")
        df = df.withColumn(f"_s_{kind}", F.when(F.size(hits) > 0, _starts(F.col(f"_p_{kind}"), hits)))
    for kind in KINDS:
        hits, span = F.col(f"_h_{kind}"), _scored(kind)
        keep = (lambda s: s["score"] > 0) if kind in BASE else (lambda s: s["score"] >= THRESHOLD)
        df = df.withColumn(f"_k_{kind}", F.when(F.size(hits) > 0, F.filter(F.transform(hits, span), keep)).otherwise(F.array().cast(kind_of)))
    df = df.withColumn("_base", F.array_sort(F.concat(*[F.col(f"_k_{k}") for k in BASE])))
    extra = F.concat(*[F.col(f"_k_{k}") for k in KINDS if k not in BASE])
    free = lambda s: ~F.exists(F.col("_base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    df = df.withColumn("_added", F.when(F.size(extra) > 0, F.filter(extra, free)).otherwise(F.array().cast(kind_of)))
    return df.drop("_t", *[f"_{x}_{k}" for x in "hps" for k in KINDS], *[f"_k_{k}" for k in KINDS if k not in BASE])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    df = find_spans(docs.select("doc_id", "text"))
    counts = [F.size(f"_k_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, F.sha2(joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("_base", "_added"))).alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))
