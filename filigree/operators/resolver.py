"""Managers from names: search variants, Atom feeds, scored look-up, validation by filings, a model's candidates.

A name's look-up first meets companies by equality of its search variants, in
their order. Names without such a company are scored against all companies by
the weight of shared words, where a word weighs more the fewer names have it.
Words of a name are ordered from rare to frequent; a pair that reaches
``percent`` of the heavier name's weight must share a word in the leading parts
of both, so only these are joined: no pair is scored that shares none, and none
that qualifies is missed. Frequent words hardly ever lead.

Tables of names stay distributed: their files are small beside the names that are made
of them, so the planner's sizes would have it broadcast them; joins ask for a merge.

Defined results: a null or empty name, or one of legal suffixes only, finds
nothing; of equally scored companies the smaller cik is taken; repeated
companies count once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.catalogue import LEGAL_SUFFIXES
from filigree.functions.scalars import comparable_name, index_url
from filigree.operators import names
from filigree.sources.parse import parsed
from filigree.sources.shared import stored
from filigree.sources.xmlforms import every, local, root_of

#: Share of the heavier name's weight that a scored company must hold.
PERCENT = 60


def compact_ampersand(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(name), r"\s*&\s*", "&"))


def without_suffixes(name: Column) -> Column:
    """Words apart by commas, periods and spaces, without legal suffixes; case stays."""
    words = F.filter(F.split(name, r"[,.\s]+"), lambda w: w != "")
    bare = lambda w: F.lower(F.regexp_replace(w, r"^[^A-Za-z0-9&]+|[^A-Za-z0-9&]+$", ""))
    return F.array_join(F.filter(words, lambda w: (bare(w) != "") & ~bare(w).isin(*LEGAL_SUFFIXES)), " ")


def simplified(name: Column) -> Column:
    words = F.split(F.regexp_replace(name, "[^A-Za-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(*LEGAL_SUFFIXES)), " ")


def search_variants(name: Column) -> Column:
    """Up to four spellings to search for, in order: as given, compact ampersands, without suffixes, letters and digits only."""
    compact = compact_ampersand(name)
    return F.array_distinct(F.array_compact(F.concat(F.array(F.trim(name), compact), F.filter(F.array(without_suffixes(compact), simplified(compact)), lambda v: v != ""))))


def form_encoded(text: Column) -> Column:
    """Spaces as plus; letters, digits, - _ . and ~ as they are; other bytes in percent."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def search_url(variant: Column) -> Column:
    return F.concat(F.lit("https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&company="), form_encoded(variant), F.lit("&type=13F-HR&owner=exclude&output=atom"))


def atom_feed(content: str) -> list[dict]:
    """The company of a search feed (the last one named) and how many of its entries are of each form."""
    root = root_of(content)
    ciks = [" ".join("".join(c.itertext()).split()) for info in every(root, "company-info") for c in info if local(c.tag) == "cik"]
    titles = [" ".join("".join(c.itertext()).split()) for info in every(root, "company-info") for c in info if local(c.tag) == "conformed-name"]
    forms = [" ".join("".join(e.itertext()).split()) for e in every(root, "filing-type")]
    return [{"cik": int(ciks[-1]) if ciks and ciks[-1].isdigit() else None, "company": titles[-1] if titles else None, "entries": len(every(root, "entry")), "forms": sorted(set(forms))}]


ATOM = "cik long, company string, entries int, forms array<string>"


def atom_managers(feeds: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    return parsed(feeds, keys, content, atom_feed, ATOM)


def _words(df: DataFrame, key: str, name: Column) -> DataFrame:
    """(key, words): the different words of comparable names."""
    return df.select(key, F.array_distinct(F.filter(F.split(comparable_name(name), " "), lambda w: w != "")).alias("words")).where(F.size("words") > 0)


def _weighed(words: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """(key, all: weight of the name, lead: words that a qualifying partner must share one of, words: word to weight)."""
    w = words.select(key, F.explode("words").alias("word")).join(weights.hint("merge"), "word").groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("rare"), "word"))).alias("ws"))
    total = F.aggregate("ws", F.lit(0).cast("long"), lambda a, x: a - x["rare"])
    before = F.transform("ws", lambda x, i: F.struct(x["word"].alias("word"), F.aggregate(F.slice("ws", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a - y["rare"]).alias("before")))
    w = w.withColumn("all", total).withColumn("b", before)
    # Words after which less than the share remains cannot carry a pair alone.
    lead = F.transform(F.filter("b", lambda x: (F.col("all") - x["before"]) * 100 >= PERCENT * F.col("all")), lambda x: x["word"])
    return w.select(key, "all", lead.alias("lead"), F.map_from_entries(F.transform("ws", lambda x: F.struct(x["word"], -x["rare"]))).alias("weights"))


def scored_pairs(queries: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, cik, shared, heavier) of all pairs whose shared words weigh ``PERCENT`` of the heavier name or more.

    ``queries`` has id and name, ``companies`` cik and company, one row each.
    """
    a, b = _words(queries, "id", F.col("name")), _words(companies, "cik", F.col("company"))
    every_word = a.select(F.explode("words").alias("word")).unionAll(b.select(F.explode("words").alias("word")))
    n = a.select(F.lit(1)).unionAll(b.select(F.lit(1))).agg(F.count("*").alias("n"))
    # A weight is the number of binary digits of how many names there are for each one with the word: whole, so sums are exact.
    weights = every_word.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("word", F.length(F.bin(F.expr("n div df"))).cast("long").alias("weight"))
    x, y = _weighed(a, "id", weights), _weighed(b, "cik", weights)
    x, y = x.select("id", F.col("all").alias("xa"), "lead", F.col("weights").alias("xw")), y.select("cik", F.col("all").alias("ya"), "lead", F.col("weights").alias("yw"))
    met = x.withColumn("k", F.explode("lead")).drop("lead").join(y.withColumn("k", F.explode("lead")).drop("lead").hint("merge"), "k").drop("k").dropDuplicates(["id", "cik"])
    shared = F.aggregate(F.array_intersect(F.map_keys("xw"), F.map_keys("yw")), F.lit(0).cast("long"), lambda s, w: s + F.col("xw")[w])
    return met.select("id", "cik", shared.alias("shared"), F.greatest("xa", "ya").alias("heavier")).where(F.col("shared") * 100 >= PERCENT * F.col("heavier"))


def manager_lookup(queries: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, name, cik, company, how, shared, heavier): the company of each name, by its variants or else by score."""
    companies = companies.groupBy("cik").agg(F.min("company").alias("company"))
    tried = queries.select("id", "name", F.posexplode(search_variants(F.col("name"))).alias("place", "variant"))
    spelled = companies.select("cik", "company", F.explode(search_variants(F.col("company"))).alias("variant")).distinct()
    w = Window.partitionBy("id").orderBy("place", "cik")
    exact = tried.join(spelled.hint("merge"), "variant").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("id", "cik", F.lit("variant").alias("how"), F.lit(None).cast("long").alias("shared"), F.lit(None).cast("long").alias("heavier"))
    rest = queries.join(exact.select("id").hint("merge"), "id", "left_anti")
    best = Window.partitionBy("id").orderBy((F.col("shared") / F.col("heavier")).desc(), "cik")
    scored = scored_pairs(rest, companies).withColumn("_n", F.row_number().over(best)).where("_n = 1").select("id", "cik", F.lit("score").alias("how"), "shared", "heavier")
    return queries.join(exact.unionByName(scored).join(companies.hint("merge"), "cik").hint("merge"), "id", "left").select("id", "name", "cik", "company", "how", "shared", "heavier")


def next_commands(cik: Column) -> Column:
    c = cik.cast("string")
    return F.when(cik.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("sec 13f-summary --cik "), c, F.lit(" --latest 2 --pretty")), F.concat(F.lit("sec 13f-diff --cik "), c, F.lit(" --pretty")), F.concat(F.lit("sec report --cik "), c, F.lit(" --kind portfolio --limit 15"))))


def latest_13f(filings: DataFrame) -> DataFrame:
    """(cik, filer, latest_accession, latest_report_date, latest_filing_date) of the newest holdings report of each company."""
    f = filings.where(F.upper("form") == "13F-HR").groupBy("cik").agg(F.max_by(F.struct("company", "accession", "report_date", "filing_date"), F.struct("filing_date", "accession")).alias("f"))
    return f.select("cik", F.col("f.company").alias("filer"), F.col("f.accession").alias("latest_accession"), F.col("f.report_date").alias("latest_report_date"), F.col("f.filing_date").alias("latest_filing_date"))


def validated(candidates: DataFrame, filings: DataFrame, key: str = "row") -> DataFrame:
    """Candidates (``key``, cik, manager, investor ...) with the newest report of their cik and a status.

    verified_13f where the filer's name matches the manager or investor, else
    company_mismatch; no_recent_13f without a report, missing_cik without a cik.
    """
    c = candidates.join(latest_13f(filings), "cik", "left")
    named = c.where("latest_accession IS NOT NULL").select(key, "filer", F.explode(F.array("manager", "investor")).alias("n")).where("n IS NOT NULL")
    # Names of one candidate and its filer only: both sides carry the candidate's key.
    hits = named.select(key, comparable_name(F.col("filer")).alias("f"), comparable_name(F.col("n")).alias("n"))
    pair = lambda s, l: F.struct(F.col(s).alias("s"), F.col(l).alias("l"))  # noqa: E731, E741
    hits = hits.withColumn("p", F.when(F.size(F.split("f", " ")) <= F.size(F.split("n", " ")), pair("f", "n")).otherwise(pair("n", "f")))
    run = (F.size(F.split("p.s", " ")) >= names.LEAST_WORDS) & (F.length("p.s") >= names.LEAST_CHARS) & F.contains(F.concat(F.lit(" "), "p.l", F.lit(" ")), F.concat(F.lit(" "), "p.s", F.lit(" ")))
    ok = hits.where((F.col("f") != "") & (F.col("n") != "") & ((F.col("f") == F.col("n")) | run)).select(key, F.lit(True).alias("_ok")).distinct()
    status = F.when(F.col("cik").isNull(), "missing_cik").when(F.col("latest_accession").isNull(), "no_recent_13f").when(F.col("_ok"), "verified_13f").otherwise("company_mismatch")
    return c.join(ok, key, "left").withColumn("status", status).withColumn("source_url", index_url(F.col("cik"), F.col("latest_accession"))).withColumn("next_commands", next_commands(F.col("cik"))).drop("_ok")


def answer_json(answer: str) -> object:
    """The JSON in a model's answer: fenced, bare, or within other words."""
    for part in [*re.findall(r"```(?:json)?\s*(.*?)```", answer, re.S), answer, *re.findall(r"\[.*\]|\{.*\}", answer, re.S)]:
        try:
            return json.loads(part.strip())
        except ValueError:
            continue
    raise ValueError("no JSON in the answer")


def answered(question: str, ask: Callable[[str], str], most: int = 5) -> list[dict]:
    """Candidates that a model proposes: one repair of an answer without JSON, one more attempt at an empty one."""

    def read(prompt: str) -> list[dict]:
        answer = ask(prompt)
        try:
            found = answer_json(answer)
        except ValueError:
            found = answer_json(ask(f"Give only the JSON of this answer about {question!r}: {answer}"))
        found = found.get("candidates", []) if isinstance(found, dict) else found
        if not isinstance(found, list):
            raise ValueError("candidates are no list")
        return [c for c in found if isinstance(c, dict)]

    found = read(f"Give the filing managers of this name as a JSON array of candidates: {question}") or read(f"There was no candidate; think of other spellings and vehicles: {question}")
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    digits = lambda v: int(d) if (d := re.sub(r"\D", "", str(v))) and not isinstance(v, bool) and len(d) < 19 else None
    return [
        {"rank": i, "candidate_type": text(c.get("candidate_type")) or "filing_manager", "investor": text(c.get("investor")), "manager": text(c.get("manager")), "cik": None if c.get("cik") is None else digits(c["cik"]), "confidence": text(c.get("confidence")), "relationship": text(c.get("relationship")), "evidence_queries": [text(q) for q in c.get("evidence_queries") or []], "notes": text(c.get("notes"))}
        for i, c in enumerate(found[:most], 1)
    ]


CANDIDATE = "rank int, candidate_type string, investor string, manager string, cik long, confidence string, relationship string, evidence_queries array<string>, notes string, error string"


def candidates_udtf(ask: Callable[[str], str]):
    """A table function question -> candidates, with an injected model; executors ask, an answer that cannot be read is a row with its error."""
    from pyspark.sql.functions import udtf

    fields = [f.strip().split(" ")[0] for f in CANDIDATE.split(", ")]

    @udtf(returnType=CANDIDATE)
    class Candidates:
        def eval(self, question: str) -> Iterator[tuple]:
            if question is None or not question.strip():
                return
            try:
                rows = answered(question, ask)
            except (ValueError, KeyError, TypeError) as e:
                rows = [{"error": f"{type(e).__name__}: {e}"}]
            for r in rows:
                yield tuple(r.get(f) for f in fields)

    return Candidates


def resolve_questions(questions: DataFrame, ask: Callable[[str], str], companies: DataFrame, filings: DataFrame) -> DataFrame:
    """Validated candidates of a batch of questions (id, question): a lateral join with the table function, then joins.
    The model is asked once a question: its candidates are stored in the shared folder.

    A candidate that is not verified is looked up by its manager's, else its
    investor's name; the cik found replaces its own where that verifies.
    """
    spark = questions.sparkSession
    spark.udtf.register("filigree_candidates", candidates_udtf(ask))
    questions.createOrReplaceTempView("_filigree_questions")
    raw = spark.sql("SELECT q.id, q.question, c.* FROM _filigree_questions q, LATERAL filigree_candidates(q.question) c")
    raw = stored(raw, "candidates").where("error IS NULL").withColumn("row", F.struct("id", "rank"))
    first = stored(validated(raw, filings), "validated")
    wanted = first.where("status <> 'verified_13f'").select("row", F.posexplode(F.array("manager", "investor")).alias("place", "name")).where("name IS NOT NULL")
    found = manager_lookup(wanted.select(F.struct("row", "place").alias("id"), "name"), companies.join(latest_13f(filings).select("cik"), "cik", "left_semi")).where("cik IS NOT NULL")
    other = found.groupBy("id.row").agg(F.min_by("cik", "id.place").alias("other"))
    again = raw.join(other, "row").where("other IS DISTINCT FROM cik").withColumn("was", F.col("cik")).withColumn("cik", F.col("other")).drop("other")
    better = validated(again, filings).where("status = 'verified_13f'")
    note = F.concat(F.lit("Company search corrected the CIK from "), F.coalesce(F.col("was").cast("string"), F.lit("missing")), F.lit(" to "), F.col("cik").cast("string"), F.lit("."))
    better = better.withColumn("notes", F.when(F.trim(F.coalesce("notes", F.lit(""))) == "", note).otherwise(F.concat("notes", F.lit(" "), note))).drop("was")
    out = first.join(better.select("row"), "row", "left_anti").unionByName(better)
    return out.select("id", "question", "rank", "candidate_type", "investor", "manager", "cik", "confidence", "relationship", "notes", "status", "filer", "latest_accession", "latest_report_date", "latest_filing_date", "source_url", "next_commands")


def resolve_managers(queries: DataFrame, companies: DataFrame, filings: DataFrame) -> DataFrame:
    """Records of managers named outright (id, name): looked up among companies with a holdings report, confidence ``rule``."""
    f = latest_13f(filings)
    found = manager_lookup(queries, companies.join(f.select("cik"), "cik", "left_semi")).join(f, "cik", "left")
    return found.select("id", F.col("name").alias("query"), F.coalesce("filer", "name").alias("manager"), "cik", "how", F.lit("rule").alias("confidence"), F.when(F.col("cik").isNull(), "missing_cik").otherwise("verified_13f").alias("status"), "latest_accession", "latest_filing_date", next_commands(F.col("cik")).alias("next_commands"))
