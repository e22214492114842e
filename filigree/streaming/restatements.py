"""Restatements as a stream: the best report of each statement line and period, revised as filings arrive.

A keyed state holds, for each company and line, the concept in use and for every
period the best report so far, the forms that reported it and how many did. A
filing that brings a better report (an amendment's annual report after an interim
one, a later filing of equal rank) emits a restatement with the former value; a
concept of higher priority replaces the line's periods. Events carry a version,
so the newest of each period is the current statement, whatever the order and the
batches in which filings came.

State grows with companies, lines and periods, not with filings. Defined results:
a period is the end date, else the filing date, else ``unknown``; nulls rank last
among dates and accessions; rows of concepts without a line are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from filigree.plans.statements import form_rank, line_table

_REPORT = "taxonomy string, priority int, rank int, concept string, form string, fp string, filed string, end string, accession string, unit string, pos int, value string, numeric_value double"
EVENTS = "cik long, statement string, line_item string, period string, version int, change string, concept string, form string, fp string, filed string, end string, accession string, numeric_value double, previous_form string, previous_value double, source_count int, duplicate_forms string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _text(v) -> str | None:
    return None if v is None or v != v else str(v)


def _order(r: dict) -> tuple:
    """Smaller is better: rank, then newest first; texts are compared through their negated code points."""
    down = lambda s: (s is None, tuple(-ord(c) for c in s) + (1,) if s is not None else ())
    up = lambda s: (s is not None, s or "")
    return r["rank"], down(r["filed"]), down(r["end"]), down(r["accession"]), up(r["unit"]), -r["pos"], up(r["value"])


class BestReports(StatefulProcessor):
    FIELDS = [f.split(" ")[0] for f in _REPORT.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.concept = handle.getValueState("concept", "taxonomy string, priority int")
        self.periods = handle.getMapState("periods", "period string", f"{_REPORT}, version int, live boolean, source_count int, forms string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reports = [{"period": _text(r["period"]), **{f: _text(r[f]) if f not in ("priority", "rank", "pos", "numeric_value") else r[f] for f in self.FIELDS}} for part in rows for r in part.to_dict("records")]
        of = lambda r: (r["taxonomy"] is not None, r["taxonomy"] or "", int(r["priority"]))
        chosen = self.concept.get()
        current = (chosen[0] is not None, chosen[0] or "", int(chosen[1])) if chosen is not None else None
        best = min(map(of, reports))
        names = [*self.FIELDS, "version", "live", "source_count", "forms"]
        held: dict[str, dict] = {}
        before: dict[str, dict | None] = {}

        def load(period: str) -> dict | None:
            if period not in before:
                row = self.periods.getValue((period,)) if self.periods.containsKey((period,)) else None
                before[period] = dict(zip(names, row, strict=True)) if row is not None else None
                if before[period] is not None:
                    held[period] = dict(before[period])
            return held.get(period)

        if current is None or best < current:
            # A concept of higher priority: what the line held belongs to another one.
            for (period,) in list(self.periods.keys()):
                load(period)
                held[period] |= {"live": False, "source_count": 0, "forms": ""}
            current = best
            self.concept.update((best[1] if best[0] else None, best[2]))
        for r in reports:
            if of(r) != current:
                continue
            p = load(r["period"])
            forms = set((p or {}).get("forms", "").split("\n")) - {""} if p else set()
            count, live = (p["source_count"], p["live"]) if p else (0, False)
            if not live or _order(r) < _order(p):
                p = {f: r[f] for f in self.FIELDS} | {"version": p["version"] if p else 0}
            held[r["period"]] = p | {"live": True, "source_count": count + 1, "forms": "\n".join(sorted(forms | {r["form"] or ""} - {""}))}
        out = []
        for period, p in held.items():
            was = before.get(period)
            if was == p:
                continue
            p["version"] += 1
            if not p["live"]:
                change = "withdrawn"
            elif was is None or not was["live"]:
                change = "new"
            else:
                change = "confirmed" if _order(was) == _order(p) else "restated"
            self.periods.updateValue((period,), tuple(p[n] for n in names))
            former = was if was is not None and was["live"] else {}
            out.append({"cik": key[0], "statement": key[1], "line_item": key[2], "period": period, "change": change, "previous_form": former.get("form"), "previous_value": former.get("numeric_value"), "duplicate_forms": p["forms"].replace("\n", ",")} | {c: p[c] for c in ("version", "concept", "form", "fp", "filed", "end", "accession", "numeric_value", "source_count")})
        if out:
            yield pd.DataFrame(out)[[f.split(" ")[0] for f in EVENTS.split(", ")]]

    def close(self) -> None:
        pass


def restatements(facts: DataFrame, statement: str = "all") -> DataFrame:
    """Events of a stream (or table) of facts; see ``filigree.plans.statements`` for its columns."""
    spark = facts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    lines = line_table(spark, statement).select("statement", "line_item", "concept", "priority")
    rows = facts.join(F.broadcast(lines), "concept").withColumn("period", F.coalesce("end", "filed", F.lit("unknown"))).withColumn("rank", form_rank())
    rows = rows.select("cik", "statement", "line_item", "period", "taxonomy", "priority", F.col("rank").cast("int").alias("rank"), "concept", "form", "fp", "filed", "end", "accession", "unit", F.col("pos").cast("int").alias("pos"), F.col("value").cast("string").alias("value"), "numeric_value")
    return rows.groupBy("cik", "statement", "line_item").transformWithStateInPandas(statefulProcessor=BestReports(), outputStructType=EVENTS, outputMode="Append", timeMode="None")


def current(events: DataFrame) -> DataFrame:
    """The statement rows that the events amount to."""
    cols = [f.split(" ")[0] for f in EVENTS.split(", ")]
    key = ["cik", "statement", "line_item", "period"]
    last = events.groupBy(*key).agg(F.max_by(F.struct(*[c for c in cols if c not in key]), "version").alias("_e")).select(*key, "_e.*")
    return last.where("change <> 'withdrawn'")
