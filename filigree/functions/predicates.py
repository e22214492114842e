"""Predicates of the domain as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filigree.functions.catalogue import EIGHTK_ITEMS, FORM_FAMILIES, alias_concepts
from filigree.functions.scalars import normalize_concept


def form_is(form: Column, wanted: str | None, amendments: bool = False) -> Column:
    """Case-insensitive; with ``amendments`` also the form followed by /A; no filter passes all."""
    if wanted is None:
        return F.lit(True)
    names = [wanted.upper(), f"{wanted.upper()}/A"] if amendments else [wanted.upper()]
    return F.upper(form).isin(*names)


def date_in(date: Column, start: str | None = None, end: str | None = None) -> Column:
    """Inclusive; a date that can't be parsed passes."""
    d = F.try_to_date(date, "yyyy-MM-dd")
    ok = F.lit(True)
    if start:
        ok = ok & (d >= F.lit(start).cast("date"))
    if end:
        ok = ok & (d <= F.lit(end).cast("date"))
    return d.isNull() | ok


def concept_is(query: str, concept: Column, label: Column | None = None) -> Column:
    """A known short name means its concepts only; else a part of the concept or label."""
    known = alias_concepts(query)
    if known is not None:
        return F.lower(concept).isin(*[c.lower() for c in known])
    part = F.lit(query.rsplit(":", 1)[-1].lower())
    hit = F.contains(F.lower(concept), part)
    return hit if label is None else hit | F.coalesce(F.contains(F.lower(label), part), F.lit(False))


def unit_is(unit: Column, wanted: str | None) -> Column:
    return F.lit(True) if wanted is None else F.lower(unit) == wanted.lower()


def part_of(x: Column, wanted: str | None) -> Column:
    return F.lit(True) if wanted is None else F.contains(F.lower(x), F.lit(wanted.lower()))


def xbrl_concept_is(value: Column, wanted: str | None) -> Column:
    return F.lit(True) if wanted is None else F.contains(normalize_concept(value), normalize_concept(F.lit(wanted)))


def inline_concept_is(name: Column, wanted: str | None) -> Column:
    """Full name if the filter has a prefix, else the local name."""
    if wanted is None:
        return F.lit(True)
    return F.lower(name if ":" in wanted else F.substring_index(name, ":", -1)) == wanted.lower()


def family_forms(kind: str) -> list[str]:
    return next(forms for k, _, forms, _ in FORM_FAMILIES if k == kind)


def in_family(form: Column, kind: str) -> Column:
    hit = F.upper(F.trim(form)).isin(*family_forms(kind))
    return hit | F.upper(F.trim(form)).startswith("424B") if kind == "prospectus" else hit


def known_item(item: Column) -> Column:
    return item.isin(*EIGHTK_ITEMS)


def is_exhibit(document_type: Column) -> Column:
    return F.coalesce(F.upper(F.trim(document_type)).startswith("EX-"), F.lit(False))


def topic_is(topic: Column, wanted: str | None) -> Column:
    return F.lit(True) if wanted is None else F.contains(topic, F.lit(wanted.strip().lower().replace("-", "_")))


def schedule13_forms(form: str | None) -> list[str]:
    if form is None or form.lower() == "all":
        return ["SC 13D", "SC 13G"]
    name = form.upper().replace("SCHEDULE ", "SC ").replace("SC13", "SC 13")
    name = name if name.startswith("SC ") else f"SC {name}"
    if name.removesuffix("/A") not in ("SC 13D", "SC 13G"):
        raise ValueError(f"unsupported schedule {form!r}")
    return [name]
