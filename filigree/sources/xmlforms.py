"""Parsers of XML forms: ownership reports, information tables, fund reports, linkbases, inline facts."""

from __future__ import annotations

import functools
import re
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame

from filigree.sources.parse import parsed


@functools.lru_cache(1 << 12)
def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def root_of(text: str) -> ET.Element:
    """The root element, after anything before the first tag, namespaces or not."""
    body = text[max(text.find("<"), 0) :].strip()
    body = re.sub(r"^\s*<xml>\s*|\s*</xml>\s*$", "", body, flags=re.I)
    body = re.sub(r"&(?!#?\w+;)", "&amp;", body)
    try:
        return ET.fromstring(body)
    except ET.ParseError as e:
        raise ValueError(f"malformed XML: {e}") from e


def find(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        if e is None:
            return None
        for c in e:
            if local(c.tag) == name:
                e = c
                break
        else:
            return None
    return e


def every(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [c for c in e.iter() if local(c.tag) == name] if e is not None else []


def text(e: ET.Element | None, *path: str) -> str | None:
    return held(find(e, *path))


def held(x: ET.Element | None) -> str | None:
    """The text of an element, or of the value in it."""
    if x is None:
        return None
    if not len(x):
        return " ".join(x.text.split()) or None if x.text else None
    v = find(x, "value")
    return " ".join("".join((v if v is not None else x).itertext()).split()) or None


def named(e: ET.Element) -> dict[str, ET.Element]:
    """The first child of each name, for records of which many are read."""
    out: dict[str, ET.Element] = {}
    for c in e:
        out.setdefault(local(c.tag), c)
    return out


def number(s: str | None) -> float | None:
    try:
        return float(s.replace(",", "")) if s else None
    except ValueError:
        return None


def whole(s: str | None) -> int | None:
    n = number(s)
    return None if n is None else int(n)


def flag(s: str | None) -> bool | None:
    return {"1": True, "true": True, "0": False, "false": False}.get((s or "").strip().lower())


def form4(content: str) -> list[dict]:
    """Transactions; each carries the first owner that was closed before it."""
    r = root_of(content)
    owner: dict = {}
    out = []
    common = {"period_of_report": text(r, "periodOfReport"), "issuer_cik": text(r, "issuer", "issuerCik"), "issuer_name": text(r, "issuer", "issuerName"), "issuer_symbol": text(r, "issuer", "issuerTradingSymbol")}
    for e in r:
        if local(e.tag) == "reportingOwner" and not owner:
            rel = find(e, "reportingOwnerRelationship")
            owner = {"owner_cik": text(e, "reportingOwnerId", "rptOwnerCik"), "owner_name": text(e, "reportingOwnerId", "rptOwnerName"), "is_director": flag(text(rel, "isDirector")), "is_officer": flag(text(rel, "isOfficer")), "is_ten_percent_owner": flag(text(rel, "isTenPercentOwner")), "officer_title": text(rel, "officerTitle")}
        for t in e if local(e.tag) in ("nonDerivativeTable", "derivativeTable") else ():
            if local(t.tag) not in ("nonDerivativeTransaction", "derivativeTransaction"):
                continue
            a, c = find(t, "transactionAmounts"), find(t, "transactionCoding")
            out.append(common | owner | {
                "pos": len(out), "derivative": local(t.tag) == "derivativeTransaction", "security_title": text(t, "securityTitle"), "transaction_date": text(t, "transactionDate"), "code": text(c, "transactionCode"),
                "shares": number(text(a, "transactionShares")), "price": number(text(a, "transactionPricePerShare")), "acquired_disposed": text(a, "transactionAcquiredDisposedCode"),
                "shares_after": number(text(t, "postTransactionAmounts", "sharesOwnedFollowingTransaction")), "ownership": text(t, "ownershipNature", "directOrIndirectOwnership"),
                "exercise_price": number(text(t, "conversionOrExercisePrice")), "underlying_title": text(t, "underlyingSecurity", "underlyingSecurityTitle"), "underlying_shares": number(text(t, "underlyingSecurity", "underlyingSecurityShares")),
            })
    return out


FORM4 = "period_of_report string, issuer_cik string, issuer_name string, issuer_symbol string, owner_cik string, owner_name string, is_director boolean, is_officer boolean, is_ten_percent_owner boolean, officer_title string, pos int, derivative boolean, security_title string, transaction_date string, code string, shares double, price double, acquired_disposed string, shares_after double, ownership string, exercise_price double, underlying_title string, underlying_shares double"


def information_table(content: str) -> list[dict]:
    out = []
    for e in every(root_of(content), "infoTable"):
        x = named(e)
        get, amount, votes = x.get, x.get("shrsOrPrnAmt"), x.get("votingAuthority")
        out.append({
            "pos": len(out), "issuer": held(get("nameOfIssuer")), "class": held(get("titleOfClass")), "cusip": held(get("cusip")), "value": whole(held(get("value"))), "shares": number(text(amount, "sshPrnamt")), "shares_type": text(amount, "sshPrnamtType"),
            "put_call": held(get("putCall")), "discretion": held(get("investmentDiscretion")), "other_manager": held(get("otherManager")), "voting_sole": number(text(votes, "Sole")), "voting_shared": number(text(votes, "Shared")), "voting_none": number(text(votes, "None")),
        })
    return out


HOLDINGS = "pos int, issuer string, class string, cusip string, value long, shares double, shares_type string, put_call string, discretion string, other_manager string, voting_sole double, voting_shared double, voting_none double"


def iso(d: str | None) -> str | None:
    m = re.fullmatch(r"(\d{2})-(\d{2})-(\d{4})", d or "")
    return f"{m[3]}-{m[1]}-{m[2]}" if m else d


def report_summary(content: str) -> list[dict]:
    r = root_of(content)
    first = lambda n: next((x for e in every(r, n) if (x := " ".join("".join(e.itertext()).split()))), None)
    manager = next(iter(every(r, "filingManager")), None)
    sign = next(iter(every(r, "signatureBlock")), None)
    return [{
        "report_date": iso(first("reportCalendarOrQuarter") or first("periodOfReport")), "report_type": first("reportType"), "manager": text(manager, "name"), "city": text(manager, "address", "city"), "state": text(manager, "address", "stateOrCountry"),
        "other_managers_count": whole(first("otherIncludedManagersCount")), "entry_total": whole(first("tableEntryTotal")), "value": whole(first("tableValueTotal")), "signer": text(sign, "name"), "signature_date": iso(text(sign, "signatureDate")),
        "other_managers": [text(e, "otherManager", "name") or "" for e in every(r, "otherManager2")],
    }]


SUMMARY = "report_date string, report_type string, manager string, city string, state string, other_managers_count long, entry_total long, value long, signer string, signature_date string, other_managers array<string>"


def fund_report(content: str, limit: int | None = None) -> list[dict]:
    by: dict[str, list[ET.Element]] = {}
    for e in root_of(content).iter():
        by.setdefault(local(e.tag), []).append(e)
    first = lambda *names: next((x for n in names for e in by.get(n, ()) if (x := " ".join("".join(e.itertext()).split()))), None)
    yes = lambda s: {"true": True, "yes": True, "y": True, "1": True, "false": False, "no": False, "n": False, "0": False}.get((s or "").lower())
    holdings = [{
        "name": held(x.get("name")), "title": held(x.get("title")), "cusip": held(x.get("cusip")), "lei": held(x.get("lei")), "balance": number(held(x.get("balance"))), "units": held(x.get("units")), "currency": held(x.get("curCd")), "value_usd": number(held(x.get("valUSD"))),
        "percent": number(held(x.get("pctVal"))), "asset_category": held(x.get("assetCat")), "country": held(x.get("invCountry")), "restricted": yes(held(x.get("isRestrictedSec"))), "liquidity": held(x.get("liquidityCat")),
    } for x in map(named, by.get("invstOrSec", ()))]
    votes = [{"issuer": text(e, "issuerName"), "cusip": text(e, "cusip"), "meeting_date": text(e, "meetingDate"), "matter": text(e, "matter"), "vote": text(e, "voteCast"), "recommendation": text(e, "managementRecommendation"), "shares": number(text(e, "sharesVoted"))} for e in [*by.get("proxyVote", ()), *by.get("proxyTable", ())]]
    holdings = holdings[:limit] if limit is not None else holdings
    return [{"registrant": first("regName", "registrantName"), "series": first("seriesName"), "class_name": first("className"), "period_end": first("repPdEnd", "periodEnd"), "fiscal_year_end": first("fiscalYrEnd", "fiscalYearEnd"), "total_assets": number(first("totAssets")), "total_liabilities": number(first("totLiabs")), "net_assets": number(first("netAssets")), "holdings_count": len(holdings), "votes_count": len(votes), "holdings": holdings, "proxy_votes": votes}]


FUND = "registrant string, series string, class_name string, period_end string, fiscal_year_end string, total_assets double, total_liabilities double, net_assets double, holdings_count long, votes_count long, holdings array<struct<name:string,title:string,cusip:string,lei:string,balance:double,units:string,currency:string,value_usd:double,percent:double,asset_category:string,country:string,restricted:boolean,liquidity:string>>, proxy_votes array<struct<issuer:string,cusip:string,meeting_date:string,matter:string,vote:string,recommendation:string,shares:double>>"


def linkbase(content: str) -> list[dict]:
    """Arcs, label links and element declarations of one linkbase or schema document."""
    concept = lambda href: href.rsplit("#", 1)[-1].replace("_", ":") if href else None
    out = []
    for e in every(root_of(content), "element"):
        if (name := e.get("name")) is not None:
            out.append({"linkbase": "schema", "relationship": "element", "child": e.get("id", name).replace("_", ":"), "label": e.get("type")})
    kinds = {"presentationLink": ("presentation", "presentationArc"), "calculationLink": ("calculation", "calculationArc"), "definitionLink": ("definition", "definitionArc"), "labelLink": ("label", "labelArc")}
    for link in root_of(content).iter():
        kind = kinds.get(local(link.tag))
        if kind is None:
            continue
        a = lambda x: {local(k): v for k, v in x.attrib.items()}
        role, locs, labels = a(link).get("role"), {}, {}
        for x in link:
            at = a(x)
            if local(x.tag) == "loc":
                locs[at.get("label")] = concept(at.get("href"))
            elif local(x.tag) == "label":
                labels.setdefault(at.get("label"), []).append((at.get("role"), " ".join("".join(x.itertext()).split())))
        for x in link:
            if local(x.tag) != kind[1]:
                continue
            at = a(x)
            row = {"linkbase": kind[0], "role": role, "relationship": at.get("arcrole"), "ord": number(at.get("order")), "weight": number(at.get("weight")), "preferred_label": at.get("preferredLabel")}
            if kind[0] == "label":
                out += [row | {"child": locs.get(at.get("from")), "label": v, "label_role": r} for r, v in labels.get(at.get("to"), [])]
            else:
                out.append(row | {"parent": locs.get(at.get("from")), "child": locs.get(at.get("to"))})
    return [x | {"pos": i} for i, x in enumerate(out)]


LINKS = "pos int, linkbase string, role string, relationship string, parent string, child string, ord double, weight double, preferred_label string, label string, label_role string"

_IX = re.compile(r"<(/?)(?:[\w.-]+:)?(nonFraction|nonNumeric)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
_XATTR = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def inline_facts(content: str) -> list[dict]:
    """Inline facts in order of their start; nested ones are kept, each with its own text."""
    import html

    open_: list[tuple[int, int, dict]] = []
    out: list[dict] = []
    for m in _IX.finditer(content):
        if not m[1]:
            at = {k.lower(): html.unescape(v or w or "") for k, v, w in _XATTR.findall(m[3])}
            out.append({})
            if m[3].rstrip().endswith("/"):
                out[-1] = _inline(at, m[2], "", len(out) - 1)
            else:
                open_.append((len(out) - 1, m.end(), at | {"_": m[2]}))
        elif open_:
            i, start, at = open_.pop()
            body = " ".join(html.unescape(re.sub(r"<[^>]*>", "", content[start : m.start()])).split())
            out[i] = _inline(at, at["_"], body, i)
    return [x for x in out if x]


def _inline(at: dict, kind: str, body: str, pos: int) -> dict:
    name = at.get("name", "")
    scale = whole(at.get("scale"))
    value = number(body.replace("$", "").replace(",", "")) if kind.lower() == "nonfraction" else None
    if value is not None:
        value = value * 10.0 ** (scale or 0) * (-1 if at.get("sign") == "-" else 1)
    return {"pos": pos, "name": name, "namespace": name.split(":")[0] if ":" in name else None, "local_name": name.rsplit(":", 1)[-1], "context_ref": at.get("contextref"), "unit_ref": at.get("unitref"), "scale": scale, "decimals": at.get("decimals"), "sign": at.get("sign"), "fact_id": at.get("id"), "value": body, "numeric_value": value}


INLINE = "pos int, name string, namespace string, local_name string, context_ref string, unit_ref string, scale int, decimals string, sign string, fact_id string, value string, numeric_value double"


def parse_column(docs: DataFrame, keys: list[str], kind: str, content: str = "content") -> DataFrame:
    """Rows of one of the parsers above: form4, holdings, summary, fund, links or inline."""
    parser, schema = {"form4": (form4, FORM4), "holdings": (information_table, HOLDINGS), "summary": (report_summary, SUMMARY), "fund": (fund_report, FUND), "links": (linkbase, LINKS), "inline": (inline_facts, INLINE)}[kind]
    return parsed(docs, keys, content, parser, schema)
