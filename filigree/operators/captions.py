"""Captions of printed forms and their values, read in one pass over a plain text.

A caption's value is what follows it, up to the next caption, the next row or
paragraph mark of the form, or the next item. A caption in brackets, as on the
cover of a schedule, names what stands before it.
"""

from __future__ import annotations

import calendar
import re

from filigree.functions import texts as X

MONTHS = "|".join(calendar.month_name[1:])
DATE = re.compile(rf"\b(?:{MONTHS}) \d{{1,2}}, ?\d{{4}}\b", re.I)
NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?")


class Captions:
    """A reader of the captions of one form: field -> its captions."""

    def __init__(self, captions: dict[str, list[str]]):
        self.field = {c.lower(): f for f, cs in captions.items() for c in cs}
        longest = sorted(self.field, key=len, reverse=True)
        self.caption = re.compile("|".join(r"\s+".join(map(re.escape, c.split())) for c in longest), re.I)
        self.mark = re.compile(r"\([a-k]\)\s|(?<!\S)\d{1,2}\.\s|\bItem\s+\d", re.I)

    def read(self, text: str) -> dict[str, list[str]]:
        """All non-empty values of each field in order."""
        out: dict[str, list[str]] = {}
        found = list(self.caption.finditer(text))
        for i, m in enumerate(found):
            name = self.field[X.squeeze(m[0]).lower()]
            if text[max(0, m.start() - 1) : m.start()] == "(":
                begin = found[i - 1].end() if i else 0
                value = re.split(r"[()]", text[begin : m.start() - 1])[-1]
            else:
                end = found[i + 1].start() if i + 1 < len(found) else len(text)
                stop = self.mark.search(text, m.end(), end)
                value = text[m.end() : stop.start() if stop else end]
            if value := clean(value):
                out.setdefault(name, []).append(value)
        return out


def clean(value: str) -> str:
    """Up to a column rule, without the punctuation around it."""
    return X.squeeze(value.partition("|")[0]).strip(" :.;,()")


def figure(values: list[str], percent: bool = False) -> float | None:
    """The first number of the first value that has one; with ``percent`` one before a percent sign."""
    for v in values:
        for m in NUMBER.finditer(v):
            if not percent or v[m.end() :].lstrip().startswith("%"):
                return float(m[0].replace(",", ""))
    return None


def date_after(text: str, phrase: str, reach: int) -> str | None:
    """The first date in the sentence of the phrase, at most ``reach`` characters after it."""
    for m in X.phrase(phrase).finditer(text):
        if d := DATE.search(text[m.end() : m.end() + reach].partition(". ")[0]):
            return d[0]
    return None


def numbered(text: str) -> list[tuple[int, str]]:
    """Entries of a list numbered 1, 2, 3, ...: each runs to the next number of the sequence."""
    marks: list[re.Match] = []
    for m in re.finditer(r"(?<![\w.$-])(\d{1,2})[.)]?\s+(?=\S)", text):
        if int(m[1]) == len(marks) + 1:
            marks.append(m)
    ends = [m.start() for m in marks[1:]] + [len(text)]
    return [(int(m[1]), X.squeeze(text[m.end() : e])) for m, e in zip(marks, ends, strict=False)]


def spans(text: str, highest: int, least_bytes: int = 16) -> dict[int, str]:
    """The first long enough span of each item."""
    heads = [m for m in re.finditer(r"\bitem\s+(\d{1,2})(?=\s*[.:(])", text, re.I) if 1 <= int(m[1]) <= highest]
    out: dict[int, str] = {}
    for m, end in zip(heads, [h.start() for h in heads[1:]] + [len(text)], strict=False):
        body = text[m.start() : end].strip()
        if len(body.encode()) >= least_bytes:
            out.setdefault(int(m[1]), body)
    return out


def signatures(text: str) -> list[str]:
    """Names that follow /s/; a name printed again under its line counts once."""
    out = []
    for part in text.split("/s/")[1:]:
        name: list[str] = []
        for word in part.split()[:12]:
            if word.endswith(":") or word in ("Page", "Date", "Item") or not (word[0].isupper() or word in ("de", "van", "von", "&")):
                break
            name.append(word)
        half = len(name) // 2
        if name and len(name) % 2 == 0 and name[:half] == name[half:]:
            name = name[:half]
        if v := clean(" ".join(name)):
            out.append(v)
    return X.unique(out)


def token_after(text: str, phrases: list[str], shape: str) -> str | None:
    """The first word after one of the phrases, quotes and colons aside, if it has the shape."""
    for p in phrases:
        for m in () if X.lacks(text, p) else X.phrase(p).finditer(text):
            word = text[m.end() : m.end() + 40].lstrip(' :"“').split(" ")[0].rstrip('.,;:")”')
            if re.fullmatch(shape, word):
                return word
    return None


def money_after(text: str, phrases: list[str], reach: int) -> str | None:
    """The first dollar amount after one of the phrases."""
    for p in phrases:
        for m in () if X.lacks(text, p) else X.phrase(p).finditer(text):
            part = text[m.end() : m.end() + reach]
            at = part.find("$")
            if at >= 0 and (n := NUMBER.match(part, at + 1)):
                return "$" + n[0].rstrip(",")
    return None
