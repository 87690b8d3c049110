"""Dates of infoboxes that are written in templates: these are evaluated, inner ones first, and the prose is read by the date grammar."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from chronika.functions import dates, text

NAMES = [m.capitalize() for m in dates.MONTHS]
DASH = " – "
#: Fixed: names of templates by what they stand for, in lower case with blanks.
DASHES = ("snd", "spnd", "ndash", "mdash", "spaced ndash", "spaced en dash", "en dash")
LISTS = ("ubl", "ublist", "unbulleted list", "plainlist", "plain list", "hlist", "flatlist", "flat list")
WRAPPERS = ("nowrap", "nobold", "small", "smaller", "big", "larger", "lang")
TOKEN = re.compile(r"\{\{|\}\}|\[\[|\]\]|\||=")


class Call:
    """A template while it is read: the pieces of its arguments, and where each one's first own '=' stands."""

    def __init__(self) -> None:
        self.args: list[list[str]] = [[]]
        self.cuts: list[int] = [-1]
        self.links = 0

    def result(self) -> str:
        name = re.sub(r"[\s_]+", " ", "".join(self.args[0])).strip().lower()
        placed, named = [], {}
        for pieces, cut in zip(self.args[1:], self.cuts[1:]):
            key, value = ("", "".join(pieces)) if cut < 0 else ("".join(pieces[:cut]).strip(), "".join(pieces[cut + 1 :]))
            if not key or key.lstrip("-").isdigit():
                placed.append((value.strip(), cut < 0))
            else:
                named[key.lower()] = value.strip()
        return evaluated(name, placed, named)


def number(value: str) -> int | None:
    return int(value) if re.fullmatch(r"[+-]?\d{1,9}", value.strip()) else None


def told(parts: list[int]) -> str:
    """Year, month and day as far as they are given and valid: '4 June 1937', 'June 1937', '1937'."""
    if not parts:
        return ""
    year, month, day = (*parts, 0, 0)[:3]
    if not 1 <= month <= 12:
        return str(year)
    return f"{day} {NAMES[month - 1]} {year}" if 1 <= day <= 31 else f"{NAMES[month - 1]} {year}"


def span(parts: list[int]) -> str:
    """Two days; what they share is said once if they stand in order."""
    first, last = parts[:3], parts[3:6]
    valid = all(1 <= y <= 9999 and 1 <= m <= 12 and 1 <= d <= 31 for y, m, d in (first, last)) and first <= last
    if valid and first == last:
        return told(first)
    if valid and first[:2] == last[:2]:
        return f"{first[2]}{DASH}{told(last)}"
    if valid and first[0] == last[0]:
        return f"{first[2]} {NAMES[first[1] - 1]}{DASH}{told(last)}"
    return told(first) + DASH + told(last)


def named_span(named: dict[str, str]) -> str:
    ends = []
    for i in "12":
        parts: list[int] = []
        for k in ("year", "month", "day"):
            n = number(named.get(k + i, ""))
            if n is None:
                break
            parts.append(n)
        ends.append(told(parts))
    return ends[0] if ends[1] in ("", ends[0]) else DASH.join(ends)


def evaluated(name: str, placed: list[tuple[str, bool]], named: dict[str, str]) -> str:
    """What a template shows of a date; '' for those that show none. placed: values and whether they came without a key."""
    texts = [v for v, _ in placed]
    numbers = [n for v, bare in placed if bare and (n := number(v)) is not None]
    if name in DASHES:
        return DASH
    if re.fullmatch(r"(?:start|end) date(?: and age)?", name):
        return told(numbers)
    if name == "date":
        day = re.match(r"(-?\d{3,4})-(\d{1,2})(?:-(\d{1,2}))?", texts[0] if texts else "")
        return told([int(g) for g in day.groups() if g]) if day else ""
    if name == "start and end dates" or name.startswith("date range"):
        if numbers:
            return span(numbers) if len(numbers) >= 6 else told(numbers)
        return named_span(named) if "year1" in named else ""
    if name == "oldstyledate" and len(texts) >= 2:
        return f"{texts[0]} {texts[1]}"
    if name in LISTS:
        lines = (re.sub(r"\s*\([^()0-9]*\)", "", line.strip().lstrip("*#")).strip() for t in texts for line in t.split("\n"))
        return DASH.join(filter(None, lines))
    if name in WRAPPERS and texts:
        return texts[-1]
    return ""


def without_templates(value: str | None) -> str:
    """The text with its templates evaluated; one that is cut open ends the text, closing braces without an opening go.

    One pass over the text with a stack, so its time follows its length.
    """
    raw = value or ""
    if "{{" not in raw and "}}" not in raw:
        return raw
    open_: list[Call] = []
    out: list[str] = []
    at = 0
    put: Callable[[str], None] = lambda s: open_[-1].args[-1].append(s) if open_ else out.append(s)
    for m in TOKEN.finditer(raw):
        put(raw[at : m.start()])
        at, mark = m.end(), m[0]
        top = open_[-1] if open_ else None
        if mark == "{{":
            open_.append(Call())
        elif mark == "}}":
            if open_:
                shown = open_.pop().result()
                put(shown)
        elif top and mark == "|" and not top.links:
            top.args.append([])
            top.cuts.append(-1)
        elif top and mark == "=" and not top.links:
            if top.cuts[-1] < 0:
                top.cuts[-1] = len(top.args[-1])
            put(mark)
        else:
            if top:
                top.links = max(0, top.links + {"[[": 1, "]]": -1}.get(mark, 0))
            put(mark)
    if not open_:
        out.append(raw[at:])
    return "".join(out)


def evaluate(value: Column) -> Column:
    """without_templates of a column, by Arrow batches."""
    return F.pandas_udf(lambda s: pd.Series([without_templates(x) for x in s], dtype=object), "string")(value)


def infobox_prose(value: Column) -> Column:
    """struct(display, start, end, year) of an infobox's date in prose or templates; null if it names no year.

    year is the first that it names. The range is that of the grammar, else the year; it starts within that year.
    """
    plain = F.regexp_replace(text.clean_wikitext(evaluate(value)), r"[ ,;()]+$", "")
    plain = dates.let(plain, lambda s: F.when(F.regexp_count(s, F.lit(r"\(")) < F.regexp_count(s, F.lit(r"\)")), F.trim(F.replace(s, F.lit(")"), F.lit("")))).otherwise(s))

    def ranged(s: Column, year: Column) -> Column:
        def within(r: Column) -> Column:
            late = (year > 0) & ~F.startswith(r["start"], F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-")))
            return F.struct(s.alias("display"), F.when(late, dates.iso(year, F.lit(1), F.lit(1))).otherwise(r["start"]).alias("start"), r["end"].alias("end"), year.alias("year"))

        given = dates.let(dates.parse_range(s, year), lambda r: F.when(r["start"] == "", dates.year_span(year)).otherwise(r))
        return dates.let(given, within)

    def read(s: Column) -> Column:
        first = F.try_element_at(dates.candidate_years(s), F.lit(1))
        return dates.let(first, lambda year: F.when((s != "") & year.isNotNull(), ranged(s, year)))

    return dates.let(dates.normalize_display(plain), read)
