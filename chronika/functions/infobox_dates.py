"""Dates of infoboxes: a second, stricter reading that tells why it refuses a text.

It shares the kinds of words with functions.dates, but only takes forms with a month or a season, tries every place of a
form until one is valid, and shows what it read with the month first.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronika.functions.dates import MONTHS, iso, kind, let, month_number, places

SEASONS = ("spring", "summer", "autumn", "fall", "winter")
#: Fixed, in order: what is read first. S a season; slashes count as dashes, a comma may join two days of different months.
FORMS = ("DMY-DMY", "MDY-MDY", "MY-DMY", "DMY-MY", "DM-DMY", "DM,DMY", "MD-MDY", "MD,MDY", "D-DMY", "MD-DY", "DMY", "MDY", "MY-MY", "M-MY", "SY", "MY")
RESULT = "struct<display:string,start:string,year:int,end_year:int,reason:string>"
FORM = "struct<kinds:string,y1:int,m1:int,d1:int,y2:int,m2:int,d2:int,span:boolean>"


def forms() -> Column:
    keys = ("kinds", "y1", "m1", "d1", "y2", "m2", "d2", "span")
    rows = [dict(zip(keys, (f, *places(f.replace("S", "M")), "-" in f or "," in f))) for f in FORMS]
    return F.from_json(F.lit(json.dumps(rows)), f"array<{FORM}>")


def refused(reason: str) -> Column:
    nothing = F.struct(F.lit("").alias("display"), F.lit("").alias("start"), F.lit(0).alias("year"), F.lit(0).alias("end_year"), F.lit(reason).alias("reason"))
    return nothing.cast(RESULT)


def shown(p: Column) -> Column:
    """What was read, month first: a shared year once, days of one month as a range."""
    text = lambda c: c.cast("string")
    day = lambda month, d: F.when(d > 0, F.concat(month, F.lit(" "), text(d))).otherwise(month)
    dated = lambda month, d, y: F.concat(day(month, d), F.when(d > 0, ", ").otherwise(" "), text(y))
    one = dated(p["m1"], p["d1"], p["y1"])
    days = F.concat(p["m1"], F.lit(" "), text(p["d1"]), F.lit("–"), text(p["d2"]), F.lit(", "), text(p["y1"]))
    year = F.concat(day(p["m1"], p["d1"]), F.lit(" – "), dated(p["m2"], p["d2"], p["y2"]))
    years = F.concat(one, F.lit(" – "), dated(p["m2"], p["d2"], p["y2"]))
    same_month = (p["y1"] == p["y2"]) & (p["m1"] == p["m2"]) & (p["d1"] > 0) & (p["d2"] > 0)
    return F.when(~p["span"], one).when(same_month, days).when(p["y1"] == p["y2"], year).otherwise(years)


def infobox_date(text: Column) -> Column:
    """struct(display, start, year, end_year, reason) of an infobox's date.

    start is an ISO day or '' if the first end names none; end_year is 0 unless the ends lie in different years. reason is
    '' or why nothing was read: bc-date, bare-year, unparsed. Days of one month must rise.
    """
    plain = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^(?:c\.|ca\.|circa|about|approx\.?|approximately|on|ad)\s+", "")
    plain = F.regexp_replace(plain, r"(?<=\b\d{1,2})(?:st|nd|rd|th)\b", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?i)\bsept\b", "sep"), r"(?i)(?<=[a-z])\.|,(?=\s*\d{3,4}(?!\d))|\bof\b", " ")
    words = F.regexp_extract_all(F.lower(plain), F.lit(r"[a-z]+|[0-9]+|\S"), 0)

    def kinds(w: Column) -> Column:
        return F.array_join(F.transform(w, lambda x: F.when(x.isin(*SEASONS), "S").when(x.isin("/", "—", "−"), "-").otherwise(kind(x))), "")

    names = F.array(*(F.lit(m.capitalize()) for m in MONTHS))

    def read(seen: Column) -> Column:
        w, k = seen["words"], seen["kinds"]

        def at(f: Column, skip: Column) -> Column:
            word = lambda place: F.when(place > 0, F.try_element_at(w, skip + place))
            number = lambda place: F.coalesce(word(place).cast("int"), F.lit(0))
            season = F.startswith(f["kinds"], F.lit("S"))
            month = lambda place: F.when(season, F.initcap(word(place))).otherwise(F.try_element_at(names, month_number(word(place))))
            parts = F.struct(number(f["y1"]).alias("y1"), month(f["m1"]).alias("m1"), number(f["d1"]).alias("d1"), number(f["y2"]).alias("y2"), month(f["m2"]).alias("m2"), number(f["d2"]).alias("d2"), f["span"].alias("span"), month_number(word(f["m1"])).alias("n1"))

            def checked(p: Column) -> Column:
                day_ok = lambda place, d: (place == 0) | d.between(1, 31)
                rising = ~(p["span"] & (p["y1"] == p["y2"]) & (p["m1"] == p["m2"]) & (p["d1"] > 0) & (p["d2"] > 0)) | (p["d1"] < p["d2"])
                ok = p["m1"].isNotNull() & p["m2"].isNotNull() & (p["y1"] > 0) & (p["y2"] > 0) & day_ok(f["d1"], p["d1"]) & day_ok(f["d2"], p["d2"]) & rising
                start = F.when(p["d1"] > 0, iso(p["y1"], p["n1"], p["d1"])).otherwise("")
                out = F.struct(shown(p).alias("display"), start.alias("start"), p["y1"].alias("year"), F.when(p["y1"] != p["y2"], p["y2"]).otherwise(0).alias("end_year"), F.lit("").alias("reason"))
                return F.when(ok, out.cast(RESULT))

            return let(parts, checked)

        def first(f: Column) -> Column:
            size = F.length(f["kinds"])
            tries = F.filter(F.sequence(F.lit(1), F.length(k) - size + 1), lambda i: F.substring(k, i, size) == f["kinds"])
            return F.aggregate(tries, F.lit(None).cast(RESULT), lambda found, i: F.when(found.isNotNull(), found).otherwise(at(f, i - 1)))

        return F.aggregate(forms(), F.lit(None).cast(RESULT), lambda found, f: F.when(found.isNotNull(), found).when(F.instr(k, f["kinds"]) > 0, first(f)))

    day = F.regexp_extract(plain, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    part = lambda a, n: F.substring(day, a, n).cast("int")
    told = F.concat(F.try_element_at(names, F.nullif(part(6, 2), F.lit(0))), F.lit(" "), part(9, 2).cast("string"), F.lit(", "), part(1, 4).cast("string"))
    whole = F.struct(told.alias("display"), day.alias("start"), part(1, 4).alias("year"), F.lit(0).alias("end_year"), F.lit("").alias("reason")).cast(RESULT)
    parsed = let(words, lambda w: let(F.struct(w.alias("words"), kinds(w).alias("kinds")), read))
    return (
        F.when(F.coalesce(text, F.lit("")).rlike(r"(?i)\bBCE?\b"), refused("bc-date"))
        .when(F.when(day != "", iso(part(1, 4), part(6, 2), part(9, 2)).isNotNull()), whole)
        .when(plain.rlike(r"^\d{3,4}$"), refused("bare-year"))
        .otherwise(F.coalesce(parsed, refused("unparsed")))
    )
