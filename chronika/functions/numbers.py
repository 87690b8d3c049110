"""Figures in free text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CEILING = 10_000_000


def figures(text: Column) -> Column:
    """All runs of digits with thousands commas, as longs, in order; longer ones than a long holds are dropped."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9][0-9,]*)"), 1)
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("bigint")), lambda x: x.isNotNull())


def casualty_estimate(text: Column, ceiling: int = CEILING) -> Column:
    """The middle of the first two figures if the text states a range and they rise; else the largest figure; 0 without any."""
    n = figures(text)
    low, high = F.try_element_at(n, F.lit(1)), F.try_element_at(n, F.lit(2))
    ranged = F.lower(text).rlike("–|—|-| to ") & (high > low) & (high <= ceiling)
    largest = F.array_max(F.filter(n, lambda x: x <= ceiling))
    return F.when(ranged, F.floor((low + high) / 2)).otherwise(F.coalesce(largest, F.lit(0))).cast("bigint")


def casualty_sum(text: Column, ceiling: int = CEILING) -> Column:
    """The sum of all figures from 1 to the ceiling."""
    usable = F.filter(figures(text), lambda x: (x > 0) & (x <= ceiling))
    return F.aggregate(usable, F.lit(0).cast("bigint"), lambda a, x: a + x)


def largest_figure(text: Column, ceiling: int | None = None) -> Column:
    """The largest figure, at most the ceiling if one is given; 0 without any."""
    n = figures(text)
    return F.coalesce(F.array_max(n if ceiling is None else F.filter(n, lambda x: x <= ceiling)), F.lit(0).cast("bigint"))


def force_figures(text: Column) -> Column:
    """Figures with an optional multiplier word (k, thousand, m, million) as array<double>."""
    pattern = r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(thousand|million|k|m)?(?![a-zA-Z])"
    text = F.coalesce(text, F.lit(""))
    numbers = F.regexp_extract_all(text, F.lit(pattern), 1)
    scales = F.regexp_extract_all(text, F.lit(pattern), 2)

    def scaled(n: Column, s: Column) -> Column:
        s = F.lower(s)
        factor = F.when(s.isin("k", "thousand"), 1e3).when(s.isin("m", "million"), 1e6).otherwise(1.0)
        return F.regexp_replace(n, ",", "").cast("double") * factor

    return F.zip_with(numbers, scales, scaled)


def comparable_force(text: Column, equipment: str = "ship|gun|tank|aircraft|plane|vessel|galley|cannon", least: int = 50) -> Column:
    """The largest force stated, before any civilian part; 0 if it counts equipment or is not over `least`."""
    text = F.coalesce(text, F.lit(""))
    military = F.regexp_replace(text, r"(?is)[,;(]?\s*(?:and\s+)?(?:[0-9][0-9,.]*\s*(?:thousand|million|k|m)?\s*)?\bcivilian.*$", "")
    most = F.coalesce(F.array_max(force_figures(military)), F.lit(0.0))
    return F.when(F.lower(text).rlike(equipment) | (most <= least), 0.0).otherwise(most)


def comma_int(n: Column) -> Column:
    return F.format_number(n, 0)


def humanized_count(n: Column, unit: str = "men") -> Column:
    """1.2 million men, 117,000 men, or nothing for 0."""
    millions = F.regexp_replace(F.format_string("%.1f", n / 1e6), r"\.0$", "")
    return F.when(n <= 0, "").when(n >= 1_000_000, F.concat(millions, F.lit(f" million {unit}"))).otherwise(F.concat(comma_int(n), F.lit(f" {unit}")))


def compact_count(n: Column) -> Column:
    """999, 1.5k, 20k, 3.4M."""
    short = lambda scale, mark: F.concat(F.regexp_replace(F.format_string("%.1f", n / scale), r"\.0$", ""), F.lit(mark))
    return F.when(n >= 1_000_000, short(1e6, "M")).when(n >= 10_000, F.concat(F.round(n / 1e3).cast("bigint").cast("string"), F.lit("k"))).when(n >= 1000, short(1e3, "k")).otherwise(n.cast("string"))


def fnv1a32(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, as a long from 0 to 2^32 - 1."""
    bytes_ = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), 1)
    step = lambda h, b: (h.bitwiseXOR(F.conv(b, 16, 10).cast("bigint")) * 16777619).bitwiseAND(F.lit(4294967295))
    return F.aggregate(bytes_, F.lit(2166136261).cast("bigint"), step)


def cos_series(x: Column) -> Column:
    """Cosine by its series up to the sixth power."""
    return 1 - x * x / 2 + F.pow(x, F.lit(4)) / 24 - F.pow(x, F.lit(6)) / 720


def sin_series(x: Column) -> Column:
    """Sine by its series up to the seventh power."""
    return x - F.pow(x, F.lit(3)) / 6 + F.pow(x, F.lit(5)) / 120 - F.pow(x, F.lit(7)) / 5040
