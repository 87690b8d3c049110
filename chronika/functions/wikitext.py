"""Template parsing and prose repair that need a stack or a callback: small Python helpers behind Arrow-batched UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: abbreviations after which no sentence starts.
ABBREVIATIONS = frozenset("mr mrs ms dr st gen col maj capt lt sgt adm cmdr gov sen rep prof rev no vol vs ca c e.g i.e etc jr sr".split())


def template_spans(text: str) -> list[tuple[int, int]]:
    """Outermost balanced {{ }} spans."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"\{\{|\}\}", text):
        if m[0] == "{{":
            if not depth:
                start = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append((start, m.end()))
    return out


def split_top(body: str, separator: str = "|") -> list[str]:
    """Parts of a template's body at separators outside of inner templates and links."""
    parts, depth, at = [], 0, 0
    for m in re.finditer(r"\{\{|\[\[|\}\}|\]\]|" + re.escape(separator), body):
        if m[0] == separator:
            if not depth:
                parts.append(body[at : m.start()])
                at = m.end()
        else:
            depth = max(0, depth + (1 if m[0] in ("{{", "[[") else -1))
    return [*parts, body[at:]]


def template_fields(text: str, name: str) -> dict[str, str]:
    """Named arguments of the first template whose name begins with `name`."""
    for start, end in template_spans(text or ""):
        head, *parts = split_top(text[start + 2 : end - 2])
        if head.strip().lower().startswith(name.lower()):
            pairs = (p.split("=", 1) for p in parts if "=" in p)
            return {k.strip().lower(): v.strip() for k, v in pairs}
    return {}


LISTS = ("plainlist", "unbulleted list", "ubl", "hlist", "flatlist", "tree list")


def render_template(inner: str) -> str:
    head, *args = split_top(inner)
    name = head.strip().lower()
    plain = [render(a.strip()) for a in args if not re.match(r"\s*\w+\s*=", a)]
    if name.startswith(LISTS):
        return ", ".join(filter(None, (re.sub(r"^\*+\s*", "", x).strip() for a in plain for x in re.split(r"\n\s*\*|\n", a))))
    if name.startswith(("flag", "flagcountry", "flagdeco", "flagu")):
        return plain[0] if plain and not name.startswith(("flagicon", "flagdeco")) else ""
    if name in ("nowrap", "small", "nobold", "lang", "ill", "sortname"):
        return plain[-1] if name == "lang" and plain else plain[0] if plain else ""
    if name == "convert" and len(plain) >= 2:
        return f"{plain[0]} {plain[1]}"
    return ""


def render(text: str) -> str:
    """Templates as their visible text, inner ones first; links as their labels."""
    out, at = [], 0
    for start, end in template_spans(text):
        out += [text[at:start], render_template(text[start + 2 : end - 2])]
        at = end
    return re.sub(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", r"\1", "".join([*out, text[at:]]))


def side_text(value: str | None, most: int = 300) -> str:
    """An infobox cell as one line: items once each, cut to `most`; '' if markup is left."""
    text = re.sub(r"(?is)<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>|<!--.*?-->", "", value or "")
    text = render(re.sub(r"(?i)<br\s*/?>", "\n", text))
    seen: dict[str, str] = {}
    for item in re.split(r"\n\s*\*?|,\s*(?=,)", re.sub(r"</?\w+[^>]*>|'{2,}", "", text)):
        item = re.sub(r"\s+", " ", item).strip(" ,;*")
        if item:
            seen.setdefault(item.lower(), item)
    out = ", ".join(seen.values())
    return "" if re.search(r"\{\{|\}\}|\[\[|\]\]", out) else out[:most].rstrip()


LOOK_BACK = 32  # characters before a sentence's end, more than an abbreviation has


def capitalize_sentences(text: str | None) -> str:
    """Upper-case letters at sentence starts, not after abbreviations, initials, ellipses or in decimals."""

    def fix(m: re.Match) -> str:
        word = re.search(r"([\w.]+)$", m.string[max(0, m.start() - LOOK_BACK) : m.start()])
        before = word[1].lower() if word else ""
        if m[1] == "." and (before in ABBREVIATIONS or len(before) == 1 or before.endswith(".")):
            return m[0]
        return m[1] + m[2] + m[3].upper()

    return re.sub(r"([.!?])(\s+)([a-zà-ÿ])", fix, text or "")


def significance(article: str | None, most_bytes: int = 800, sections=("aftermath", "legacy", "significance", "consequences", "results", "impact")) -> str:
    """The first clean paragraph of the best-ranked section, whole sentences up to most_bytes."""
    parts = re.split(r"(?m)^==+\s*([^=\n]+?)\s*==+\s*$", article or "")
    found = {t.strip().lower(): b for t, b in zip(parts[1::2], parts[2::2])}
    for wanted in sections:
        for title, body in found.items():
            if wanted in title:
                for paragraph in re.split(r"\n\s*\n", re.sub(r"(?is)<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", "", body)):
                    plain = re.sub(r"\s+", " ", re.sub(r"'{2,}", "", render(paragraph))).strip()
                    if len(plain) >= 60 and not re.match(r"[|*#:{]", plain) and "[[" not in plain:
                        out = ""
                        for sentence in re.split(r"(?<=[.!?])\s+", plain):
                            if len(f"{out} {sentence}".encode()) > most_bytes:
                                break
                            out = f"{out} {sentence}".strip()
                        return out
    return ""


INFOBOX_FIELDS = ("conflict", "date", "place", "result", "partof", "combatant1", "combatant2", "combatant3", "commander1", "commander2", "strength1", "strength2", "casualties1", "casualties2", "territory", "coordinates")


def _column(fn, kind: str = "string"):
    return F.pandas_udf(lambda s: s.map(fn).astype(object) if kind != "string" else pd.Series([fn(x) for x in s], dtype=object), kind)


def side_text_column(text: Column) -> Column:
    return _column(side_text)(text)


def capitalize_column(text: Column) -> Column:
    return _column(capitalize_sentences)(text)


def significance_column(article: Column) -> Column:
    return _column(significance)(article)


def infobox(article: Column, name: str = "infobox military conflict") -> Column:
    """The fields of an article's infobox as a struct of raw texts."""

    def read(s: pd.Series) -> pd.DataFrame:
        rows = [template_fields(x, name) for x in s]
        return pd.DataFrame([[r.get(f, "") for f in INFOBOX_FIELDS] for r in rows], columns=list(INFOBOX_FIELDS), dtype=object)

    return F.pandas_udf(read, ", ".join(f"{f} string" for f in INFOBOX_FIELDS))(article)
