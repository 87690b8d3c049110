"""Cleaning, keys and similarity of text, as column expressions.

Rule lists (phrases to labels) are parameters throughout: the functions know no particular wars or countries.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: words of an image's options that stand before a pipe, and fields of an infobox that leak behind one.
IMAGE_OPTIONS = ("thumb", "thumbnail", "frame", "frameless", "border", "bottom", "top", "centre", "center", "left", "right", "none", "upright")
INFOBOX_FIELDS = ("combatant", "commander", "strength", "casualties", "result")
INLINE_TAGS = ("small", "sub", "sup", "center", "nowrap", "span", "i", "b")
STOP_WORDS = ("the", "of", "and", "at", "in", "on", "for", "a", "an", "battle", "siege", "raid", "action", "skirmish", "combat", "engagement")
#: Accented Latin letters and what they fold to.
ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçĆćČčĎďÈÉÊËèéêëĚěĘęĞğÌÍÎÏìíîïİıŁłÑñŃńŇňÒÓÔÕÖØòóôõöøŐőŘřŚśŞşŠšŤťÙÚÛÜùúûüŮůŰűÝýÿŹźŻżŽž"
FOLDED = "AAAAAAaaaaaaCcCcCcDdEEEEeeeeEeEeGgIIIIiiiiIiLlNnNnNnOOOOOOooooooOoRrSsSsSsTtUUUUuuuuUuUuYyyZzZzZz"


def chain(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, F.coalesce(text, F.lit("")))


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.lower(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Mn}", ""), ACCENTED, FOLDED))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s{2,}", " "))


def visible(text: Column) -> Column:
    """Wiki text without templates, references and link brackets, in one pass over its brackets and tags.

    levels holds the text of each open link, the outermost first; a closed link leaves what follows its last
    pipe. What stands in a template or a reference is left out, however deep they nest; a template, reference or
    link that is never closed hides all that follows it, and a closing bracket without an opening one goes.
    """
    parts = F.regexp_extract_all(text, F.lit(r"\{\{|\}\}|\[\[|\]\]|<(?=[/A-Za-z])[^<>]*(?:>|$)|[^{}\[\]<]+|[{}\[\]<]"), 0)
    start = F.struct(F.array(F.lit("")).alias("levels"), F.lit(0).alias("deep"), F.lit(False).alias("cited"))

    def step(at: Column, part: Column) -> Column:
        levels, deep, cited = at["levels"], at["deep"], at["cited"]
        top, depth = F.element_at(levels, -1), F.size(levels)
        shown = lambda t: F.concat(F.slice(levels, 1, depth - 1), F.array(F.concat(top, t)))
        label = F.element_at(F.split(top, r"\|"), -1)
        closed = F.concat(F.slice(levels, 1, F.greatest(depth - 2, F.lit(0))), F.array(F.concat(F.element_at(levels, -2), label)))
        name = F.lower(F.regexp_extract(part, r"^</?(\w+)", 1))
        now = lambda levels=levels, deep=deep, cited=cited: F.struct(levels.alias("levels"), deep.alias("deep"), cited.alias("cited"))
        opened = name == "ref"
        return (
            F.when(cited, now(cited=~(opened & F.startswith(part, F.lit("</")))))
            .when(opened, now(cited=~F.startswith(part, F.lit("</")) & ~F.endswith(part, F.lit("/>"))))
            .when(part == "{{", now(deep=deep + 1))
            .when(part == "}}", now(deep=F.greatest(deep - 1, F.lit(0))))
            .when(deep > 0, at)
            .when(part == "[[", now(levels=F.concat(levels, F.array(F.lit("")))))
            .when(part == "]]", F.when(depth > 1, now(levels=closed)).otherwise(at))
            .when(name == "br", now(levels=shown(F.lit(" "))))
            .when(name.isin(*INLINE_TAGS), at)
            .otherwise(now(levels=shown(part)))
        )

    return F.element_at(F.aggregate(parts, start, step)["levels"], 1)


def without_options(text: Column) -> Column:
    """The parts between pipes from the first that is no option of an image to the last before a field of an infobox, and no 'name =' before it."""
    option = rf"(?i)^\s*(?:(?:{'|'.join(IMAGE_OPTIONS)})(?:=[\d.]+)?|\d+\s*px|(?:alt|link)=.*|(?:file|image):.*)\s*$"
    field = rf"(?i)^\s*(?:{'|'.join(INFOBOX_FIELDS)})\d*\s*=|^\s*group\s*="

    def kept(parts: Column) -> Column:
        # The last part is the text itself; only what a pipe follows can be an option.
        options = F.transform(parts, lambda p, i: (i < F.size(parts) - 1) & p.rlike(option))
        first = F.greatest(F.array_position(options, F.lit(False)).cast("int"), F.lit(1))
        rest = F.slice(parts, first, F.size(parts))
        named = F.when((F.trim(F.element_at(rest, 1)) == "") & (F.size(rest) > 1), F.concat(F.array(F.regexp_replace(F.try_element_at(rest, F.lit(2)), r"^\s*\w+\s*=", "")), F.slice(rest, 3, F.size(rest)))).otherwise(rest)
        leak = F.array_position(F.transform(named, lambda p, i: (i > 0) & p.rlike(field)), F.lit(True)).cast("int")
        return F.array_join(F.slice(named, 1, F.when(leak > 0, leak - 1).otherwise(F.size(named))), "|")

    return F.transform(F.array(F.split(text, r"\|")), kept)[0]


def strip_markup(text: Column) -> Column:
    """A short field as a reader sees it: wiki markup, image options and leaked fields off, no loose marks at its ends."""
    plain = without_options(visible(F.coalesce(text, F.lit(""))))
    return F.trim(F.regexp_replace(squeeze(F.translate(plain, "•\ufffd", "")), r"^[\s|;,]+|[\s|:;,]+$", ""))


def decode_entities(text: Column) -> Column:
    """The six entities that catalogue fields carry."""
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def clean_prose(text: Column) -> Column:
    """Prose without markup; an image caption, or prose in which markup is left, becomes empty."""
    caption = F.coalesce(text, F.lit("")).rlike(r"(?i)^\s*(?:thumb|\d+px|file:|image:)[^|]*\|")
    out = strip_markup(decode_entities(text))
    return F.when(caption | out.rlike(r"\{\{|\}\}|\[\[|\]\]|<ref"), "").otherwise(upper_initial(out))


def upper_initial(text: Column) -> Column:
    """The first letter in upper case; an ordinal after leading digits in lower case."""
    ordinal = F.concat(F.regexp_extract(text, r"^(\d+)", 1), F.lower(F.regexp_extract(text, r"^\d+(ST|ND|RD|TH|st|nd|rd|th|St|Nd|Rd|Th)\b", 1)))
    return F.when(text.rlike(r"(?i)^\d+(?:st|nd|rd|th)\b"), F.concat(ordinal, F.regexp_replace(text, r"(?i)^\d+(?:st|nd|rd|th)", ""))).otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30)))


def clean_side_name(text: Column) -> Column:
    """A participant's name: markup off, a leading alignment word off, its parts joined by single commas."""
    aligned = rf"^(?i:{'|'.join(IMAGE_OPTIONS)})\s+(?=\p{{Lu}})"
    parts = F.transform(F.split(F.regexp_replace(strip_markup(text), aligned, ""), r"[|;,]"), lambda p: F.trim(p))
    return squeeze(F.array_join(F.filter(parts, lambda p: p != ""), ", "))


def clean_wikitext(text: Column, most: int = 300) -> Column:
    """An infobox value: markup off, a leading article off, cut to `most` characters; what begins with a pipe is refused."""
    value = squeeze(F.regexp_replace(strip_markup(decode_entities(text)), r"^[Tt]he\s+", ""))
    return F.when(F.coalesce(text, F.lit("")).rlike(r"^\s*\|"), "").otherwise(F.left(value, F.lit(most)))


def null_junk(text: Column, longest: int = 120) -> Column:
    """'' for template residue and over-long values."""
    return F.when(~trusted_name(text, longest), "").otherwise(text)


def trusted_name(text: Column, longest: int = 120) -> Column:
    """Empty, or without markup characters and the word image, and not over-long."""
    return (text == "") | (~F.lower(text).rlike(r"[|{}=<>]|image") & (F.length(text) <= longest))


def garbage(text: Column) -> Column:
    """Whether wiki tokens are left in a text."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(r"\{\{|\}\}|\[\[|\]\]|<ref|<br|\bthumb\||\bflagicon\b|\bplainlist\b|&nbsp;")


def strip_prefix(text: Column, separator: str) -> Column:
    """What stands behind the first separator, twice; all of it without one."""
    behind = lambda c: F.regexp_replace(c, "^.*?" + re.escape(separator), "")
    return F.trim(behind(behind(text)))


def collapse_repeats(text: Column) -> Column:
    """A run of the same word, or of the same comma-separated part, once."""
    return chain(text, [(r"(?i)\b(\w+)(?:\s+\1\b)+", "$1"), (r"(?i)(^|, )([^,]+)(?:, \2(?=,|$))+", "$1$2")])


def slug(text: Column, most: int = 80) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.left(F.regexp_replace(out, r"^-+|-+$", ""), F.lit(most)), r"-+$", "")


def url_title(url: Column) -> Column:
    """The article title of an encyclopedia address; '' for others."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"/wiki/([^?#]+)", 1)
    return F.replace(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit("")), F.lit("_"), F.lit(" "))


def name_tokens(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct lower-case words of letters and digits, stop words left out."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*stop)))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def core_tokens(name: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Folded tokens of a name without parentheses and stop words, in order."""
    plain = F.regexp_replace(fold(name), r"\([^)]*\)", " ")
    return F.filter(F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: ~w.isin(*stop))


def core_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance of the joined cores over the longer one."""
    ca, cb = F.array_join(core_tokens(a), ""), F.array_join(core_tokens(b), "")
    longer = F.greatest(F.length(ca), F.length(cb))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(ca, cb) / longer)


ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "i", "ii", "iii", "iv", "v", "vi")


def ordinal_mismatch(a: Column, b: Column) -> Column:
    """Whether an ordinal or a number stands in one name only."""
    odd = lambda t: F.filter(core_tokens(t), lambda w: w.isin(*ORDINALS) | w.rlike("[0-9]"))
    return (F.size(F.array_except(odd(a), odd(b))) > 0) | (F.size(F.array_except(odd(b), odd(a))) > 0)


#: Fixed: phrases and what they are spelled as in a key, in this order.
SPELLINGS = (
    ("second world war", "world war ii"),
    ("first world war", "world war i"),
    ("the great war", "world war i"),
    ("(world war ii)", "of world war ii"),
    ("(world war i)", "of world war i"),
    ("theatre", "theater"),
    ("of the world war", "of world war"),
)


def conflict_key(name: Column) -> Column:
    """The key under which spellings of one conflict meet."""
    out = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[–—−]", "-")
    out = F.regexp_replace(out, "^the ", "")
    for said, meant in SPELLINGS:
        out = F.replace(out, F.lit(said), F.lit(meant))
    out = F.when(out == "great war", "world war i").otherwise(out)
    return F.trim(F.regexp_replace(out, " {2,}", " "))


def alias_phrase(name: Column) -> Column:
    """Whether a spelling is one that a canonical form is preferred to."""
    return F.lower(name).rlike(r"second world war|first world war|great war|theatre|\(world war i")


def repair_comma(name: Column) -> Column:
    """One name from a comma-joined one: joined after 'of (the)', cut before 'and (the)', else the first part."""
    before = F.trim(F.regexp_extract(name, r"^([^,]*),", 1))
    after = F.trim(F.regexp_replace(F.trim(F.regexp_extract(name, r"^[^,]*,([\s\S]*)$", 1)), r"^\(|\)$", ""))
    head = F.trim(F.regexp_replace(before, r"(?i) and(?: the)?$", ""))
    repaired = (
        F.when(before == "", after)
        .when(F.lower(before).rlike(r" and(?: the)?$"), F.when(head == "", before).otherwise(head))
        .when(F.lower(before).rlike(r" of(?: the)?$"), F.when(after == "", before).otherwise(F.concat_ws(" ", before, after)))
        .otherwise(before)
    )
    return F.when(F.instr(name, ",") > 0, repaired).otherwise(name)


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str = "") -> Column:
    """The label of the first rule (pattern, label) that a lower-cased text matches."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(low.rlike(p), F.lit(label)) for p, label in rules), F.lit(default))


def all_matches(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The labels of all rules whose phrase a text holds as whole words, in the order of the rules, each once."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    return F.array_distinct(F.array_compact(F.array(*(F.when(padded.rlike(p), F.lit(label)) for p, label in rules))))


def belligerent_key(name: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The rule's key, else the slug of the cleaned name."""
    return F.coalesce(F.nullif(first_match(name, rules), F.lit("")), slug(clean_side_name(name)))


def side_is_junk(name: Column) -> Column:
    """Names that stand for no participant."""
    return F.trim(name).rlike(r"(?i)^(?:|unknown|none|n/?a|various|others?|tbd|see below|\d+)$")


def clean_victor(text: Column) -> Column:
    """A victor's name: qualifiers of a victory off; '' for results without a victor, and outside 2 to 80 characters."""
    out = squeeze(chain(text, [(r"(?i)^(?:decisive|major|minor|pyrrhic|tactical|strategic|crushing|overwhelming)\s+", ""), (r"(?i)\s+(?:victory|win|success)\b.*$", ""), (r"[\s.;:,]+$", "")]))
    return F.when(out.rlike(r"(?i)^(?:inconclusive|draw|stalemate|indecisive|disputed|unknown|see\b.*)$") | ~F.length(out).between(2, 80), "").otherwise(out)


def infer_victor(result: Column, most_words: int = 4) -> Column:
    """The name before 'victory' without qualifiers; '' if undecided, too long, or with digits."""
    name = clean_victor(F.regexp_extract(F.coalesce(result, F.lit("")), r"(?i)^\s*(.*?)\s+(?:victory|victories)\b", 1))
    return F.when(F.coalesce(result, F.lit("")).rlike(r"(?i)inconclusive|stalemate|disputed") | name.rlike(r"\d") | (F.size(F.split(name, r"\s+")) > most_words), "").otherwise(name)


def victor_from_prose(text: Column) -> Column:
    """The subject of the first sentence pattern that names a winner, 3 to 60 characters, not a pronoun or article alone."""
    patterns = [r"(?:^|[.;] )([A-Z][\p{L} ]+?) (?:won|was victorious|were victorious|prevailed)\b", r"(?:^|[.;] )([A-Z][\p{L} ]+?) (?:defeated|routed|crushed)\b", r"victory (?:for|of) (?:the )?([A-Z][\p{L} ]+?)(?=[.,;]|$)", r"(?:won|gained) by (?:the )?([A-Z][\p{L} ]+?)(?=[.,;]|$)"]
    usable = lambda c: F.when(F.length(c).between(3, 60) & ~c.rlike(r"^(?:He|She|They|It|His|Her|Their|This|That|After|When|In|On|At)\b"), c)
    return F.coalesce(*(usable(F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1), r"^The ", "")) for p in patterns), F.lit(""))


def significance_sentence(summary: Column, signals: str = r"(?i)\b(?:led to|resulted in|marked|ended|turning point|decisive|significan|paved the way|secured|forced)") -> Column:
    """The last sentence of 30 to 360 characters that says why it mattered."""
    sentences = F.transform(F.split(F.coalesce(summary, F.lit("")), r"(?<=[.!?])\s+(?=\p{Lu})"), lambda s: F.trim(s))
    fit = F.filter(sentences, lambda s: F.length(s).between(30, 360) & s.rlike(signals))
    return F.coalesce(F.try_element_at(fit, F.lit(-1)), F.lit(""))


def cut_bytes(text: Column, most: int) -> Column:
    """As many whole characters as fit into `most` bytes of UTF-8."""
    head = F.left(text, F.lit(most))
    fits = F.aggregate(F.split(head, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("s")), lambda a, c: F.when(a["n"] + F.octet_length(c) <= most, F.struct((a["n"] + F.octet_length(c)).alias("n"), F.concat(a["s"], c).alias("s"))).otherwise(F.struct(F.lit(most + 1).alias("n"), a["s"].alias("s"))))
    return F.when(F.octet_length(text) <= most, text).otherwise(fits["s"])


def cut_chars(text: Column, most: int) -> Column:
    return F.left(text, F.lit(most))


def richness(*fields: Column) -> Column:
    """How many of the fields say something."""
    return reduce(lambda a, b: a + b, (F.coalesce((F.trim(f) != ""), F.lit(False)).cast("int") for f in fields))


def citations(text: Column) -> Column:
    """Citations of reference blocks as an array of structs (kind, title, url, year), each address or title once."""
    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?is)<ref\b[^>/]*>(.*?)</ref>"), 1)
    field = lambda b, name: F.trim(F.regexp_extract(b, rf"(?i)\|\s*{name}\s*=\s*([^|}}]*)", 1))

    def cite(b: Column) -> Column:
        kind = F.lower(F.regexp_extract(b, r"(?i)\{\{\s*cite\s+(\w+)", 1))
        url = F.coalesce(F.nullif(field(b, "url"), F.lit("")), F.regexp_extract(b, r"(https?://[^\s|}\]]+)", 1))
        host = F.regexp_extract(url, r"^https?://(?:www\.)?([^/]+)", 1)
        title = F.coalesce(F.nullif(field(b, "title"), F.lit("")), host)
        year = F.regexp_extract(F.concat_ws(" ", field(b, "year"), field(b, "date")), r"(\d{4})", 1)
        return F.struct(F.when(kind == "", "web").otherwise(kind).alias("kind"), F.left(title, F.lit(240)).alias("title"), F.left(url, F.lit(480)).alias("url"), year.alias("year"))

    found = F.filter(F.transform(blocks, cite), lambda c: c["title"] != "")
    return F.array_sort(F.array_distinct(found))


def html_links(page: Column) -> Column:
    """(href, label) of the links of a page, in order."""
    pattern = r"""(?is)<a\b[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""
    return F.zip_with(F.regexp_extract_all(page, F.lit(pattern), 1), F.regexp_extract_all(page, F.lit(pattern), 2), lambda h, t: F.struct(h.alias("href"), F.trim(F.regexp_replace(t, "<[^>]*>", "")).alias("label")))


def non_battle(labels: Column, banned: str, military: str) -> Column:
    """Whether a pipe-joined list of class labels marks no battle: one is banned, or none is military; False for ''."""
    parts = F.filter(F.split(F.lower(F.coalesce(labels, F.lit(""))), r"\|"), lambda x: F.trim(x) != "")
    return (F.size(parts) > 0) & (F.exists(parts, lambda x: x.rlike(banned)) | F.forall(parts, lambda x: ~x.rlike(military)))
