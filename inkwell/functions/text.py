"""Text, URL, title and date expressions: Column in, Column out, JVM-side."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import lexicon as L

#: The parts of a URL: scheme, authority, path, query.
URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def url_part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), URL, k)


def host_of(url: Column) -> Column:
    return F.lower(url_part(url, 2))


def normalize_url(url: Column) -> Column:
    """Host in lower case, no fragment, no ;parameters, no slash at the path's end; the query stays."""
    path = F.regexp_replace(F.regexp_replace(url_part(url, 3), ";[^/]*$", ""), "/+$", "")
    query = url_part(url, 4)
    return F.concat(F.lower(url_part(url, 1)), F.lit("://"), host_of(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def resolve_url(base: Column, link: Column) -> Column:
    """An absolute URL of a link on a page: absolute, //host, /path, or relative to the page's folder."""
    link = F.trim(link)
    scheme, host = url_part(base, 1), url_part(base, 2)
    folder = F.regexp_replace(F.coalesce(F.nullif(url_part(base, 3), F.lit("")), F.lit("/")), "[^/]*$", "")
    root = F.concat(scheme, F.lit("://"), host)
    joined = F.concat(folder, link)
    parts = F.split(F.regexp_replace(joined, "^/", ""), "/", -1)
    climbed = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(p == ".", a).otherwise(F.concat(a, F.array(p))),
    )
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, F.lit("/"), F.array_join(climbed, "/")))
    )


def video_url_key(url: Column) -> Column:
    """``douyin:<id>`` for /video/<id> and /note/<id>; else the URL without query and closing slashes."""
    found = F.regexp_extract(url, r"/(?:share/)?(?:video|note)/([0-9]+)", 1)
    return F.when(found != "", F.concat(F.lit("douyin:"), found)).otherwise(F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), "/+$", ""))


def share_id(url: Column) -> Column:
    """The video id of a share URL, from the path or a modal_id / vid parameter; null if none."""
    path, query = F.regexp_extract(url, r"/(?:video|note)/([0-9]+)", 1), F.regexp_extract(url, r"[?&](?:modal_id|vid|item_id)=([0-9]+)", 1)
    return F.coalesce(F.nullif(path, F.lit("")), F.nullif(query, F.lit("")))


def is_government(host: Column) -> Column:
    return host.endswith(".gov.cn") | host.endswith(".gov")


def title_key(title: Column, tails: tuple[str, ...] = L.TITLE_TAILS) -> Column:
    """A stable fingerprint of a title; an empty one never equals another."""
    steps = (
        (r"(?U)[\s　]+", ""),
        (r"^[·•\-—_【\[\(（]+", ""),
        (f"(?:{'|'.join(map(re.escape, tails))})$", ""),
        (r"(?<=[一-鿿])[0-9]$", ""),
        (r"[^\p{L}\p{N}_]+", ""),
    )
    return functools.reduce(lambda c, s: F.regexp_replace(c, *s), steps, F.lower(F.trim(title)))


def extract_date(text: Column, year: Column) -> Column:
    """The first year-month-day of a text; failing that the first month-day with ``year``; else null."""
    full = [F.regexp_extract(text, r"([0-9]{4})[-/年.]([0-9]{1,2})[-/月.]([0-9]{1,2})", k).try_cast("int") for k in (1, 2, 3)]
    short = [F.regexp_extract(text, r"([0-9]{1,2})[-/月.]([0-9]{1,2})日?", k).try_cast("int") for k in (1, 2)]
    zero = [F.lit(0), F.lit(0), F.lit(0)]
    first = F.when(full[0] >= 1, F.try_make_timestamp(*full, *zero))
    return F.coalesce(first, F.try_make_timestamp(year, *short, *zero))


def compact(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def summary(text: Column, most: int = 180) -> Column:
    return F.substring(compact(text), 1, most)


def page_body(html: Column) -> Column:
    """A page's markup without scripts, styles and noscript blocks."""
    return F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>", "")


def unescaped(text: Column) -> Column:
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def markup_lines(html: Column) -> Column:
    """Text between tags as an array of compact lines without empty ones."""
    return F.filter(F.transform(F.split(F.regexp_replace(html, r"(?s)<[^>]*>", "\n"), "\n", -1), compact), lambda x: x != "")


def bound(text: Column, f: Callable[[Column], Column]) -> Column:
    """f(text) with the text computed once, however often ``f`` reads it."""
    return F.transform(F.array(text), f)[0]


def _has_any(text: Column, words) -> Column:
    return functools.reduce(lambda a, w: a | text.contains(w), words, F.lit(False))


def _count_hits(text: Column, words) -> Column:
    return functools.reduce(lambda a, w: a + text.contains(w).cast("int"), words, F.lit(0))


def has_any(text: Column, words) -> Column:
    return bound(text, lambda t: _has_any(t, words))


def count_hits(text: Column, words) -> Column:
    return bound(text, lambda t: _count_hits(t, words))


def hits(text: Column, words) -> Column:
    """The words of a list that a text holds, in the list's order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def label(text: Column, rules, other: str) -> Column:
    """The label of the first rule with a word in the text."""

    def first(t: Column) -> Column:
        out = F.lit(other)
        for name, words in reversed(rules):
            out = F.when(_has_any(t, words), F.lit(name)).otherwise(out)
        return out

    return bound(text, first)


def _relevance(text: Column, lexicon: L.Relevance) -> Column:
    return functools.reduce(lambda a, s: a + _count_hits(text, s[0]) * s[1], lexicon.weighted, F.lit(0))


def relevance(text: Column, lexicon: L.Relevance = L.Relevance()) -> Column:
    """Sum of weights of the words present; a word in two sets counts in both."""
    return bound(text, lambda t: _relevance(t, lexicon))


def is_relevant(text: Column, lexicon: L.Relevance = L.Relevance()) -> Column:
    return bound(text, lambda t: ~(_has_any(t, lexicon.noise) & ~_has_any(t, lexicon.rescue)) & (_relevance(t, lexicon) >= lexicon.least))


def age_days(then: Column, as_of: Column) -> Column:
    """Whole elapsed days, not calendar ones."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros(then)) / F.lit(86_400_000_000)).cast("long")


def recommendation(likes: Column, saves: Column, then: Column, in_scope: Column, as_of: Column) -> Column:
    age = F.greatest(age_days(then, as_of), F.lit(0).cast("long"))
    return likes + 2 * saves + 120 * F.greatest(30 - age, F.lit(0).cast("long")) + F.when(in_scope, 800).otherwise(0)


def in_scope(text: Column, words=L.DISCOVERY, excluded=L.DISCOVERY_EXCLUDED) -> Column:
    return ~has_any(text, excluded) & has_any(text, words)


def fresh(then: Column, as_of: Column, most: int = 90) -> Column:
    """Items without a date are kept."""
    return then.isNull() | (age_days(then, as_of) <= most)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of the character sets of two texts."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def excerpt(text: Column, fallback: Column, most: int = 110) -> Column:
    """The first two sentences, cut to ``most`` characters with dots; ``fallback`` for an empty text."""
    parts = F.split(F.regexp_replace(compact(text), r"([。！？!?；;])\s*", "$1\u0001"), "\u0001", -1)
    two = F.array_join(F.slice(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), 1, 2), "")
    out = F.coalesce(F.nullif(two, F.lit("")), fallback)
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 2), F.lit("..."))).otherwise(out)


def masked_persons(text: Column, persons=L.PERSONS, letters: str = "一-龥") -> Column:
    """One or two letters ahead of a word for a person become 某."""
    return F.regexp_replace(text, f"[{letters}]{{1,2}}({'|'.join(persons)})", "某$1")


def needs_caution(text: Column, pattern: str = L.CAUTION) -> Column:
    return text.rlike(pattern)


def marked_caution(text: Column) -> Column:
    phrase = F.regexp_replace(F.trim(text), "[；;。 ]+$", "")
    return F.when(phrase == "", phrase).otherwise(F.concat(F.lit("[[CAUTION:"), phrase, F.lit("]]")))


def rewritten(text: Column, rules=L.REWRITES, owner: str | None = None) -> Column:
    """Patterns replaced in the order given, then repeated exclamation marks and outer punctuation tidied.

    A text's first "we" becomes the ``owner``'s name where one is given.
    """
    rules = ((L.WE, owner), *rules) if owner else rules
    out = functools.reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, F.trim(text))
    return F.regexp_replace(F.regexp_replace(out, "[!！]{2,}", "。"), "^[ ，。；：、]+|[ ，。；：、]+$", "")


def condensed(text: Column, most: int = 46, rules=L.REWRITES) -> Column:
    """At most ``most`` characters, cut at the last pause in the second half where there is one."""
    s = rewritten(text, rules)
    head = F.regexp_extract(F.substring(s, 1, most), "^(.*)[，、；]", 1)
    return F.when(F.length(s) <= most, s).when(F.length(head) >= most // 2, head).otherwise(F.substring(s, 1, most))
