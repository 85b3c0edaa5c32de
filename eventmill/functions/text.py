"""Text functions: clauses, audiences, markup, URLs, phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Audience labels and what they mean, in the order in which they are looked for.
AUDIENCE_LABELS = (
    ("children 12 and under", "children"), ("children", "children"), ("family", "families"), ("families", "families"),
    ("young people 13+", "teens"), ("young people", "teens"), ("teens", "teens"), ("youth event", "teens"), ("youth", "teens"),
    ("adults", "adults"), ("adult", "adults"), ("schools", "schools"), ("school groups", "schools"), ("students", "schools"),
)
#: What ends a clause (a full stop only before white space or the end).
CLAUSE_END = "[;•\n]|\\.(?=\\s|$)|\\s{2,}"
#: Words by which a sentence says that something stopped.
STOPPED = (
    r"\b(?:no longer|used to|formerly|previously|until further notice|has (?:been )?(?:dropped|suspended|withdrawn|removed|ended)"
    r"|was (?:dropped|suspended|withdrawn|removed|ended)|ceased|discontinued|not currently|temporarily (?:closed|suspended)|does not apply|no longer applies)\b"
)
NEAR = 120


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clauses(text: Column) -> Column:
    return F.filter(F.split(text, CLAUSE_END), lambda c: F.length(F.trim(c)) > 0)


def map_audience(label: Column) -> Column:
    """The label itself if known, else the first known label that it contains."""
    key = spaced(F.lower(label))
    out = F
    for known, value in AUDIENCE_LABELS:
        out = out.when(key == known, value)
    for known, value in AUDIENCE_LABELS:
        out = out.when(F.contains(key, F.lit(known)), value)
    return out


def html_text(html: Column) -> Column:
    """Text of markup: no scripts, styles or comments, tags as spaces, common entities read, spaces collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return spaced(t)


def shortened(text: Column, limit: int = 420) -> Column:
    """Cut at the last space within `limit` characters, with an ellipsis; empty text is null."""
    head = F.substring(text, 1, limit)
    cut = F.regexp_replace(head, r"(?s)\s[^ ]*$", "")
    return F.nullif(F.when(F.length(text) > limit, F.concat(cut, F.lit("…"))).otherwise(text), F.lit(""))


def meta(html: Column, name: str) -> Column:
    """Content of a meta element by property, else by name."""
    found = [F.nullif(F.regexp_extract(html, rf'(?is)<meta\b[^>]*\b{attr}\s*=\s*"{name}"[^>]*\bcontent\s*=\s*"([^"]*)"', 1), F.lit("")) for attr in ("property", "name")]
    return F.coalesce(*found)


def title(html: Column) -> Column:
    return F.nullif(spaced(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def absolute(base: Column, link: Column) -> Column:
    """A link against its page: absolute ones stay, others take the scheme, the host or the folder of the page."""
    scheme, host = F.regexp_extract(base, r"^([A-Za-z][\w+.-]*):", 1), F.regexp_extract(base, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(bare.rlike(r"^[A-Za-z][\w+.-]*://[^/]*$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, r"[^/]*$", ""))
    return (
        F.when(link.rlike(r"^[A-Za-z][\w+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(host, link))
        .when(F.startswith(link, F.lit("?")) | F.startswith(link, F.lit("#")), F.concat(bare, link))
        .otherwise(F.concat(folder, link))
    )


def with_param(url: Column, name: str, value: Column) -> Column:
    """The URL with a query parameter set: replaced where it stands, else added."""
    bare, anchor = F.regexp_replace(url, "#.*$", ""), F.regexp_extract(url, "(#.*)$", 1)
    there = rf"([?&]){name}=[^&]*"
    put = F.concat(F.lit(f"{name}="), value.cast("string"))
    new = F.when(bare.rlike(there), F.regexp_replace(bare, F.lit(there), F.concat(F.lit("$1"), put))).otherwise(F.concat(bare, F.when(F.contains(bare, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), put))
    return F.concat(new, anchor)


def to_root(asked: Column, got: Column) -> Column:
    """A page that answers with its site's root isn't there any more."""
    path = lambda u: F.coalesce(F.regexp_extract(u, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    return path(got).isin("", "/") & ~path(asked).isin("", "/")


def phrase_confirmed(text: Column, phrase: Column, unless: Column) -> Column:
    """Some occurrence of the phrase without a word that says it stopped within NEAR characters on either side, and no veto anywhere."""
    low, want = F.lower(text), F.lower(phrase)
    veto = F.exists(F.coalesce(unless, F.array().cast("array<string>")), lambda u: F.contains(low, F.lower(u)))
    parts = F.split(low, F.concat(F.lit(r"\Q"), want, F.lit(r"\E")), -1)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.length(F.array_join(F.slice(parts, 1, i), "")) + (i - 1) * F.length(want))
    clear = F.exists(F.when(F.size(parts) > 1, starts).otherwise(F.array().cast("array<int>")), lambda p: ~F.substr(low, F.greatest(p - NEAR, F.lit(0)) + 1, F.least(p, F.lit(NEAR)) + F.length(want) + NEAR).rlike(STOPPED))
    return F.coalesce((F.length(want) > 0) & ~veto & clear, F.lit(False))


def iso_date(value: Column) -> Column:
    return F.substring(value, 1, 10).try_cast("date")


def cache_key(model: Column, version: Column, title_: Column, summary: Column) -> Column:
    sep = F.lit("\x1f")
    return F.substring(F.sha1(F.concat(model, sep, version, sep, F.coalesce(title_, F.lit("")), sep, F.coalesce(summary, F.lit("")))), 1, 16)


def labels_of_reply(reply: Column, vocabulary: list[str], most: int = 3) -> Column:
    """Labels of a model's reply: its first list, of texts or objects with a label; glosses after a dash go; known ones, distinct, `most` at most."""
    body = F.regexp_extract(reply, r"(?s)(\[.*?\])", 1)
    objects = F.transform(F.from_json(body, "array<struct<label: string, theme: string, name: string>>"), lambda o: F.coalesce(o["label"], o["theme"], o["name"]))
    texts = F.when(body.rlike(r"^\[\s*\{"), objects).otherwise(F.from_json(body, "array<string>"))
    clean = F.transform(texts, lambda t: F.trim(F.regexp_replace(t, r"\s+[-–—:(].*$", "")))
    known = F.filter(clean, lambda t: t.isin(vocabulary))
    return F.when(body != "", F.slice(F.array_distinct(F.coalesce(known, F.array().cast("array<string>"))), 1, most))
