"""Texts: markup, fingerprints, role families, model output, search text."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream import config

#: White space of Unicode and the separators \x1c to \x1f; Spark's \s and trim have only the ASCII ones, or the blank.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def strip_html(markup: Column, entities_first: bool = True) -> Column:
    """Plain text of a markup fragment; entities are decoded before the tags go, or after."""

    def decode(c: Column) -> Column:
        """The few entities that nearly all markup has inside the JVM, any other one by Python's table."""
        rest = F.replace(c, F.lit("&nbsp;"), F.lit(" "))
        for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
            rest = F.replace(rest, F.lit(name), F.lit(sign))
        rare = F.coalesce(F.regexp_replace(c, "&(?:lt|gt|quot|#39|apos|amp|nbsp);", "").rlike(r"&(?:#|[A-Za-z])"), F.lit(False))
        return F.when(rare, F.translate(F.pandas_udf(_unescape, "string")(F.when(rare, c)), "\u00a0", " ")).otherwise(rest)

    def untag(c: Column) -> Column:
        return F.regexp_replace(c, "<[^>]+>", " ")

    text = untag(decode(markup)) if entities_first else decode(untag(markup))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def page_fingerprint(text: Column, least: int = 100) -> Column:
    """First 16 hex digits of the SHA-1 of the squeezed lower-case text, of any script; '' for less than ``least`` characters."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    flat = F.lower(F.regexp_replace(bare, f"[{BLANKS}]+", " "))
    return F.when(F.length(bare) < least, F.lit("")).otherwise(F.substring(F.sha1(F.encode(flat, "UTF-8")), 1, 16))


def role_family(title: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    out = None
    for needle, family in config.ROLE_RULES:
        out = F.when(t.contains(needle), family) if out is None else out.when(t.contains(needle), family)
    return out.otherwise("other")


def search_text(*parts: Column) -> Column:
    """The parts in order, blanks between, null and empty ones left out."""
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def unfenced_json(text: Column) -> Column:
    """Model output without its code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def cookie_names(header: Column) -> Column:
    """Names in a joined set-cookie header; commas within dates don't split."""
    return F.transform(F.split(header, r",\s*(?=[^;,\s=]+=)"), lambda c: F.trim(F.split_part(c, F.lit("="), F.lit(1))))


def snippet(title: Column, description: Column, link: Column, most: int = 300) -> Column:
    return F.concat(title, F.lit(" — "), F.left(F.coalesce(description, F.lit("")), F.lit(most)), F.lit(" ("), link, F.lit(")"))


def words(text: Column, least: int = 1) -> Column:
    """Lower-case runs of letters, marks and digits of any script; a script without blanks gives long runs."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")), " "), lambda t: F.length(t) >= least)


def object_of(column: Column) -> Column:
    """A JSON object as a map of texts; any other text, and null, is an empty map."""
    return F.coalesce(F.when(F.trim(column).startswith("{"), F.from_json(column, "map<string,string>")), F.create_map().cast("map<string,string>"))


def first_word(column: Column) -> Column:
    return F.split_part(F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"\s+", " ")), F.lit(" "), F.lit(1))


def main_text(markup: Column) -> Column:
    """Running text of a page: without scripts, styles, navigation, headers, footers and forms; blocks become lines."""
    body = F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?is)<!--.*?-->|<(script|style|nav|header|footer|aside|form|noscript|svg)\b.*?</\1\s*>", " ")
    lines = F.regexp_replace(body, r"(?i)</?(?:p|div|br|li|h[1-6]|tr|section|article)\b[^>]*>", "\u0001")
    parts = F.filter(F.transform(F.split(lines, "\u0001"), lambda x: strip_plain(x)), lambda x: x != "")
    return F.array_join(parts, "\n")


def strip_plain(markup: Column) -> Column:
    """Tags dropped, the common entities decoded, white space squeezed; all inside the JVM."""
    text = F.regexp_replace(markup, "<[^>]+>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def profile_facts(answer: Column) -> Column:
    """struct(funding_stage, total_raised, investors) of a model's JSON answer; blank values are null."""
    v = F.from_json(unfenced_json(answer), "funding_stage string, total_raised string, investors array<string>")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.struct(some(v["funding_stage"]).alias("funding_stage"), some(v["total_raised"]).alias("total_raised"), F.coalesce(F.filter(v["investors"], lambda x: F.trim(x) != ""), F.array().cast("array<string>")).alias("investors"))
