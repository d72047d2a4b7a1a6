"""Company names and the keys by which they are looked up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream import config

_LEGAL = r"(?i)[\s,]+(?:holdings|incorporated|inc|llc|l\.l\.c|ltd|limited|corporation|corp|company|co|plc|gmbh|ag|sas|sa|sl|ab|pty|pvt)\.?$"


def squeezed(column: Column) -> Column:
    """Only lower-case letters and digits, single blanks between the words."""
    return F.trim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", " "))


def clean_name(name: Column) -> Column:
    """Two passes of the legal suffixes, & spelt out, punctuation dropped; null is ''."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    for _ in range(2):
        bare = F.regexp_replace(bare, _LEGAL, "")
    return squeezed(F.regexp_replace(bare, "&", " and "))


def filing_name(name: Column) -> Column:
    words = "|".join(s.replace(".", r"\.") for s in config.FILING_SUFFIXES)
    return squeezed(F.regexp_replace(F.coalesce(name, F.lit("")), rf"(?i)\b({words})\b\.?", " "))


def _without_suffixes(name: Column) -> Column:
    """A fold over the suffix list; nested conditions instead would double the expression with each suffix."""
    base = F.trim(F.lower(F.coalesce(name, F.lit(""))))
    suffixes = F.array(*[F.lit(s) for s in config.DIRECTORY_SUFFIXES])
    return F.aggregate(suffixes, base, lambda b, s: F.when(F.endswith(b, s), F.trim(F.left(b, F.length(b) - F.length(s)))).otherwise(b))


def directory_key(name: Column) -> Column:
    """Letters and digits after the suffixes were taken off in their order, each at most once."""

    return F.regexp_replace(_without_suffixes(name), "[^a-z0-9]+", "")


def domain_stem(domain: Column) -> Column:
    stem = F.split_part(F.regexp_replace(F.lower(domain), r"www\.", ""), F.lit("."), F.lit(1))
    return F.when(F.length(stem) >= 2, stem)


def state_code(value: Column) -> Column:
    """Two-letter code of a US state: its name, its code, its name within the text, or a last code before a ZIP."""
    v = F.trim(F.lower(value))
    codes = list(config.STATE_CODES.values())
    out = F.when((F.length(v) == 2) & v.isin(codes), v)
    for full, code in config.STATE_CODES.items():
        out = out.when(v == full, F.lit(code))
    for full, code in config.STATE_CODES.items():
        out = out.when(v.rlike(rf"\b{full}\b"), F.lit(code))
    tail = F.regexp_extract(v, r"\b([a-z]{2})\b\s*\d{0,5}\s*$", 1)
    return out.when(tail.isin(codes), tail)


def name_keys(cleaned: Column) -> Column:
    """Lookup keys of a cleaned name, strictest first: itself, c: without blanks, t: without trailing descriptors
    (at least two words stay), k: its sorted distinctive words (if at least two)."""
    descriptors = F.array(*[F.lit(d) for d in config.NAME_DESCRIPTORS])
    words = "|".join(config.NAME_DESCRIPTORS)
    tokens = F.split(cleaned, " ")
    core = F.array_sort(F.array_distinct(F.filter(tokens, lambda t: ~F.array_contains(descriptors, t))))
    # The first two words are protected; what follows loses its trailing run of descriptors.
    head, tail = F.array_join(F.slice(tokens, 1, 2), " "), F.array_join(F.slice(tokens, 3, 1000), " ")
    trimmed = F.regexp_replace(tail, rf"(?:^|\s+)(?:(?:{words})(?:\s+|$))+$", "")
    stripped = F.trim(F.concat_ws(" ", head, F.trim(trimmed)))
    keys = F.array(cleaned, F.concat(F.lit("c:"), F.regexp_replace(cleaned, " ", "")), F.concat(F.lit("t:"), stripped), F.when(F.size(core) >= 2, F.concat(F.lit("k:"), F.array_join(core, " "))))
    return F.filter(keys, lambda k: k.isNotNull())


def is_weak_name(cleaned: Column, common_words=config.COMMON_WORDS) -> Column:
    """Whether a cleaned name is unsafe alone: short, generic, a common word or a compound of two, or all generic words."""
    tokens = F.split(cleaned, " ")
    vague = F.array(*[F.lit(w) for w in dict.fromkeys((*config.GENERIC_TOKENS, *config.NAME_DESCRIPTORS))])
    common = F.array(*[F.lit(w) for w in common_words])
    n = F.length(cleaned)
    compound = F.exists(F.sequence(F.lit(3), F.greatest(n - 3, F.lit(3))), lambda i: (n >= 6) & F.array_contains(common, F.substring(cleaned, F.lit(1), i)) & F.array_contains(common, F.substring(cleaned, i + 1, n)))
    single = (n <= 3) | F.array_contains(vague, cleaned) | F.array_contains(common, cleaned) | compound
    return F.when(cleaned == "", True).when(F.size(tokens) == 1, single).otherwise(F.forall(tokens, lambda t: F.array_contains(vague, t) | (F.length(t) <= 2)))


def name_tokens(name: Column, least: int = 2) -> Column:
    return F.filter(F.split(squeezed(F.coalesce(name, F.lit(""))), " "), lambda t: F.length(t) >= least)


def relevance_multiplier(name: Column) -> Column:
    """0.5 for no or one short word, 0.6 with a generic word, else 1."""
    tokens = name_tokens(name)
    generic = F.array(*[F.lit(t) for t in config.GENERIC_TOKENS])
    return F.when(F.size(tokens) == 0, 0.5).when((F.size(tokens) == 1) & (F.length(F.try_element_at(tokens, F.lit(1))) <= 4), 0.5).when(F.arrays_overlap(tokens, generic), 0.6).otherwise(1.0)


def title_mentions(title: Column, name: Column) -> Column:
    """Whether a title names a company: of several words one of at least four letters as a whole word; a single
    word of up to four letters anywhere in a title of under 80 characters, a longer one as a whole word."""
    t, tokens = F.lower(title), name_tokens(name)
    padded = F.concat(F.lit(" "), F.regexp_replace(t, "[^a-z0-9_]+", " "), F.lit(" "))
    whole = lambda w: padded.contains(F.concat(F.lit(" "), w, F.lit(" ")))
    one = F.try_element_at(tokens, F.lit(1))
    found = F.when(F.size(tokens) >= 2, F.exists(tokens, lambda w: (F.length(w) >= 4) & whole(w))).when(F.length(one) <= 4, t.contains(one) & (F.length(t) < 80)).otherwise(whole(one))
    return F.coalesce((F.length(title) > 0) & (F.length(name) > 0) & (F.size(tokens) > 0) & found, F.lit(False))


def slug_variants(name: Column, domain: Column) -> Column:
    """Board slugs to try: domain stem, hyphenated, joined, and a long distinctive first word."""
    base = _without_suffixes(name)
    hyphen = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    first = F.split_part(hyphen, F.lit("-"), F.lit(1))
    generic = F.array(*[F.lit(t) for t in config.GENERIC_TOKENS])
    long_first = F.when(hyphen.contains("-") & (F.length(first) >= 6) & ~F.array_contains(generic, first), first)
    return F.filter(F.array_distinct(F.array(domain_stem(domain), hyphen, F.regexp_replace(base, "[^a-z0-9]+", ""), long_first)), lambda v: v.isNotNull() & (v != ""))


def entity_slug(value: Column, separator: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", separator), f"^{separator}+|{separator}+$", "")
