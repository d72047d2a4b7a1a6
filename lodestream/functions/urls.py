"""Hosts, root domains, board addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream import config


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def root_domain(value: Column) -> Column:
    """The last two labels; a leading www. is taken off as a prefix."""
    labels = F.split(F.regexp_replace(F.lower(value), r"^www\.", ""), r"\.")
    return F.when(F.size(labels) >= 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(F.element_at(labels, 1))


def same_site(url: Column, site: Column) -> Column:
    """Whether an address is on the site of another: its host is the site's or below it, www. aside."""
    h, s = F.lower(F.try_parse_url(url, F.lit("HOST"))), host(site)
    return (h == s) | h.endswith(F.concat(F.lit("."), s))


def path_slug(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"/([^/?#]+)/?$", 1), F.lit(""))


def profile_url(url: Column) -> Column:
    """Canonical address of a company page on the professional network."""
    slug = F.lower(F.regexp_extract(url, r"(?i)linkedin\.com/company/([A-Za-z0-9_%\-.]+)", 1))
    return F.when(slug != "", F.concat(F.lit("https://www.linkedin.com/company/"), slug))


def board_candidates(html: Column) -> Column:
    """Distinct 'board:slug' in order of the patterns; slugs of at least two characters, ashby's in lower case."""
    def labelled(board: str, slugs: Column) -> Column:
        return F.transform(F.filter(slugs, lambda s: F.length(s) >= 2), lambda s: F.concat(F.lit(board + ":"), s))

    found = []
    for board, pattern in config.BOARD_PATTERNS:
        slugs = F.regexp_extract_all(html, F.lit("(?i)" + pattern), F.lit(1))
        slugs = F.transform(slugs, lambda s: F.lower(s)) if board == "ashby" else slugs
        found.append(labelled(board, slugs))
    embed = F.regexp_extract_all(html, F.lit(config.EMBEDDED_BOARD), F.lit(1))
    found.append(labelled("greenhouse", embed))
    return F.array_distinct(F.flatten(F.array(*found)))
