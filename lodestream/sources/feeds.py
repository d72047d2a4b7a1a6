"""News and product feeds: links to feeds, entries, verdicts on entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream import config
from lodestream.functions import dates, text, urls

_RSS = "channel struct<item:array<struct<title:string,link:string,pubDate:string,description:string,source:string>>>"
_ATOM = "entry array<struct<title:string,link:array<struct<_href:string,_rel:string>>,updated:string,published:string,summary:string>>"

# An entry's category and the event that it is.
NEWS_EVENTS = {
    "funding": "funding_round", "exec_hire": "exec_hire", "exec_departure": "exec_departure", "layoffs": "layoffs", "acquisition": "acquisition",
    "expansion": "expansion", "partnership": "partnership", "product": "product_launch", "business_news": "news_mention",
}
FEED_EVENTS = {"launch": "product_launch", "funding": "funding_round", "exec_hire": "exec_hire", "expansion": "expansion", "acquisition": "acquisition", "partnership": "partnership"}


def rss_items(feeds: DataFrame) -> DataFrame:
    """company_id, place, title, url, written, summary of RSS documents (company_id, xml); items need a title."""
    doc = feeds.select("company_id", F.from_xml("xml", _RSS).alias("d"))
    each = doc.select("company_id", F.posexplode("d.channel.item").alias("place", "e"))
    return each.select("company_id", "place", F.trim("e.title").alias("title"), F.col("e.link").alias("url"), F.col("e.pubDate").alias("written"), text.strip_html(F.col("e.description")).alias("summary")).filter(F.col("title") != "")


def atom_entries(feeds: DataFrame) -> DataFrame:
    doc = feeds.select("company_id", F.from_xml("xml", _ATOM).alias("d"))
    each = doc.select("company_id", F.posexplode("d.entry").alias("place", "e"))
    return each.select("company_id", "place", F.trim("e.title").alias("title"), F.try_element_at("e.link", F.lit(1))["_href"].alias("url"), F.coalesce("e.published", "e.updated").alias("written"), text.strip_html(F.col("e.summary")).alias("summary")).filter(F.col("title") != "")


def recent(entries: DataFrame, as_of: Column, days: int, most: int, undated: bool) -> DataFrame:
    """The newest ``most`` entries of each company that are not older than the days; ``undated`` tells whether an
    entry without a readable date passes."""
    at = dates.parse_event_date(F.col("written"))
    fresh = at >= as_of - F.make_dt_interval(F.lit(days))
    kept = entries.withColumn("event_date", at).filter((at.isNull() & F.lit(undated)) | fresh)
    w = Window.partitionBy("company_id").orderBy(F.desc_nulls_last("event_date"), "place")
    return kept.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


# Words in a feed's address, the most telling first.
FEED_WORDS = ("changelog", "release", "product", "news", "press", "blog")


def feed_links(pages: DataFrame, keywords=FEED_WORDS, most: int = 3) -> DataFrame:
    """company_id, feed_url, place of the feeds that a page (company_id, url, html) links to on its own site, by the
    first keyword in their address."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<link\b[^>]*application/(?:rss|atom)\+xml[^>]*>"), F.lit(0))
    each = pages.select("company_id", "url", F.posexplode(tags).alias("place", "tag"))
    href = F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']([^\"']+)", 1)
    site = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    full = F.when(href.startswith("/"), F.concat(site, href)).otherwise(href)
    rank = F.lit(len(keywords))
    for i, word in reversed(list(enumerate(keywords))):
        rank = F.when(F.lower("feed_url").contains(word), i).otherwise(rank)
    own = each.withColumn("feed_url", full).filter((full != "") & urls.same_site(F.col("feed_url"), F.col("url")))
    w = Window.partitionBy("company_id").orderBy(rank, "place")
    return own.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("company_id", "feed_url", "place")


def judged(entries: DataFrame, verdicts: DataFrame, events: dict[str, str]) -> DataFrame:
    """Entries with the verdict of their place (company_id, i, category); one of an unknown category, or for a place
    that there isn't, is dropped."""
    table = F.create_map(*[F.lit(x) for k, v in events.items() for x in (k, v)])
    v = verdicts.select("company_id", F.col("i").alias("place"), F.try_element_at(table, F.col("category")).alias("event_type")).filter(F.col("event_type").isNotNull())
    return entries.join(v, ["company_id", "place"])


def demoted(events: DataFrame, amount: str = "amount") -> DataFrame:
    """A funding event with neither an amount nor a round in its title is but a mention."""
    bare = (F.col("event_type") == "funding_round") & (F.coalesce(F.col(amount), F.lit("")) == "") & ~F.coalesce(F.col("title"), F.lit("")).rlike(config.ROUND_WORDS)
    return events.withColumn("event_type", F.when(bare, "news_mention").otherwise(F.col("event_type")))


def verdicts_from_model(outputs: DataFrame) -> DataFrame:
    """company_id, i, category, amount, story of a model's answers (company_id, answer): a JSON list, or an object
    with items or results, with or without a code fence; an unreadable answer gives none."""
    item = "array<struct<i:int,category:string,amount:string,story:string>>"
    a = text.unfenced_json(F.col("answer"))
    wrapped = F.from_json(a, f"items {item}, results {item}")
    items = F.when(a.startswith("["), F.from_json(a, item)).otherwise(F.coalesce(wrapped["items"], wrapped["results"]))
    return outputs.select("company_id", F.explode(items).alias("v")).select("company_id", "v.i", "v.category", "v.amount", "v.story").filter(F.col("i").isNotNull())
