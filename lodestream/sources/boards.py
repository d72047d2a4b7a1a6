"""Job boards: payloads of each kind of board as rows of one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream import config
from lodestream.functions import names, text, urls

MOST_BODY = 4000

_SCHEMAS = {
    "greenhouse": "jobs array<struct<id:string,internal_job_id:string,title:string,content:string,absolute_url:string,location:struct<name:string>>>",
    "lever": "array<struct<id:string,text:string,description:string,descriptionPlain:string,company:string,categories:struct<team:string,location:string>>>",
    "ashby": "organization struct<name:string>, jobs array<struct<id:string,title:string,descriptionHtml:string,location:string>>",
    "smartrecruiters": "content array<struct<id:string,name:string,company:struct<name:string>,location:struct<city:string>,jobAd:struct<sections:struct<jobDescription:struct<text:string>>>>>",
    "workable": "name string, jobs array<struct<shortcode:string,id:string,title:string,description:string,full_description:string,location:struct<location_str:string,city:string>>>",
    "rippling": "array<struct<id:string,uuid:string,name:string,url:string,workLocation:struct<label:string>>>",
}


def _some(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def _fields(board: str, p: Column, j: Column) -> list[Column]:
    """external_id, title, location, body, url, organization of a posting ``j`` of payload ``p``."""
    none = F.lit("")
    if board == "greenhouse":
        return [_some(j["id"], j["internal_job_id"]), _some(j["title"]), _some(j["location"]["name"]), _some(j["content"]), _some(j["absolute_url"]), none]
    if board == "lever":
        return [_some(j["id"]), _some(j["text"]), _some(j["categories"]["location"]), _some(j["descriptionPlain"], j["description"]), none, _some(j["company"], F.try_element_at(p, F.lit(1))["categories"]["team"])]
    if board == "ashby":
        # The location is a text or an object with a name.
        return [_some(j["id"]), _some(j["title"]), _some(F.get_json_object(j["location"], "$.name"), j["location"]), _some(j["descriptionHtml"]), none, _some(p["organization"]["name"])]
    if board == "smartrecruiters":
        return [_some(j["id"]), _some(j["name"]), _some(j["location"]["city"]), _some(j["jobAd"]["sections"]["jobDescription"]["text"]), none, _some(j["company"]["name"])]
    if board == "workable":
        return [_some(j["shortcode"], j["id"]), _some(j["title"]), _some(j["location"]["location_str"], j["location"]["city"]), _some(j["description"], j["full_description"]), none, _some(p["name"])]
    return [_some(j["uuid"], j["id"]), _some(j["name"]), _some(j["workLocation"]["label"]), none, _some(j["url"]), none]


def _items(board: str, p: Column) -> Column:
    return p if board in ("lever", "rippling") else p["content"] if board == "smartrecruiters" else p["jobs"]


def posts_from_json(payloads: DataFrame) -> DataFrame:
    """company_id, source, external_id, title, location, body_text, absolute_url, organization_name.

    ``payloads``: company_id, board, payload. A payload that isn't of its board's form gives no post.
    """
    out = None
    for board, schema in _SCHEMAS.items():
        p = payloads.filter(F.col("board") == board).select("company_id", F.from_json("payload", schema).alias("p"))
        each = p.select("company_id", "p", F.explode(_items(board, F.col("p"))).alias("j"))
        names = ("external_id", "title", "location", "body", "absolute_url", "organization_name")
        rows = each.select("company_id", F.lit(board).alias("source"), *[c.alias(n) for c, n in zip(_fields(board, F.col("p"), F.col("j")), names)])
        out = rows if out is None else out.unionByName(rows)
    return out.filter(F.col("external_id") != "").withColumn("body_text", F.left(text.strip_html(F.col("body")), F.lit(MOST_BODY))).drop("body")


def posts_from_html(pages: DataFrame, pattern: str, source: str) -> DataFrame:
    """Posts of a board that is a page of links: the pattern's groups are address, id and title."""
    hits = pages.select("company_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("place", "hit"))
    group = lambda i: F.regexp_extract("hit", pattern, i)
    rows = hits.select("company_id", "place", F.lit(source).alias("source"), text.strip_html(group(1)).alias("absolute_url"), group(2).alias("external_id"), text.strip_html(group(3), entities_first=False).alias("title"))
    return rows.filter(F.col("title") != "").groupBy("company_id", "source", "external_id").agg(F.min_by(F.struct("title", "absolute_url"), "place").alias("r")).select("company_id", "source", "external_id", "r.title", "r.absolute_url")


def posting_ld(pages: DataFrame) -> DataFrame:
    """company_id, title, location, body_text of the JobPosting blocks (JSON-LD) of pages."""
    blocks = pages.select("company_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))).alias("j"))
    j = F.from_json("j", "`@type` string, title string, description string, jobLocation struct<address:struct<addressLocality:string>>")
    return blocks.select("company_id", j.alias("j")).filter(F.col("j.`@type`") == "JobPosting").select("company_id", "j.title", F.col("j.jobLocation.address.addressLocality").alias("location"), text.strip_html(F.col("j.description")).alias("body_text"))


def board_is_own(posts: DataFrame, company: str, domain: str, roots: tuple[str, ...], first: int = 3) -> DataFrame:
    """company_id, own: whether the first posts' addresses lie on the company's domain or on a board's."""
    host = urls.root_domain(urls.host(F.col("absolute_url")))
    foreign = host.isNotNull() & ~host.isin(*roots) & (host != urls.root_domain(F.col(domain)))
    ranked = posts.select(company, F.struct("external_id", foreign.alias("foreign")).alias("p"))
    return ranked.groupBy(company).agg(F.slice(F.array_sort(F.collect_list("p")), 1, first).alias("ps")).select(company, (~F.exists("ps", lambda p: F.coalesce(p["foreign"], F.lit(False)))).alias("own"))


def board_summary(posts: DataFrame) -> DataFrame:
    """company_id, source, n_posts and up to ten titles."""
    return posts.groupBy("company_id", "source").agg(F.count(F.lit(1)).alias("n_posts"), F.slice(F.array_sort(F.collect_set("title")), 1, 10).alias("roles"))


def candidate_boards(companies: DataFrame, company: str, name: str, domain: str, cached: str, html: str, searched: str) -> DataFrame:
    """company_id, place, board, slug, verified_by_page: the boards to try for a company, best first, each once: the one
    that answered before (struct of board and slug), those that the page links to, those that a search found (array of
    'board:slug'), the slugs that the name suggests on each main board, the domain's stem on the others."""
    texts = F.array().cast("array<string>")
    known = F.when((F.col(cached)["board"] != "") & (F.col(cached)["slug"] != ""), F.array(F.concat(F.col(cached)["board"], F.lit(":"), F.col(cached)["slug"]))).otherwise(texts)
    shown = F.concat(known, F.coalesce(urls.board_candidates(F.coalesce(F.col(html), F.lit(""))), texts), F.coalesce(F.col(searched), texts))
    on = lambda boards, slugs: F.flatten(F.transform(slugs, lambda v: F.array(*[F.concat(F.lit(f"{b}:"), v) for b in boards])))
    stem = names.domain_stem(F.col(domain))
    guessed = F.concat(on(config.MAIN_BOARDS, names.slug_variants(F.col(name), F.col(domain))), on(config.OTHER_BOARDS, F.when(stem.isNotNull(), F.array(stem)).otherwise(texts)))
    each = companies.select(F.col(company).alias("company_id"), shown.alias("_shown"), F.posexplode(F.array_distinct(F.concat(shown, guessed))).alias("place", "c"))
    return each.select("company_id", "place", F.split_part("c", F.lit(":"), F.lit(1)).alias("board"), F.regexp_extract("c", "^[^:]*:(.*)$", 1).alias("slug"), F.array_contains("_shown", F.col("c")).alias("verified_by_page"))


def careers_address(slug: Column) -> Column:
    """The base address of a hosted careers page by its slug, which may be an address or have the page's prefix."""
    bare = F.regexp_replace(F.trim(slug), "/+$", "")
    return F.when(bare.rlike("^https?://"), bare).when(bare.rlike("^(?:us)?careers-"), F.concat(F.lit("https://"), bare, F.lit(".icims.com"))).otherwise(F.concat(F.lit("https://careers-"), bare, F.lit(".icims.com")))


def listing_address(slug: Column) -> Column:
    return F.concat(F.lit("https://"), slug, F.lit(".applytojob.com/apply/jobs"))


def detail_address(slug: Column, job: Column) -> Column:
    return F.concat(listing_address(slug), F.lit("/details/"), job)
