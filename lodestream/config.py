"""Vocabularies and defaults; every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# Descriptors shared by many unrelated companies.
NAME_DESCRIPTORS = (
    "therapeutics", "pharmaceuticals", "pharma", "bio", "biosciences", "biotherapeutics",
    "medical", "health", "healthcare", "systems", "technologies", "technology", "tech",
    "software", "solutions", "labs", "lab", "analytics", "ai", "data", "digital", "networks",
    "group", "holdings", "partners", "capital", "ventures", "global", "international",
    "services", "industries", "enterprises", "robotics", "energy", "sciences", "the", "and",
    "co", "company", "corp", "inc", "llc", "ltd", "hq", "io", "app", "platform", "cloud",
)

# Short names that collide with unrelated things.
GENERIC_TOKENS = (
    "scale", "ramp", "notion", "apollo", "stripe", "square", "circle",
    "linear", "beam", "flow", "wave", "spark", "pulse", "core", "base",
    "path", "bridge", "cloud", "data", "tech", "labs", "ai", "io",
)

# US states and their codes.
STATE_CODES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca",
    "colorado": "co", "connecticut": "ct", "delaware": "de", "district of columbia": "dc",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il",
    "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la",
    "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn",
    "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv",
    "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny",
    "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or",
    "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd",
    "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va",
    "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}

# Needle and role family, the first that is contained decides.
ROLE_RULES = (
    ("account executive", "sales_ae"), ("sales", "sales"), ("sdr", "sales_sdr"), ("solutions engineer", "solutions_eng"),
    ("support", "support"), ("security", "security"), ("infrastructure", "infra"), ("sre", "infra"), ("devops", "infra"),
    ("data", "data"), ("machine learning", "ml"), (" ai", "ml"), ("product manager", "product"), ("product designer", "design"),
    ("designer", "design"), ("marketing", "marketing"), ("finance", "finance"), ("legal", "legal"), ("people", "people_ops"),
    ("recruit", "people_ops"), ("engineer", "engineering"),
)

# Legal suffixes of a filing name and of a directory key, in their order.
FILING_SUFFIXES = ("inc", "incorporated", "llc", "l.l.c", "ltd", "limited", "corp", "corporation", "co", "company", "holdings", "technologies", "technology", "labs", "group")
DIRECTORY_SUFFIXES = (" inc", " inc.", " llc", " ltd", " corp", " corporation", " co", " co.", " technologies", " technology", " tech", " solutions", " group", " labs", " ai", " io", ".io", ".ai")

# Event types of which several outlets report one event, and the weights of a heat score.
CLUSTER_TYPES = ("funding_round", "exec_hire", "exec_departure", "layoffs", "acquisition", "expansion", "partnership", "product_launch", "news_mention")
EVENT_WEIGHTS = {
    "funding_round": 30, "exec_hire": 18, "job_change": 15, "product_launch": 18, "gov_contract": 20, "role_spike": 14, "hiring_surge": 14,
    "concept_spike": 20, "role_first_seen": 18, "concept_first_seen": 15, "news_mention": 10, "tech_first_seen": 10, "tech_dropped": 12,
    "exec_departure": 16, "layoffs": 16, "acquisition": 20, "expansion": 12, "partnership": 10, "social_post": 8, "engagement": 12, "competitor_touch": 14,
}

# Words of a title that make a funding round of it, and of a signal that speak of money.
ROUND_WORDS = r"(?i)\b(series [a-h]|seed|pre-seed|round)\b"
MONEY_WORDS = r"(?i)\b(series\s*[a-j]|seed\s*round|pre-seed|raised\s+\$|funding\s+round|\$\d+[\d,.]*\s*[mbk]?)\b"

# The address of a job on a careers page of its own, with the first path part as the board's slug.
EMBEDDED_BOARD = r"(?i)https?://[^/\s\"']+/([a-zA-Z0-9_-]+)\?[^\"'\s]*gh_jid=\d+"

# Categories of technologies whose adoption is an event.
TECH_EVENT_CATEGORIES = (
    "A/B Testing", "Accounting", "Advertising", "Analytics", "Appointment scheduling",
    "Authentication", "CMS", "CRM", "Customer data platform", "Documentation", "Ecommerce",
    "Email", "Feature management", "Form builders", "IaaS", "Issue trackers", "LMS",
    "Live chat", "Loyalty & rewards", "Marketing automation", "PaaS", "Payment processors",
    "Personalisation", "RUM", "Recruitment & staffing", "Referral marketing", "Retargeting",
    "Reviews", "Search engines", "Segmentation", "Surveys", "Translation", "User onboarding",
    "Webmail", "Wikis",
)

# Patterns of technologies in markup, where there is no rule set.
FALLBACK_TECH = (
    ("hubspot", (r"hubspot\.com", r"hs-scripts", r"hbspt\.")), ("salesforce", (r"salesforce\.com", r"force\.com", r"pardot\.com")), ("intercom", (r"intercom\.io", r"intercomSettings")),
    ("drift", (r"drift\.com",)), ("zendesk", (r"zendesk\.com",)), ("crisp", (r"crisp\.chat", r"client\.crisp\.chat")), ("calendly", (r"calendly\.com",)), ("stripe", (r"js\.stripe\.com", r"stripe\.com/v3")),
    ("braintree", (r"braintreegateway\.com",)), ("paypal", (r"paypalobjects\.com",)), ("segment", (r"cdn\.segment\.com", r"analytics\.js")), ("mixpanel", (r"mixpanel\.com", r"mixpanel\.init")),
    ("heap", (r"heapanalytics\.com", r"heap\.io")), ("hotjar", (r"hotjar\.com",)), ("clarity", (r"clarity\.ms",)), ("klaviyo", (r"a\.klaviyo\.com", r"klaviyo\.com/onsite")), ("mailchimp", (r"list-manage\.com",)),
    ("shopify", (r"cdn\.shopify\.com", r"Shopify\.theme")), ("react", (r"_next/static", r"react\.production\.min", r"__NEXT_DATA__")), ("next.js", (r"_next/", r"__NEXT_DATA__")),
    ("vue", (r"vue\.runtime", r"__vue__")), ("angular", (r"ng-version=",)), ("cloudflare", (r"cloudflare\.com", r"__cf_bm", r"cf-ray")),
)

# Sources whose events are tied to the company by identity.
IDENTITY_SOURCES = ("company_feed", "sec_edgar", "sec_8k", "usaspending", "warn_notice", "github", "npm")

# Job boards and the address pattern whose first group is the board's slug.
BOARD_PATTERNS = (
    ("greenhouse", r"boards\.greenhouse\.io/([a-zA-Z0-9_-]+)"),
    ("greenhouse", r"boards-api\.greenhouse\.io/v1/boards/([a-zA-Z0-9_-]+)"),
    ("lever", r"jobs\.lever\.co/([a-zA-Z0-9_-]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([a-zA-Z0-9_-]+)"),
    ("smartrecruiters", r"jobs\.smartrecruiters\.com/([a-zA-Z0-9_-]+)"),
    ("workable", r"apply\.workable\.com/([a-zA-Z0-9_-]+)"),
    ("rippling", r"ats\.rippling\.com/([a-zA-Z0-9_-]+)"),
    ("jazzhr", r"([a-zA-Z0-9_-]+)\.applytojob\.com"),
    ("icims", r"((?:us)?careers-[a-zA-Z0-9_-]+)\.icims\.com"),
)

# The order in which boards are tried, and their root domains.
MAIN_BOARDS, OTHER_BOARDS = ("greenhouse", "lever", "ashby", "smartrecruiters", "workable"), ("rippling", "jazzhr", "icims")
BOARD_ORDER = ("greenhouse", "lever", "ashby", "smartrecruiters", "workable", "icims", "jazzhr", "rippling")
BOARD_ROOTS = ("greenhouse.io", "lever.co", "ashbyhq.com", "smartrecruiters.com", "workable.com", "rippling.com", "applytojob.com", "icims.com")

# Text in a TXT record and host part of an MX record, and the vendor each shows.
TXT_VENDORS = {
    "google-site-verification": "google_workspace", "ms=": "microsoft365", "atlassian-domain-verification": "atlassian", "stripe-verification": "stripe",
    "hubspot": "hubspot", "zoom": "zoom", "docusign": "docusign", "slack-domain-verification": "slack", "notion": "notion", "miro-verification": "miro",
    "openai-domain-verification": "openai", "linear-domain-verification": "linear", "facebook-domain-verification": "meta_ads",
    "apple-domain-verification": "apple_business", "canva-site-verification": "canva", "loom-verification": "loom", "webex": "webex", "dropbox-domain-verification": "dropbox",
}
MX_VENDORS = (("google", "google_workspace"), ("outlook", "microsoft365"), ("microsoft", "microsoft365"), ("zoho", "zoho"), ("proofpoint", "proofpoint"))

# Header synonyms of layoff notices by field, in order of preference.
NOTICE_HEADERS = {
    "company": ("company", "business legal name", "business name", "employer", "job_site_name", "organization"),
    "notice_date": ("notice_date", "date of warn notice", "notice date", "received date", "received_date", "wfdd_received_date", "date received", "date posted", "effective date", "effective_date", "layoff start date"),
    "employees": ("num_employees", "number of affected workers", "# of workers", "total_layoff_number", "employees affected", "number of employees", "workforce affected", "affected", "workers"),
    "location": ("city", "city_name", "location", "impacted site address", "address"),
}

#: Words for the weak-name test; a stand-in for a word-frequency list, to be replaced by a larger one where needed.
COMMON_WORDS = (
    "air", "apple", "base", "bank", "beam", "blue", "book", "box", "bridge", "bright", "circle", "city", "clear", "cloud", "core", "data", "east", "edge", "fire", "first",
    "flow", "forge", "gold", "green", "grid", "hub", "iron", "key", "lake", "light", "line", "link", "moon", "mountain", "nest", "north", "notion", "ocean", "origin", "park",
    "path", "pulse", "ramp", "red", "river", "rock", "scale", "sky", "snow", "south", "spark", "square", "star", "stone", "storm", "stripe", "summit", "sun", "tide", "tower",
    "tree", "unity", "wave", "west", "wind", "wood", "work",
)


@dataclass(frozen=True)
class Defaults:
    """Numbers that the operators use where the caller gives none."""

    surge_ratio: float = 1.5
    spike_posts: int = 3
    concept_posts: int = 2
    concept_days: int = 30
    first_seen_days: int = 7
    cluster_days: int = 30
    cluster_memory: int = 25
    cluster_similarity: int = 72
    strict_similarity: int = 85
    sources_kept: int = 10
    merge_gain: float = 0.05
    merge_cap: float = 0.98
    heat_days: float = 30.0
    heat_cap: float = 100.0
    headroom: float = 0.9
    windows: dict = field(default_factory=lambda: {"1 minute": 200, "1 hour": 6000, "1 day": 50000})


DEFAULTS = Defaults()
