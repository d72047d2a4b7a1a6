"""Quantities recorded in different units and scales, converted to common units.

A text is rewritten into fields (currency, number, scale, currency of one or two amounts, open end) by one anchored
pattern inside the JVM. These become candidates, the combinations of units that the text leaves open: a sign before
three digits is a thousands or a decimal sign; a number without any unit has every currency and every power of a
thousand. Identities hold between columns: dollars = number x scale x rate of the currency, and both tables state the
money that one company has raised; employee_range and headcount are one company's number of people. Of the candidates
the one with the least sum of squared log residuals against the other statements of the quantity is chosen; where
the next one is as good, or nothing else states the quantity, the value is flagged as not unique.

Scale: the texts are parsed once, without a shuffle, into a staged table. A text with one candidate needs no identity
and no join. The others' identities are one anchor per entity (squared residuals against many statements are least
where the residual against their mean is), pre-aggregated before the join, so that a hot entity is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.runtime import staged

# Currency signs and codes as written, by ISO code.
CURRENCIES = {
    "us$": "USD", "usd": "USD", "$": "USD", "ca$": "CAD", "c$": "CAD", "cad": "CAD", "a$": "AUD", "au$": "AUD", "aud": "AUD", "r$": "BRL", "brl": "BRL",
    "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR", "£": "GBP", "gbp": "GBP", "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR",
    "¥": "JPY", "jpy": "JPY", "yen": "JPY", "sek": "SEK", "kr": "SEK", "chf": "CHF", "fr.": "CHF",
}

# Scale words.
SCALES = {
    "k": 10**3, "tsd": 10**3, "thousand": 10**3, "m": 10**6, "mm": 10**6, "mn": 10**6, "mio": 10**6, "mio.": 10**6, "mill": 10**6, "million": 10**6, "millions": 10**6,
    "b": 10**9, "bn": 10**9, "billion": 10**9, "mrd": 10**9, "mrd.": 10**9, "tn": 10**12, "trillion": 10**12,
    "cr": 10**7, "cr.": 10**7, "crore": 10**7, "crores": 10**7, "lakh": 10**5, "lakhs": 10**5, "lac": 10**5, "dozen": 12, "score": 20,
}

#: Residuals that differ by no more than this (in logs) are equally good.
TOLERANCE = 0.05

#: Scales whose writers use the comma as decimal sign.
COMMA_DECIMAL_SCALES = ("mio", "mio.", "mrd", "mrd.", "tsd")


def _alternatives(words) -> str:
    return "|".join(w.replace(".", r"\.").replace("$", r"\$") for w in sorted(words, key=len, reverse=True))


_CUR = f"(?<![a-z])(?:{_alternatives(CURRENCIES)})(?![a-z])"
_NUM = r"\d{1,3}(?:[ ,.']\d{3})+(?:[.,]\d+)?(?!\d|e[+-]?\d)|\d+(?:[.,]\d+)?(?:e[+-]?\d+)?"
_SCALE = f"(?:{_alternatives(SCALES)})(?![a-z])"
_AMOUNT = rf"(?:({_CUR})\s*)?({_NUM})\s*({_SCALE})?\s*({_CUR})?"
_LEAD = r"^(.*?)"
#: Groups: 1 lead; 2-5 first amount; 6-9 second amount; 10 what follows.
QUANTITY = rf"{_LEAD}{_AMOUNT}(?:\s*(?:-|–|—|\bto\b|\band\b|\.\.|,(?= ))\s*{_AMOUNT})?(.*)$"
_FIELDS = "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"
_OPEN_LEAD = r"(?:\b(?:min|minimum|at least|more than|over|above|from)\b\.?|>|≥)\s*$"
_OPEN_TAIL = r"^\s*(?:\+|or more|and more|and up|plus)|^\s*[a-z]*\s*\+"
_UNIT = rf"^(k)?\s*({_CUR}|[a-z]{{3}})?\s*({_SCALE})?$"


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is evaluated once a row: a generator keeps projections from being merged and repeated."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _lookup(table: dict, key: Column, kind: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), key).cast(kind)


def plain_text(column: Column) -> Column:
    """Lower case, white space squeezed; what stands in brackets of the kind (round, year) is a remark."""
    text = F.trim(F.regexp_replace(F.lower(column), r"[\s   ]+", " "))
    text = F.regexp_replace(text, r"\s*\([^)]*\)", "")
    return F.regexp_replace(text, r"\|", " ")


def total_part(text: Column) -> Column:
    """If the text names a total beside its parts, the total's amount; otherwise the whole text."""
    named = F.regexp_extract(text, r"\btotal(?:ling|led| of)?:?\s+([^;]*\d.*?)(?:,?\s+of which.*)?$", 1)
    return F.when(named != "", named).otherwise(text)


def readings(number: Column, scale: Column) -> Column:
    """Array of the decimal strings that the written number can stand for, the likeliest first.

    One sign before exactly three digits is the doubtful form: a thousands or a decimal sign. A comma is doubtful before a
    scale word of a language with decimal commas only, and then likelier decimal; a dot is likelier decimal before a
    scale word of another language.
    """
    squeezed = F.regexp_replace(number, "[ ']", "")
    last_comma = F.regexp_replace(F.regexp_replace(squeezed, r"\.", ""), ",", ".")
    no_comma = F.regexp_replace(squeezed, ",", "")
    no_dot = F.regexp_replace(squeezed, r"\.", "")
    both = squeezed.contains(".") & squeezed.contains(",")
    one_dot = squeezed.rlike(r"^[1-9]\d{0,2}\.\d{3}$")
    one_comma = squeezed.rlike(r"^[1-9]\d{0,2},\d{3}$")
    comma_scale = scale.isin(*COMMA_DECIMAL_SCALES)
    marked = (
        F.when(both & squeezed.rlike(r",\d*$"), F.array(last_comma))
        .when(both, F.array(no_comma))
        .when(squeezed.rlike(r"\..*\."), F.array(no_dot))
        .when(squeezed.rlike(r",.*,"), F.array(no_comma))
        .when(one_dot, F.when((scale == "") | comma_scale, F.array(no_dot, squeezed)).otherwise(F.array(squeezed, no_dot)))
        .when(one_comma, F.when(comma_scale, F.array(last_comma, no_comma)).otherwise(F.array(no_comma)))
        .when(squeezed.contains(","), F.array(last_comma))
        .otherwise(F.array(squeezed))
    )
    return F.when(squeezed.rlike("[.,]"), marked).otherwise(F.array(squeezed))


def parsed_quantities(values: DataFrame, text: str, unit: str | None = None) -> DataFrame:
    """Adds ``q``: struct(currency, scaled, lows, highs, open_up), or null where the text has no number.

    ``lows`` and ``highs`` are the candidate ends in the text's own unit, likeliest first; ``scaled`` tells whether
    a scale was stated; ``unit`` is a column with the unit where the text has none.
    """
    df = _once(values, "_t", total_part(plain_text(F.col(text))))
    df = _once(df, "_f", F.when(F.col("_t").rlike(r"\d"), F.split(F.regexp_replace("_t", QUANTITY, _FIELDS), r"\|")))
    f = [F.element_at("_f", i + 1) for i in range(10)]
    unit_text = F.lower(F.trim(F.col(unit))) if unit else F.lit(None).cast("string")
    df = _once(df, "_u", F.when(unit_text.rlike(_UNIT), F.split(F.regexp_replace(unit_text, _UNIT, "$1|$2|$3"), r"\|")))
    u = [F.coalesce(F.element_at("_u", i + 1), F.lit("")) for i in range(3)]

    def first(*columns: Column) -> Column:
        out = F.lit("")
        for c in reversed(columns):
            out = F.when(c != "", c).otherwise(out)
        return out

    own = first(f[1], f[4], f[5], f[8])
    scale2 = f[7]
    scale1 = F.when(f[3] != "", f[3]).when((f[6] != "") & (f[1] == ""), scale2).otherwise("")  # "between 1 and 2 million USD"
    unit_scale = first(u[2], u[0])
    cell = F.struct(
        _lookup(CURRENCIES, F.when(own != "", own).otherwise(u[1]), "string").alias("currency"),
        F.when(scale1 != "", scale1).otherwise(F.when(own == "", unit_scale).otherwise("")).alias("s1"),
        F.when(scale2 != "", scale2).otherwise(F.when(own == "", unit_scale).otherwise("")).alias("s2"),
        f[2].alias("n1"),
        f[6].alias("n2"),
        (f[0].rlike(_OPEN_LEAD) | f[9].rlike(_OPEN_TAIL)).alias("open_up"),
    )
    df = _once(df, "_c", F.when(F.col("_f").isNotNull() & (f[2] != ""), cell))

    def ends(number: Column, scale: Column) -> Column:
        factor = F.coalesce(_lookup(SCALES, scale, "long"), F.lit(1)).cast("decimal(13,0)")
        return F.filter(F.transform(readings(number, scale), lambda x: (x.try_cast("decimal(22,6)") * factor).cast("decimal(26,4)")), lambda x: x.isNotNull())

    q = F.struct(
        F.col("_c.currency").alias("currency"),
        (F.col("_c.s1") != "").alias("scaled"),
        ends(F.col("_c.n1"), F.col("_c.s1")).alias("lows"),
        F.when(F.col("_c.n2") != "", ends(F.col("_c.n2"), F.col("_c.s2"))).alias("highs"),
        F.col("_c.open_up").alias("open_up"),
    )
    df = _once(df, "q", F.when(F.col("_c").isNotNull(), q))
    return df.select(*values.columns, F.when(F.size("q.lows") > 0, F.col("q")).alias("q"))


def anchors(observations: DataFrame) -> DataFrame:
    """kind, entity, anchor: the mean log of the observations of each entity that can be read in one way only."""
    return observations.filter(F.col("value") > 0).groupBy("kind", "entity").agg(F.avg(F.ln(F.col("value").cast("double"))).alias("anchor"))


def solve(candidates: Column, anchor: Column, tolerance: float = TOLERANCE) -> Column:
    """struct(chosen, residual, solution): of an array of candidates (currency, scale, low, high), the likeliest first,
    the one of least log residual against ``anchor``.

    ``solution`` is stated (there is one candidate), identity (the identity decides), or not_unique (no anchor, or two
    candidates within ``tolerance`` of each other; then a stated currency's likeliest candidate is kept, and of all
    currencies the nearest). The log of a range is that of its middle.
    """
    log = lambda x: F.ln(F.greatest(x.cast("double"), F.lit(1e-9)))
    residual = lambda c: F.abs((log(c["low"]) + log(F.coalesce(c["high"], c["low"]))) / 2 - anchor)
    scored = F.array_sort(F.transform(candidates, lambda c, i: F.struct(residual(c).alias("r"), i.alias("i"))))
    one, two = F.try_element_at(scored, F.lit(1)), F.try_element_at(scored, F.lit(2))
    clear = anchor.isNotNull() & (two["r"] - one["r"] > tolerance)
    bare = F.size(candidates) > 2
    at = F.when(clear | (bare & anchor.isNotNull()), one["i"] + 1).otherwise(F.lit(1))
    return F.struct(F.element_at(candidates, at).alias("chosen"), F.when(anchor.isNotNull(), one["r"]).alias("residual"), F.when(F.size(candidates) == 1, "stated").when(clear, "identity").otherwise("not_unique").alias("solution"))


def quantity_fields(results: DataFrame, companies: DataFrame) -> DataFrame:
    """The texts of the three fields: table_name, record_id, field_name, kind, entity, text, unit; repeated rows once."""

    def field(df: DataFrame, table: str, name: str, kind: str, entity: str, unit: str | None) -> DataFrame:
        return df.select(F.lit(table).alias("table_name"), F.col("id").alias("record_id"), F.lit(name).alias("field_name"), F.lit(kind).alias("kind"), F.col(entity).alias("entity"), F.col(name).alias("text"), (F.col(unit) if unit else F.lit(None).cast("string")).alias("unit"))

    raised = field(results, "company_signal_result", "total_raised", "money", "company_id", "amount_unit")
    company = companies.select("id", F.explode(F.array(F.struct(F.lit("funding").alias("field_name"), F.lit("money").alias("kind"), F.col("funding").alias("text")), F.struct(F.lit("employee_range").alias("field_name"), F.lit("people").alias("kind"), F.col("employee_range").alias("text")))).alias("f"))
    stated = company.select(F.lit("discovery_company").alias("table_name"), F.col("id").alias("record_id"), "f.field_name", "f.kind", F.col("id").alias("entity"), "f.text", F.lit(None).cast("string").alias("unit"))
    return raised.unionByName(stated).filter(F.col("text").rlike(r"\d")).distinct()


def unit_combinations(rates: DataFrame) -> DataFrame:
    """One row, ``all``: every currency with its rate and every power of a thousand; a rate table has at most some 180 currencies."""
    table = rates.select("currency", F.col("usd_per_unit").cast("decimal(12,8)").alias("rate")).filter(F.col("currency").isNotNull() & F.col("rate").isNotNull()).groupBy("currency").agg(F.max("rate").alias("rate"))
    return table.select("currency", "rate", F.explode(F.array(*[F.lit(10**k).cast("long") for k in (0, 3, 6, 9)])).alias("scale")).agg(F.collect_list(F.struct("currency", "scale", "rate")).alias("all"))


CANDIDATE = "array<struct<currency:string,scale:bigint,low:decimal(30,6),high:decimal(30,6)>>"


def solved_quantities(results: DataFrame, companies: DataFrame, rates: DataFrame) -> DataFrame:
    """table_name, record_id, field_name, currency, scale, low_value, high_value, residual, solution, has_unit: one row for
    each text that states a quantity.

    Input: company_signal_result (id, company_id, total_raised, amount_unit), discovery_company (id, funding,
    employee_range, headcount) and currency_rate. Values are whole US dollars (half up) or people. A single value has
    equal ends; one open upwards has high_value -1. The currency in the text prevails over amount_unit; ``has_unit`` is
    false for money that names neither a currency nor a scale, which is solved by the identity alone: without any other
    statement of its company its values are null and its solution is none. Money with a scale only, or with a currency
    without a rate, gives no row, nor do null, blank and numberless texts. Repeated rows count once. Empty tables are
    allowed. Texts with a stated total are read at the total, otherwise at their first amount.
    """
    parsed = staged(parsed_quantities(quantity_fields(results, companies), "text", "unit").filter(F.col("q").isNotNull()).drop("text", "unit"), "quantities")
    money, people = F.col("kind") == "money", F.col("kind") == "people"
    bare = money & F.col("q.currency").isNull() & ~F.col("q.scaled")
    stated = unit_combinations(rates).select(F.map_from_entries(F.transform(F.filter("all", lambda x: x["scale"] == 1), lambda x: F.struct(x["currency"], x["rate"]))).alias("rates"), "all")
    df = parsed.filter(people | bare | F.col("q.currency").isNotNull()).join(F.broadcast(stated), F.lit(True))
    rate = F.when(people, F.lit(1).cast("decimal(12,8)")).otherwise(F.try_element_at("rates", F.col("q.currency")))

    def candidate(currency: Column, scale: Column, factor: Column, low: Column, high: Column) -> Column:
        to = lambda x: (x * factor).cast("decimal(30,6)")
        return F.struct(currency.alias("currency"), scale.alias("scale"), to(low).alias("low"), to(high).alias("high"))

    # Both ends of a range are read alike.
    high_of = lambda i: F.coalesce(F.try_element_at("q.highs", F.when(F.size("q.highs") == F.size("q.lows"), i + 1).otherwise(F.lit(1))), F.lit(None).cast("decimal(26,4)"))
    read = F.transform("q.lows", lambda low, i: candidate(F.when(money, F.col("q.currency")), F.lit(1).cast("long"), rate, low, high_of(i)))
    every = F.transform("all", lambda x: candidate(x["currency"], x["scale"], x["rate"] * x["scale"].cast("decimal(13,0)"), F.element_at("q.lows", 1), F.try_element_at("q.highs", F.lit(1))))
    options = F.when(bare, every.cast(CANDIDATE)).otherwise(read.cast(CANDIDATE))
    df = df.filter(bare | rate.isNotNull()).select("table_name", "record_id", "field_name", "kind", "entity", "q.open_up", (~bare).alias("has_unit"), options.alias("candidates")).filter(F.size("candidates") > 0)

    single = F.size("candidates") == 1
    sure = df.filter(single & F.col("candidates")[0]["high"].isNull() & F.col("has_unit")).select("kind", "entity", F.col("candidates")[0]["low"].alias("value"))
    known = companies.filter(F.col("headcount") > 0).select(F.lit("people").alias("kind"), F.col("id").alias("entity"), F.col("headcount").cast("decimal(30,6)").alias("value")).distinct()
    # People are judged by headcount alone: a count that is read in one way is no statement of another row.
    open_ = df.filter(~single).join(anchors(sure.filter(money).unionByName(known)), ["kind", "entity"], "left").withColumn("s", solve(F.col("candidates"), F.col("anchor")))
    fixed = df.filter(single).select("table_name", "record_id", "field_name", "open_up", "has_unit", F.col("candidates")[0].alias("c"), F.lit(None).cast("double").alias("residual"), F.lit("stated").alias("solution"))
    solved = open_.select("table_name", "record_id", "field_name", "open_up", "has_unit", F.when(F.col("has_unit") | F.col("anchor").isNotNull(), F.col("s.chosen")).alias("c"), F.col("s.residual").alias("residual"), F.when(~F.col("has_unit") & F.col("anchor").isNull(), "none").otherwise(F.col("s.solution")).alias("solution"))
    out = fixed.unionByName(solved)
    low = F.round("c.low", 0).cast("long")
    high = F.when(F.col("c.high").isNotNull(), F.round("c.high", 0).cast("long")).when(F.col("open_up") & low.isNotNull(), F.lit(-1).cast("long")).otherwise(low)
    swap = (high >= 0) & (high < low)
    return out.select(
        "table_name", "record_id", "field_name", "c.currency", "c.scale", F.when(swap, high).otherwise(low).alias("low_value"), F.when(swap, low).otherwise(high).alias("high_value"),
        F.round("residual", 6).alias("residual"), "solution", "has_unit",
    )


def converted_quantities(solved: DataFrame) -> DataFrame:
    """table_name, record_id, field_name, low_value, high_value, solution of the quantities whose unit is stated."""
    return solved.filter("has_unit").select("table_name", "record_id", "field_name", "low_value", "high_value", "solution")


def converted_money(results: DataFrame, companies: DataFrame, rates: DataFrame) -> DataFrame:
    """The money whose unit is stated."""
    return converted_quantities(solved_quantities(results, companies, rates)).filter(F.col("field_name") != "employee_range")


def converted_head_counts(companies: DataFrame) -> DataFrame:
    """The same for discovery_company.employee_range in people; its identity is the column headcount."""
    nothing = companies.select("id", F.col("id").alias("company_id"), F.col("employee_range").alias("total_raised"), F.col("employee_range").alias("amount_unit")).limit(0)
    rates = companies.select(F.col("employee_range").alias("currency"), F.lit(1.0).alias("usd_per_unit")).limit(0)
    return converted_quantities(solved_quantities(nothing, companies, rates)).filter(F.col("field_name") == "employee_range")


def inferred_units(results: DataFrame, companies: DataFrame, rates: DataFrame) -> DataFrame:
    """The money that is written without any unit: table_name, record_id, field_name, currency, scale, usd, residual, solution."""
    solved = solved_quantities(results, companies, rates).filter(~F.col("has_unit"))
    return solved.select("table_name", "record_id", "field_name", "currency", "scale", F.col("low_value").alias("usd"), "residual", "solution")
