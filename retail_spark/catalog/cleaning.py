"""Column cleaners, on the raw views (and on page and chat text)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retail_spark.catalog import oracle_views as o
from retail_spark.catalog.registry import entry
from retail_spark.functions import cleaning as clean
from retail_spark.plans.cleaning import flat_customers
from retail_spark.sources.readers import SOURCE_ORDER

# The character names that the pages use, for the SQL side.
PAGE_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def _page_text_sql() -> str:
    text = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g')"
    text = rf"regexp_replace({text}, '(?is)</?[a-z][^>]*>|<[!?][^>]*>', '', 'g')"
    for name, letter in PAGE_ENTITIES:
        text = f"replace({text}, '{name}', '{letter}')"
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


#: Every date is written once more in one of these ways and has to come back.
OTHER_FORMS = (
    "yyyy/MM/dd", "yyyy.M.d", "yyyyMMdd", "M/d/yy", "EEEE, MMMM d, yyyy", "EEE d MMM yyyy", "MMMM yyyy", "d'th' MMM yyyy",
)

_PARSED, _WAY = o.date_of("order_date"), f"CAST(order_id AS BIGINT) % {len(OTHER_FORMS)}"


@entry(
    "clean_parse_date",
    f"""SELECT order_id, CAST(s1 AS BIGINT) AS s1, order_date, {o.iso(_PARSED)} AS parsed,
    {o.iso(o.date_of("order_date", day_first=True))} AS parsed_day_first,
    {o.iso(f"CASE WHEN {_WAY} = {OTHER_FORMS.index('MMMM yyyy')} THEN CAST(date_trunc('month', {_PARSED}) AS DATE) ELSE {_PARSED} END")} AS reparsed
    FROM r_orders""",
)
def clean_parse_date(v):
    raw = F.col("order_date")
    way = F.col("order_id").cast("bigint") % len(OTHER_FORMS)
    forms = [F.when(way == k, F.date_format("parsed", form)) for k, form in enumerate(OTHER_FORMS)]
    return v.orders_raw.select(
        "order_id",
        F.col(f"{SOURCE_ORDER}.l_linenumber").alias("s1"),
        "order_date",
        clean.parse_date(raw).alias("parsed"),
        clean.parse_date(raw, day_first=True).alias("parsed_day_first"),
    ).withColumn("reparsed", clean.parse_date(F.coalesce(*forms)))


@entry(
    "clean_price",
    """SELECT order_id, unit_price,
    CAST(try_cast(regexp_replace(unit_price, '[^0-9.]', '', 'g') AS DECIMAL(18,2)) AS DOUBLE) AS price FROM r_orders""",
)
def clean_price(v):
    return v.orders_raw.select("order_id", "unit_price", clean.clean_price(F.col("unit_price")).alias("price"))


@entry("clean_bool", f"SELECT src_ord, is_active, {o.flag('is_active')} AS flag FROM r_customers")
def clean_bool(v):
    return v.customers_raw.select(SOURCE_ORDER, "is_active", clean.to_flag(F.col("is_active")).alias("flag"))


@entry(
    "clean_verified",
    f"SELECT src_ord, verified_purchase, {o.verified('verified_purchase')} AS verified FROM r_reviews",
)
def clean_verified(v):
    c = F.col("verified_purchase")
    return v.reviews_raw.select(SOURCE_ORDER, "verified_purchase", clean.to_verified(c).alias("verified"))


@entry("clean_strip_html", f"SELECT page_id, {_page_text_sql()} AS page_text FROM pages")
def clean_strip_html(v):
    return v.table("pages").select("page_id", clean.strip_html(F.col("html")).alias("page_text"))


@entry("clean_rating", f"SELECT src_ord, rating, CAST({o.rating('rating')} AS DOUBLE) AS cleaned FROM r_reviews")
def clean_rating(v):
    return v.reviews_raw.select(SOURCE_ORDER, "rating", clean.to_rating(F.col("rating")).alias("cleaned"))


@entry("clean_synonyms_status", f"SELECT order_id, status, {o.status('status')} AS cleaned FROM r_orders")
def clean_synonyms_status(v):
    return v.orders_raw.select("order_id", "status", clean.clean_status(F.col("status")).alias("cleaned"))


@entry(
    "clean_synonyms_payment", f"SELECT order_id, payment_method, {o.payment('payment_method')} AS cleaned FROM r_orders"
)
def clean_synonyms_payment(v):
    c = F.col("payment_method")
    return v.orders_raw.select("order_id", "payment_method", clean.clean_payment_method(c).alias("cleaned"))


@entry(
    "clean_title_case",
    f"""SELECT 'customer' AS source, src_ord, {o.title("first_name")} AS first, {o.title("city")} AS second FROM r_customers
    UNION ALL SELECT 'product', src_ord, {o.title("product_name")}, {o.title("sku")} FROM r_products""",
)
def clean_title_case(v):
    people = flat_customers(v.customers_raw)

    def titled(df, source, first, second):
        return df.select(
            F.lit(source).alias("source"),
            SOURCE_ORDER,
            clean.title_case(F.col(first)).alias("first"),
            clean.title_case(F.col(second)).alias("second"),
        )

    return titled(people, "customer", "first_name", "city").unionByName(
        titled(v.products_raw, "product", "product_name", "sku")
    )


@entry(
    "clean_lower_trim",
    "SELECT src_ord, lower(trim(email)) AS email, lower(trim(loyalty_tier)) AS loyalty_tier FROM r_customers",
)
def clean_lower_trim(v):
    return v.customers_raw.select(
        SOURCE_ORDER,
        clean.lower_strip(F.col("email")).alias("email"),
        clean.lower_strip(F.col("loyalty_tier")).alias("loyalty_tier"),
    )


@entry(
    "clean_presence_flag",
    """SELECT 'email' AS flag, src_ord, email IS NOT NULL AS present FROM r_customers
    UNION ALL SELECT 'review_text', src_ord, coalesce(trim(review_text) <> '', false) FROM r_reviews""",
)
def clean_presence_flag(v):
    emails = v.customers_raw.select(
        F.lit("email").alias("flag"), SOURCE_ORDER, clean.has_value(F.col("email")).alias("present")
    )
    texts = v.reviews_raw.select(
        F.lit("review_text").alias("flag"), SOURCE_ORDER, clean.has_text(F.col("review_text")).alias("present")
    )
    return emails.unionByName(texts)


@entry(
    "clean_numeric_coerce",
    """SELECT order_id, total_amount, CAST(try_cast(total_amount AS DECIMAL(18,2)) AS DOUBLE) AS amount,
    try_cast(unit_price AS DOUBLE) AS price_as_number FROM r_orders""",
)
def clean_numeric_coerce(v):
    return v.orders_raw.select(
        "order_id",
        "total_amount",
        clean.to_money(F.col("total_amount")).alias("amount"),
        clean.to_double(F.col("unit_price")).alias("price_as_number"),
    )


@entry(
    "clean_fill_default",
    """SELECT 'discount' AS field, CAST(order_id AS VARCHAR) AS id,
      CAST(coalesce(try_cast(discount_pct AS DOUBLE), 0.0) AS VARCHAR) AS filled FROM r_orders
    UNION ALL SELECT 'tier', CAST(src_ord AS VARCHAR), coalesce(loyalty_tier, 'none') FROM r_customers
    UNION ALL SELECT 'category', CAST(src_ord AS VARCHAR), coalesce(category, 'uncategorized') FROM r_products""",
)
def clean_fill_default(v):
    def filled(df, field, key, value):
        return df.select(
            F.lit(field).alias("field"), F.col(key).cast("string").alias("id"), value.cast("string").alias("filled")
        )

    discount = F.coalesce(clean.to_double(F.col("discount_pct")), F.lit(0.0))
    return (
        filled(v.orders_raw, "discount", "order_id", discount)
        .unionByName(filled(v.customers_raw.fillna({"loyalty_tier": "none"}), "tier", SOURCE_ORDER, F.col("loyalty_tier")))
        .unionByName(
            filled(v.products_raw.fillna({"category": "uncategorized"}), "category", SOURCE_ORDER, F.col("category"))
        )
    )


@entry(
    "clean_int_cast",
    """SELECT src_ord, coalesce(CAST(trunc(try_cast(helpful_votes AS DOUBLE)) AS BIGINT), 0) AS votes,
    CAST(trunc(CAST(weight AS DOUBLE)) AS BIGINT) AS whole_weight
    FROM r_reviews r LEFT JOIN (SELECT product_id, weight_kg AS weight FROM r_products) p ON p.product_id = r.product_id""",
)
def clean_int_cast(v):
    weights = v.products_raw.select("product_id", "weight_kg")
    return v.reviews_raw.join(weights, "product_id", "left").select(
        SOURCE_ORDER,
        clean.to_whole(F.col("helpful_votes"), default=0).alias("votes"),
        clean.to_whole(F.col("weight_kg")).alias("whole_weight"),
    )


@entry("clean_iso_date_text", f"SELECT src_ord, {o.iso(o.date_of('signup_date'))} AS signup_text FROM r_customers")
def clean_iso_date_text(v):
    parsed = clean.parse_date(F.col("signup_date"))
    return v.customers_raw.select(SOURCE_ORDER, clean.iso_text(parsed).alias("signup_text"))


@entry(
    "clean_clamp_min",
    """SELECT src_ord, stock_quantity, greatest(try_cast(stock_quantity AS BIGINT), 0)
      * (CASE WHEN stock_quantity IS NULL THEN NULL ELSE 1 END) AS clamped,
    coalesce(try_cast(stock_quantity AS BIGINT) < 0, false) AS was_clamped FROM r_products""",
)
def clean_clamp_min(v):
    stock = clean.to_whole(F.col("stock_quantity"))
    return v.products_raw.select(
        SOURCE_ORDER,
        "stock_quantity",
        clean.clamp_min(stock).alias("clamped"),
        F.coalesce(stock < 0, F.lit(False)).alias("was_clamped"),
    )


@entry(
    "clean_bool_to_int",
    f"""SELECT 'is_active' AS flag, src_ord, CAST(coalesce({o.flag("is_active")}, false) AS BIGINT) AS stored
    FROM r_customers
    UNION ALL SELECT 'verified_purchase', src_ord, CAST({o.verified("verified_purchase")} AS BIGINT) FROM r_reviews""",
)
def clean_bool_to_int(v):
    active = v.customers_raw.select(
        F.lit("is_active").alias("flag"),
        SOURCE_ORDER,
        clean.flag_to_int(clean.to_flag(F.col("is_active"))).alias("stored"),
    )
    verified = v.reviews_raw.select(
        F.lit("verified_purchase").alias("flag"),
        SOURCE_ORDER,
        clean.flag_to_int(clean.to_verified(F.col("verified_purchase")), null_as_zero=False).alias("stored"),
    )
    return active.unionByName(verified)


@entry("clean_nan_to_null", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN value END AS value FROM events")
def clean_nan_to_null(v):
    measured = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return v.table("events").select("event_id", clean.nan_to_null(measured).alias("value"))


@entry(
    "clean_column_names",
    "SELECT c_custkey AS customer_key, c_name AS full_name, c_acctbal AS balance FROM customer",
)
def clean_column_names(v):
    exported = v.table("customer").select(
        F.col("c_custkey").alias(" Customer Key "), F.col("c_name").alias("Full Name"), F.col("c_acctbal").alias("BALANCE ")
    )
    return exported.toDF(*clean.clean_names(exported.columns))


@entry(
    "clean_rename_nested",
    "SELECT customer_id, first_name, last_name, city, country, postal_code FROM r_customers",
)
def clean_rename_nested(v):
    return flat_customers(v.customers_raw).select(
        "customer_id", "first_name", "last_name", "city", "country", "postal_code"
    )


REPLIES = """SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN '```sql' || chr(10) || text || chr(10) || '```'
  WHEN 1 THEN 'SQL: ' || text WHEN 2 THEN 'sql:```SELECT ' || text || '```' ELSE text END AS reply FROM conversations"""


def replies(v):
    """Chat turns dressed up as model replies that carry a statement."""
    k = (F.col("conv_id") + F.col("turn")) % 4
    text = F.col("text")
    reply = (
        F.when(k == 0, F.concat(F.lit("```sql\n"), text, F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("SQL: "), text))
        .when(k == 2, F.concat(F.lit("sql:```SELECT "), text, F.lit("```")))
        .otherwise(text)
    )
    return v.table("conversations").select("conv_id", "turn", reply.alias("reply"))


_BARE = r"regexp_replace(regexp_replace(reply, '(?i)```(sql)?', '', 'g'), '^\s+|\s+$', '', 'g')"


@entry(
    "text_extract_sql",
    rf"""SELECT conv_id, turn,
    regexp_replace(regexp_replace({_BARE}, '(?i)^sql:', ''), '^\s+|\s+$', '', 'g') AS statement FROM ({REPLIES}) t""",
)
def text_extract_sql(v):
    return replies(v).select("conv_id", "turn", clean.extract_statement(F.col("reply")).alias("statement"))
