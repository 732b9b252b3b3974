"""Event summaries, facets and brand statistics, each with its SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.functions.pages import probe_page
from vitrine.functions.sizes import BANDS, LADDER, band_of
from vitrine.functions.text import looks_like_email, visible_text
from vitrine.operators import audits as A
from vitrine.plans.catalog import COLORS, CURRENCY, EVENT_SQL, GROUP, PRODUCT_SQL, SIZES, STYLES, brand_score, events, facet, lookup, named, products, rand_sql, sql_list, sql_lookup, table, variants

Q: dict = {}
SQL: dict[str, str] = {}
LOOK_BACK = 30


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


P = f"WITH {PRODUCT_SQL}"
E = f"{P}, {EVENT_SQL}"
RECENT = f"{E}, recent AS (SELECT * FROM event WHERE day > (SELECT max(day) FROM event) - {LOOK_BACK})"
ONE = "*"


def recent(spark: SparkSession, sf_dir: str, days: int = LOOK_BACK) -> DataFrame:
    """The events of the last days before and on the newest event's day."""
    ev = events(spark, sf_dir)
    newest = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click", "purchase")).agg(F.max(F.to_date("ts")).alias("newest"))
    return ev.crossJoin(F.broadcast(newest)).filter(F.col("day") > F.date_sub("newest", days)).drop("newest")


def views_and_outs() -> list[Column]:
    return [F.count_if(F.col("measure") == "view").alias("view"), F.count_if(F.col("measure") == "out").alias("out")]


VO = "count(*) FILTER (measure = 'view') AS view, count(*) FILTER (measure = 'out') AS out"


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows with their rank as a column; a top-k aggregation first, so the window sees k rows."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


# -- event analytics ---------------------------------------------------------------------------------


@query(
    "A02_totals",
    f"""{RECENT} SELECT {VO}, count(*) FILTER (kind = 'product') AS out_product, count(*) FILTER (kind = 'brand') AS out_brand,
    CASE WHEN count(*) FILTER (measure = 'view') > 0 THEN count(*) FILTER (measure = 'out') / count(*) FILTER (measure = 'view') ELSE 0.0 END AS ctr,
    count(DISTINCT session) AS sessions, count(DISTINCT day) AS days_with_data FROM recent""",
)
def totals(spark, sf_dir):
    found = recent(spark, sf_dir).agg(
        *views_and_outs(),
        F.count_if(F.col("kind") == "product").alias("out_product"),
        F.count_if(F.col("kind") == "brand").alias("out_brand"),
        F.countDistinct("session").alias("sessions"),
        F.countDistinct("day").alias("days_with_data"),
    )
    return found.withColumn("ctr", F.when(F.col("view") > 0, F.col("out") / F.col("view")).otherwise(0.0))


@query(
    "A03_daily",
    f"""{RECENT}, days AS (SELECT CAST(unnest(generate_series((SELECT max(day) FROM event) - {LOOK_BACK - 1}, (SELECT max(day) FROM event), INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT day, count(pos) FILTER (measure = 'view') AS view, count(pos) FILTER (measure = 'out') AS out FROM days LEFT JOIN recent USING (day) GROUP BY 1""",
)
def daily(spark, sf_dir):
    newest = events(spark, sf_dir).agg(F.max("day").alias("d"))
    days = newest.select(F.explode(F.sequence(F.date_sub("d", LOOK_BACK - 1), "d")).alias("day"))
    counts = recent(spark, sf_dir).groupBy("day").agg(*views_and_outs())
    return days.join(counts, "day", "left").na.fill(0, ["view", "out"])


@query(
    "A04_hourly",
    f"""{RECENT} SELECT CAST(h AS INTEGER) AS hour, count(pos) FILTER (measure = 'view') AS view, count(pos) FILTER (measure = 'out') AS out
    FROM range(24) t(h) LEFT JOIN recent ON hour(ts) = h GROUP BY 1""",
)
def hourly(spark, sf_dir):
    counts = recent(spark, sf_dir).groupBy(F.coalesce(F.hour("ts"), F.lit(0)).alias("hour")).agg(*views_and_outs())
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(counts, "hour", "left").na.fill(0, ["view", "out"])


def _top_events(key: str, k: int, labels: list[str], spark, sf_dir):
    first = F.struct("day", F.when(F.col("measure") == "view", 0).otherwise(1).alias("o"), "pos")
    rows = recent(spark, sf_dir).filter(F.col(key).isNotNull())
    counts = rows.groupBy(key).agg(*views_and_outs(), *(F.min_by(c, first).alias(c) for c in labels))
    return top(counts, k, F.desc(F.col("view") + F.col("out")), F.asc(key))


for _key, _k, _labels in (("brand_slug", 20, ["brand"]), ("category", 15, []), ("product_id", 20, ["product_name", "brand"])):
    query(
        f"A05_by_{_key.split('_')[0]}",
        f"""{RECENT}, c AS (SELECT {_key}, {VO}{"".join(f", arg_min({c}, (day, CASE WHEN measure = 'view' THEN 0 ELSE 1 END, pos)) AS {c}" for c in _labels)}
        FROM recent WHERE {_key} IS NOT NULL GROUP BY 1) SELECT *, row_number() OVER (ORDER BY view + out DESC, {_key}) AS rank FROM c ORDER BY rank LIMIT {_k}""",
    )(partial(_top_events, _key, _k, _labels))


def _outbound(key: str, label: list[str], spark, sf_dir):
    """Click-outs by key, the 50 with most; labels come from the newest day's first event."""
    rows = recent(spark, sf_dir).filter((F.col("measure") == "out") & F.col(key).isNotNull())
    newest = F.struct((-F.datediff("day", F.lit("2000-01-01"))).alias("d"), "pos")
    counts = rows.groupBy(key).agg(F.count(ONE).alias("count"), *(F.min_by(c, newest).alias(c) for c in label))
    return top(counts, 50, F.desc("count"), F.asc(key))


for _key, _labels in (("brand_slug", ["brand"]), ("product_id", ["product_name", "brand"]), ("category", [])):
    query(
        f"A01_outbound_{_key.split('_')[0]}",
        f"""{RECENT}, c AS (SELECT {_key}, count(*) AS count{"".join(f", arg_min({c}, (-date_diff('day', DATE '2000-01-01', day), pos)) AS {c}" for c in _labels)}
        FROM recent WHERE measure = 'out' AND {_key} IS NOT NULL GROUP BY 1) SELECT *, row_number() OVER (ORDER BY count DESC, {_key}) AS rank FROM c ORDER BY rank LIMIT 50""",
    )(partial(_outbound, _key, _labels))


@query(
    "T02_day_buckets",
    f"""{E} SELECT day, measure, count(*) AS n FROM event GROUP BY ALL""",
)
def day_buckets(spark, sf_dir):
    """Tumbling day windows, the batch twin of the streaming count."""
    w = F.window("ts", "1 day").getField("start")
    return events(spark, sf_dir).groupBy(F.to_date(w).alias("day"), "measure").agg(F.count(ONE).alias("n"))


@query("T05_sessions", f"{E} SELECT day, count(DISTINCT session) AS sessions FROM event GROUP BY 1")
def sessions(spark, sf_dir):
    return events(spark, sf_dir).groupBy("day").agg(F.countDistinct("session").alias("sessions"))


@query(
    "T12_rate_limit",
    """WITH gap AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT user_id, count(*) AS n, count(*) FILTER (before IS NOT NULL AND epoch_us(ts) - epoch_us(before) < 60000000) AS limited FROM gap GROUP BY 1""",
)
def rate_limit(spark, sf_dir):
    """Events that come less than a minute after the user's last one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(w))
    near = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp")) < 60_000_000
    return ev.groupBy("user_id").agg(F.count(ONE).alias("n"), F.count_if(F.coalesce(near, F.lit(False))).alias("limited"))


# -- facets and brand statistics ------------------------------------------------------------------------


#: Which line items stand for a size and for a colour, as in the product view.
F_LINE, F_SHADE = "l_linenumber", f"l_suppkey % {len(COLORS)} + 1"


@query(
    "A06_categories",
    f"""{P} SELECT category, count(*) AS n FROM product GROUP BY 1 UNION ALL SELECT 'ALL', count(*) FROM product UNION ALL SELECT 'BRANDS', count(DISTINCT brand) FROM product""",
)
def categories(spark, sf_dir):
    p = named(spark, sf_dir)
    rows = p.select("category", "brand").cube("category").agg(F.count(ONE).alias("n"))
    brands = p.agg(F.countDistinct("brand").alias("n")).select(F.lit("BRANDS").alias("category"), "n")
    return rows.select(F.coalesce("category", F.lit("ALL")).alias("category"), "n").unionByName(brands)


for _id, _col, _values, _number in (("A07_sizes", "sizes", SIZES, F_LINE), ("A09_colors", "color_tags", COLORS, F_SHADE)):
    query(_id, f"{P} SELECT t, count(*) AS n FROM (SELECT unnest({_col}) AS t FROM product) GROUP BY 1")(
        partial(lambda values, number, spark, sf_dir: facet(spark, sf_dir, values, F.expr(number)), _values, _number)
    )


@query(
    "A08_styles",
    f"""{P}, c AS (SELECT s, count(*) AS n FROM (SELECT unnest(styles) AS s FROM product) GROUP BY 1)
    SELECT k AS s, coalesce(n, 0) AS n FROM (SELECT unnest({sql_list([*STYLES, "old-money", "spor"])}) AS k) LEFT JOIN c ON s = k""",
)
def styles(spark, sf_dir):
    domain = spark.createDataFrame([(s,) for s in [*STYLES, "old-money", "spor"]], "s string")
    counts = products(spark, sf_dir).select(F.explode("styles").alias("s")).groupBy("s").agg(F.count(ONE).alias("n"))
    return F.broadcast(domain).join(counts, "s", "left").na.fill(0, ["n"])


@query("A10_groups", f"{P} SELECT {sql_lookup(GROUP, 'category')} AS g, category, count(*) AS n FROM product GROUP BY ROLLUP (g, category)")
def groups(spark, sf_dir):
    p = products(spark, sf_dir).withColumn("g", lookup(GROUP, F.col("category")))
    return p.rollup("g", "category").agg(F.count(ONE).alias("n"))


def sql_band(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} BETWEEN {a} AND {b} THEN '{k}'" for k, a, b in BANDS) + " END"


@query("A11_bands", f"SELECT {sql_band('p_size')} AS band, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def bands(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(band_of(F.col("p_size").cast("string")).alias("band")).agg(F.count(ONE).alias("n"))


@query(
    "A12_brand_stats",
    f"""{P} SELECT brand_slug, count(*) AS total, count(*) FILTER (in_stock) AS live, min(price) AS low, quantile_disc(price, 0.5 ORDER BY price DESC) AS mid, max(price) AS high FROM product GROUP BY 1""",
)
def brand_stats(spark, sf_dir):
    mid = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY price DESC)")
    return products(spark, sf_dir).groupBy("brand_slug").agg(
        F.count(ONE).alias("total"), F.count_if("in_stock").alias("live"), F.min("price").alias("low"), mid.alias("mid"), F.max("price").alias("high")
    )


@query(
    "A12_dominant_currency",
    f"""WITH s AS (SELECT s_suppkey, {sql_lookup(CURRENCY, "r_name", "'TRY'")} AS cur FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    c AS (SELECT p_partkey AS product, cur, count(*) AS n, min(l_orderkey * 8 + l_linenumber) AS first FROM lineitem JOIN part ON l_partkey = p_partkey JOIN s ON l_suppkey = s_suppkey GROUP BY ALL)
    SELECT product, arg_max(cur, (n, -first)) AS cur, max(n) AS n FROM c GROUP BY 1""",
)
def dominant_currency(spark, sf_dir):
    """The currency that most of a product's lines have; of equals the one that was seen first."""
    s = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", lookup(CURRENCY, F.col("r_name"), "TRY").alias("cur"))
    )
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product"), "l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"))
    return A.dominant(lines.join(s, F.col("l_suppkey") == F.col("s_suppkey")), "product", "cur", F.col("at"))


@query(
    "A18_price_range",
    f"{P} SELECT id, price_min, price_max, in_stock, pop, CAST(day AS INTEGER) AS day, n_variants FROM product",
)
def price_range(spark, sf_dir):
    return products(spark, sf_dir).select("id", "price_min", "price_max", "in_stock", "pop", "day", "n_variants")


@query(
    "A22_import_report",
    f"""{P} SELECT count(*) AS n, count(price_min) AS priced, count(*) FILTER (len(sizes) > 0) AS sized, count(*) FILTER (in_stock) AS live,
    count(*) FILTER (len(color_tags) > 1) AS multi, count(DISTINCT brand) AS brands FROM product""",
)
def import_report(spark, sf_dir):
    return products(spark, sf_dir).agg(
        F.count(ONE).alias("n"), F.count("price_min").alias("priced"), F.count_if(F.size("sizes") > 0).alias("sized"), F.count_if("in_stock").alias("live"),
        F.count_if(F.size("color_tags") > 1).alias("multi"), F.countDistinct("brand").alias("brands"),
    )


@query(
    "A23_health",
    f"{P} SELECT brand_slug, count(*) AS n, count(price_min) AS priced, count(*) FILTER (len(sizes) > 0) AS sized FROM product GROUP BY 1",
)
def health(spark, sf_dir):
    return products(spark, sf_dir).groupBy("brand_slug").agg(F.count(ONE).alias("n"), F.count("price_min").alias("priced"), F.count_if(F.size("sizes") > 0).alias("sized"))


@query(
    "A32_size_tokens",
    f"{P}, t AS (SELECT unnest(sizes) AS tok FROM product) SELECT tok, count(*) AS n, list_contains({sql_list(LADDER)}, tok) AS known FROM t GROUP BY 1",
)
def size_tokens(spark, sf_dir):
    t = products(spark, sf_dir).select(F.explode("sizes").alias("tok")).groupBy("tok").agg(F.count(ONE).alias("n"))
    return t.withColumn("known", F.col("tok").isin(LADDER))


@query(
    "A33_outfit_total",
    """SELECT o_orderkey AS outfit, round(coalesce(sum(p), 0), 2) AS total, bool_and(p IS NOT NULL) AS all_priced, arg_min(cur, l_linenumber * 100000000 + l_partkey) FILTER (p IS NOT NULL) AS currency
    FROM orders JOIN (SELECT *, CASE WHEN p_partkey % 7 > 0 THEN p_retailprice END AS p, CASE p_partkey % 3 WHEN 0 THEN 'TRY' WHEN 1 THEN 'EUR' ELSE 'USD' END AS cur FROM lineitem JOIN part ON l_partkey = p_partkey) ON o_orderkey = l_orderkey GROUP BY 1""",
)
def outfit_total(spark, sf_dir):
    """An order's lines as an outfit; every seventh product has no price."""
    cur = F.element_at(F.array(*map(F.lit, ["TRY", "EUR", "USD"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 > 0, F.col("p_retailprice")).alias("price"), cur.alias("currency"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("outfit"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey")).alias("pos"), "l_partkey")
    known = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("outfit")), "outfit", "left_semi")
    return A.outfit_totals(known.join(p, F.col("l_partkey") == F.col("p_partkey"))).withColumn("total", F.round("total", 2))


@query(
    "A34_group_in_order",
    f"{P} SELECT category, count(*) AS n, min(pos) AS first, row_number() OVER (ORDER BY min(pos)) AS rank FROM product GROUP BY 1",
)
def group_in_order(spark, sf_dir):
    g = products(spark, sf_dir).groupBy("category").agg(F.count(ONE).alias("n"), F.min("pos").alias("first"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first")))


# -- joins with dimensions -----------------------------------------------------------------------------


@query("J01_brand_score", f"SELECT DISTINCT p_brand AS brand, floor(1 + {rand_sql('score', 'p_brand')} * 5) AS score, (floor(1 + {rand_sql('score', 'p_brand')} * 5) - 1) / 4 AS score01 FROM part")
def brand_scores(spark, sf_dir):
    s = brand_score(F.col("brand")).cast("double")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct().select("brand", s.alias("score"), ((s - 1) / 4).alias("score01"))


@query(
    "J04_brand_index",
    f"""{P} SELECT brand, count(*) AS n, row_number() OVER (ORDER BY brand) AS rank FROM product WHERE in_stock GROUP BY 1 HAVING count(*) > 0""",
)
def brand_index_counts(spark, sf_dir):
    g = products(spark, sf_dir).filter("in_stock").groupBy("brand").agg(F.count(ONE).alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("brand")))


@query(
    "J06_list_items",
    f"""{P}, l AS (SELECT o_orderkey AS list_id, l_linenumber AS at, CAST(l_partkey + 50 AS VARCHAR) AS pid FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT list_id, count(*) AS n, count(*) FILTER (id IS NULL) AS missing FROM l LEFT JOIN product ON id = pid GROUP BY 1""",
)
def list_items(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ids = ids.select(F.col("o_orderkey").alias("list_id"), (F.col("l_partkey") + 50).cast("string").alias("pid"))
    found = ids.join(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id")), F.col("pid") == F.col("id"), "left")
    return found.groupBy("list_id").agg(F.count(ONE).alias("n"), F.count_if(F.col("id").isNull()).alias("missing"))


@query("J07_in_any_list", f"{P} SELECT id FROM product WHERE pos IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def in_any_list(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("pos"))
    return products(spark, sf_dir).join(listed, "pos", "left_semi").select("id")


@query("J12_archived_brands", f"{P} SELECT id, brand FROM product WHERE brand NOT IN ('Brand#1', 'Brand#7', 'Brand#13')")
def archived_brands(spark, sf_dir):
    gone = spark.createDataFrame([("Brand#1",), ("Brand#7",), ("Brand#13",)], "brand string")
    return products(spark, sf_dir).join(F.broadcast(gone), "brand", "left_anti").select("id", "brand")


@query("J13_untagged", f"{P} SELECT id FROM product WHERE len(color_tags) = 0")
def untagged(spark, sf_dir):
    tagged = variants(spark, sf_dir).select(F.col("pid").alias("pos")).distinct()
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos")).join(tagged, "pos", "left_anti").select(F.col("pos").cast("string").alias("id"))


@query(
    "J19_review_summaries",
    """SELECT CAST(p_partkey AS VARCHAR) AS product_id, count(l_orderkey) AS n, CASE WHEN count(l_orderkey) > 0 THEN floor(avg(1 + l_linenumber % 5) * 10 + 0.5) / 10 END AS mean
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' GROUP BY 1""",
)
def review_summaries(spark, sf_dir):
    """Count and mean rating to one decimal; products without reviews have 0 and null."""
    reviews = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_partkey", (1 + F.col("l_linenumber") % 5).alias("rating"))
    g = reviews.groupBy("l_partkey").agg(F.count(ONE).alias("n"), (F.floor(F.avg("rating") * 10 + 0.5) / 10).alias("mean"))
    p = table(spark, sf_dir, "part").select("p_partkey")
    return p.join(g, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_partkey").cast("string").alias("product_id"), F.coalesce("n", F.lit(0)).alias("n"), "mean")


@query("J20_band_join", f"SELECT p_partkey AS id, {sql_band('p_size')} AS band FROM part")
def band_join(spark, sf_dir):
    """A range join against the six bands, broadcast as they are a fixed table."""
    b = spark.createDataFrame(BANDS, "band string, lo int, hi int")
    return table(spark, sf_dir, "part").join(F.broadcast(b), F.col("p_size").between(F.col("lo"), F.col("hi")), "left").select(F.col("p_partkey").alias("id"), "band")


@query(
    "J21_price_drift",
    f"""{P}, l AS (SELECT pid, sid, vprice * CASE sid % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 1.1 WHEN 2 THEN 1.01 ELSE 0.99 END AS live FROM variant)
    SELECT pid AS id, sid, live, live < price_min AS below FROM l JOIN product ON pos = pid WHERE NOT (live >= price_min * (1 - 0.02) AND live <= price_max * (1 + 0.02))""",
)
def price_drift(spark, sf_dir):
    """Live prices outside their product's range by over two per cent, below it or above."""
    factor = F.element_at(F.array(*map(F.lit, [0.9, 1.1, 1.01, 0.99])), (F.col("sid") % 4 + 1).cast("int"))
    live = variants(spark, sf_dir).select(F.col("pid").alias("id"), "sid", (F.col("vprice") * factor).alias("live"))
    p = products(spark, sf_dir).select(F.col("pos").alias("id"), "price", "price_min", "price_max")
    return A.price_drift(p, live).select("id", "sid", "live", (F.col("live") < F.col("low")).alias("below"))


# -- pages ---------------------------------------------------------------------------------------------


MESSAGE = '<p msg="2.500 TL ürüne ücretsiz kargo" class="x" msg="kısa"><font size=2>bu <mark>gün</mark></font>&NBSP;it&#39;s<noscript>aç</noscript></p>'


@query(
    "X44_visible_text",
    rf"""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html || '{MESSAGE.replace("'", "''")}' ELSE html END AS html FROM pages),
    a AS (SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)\smsg="([^"]{{6,120}})"', 1), ' | ') AS msg, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g') AS t FROM p),
    b AS (SELECT page_id, msg, regexp_replace(regexp_replace(t, '(?i)</?(?:span|b|strong|em|i|u|small|font|mark|abbr|label)\b[^>]*>', '', 'g'), '<[^>]+>', ' | ', 'g') AS t FROM a),
    c AS (SELECT page_id, msg, regexp_replace(regexp_replace(regexp_replace(t, '(?i)&nbsp;?', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&#x27;|&#39;', chr(39), 'g') AS t FROM b)
    SELECT page_id, CASE WHEN msg = '' THEN '' ELSE msg || ' | ' END || regexp_replace(t, '\s+', ' ', 'g') AS text FROM c""",
)
def page_text(spark, sf_dir):
    """Every third page carries an announcement in an attribute, tags that stand inside a line, and a noscript part."""
    html = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit(MESSAGE))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", visible_text(html).alias("text"))


PROBED = [
    '<meta property="og:type" content="Product"><script type="application/ld+json">{"@graph":[{"@type":"Product","offers":[{"price":12.5,"priceCurrency":"EUR"}],"color":"Red","hasVariant":[{"size":"M"}]}]}</script>',
    '<meta property="product:price:amount" content="9,90"><select name="Beden"><option>1</select><button> XL </button><script>var productDetailModel = {}</script>',
    '<script type="application/ld+json">[{"@type":["Thing","Product"],"offers":{"lowPrice":"7"},"image":["a.jpg"],"additionalProperty":[{"name":"Renk"},{"name":"Beden"}]}]</script>',
    '<script type="application/ld+json">{"@type":"Product",</script><script>window.__NEXT_DATA__={}</script><select class="color">',
]


@query(
    "X50_page_probe",
    """SELECT page_id, m IN (0, 2) AS jsonld, CASE WHEN m = 0 THEN 'product' END AS og_type, CASE m WHEN 0 THEN '12.5' WHEN 1 THEN '9,90' WHEN 2 THEN '7' END AS price, CASE WHEN m = 0 THEN 'EUR' END AS currency,
    m IN (0, 2) AS color, m IN (0, 2) AS size_in_data, m = 1 AS size_select, m = 1 AS size_button, m = 2 AS image, m = 1 AS model, m = 3 AS state FROM (SELECT page_id, page_id % 4 AS m FROM pages)""",
)
def page_probe(spark, sf_dir):
    """What product pages give away, in four forms that stores have."""
    head = F.element_at(F.array(*map(F.lit, PROBED)), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", probe_page(F.concat(head, "html")).alias("p")).select("page_id", "p.*")


@query("X33_emails", "SELECT doc_id, length(text) <= 254 AND regexp_matches(text, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]{2,}$') AS ok FROM documents")
def emails(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", looks_like_email(F.col("text")).alias("ok"))


assert len(COLORS) == 10
