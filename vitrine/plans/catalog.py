"""The catalogue and event views that the queries run on, from the star-schema tables.

Each view has a DataFrame form and the same as SQL text, so that results can be compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.classify import detect_genders
from vitrine.operators.catalog_query import CatalogQuery

SIZES = ["XS", "S", "M", "L", "XL", "2XL", "3XL"]
COLORS = ["siyah", "beyaz", "gri", "bej", "kirmizi", "pembe", "yesil", "mavi", "mor", "cok-renkli"]
HEXES = ["#111111", "#f0efea", "#8a8a86", "#cdbfa2", "#b03030", "#d1789b", "#4a7a45", "#2f6aa8", "#6a3a8a", "#8a8a90"]
STYLES = ["streetwear", "basic", "ravewear", "minimalist", "y2k", "techwear"]
CATEGORY = {"ECONOMY": "TİŞÖRT", "SMALL": "HOODIE", "MEDIUM": "CEKET", "PROMO": "ÇANTA", "STANDARD": "PANTOLON", "LARGE": "ELBİSE"}
GROUP = {"TİŞÖRT": "ÜST GİYİM", "HOODIE": "ÜST GİYİM", "CEKET": "DIŞ GİYİM", "ÇANTA": "AKSESUAR", "PANTOLON": "ALT GİYİM", "ELBİSE": "ELBİSE"}
#: What stands after a product's name for the rules that find whom it is for.
FOR_WHOM = ["erkek", "kadın", "unisex", "oversize", ""]
CURRENCY = {"EUROPE": "EUR", "AMERICA": "USD"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt over all cores by a key: a small table is few splits, which heavy work on each row would leave to a few tasks."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, key)


def lookup(pairs: dict[str, str], key: Column, default: str | None = None) -> Column:
    found = F.lit(default).cast("string")
    for k, v in pairs.items():
        found = F.when(key == k, v).otherwise(found)
    return found


def sql_lookup(pairs: dict[str, str], key: str, default: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {default} END"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def variants(spark: SparkSession, sf_dir: str, parts: DataFrame | None = None) -> DataFrame:
    """One row per product and supplier: (pid, sid, vprice, vstock, lines, n, shipped); parts: only these parts' rows are aggregated."""
    lines = table(spark, sf_dir, "lineitem")
    if parts is not None:
        lines = lines.join(parts.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    unit = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100
    return (
        lines.groupBy(F.col("l_partkey").alias("pid"), F.col("l_suppkey").alias("sid"))
        .agg(
            F.min(unit).alias("vprice"),
            F.max(F.col("l_returnflag") == "N").alias("vstock"),
            F.collect_set("l_linenumber").alias("lines"),
            F.count(F.lit(1)).alias("n"),
            F.max("l_shipdate").alias("shipped"),
        )
    )


def part_condition(q: CatalogQuery) -> Column | None:
    """What a product query says of the part table alone; its other filters need the aggregated line items."""
    types = [t for t, c in CATEGORY.items() if c == q.category]
    found = [F.col("p_type").isin(types)] if types else []
    found += [F.col("p_brand").isin(q.brands)] if q.brands else []
    styles = [F.shiftright("p_size", STYLES.index(s)).bitwiseAND(1) == 1 for s in q.styles if s in STYLES]
    found += [reduce(lambda a, b: a | b, styles)] if styles else []
    return reduce(lambda a, b: a & b, found) if found else None


def products(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """The catalogue: one row per part.  pos is the load order and the last key of every sort.

    where: a condition on the part table; line items of other parts are left out before they are aggregated.
    """
    parts = table(spark, sf_dir, "part")
    parts = parts if where is None else parts.filter(where)
    pick = lambda values, ids: F.transform(ids, lambda i: F.element_at(F.array(*map(F.lit, values)), i.cast("int")))
    per = (
        variants(spark, sf_dir, None if where is None else parts)
        .groupBy("pid")
        .agg(
            F.min("vprice").alias("price_min"),
            F.max("vprice").alias("price_max"),
            F.max("vstock").alias("in_stock"),
            F.sum("n").alias("pop"),
            F.max("shipped").alias("shipped"),
            F.count(F.lit(1)).alias("n_variants"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("lines"),
            F.array_sort(F.collect_set(F.col("sid") % len(COLORS) + 1)).alias("cids"),
        )
    )
    newest = table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").alias("newest"))  # looked up only where `day` is wanted
    bits = F.array(*[F.when(F.shiftright("p_size", k).bitwiseAND(1) == 1, F.lit(s)) for k, s in enumerate(STYLES)])
    empty = F.array().cast("array<string>")
    return (
        parts.join(per, F.col("p_partkey") == F.col("pid"), "left")
        .select(
            F.col("p_partkey").alias("pos"),
            F.col("p_partkey").cast("string").alias("id"),
            F.col("p_brand").alias("brand"),
            F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("brand_slug"),
            F.col("p_name").alias("name"),
            lookup(CATEGORY, F.col("p_type"), "DİĞER").alias("category"),
            F.col("p_retailprice").alias("price"),
            "price_min",
            "price_max",
            F.coalesce("in_stock", F.lit(False)).alias("in_stock"),
            F.coalesce("pop", F.lit(0)).alias("pop"),
            F.coalesce(F.datediff(newest.scalar(), "shipped") % 60, F.lit(30)).cast("int").alias("day"),
            (1 + F.col("p_size") % 7).cast("int").alias("n_images"),
            F.coalesce("n_variants", F.lit(0)).alias("n_variants"),
            F.coalesce(pick(SIZES, F.col("lines")), empty).alias("sizes"),
            F.coalesce(pick(COLORS, F.col("cids")), empty).alias("color_tags"),
            F.filter(bits, lambda s: s.isNotNull()).alias("styles"),
            F.element_at(F.array(*map(F.lit, HEXES)), (F.col("p_size") % 10 + 1).cast("int")).alias("hex"),
        )
        .withColumn("genders", detect_genders(F.concat_ws(" ", "name", F.element_at(F.array(*map(F.lit, FOR_WHOM)), (F.col("pos") % 5 + 1).cast("int"))), F.col("category"), F.col("sizes")))
    )


PRODUCT_SQL = f"""
variant AS (
  SELECT l_partkey AS pid, l_suppkey AS sid, min(floor(l_extendedprice / l_quantity * 100) / 100) AS vprice, bool_or(l_returnflag = 'N') AS vstock,
         list(DISTINCT l_linenumber) AS lines, count(*) AS n, max(l_shipdate) AS shipped
  FROM lineitem GROUP BY 1, 2),
per AS (
  SELECT pid, min(vprice) AS price_min, max(vprice) AS price_max, bool_or(vstock) AS in_stock, CAST(sum(n) AS BIGINT) AS pop, max(shipped) AS shipped, count(*) AS n_variants,
         list_sort(list_distinct(flatten(list(lines)))) AS lines, list_sort(list(DISTINCT sid % {len(COLORS)} + 1)) AS cids
  FROM variant GROUP BY 1),
product AS (
  SELECT p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand, lower(replace(p_brand, '#', '-')) AS brand_slug, p_name AS name,
         {sql_lookup(CATEGORY, "p_type", "'DİĞER'")} AS category, p_retailprice AS price, price_min, price_max,
         coalesce(in_stock, false) AS in_stock, coalesce(pop, 0) AS pop,
         coalesce(date_diff('day', shipped, (SELECT max(l_shipdate) FROM lineitem)) % 60, 30) AS day, 1 + p_size % 7 AS n_images,
         coalesce(n_variants, 0) AS n_variants,
         coalesce(list_transform(lines, lambda x: {sql_list(SIZES)}[x]), []) AS sizes,
         coalesce(list_transform(cids, lambda x: {sql_list(COLORS)}[x]), []) AS color_tags,
         list_filter({sql_list(STYLES)}, lambda s, i: (p_size >> CAST(i - 1 AS INTEGER)) & 1 = 1) AS styles,
         {sql_list(HEXES)}[p_size % 10 + 1] AS hex,
         CASE WHEN p_partkey % 5 = 0 THEN ['erkek'] WHEN p_partkey % 5 = 1 THEN ['kadin'] WHEN p_partkey % 5 <> 2 AND p_type = 'LARGE' THEN ['kadin'] WHEN p_partkey % 5 IN (2, 3) THEN ['kadin', 'erkek']
              WHEN len(lines) >= 2 AND list_min(lines) >= 3 AND list_max(lines) >= 5 THEN ['erkek'] ELSE ['kadin', 'erkek'] END AS genders
  FROM part LEFT JOIN per ON pid = p_partkey)"""


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a product is called, from the part table alone: (id, name, brand, brand_slug, category)."""
    slug = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    category = lookup(CATEGORY, F.col("p_type"), "DİĞER")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), slug.alias("brand_slug"), category.alias("category")
    )


def facet(spark: SparkSession, sf_dir: str, values: list[str], number: Column) -> DataFrame:
    """(t, n): of how many products some line item has each value; number: a line item's value, from 1.

    The same counts as the lists of products() would give, from distinct pairs of product and value.
    """
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", number.cast("int").alias("k")).distinct().join(known, "l_partkey", "left_semi")
    return pairs.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(F.element_at(F.array(*map(F.lit, values)), F.col("k")).alias("t"), "n")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product views and click-outs: (pos, ts, day, measure, kind, session, product_id, product_name, brand, brand_slug, category)."""
    raw = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click", "purchase"))
    cols = named(spark, sf_dir).withColumnsRenamed({"id": "product_id", "name": "product_name"})
    view = F.col("event_type") == "view"
    return (
        raw.select(
            F.col("event_id").alias("pos"),
            "ts",
            F.to_date("ts").alias("day"),
            F.when(view, "view").otherwise("out").alias("measure"),
            F.when(view, None).when(F.col("event_type") == "click", "brand").otherwise("product").alias("kind"),
            F.col("user_id").cast("string").alias("session"),
            F.get_json_object("props", "$.k").alias("product_id"),
        )
        .join(cols, "product_id", "left")
    )


EVENT_SQL = """
event AS (
  SELECT event_id AS pos, ts, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'view' THEN 'view' ELSE 'out' END AS measure,
         CASE event_type WHEN 'click' THEN 'brand' WHEN 'purchase' THEN 'product' END AS kind, CAST(user_id AS VARCHAR) AS session,
         json_extract_string(props, '$.k') AS product_id, name AS product_name, brand, brand_slug, category
  FROM events LEFT JOIN product ON id = json_extract_string(props, '$.k')
  WHERE event_type IN ('view', 'click', 'purchase'))"""


def brand_score(slug: Column) -> Column:
    """The editorial score of a brand, 1 to 5, made from its name."""
    from vitrine.functions.text import rand01

    return F.floor(1 + rand01("score", slug) * 5)


FNV_MACRO = """list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(regexp_extract_all({0}, '.'), lambda c: CAST(ascii(c) AS HUGEINT))),
 lambda h, c: (xor(h, c) * 16777619) % 4294967296)"""


def fnv_sql(text: str) -> str:
    return "(" + FNV_MACRO.format(text) + ")"


def rand_sql(seed: str, key: str) -> str:
    return f"(CAST({fnv_sql(f"'{seed}|' || {key}")} AS DOUBLE) / 4294967296.0)"
