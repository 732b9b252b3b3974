"""Entity resolution and keyed user state over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import resolve, userdata
from vitrine.plans.catalog import COLORS, sql_list, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def records(spark, sf_dir):
    """Line items as scraped records: pos, brand_slug, name with a colour word, image, price, pop, day, sizes."""
    color = F.element_at(F.array(*map(F.lit, COLORS)), (F.col("l_suppkey") % 10 + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
        F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("brand_slug"),
        F.concat_ws(" ", "p_name", color).alias("name"),
        F.when(F.col("l_quantity") > 1, F.concat(F.lit("img/"), F.col("l_suppkey").cast("string"))).alias("image"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("price"),
        F.col("l_quantity").cast("long").alias("pop"),
        F.col("l_linenumber").alias("day"),
        F.array(F.col("l_linenumber").cast("string")).alias("sizes"),
        (F.col("l_returnflag") == "N").alias("in_stock"),
    )


RECORDS = f"""WITH rec AS (
  SELECT l_orderkey * 8 + l_linenumber AS pos, lower(replace(p_brand, '#', '-')) AS brand_slug, p_name || ' ' || {sql_list(COLORS)}[l_suppkey % 10 + 1] AS name, p_name,
         CASE WHEN l_quantity > 1 THEN 'img' END AS image, floor(l_extendedprice / l_quantity * 100) / 100 AS price, CAST(l_quantity AS BIGINT) AS pop, l_linenumber AS day,
         l_returnflag = 'N' AS in_stock, l_suppkey % 10 AS c
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(
    "A16_build_groups",
    f"""{RECORDS} SELECT brand_slug, trim(regexp_replace(name, '[^a-zçğıöşü0-9]+', ' ', 'g')) AS key, min(pos) AS pos, count(*) AS n_variants, min(price) AS price_min, max(pop) AS pop, min(day) AS day
    FROM rec WHERE image IS NOT NULL GROUP BY 1, 2""",
)
def build_groups(spark, sf_dir):
    return resolve.build_groups(records(spark, sf_dir)).select("brand_slug", "key", "pos", "n_variants", "price_min", "pop", "day")


@query(
    "A17_colorless",
    f"""{RECORDS}, g AS (SELECT brand_slug, name, min(pos) AS pos, min(price) AS price_min FROM rec WHERE image IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT *, trim(regexp_replace(regexp_replace(replace(name, 'cok-renkli', 'cok'), ' (siyah|beyaz|gri|bej|kirmizi|pembe|mavi|mor|yesil)$', ''), '^(red|blue) | (red|blue) ', ' ')) AS colorless FROM g)
    SELECT brand_slug, colorless, count(*) AS n_groups, min(price_min) AS price_min FROM k GROUP BY 1, 2""",
)
def colorless(spark, sf_dir):
    return resolve.bucket_by_color(resolve.build_groups(records(spark, sf_dir))).select("brand_slug", "colorless", "n_groups", "price_min")


@query(
    "A19_fold_variants",
    """WITH r AS (SELECT l_partkey AS pid, l_orderkey * 8 + l_linenumber AS pos, CAST(l_suppkey % 17 AS VARCHAR) AS key, l_returnflag = 'N' AS in_stock, floor(l_extendedprice / l_quantity * 100) / 100 AS price,
        l_linenumber AS size FROM lineitem),
    k AS (SELECT pid, key, min(pos) AS first FROM r GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY first, key) AS place FROM k),
    s AS (SELECT r.*, bool_or(r.in_stock) OVER (PARTITION BY r.pid, r.key) AS live FROM r LEFT JOIN p ON p.pid = r.pid AND p.place = 12 WHERE p.first IS NULL OR r.pos <= p.first)
    SELECT pid, key, bool_or(in_stock) AS in_stock, min(price) FILTER (in_stock = live) AS price, array_to_string(list_sort(list_distinct(list(size) FILTER (in_stock = live))), ',') AS sizes,
    row_number() OVER (PARTITION BY pid ORDER BY min(pos), key) AS place FROM s GROUP BY 1, 2""",
)
def fold_variants(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("pid"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), (F.col("l_suppkey") % 17).cast("string").alias("key"), (F.col("l_returnflag") == "N").alias("in_stock"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("price"), F.lit(None).cast("string").alias("url"), F.col("l_linenumber").alias("size"),
    )
    found = resolve.fold_variants(rows)
    return found.select("pid", "key", "in_stock", "price", F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes"), "place")


@query(
    "A20_color_suspects",
    """SELECT l_partkey AS pid, l_suppkey % 10 AS c, count(*) AS n, count(*) > 1 AS color_suspect FROM lineitem GROUP BY 1, 2""",
)
def color_suspects(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pid"), (F.col("l_suppkey") % 10).alias("c"), F.concat(F.lit("c"), F.col("l_suppkey") % 10).alias("color"))
    return resolve.color_suspects(v).groupBy("pid", "c").agg(F.count("*").alias("n"), F.max("color_suspect").alias("color_suspect"))


@query("F13_route", "SELECT p_partkey AS id, CASE WHEN p_brand IN ('Brand#1', 'Brand#7') THEN 'MARKA' WHEN p_type = 'PROMO' THEN 'AYAKKABI' WHEN p_size <= 4 THEN 'COCUK' END AS archive_reason FROM part")
def route(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.when(F.col("p_type") == "PROMO", "AYAKKABI").otherwise("DİĞER").alias("category"), F.when(F.col("p_size") <= 4, "age").alias("kids")
    )
    return resolve.route(p, ["Brand#1", "Brand#7"]).select("id", "archive_reason")


@query(
    "T09_votes",
    """WITH p AS (SELECT json_extract_string(props, '$.k') AS product_id, user_id, count(*) AS n FROM events GROUP BY 1, 2) SELECT product_id, count(*) FILTER (n % 2 = 1) AS votes FROM p GROUP BY 1""",
)
def votes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("product_id"), F.col("user_id").alias("voter"))
    return userdata.toggled_votes(rows)


@query(
    "A14_top_requested",
    """WITH p AS (SELECT json_extract_string(props, '$.k') AS product_id, count(DISTINCT user_id) AS votes FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY votes DESC, product_id) AS rank FROM p) SELECT * FROM r WHERE rank <= 10""",
)
def top_requested(spark, sf_dir):
    from vitrine.plans.analytics import top

    rows = table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("product_id")).agg(F.countDistinct("user_id").alias("votes"))
    return top(rows, 10, F.desc("votes"), F.asc("product_id"))


@query(
    "U02_list_union",
    """WITH l AS (SELECT o_custkey AS c, list(o_orderkey ORDER BY o_orderkey) AS a, list(o_orderkey + 3 ORDER BY o_orderkey DESC) AS b FROM orders GROUP BY 1),
    u AS (SELECT c, list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))) AS u FROM l)
    SELECT c, array_to_string(CASE WHEN len(u) > 12 THEN u[len(u) - 11:] ELSE u END, ',') AS items FROM u""",
)
def list_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"))
    b = F.reverse(F.transform("a", lambda x: x + 3))
    return o.select("c", F.array_join(userdata.union_items(F.col("a"), b, 12).cast("array<string>"), ",").alias("items"))


@query(
    "J15_merge_lists",
    """WITH o AS (SELECT o_orderkey AS pos, 'r' || (o_orderkey % 499) AS id, 'List ' || o_custkey AS name, CAST(o_orderkey AS VARCHAR) AS item, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS t FROM orders),
    r AS (SELECT * FROM o WHERE pos % 2 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1), l AS (SELECT * FROM o WHERE pos % 2 = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1),
    n AS (SELECT name, arg_max(id, pos) AS name_id FROM r GROUP BY 1), m AS (SELECT l.*, coalesce(x.id, name_id) AS want FROM l LEFT JOIN r x ON x.id = l.id LEFT JOIN n ON n.name = l.name),
    k AS (SELECT * EXCLUDE (want), CASE WHEN row_number() OVER (PARTITION BY want ORDER BY pos) = 1 THEN want END AS goal FROM m)
    SELECT coalesce(r.id, k.id) AS id, CASE WHEN coalesce(k.t > r.t, r.t IS NULL) THEN k.name ELSE r.name END AS name, concat_ws(',', r.item, k.item) AS items, least(k.t, r.t) AS created, greatest(k.t, r.t) AS updated
    FROM k FULL JOIN r ON goal = r.id""",
)
def merge_lists(spark, sf_dir):
    """Lists of two devices: met by id, else by name, each remote list by the first local one that comes for it."""
    o = table(spark, sf_dir, "orders")
    cols = lambda d, k: d.select(F.col("o_orderkey").alias("pos"), F.concat(F.lit(k), F.col("o_orderkey") % 499).alias("id"), F.concat(F.lit("List "), F.col("o_custkey").cast("string")).alias("name"), F.array(F.col("o_orderkey").cast("string")).alias("items"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("updated"))  # noqa: E731, E501
    remote = userdata.latest(cols(o.filter("o_orderkey % 2 = 0"), "r"), ["id"], ["pos"])
    local = userdata.latest(cols(o.filter("o_orderkey % 2 = 1"), "r"), ["id"], ["pos"])
    return userdata.merge_lists(remote, local).select("id", "name", F.array_join("items", ",").alias("items"), "created", "updated")
