"""Stored and landed things that take several writes: paged sources, sitemap walks, keyed tables, guarded brands, refresh runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine import sources, streaming
from vitrine.operators import accounts, userdata
from vitrine.operators import refresh as R
from vitrine.plans.catalog import table
from vitrine.plans.files import shared
from vitrine.plans.merge import BRANDS, store_ages
from vitrine.sources import paged, sitemaps, stores
from vitrine.sources.runs import KeyedTable

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


SLUG = "lower(replace(p_brand, '#', '-'))"


def slug():
    return F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))


FULL = 20


def landed_lists(spark, sf_dir) -> str:
    """Parts as landed pages of 20: from its third page on brand-3 has no prices, brand-4's second page never came."""
    path = shared(spark, "lists")
    p = table(spark, sf_dir, "part").select(slug().alias("brand"), F.col("p_partkey").alias("pos"), "p_name", "p_retailprice")
    p = p.withColumn("page", F.floor((F.row_number().over(Window.partitionBy("brand").orderBy("pos")) - 1) / FULL) + 1)
    tired = (F.col("brand") == "brand-3") & (F.col("page") > 2)
    variant = F.struct(F.lit("Red").alias("option1"), F.when(~tired, F.col("p_retailprice").cast("string")).alias("price"), F.lit(True).alias("available"))
    option = F.struct(F.lit("Renk").alias("name"), F.lit(1).alias("position"), F.array(F.lit("Red")).alias("values"))
    product = F.struct(F.col("pos").alias("id"), F.col("p_name").alias("title"), F.array(option).alias("options"), F.array(variant).alias("variants"), F.array(F.struct(F.lit("a.jpg").alias("src"))).alias("images"))
    paged.land_pages(p.filter("brand <> 'brand-4' or page <> 2").select("brand", "pos", "page", product.alias("product")), path)
    return path


def landed_pages(spark, path: str) -> DataFrame:
    paged.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("landed_pages").option("path", path).option("full", str(FULL)).load()


PAGED = f"""WITH p AS (SELECT {SLUG} AS brand, p_partkey AS id, p_retailprice AS price, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // {FULL} + 1 AS page FROM part),
    g AS (SELECT brand, page, count(*) AS products FROM p GROUP BY 1, 2), m AS (SELECT brand, max(page) AS pages, arg_max(products, page) AS tail FROM g GROUP BY 1),
    k AS (SELECT brand, page, products, CASE WHEN brand = 'brand-4' AND pages > 1 THEN 'missing' WHEN brand = 'brand-3' AND pages > 2 THEN 'priceless' WHEN tail = {FULL} THEN 'missing' END AS why,
                 CASE WHEN brand = 'brand-4' THEN 1 WHEN brand = 'brand-3' THEN least(pages, 2) ELSE pages END AS most FROM g JOIN m USING (brand))"""


@query("S11_landed_pages", f"{PAGED} SELECT brand, page, products, CASE WHEN page = most THEN why END AS note FROM k WHERE page <= most")
def pages_of_lists(spark, sf_dir):
    """All brands' pages through the data source: lists end with a short page, one that never came, or one without prices."""
    return landed_pages(spark, landed_lists(spark, sf_dir)).select("brand", F.col("page").cast("long").alias("page"), F.col("products").cast("long").alias("products"), "note")


@query("S13_paged_records", f"{PAGED} SELECT p.brand, id, price FROM p JOIN k USING (brand, page) WHERE page <= most AND p.brand IN ('brand-3', 'brand-4', 'brand-5')")
def paged_records(spark, sf_dir):
    """Records of three brands; the filter chooses the partitions, so other brands' pages are not opened."""
    pages = landed_pages(spark, landed_lists(spark, sf_dir)).filter(F.col("brand").isin("brand-3", "brand-4", "brand-5"))
    return stores.shopify_records(pages.select("brand", "body")).select("brand", "id", "price")


MAP_CAP = 40


@query(
    "S19_sitemap_walk",
    f"""WITH u AS (SELECT 'https://' || {SLUG} || '.com' AS origin, p_partkey AS id, p_partkey % 3 AS g FROM part),
    k AS (SELECT origin, CASE g WHEN 0 THEN origin || '/x/' || id || '/y' WHEN 2 THEN origin || '/flat' || id ELSE origin || '/urun/' || id END AS url,
          row_number() OVER (PARTITION BY origin ORDER BY CASE g WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END, id) AS place FROM u) SELECT origin, place, url FROM k WHERE place <= {MAP_CAP}""",
)
def sitemap_walk(spark, sf_dir):
    """Indexes within indexes, one that names itself, one too deep, pages that are no products, and roots that are not there or not needed."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("https://"), slug(), F.lit(".com")).alias("o"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("g"))
    entry = lambda loc: F.concat(F.lit("<url><loc>"), loc, F.lit("</loc></url>"))
    one = lambda *c: entry(F.concat(*(F.lit(x) if x not in ("o", "id") else F.col(x) for x in c)))
    listed = lambda g, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("g") == g, F.struct("id", c.alias("c"))))), lambda x: x.c), "")
    maps = p.groupBy("o").agg(
        listed(0, one("o", "/x/", "id", "/y")).alias("named"), listed(1, F.concat(one("o", "/urun/", "id"), one("o", "/a/b/", "id"))).alias("included"), listed(2, one("o", "/flat", "id")).alias("deep"),
    )
    below = lambda *names: F.concat(*(F.concat(F.lit("<sitemap><loc>"), F.col("o"), F.lit(f"/{n}.xml</loc></sitemap>")) for n in names))
    bodies = {
        "sitemap": F.concat(below("product-1", "index-2", "sitemap"), F.lit("<loc>"), F.col("o"), F.lit("/hakkimizda</loc>")),
        "product-1": F.col("named"),
        "index-2": F.concat(entry(F.concat("o", F.lit("/deep-3.xml"))), F.col("included")),
        "deep-3": F.concat(entry(F.concat("o", F.lit("/too-deep.xml"))), F.col("deep")),
        "too-deep": one("o", "/urun/unseen"),
        "other": one("o", "/urun/other"),
    }
    landed = maps.select(F.explode(F.array(*(F.struct(F.concat("o", F.lit(f"/{n}.xml")).alias("loc"), body.alias("xml")) for n, body in bodies.items()))).alias("m")).select("m.*")
    roots = maps.select(F.col("o").alias("origin"), F.posexplode(F.array(*(F.concat("o", F.lit(f"/{n}.xml")) for n in ("gone", "sitemap", "other")))).alias("root", "loc"))
    return sitemaps.sitemap_pages(roots, landed, cap=MAP_CAP)


LATEST = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type FROM r WHERE k = 1 AND event_type <> 'error'"


def keyed_events(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "event_type", (F.col("event_type") == "error").alias("gone"))


@query("K07_keyed_table", LATEST)
def keyed_table(spark, sf_dir):
    """Events as batches of a keyed table: each written once, one of them twice, compacted on the way; an error takes the user out."""
    rows, ev = KeyedTable(spark, shared(spark, "keyed"), ["user_id"], "at", buckets=4, most_runs=3), keyed_events(spark, sf_dir)
    for k in (0, 1, 2, 2, 3, 4):
        rows.append(ev.filter(F.col("event_id") % 5 == k), k, "gone")
    return rows.read().select("user_id", "event_id", "event_type")


@query("K07_keyed_lookup", f"SELECT * FROM ({LATEST}) WHERE user_id IN (3, 14, 15, 92)")
def keyed_lookup(spark, sf_dir):
    """A few users of it; only their buckets are opened."""
    rows, ev = KeyedTable(spark, shared(spark, "keyed"), ["user_id"], "at", buckets=8), keyed_events(spark, sf_dir)
    for k in range(3):
        rows.append(ev.filter(F.col("event_id") % 3 == k), k, "gone")
    return rows.lookup([(3,), (14,), (15,), (92,)]).select("user_id", "event_id", "event_type")


@query("T10_stream_upserts", LATEST)
def stream_upserts(spark, sf_dir):
    """The same by a stream over landed files, one a batch."""
    path, landed = shared(spark, "upserts"), shared(spark, "landed")
    ev = keyed_events(spark, sf_dir)
    ev.repartitionByRange(4, "event_id").write.parquet(landed)
    rows = KeyedTable(spark, path, ["user_id"], "at", buckets=4, most_runs=3)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    streaming.upsert_batches(stream, rows, f"{path}-checkpoint", "gone").trigger(availableNow=True).start().awaitTermination()
    return rows.read().select("user_id", "event_id", "event_type")


@query(
    "K05_guarded_brands",
    f"""WITH o AS (SELECT {SLUG} AS brand_slug, p_partkey % 5 AS k, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 4 AS kind FROM part),
    b AS (SELECT brand_slug, kind, count(*) AS n, count(*) FILTER (CASE kind WHEN 0 THEN k = 0 WHEN 1 THEN true WHEN 3 THEN k <> 0 ELSE false END) AS m FROM o GROUP BY 1, 2)
    SELECT brand_slug, CASE WHEN kind <> 1 AND m > 0 AND m >= 0.6 * n THEN 'new' ELSE 'old' END AS written, CASE WHEN kind <> 1 AND m > 0 AND m >= 0.6 * n THEN m ELSE n END AS n FROM b""",
)
def guarded_brands(spark, sf_dir):
    """A second write brings too few rows (kind 0), rows without prices (1), nothing (2), or good ones (3) for a brand."""
    path = shared(spark, "brands")
    p = table(spark, sf_dir, "part").withColumn("kind", F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int") % 4)
    rows = lambda df, what, price: df.select(F.col("p_partkey").alias("id"), price.alias("price"), F.array(F.lit("S")).alias("sizes"), F.lit(what).alias("written"), slug().alias("brand_slug"))
    sources.write_brands(rows(p, "old", F.col("p_retailprice")), path, f"{path}-report-1")
    new = p.filter("(kind = 0 and p_partkey % 5 = 0) or kind = 1 or (kind = 3 and p_partkey % 5 <> 0)")
    sources.write_brands(rows(new, "new", F.when(F.col("kind") != 1, F.col("p_retailprice"))), path, f"{path}-report-2")
    return spark.read.parquet(path).groupBy("brand_slug", "written").agg(F.count("*").alias("n"))


@query(
    "T14_refresh_runs",
    f"""{BRANDS}, d AS (SELECT slug, CASE WHEN platform = 'shopify' THEN 0 ELSE 1 END AS lane, row_number() OVER (PARTITION BY platform = 'shopify' ORDER BY age DESC NULLS LAST, slug) AS place FROM b)
    SELECT slug, CASE WHEN lane = 0 OR place <= 20 THEN 1 ELSE 2 END AS run FROM d""",
)
def refresh_runs(spark, sf_dir):
    """All stores are due: a first run, whose time is up after one lot of slow stores, and a second one for what is left."""
    path = shared(spark, "refresh")
    plan = accounts.refresh_plan(store_ages(spark, sf_dir).na.fill(-1, ["age"]), ["shopify"], 340_000, force=True).select("slug", "lane", "place")
    plan.write.parquet(f"{path}/plan")
    plan = spark.read.parquet(f"{path}/plan")
    R.queue(plan, f"{path}/lots", lot=10)
    state = KeyedTable(spark, f"{path}/state", ["slug"], "at", buckets=2)
    turns = {"run": 0, "slow": 0}

    def work(lot: DataFrame) -> DataFrame:
        turns["slow"] += lot.first().lane
        return lot.select("slug", F.lit(turns["run"]).alias("run"), F.lit(turns["run"]).alias("at"))

    for run, budget in ((1, 1.5), (2, 1e9)):
        turns |= {"run": run, "slow": 0}
        R.refresh(spark, f"{path}/lots", f"{path}/checkpoint", state, work, budget, clock=lambda: float(turns["slow"]), at_once=10_000)
    return state.read().select("slug", "run")


@query("N09_review_upsert", """WITH f AS (SELECT event_type, user_id, min(ts) AS first, min(event_id) AS id FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first, id) AS place FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT r.user_id, r.event_type, r.event_id FROM r JOIN k USING (event_type, user_id) WHERE n = 1 AND place <= 60""")
def review_upsert(spark, sf_dir):
    """One review a writer and product, the latest; a product takes the first 60 writers' and no more."""
    ev = table(spark, sf_dir, "events")
    first = ev.groupBy("event_type", "user_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    held = userdata.first_writers(first, "event_type", "first", 60)
    latest = userdata.latest(ev, ["user_id", "event_type"], ["ts", "event_id"])
    return latest.join(held.select("event_type", "user_id"), ["event_type", "user_id"], "left_semi").select("user_id", "event_type", "event_id")


@query(
    "T07_dead_images",
    """WITH m AS (SELECT user_id, ts FROM events WHERE event_type = 'error')
    SELECT event_id, EXISTS (SELECT 1 FROM m WHERE m.user_id = e.user_id AND m.ts < e.ts AND epoch_us(e.ts) - epoch_us(m.ts) <= 43200000000) AS dead FROM events e WHERE event_type = 'view'""",
)
def dead_images(spark, sf_dir):
    """A stream of marks (errors) and asks (views): dead is what was marked in the last twelve hours, however many addresses that are."""
    landed, out = shared(spark, "marks"), shared(spark, "dead")
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "view"))
    ev = ev.select(F.col("user_id").cast("string").alias("url"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "error").alias("mark"), "event_id")
    ev.write.parquet(landed)
    stream = spark.readStream.schema(ev.schema).parquet(landed).select("url", "at", "mark")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        streaming.dead_images(stream, most=None, groups=8).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    told = spark.read.schema("url string, at timestamp, dead boolean").parquet(out).distinct()  # asks of one address at one time have one answer
    return ev.filter("not mark").join(told, ["url", "at"]).select("event_id", "dead")
