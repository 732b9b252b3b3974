"""Probes and audits of stores, hosts and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a page says whose domain is for sale; seen in its first 4000 characters.
PARKED = (
    r"(?i)alan\s*ad[ıi].*sat[ıi]l[ıi]k|domain (?:is )?for sale|this domain|parked|bu alan ad[ıi]|sedo|godaddy|hostinger.*park"
)
LEAST_PAGE = 800
DEAD_SECONDS = 12 * 3600


def looks_parked(html: Column) -> Column:
    """A page of a domain for sale, or one with next to nothing on it."""
    title = F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)
    return F.concat_ws(" ", title, F.substring(html, 1, 4000)).rlike(PARKED) | (F.length(html) < LEAST_PAGE)


def page_verdict(status: Column, html: Column, products: Column) -> Column:
    """What a probe of a store's home page comes to."""
    return F.when(html.isNull() | (status >= 400), "ERİŞİLEMEDİ").when(looks_parked(html), "PARK/KAPALI").when(products > 0, "TAMAM").otherwise("ÜRÜN YOK")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^https?://(?:[^/@]*@)?([^/:?#]+)", 1))


def allowed_image_host(rows: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """rows with allowed: the url's host is listed (suffix) or lies below one that is.

    Addresses, local names and names without a dot never are.  Hosts are compared once each, by key: every
    ending of a host at a dot is looked up.
    """
    rows = rows.withColumn("_host", host_of(F.col(url_col)))
    hosts = rows.select("_host").distinct()
    public = F.contains("_host", F.lit(".")) & ~F.col("_host").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|\.local$|\.internal$")
    parts = F.split("_host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    found = hosts.filter(public).select("_host", F.explode(endings).alias("suffix")).join(listed.select("suffix"), "suffix", "left_semi").select("_host").distinct()
    return rows.join(found.withColumn("_ok", F.lit(True)), "_host", "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_host", "_ok")


def still_dead(marks: DataFrame, now: Column, seconds: int = DEAD_SECONDS, most: int | None = None) -> DataFrame:
    """Marks (url, at) that still hold, the latest of each address; most: the newest so many stay."""
    live = marks.groupBy("url").agg(F.max("at").alias("at")).filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp")) <= seconds * 1_000_000)
    return live.orderBy(F.desc("at"), "url").limit(most) if most else live


def dead_last(products: DataFrame, images: DataFrame, dead: DataFrame) -> DataFrame:
    """products (id) with dead: they have images (id, url) and every one of them is dead (url)."""
    known = images.join(dead.select("url").distinct().withColumn("_dead", F.lit(True)), "url", "left")
    per = known.groupBy("id").agg(F.every(F.coalesce("_dead", F.lit(False))).alias("_all"))
    return products.join(per, "id", "left").withColumn("dead", F.coalesce("_all", F.lit(False))).drop("_all")


def first_valid(candidates: DataFrame) -> DataFrame:
    """(slug, url): of each store's candidate addresses (slug, place, url, ok) the first that is valid."""
    return candidates.filter("ok").groupBy("slug").agg(F.min_by("url", "place").alias("url"))


def candidate_domains(names: DataFrame, endings: list[str]) -> DataFrame:
    """(slug, place, url) from (slug): the slug, with and without hyphens, under each ending in their order."""
    forms = F.array_distinct(F.array(F.regexp_replace("slug", "-", ""), F.col("slug")))
    urls = F.flatten(F.transform(forms, lambda f: F.array(*[F.concat(F.lit("https://"), f, F.lit(e)) for e in endings])))
    return names.select("slug", F.posexplode(urls).alias("place", "url"))


def import_histograms(products: DataFrame) -> DataFrame:
    """(what, value, n): an import's categories, currencies and genders (two are unisex), from one pass over the products."""
    gender = F.when(F.size("genders") >= 2, "unisex").otherwise(F.col("genders")[0])
    entry = lambda what, value: F.struct(F.lit(what).alias("what"), value.alias("value"))
    each = products.select(F.explode(F.array(entry("category", F.col("category")), entry("currency", F.col("currency")), entry("gender", gender))).alias("e"))
    return each.groupBy("e.what", "e.value").agg(F.count("*").alias("n"))


def scrape_totals(roster: DataFrame, records: DataFrame) -> DataFrame:
    """One row: brands, records, and the brands of the roster (slug) that gave no records (slug), as their number and by name."""
    per = roster.join(records.groupBy("slug").agg(F.count("*").alias("n")), "slug", "left").na.fill(0, ["n"])
    none = F.array_sort(F.collect_list(F.when(F.col("n") == 0, F.col("slug"))))  # names of brands
    return per.agg(F.count("*").alias("brands"), F.sum("n").alias("records"), F.count_if(F.col("n") == 0).alias("empty"), F.array_join(none, ",").alias("empty_brands"))


def discovery_lift(head: DataFrame, live: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One row: each measure's mean in the head of a feed against all that is live, the head's brands, and the largest share of one."""
    means = lambda df, tag: df.agg(*(F.avg(c).alias(f"{tag}_{n}") for n, c in measures.items()))
    brands = head.groupBy("brand_slug").agg(F.count("*").alias("n")).agg(F.count("*").alias("brands"), (F.max("n") / F.sum("n")).alias("largest_share"))
    lifts = [F.when(F.col(f"all_{n}") > 0, F.col(f"head_{n}") / F.col(f"all_{n}")).otherwise(0.0).alias(n) for n in measures]
    return means(head, "head").crossJoin(means(live, "all")).crossJoin(brands).select(*lifts, "brands", "largest_share")  # one row each


def price_drift(products: DataFrame, live: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """live (id, live) outside its product's range (id, price, price_min, price_max) by more than the tolerance, on either side."""
    met = live.join(products.select("id", "price", F.coalesce("price_min", "price").alias("low"), F.coalesce("price_max", "price").alias("high")), "id")
    fits = (F.col("live") >= F.col("low") * (1 - tolerance)) & (F.col("live") <= F.col("high") * (1 + tolerance))
    return met.filter(~fits)


def outfit_totals(lines: DataFrame) -> DataFrame:
    """(outfit, total, all_priced, currency) of lines (outfit, pos, price, currency); the currency is that of the first with a price."""
    priced = F.col("price").isNotNull()
    return lines.groupBy("outfit").agg(
        F.coalesce(F.sum("price"), F.lit(0)).alias("total"), F.every(priced).alias("all_priced"), F.min_by("currency", F.when(priced, F.col("pos"))).alias("currency")
    )


def bump_views(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """stored (id, views) with the views since (id, one row each) added; views of lists that are not there don't count."""
    since = seen.groupBy("id").agg(F.count("*").alias("_since"))
    return stored.join(since, "id", "left").withColumn("views", F.col("views") + F.coalesce("_since", F.lit(0))).drop("_since")


def dominant(rows: DataFrame, group: str, value: str, at: Column) -> DataFrame:
    """(group, value, n): the most frequent value of each group, of equals the one that was seen first."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(at).alias("_first"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct(F.col("n"), -F.col("_first"))).alias(value), F.max("n").alias("n"))


def chosen_brands(brands: DataFrame, only: list[str] | None = None, skip: list[str] | None = None, platform: str | None = None) -> DataFrame:
    """brands (slug, platform) that a run is asked for."""
    for wanted in ([F.col("slug").isin(only)] if only else []) + ([~F.col("slug").isin(skip)] if skip else []) + ([F.col("platform") == platform] if platform else []):
        brands = brands.filter(wanted)
    return brands
