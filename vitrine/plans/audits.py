"""Audits and reports of the catalogue, each calling the rule it audits, with SQL that restates it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine import sources
from vitrine.functions import classify, rules
from vitrine.functions.color import FAMILIES
from vitrine.functions.text import fold, index_letter
from vitrine.operators import audits as audits_op
from vitrine.operators import resolve
from vitrine.plans.catalog import CURRENCY, GROUP, PRODUCT_SQL, lookup, products, sql_list, sql_lookup, table, variants
from vitrine.plans.files import written
from vitrine.plans.names import COPIES, names, sql_fold, sql_hit, sql_tr, sql_turn, turn

Q: dict = {}
SQL: dict[str, str] = {}
P = f"WITH {PRODUCT_SQL}"


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("A21_positive_range", f"{P} SELECT pid, min(vprice) FILTER (vprice > 200) AS low, max(vprice) FILTER (vprice > 200) AS high FROM variant GROUP BY 1")
def positive_range(spark, sf_dir):
    """Least and greatest of the prices that count, as plain aggregates."""
    price = F.when(F.col("vprice") > 200, F.col("vprice"))
    return variants(spark, sf_dir).groupBy("pid").agg(F.min(price).alias("low"), F.max(price).alias("high"))


HIST = f"{P}, r AS (SELECT category, {sql_lookup(CURRENCY, "['EUROPE', 'AMERICA', 'ASIA'][pos % 3 + 1]", "'TRY'")} AS currency, CASE WHEN pos % 5 = 0 THEN 'kadin' WHEN pos % 5 = 1 THEN 'erkek' ELSE 'unisex' END AS gender FROM product)"


@query(
    "A22_histograms",
    f"""{P}, r AS (SELECT category, CASE pos % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'TRY' END AS currency, CASE WHEN len(genders) >= 2 THEN 'unisex' ELSE genders[1] END AS gender FROM product)
    SELECT 'category' AS what, category AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'currency', currency, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'gender', gender, count(*) FROM r GROUP BY 2""",
)
def histograms(spark, sf_dir):
    """The import report's three histograms; genders are what the rules find in the names."""
    region = F.element_at(F.array(*map(F.lit, ["EUROPE", "AMERICA", "ASIA"])), (F.col("pos") % 3 + 1).cast("int"))
    return audits_op.import_histograms(products(spark, sf_dir).withColumn("currency", lookup(CURRENCY, region, "TRY")))


@query("A24_scrape_totals", "WITH b AS (SELECT s_name AS slug, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_linenumber = 7 AND l_quantity > 44 GROUP BY 1) SELECT count(*) AS brands, CAST(sum(n) AS BIGINT) AS records, count(*) FILTER (n = 0) AS empty, coalesce(string_agg(slug, ',' ORDER BY slug) FILTER (n = 0), '') AS empty_brands FROM b")
def scrape_totals(spark, sf_dir):
    """A run's records by store, and the stores of the roster that gave none."""
    roster = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("slug"))
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_linenumber = 7 and l_quantity > 44").select("l_suppkey")
    return audits_op.scrape_totals(roster.select("slug"), lines.join(roster, F.col("l_suppkey") == F.col("s_suppkey")).select("slug"))


KNOWN_TAGS = sql_list(list(FAMILIES))


@query(
    "A27_color_coverage",
    f"""{P}, t AS (SELECT unnest(CASE WHEN pos % 11 = 0 THEN list_append(color_tags, 'odd') ELSE color_tags END) AS tag FROM product), w AS (SELECT count(*) FILTER (len(color_tags) > 0 OR pos % 11 = 0) AS w FROM product), g AS (SELECT tag, count(*) AS n FROM t GROUP BY 1)
    SELECT tag, n, round(n / w, 6) AS share, n = (SELECT max(n) FROM g) AS largest, NOT list_contains({KNOWN_TAGS}, tag) AS unknown FROM g, w""",
)
def color_coverage(spark, sf_dir):
    """Share of each tag among tagged products, which is the largest, and which are no family."""
    p = products(spark, sf_dir).withColumn("tags", F.when(F.col("pos") % 11 == 0, F.concat("color_tags", F.array(F.lit("odd")))).otherwise(F.col("color_tags")))
    whole = p.filter(F.size("tags") > 0).agg(F.count("*").alias("w"))
    tags = p.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    most = tags.agg(F.max("n").alias("most"))
    both = tags.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(most))  # one row each
    return both.select("tag", "n", F.round(F.col("n") / F.col("w"), 6).alias("share"), (F.col("n") == F.col("most")).alias("largest"), (~F.col("tag").isin(list(FAMILIES))).alias("unknown"))


MEN_SQL = f"(regexp_matches(tr, '{'|'.join(rules.MEN)}') OR regexp_matches(tr, '(^|[^A-Za-z0-9_])({'|'.join(rules.MEN_WHOLE)})($|[^A-Za-z0-9_])'))".replace("men'?s", "men''?s")


@query(
    "A28_gender_accuracy",
    f"""{COPIES}, g AS (SELECT *, {sql_hit('tr', rules.WOMEN)} AS w, {MEN_SQL} AS m, {sql_hit('tr', rules.UNISEX)} AS u, {sql_hit('tr', rules.LOOSE)} AS l FROM c), s AS (SELECT *, w <> m AND NOT u AS said FROM g),
    b AS (SELECT said, w, CASE WHEN u OR l THEN 'both' WHEN sizes IN (1, 2) THEN 'erkek' ELSE 'both' END AS blind FROM s WHERE said)
    SELECT count(*) FILTER (blind = CASE WHEN w THEN 'kadin' ELSE 'erkek' END) AS hit, count(*) FILTER (blind <> 'both' AND blind <> CASE WHEN w THEN 'kadin' ELSE 'erkek' END) AS miss, count(*) FILTER (blind = 'both') AS abstain
    FROM (SELECT said, w, CASE WHEN sizes IN (1, 2) THEN 'erkek' ELSE 'both' END AS blind FROM s WHERE said) b""",
)
def gender_accuracy(spark, sf_dir):
    """Over products whose name says the gender: what the sizes alone would have said."""
    n = names(spark, sf_dir)
    plain = lambda c: classify.detect_genders(c, F.lit(classify.OTHER), F.array().cast("array<string>"))
    said = n.withColumn("told", plain(F.col("name"))).filter(F.size("told") == 1)
    guess = F.coalesce(classify.genders_from_sizes(F.col("sizes")), F.array(F.lit("kadin"), F.lit("erkek")))
    said = said.withColumn("guess", guess)
    right = F.col("guess")[0] == F.col("told")[0]
    one = F.size("guess") == 1
    return said.agg(F.count_if(one & right).alias("hit"), F.count_if(one & ~right).alias("miss"), F.count_if(~one).alias("abstain"))


@query(
    "A29_archive_audit",
    f"""{COPIES}, k AS (SELECT *, lower({sql_tr('name')}) || chr(1) || {sql_tr('lower(name)')} AS two_copies, trim({sql_tr('brand')}) AS b FROM c),
    s AS (SELECT *, CASE WHEN sizes = 3 THEN 'age' WHEN {sql_hit("replace(two_copies, b, ' ')", rules.SLOGANS)} THEN NULL WHEN {sql_hit("replace(two_copies, b, ' ')", [], rules.KIDS)} THEN 'name' END AS kids FROM k),
    r AS (SELECT brand, CASE WHEN brand IN ('Brand#1', 'Brand#7') THEN 'MARKA' WHEN category = 'AYAKKABI' THEN 'AYAKKABI' WHEN kids IS NOT NULL THEN 'COCUK' END AS reason, CASE WHEN brand IN ('Brand#1', 'Brand#7') OR category = 'AYAKKABI' THEN '-' ELSE kids END AS signal FROM s),
    g AS (SELECT reason, signal, brand, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY reason, signal ORDER BY n DESC, brand) AS rank FROM g QUALIFY rank <= 8""",
)
def archive_audit(spark, sf_dir):
    """What the archive router would take, by reason, signal and brand; the eight largest brands of each."""
    n = names(spark, sf_dir).withColumn("category", classify.categorize(F.col("name"))).withColumn("kids", classify.kids_reason(F.col("name"), F.col("sizes"), F.col("brand")))
    routed = resolve.route(n, ["Brand#1", "Brand#7"])
    signal = F.when(F.col("archive_reason") == "COCUK", F.col("kids")).otherwise("-")
    # rows without a reason count nothing: a filter on the reason would work it out once more, before rows are dealt over the cores
    g = routed.groupBy(F.col("archive_reason").alias("reason"), signal.alias("signal"), "brand").agg(F.count("archive_reason").alias("n")).filter("n > 0")
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("reason", "signal").orderBy(F.desc("n"), "brand"))).filter("rank <= 8")


@query("A30_pattern_and_basic", f"{COPIES} SELECT count(*) FILTER ({sql_hit('two', *rules.STYLE_WORDS['pattern'])}) AS patterned, 0 AS both_styles FROM c")
def pattern_and_basic(spark, sf_dir):
    """No product is both patterned, by the words themselves, and basic, by the style rule: a count that has to be 0."""
    n = names(spark, sf_dir)
    styles = classify.product_styles(F.col("name"), classify.categorize(F.col("name")), F.array(F.lit("basic"), F.lit("minimalist")))
    patterned = classify.hit(classify.copies(F.col("name"), tight=False), *rules.STYLE_WORDS["pattern"])
    return n.agg(F.count_if(patterned).alias("patterned"), F.count_if(patterned & F.array_contains(styles, "basic")).cast("int").alias("both_styles"))


STYLE_ROWS = [("brand-1", "y2k"), ("brand-1", "basic"), ("brand-2", "gothic"), ("brand-999", "basic")]


@query(
    "A31_brand_styles",
    f"""{P}, b AS (SELECT DISTINCT brand_slug FROM product), s(slug, style) AS (VALUES {', '.join(map(str, STYLE_ROWS))}), known AS (SELECT unnest({sql_list(classify.STYLES)}) AS style)
    SELECT 'count' AS what, style AS value, (SELECT count(*) FROM s WHERE s.style = known.style AND slug IN (SELECT brand_slug FROM b)) AS n FROM known UNION ALL
    SELECT 'untagged', brand_slug, 1 FROM b WHERE brand_slug NOT IN (SELECT slug FROM s) UNION ALL SELECT DISTINCT 'orphan', slug, 1 FROM s WHERE slug NOT IN (SELECT brand_slug FROM b) UNION ALL
    SELECT DISTINCT 'invalid', slug, 1 FROM s WHERE style NOT IN (SELECT style FROM known)""",
)
def brand_styles(spark, sf_dir):
    """Brands by style, zero-filled; brands without any, entries of no brand, and entries of no style."""
    b = products(spark, sf_dir).select(F.col("brand_slug").alias("slug")).distinct()
    s = spark.createDataFrame(STYLE_ROWS, "slug string, style string")
    known = spark.createDataFrame([(x,) for x in classify.STYLES], "style string")
    counts = known.join(s.join(b, "slug", "left_semi").groupBy("style").agg(F.count("*").alias("n")), "style", "left").na.fill(0, ["n"])
    row = lambda d, what: d.select(F.lit(what).alias("what"), F.col("slug").alias("value"), F.lit(1).cast("long").alias("n")).distinct()
    found = counts.select(F.lit("count").alias("what"), F.col("style").alias("value"), "n").unionByName(row(b.join(s, "slug", "left_anti"), "untagged"))
    return found.unionByName(row(s.join(b, "slug", "left_anti"), "orphan")).unionByName(row(s.join(known, "style", "left_anti"), "invalid"))


LETTERED = ["", "i", "İ", "ı", "ç", "9", " "]


@query("A35_brand_index", f"WITH n AS (SELECT {sql_turn(LETTERED, 1)} || p_name AS name FROM part), l AS (SELECT name, translate(trim(name)[1], 'iı', 'İI') AS c FROM n) SELECT CASE WHEN regexp_matches(c, '\\p{{L}}') THEN upper(c) ELSE '#' END AS letter, count(DISTINCT name) AS n FROM l GROUP BY 1")
def brand_index(spark, sf_dir):
    """Every name under its upper-case first letter by Turkish rules; dotted and dotless i are two letters."""
    n = table(spark, sf_dir, "part").select(F.concat(turn(LETTERED, 1), "p_name").alias("name"))
    return n.groupBy(index_letter(F.col("name")).alias("letter")).agg(F.countDistinct("name").alias("n"))


@query("A40_list_views", "SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_size + count(event_id) AS BIGINT) AS views FROM part LEFT JOIN events ON json_extract_string(props, '$.k') = CAST(p_partkey AS VARCHAR) AND event_type = 'view' GROUP BY p_partkey, p_size")
def list_views(spark, sf_dir):
    """Views since added to stored counters; lists without any keep theirs."""
    stored = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("long").alias("views"))
    return audits_op.bump_views(stored, table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.get_json_object("props", "$.k").alias("id")))


@query("A43_scored_brands", "SELECT count(*) FILTER (score IS NOT NULL) AS n, count(*) AS brands FROM (SELECT p_brand, CASE WHEN min(p_partkey) % 4 > 0 THEN 3.0 END AS score FROM part GROUP BY 1)")
def scored_brands(spark, sf_dir):
    """Brands that have an editorial score."""
    b = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("k"))
    scores = b.filter("k % 4 > 0").select("p_brand", F.lit(3.0).alias("score"))
    return b.join(scores, "p_brand", "left").agg(F.count("score").alias("n"), F.count("*").alias("brands"))


@query("U04_nav_categories", f"{P} SELECT DISTINCT category FROM product WHERE category NOT IN ('ÇANTA', 'AYAKKABI')")
def nav_categories(spark, sf_dir):
    """Categories without those that are archived, as a set difference."""
    gone = spark.createDataFrame([("ÇANTA",), ("AYAKKABI",)], "category string")
    return products(spark, sf_dir).select("category").distinct().subtract(gone)


@query("K04_shrink_guard", f"{P}, n AS (SELECT category, count(*) AS new_n FROM product GROUP BY 1), o AS (SELECT count(*) AS old_n FROM product) SELECT category, old_n, new_n, new_n < 0.6 * old_n AS refused FROM n, o")
def shrink_guard(spark, sf_dir):
    """Whether the writer's guard would refuse a catalogue of one category only in place of the whole."""
    p = products(spark, sf_dir)
    whole = p.agg(F.count("*").alias("old_n"))
    return p.groupBy("category").agg(F.count("*").alias("new_n")).crossJoin(F.broadcast(whole)).select("category", "old_n", "new_n", sources.shrinks(F.col("old_n"), F.col("new_n")).alias("refused"))


@query("N10_every_kth", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS c FROM documents) SELECT doc_id FROM n WHERE i % greatest(c // 20, 1) = 0")
def every_kth(spark, sf_dir):
    """Every k-th of all documents so that about twenty stay.

    Rows are numbered by lots: counts first, then numbers within each, so no task sees all rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id")
    lot = F.floor(F.col("doc_id") / 1024)
    sizes = docs.groupBy(lot.alias("lot")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("lot").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("lot", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("c"))
    at = F.row_number().over(Window.partitionBy("lot").orderBy("doc_id")) - 1
    rows = docs.withColumn("lot", lot).withColumn("at", at).join(sizes, "lot")
    return rows.filter((F.col("before") + F.col("at")) % F.greatest(F.floor(F.col("c") / 20), F.lit(1)) == 0).select("doc_id")


@query(
    "F26_suggestions",
    f"""{COPIES}, b AS (SELECT DISTINCT brand AS v FROM c WHERE contains({sql_fold('brand')}, 'nd#1')), g AS (SELECT DISTINCT category AS v FROM c WHERE contains({sql_fold('category')}, 'nd#1')),
    r AS (SELECT 0 AS place, 'brand' AS kind, v, row_number() OVER (ORDER BY v) AS k FROM b UNION ALL SELECT 1, 'category', v, row_number() OVER (ORDER BY v) FROM g),
    b2 AS (SELECT DISTINCT brand AS v FROM c WHERE contains({sql_fold('brand')}, 'ka')), g2 AS (SELECT DISTINCT category AS v FROM c WHERE contains({sql_fold('category')}, 'ka')),
    r2 AS (SELECT 0 AS place, 'brand' AS kind, v, row_number() OVER (ORDER BY v) AS k FROM b2 UNION ALL SELECT 1, 'category', v, row_number() OVER (ORDER BY v) FROM g2),
    x AS (SELECT 'nd#1' AS needle, * FROM r WHERE place = 1 OR k <= 5 UNION ALL SELECT 'ka', * FROM r2 WHERE place = 1 OR k <= 5)
    SELECT needle, kind, v, row_number() OVER (PARTITION BY needle ORDER BY place, k) AS rank FROM x QUALIFY rank <= 6""",
)
def suggestions(spark, sf_dir):
    """For each needle at most five brands, then categories, six in all; needles under two characters have none."""
    n = names(spark, sf_dir)
    both = F.array(*(F.struct(F.lit(kind).alias("kind"), v.alias("v")) for kind, v in (("brand", F.col("brand")), ("category", classify.categorize(F.col("name"))))))
    every = written(n.select(F.explode(both).alias("e")).select("e.*").distinct(), "suggested")
    kinds = [(place, kind, every.filter(F.col("kind") == kind).select("v")) for place, kind in enumerate(("brand", "category"))]
    found = None
    for needle in ("nd#1", "ka", "k"):
        if len(needle) < 2:
            continue
        for place, kind, values in kinds:
            met = values.filter(F.contains(fold(F.col("v")), F.lit(needle))).orderBy("v").limit(5 if kind == "brand" else 6)
            met = met.select(F.lit(needle).alias("needle"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), "v")
            found = met if found is None else found.unionByName(met)
    rank = F.row_number().over(Window.partitionBy("needle").orderBy("place", "v"))
    return found.withColumn("rank", rank).filter("rank <= 6").select("needle", "kind", "v", "rank")


@query(
    "P14_owner_check",
    """WITH a AS (SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS foreign_, o_orderkey % 11 = 4 AS bare, o_orderkey % 7 = 1 AS new FROM orders),
    s AS (SELECT count(*) AS n FROM a WHERE NOT new), k AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM a WHERE new AND NOT bare)
    SELECT a.id, CASE WHEN bare THEN 'bos' WHEN NOT new AND foreign_ THEN 'sahip' WHEN new AND k > 40 THEN 'dolu' END AS error,
           CASE WHEN error IS NULL THEN 5 END AS items, CASE WHEN error IS NULL THEN 'c0|c2|c3|c4' END AS covers FROM a LEFT JOIN k ON a.id = k.id""",
)
def owner_check(spark, sf_dir):
    """A list is published anew only by its owner, a new one while there is room for it; ids once each, four covers."""
    key = lambda c: F.sha2(c.cast("string"), 256)
    o = table(spark, sf_dir, "orders")
    stored = o.filter("o_orderkey % 7 <> 1").select(F.col("o_orderkey").alias("id"), key(F.col("o_custkey")).alias("owner"))
    ids = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k == 7, "").otherwise((k % 5).cast("string")))
    asked = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"), key(F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).alias("writer"),
        F.when(F.col("o_orderkey") % 11 == 4, F.array(F.lit(""))).otherwise(ids).alias("ids"), F.array(*map(F.lit, ["c0", "", "c2", "c3", "c4", "c5"])).alias("covers"),
    )
    found = resolve.publish(stored, asked, most_lists=stored.count() + 40)
    return found.select("id", "error", F.when(F.col("accepted"), F.size("ids")).alias("items"), F.array_join("covers", "|").alias("covers"))


@query(
    "X36_category_groups",
    """WITH c AS (SELECT p_partkey AS id, ['TAKI', 'GÖZLÜK', 'SAAT', 'CÜZDAN', 'AKSESUAR', 'ÇANTA', 'ŞAPKA', 'KEMER', 'ÇORAP', 'TİŞÖRT', 'JEAN', 'MONT', 'ETEK', 'İÇ GİYİM', 'DİĞER', 'AYAKKABI'][p_partkey % 16 + 1] AS category FROM part)
    SELECT id, category, CASE WHEN category = 'TİŞÖRT' THEN 'ÜST GİYİM' WHEN category = 'JEAN' THEN 'ALT GİYİM' WHEN category = 'MONT' THEN 'DIŞ GİYİM' WHEN category = 'ETEK' THEN 'ELBİSE & TAKIM'
    WHEN category = 'İÇ GİYİM' THEN 'İÇ GİYİM' WHEN category = 'DİĞER' THEN 'SINIFLANDIRILMAMIŞ' WHEN category <> 'AYAKKABI' THEN 'AKSESUAR' END AS grp,
    category NOT IN ('TAKI', 'GÖZLÜK', 'SAAT', 'CÜZDAN', 'AKSESUAR') AS has_sizes FROM c""",
)
def category_groups(spark, sf_dir):
    """The heading of each product's category, and whether it keeps sizes; archived categories stand under no heading."""
    some = ["TAKI", "GÖZLÜK", "SAAT", "CÜZDAN", "AKSESUAR", "ÇANTA", "ŞAPKA", "KEMER", "ÇORAP", "TİŞÖRT", "JEAN", "MONT", "ETEK", "İÇ GİYİM", "DİĞER", "AYAKKABI"]
    category = F.element_at(F.array(*map(F.lit, some)), (F.col("p_partkey") % len(some) + 1).cast("int"))
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), category.alias("category"))
    return c.select("id", "category", classify.group_of_category(F.col("category")).alias("grp"), classify.cat_has_sizes(F.col("category")).alias("has_sizes"))
