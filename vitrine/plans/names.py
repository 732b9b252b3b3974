"""The name rules over names made from the part table, each with the rule restated in SQL.

A name is the part's own with words of the trade around it, so that every rule, its exceptions and its spelling
variants occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import classify, html, rules
from vitrine.functions.color import NAMES, name_to_tags
from vitrine.functions.text import ACCENTED, BASES, PLAIN, TURKISH, fold, tr_lower
from vitrine.operators import search
from vitrine.plans.catalog import spread, sql_list, table

Q: dict = {}
SQL: dict[str, str] = {}

BEFORE = ["", "Oversize", "Kadın", "ERKEK", "Unisex", "Stray Kids", "Çocuk", "Basic", "Y2K", "Cry Baby", "Boca Juniors", "baby blue", "men's", "Women"]
AFTER = [
    "T - Shirt", "CARDIGAN 002", "UZUN KOLLU T-SHIRT", "Yeezy", "BEANIE", "Bikini Lines Baskılı Tshirt", "Bikini", "Denim Jacket", "Kargo Pantolon", "Köpek Tasması",
    "Külotlu Çorap", "Patchwork Jean", "Yama Patch", "Robotik Bardak", "slim fiT SHIRT", "Air Force 1", "Samba OG", "New Balance 9060", "Kombin 238", "Çift Kombin Tişört",
    "Mevsimlik Ceket", "ZIP - UP", "Gümüş Yüzüğü", "kemerli etek", "deri kemer", "Hediye Seti", "Pijama Takımı", "Eşofman Altı", "Mini Crop Top", "Cargo Denim Flare",
    "İPEK GÖMLEK", "Spor Bra", "Leopar Kürk", "Kaşmir", "Linen", "Mesh", "Su Geçirmez", "antrenman", "Jordan 4", "Cortez",
    "Salomon XT", "Tabi", "Vans", "Low-Rise", "Low - Rise", "Plain White", "Metalik Kelebek", "Kids", "Bebek Mavi", "Kid A",
]
SOURCE = ["", "Tişört / Üst", "sneaker", "Dekorasyon", "ceket, dış giyim"]
EDGE_SIZES = [["S", "M"], ["L", "XL", "2XL"], ["M", "L", "XL", "2XL"], ["9-10 YAŞ"], []]
KEY = "p_partkey"


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def turn(values: list, step: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col(KEY) / step) % len(values) + 1).cast("int"))


def sql_turn(values: list[str], step: int) -> str:
    quoted = "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
    return f"{quoted}[CAST({KEY} // {step} % {len(values)} + 1 AS INTEGER)]"


def names(spark, sf_dir) -> DataFrame:
    """id, name, source_text, sizes, brand."""
    sizes = F.element_at(F.array(*[F.array(*map(F.lit, s)).cast("array<string>") for s in EDGE_SIZES]), (F.col(KEY) % len(EDGE_SIZES) + 1).cast("int"))
    name = F.trim(F.concat_ws(" ", turn(BEFORE, 1), "p_name", turn(AFTER, 1)))
    return spread(table(spark, sf_dir, "part"), KEY).select(F.col(KEY).alias("id"), name.alias("name"), turn(SOURCE, 3).alias("source_text"), sizes.alias("sizes"), F.col("p_brand").alias("brand"))


NAME_SQL = f"""WITH n AS (SELECT {KEY} AS id, trim({sql_turn(BEFORE, 1)} || ' ' || p_name || ' ' || {sql_turn(AFTER, 1)}) AS name, {sql_turn(SOURCE, 3)} AS source_text,
    {KEY} % {len(EDGE_SIZES)} AS sizes, p_brand AS brand FROM part)"""


def sql_tr(x: str) -> str:
    return f"lower(replace(translate({x}, 'İI', 'iı'), chr(775), ''))"


def sql_copies(x: str, tight: bool = True) -> str:
    both = [sql_tr(x), f"lower(replace(translate({x}, 'İ', 'i'), chr(775), ''))"]
    if tight:
        both += [f"regexp_replace({h}, '\\s*[-–—]\\s*', '-', 'g')" for h in both]
    return f"concat_ws(chr(1), {', '.join(both)})"


def sql_hit(hay: str, free: list[str], whole: list[str] | tuple = ()) -> str:
    pattern = classify.plain_pattern(free, whole).replace("'", "''")
    return f"regexp_matches({hay}, '{pattern}')"


def sql_category(hay: str) -> str:
    cases = []
    for category, free, whole in rules.CATEGORY_RULES:
        meets = sql_hit(hay, free, whole)
        if category == "İÇ GİYİM":
            meets += f" AND NOT {sql_hit(hay, rules.OUTER)}"
        cases.append(f"WHEN {meets} THEN '{category}'")
    return f"CASE {' '.join(cases)} ELSE 'DİĞER' END"


COPIES = f"{NAME_SQL}, h AS (SELECT *, {sql_copies('name')} AS hay, {sql_copies('name', False)} AS two, {sql_tr('name')} AS tr, {sql_copies('source_text')} AS src FROM n), c AS (SELECT *, {sql_category('hay')} AS category FROM h)"


@query("X03_categories", f"{COPIES} SELECT id, category FROM c")
def categories(spark, sf_dir):
    return names(spark, sf_dir).select("id", classify.categorize(F.col("name")).alias("category"))


@query("F12_non_wearable", f"{COPIES} SELECT id, category = 'DİĞER' AND {sql_hit('tr', rules.NOT_WORN)} AS gone FROM c")
def non_wearable(spark, sf_dir):
    n = names(spark, sf_dir).withColumn("category", classify.categorize(F.col("name")))
    return n.select("id", classify.is_non_wearable(F.col("name"), F.col("category")).alias("gone"))


@query("X04_shoe_models", f"{COPIES} SELECT id, {sql_hit('hay', rules.SHOE_MODELS)} AS shoe FROM c")
def shoe_models(spark, sf_dir):
    return names(spark, sf_dir).select("id", classify.looks_like_shoe(F.col("name")).alias("shoe"))


@query(
    "P09_final_category",
    f"""{COPIES}, d AS (SELECT *, CASE WHEN category = 'DİĞER' AND NOT {sql_hit('tr', rules.NOT_WORN)} THEN {sql_category('src')} ELSE category END AS second FROM c)
    SELECT id, CASE WHEN second = 'DİĞER' AND {sql_hit('hay', rules.SHOE_MODELS)} THEN 'AYAKKABI' ELSE second END AS category FROM d""",
)
def final_category(spark, sf_dir):
    return names(spark, sf_dir).select("id", classify.final_category(F.col("name"), F.col("source_text")).alias("category"))


SQL_MEN = f"(regexp_matches(tr, '{'|'.join(rules.MEN)}') OR regexp_matches(tr, '(^|[^A-Za-z0-9_])({'|'.join(rules.MEN_WHOLE)})($|[^A-Za-z0-9_])'))".replace("men'?s", "men''?s")


@query(
    "X05_genders",
    f"""{COPIES}, g AS (SELECT *, {sql_hit('tr', rules.WOMEN)} AS w, {SQL_MEN} AS m, {sql_hit('tr', rules.UNISEX)} AS u, {sql_hit('tr', rules.LOOSE)} AS l FROM c)
    SELECT id, CASE WHEN NOT u AND w AND NOT m THEN 'KADIN' WHEN NOT u AND m AND NOT w THEN 'ERKEK' WHEN NOT u AND NOT w AND NOT m AND category IN ({', '.join(f"'{x}'" for x in classify.WOMEN_CATEGORIES)}) THEN 'KADIN'
    WHEN u OR l THEN 'UNISEX' WHEN sizes IN (1, 2) THEN 'ERKEK' ELSE 'UNISEX' END AS gender FROM g""",
)
def genders(spark, sf_dir):
    n = names(spark, sf_dir)
    found = classify.detect_genders(F.col("name"), classify.categorize(F.col("name")), F.col("sizes"))
    return n.select("id", classify.gender_label(found).alias("gender"))


@query(
    "F21_kids",
    f"""{COPIES}, k AS (SELECT *, lower({sql_tr('name')}) || chr(1) || {sql_tr('lower(name)')} AS two_copies, trim({sql_tr('brand')}) AS b FROM c), s AS (SELECT *, replace(two_copies, b, ' ') AS left_over FROM k)
    SELECT id, CASE WHEN sizes = 3 THEN 'age' WHEN {sql_hit('left_over', rules.SLOGANS)} THEN '-' WHEN {sql_hit('left_over', [], rules.KIDS)} THEN 'name' ELSE '-' END AS reason FROM s""",
)
def kids(spark, sf_dir):
    n = names(spark, sf_dir)
    return n.select("id", F.coalesce(classify.kids_reason(F.col("name"), F.col("sizes"), F.col("brand")), F.lit("-")).alias("reason"))


@query("F30_slogans", f"{COPIES} SELECT id FROM c WHERE {sql_hit('two', rules.SLOGANS)}")
def slogans(spark, sf_dir):
    return names(spark, sf_dir).filter(classify.hit(classify.copies(F.col("name"), tight=False), rules.SLOGANS)).select("id")


def sql_styles(prior: str) -> str:
    says = {k: sql_hit("two", *v) for k, v in rules.STYLE_WORDS.items()}
    add = {
        "streetwear": "pattern", "basic": "NOT pattern AND plain", "minimalist": "NOT pattern AND minimal", "techwear": "tech",
        "ravewear": "rave OR category = 'KORSE / BODY'", "spor": "sport OR category IN ('EŞOFMAN ALTI', 'FORMA', 'TAYT')",
        "old-money": "NOT pattern AND (old_money OR category IN ('TRİKO / KAZAK', 'HIRKA'))",
        "y2k": "y2k_strong OR (y2k_free AND y2k_whole)",
    }
    made = ", ".join(f"CASE WHEN {c} THEN '{s}' END" for s, c in add.items())
    flags = ", ".join(f"{v} AS {k}" for k, v in says.items())
    return (
        f"{COPIES}, y AS (SELECT *, {flags} FROM c) SELECT id, array_to_string(list_sort(list_distinct(list_concat(list_filter({sql_list(prior)}, lambda s: NOT (pattern AND s IN ('basic', 'minimalist'))), "
        f"list_filter([{made}], lambda s: s IS NOT NULL)))), '|') AS styles FROM y"
    )


PRIOR = ["basic", "y2k"]


@query("X07_styles", sql_styles(PRIOR))
def styles(spark, sf_dir):
    n = names(spark, sf_dir)
    found = classify.product_styles(F.col("name"), classify.categorize(F.col("name")), F.array(*map(F.lit, [*PRIOR, "techwear"])))
    return n.select("id", F.array_join(F.array_sort(found), "|").alias("styles"))


def sql_fold(x: str) -> str:
    return f"lower(translate(translate({x}, '{TURKISH}', '{PLAIN}'), '{ACCENTED}', '{BASES}'))"


SYNONYM_ROWS = ", ".join(f"('{k}', [{', '.join(repr(v) for v in vs)}])" for k, vs in search.SYNONYMS.items())


@query(
    "J23_synonyms",
    f"""{NAME_SQL}, s(token, more) AS (VALUES {SYNONYM_ROWS}), t AS (SELECT id, generate_subscripts(string_split({sql_fold('name')}, ' '), 1) AS place, unnest(string_split({sql_fold('name')}, ' ')) AS token FROM n)
    SELECT id, CAST(place AS BIGINT) - 1 AS place, array_to_string(list_concat([t.token], coalesce(more, [])), '|') AS found FROM t LEFT JOIN s ON s.token = t.token""",
)
def synonyms(spark, sf_dir):
    n = names(spark, sf_dir)
    groups = search.expand_tokens(F.split(fold(F.col("name")), " "))
    return n.select("id", F.posexplode(groups).alias("place", "g")).select("id", F.col("place").cast("long").alias("place"), F.array_join("g", "|").alias("found"))


SHOWN = ["Gri Melanj", "Açık Mavi", "Siyah/Beyaz", "Siyah - mavisi", "-", "Nefti", "Kırmızı, Bordo", "black red", "Xyz", "", "koyu  yeşili"]
COLOR_ROWS = ", ".join(f"('{n}', '{f}')" for n, f in NAMES.items())


@query(
    "X15_color_names",
    f"""WITH m(name, family) AS (VALUES {COLOR_ROWS}), d AS (SELECT name, first(family) AS family FROM m GROUP BY 1), c AS (SELECT {KEY} AS id, trim({sql_tr(sql_turn(SHOWN, 1) + " || CASE WHEN p_size % 4 = 0 THEN '/' || p_name ELSE '' END")}) AS key FROM part),
    p AS (SELECT id, key, generate_subscripts(regexp_split_to_array(key, '[/\\-,|+&]'), 1) AS i, trim(unnest(regexp_split_to_array(key, '[/\\-,|+&]'))) AS part FROM c),
    pf AS (SELECT p.*, d.family FROM p LEFT JOIN d ON d.name = p.part WHERE p.part <> ''),
    w AS (SELECT id, i, family, 0 AS j FROM pf WHERE family IS NOT NULL UNION ALL
          SELECT id, i, coalesce((SELECT family FROM d WHERE d.name = x.word), (SELECT family FROM d WHERE d.name = regexp_replace(x.word, '(si|sı|su|sü|i|ı|u|ü)$', ''))), j
          FROM (SELECT id, i, generate_subscripts(regexp_split_to_array(part, '\\s+'), 1) AS j, unnest(regexp_split_to_array(part, '\\s+')) AS word FROM pf WHERE family IS NULL) x
          WHERE word NOT IN ('açık','acik','koyu','orta','antik','soft','light','dark','pale','deep','neon','pastel','mat','parlak','metalik','rengi','renk','tonu')),
    f AS (SELECT id, family, min(i * 1000 + j) AS place FROM w WHERE family IS NOT NULL GROUP BY 1, 2)
    SELECT c.id, CASE WHEN key IN ('', '-') THEN '' WHEN d.family IS NOT NULL THEN d.family ELSE coalesce((SELECT string_agg(family, '|' ORDER BY place) FROM f WHERE f.id = c.id), '') END AS found
    FROM c LEFT JOIN d ON d.name = c.key""",
)
def color_names(spark, sf_dir):
    raw = F.concat(turn(SHOWN, 1), F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("/"), F.col("p_name"))).otherwise(""))
    return table(spark, sf_dir, "part").select(F.col(KEY).alias("id"), F.array_join(name_to_tags(raw), "|").alias("found"))


PERK_TEXT = [
    "Hoş geldiniz | {n} TL ve üzeri ücretsiz kargo | kolay iade imkanı", "1.800 TL'lik ürüne ÜCRETSİZ kargo", "ücretsiz kargo {n} TL üzeri siparişler için", "aynı gün kargo | 12 taksit seçeneği ile",
    "kapıda ödeme var | {n} gün içinde iade ve değişim hakkı", "ilk üyelik için yüzde {n} indirim kodu", "% 10 indirim kuponu hediye", "taksit imkanı tüm kartlara ve", "merhaba dünya",
]


def perk_sql() -> str:
    kinds = []
    for kind in dict.fromkeys(k for k, _ in html.PERKS):
        tidy = [f"tidy(regexp_extract(t, '(?i){p}', 0))".replace("tidy(", "") for k, p in html.PERKS if k == kind]
        firsts = []
        for x in tidy:
            x = x.removesuffix(")")
            x = f"regexp_replace(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^[^\\p{{L}}\\p{{N}}₺%]+', ''), '[|•·,]+$', '')"
            x = f"substr(trim({x}), 1, 90)"
            for _ in range(3):
                x = f"regexp_replace({x}, '(?i)\\s+({'|'.join(rules.DANGLING)})$', '')"
            x = f"trim({x})"
            firsts.append(f"CASE WHEN length({x}) >= 8 THEN {x} END")
        kinds.append(f"CASE WHEN coalesce({', '.join(firsts)}) IS NOT NULL THEN '{kind}=' || coalesce({', '.join(firsts)}) END")
    return f"concat_ws('|', {', '.join(kinds)})"


@query("X45_perks", f"WITH s AS (SELECT s_suppkey AS id, replace({sql_turn(PERK_TEXT, 1).replace(KEY, 's_suppkey')}, '{{n}}', CAST(s_nationkey + 5 AS VARCHAR)) AS t FROM supplier) SELECT id, {perk_sql()} AS found FROM s")
def perks(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, PERK_TEXT)), (F.col("s_suppkey") % len(PERK_TEXT) + 1).cast("int"))
    text = F.replace(text, F.lit("{n}"), (F.col("s_nationkey") + 5).cast("string"))
    found = F.array_join(F.transform(html.perks(text), lambda x: F.concat(x.kind, F.lit("="), x.text)), "|")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), found.alias("found"))


@query("X01_tr_lower", f"SELECT doc_id, md5({sql_tr("replace(text, 'ẞ', 'ß')")}) AS h FROM documents")
def lowered(spark, sf_dir):
    """Every document; a null text has no hash.  SQL says what becomes of the capital sharp s, as engines' lower() differ on it."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tr_lower(F.col("text"))).alias("h"))


@query("X12_fold", f"SELECT doc_id, md5({sql_fold("replace(text, 'ẞ', 'ß')")}) AS h FROM documents")
def folded(spark, sf_dir):
    """Every document; a null text has no hash."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fold(F.col("text"))).alias("h"))
