"""What only shows in larger tables: files of many rows, lists of many pages, ties, and work done once a row."""

import json
import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vitrine.functions import classify, rules
from vitrine.functions.color import hex_to_tag, tone_class
from vitrine.operators import merge
from vitrine.operators import refresh as R
from vitrine.sources import landed, paged
from vitrine.sources.runs import KeyedTable
from vitrine.plans import registry


FOLDER = "/root/testdata/sf0.001"
SMALL = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}


def arrays(spark, path, suffix, **options):
    """Files of five lots' arrays, written while shuffles are cut as finely as those of large tables."""
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(20_000).select(F.concat(F.lit("b"), F.col("id") % 5).alias("lot"), F.struct("id").alias("r"))
        landed.write_arrays(rows, path, "lot", "r", **options)
    finally:
        for k in SMALL:
            spark.conf.unset(k)
    return list(Path(path).rglob(f"*.{suffix}"))


def test_arrays_of_many_rows(spark, tmp_path):
    """A lot is one file whose brackets stand around all of its records."""
    files = arrays(spark, f"{tmp_path}/a", "txt")
    assert len(files) == 5 and sorted(r["id"] for f in files for r in json.loads(f.read_text())) == list(range(20_000))


def test_gzip_arrays_of_many_rows(spark, tmp_path):
    """The same compressed, through the catalogue's reader, which takes whole arrays only."""
    assert len(arrays(spark, f"{tmp_path}/a", "gz", compression="gzip")) == 5
    got = landed.CatalogCache(spark).get(f"{tmp_path}/a")
    assert got.count() == 20_000 and got.select("id").distinct().count() == 20_000


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_snapshot_files_stay_small(spark, tmp_path, monkeypatch):
    """More products are more files, not larger ones."""
    monkeypatch.setattr("vitrine.plans.files.LOT", 10)
    monkeypatch.setattr("vitrine.plans.files.shared", lambda spark, name: f"{tmp_path}/{name}")
    got = registry.queries()["S27_gzip_snapshot"](spark, FOLDER)
    assert got.select("id").distinct().count() == 200 and len(list(tmp_path.rglob("*.gz"))) == 20


def test_equal_places(spark, tmp_path):
    """Of candidates at one place the first row's counts, as in the order of the table."""
    rows = [(1, 7, k, 1, "R") for k in (5, 3, 9, 4)] + [(0, 7, 2, 1, "N"), (2, 8, 6, 1, "R"), (2, 8, 1, 1, "R")]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {(r.slug, r.url) for r in registry.queries()["S31_first_valid"](spark, str(tmp_path)).collect()} == {(7, 5), (8, 6)}


def test_lists_of_many_pages(spark, tmp_path):
    """A list is read to its end, however many pages it has; an option bounds it."""
    spark.dataSource.register(paged.LandedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for page in range(1, 71):
        at = Path(tmp_path, "brand=long", f"page={page}")
        at.mkdir(parents=True)
        (at / "part-0.txt").write_text(json.dumps({"products": [{"variants": [{"price": "5"}]}] * (3 if page < 70 else 1)}))
    read = spark.read.format("landed_pages").option("path", str(tmp_path)).option("full", "3")
    assert read.load().count() == 70 and read.option("most", "5").load().count() == 5


def test_records_of_many_pages(spark, tmp_path):
    """A list of 70 pages gives all its records."""
    p = spark.range(1400).select(F.col("id").alias("p_partkey"), F.lit("Brand#5").alias("p_brand"), F.lit("x").alias("p_name"), F.lit(9.0).alias("p_retailprice"))
    p.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert registry.queries()["S13_paged_records"](spark, str(tmp_path)).select("id").distinct().count() == 1400


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("parts"))
    p = spark.range(40).select(F.col("id").alias("p_partkey"), F.lit("red bolt").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("SMALL").alias("p_type"), (F.col("id") % 7).cast("int").alias("p_size"), F.lit(9.0).alias("p_retailprice"))
    p.coalesce(1).write.parquet(f"{path}/part.parquet")
    return path


@pytest.mark.parametrize("name", ["X03_categories", "X04_shoe_models", "X05_genders", "X07_styles", "P09_final_category", "F12_non_wearable", "A29_archive_audit"])
def test_names_are_lowered_once(spark, parts, name):
    """A rule list reads the copies of a name, it does not make them anew for each rule; and names are dealt over the cores first."""
    plan = registry.queries()[name](spark, parts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 16 and "RepartitionByExpression" in plan


def test_suggestions_read_names_once(spark, parts):
    """what can be suggested is worked out once, not once a needle and kind."""
    plan = registry.queries()["F26_suggestions"](spark, parts)._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(p_name" not in plan and "p_name" not in plan


def test_refresh_of_many_lots(spark, tmp_path):
    """Fast lots are one batch; slow ones as many as the time left has room for, the same stores as one by one."""
    plan = spark.createDataFrame([(f"f{k}", 0, k) for k in range(1, 31)] + [(f"s{k}", 1, k) for k in range(1, 41)], "slug string, lane int, place long")
    assert R.queue(plan, f"{tmp_path}/lots", lot=2) == 35
    state, lots = KeyedTable(spark, f"{tmp_path}/state", ["slug"], "at"), []

    def work(lot):
        lots.append(lot.count())
        return lot.select("slug", F.lit(len(lots)).alias("at"))

    run = lambda budget: R.refresh(spark, f"{tmp_path}/lots", f"{tmp_path}/cp", state, work, budget, clock=lambda: float(max(0, len(lots) - 1)), at_once=100)
    assert not run(1.5) and lots == [30, 2, 2]  # the second slow lot begins in time, the third does not
    assert run(100) and lots == [30, 2, 2, 2, 34] and state.read().count() == 70


def test_asks_at_one_time(spark, tmp_path):
    """Asks of one address at one time are a row each, and no number of marked addresses makes one forgotten."""
    ev = spark.createDataFrame([(1, 7, 0, "error"), (2, 7, 5, "view"), (3, 7, 5, "view"), (4, 8, 5, "view"), (5, 7, 50_000, "view")], "event_id long, user_id long, s long, event_type string")
    ev.select("event_id", "user_id", "event_type", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["T07_dead_images"](spark, str(tmp_path)).collect()
    assert sorted((r.event_id, r.dead) for r in got) == [(2, True), (3, True), (4, False), (5, False)]


@pytest.mark.parametrize("name", ["X10_better_hex", "X52_swatches", "S12_shop_records", "S14_graph_records", "S17_market_records", "S18_site_records", "X42_page_records"])
def test_parts_are_dealt(spark, parts, name):
    """Heavy work on each part is not left to the few splits of a small table."""
    assert "RepartitionByExpression" in registry.queries()[name](spark, parts)._jdf.queryExecution().optimizedPlan().toString()


def test_colours_are_read_once(spark):
    """The digits of a shade and the families of a name stand in the plan once each."""
    df = spark.range(1).select(F.lit("x").alias("h"), F.lit("y").alias("n")).repartition(2)
    plan = lambda c: df.select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan(hex_to_tag(F.col("h"))).count("regexp_extract") == 1 and plan(tone_class(F.col("h"))).count("regexp_extract") == 1
    assert plan(merge.better_hex(F.col("h"), F.col("h"), F.col("n"))).count("translate(") == 1


def test_pages_are_landed_by_the_source(spark, tmp_path):
    """A page is one file, not four and a folder's renames; names that need escapes are found again; a page landed again replaces the older."""
    at = f"{tmp_path}/lists"
    for price in ("5", "7"):
        p = spark.range(7).select(F.when(F.col("id") < 6, "a:b %41").alias("brand"), F.col("id").alias("pos"), F.struct("id", F.array(F.struct(F.lit(price).alias("price"))).alias("variants")).alias("product"))
        paged.land_pages(p, at, full=4)
    assert sorted(str(f.relative_to(at)) for f in Path(at).rglob("*") if f.is_file()) == [f"brand=a%3Ab %2541/page={n}/body.txt" for n in (1, 2)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    got = spark.read.format("landed_pages").option("path", at).option("full", "4").load().filter("brand = 'a:b %41'").orderBy("page").collect()
    assert [(r.page, r.products, r.note) for r in got] == [(1, 4, None), (2, 2, None)] and '"price":"7"' in got[0].body


def test_rules_look_at_a_letter_once():
    """A place in a name is left after one look where no word of a rule begins with its letter; the rule stays the same."""
    assert classify.pattern(["abc", "abd", r"\bxy", "a|z"], ["q"]).startswith(f"(?=[ax])(?:a(?:bc|bd)|x(?:(?<!{classify.WORD}x)y))|(?:(?:a|z))|(?=[q])")
    word = "[A-Za-z0-9_]"
    lists = [(f, w) for _, f, w in rules.CATEGORY_RULES] + [(rules.SHOE_MODELS, []), (rules.NOT_WORN, []), (rules.SLOGANS, []), ([], rules.KIDS), ([r"a\(b|c\)", "x?y", r"\bşal", r"\b\d+z"], ["z+w"])]
    said = [re.sub(r"\\b|\\s[*+]|[?*+()\[\]\\]", "", x).split("|")[0] for f, w in lists for x in [*f, *w]]
    names = [a.join((x, y)) for k, x in enumerate(said) for a, y in (("", "x"), (" ", said[k * 7 % len(said)]), ("ş", x), ("-", x[1:]))]
    for free, whole in lists:
        plain = [f"(?:{x})" for x in free] + ([f"(?<![{classify.LETTERS}])(?:{'|'.join(whole)})(?![{classify.LETTERS}])"] if whole else [])
        plain = "|".join(plain).replace(r"\b", f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))")
        assert [n for n in names if re.search(plain, n)] == [n for n in names if re.search(classify.pattern(free, whole), n)]
