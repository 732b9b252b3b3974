"""Operators that SQL can't express, against plain loops; sources, sinks and streams on small files."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitrine import sources, streaming
from vitrine.operators import catalog_query as C
from vitrine.operators import feed, resolve, userdata
from vitrine.sources import stores
from vitrine.sources.runs import KeyedTable


def plain_weave(items, rules, limit):
    """The greedy by its definition: (brand, category, tone, score) in load order to indexes in pick order."""
    lanes = {}
    for k, x in enumerate(items):
        lanes.setdefault(x[0], []).append(k)
    for lane in lanes.values():
        lane.sort(key=lambda k: -items[k][3])
    out, used, cats = [], dict.fromkeys(lanes, 0), {}
    while len(out) < min(limit, len(items)):
        best = spare = None
        for b, lane in lanes.items():
            if used[b] == len(lane):
                continue
            k = lane[used[b]]
            eff = items[k][3] * rules.fatigue ** used[b] * (rules.category_fatigue ** cats.get(items[k][1], 0) if rules.category_fatigue < 1 else 1)
            if spare is None or eff > spare[0]:
                spare = (eff, b, k)
            if best is not None and eff <= best[0]:
                continue
            if any(items[j][0] == b for j in out[::-1][: rules.brand_gap]):
                continue
            if rules.category_run and len(out) >= rules.category_run and all(items[j][1] == items[k][1] for j in out[-rules.category_run :]):
                continue
            if rules.tone_run and items[k][2] and len(out) >= rules.tone_run and all(items[j][2] == items[k][2] for j in out[-rules.tone_run :]):
                continue
            best = (eff, b, k)
        _, b, k = best or spare
        out.append(k)
        used[b] += 1
        cats[items[k][1]] = cats.get(items[k][1], 0) + 1
    return out


@pytest.mark.parametrize("mode", list(feed.RULES))
@pytest.mark.parametrize("brands", [1, 3, 12])
def test_weave(mode, brands):
    rng = random.Random(brands)
    items = [(f"b{rng.randrange(brands)}", f"c{rng.randrange(3)}", rng.randrange(3), rng.random()) for _ in range(150)]
    df = pd.DataFrame([(*x, k) for k, x in enumerate(items)], columns=["brand_slug", "category", "tone", "s", "pos"])
    assert feed.weave_rows(df, feed.RULES[mode], 100) == plain_weave(items, feed.RULES[mode], 100)


def test_query_urls_and_pages():
    q = C.CatalogQuery(
        category="İÇ GİYİM", brands=["Oath İstanbul", "A & B"], colors=["siyah", "mor"], genders=["kadin"], sizes=["39,5", "4'LU SET", "135/54"], styles=["y2k"],
        price="4k+", sort="TARİH", direction="desc", in_stock_only=False, page=3, search="hot gear",
    )
    roster = ["Oath İstanbul", "A & B", "C"]
    assert C.CatalogQuery.parse(q.url(), roster) == q and C.CatalogQuery().url() == ""
    assert "kategori=ic-giyim" in q.url() and "marka=oath-istanbul%2Ca-and-b" in q.url() and "stok=tumu" in q.url() and "yon=azalan" in q.url()
    pairs = [
        ("kategori=tisort", "cat=T%C4%B0%C5%9E%C3%96RT"), ("", "cat=T%C3%9CM+%C3%9CR%C3%9CNLER"), ("marka=oath-istanbul", "brand=OATH+ISTANBUL"), ("fiyat=2k-4k", "price=2"), ("fiyat=0-1k", "price=0"),
        ("sirala=fiyat", "sort=F%C4%B0YAT&dir=asc"), ("sirala=fiyat&yon=azalan", "sort=F%C4%B0YAT&dir=desc"), ("stok=tumu", "tukenmis=1"), ("beden=M&beden=39,5", "size=M&size=39,5"),
        ("sayfa=3", "page=3"), ("q=siyah+tee", "q=siyah tee"), ("kategori=ceket&marka=c&fiyat=4k%2B&sayfa=2", "cat=CEKET&brand=C&price=3&page=2"),
    ]
    for new, old in pairs:
        assert C.CatalogQuery.parse(new, roster) == C.CatalogQuery.parse(old, roster), (new, old)
    assert C.CatalogQuery.parse("sayfa=x").page == 1 and C.CatalogQuery.parse("marka=unheard-of").brands == ["unheard-of"] and not C.CatalogQuery.parse("stok=tumu").in_stock_only
    assert C.page_list(5, 20) == [1, "…", 4, 5, 6, "…", 20] and C.page_list(2, 5) == [1, 2, 3, 4, 5]
    assert C.cycle_sort("", "asc", "FİYAT") == ("FİYAT", "asc") and C.cycle_sort("FİYAT", "asc", "FİYAT") == ("FİYAT", "desc") and C.cycle_sort("FİYAT", "desc", "FİYAT") == ("", "asc")


def test_names(spark):
    df = spark.createDataFrame([("Basic Tee AÇIK MAVİ",), ("Açık Yaka Gömlek",), ("SİYAH Hoodie - Black",), (None,)], "n string")
    rows = df.select(resolve.colorless_key(F.col("n")).alias("k"), resolve.color_in_name(F.col("n")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("basic tee", "mavi"), ("açık yaka gömlek", None), ("hoodie", "siyah"), (None, None)]


def test_photos(spark):
    df = spark.createDataFrame([(["a.jpg", "no-image.png", None, "a.jpg", "x/varyasyonresim/1.jpg", "b.jpg"],)], "u array<string>")
    assert df.select(resolve.photos(F.col("u"))).first()[0] == ["a.jpg", "b.jpg"]


def test_fold_variants(spark):
    rows = [(1, 1, "a", False, 5.0, None, "S"), (1, 2, "a", True, 9.0, None, "M"), (1, 3, "a", True, 8.0, "u3", "L"), (1, 4, "b", False, 3.0, "u4", "S"), (1, 5, "c", True, 1.0, "u5", "S"), (1, 6, "a", True, 1.0, "u6", "XL")]
    df = spark.createDataFrame(rows, "pid long, pos long, key string, in_stock boolean, price double, url string, size string")
    got = {r.key: (r.in_stock, r.price, r.url, r.sizes, r.place) for r in resolve.fold_variants(df, 3).collect()}
    # the third key arrives at row 5, so row 6 is not seen although its key is known
    assert got == {"a": (True, 8.0, "u3", ["L", "M"], 1), "b": (False, 3.0, "u4", ["S"], 2), "c": (True, 1.0, "u5", ["S"], 3)}


def test_merge_lists(spark):
    kind = "pos long, id string, name string, items array<string>, created long, updated long"
    remote = spark.createDataFrame([(1, "r1", "Yaz", ["a", "b"], 5, 10), (2, "r2", "KIŞ", ["x"], 1, 2)], kind)
    local = spark.createDataFrame([(1, "l1", "kış ", ["x", "y"], 3, 9), (2, "r1", "Yaz 2", ["b", "c"], 4, 8), (3, "l3", "Kış", ["z"], 7, 7), (4, "l4", "Yeni", [], 1, 1)], kind)
    got = {r.id: (r.name, r["items"], r.created, r.updated) for r in userdata.merge_lists(remote, local).collect()}
    assert got == {"r1": ("Yaz", ["a", "b", "c"], 4, 10), "r2": ("kış ", ["x", "y"], 1, 9), "l3": ("Kış", ["z"], 7, 7), "l4": ("Yeni", [], 1, 1)}


def test_latest_and_votes(spark):
    df = spark.createDataFrame([("p", "u", 1), ("p", "u", 2), ("p", "v", 1), ("q", "u", 1)], "product_id string, voter string, at long")
    assert userdata.latest(df, ["product_id", "voter"], ["at"]).count() == 3
    assert userdata.latest(df, ["product_id", "voter"], ["at"], 1, "product_id", "at").count() == 2
    assert {r.product_id: r.votes for r in userdata.toggled_votes(df).collect()} == {"p": 1, "q": 1}


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "name": "Tee", "price": 5, "sizes": ["S"], "variants": [{"color": "x", "inStock": True}]}]))
    assert sources.read_catalog(spark, str(tmp_path / "c.json")).first().variants[0].inStock is True
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(ValueError, match="empty"):
        sources.read_catalog(spark, str(tmp_path / "none.json"))
    (tmp_path / "day=2024-01-01").mkdir()
    (tmp_path / "day=2024-01-01" / "v.jsonl").write_text('{"at": "2024-01-01T05:00:00Z", "brand": "A", "session": "s"}\nnot json\n')
    events = sources.read_events(spark, str(tmp_path / "day=*"))
    assert events.count() == 1
    (tmp_path / "b.csv").write_text("name,style,url\nOath,y2k;basic,https://o.example.com\n")
    assert sources.read_brands(spark, str(tmp_path / "b.csv")).first().styles == ["y2k", "basic"]
    options = [{"name": "Mint", "position": 2, "values": ["S", "M"]}, {"name": "Color", "position": 1, "values": ["Red", "Blue"]}]
    body = json.dumps({"products": [{"id": 7, "title": "Tee", "handle": "tee", "options": options, "variants": [{"option1": "Red", "option2": "S", "price": "9.5", "available": False}, {"option1": "Red", "option2": "M", "price": "12", "available": True}, {"option1": "Blue", "option2": "S", "price": "8", "available": False}], "images": [{"src": "a.jpg"}]}]})
    got = {r.color: (r.in_stock, r.price, r.sizes) for r in stores.shopify_records(spark.createDataFrame([("A", body)], "brand string, body string")).collect()}
    assert got == {"Red": (True, 12.0, ["M"]), "Blue": (False, 8.0, ["S"])}


def test_guarded_writes(spark, tmp_path):
    path = str(tmp_path / "catalog")
    assert sources.write_catalog(spark.range(10), path) == 10
    with pytest.raises(ValueError, match="replace"):
        sources.write_catalog(spark.range(5), path)
    assert sources.write_catalog(spark.range(5), path, force=True) == 5
    kind = "brand_slug string, price double, sizes array<string>"
    old = spark.createDataFrame([("a", 1.0, ["S"])] * 10 + [("b", 1.0, ["S"])] * 10 + [("c", 1.0, ["S"])], kind)
    new = spark.createDataFrame([("a", 2.0, ["S"])] * 5 + [("b", None, ["S"])] * 10 + [("c", 3.0, ["S"]), ("d", 4.0, [])], kind)
    got = sources.keep_last_good(old, new).groupBy("brand_slug").agg(F.count("*").alias("n"), F.max("price").alias("p")).collect()
    assert {r.brand_slug: (r.n, r.p) for r in got} == {"a": (10, 1.0), "b": (10, 1.0), "c": (1, 3.0), "d": (1, 4.0)}


def test_upserts(spark):
    old = spark.createDataFrame([("a", "1", None), ("b", "2", "x")], "k string, u string, v string")
    new = spark.createDataFrame([("a", None, "n"), ("c", "3", None)], "k string, u string, v string")
    assert {tuple(r) for r in sources.upsert(old, new, "k").collect()} == {("a", "1", "n"), ("b", "2", "x"), ("c", "3", None)}
    assert sources.insert_absent(old, new, "k").count() == 3


def run_stream(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    lines = [{"at": f"2024-01-0{1 + k % 3}T0{k % 9}:00:00Z", "kind": "product", "session": f"s{k % 4}"} for k in range(30)]
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken")
    counts = run_stream(streaming.day_counts(streaming.read_event_stream(spark, str(folder))), "days", "complete")
    assert sorted(r.n for r in counts.collect()) == [10, 10, 10]
    keyed = streaming.read_event_stream(spark, str(folder)).select(F.col("session").alias("key"), "at")
    got = run_stream(streaming.limited(keyed, 3600 * 24), "limits", "update").agg(F.sum("accepted").alias("a"), F.sum("refused").alias("r")).first()
    assert got.a + got.r == 30 and got.r > 0
    votes = keyed.select(F.lit("p").alias("product_id"), F.col("key").alias("voter"), "at")
    assert run_stream(streaming.one_vote_each(votes), "votes", "append").count() == 4
    out = str(tmp_path / "table")
    latest = streaming.upsert_batches(keyed, KeyedTable(spark, out, ["key"], "at"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    latest.awaitTermination(120)
    assert KeyedTable(spark, out, ["key"], "at").read().count() == 4


def landed_rows(spark, folder, rows, ddl):
    """A stream of the rows, as files that land."""
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.createDataFrame([], ddl).schema).parquet(folder)


def test_votes_with_eviction(spark, tmp_path):
    """With two known voters: the third pushes out the first, whose vote stays; pressing again counts anew."""
    presses = ["a", "b", "c", "a", "c"]
    rows = [("p", v, f"2024-01-01 00:00:0{k}") for k, v in enumerate(presses)]
    stream = landed_rows(spark, str(tmp_path / "in"), rows, "product_id string, voter string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = run_stream(streaming.restock_votes(stream, most_voters=2), "restock", "update").collect()
    assert [(r.product_id, r.votes) for r in got] == [("p", 3)]  # 1, 2, 3 (a out), 4 (b out), 3


def test_login_guard(spark, tmp_path):
    """Three wrong tries lock for a time; a right one clears; tries far apart don't add up."""
    tries = [("k", 0, False), ("k", 1, False), ("k", 2, False), ("k", 3, True), ("k", 20, True), ("m", 0, False), ("m", 1, True), ("m", 2, False), ("m", 3, False), ("m", 60, False)]
    rows = [(k, f"2024-01-01 0{m // 60}:{m % 60:02d}:00", ok) for k, m, ok in tries]
    stream = landed_rows(spark, str(tmp_path / "in"), rows, "key string, at string, ok boolean").withColumn("at", F.col("at").cast("timestamp"))
    got = {(r.key, r.at.minute + 60 * r.at.hour): r.verdict for r in run_stream(streaming.login_guard(stream, tries=3), "guard", "append").collect()}
    assert [got["k", m] for m in (0, 1, 2, 3, 20)] == ["wrong", "wrong", "wrong", "locked", "ok"]
    assert [got["m", m] for m in (0, 1, 2, 3, 60)] == ["wrong", "ok", "wrong", "wrong", "wrong"]


def test_log_sinks_and_deletes(spark, tmp_path):
    rows = [("view", "1", "2024-01-01 10:00:00", False), ("view", "2", "2024-01-02 10:00:00", False), ("click", "1", "2024-01-02 11:00:00", True)]
    stream = landed_rows(spark, str(tmp_path / "in"), rows, "kind string, key string, at string, gone boolean").withColumn("at", F.col("at").cast("timestamp"))
    for writer in streaming.log_sinks(stream, str(tmp_path / "logs"), str(tmp_path / "cp"), {"views": ["view"], "outbound": ["click"]}):
        writer.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.json(str(tmp_path / "logs" / "views")).groupBy("day").count().count() == 2 and spark.read.json(str(tmp_path / "logs" / "outbound")).count() == 1
    table = KeyedTable(spark, str(tmp_path / "t"), ["key"], "at")
    writer = streaming.upsert_batches(stream.select("key", "at", "gone"), table, str(tmp_path / "cp2"), deleted="gone")
    writer.trigger(availableNow=True).start().awaitTermination()
    assert [r.key for r in table.read().collect()] == ["2"]
