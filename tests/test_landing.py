"""Landed pages as a data source, keyed tables, guarded brands, refresh runs and dead images, on small files."""

import hashlib
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vitrine import sources, streaming
from vitrine.operators import refresh as R
from vitrine.sources import landed, paged, sitemaps
from vitrine.sources.runs import KeyedTable


def land(folder, brand, page, n, price="5"):
    at = Path(folder, f"brand={brand}", f"page={page}")
    at.mkdir(parents=True)
    (at / "part-0.txt").write_text(json.dumps({"products": [{"id": k, "variants": [{"price": price}]} for k in range(n)]}))


@pytest.fixture
def source(spark):
    spark.dataSource.register(paged.LandedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return lambda reader, folder: reader.format("landed_pages").option("path", str(folder)).option("full", "3").load()


def test_lists_end(spark, source, tmp_path):
    for page, n in enumerate((3, 3, 2, 3), 1):  # what comes after a short page is not read
        land(tmp_path, "short", page, n)
    for page, n in enumerate((3, 3), 1):
        land(tmp_path, "cut", page, n)
    for page, price in enumerate(("5", "5", None), 1):
        land(tmp_path, "tired", page, 3, price)
    land(tmp_path, "full", 1, 3)
    land(tmp_path, "full", 2, 0)
    land(tmp_path, "free", 1, 3, "0")  # never had prices
    land(tmp_path, "free", 2, 1, "0")
    Path(tmp_path, "brand=broken", "page=1").mkdir(parents=True)
    Path(tmp_path, "brand=broken", "page=1", "x").write_text("{no")
    got = sorted((r.brand, r.page, r.products, r.note) for r in source(spark.read, tmp_path).collect())
    assert got == [
        ("cut", 1, 3, None), ("cut", 2, 3, "missing"), ("free", 1, 3, None), ("free", 2, 1, None), ("full", 1, 3, None),
        ("short", 1, 3, None), ("short", 2, 3, None), ("short", 3, 2, None), ("tired", 1, 3, None), ("tired", 2, 3, "priceless"),
    ]


def test_filters_choose_partitions(spark, source, tmp_path):
    for brand in ("a", "b", "c"):
        land(tmp_path, brand, 1, 2)
    some = source(spark.read, tmp_path).filter(F.col("brand").isin("a", "c"))
    assert some.rdd.getNumPartitions() == 2 and sorted(r.brand for r in some.collect()) == ["a", "c"]
    assert source(spark.read, tmp_path).filter("brand = 'b' and products > 1").count() == 1
    assert source(spark.read, tmp_path / "none").count() == 0


def test_pages_as_a_stream(spark, source, tmp_path):
    """Each page comes once, in the run after it landed."""
    land(tmp_path / "in", "a", 1, 3)

    def run():
        q = source(spark.readStream, tmp_path / "in").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        q.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.brand, r.page, r.products) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [("a", 1, 3)]
    land(tmp_path / "in", "a", 2, 2)
    land(tmp_path / "in", "b", 1, 1)
    assert run() == [("a", 1, 3), ("a", 2, 2), ("b", 1, 1)]


def files(path):
    return {str(p.relative_to(path)): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(path).rglob("*.parquet")}


def rows(spark, *values):
    return spark.createDataFrame(values, "key string, at long, value string, gone boolean")


def test_keyed_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = KeyedTable(spark, path, ["key"], "at", buckets=4, most_runs=3)
    assert table.read() is None and table.lookup([("a",)]) is None
    assert table.append(rows(spark, *((f"k{i}", 1, "old", False) for i in range(500))), 0)
    before = files(path)
    assert table.append(rows(spark, ("k1", 2, "new", False), ("k1", 3, "newest", False), ("k2", 0, "older", False), ("k3", 5, "", True)), 1, "gone")
    written = {n for n in files(path) if n not in before}
    assert all(n.startswith("run-0000000001/") for n in written) and len(written) <= 3 and {n: h for n, h in files(path).items() if n in before} == before
    state = lambda t=table, v=None: {r.key: r.value for r in t.read(v).collect()}
    assert len(state()) == 499 and state()["k1"] == "newest" and state()["k2"] == "old" and "k3" not in state()
    assert not table.append(rows(spark, ("k1", 9, "again", False)), 1) and state()["k1"] == "newest"  # the same batch changes nothing
    assert len(state(v=1)) == 500 and state(v=1)["k1"] == "old"  # an older version
    table.append(rows(spark, ("k9", 2, "nine", False)), 2)  # the third run: compacted
    left = {p.name for p in Path(path).iterdir()}
    assert [n for n in left if n.startswith("base-")] and table.manifest()["runs"] == [] and state()["k9"] == "nine"
    table.append(rows(spark, ("k3", 4, "late", False), ("k4", 4, "four", False)), 3, "gone")
    assert "k3" not in state() and state()["k4"] == "four"  # a late row older than the deletion
    for n in range(4, 9):
        table.append(rows(spark, (f"x{n}", n, "x", False)), n)
    names = [p.name for p in Path(path).iterdir() if p.name != "manifest"]
    assert len([n for n in names if n.startswith("base-")]) <= 2 and len(names) <= 2 + 2 * 3 and len(list(Path(path, "manifest").glob("[0-9]*.json"))) <= 5
    again = KeyedTable(spark, path, ["key"], "at")
    assert state(again) == state() and len(state()) == 504
    table.compact(F.col("at") < 6)
    assert len(state()) == 504
    assert {r.key: r.value for r in again.lookup([("k1",), ("nobody",), ("k3",)]).collect()} == {"k1": "newest"}
    plan = again.lookup([("k1",)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters:")[1][:40]


def test_refused_brands_keep_their_files(spark, tmp_path):
    kind = "id long, price double, sizes array<string>, brand_slug string"
    path = f"{tmp_path}/brands"
    make = lambda *spec: spark.createDataFrame([(k, p, ["S"] if s else [], b) for b, n, p, s in spec for k in range(n)], kind)
    sources.write_brands(make(("a", 10, 1.0, 1), ("b", 10, 1.0, 1), ("c", 10, 1.0, 1), ("d", 10, 1.0, 1)), path, f"{tmp_path}/r1")
    before = files(path)
    told = sources.write_brands(make(("a", 5, 2.0, 1), ("b", 10, None, 1), ("c", 9, 2.0, 1), ("e", 1, 2.0, 0)), path, f"{tmp_path}/r2")
    assert {r.brand_slug: r.keep_old for r in told.collect()} == {"a": True, "b": True, "c": False, "e": False}
    after = files(path)
    same = lambda b: {n: h for n, h in before.items() if f"={b}/" in n} == {n: h for n, h in after.items() if f"={b}/" in n}
    assert same("a") and same("b") and same("d") and not same("c")
    got = {r.brand_slug: (r.n, r.p) for r in spark.read.parquet(path).groupBy("brand_slug").agg(F.count("*").alias("n"), F.max("price").alias("p")).collect()}
    assert got == {"a": (10, 1.0), "b": (10, 1.0), "c": (9, 2.0), "d": (10, 1.0), "e": (1, 2.0)}


def test_lots_are_dealt_once(spark, tmp_path):
    done = f"{tmp_path}/done"
    seen = []

    def work(lot):
        seen.append(lot.count())
        return lot.select("id", F.lit(1).alias("run"))

    got = landed.in_lots(spark.range(100), done, work, lot=30)
    assert got.count() == 100 and sum(seen) == 100 and 2 <= len(seen) <= 4 and not [x for x in os.listdir(tmp_path) if "lots" in x]


def test_refresh_goes_on(spark, tmp_path):
    """Two lots fit the time of the first run; the second begins with the third; fast stores are never left out."""
    plan = spark.createDataFrame([(f"f{k}", 0, k) for k in range(1, 4)] + [(f"s{k}", 1, k) for k in range(1, 8)], "slug string, lane int, place long")
    assert R.queue(plan, f"{tmp_path}/lots", lot=2) == 6
    state = KeyedTable(spark, f"{tmp_path}/state", ["slug"], "at")
    lots = []

    def work(lot):
        lots.append(sorted(r.slug for r in lot.collect()))
        return lot.select("slug", F.lit(len(lots)).alias("at"))

    run = lambda budget: R.refresh(spark, f"{tmp_path}/lots", f"{tmp_path}/cp", state, work, budget, clock=lambda: float(len(lots)))
    assert not run(3) and lots == [["f1", "f2"], ["f3"], ["s1", "s2"], ["s3", "s4"]]
    assert {r.slug for r in state.read().collect()} == {"f1", "f2", "f3", "s1", "s2", "s3", "s4"}
    assert run(100) and lots[4:] == [["s5", "s6"], ["s7"]] and state.read().count() == 10


def test_dead_images(spark, tmp_path):
    """Marks are known for an hour and no more than three of them; what was marked first leaves first."""
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set(key, rocks)
    at = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    steps = [  # one file, so one batch, each
        [("a", 0, True), ("b", 1, True), ("a", 2, False), ("x", 2, False)],
        [("c", 10, True), ("a", 11, True), ("d", 12, True), ("a", 13, False), ("b", 13, False)],  # a came first, so a leaves for d
        [("b", 50, False), ("b", 62, False), ("c", 62, False)],  # an hour after its mark
        [("e", 200, True)],
        [("c", 201, False), ("d", 201, False), ("e", 201, False)],
    ]
    try:
        for k, step in enumerate(steps):
            df = spark.createDataFrame([(u, at(m), mark) for u, m, mark in step], "url string, at string, mark boolean")
            df.select("url", F.col("at").cast("timestamp").alias("at"), "mark").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
            os.utime(f"{tmp_path}/in/{k}")
            stream = spark.readStream.schema("url string, at timestamp, mark boolean").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            out = streaming.dead_images(stream, ttl=3600, most=3, groups=1, late="1 minute")
            q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            q.awaitTermination(180)
        got = {(r.url, r.at.hour * 60 + r.at.minute): r.dead for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    finally:
        spark.conf.unset(key)
    assert got == {
        ("a", 2): True, ("x", 2): False, ("a", 13): False, ("b", 13): True, ("b", 50): True, ("b", 62): False, ("c", 62): True, ("c", 201): False, ("d", 201): False, ("e", 201): True,
    }


def test_sitemap_depth_and_roots(spark):
    page = lambda *locs: "".join(f"<url><loc>{x}</loc></url>" for x in locs)
    o = "https://s.com"
    maps = {
        f"{o}/a.xml": page(f"{o}/b.xml", f"{o}/a.xml", f"{o}/urun/1", f"{o}/blog/urun/9"),
        f"{o}/b.xml": page(f"{o}/c.xml", f"{o}/urun/2", f"{o}/urun/1"),
        f"{o}/c.xml": page(f"{o}/d.xml", f"{o}/urun/3", f"{o}/long-name", f"{o}/abc", "https://other.com/long-name"),
        f"{o}/d.xml": page(f"{o}/urun/4"),
        f"{o}/z.xml": page(f"{o}/urun/5"),
    }
    roots = spark.createDataFrame([(o, 0, f"{o}/none.xml"), (o, 1, f"{o}/a.xml"), (o, 2, f"{o}/z.xml")], "origin string, root int, loc string")
    landed_maps = spark.createDataFrame(list(maps.items()), "loc string, xml string")
    walk = lambda **k: [r.url.removeprefix(o) for r in sitemaps.sitemap_pages(roots, landed_maps, **k).orderBy("place").collect()]
    assert walk() == ["/urun/3", "/long-name", "/urun/2", "/urun/1"]
    assert walk(cap=2) == ["/urun/3", "/long-name"] and walk(depth=0) == ["/urun/1"]
