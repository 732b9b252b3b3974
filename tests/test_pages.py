"""Pages, stores, landed files and share codes on small fixtures."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitrine.functions import pages, share
from vitrine.operators import accounts, merge
from vitrine.sources import landed, stores


def ld(body: str) -> str:
    return f'<script type="application/ld+json">{body}</script>'


def test_product_is_found_nearest_to_the_top():
    deep = '{"a":{"b":[{"@type":"Product","name":"deep"}]}}'
    assert pages.find_product(ld(deep))["name"] == "deep"
    assert pages.find_product(ld(deep) + ld('[{"@type":["X","Product"],"name":"top"}]'))["name"] == "top"
    assert pages.find_product(ld("{broken") + "<p>") is None and pages.find_product(None) is None
    far = '{"@type":"Product","name":"far"}'
    for _ in range(6):
        far = '{"x":' + far + "}"
    assert pages.find_product(ld(far)) is None


def test_plain_node_takes_every_form():
    node = pages.plain_node({"name": 5, "image": [{"url": "a"}, "b", 3], "offers": {"Price": 1.5, "availability": None}, "keywords": "k", "hasVariant": [{"size": "M"}], "additionalProperty": {"name": "Beden", "value": "L"}})
    assert node["name"] == "5" and node["images"] == ["a", "b"] and node["offers"][0]["price"] == "1.5" and node["keywords"] == ["k"] and node["sizes"] == ["M", "L"]


def test_inline_json_stops_at_its_end():
    assert pages.json_at('x = {"a":{"b":"}"}}; }', "x =") == '{"a": {"b": "}"}}'
    assert pages.json_at('x = {"a":', "x =") is None and pages.json_at("none", "x") is None and pages.json_at(None, "x") is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, brand_slug string, url string, html string")
    assert stores.page_records(none).count() == 0 and stores.distinct_records(stores.page_records(none)).columns == stores.RECORD
    assert stores.graph_records(spark.createDataFrame([], "brand_slug string, url string, cdn string, merchant string, body string")).count() == 0
    assert stores.own_api_records(spark.createDataFrame([(None, None, None), ("b", "u", "{broken")], "brand_slug string, url string, body string")).count() == 0


def test_short_ids(spark):
    """The two rounds by whole numbers."""

    def plain(text):
        h = 2166136261
        for c in text:
            h = (h ^ ord(c)) * 16777619 % 2**32
        second = (h ^ (h >> 15)) * share.SECOND_ROUND % 2**32
        second ^= second >> 13
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"
        out = ""
        for _ in range(7):
            h, r = divmod(h, 36)
            out = digits[r] + out
        return out + digits[second % 36]

    ids = ["", "a", "brand::name", "x" * 300, *map(str, range(200))]
    df = spark.createDataFrame(pd.DataFrame({"v": ids})).withColumn("s", share.short_id(F.col("v")))
    assert {r.v: r.s for r in df.collect()} == {v: plain(v) for v in ids}


def test_lots_go_on_where_they_stopped(spark, tmp_path):
    todo = spark.range(50).select("id")
    seen = []

    def work(lot):
        seen.append(lot.count())
        if len(seen) == 3:
            raise RuntimeError("cut short")
        return lot.withColumn("done", F.lit(True))

    with pytest.raises(RuntimeError):
        landed.in_lots(todo, f"{tmp_path}/done", work, lot=10)
    before = spark.read.parquet(f"{tmp_path}/done").count()
    assert landed.in_lots(todo, f"{tmp_path}/done", lambda d: d.withColumn("done", F.lit(True)), lot=10).count() == 50 and 0 < before < 50
    assert spark.read.parquet(f"{tmp_path}/done").select("id").distinct().count() == 50


def test_missing_and_empty_days(spark, tmp_path):
    row = spark.createDataFrame([("2024-01-02 10:00:00", "view")], "at string, kind string").withColumn("at", F.col("at").cast("timestamp"))
    landed.append_events(row, str(tmp_path), "views")
    spark.createDataFrame([("{bad",)], "value string").write.text(f"{tmp_path}/views/day=2024-01-03")
    assert landed.read_day(spark, str(tmp_path), "views", "2024-01-02").count() == 1
    assert landed.read_day(spark, str(tmp_path), "views", "2024-01-03").count() == 0
    assert landed.read_day(spark, str(tmp_path), "views", "2024-01-04") is None


def test_users_keep_their_first_role(spark):
    users = spark.createDataFrame([("1", "a@x", "user", ["email"], 1, 1)], "id string, email string, requested_role string, providers array<string>, created_at long, last_login_at long")
    logins = spark.createDataFrame([("a@x", "google", "seller", 5), ("b@x", "email", "seller", 6), ("b@x", "email", "user", 7)], "email string, provider string, role string, at long")
    got = {r.email: r for r in accounts.upsert_users(users, logins, spark.createDataFrame([("b@x",)], "email string")).collect()}
    assert (got["a@x"].providers, got["a@x"].role, got["a@x"].last_login_at) == (["email", "google"], "user", 5)
    assert (got["b@x"].requested_role, got["b@x"].role, got["b@x"].created_at, got["b@x"].last_login_at) == ("seller", "admin", 6, 7)


def test_colors(spark):
    df = spark.createDataFrame([("Siyah",), ("xyz",), ("",), ("Beyaz/Lacivert",), ("açık mavi",)], "v string")
    got = {r.v: r.h for r in df.withColumn("h", merge.color_to_hex(F.col("v"))).collect()}
    h = 0
    for c in "xyz":
        h = (h * 31 + ord(c)) & 255
    level = f"{70 + h % 90:02x}"
    assert got["Siyah"] == "#111111" and got["xyz"] == f"#{level * 3}" and got["Beyaz/Lacivert"] == "#ededea" and got["açık mavi"] == "#2f4a6a"
