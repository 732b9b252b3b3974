"""HTML extraction and raster colours on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions import html, images, logos, text
from vitrine.operators import resolve

PAGE = """<html><head><meta property="og:image" content="o.jpg?a=1&amp;b=2">
<script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": "Product", "name": "Tee", "image": ["i.jpg"],
 "offers": [{"price": "1.799,90", "availability": "https://schema.org/OutOfStock", "priceCurrency": "try"}, {"price": "1999", "availability": "InStock"}]}]}</script>
<script type="application/ld+json">{broken</script></head></html>"""


def test_page_record(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<html></html>"), (3, None)], "id int, h string")
    rows = {r.id: r.r for r in df.select("id", html.page_record(F.col("h")).alias("r")).collect()}
    assert tuple(rows[1]) == ("Tee", 1999.0, "TRY", "i.jpg", True) and rows[2] is None and rows[3] is None
    assert df.select(html.meta(F.col("h"), "og:image").alias("m")).first().m == "o.jpg?a=1&b=2"


def test_perks_and_sitemap(spark):
    text = "2.000 TL ve üzeri ücretsiz kargo | 14 gün içinde kolay iade | 3 taksit"
    row = spark.createDataFrame([(text,)], "t string").select(html.perks(F.col("t")).alias("p")).first()
    assert {x.kind: x.text for x in row.p} == {"kargo": "2.000 TL ve üzeri ücretsiz kargo", "iade": "14 gün içinde kolay iade", "taksit": "3 taksit"}
    xml = "<urlset><url><loc> a </loc><image:image></image:image></url><url><loc><![CDATA[b]]></loc></url><url></url></urlset>"
    row = spark.createDataFrame([(xml,)], "x string").select(html.sitemap_entries(F.col("x")).alias("e"), html.widest(F.lit("a.jpg 320w, b.jpg 1280w, c.jpg 640w")).alias("w")).first()
    assert [(e.loc, e.image) for e in row.e] == [("a", True), ("b", False)] and row.w == "b.jpg"


@pytest.mark.parametrize(("head", "kind"), [(b"\xff\xd8\xff\xe0" + b"\0" * 9, "image/jpeg"), (b"RIFFxxxxWEBP", "image/webp"), (b"\0\0\0\x18ftypavif", "image/avif"), (b"GIF89a", None), (b"plain text..", None)])
def test_image_types(spark, head, kind):
    assert spark.createDataFrame([(bytearray(head),)], "b binary").select(html.image_type(F.col("b"))).first()[0] == kind


def test_snap(spark):
    df = spark.createDataFrame([(0,), (100,), (320,), (5000,)], "w int")
    assert [r[0] for r in df.select(html.snap_width(F.col("w"), [160, 320, 640])).collect()] == [0, 160, 320, 640]


def raster(ground, *blocks, n=64):
    px = np.zeros((n, n, 3), np.uint8)
    px[:] = ground
    for (a, b), color in blocks:
        px[12:52, a:b] = color
    return px.tobytes()


def test_raster_colors(spark):
    white = (250, 250, 250)
    cases = [raster(white, ((12, 52), (20, 20, 20))), raster(white, ((12, 32), (200, 20, 30)), ((32, 52), (30, 60, 200))), raster(white), b"xx", None,
             raster(white, ((12, 22), (200, 20, 30)), ((22, 32), (30, 60, 200)), ((32, 42), (40, 160, 60)), ((42, 52), (230, 200, 40)))]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(cases)], "i int, b binary")
    rows = df.select("i", images.color_tags("b").alias("t"), images.dominant_color("b").alias("d")).orderBy("i").collect()
    assert rows[0].t == ["siyah"] and rows[0].d == "#141414"
    assert sorted(rows[1].t) == ["kirmizi", "mavi"] and rows[2].t == [] and rows[2].d == "#fafafa" and rows[3].t == [] and rows[3].d is None and rows[4].t == []
    assert "cok-renkli" in rows[5].t


def test_tidy_golden(spark):
    golden = {
        "  | 2.500 TL ve üzeri  ücretsiz kargo ·": "2.500 TL ve üzeri ücretsiz kargo", "iade edebilir ya da": "iade edebilir", "kargo için ve ile da": "kargo için", "** %10 indirim,,": "%10 indirim",
        "x" * 100: "x" * 90, "14 gün içinde iade |": "14 gün içinde iade", "Ve": "Ve", "": "",
    }
    df = spark.createDataFrame(list(golden.items()), "t string, want string")
    assert not [r for r in df.select("t", "want", html.tidy(F.col("t")).alias("got")).collect() if r.got != r.want]


def test_visible_text_golden(spark):
    page = '<p msg="2.500 TL ücretsiz kargo" msg="kısa">a<b>b</b><FONT x>c</FONT><a href=x>d</a></p><script>x</script><noscript>n</noscript>&nbsp;e&amp;f&#39;s'
    got = spark.createDataFrame([(page,), ("<div>plain</div>",)], "h string").select(text.visible_text(F.col("h")).alias("t")).collect()
    assert [r.t for r in got] == ["2.500 TL ücretsiz kargo |  | abc | d | | | n | e&f's", " | plain | "]


def rgba(kind, n=16):
    px = np.zeros((n, n, 4), np.uint8)
    if kind in ("dark box", "light box", "dark mark on light box"):
        px[:] = (20, 20, 20, 255) if kind == "dark box" else (240, 240, 240, 255)
        if kind == "dark mark on light box":
            px[3:13, 3:13, :3] = 10
    elif kind != "nothing":
        px[4:12, 4:12] = {"dark": (10, 10, 10, 255), "light": (240, 240, 240, 255), "bright colour": (250, 160, 30, 255), "dark colour": (60, 0, 40, 255), "faint": (0, 0, 0, 90)}[kind]
    return px.tobytes()


def test_logo_inversion_golden(spark):
    golden = {"dark box": False, "light box": True, "dark mark on light box": True, "dark": True, "light": False, "bright colour": False, "dark colour": True, "faint": False, "nothing": False}
    df = spark.createDataFrame([(k, bytearray(rgba(k))) for k in golden] + [("broken", bytearray(b"abc")), ("null", None)], "k string, r binary")
    got = {r.k: r.i for r in df.select("k", logos.decide_invert("r", F.lit(16)).alias("i")).collect()}
    assert got == golden | {"broken": None, "null": None}


def test_logo_candidates_golden(spark):
    html_ = """<IMG class="hdr-logo" srcset="/l-200.webp 200w, /l-800.webp 800w" width=90><img src="/odeme/logo_visa.png"><img src="x.png" alt="Brand Logo">
      <link rel="icon" sizes="32x32" href="/fav.png"><link rel="apple-touch-icon" href="/touch.png"><link rel="stylesheet" href="/s.css">
      <script type="application/ld+json">[{"@type":"WebSite","publisher":{"@type":"Organization","logo":"https://c.com/deep.svg"}}]</script><meta property="og:image" content="/l-800.webp">"""
    got = spark.createDataFrame([(html_,), (None,), ("",)], "h string").select(logos.logo_candidates(F.coalesce("h", F.lit("")), F.lit("https://www.s.com/a/b.html"), F.lit("brand-co")).alias("c")).collect()
    assert [(x.url.removeprefix("https://www.s.com"), x.score, x.kind) for x in got[0].c] == [
        ("/l-800.webp", 102, "img"), ("/touch.png", 80, "icon"), ("https://c.com/deep.svg", 70, "jsonld"), ("/fav.png", 47, "icon"), ("/a/x.png", 43, "img"), ("/favicon.ico", 10, "icon"),
    ]
    assert [x.url for x in got[1].c] == [x.url for x in got[2].c] == ["https://www.s.com/favicon.ico"]


def test_names_are_cut_as_written(spark):
    golden = {
        "SİYAH Hoodie": "Hoodie", "Hoodie - AÇIK  MAVİ": "Hoodie", "Açık Yaka Gri\u0307 Tee": "Açık Yaka Tee", "I\u0307nce Beyaz/Navy Şort": "I\u0307nce / Şort", "Kırmızı": "Kırmızı", "Grimsi Mor": "Grimsi",
        "Tee | Mavi | Slim": "Tee | Slim", "a Mavi": "a Mavi", "GRI Tee": "GRI Tee", "SI\u0307YAH Tee": "SI\u0307YAH Tee", "Gri\u0307 Tee": "Tee",
    }
    df = spark.createDataFrame(list(golden.items()), "n string, want string")
    assert not [r for r in df.select("n", "want", resolve.clean_name(F.col("n")).alias("got")).collect() if r.got != r.want]
