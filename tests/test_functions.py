"""Golden tables and small properties of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from vitrine.functions import classify, color, sizes, text

SIZES = [
    ("Small", ["S"]), ("MEDIUM", ["M"]), ("X Large", ["XL"]), ("XLarge", ["XL"]), ("Xxlarge", ["2XL"]), ("X-SMALL", ["XS"]), ("Xl", ["XL"]), ("s", ["S"]),
    ("XXL", ["2XL"]), ("XXS", ["2XS"]), ("4XL", ["4XL"]), ("S-M", ["S", "M"]), ("S/M", ["S", "M"]), ("SM", ["S", "M"]), ("L/XL", ["L", "XL"]),
    ("2XL-3XL", ["2XL", "3XL"]), ("Small-Medium", ["S", "M"]), ("35-38", ["35", "36", "37", "38"]), ("30/32", ["30"]), ("32-32", ["32"]),
    ("TEK BOYUT", ["TEK BEDEN"]), ("OneSize", ["TEK BEDEN"]), ("OS", ["TEK BEDEN"]), ("Standart beden", ["TEK BEDEN"]),
    ("XL (M-L BEDENE TEKABUL EDER)", ["XL"]), ("28 (XXS)", ["28", "2XS"]), ("9-10 YAŞ", ["9-10 YAŞ"]), ("5-6 Yaş", ["5-6 YAŞ"]), ("42", ["42"]),
    ("105CM", ["105"]), ("W30 L32", ["W30/L32"]), ("w36 l32", ["W36/L32"]), ("Default Title", []), ("", []), ("Siyah", ["SIYAH"]), ("3", []), (None, []),
]
NUMBERS = [
    ("1.799,90", 1799.9), ("1.799", 1799.0), ("2.500,00", 2500.0), ("1.234.567", 1234567.0), ("799,9", 799.9), ("0,5", 0.5), ("1,799.90", 1799.9), ("1,799", 1799.0),
    ("12,345.67", 12345.67), ("19.99", 19.99), ("₺1.799,90", 1799.9), ("1 799,90", 1799.9), ("TRY 899", 899.0), ("1799", 1799.0), ("-5,5", -5.5), ("", None), ("bedava", None), (None, None),
]
CATEGORIES = [
    ("CARDIGAN 002", "HIRKA"), ("FOIL BEANIE", "ŞAPKA"), ("CHOK-DEE ZIP-UP", "HOODIE"), ("OVERSIZE T-SHIRT", "TİŞÖRT"), ("CLASSIC DENIM JACKET", "CEKET"),
    ("SLIM FIT SHIRT", "GÖMLEK"), ("Erkek Punk Viking Rune Yüzüğü", "TAKI"), ("CARD HOLDER 027", "CÜZDAN"), ("Kombin 238", "TAKIM"),
    ("MORE SWAG UZUN KOLLU T-SHIRT", "UZUN KOLLU"), ("Bikini Lines Baskılı Relaxed Fit Kadın Tshirt", "TİŞÖRT"), ("Kelebek Patchler", "AKSESUAR"),
    ("Erkek Baggy Fit Yüksek Bel Kemerli Gabardin Pantolon", "PANTOLON"), ("Erkek Sırtı Patchli Oversize T - Shirt", "TİŞÖRT"), ("Havlu Triko Polo", "TRİKO / KAZAK"),
    ("Keten Şort", "ŞORT"), ("Köpek Tasması", "-"), ("Y2K Pink Takma Tırnak", "-"), (None, "DİĞER"),
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def test_sizes(spark):
    rows = column(spark, [r for r, _ in SIZES]).select("i", "v", sizes.normalize_size(F.col("v")).alias("got")).collect()
    assert {(r.v, tuple(r.got)) for r in rows} == {(raw, tuple(want)) for raw, want in SIZES}


def test_size_preview(spark):
    shown, more = sizes.preview(F.col("v"))
    cases = [(["2XS", "S", "M"], ["S", "M"], 1), (["M", "S", "XL", "L", "2XL", "3XL"], ["S", "M", "L", "XL", "2XL"], 1), ([], [], 0), (["TEK BEDEN"], ["TEK BEDEN"], 0)]
    rows = column(spark, [c[0] for c in cases], "array<string>").select("i", shown.alias("s"), more.alias("m")).collect()
    assert [(r.s, r.m) for r in sorted(rows)] == [(c[1], c[2]) for c in cases]


def test_numbers(spark):
    rows = column(spark, [r for r, _ in NUMBERS]).select("v", text.parse_number(F.col("v")).alias("got")).collect()
    assert {r.v: r.got for r in rows} == dict(NUMBERS)


def test_categories(spark):
    df = column(spark, [r for r, _ in CATEGORIES]).withColumn("c", classify.categorize(F.col("v")))
    got = df.select("v", F.when(F.coalesce(classify.is_non_wearable(F.col("v"), F.col("c")), F.lit(False)), "-").otherwise(F.col("c")).alias("c")).collect()
    assert {r.v: r.c for r in got} == dict(CATEGORIES)


@pytest.mark.parametrize("key", ["", "a", "x|42", "kesfet|marka:Brand#2"])
def test_fnv(spark, key):
    h = 2166136261
    for c in key:
        h = ((h ^ ord(c)) * 16777619) % 2**32
    assert column(spark, [key]).select(text.fnv1a(F.col("v"))).first()[0] == h


def test_turkish(spark):
    row = column(spark, ["GRİ KAZIK"]).select(text.tr_lower(F.col("v")), text.fold(F.col("v")), text.slugify(F.lit("Köstebek & Çınar’s"))).first()
    assert tuple(row) == ("gri kazık", "gri kazik", "kostebek-and-cinars")


def test_colors(spark):
    rows = column(spark, ["GRİ", "Açık Mavi", "Siyah/Beyaz", "mavisi", "-", None, "xyz"]).select(color.name_to_tags(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == [["gri"], ["mavi"], ["siyah", "beyaz"], ["mavi"], [], [], []]
    rows = column(spark, ["#111111", "f0efea", "#b03030", "#20263a", "nope", None]).select(color.hex_to_tag(F.col("v")).alias("t"), color.tone_class(F.col("v")).alias("n")).collect()
    assert [(r.t, r.n) for r in rows] == [("siyah", 1), ("beyaz", 2), ("kirmizi", 1), ("lacivert", 1), (None, 0), (None, 0)]


def test_genders_and_kids(spark):
    df = spark.createDataFrame(
        [("Erkek Tişört", "TİŞÖRT", ["S"], "X"), ("Kadın Elbise", "ELBİSE", [], "X"), ("Oversize", "TİŞÖRT", ["M", "XL"], "X"), ("Tee", "TİŞÖRT", ["M", "L", "XL"], "X"), ("Mini", "ETEK", [], "X"),
         ("Stray Kids Tee", "TİŞÖRT", [], "X"), ("Kids Tee", "TİŞÖRT", [], "X"), ("Junior Crime Tee", "TİŞÖRT", [], "Junior Crime"), ("Tee", "TİŞÖRT", ["9-10 YAŞ"], "X")],
        "n string, c string, s array<string>, b string",
    )
    rows = df.select(classify.gender_label(classify.detect_genders(F.col("n"), F.col("c"), F.col("s"))).alias("g"), classify.kids_reason(F.col("n"), F.col("s"), F.col("b")).alias("k")).collect()
    assert [r.g for r in rows] == ["ERKEK", "KADIN", "UNISEX", "ERKEK", "KADIN", "UNISEX", "UNISEX", "UNISEX", "UNISEX"]
    assert [r.k for r in rows] == [None, None, None, None, None, None, "name", None, "age"]


def test_styles(spark):
    df = spark.createDataFrame([("Çizgili Basic Tee", "TİŞÖRT", ["basic", "y2k"]), ("Plain Tee", "TİŞÖRT", []), ("Crop Denim", "ÜST", [])], "n string, c string, b array<string>")
    rows = df.select(classify.product_styles(F.col("n"), F.col("c"), F.col("b")).alias("s")).collect()
    assert [r.s for r in rows] == [["y2k", "streetwear"], ["basic"], ["y2k"]]


def test_rules_in_full(spark):
    """Names that only the full lists tell: models, phrases, suffixes, spellings with spaced hyphens."""
    cases = {
        "Yeezy Slide": "AYAKKABI", "T - Shirt": "TİŞÖRT", "slim fiT SHIRT": "GÖMLEK", "kemerli etek": "ETEK", "Patchwork Jean": "JEAN", "Bikini Lines Baskılı Tshirt": "TİŞÖRT",
        "Külotlu Çorap": "ÇORAP", "KOMBİN 238": "TAKIM", "Çift Kombin Tişört": "TİŞÖRT", "Robotik": "DİĞER", "ZIP - UP": "HOODIE", "Gümüş Yüzüğü": "TAKI",
    }
    df = column(spark, list(cases)).withColumn("c", classify.categorize(F.col("v")))
    assert {r.v: r.c for r in df.collect()} == cases
    shoes = {"Air Force 1": True, "Jordan Tee": False, "New Balance 9060": True, "Samba": True, "sambaci": False}
    assert {r.v: r.s for r in column(spark, list(shoes)).withColumn("s", classify.looks_like_shoe(F.col("v"))).collect()} == shoes
    kids = {"Boca Juniors Forma": None, "Juniors Tee": "name", "baby blue tee": None, "Bebek Mavi": None, "Junior Crime Tee": None, "Kid A Tee": None}
    got = column(spark, list(kids)).withColumn("k", classify.kids_reason(F.col("v"), F.array(F.lit("S")), F.lit("Junior Crime")))
    assert {r.v: r.k for r in got.collect()} == kids
