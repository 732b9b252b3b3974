"""The word lists that classify product names.  They are data; other lists can be passed instead.

A rule has words that match anywhere (free) and words that match as whole words only (whole).  Entries are
pieces of regular expressions.
"""

from __future__ import annotations

#: Category rules in order; the first that matches wins: category, free words, whole words.
CATEGORY_RULES: list[tuple[str, list[str], list[str]]] = [
    (
        "AYAKKABI",
        ["ayakkab", "sneaker", "makosen", "loafer", "çizme", "cizme", "terlik", "sandalet"],
        ["bot", "botu", "botlar", "botları", "boot", "boots", "shoe", "shoes", "yeezy", "postal", "postalı", "postallar"],
    ),
    ("SAAT", ["kol saati", "kol saatı"], ["saat", "saati", "watch"]),
    ("ÇANTA", ["çanta", "canta", "backpack", "crossbody", "valiz", "bavul"], ["bag", "bags", "tote", "clutch", "shopper", "suitcase"]),
    ("ŞAPKA", ["şapka", "sapka", "snapback", "trucker", "beanie", "bucket", "balaklava", "balaclava", "kasket"], ["cap", "bere", "hat", "hats"]),
    ("ÇORAP", ["çorap", "çorab", "corap", "corab", "tozluk", "patik"], ["sock", "socks", "crews"]),
    (
        "İÇ GİYİM",
        [
            "boxer", "külot", "kulot", "sütyen", "sutyen", "iç giyim", "ic giyim", "iç çamaşır", "ic camasir", "bikini", "mayo", "pijama",
            "gecelik", "jartiyer", "babydoll",
        ],
        ["brief", "briefs", "thong"],
    ),
    ("GÖZLÜK", ["gözlü", "gozlu", "sunglass", "eyewear"], ["glasses", "shades"]),
    ("CÜZDAN", ["cüzdan", "cuzdan", "kartlık", "kartlik", "card holder", "cardholder"], ["wallet"]),
    ("KEMER", ["harness", "kuşağı", "kusagi"], ["kemer", "kemeri", "kemerler", "kemerleri", "belt", "belts"]),
    (
        "TAKI",
        [
            "kolye", "bileklik", "bilezik", "piercing", "choker", "halhal", "broş", "gerdanlık", "gerdanlik", "yüzüğ", "yuzug", "küpe", "kupe",
            "earring", "hızma", "hizma", "septum", "grillz",
        ],
        ["yüzük", "yuzuk", "zincir", "zinciri", "chain", "takı", "necklace", "bracelet", "pendant", "ring", "rings"],
    ),
    (
        "ATKI / ELDİVEN",
        [
            "eldiven", "boyunluk", "bandana", "kolluk", "kol ısıtıcı", "kol isitici", "bacak ısıtıcı", "bacak isitici", "boyunbağı", "boyunbagi",
        ],
        ["atkı", "atki", "glove", "gloves", "scarf", "şal", "buff"],
    ),
    (
        "AKSESUAR",
        [
            "aksesuar", "accessor", "anahtarl", "keychain", "rozet", "maske", "kılıf", "kilif", "poşet", "çakmak", "sticker", "poster", "kupa",
            "kravat", "papyon", "jartiyer", "duvar örtüsü", "saç band", "sac band", "saç toka", "headband", "peruk", "kolluğu", "hediye seti",
            "kırtasiye", "kirtasiye",
        ],
        ["pin", "mug", "mask", "masks", "taç", "case", "toka", "tokası", "patch", "patchler", "patchleri"],
    ),
    ("MONT", ["parka", "puffer", "şişme", "sisme", "trençkot", "trench", "yağmurluk", "anorak", "polar"], ["mont", "montu", "coat", "kaban"]),
    ("CEKET", ["ceket", "jacket", "bomber", "blazer", "varsity"], []),
    ("YELEK", ["yelek"], ["vest"]),
    ("HIRKA", ["hırka", "hirka", "cardigan"], []),
    ("ELBİSE", ["elbise", "gelinlik", "tulum", "jumpsuit", "salopet"], ["dress"]),
    ("ETEK", ["etekli"], ["etek", "eteği", "etegi", "skirt"]),
    (
        "TAKIM",
        ["takımı", "takimi", "eşofman takım", "ikili takım", "full set", "pijama", "tracksuit"],
        ["takım", "takim", "suit", "set", "seti"],
    ),
    ("HOODIE", ["hoodie", "hoodıe", "hoddie", "kapüşonlu", "kapusonlu", "kapşonlu", "kapsonlu", "zip up", "zip-up", "full zip"], ["hood"]),
    ("SWEATSHIRT", ["sweatshirt", "sweatshırt", "sweathirt", "swetshirt", "crewneck", "crew neck"], ["sweat", "sweati"]),
    ("TRİKO / KAZAK", ["triko", "kazak", "süveter", "suveter", "sweater", "balıkçı", "boğazlı", "bogazli"], ["knit"]),
    ("UZUN KOLLU", ["uzun kollu", "longsleeve", "long sleeve", "long-sleeve", "raglan kollu"], []),
    ("TİŞÖRT", ["tişört", "tisort", "tişort", "t-shirt", "tshirt"], ["t shirt", "tee", "tees"]),
    ("POLO", [], ["polo"]),
    ("FORMA", ["jersey", "maillot"], ["forma", "forması"]),
    ("GÖMLEK", ["gömlek", "gömleğ", "gomlek", "frak"], ["shirt", "shırt", "shirts"]),
    (
        "ATLET / KOLSUZ",
        ["kolsuz", "askılı", "askili", "bralet", "büstiyer", "bustiyer", "tank top", "sleeveless"],
        ["atlet", "atleti", "tank", "halter", "singlet", "bra"],
    ),
    ("KORSE / BODY", ["korse", "corset", "bodysuit", "bustier"], ["body"]),
    (
        "BLUZ",
        [
            "bluz", "blouse", "crop top", "croptop", "kroptop", "pelerin", "kimono", "tunik", "tunic", "off shoulder", "off-shoulder", "düşük omuz",
        ],
        [],
    ),
    ("JEAN", ["jean", "jeans", "jorts", "denim pantolon", "kot pantolon", "denım", "kot alt"], []),
    ("EŞOFMAN ALTI", ["eşofman", "esofman", "sweatpant", "jogger", "jogging", "track pant", "trackpant"], []),
    ("ŞORT", ["bermuda", "şortu", "sortu", "şortolon", "kapri", "capri"], ["şort", "sort", "short", "shorts"]),
    ("TAYT", ["legging"], ["tayt", "taytı"]),
    ("PANTOLON", ["pantolon", "kargo", "cargo", "baggy", "chino", "trouser", "şalvar", "salvar"], ["pant", "pants"]),
    ("TAKIM", [], ["kombin", "kombini", "kombinini"]),
    ("ÜST", ["üst giyim", "cropped"], ["üst", "üstü", "top", "tops", "crop", "croplu"]),
]

#: An outer garment in the name overrides the underwear rule.
OUTER = [
    "tişört", "tisort", "tişort", "t-shirt", "tshirt", "sweatshirt", "sweatshırt", "hoodie", "hoodıe", "eşofman", "esofman", "elbise", "ceket",
    "gömlek", "gomlek", "mont", "hırka", "hirka",
]

#: Goods that nobody wears; tried on names without a category only.
NOT_WORN = [
    "tablo", "kanvas tablo", "perde", "halı", "havlusu", "bardak", "bardağ", "kupa bardağ", "mutfak", "parfüm", "yastık", "nevresim", "mum",
    "mumluk", "vazo", "saksı", "tepsi", "masa örtü", "abajur", "duvar örtüsü", "puzzle", "oyuncak", "defter", "kalemlik", "küllük", "tesbih",
    "poster", "sticker", "magnet", "takvim", "termos", "matara", "plaj örtü", "pareo", "banyo", "bornoz", "taşıma araba", "lamba", "aydınlatma",
    "dekorasyon", "lego", "figür", "figur", "tasma", "şemsiye", "semsiye", "takma tırnak", "saç boyası", "sac boyasi", "boyası 8",
    "runner örtü", "kapı askısı", "biblo", "çerçeve", "halı yıkama", "kadeh", "şarap kadehi", "oje", "kitap", "kitap ayra", "dekor",
    "oda kokusu", "el ısıtıcı", "cep ısıtıcı", "buhurdan", "ayakkabı boyası", "battaniye", "şarj", "sarj", "adaptör", "adaptor", "kablo",
    "ekran koruyucu", "şerit led", "serit led", "led ışık", "led isik", "harita", "bayrağ", "bayrak", "duvar çıkartma", "duvar cikartma",
    "maket", "puzzel",
]

#: Names of shoe models; tried on names without a category only.
SHOE_MODELS = [
    "air ?force", r"\baf1\b", "air ?max", "sb dunk", "dunk (low|high|mid)", r"\bdunk\b", r"air ?jordan\s*\d", r"jordan\s+\d+\s*(low|high|mid|retro)?",
    "blazer mid", "cortez", r"\bvomero\b", "pegasus", r"\bp-?6000\b", r"\btn\b\s*(plus)?",
    r"\bsamba\b", r"\bgazelle\b", "superstar", "stan smith", r"campus\s*(00s|80s)?", "forum (low|mid|high)", r"\bhandball spezial\b",
    r"\bspezial\b", r"\byeezy\b", r"\bozweego\b", r"\badizero\b",
    "new ?balance", r"\b(9060|2002r|1906r|1906a|530|550|327|574|990v?\d?|991|992|993)\b",
    "old ?skool", "knu ?skool", "sk8-?hi", r"\bauthentic\b\s*vans", r"\bvans\b", "chuck taylor", "all ?star", "converse", r"\bone star\b",
    r"\bgel-?(kayano|lyte|nyc|1130|1090)\b", r"\basics\b", r"salomon\s*(xt|acs)", r"\bmargiela tabi\b", r"\btabi\b",
]

#: Gender words; the whole words have ASCII boundaries.
WOMEN = ["kad[ıi]n", "women", "woman", "womens", "female", "ladies", "bayan", "femme", "wmns", "hamile", "anne"]
MEN, MEN_WHOLE = ["erkek", "homme", "menswear", "baba"], ["men", "man", "mens", "men'?s", "male"]
UNISEX, LOOSE = ["unisex", "uniseks"], ["oversize", "boxy", "baggy", "relaxed fit"]

#: The words of styles: free words, whole words.
STYLE_WORDS: dict[str, tuple[list[str], list[str]]] = {
    "pattern": (
        [
            "desen", "baskı", "baski", "çiçekli", "cicekli", "kamuflaj", "kamuflajlı", "leopar", "zebra", "ekose", "çizgili", "cizgili", "puantiye",
            "batik", "kareli", "yıldızlı", "nakış", "nakis", "işleme", "grafik", "tie-dye", "tiedye", "tie dye", "kolaj", "logolu", "yazılı",
            "yazili", "sloganlı",
        ],
        [
            "print", "printed", "graphic", "camo", "floral", "striped", "plaid", "checkered", "tartan", "paisley", "tribal", "embroidered",
            "embroidery", "patchwork", "slogan", "anime", "cartoon",
        ],
    ),
    "plain": (
        ["düz renk", "duz renk", "sade", "minimal", "monokrom"],
        ["plain", "solid", "blank", "basic", "temel", "essential", "essentials", "core"],
    ),
    "minimal": (["minimalist", "minimal"], ["keten", "linen", "poplin", "oxford", "muslin", "monokrom", "clean", "essential"]),
    "tech": (
        ["kargo", "taktik", "teknik", "su geçirmez", "su gecirmez", "rüzgarlık", "ruzgarlik"],
        [
            "cargo", "tactical", "ripstop", "softshell", "waterproof", "windbreaker", "utility", "parachute", "gorpcore", "shell", "tech", "hardshell",
        ],
    ),
    "rave": (
        ["fileli", "transparan", "reflektif", "payet"],
        [
            "simli", "file", "mesh", "latex", "neon", "reflective", "glitter", "rave", "cyber", "holographic", "korse", "corset", "harness", "fishnet",
        ],
    ),
    "sport": (
        ["eşofman", "esofman", "antrenman", "performans", "koşu", "kosu"],
        ["dry-fit", "dryfit", "forma", "jersey", "futbol", "basketbol", "training", "gym", "athletic", "sport", "sports", "running"],
    ),
    "old_money": (["kaşmir", "kasmir", "kaşe", "triko"], ["polo", "blazer", "chino", "cashmere", "merino", "loafer", "knit", "cardigan"]),
    "y2k_strong": (
        [
            "y2k", "2000ler", "2000'ler", "rhinestone", "taşlı", "tasli", "kelebek", "holografik", "metalik", "parlak saten", "düşük bel", "dusuk bel",
            "dantelli kolye ucu",
        ],
        [
            "baggy", "lowrise", "low-rise", "bedazzled", "butterfly", "cyber", "shimmer", "iridescent", "velour", "juicy", "tramp", "halter",
            "babytee", "trucker",
        ],
    ),
    "y2k_free": (["crop", "mini etek", "kısa etek", "kisa etek", "yıldız", "yildiz", "kalp"], []),
    "y2k_whole": ([], ["cropped", "mini", "flare", "bootcut", "cargo", "denim"]),
}

#: Words that make a child's item, words that don't by themselves, and phrases in which none does.
KIDS = [
    "çocuk", "cocuk", "çocuğu", "cocugu", "çocuklu", "çocuklar", "çocukları", "kids", "kids'", "junior", "juniors", "toddler", "infant",
    "newborn", "yenidoğan", "yenidogan", "oğlan", "oglan", "erkek çocuk", "kız çocuk", "kiz cocuk", "bebek giyim", "çocuk giyim",
]
KIDS_WEAK = ["bebek", "bebe", "baby", "babies", "bebegi", "bebeği", "kid", "kid's"]
SLOGANS = [
    r"stray\s*kids", r"kids\s+karma", r"boca\s+juniors", r"kids\s+see\s+ghosts", r"the\s+kids\s+ar[eı]n'?t\s+alright", r"kids\s+in\s+the\s+dark",
    r"all\s+the\s+kids", r"wild\s+kids", r"lost\s+kids", r"rich\s+kids", r"kid\s+cudi", r"kid\s+a\b", r"baby\s+metal", "babymetal", r"cry\s*baby",
    "crybaby", r"baby\s+blue", r"baby\s+pink",
]

#: Search synonyms, one step, as typed; keys and values are folded before use.
SYNONYMS: dict[str, list[str]] = {
    "tshirt": ["tisort", "t-shirt", "tişört"],
    "t-shirt": ["tisort", "tshirt"],
    "tisort": ["tshirt", "t-shirt", "tişört"],
    "tee": ["tisort", "tshirt"],
    "sweat": ["sweatshirt", "sweatshırt"],
    "sweatshirt": ["sweat"],
    "kapsonlu": ["hoodie", "kapusonlu", "kapuson"],
    "kapusonlu": ["hoodie", "kapsonlu"],
    "hoodie": ["kapusonlu", "kapsonlu", "kapuson"],
    "kazak": ["triko", "sweater"],
    "triko": ["kazak", "sweater"],
    "sweater": ["kazak", "triko"],
    "gomlek": ["shirt"],
    "atlet": ["kolsuz", "tank"],
    "kolsuz": ["atlet", "tank"],
    "pantalon": ["pantolon"],
    "pantolon": ["pants", "trousers"],
    "kot": ["jean", "denim"],
    "jean": ["kot", "denim"],
    "denim": ["jean", "kot"],
    "esofman": ["eşofman", "jogger", "sweatpant"],
    "jogger": ["esofman", "sweatpant"],
    "sort": ["şort", "short"],
    "tayt": ["legging"],
    "mont": ["kaban", "parka", "jacket"],
    "kaban": ["mont", "parka"],
    "parka": ["mont", "kaban"],
    "ceket": ["jacket", "blazer"],
    "yelek": ["vest"],
    "canta": ["bag", "çanta"],
    "bag": ["canta", "çanta"],
    "sapka": ["cap", "bere", "şapka"],
    "cap": ["sapka", "şapka"],
    "bere": ["beanie", "sapka"],
    "kemer": ["belt"],
    "corap": ["socks", "çorap"],
    "gozluk": ["glasses", "gözlük"],
    "oversize": ["oversized", "bol"],
    "oversized": ["oversize"],
    "crop": ["cropped", "kisa"],
    "cropped": ["crop"],
    "siyah": ["black"],
    "black": ["siyah"],
    "beyaz": ["white"],
    "white": ["beyaz"],
    "mavi": ["blue"],
    "blue": ["mavi"],
    "yesil": ["green", "yeşil"],
    "green": ["yesil", "yeşil"],
    "kirmizi": ["red", "kırmızı"],
    "red": ["kirmizi", "kırmızı"],
    "gri": ["gray", "grey"],
    "gray": ["gri"],
    "grey": ["gri"],
    "bej": ["beige", "krem", "ekru"],
    "lacivert": ["navy"],
    "navy": ["lacivert"],
}

#: Words that a perk sentence must not end in.
DANGLING = ["ve", "ya", "da", "de", "ile", "veya", "için", "hem", "ayrıca", "olarak", "kadar", "üzeri", "üzerinde"]
