"""Personal data by weak supervision (operator 3).  DataFrame functions only.

Spans are found natively: a pattern's matches are put between marker characters, the text is split at the
markers, and the lengths of the parts give the places.  Four base kinds come straight from their patterns
and checks.  More candidates (secrets, bank accounts, identity and local phone numbers) are judged:

1. labelers vote on every span, base and candidate: strict format (patterns, check digits, lengths), gazetteers
   (top-level domains, calling and area codes, issuers, account countries, key prefixes), words before it
   (context), and variety of its characters;
2. the counts by kind, votes and features, a table whose size does not depend on the corpus, go to the driver,
   where expectation-maximisation estimates each labeler's reliability and a probability for each vote; strict form
   and gazetteer, which know much the same, are one witness with a joint table of outcomes;
3. a logistic span classifier is fitted to those probabilities on kind, votes and features of the span itself
   (length, digits, separators, case, a context word close by), so it can also tell apart spans with equal votes;
   as a column expression it decides, in a second pass over the texts, which candidates are spans too.

Base spans always stay; a candidate that overlaps one is left out.

Defined results: a null text is an empty one, without spans; repeated rows give equal values; without any
candidate the classifier accepts none; other columns are not touched, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, OTHER_MARK = "\ue000", "\ue001"
BLOCK = 512  # even: a part's parity is the same within its block
BASE = ["email", "ip", "card", "phone"]
MORE = ["secret", "iban", "national_id", "local_phone"]
KINDS = BASE + MORE
SPAN = "array<struct<s:int,e:int,v:string,c:string>>"

# Patterns in a form that reads a text once: runs are entered at their start and never given back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = {
    "secret": r"(?<![A-Za-z0-9])(?:[A-Fa-f0-9]{32,64}+|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9A-Za-z+-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: Strict forms by kind; accounts have a length and check digits besides.
STRICT = {
    "email": r"^[A-Za-z0-9][^@]*@.*\.[A-Za-z]{2,}$",
    "ip": r"^(?!0)[0-9]{1,3}(\.[0-9]{1,3}){3}$",
    "card": r"^[3-6]",
    "phone": r"^\+[1-9]",
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|.*[_-].*|A[KS]IA.*)$",
    "iban": r"^[A-Z]{2}[0-9]{2}",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "local_phone": r"^\(?[2-9](?!11)[0-8][0-9][^0-9]{1,2}[2-9](?!11)",
}
#: Top-level domains.
DOMAINS = [
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "mobi", "app", "dev", "online", "site", "shop", "store", "tech", "cloud",
    "ac", "ae", "ar", "at", "au", "be", "bg", "br", "ca", "ch", "cl", "cn", "co", "cz", "de", "dk", "ee", "eg", "es", "eu", "fi", "fr", "gr", "hk", "hr", "hu",
    "id", "ie", "il", "in", "io", "ir", "is", "it", "jp", "kr", "lt", "lu", "lv", "ma", "me", "mx", "my", "nl", "no", "nz", "pe", "ph", "pk", "pl", "pt", "ro",
    "rs", "ru", "sa", "se", "sg", "si", "sk", "th", "tr", "tv", "tw", "ua", "uk", "us", "uy", "ve", "vn", "za",
]
#: Address ranges that networks of their own or well-known services have.
NETWORKS = [r"10\.", r"127\.", r"192\.168\.", r"172\.(?:1[6-9]|2[0-9]|3[01])\.", r"169\.254\.", r"100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.", r"8\.8\.", r"1\.1\.1\.", r"9\.9\.9\."]
#: First digits of card issuers.
ISSUERS = ["4", "5[1-5]", "222[1-9]", "22[3-9]", "2[3-6]", "27[01]", "2720", "34", "37", "36", "38", "30[0-5]", "35(?:2[89]|[3-8])", "6011", "64[4-9]", "65", "62", "50", "5[6-8]"]
#: Calling codes of one and two digits; those of three begin as the last entries say.
CALLING = [
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
    "21[1-8]", "22[0-9]", "23[0-9]", "24[0-9]", "25[0-8]", "26[0-9]", "29[01789]", "35[0-9]", "37[0-9]", "38[0-9]", "42[013]", "50[0-9]", "59[0-9]", "67[0-9]", "68[0-9]",
    "69[0-2]", "85[0-6]", "88[06]", "96[0-8]", "97[0-79]", "99[2-68]",
]
#: Area codes of large regions.
AREAS = [
    "201", "202", "203", "205", "206", "207", "208", "209", "210", "212", "213", "214", "215", "216", "217", "218", "224", "225", "227", "228", "229", "231", "234", "239",
    "240", "248", "251", "252", "253", "254", "256", "260", "262", "267", "269", "270", "276", "281", "301", "302", "303", "304", "305", "307", "308", "309", "310", "312",
    "313", "314", "315", "316", "317", "318", "319", "320", "321", "323", "325", "330", "331", "334", "336", "337", "339", "346", "347", "351", "352", "360", "361", "385",
    "386", "401", "402", "404", "405", "406", "407", "408", "409", "410", "412", "413", "414", "415", "416", "417", "419", "423", "424", "425", "430", "432", "434", "435",
    "440", "443", "469", "470", "475", "478", "479", "480", "501", "502", "503", "504", "505", "507", "508", "509", "510", "512", "513", "514", "515", "516", "517", "518",
    "520", "530", "540", "541", "551", "559", "561", "562", "563", "567", "570", "571", "573", "574", "580", "585", "586", "601", "602", "603", "604", "605", "606", "607",
    "608", "609", "610", "612", "614", "615", "616", "617", "618", "619", "620", "623", "626", "630", "631", "636", "641", "646", "650", "651", "660", "661", "662", "678",
]
#: Account lengths by country.
ACCOUNTS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
#: The gazetteers as patterns, by kind.
KNOWN = {
    "email": rf"(?i)\.(?:{'|'.join(DOMAINS)})$",
    "ip": f"^(?:{'|'.join(NETWORKS)})",
    "card": f"^(?:{'|'.join(ISSUERS)})",
    "phone": rf"^\+(?:{'|'.join(CALLING)})",
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA.*|ASIA.*|gh[opsu]_.*|xox[abprs]-.*)$",
    "iban": f"^(?:{'|'.join(ACCOUNTS)})",
    "national_id": r"^(?!000|666|9|219-09-9999|078-05-1120)",
    "local_phone": rf"^\(?(?:{'|'.join(AREAS)})",
}
CONTEXT = {
    "email": r"e-?mail|write|contact|correo|courriel",
    "ip": r"\bip\b|host|server|address|login",
    "card": r"card|visa|master|pay|karte|carte|tarjeta",
    "phone": r"phone|call|tel|mobile|fax|ruf|appel|llam",
    "secret": r"token|secret|key|passw|pwd|auth|credential",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "national_id": r"ssn|social|security|\bid\b|passport",
    "local_phone": r"phone|call|tel|mobile|fax",
}
LABELERS = 4
FEATURES = ["long", "digits", "separated", "mixed_case", "close"]
CLOSE = 12  # characters


def located(parts: Column) -> Column:
    """The odd parts as array<struct<s,e,v,c>>: place in code points, value, and up to 32 characters before it.

    Block by block, so that appending costs no more than the block's size for each match.
    """

    def step(acc: Column, x: Column) -> Column:
        end = acc.pos + F.length(x)
        span = F.struct(acc.pos.alias("s"), end.alias("e"), x.alias("v"), F.lower(F.substring(acc.prev, -32, 32)).alias("c"))
        return F.struct(
            end.alias("pos"),
            (~acc.odd).alias("odd"),
            x.alias("prev"),
            F.when(acc.odd, F.concat(acc.out, F.array(span))).otherwise(acc.out).alias("out"),
        )

    def block(acc: Column, b: Column) -> Column:
        start = F.struct(acc.pos.alias("pos"), F.lit(False).alias("odd"), acc.prev.alias("prev"), F.array().cast(SPAN).alias("out"))
        inner = F.aggregate(b, start, step)
        return F.struct(inner.pos.alias("pos"), inner.prev.alias("prev"), F.concat(acc.out, F.array(inner.out)).alias("out"))

    count = F.floor((F.size(parts) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count), lambda k: F.slice(parts, k * BLOCK + 1, F.lit(BLOCK)))
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("prev"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.flatten(F.aggregate(blocks, zero, block).out)


def matches(text: Column, pattern: str, worth: Column) -> Column:
    """Leftmost non-overlapping matches of the pattern; worth: a cheap condition that any match needs."""
    marked = F.when(worth, F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}")))
    none = F.array().cast(SPAN)
    return F.when(F.contains(marked, F.lit(MARK)), located(F.split(marked, MARK))).otherwise(none)


def luhn(digits: Column) -> Column:
    def value(d: Column, k: Column) -> Column:
        n = d.cast("int") * (1 + k % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def clean_text(text: Column) -> Column:
    """Null as empty, and the marker replaced where a text has it; lengths stay."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER_MARK)).otherwise(text)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the base kinds: matches that pass their check."""
    digits = text.rlike("[0-9]")
    only = lambda v: F.regexp_replace(v, "[^0-9]", "")
    card = lambda x: F.length(only(x.v)).between(14, 19) & luhn(only(x.v))
    return {
        "email": matches(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(matches(text, IP, digits), lambda x: x.v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": F.filter(matches(text, CARD, digits), card),
        "phone": F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda x: F.length(only(x.v)).between(10, 15)),
    }


def candidate_spans(text: Column) -> Column:
    return matches(text, "|".join(CANDIDATE.values()), text.rlike("[0-9]{2}"))


def kind_of_candidate(v: Column) -> Column:
    """The first candidate kind whose pattern is the whole value."""
    found = F.lit("secret")
    for kind in ("local_phone", "national_id", "iban"):
        found = F.when(v.rlike(f"^(?:{CANDIDATE[kind]})$"), F.lit(kind)).otherwise(found)
    return found


def by_kind(kind: Column, patterns: dict[str, str], value: Column) -> Column:
    found = F.lit(False)
    for name, pattern in patterns.items():
        found = F.when(kind == name, value.rlike(pattern)).otherwise(found)
    return found.cast("int")


def account_holds(v: Column) -> Column:
    """Whether an account has its country's length and its check digits leave 1 by 97."""
    length = F.try_element_at(F.create_map(*[F.lit(x) for pair in ACCOUNTS.items() for x in pair]), F.substring(v, 1, 2))
    moved = F.split(F.concat(F.substring(v, 5, 34), F.substring(v, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(c == "", acc).when(n >= 65, (acc * 100 + n - 55) % 97).otherwise((acc * 10 + n - 48) % 97)

    return F.coalesce(F.length(v) == length, F.lit(False)) & (F.aggregate(moved, F.lit(0), step) == 1)


def votes(kind: Column, x: Column) -> list[Column]:
    """What the labelers say of a span: 1 or 0 each."""
    strict = F.when(kind == "iban", account_holds(x.v).cast("int")).otherwise(by_kind(kind, STRICT, x.v))
    varied = F.size(F.array_distinct(F.split(x.v, ""))) >= 5
    return [strict, by_kind(kind, KNOWN, x.v), by_kind(kind, CONTEXT, x.c), varied.cast("int")]


def features(kind: Column, x: Column) -> list[Column]:
    """What the classifier sees of a span besides its kind and votes: 1 or 0 each, in the order of FEATURES."""
    digits = F.length(F.regexp_replace(x.v, "[^0-9]", ""))
    return [
        (F.length(x.v) >= 20).cast("int"),
        (digits * 10 >= F.length(x.v) * 6).cast("int"),
        x.v.rlike(r"[\x20().-]").cast("int"),
        (x.v.rlike("[a-z]") & x.v.rlike("[A-Z]")).cast("int"),
        by_kind(kind, CONTEXT, F.substring(x.c, -CLOSE, CLOSE)),
    ]


def judged(kind: Column | None, spans: Column, name: str | None = None) -> Column:
    """array<struct<s,k,e,kind,votes,feats>> of spans; k orders kinds."""

    def one(x: Column) -> Column:
        what = F.lit(name) if name else kind_of_candidate(x.v)
        order = F.array_position(F.array(*map(F.lit, KINDS)), what).cast("int")
        return F.struct(x.s.alias("s"), order.alias("k"), x.e.alias("e"), what.alias("kind"), F.array(*votes(what, x)).alias("votes"), F.array(*features(what, x)).alias("feats"))

    return F.transform(spans, one)


@dataclass
class SpanClassifier:
    """Logistic weights by name; reliability: (sensitivity, false-alarm rate) of each labeler, from EM."""

    weights: dict[str, float] = field(default_factory=dict)
    reliability: list[tuple[float, float]] = field(default_factory=list)

    def probability(self, x: Column) -> Column:
        if not self.weights:
            return F.lit(0.0)
        z = F.lit(self.weights["bias"])
        for k in range(LABELERS):
            z = z + x.votes[k] * self.weights[f"vote{k}"]
        for k, name in enumerate(FEATURES):
            z = z + x.feats[k] * self.weights[name]
        for name in KINDS:
            z = z + F.when(x.kind == name, self.weights[name]).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


#: Labelers that look at the same thing are one witness, whose outcomes are judged jointly: form and gazetteer share most of
#: what they know (for secrets one implies the other), so their agreement must not count twice.
WITNESSES = [(0, 1), (2,), (3,)]


def estimate(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 60) -> tuple[dict, list[tuple[float, float]]]:
    """EM for two classes and independent witnesses, a prior by kind; probabilities by entry, (hits, false alarms) by labeler.

    A witness says one of 2 ** k outcomes; their shares in each class begin as if its labelers were independent and
    are re-estimated as a whole, two pseudo-rows of that beginning added.
    """
    kinds = {kind for kind, _ in counts}
    prior = dict.fromkeys(kinds, 0.7)
    start = [{o: math.prod(q if x else 1 - q for x in o) for o in product((0, 1), repeat=len(w))} for q in (0.8, 0.3) for w in WITNESSES]
    shares = [start[: len(WITNESSES)], start[len(WITNESSES) :]]  # of the outcomes, where a span is personal data and where not
    begun = [[dict(t) for t in side] for side in shares]
    said = {v: [tuple(v[k] for k in w) for w in WITNESSES] for _, v in counts}
    p = {}
    for _ in range(rounds):
        for kind, v in counts:
            yes, no = (prior[kind], 1 - prior[kind])
            for w, o in enumerate(said[v]):
                yes, no = yes * shares[0][w][o], no * shares[1][w][o]
            p[kind, v] = yes / (yes + no) if yes + no else 0.5
        for kind in kinds:
            total = sum(n for (q, _), n in counts.items() if q == kind)
            prior[kind] = (sum(n * p[q, v] for (q, v), n in counts.items() if q == kind) + 1.4) / (total + 2)
        for side, weight in enumerate((lambda x: p[x], lambda x: 1 - p[x])):
            whole = sum(n * weight(x) for x, n in counts.items()) + 2
            for w, table in enumerate(shares[side]):
                for o in table:
                    table[o] = (sum(n * weight(x) for x, n in counts.items() if said[x[1]][w] == o) + 2 * begun[side][w][o]) / whole
    of = lambda side, k: sum(share for w, labelers in enumerate(WITNESSES) if k in labelers for o, share in shares[side][w].items() if o[labelers.index(k)])
    return p, [(of(0, k), of(1, k)) for k in range(LABELERS)]


def fit_spans(counts: dict[tuple[str, tuple[int, ...], tuple[int, ...]], int], steps: int = 400, rate: float = 0.5) -> SpanClassifier:
    """EM on votes, then logistic regression on its probabilities, over a table of at most kinds x 2 ** (labelers + features) entries."""
    if not counts:
        return SpanClassifier()
    by_vote: dict[tuple[str, tuple[int, ...]], int] = {}
    for (kind, v, _), n in counts.items():
        by_vote[kind, v] = by_vote.get((kind, v), 0) + n
    p, reliability = estimate(by_vote)
    names = ["bias", *(f"vote{k}" for k in range(LABELERS)), *FEATURES, *KINDS]
    rows = [
        (n, p[kind, v], ["bias", kind, *(f"vote{k}" for k in range(LABELERS) if v[k]), *(name for k, name in enumerate(FEATURES) if f[k])])
        for (kind, v, f), n in sorted(counts.items())
    ]
    weights = dict.fromkeys(names, 0.0)
    total = sum(counts.values())
    for _ in range(steps):
        slope = dict.fromkeys(names, 0.0)
        for n, wanted, active in rows:
            error = 1 / (1 + math.exp(-sum(weights[a] for a in active))) - wanted
            for a in active:
                slope[a] += n / total * error
        for a in names:
            weights[a] -= rate * (slope[a] + 1e-4 * weights[a])
    return SpanClassifier(weights, reliability)


def train(docs: DataFrame, text_col: str = "text") -> SpanClassifier:
    """The first pass: votes on all spans of all texts, counted on the cluster."""
    text = docs.select(clean_text(F.col(text_col)).alias("_t"))
    spans = F.concat(*(judged(None, found, kind) for kind, found in base_spans(F.col("_t")).items()), judged(None, candidate_spans(F.col("_t"))))
    rows = text.select(F.explode(spans).alias("x")).groupBy("x.kind", "x.votes", "x.feats").agg(F.count(F.lit(1)).alias("n"))
    # at most kinds x 2 ** (labelers + features) rows
    return fit_spans({(r["kind"], tuple(r["votes"]), tuple(r["feats"])): r["n"] for r in rows.collect()})


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")


def with_spans(docs: DataFrame, model: SpanClassifier, text_col: str = "text") -> DataFrame:
    """docs with _base and _spans, sorted array<struct<s,k,e,kind,..>> of base and of all spans, and _t, the text they count in."""
    df = docs.withColumn("_t", clean_text(F.col(f"`{text_col}`")))
    base = F.concat(*(judged(None, found, kind) for kind, found in base_spans(F.col("_t")).items()))
    df = df.withColumn("_base", F.array_sort(base)).withColumn("_more", judged(None, candidate_spans(F.col("_t"))))
    overlaps = lambda x: F.exists("_base", lambda b: (b.s < x.e) & (x.s < b.e))
    more = F.filter("_more", lambda x: (model.probability(x) >= 0.5) & ~overlaps(x))
    spans = F.when(F.size("_more") == 0, F.col("_base")).otherwise(F.array_sort(F.concat("_base", more)))
    return df.withColumn("_spans", spans).drop("_more")


def find_pii(docs: DataFrame, model: SpanClassifier | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans: array<struct<kind,start,end>> by start, then kind."""
    model = model or train(docs, text_col)
    found = with_spans(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")), model, "_text")
    plain = lambda c: F.transform(c, lambda x: F.struct(x.kind.alias("kind"), x.s.alias("start"), x.e.alias("end")))
    return found.select(F.col("_id").alias(id_col), plain("_base").alias("base"), plain("_spans").alias("spans"))


def redact(docs: DataFrame, model: SpanClassifier | None = None, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    model = model or train(docs, text_col)
    names = docs.columns
    df = with_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_doc"), F.col(f"`{text_col}`").alias("_text")), model, "_text")

    def step(acc: Column, x: Column) -> Column:
        before = F.substring(F.col("_text"), acc.pos + 1, x.s - acc.pos)
        piece = F.array(before, F.concat(F.lit("["), F.upper(x.kind), F.lit("]")))
        return F.struct(F.greatest(acc.pos, x.e).alias("pos"), F.when(x.s >= acc.pos, F.concat(acc.out, piece)).otherwise(acc.out).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    df = df.withColumn("_cut", F.when(F.size("_spans") > 0, F.aggregate("_spans", zero, step)))
    rest = F.substring(F.col("_text"), F.col("_cut.pos") + 1, F.length("_text"))
    text = F.when(F.col("_cut").isNull(), F.col("_text")).otherwise(F.concat(F.array_join("_cut.out", ""), rest))
    df = df.withColumn("_new", text)
    cols = []
    for c in names:
        col = F.col(f"_doc.`{c}`")
        if c == text_col:
            col = F.col("_new")
        elif c == chars_col:
            kind = dict(docs.dtypes)[c]
            col = F.when(F.col("_cut").isNull(), col).otherwise(F.length("_new").cast(kind))
        cols.append(col.alias(c))
    return df.select(*cols)
