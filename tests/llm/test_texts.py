"""Operators on single texts: personal data, language, media, tokens, packing, toxicity."""

import base64
import bisect
import hashlib
import math
import os
import random
import re
import struct
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from helpers import SCHEMA, documents, texts
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitrine.llm import langid, media, pii, pieces, toxicity
from vitrine.llm.packing import OUTSIDE, default_tokenizer, linear_grouping, pack_documents, token_ids
from vitrine.llm.queries import QUERIES

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
ODD = [
    "a@b.co+x@c.de and x@y.zz.", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.255", "4111 1111 1111 1111 and 5500-0055-5555-5559 79927398713", "+1 (499) 555-6503%%% +49 30 1234567 - +1",
    "😀 é a@b.co  1.1.1.1", "x" * 3000 + "@" + "y" * 300 + ".z", "1" * 5000, "1 " * 3000, "a@b@c.d a@@b.c .@a.b", "+12345678901234567 +1234567890.", "8.8.8.8 " * 700,
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, ["en", "de", None][i % 3], "s", 1, "x", "y", "z") for i, t in enumerate(texts() + ODD)]
    return documents(spark, tmp_path_factory.mktemp("texts"), rows)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return documents(spark, tmp_path_factory.mktemp("none"), [])[0]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or "", re.ASCII):
            v, digits = m.group(), re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def test_pii(docs):
    df, rows = docs
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    for i, t, *_ in rows:
        assert [(x.kind, x.start, x.end) for x in got[i].base] == base_spans(t), t
        assert set(got[i].base) <= set(got[i].spans)


def test_pii_model_and_redaction(spark, empty):
    secret = "ab12" * 10
    rows = [(i, f"token = {secret[:-1]}{i % 10} and a@b.com or call +1 499 555 6503", None, None, 10, "r", "s", "k") for i in range(40)] + [(99, None, None, None, 0, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = pii.train(df)
    assert len(model.reliability) == 4 and model.weights
    got = pii.redact(df, model)
    assert got.columns == SCHEMA.names
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[3].text == "token = [SECRET] and [EMAIL] or call [PHONE]" and by_id[3].n_chars == len(by_id[3].text) and by_id[3]._row == "r"
    assert by_id[99].text is None and by_id[99].n_chars == 0
    assert pii.find_pii(empty).count() == 0 and pii.redact(empty).count() == 0 and pii.train(empty).weights == {}


def iban_ok(v):
    text = "".join(str(int(c, 36)) for c in v[4:] + v[:4])
    return len(v) == pii.ACCOUNTS.get(v[:2]) and int(text) % 97 == 1


def test_pii_accounts(spark):
    """Check digits and lengths natively as by whole numbers."""
    known = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "TR330006100519786457841326"]
    bad = ["DE89370400440532013001", "DE8937040044053201300", "GB82WEST12345698765433", "ZZ82WEST12345698765432", ""]
    df = spark.createDataFrame([(v,) for v in known + bad], "v string").withColumn("ok", pii.account_holds(F.col("v")))
    assert {r.v: r.ok for r in df.collect()} == {v: v in known for v in known + bad} and all(map(iban_ok, known)) and not any(map(iban_ok, bad))


def test_pii_added_spans(spark):
    """Candidates that labelers agree on are added where they stand; those without support, and those over base spans, are not."""
    rng = random.Random(9)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(120):
        rows.append((3 * i, f"secret key: {hexed(40)} and account DE89370400440532013000, ssn 123-45-67{i % 90 + 10}."))
        rows.append((3 * i + 1, f"call 212-555-{1000 + i} or mail user{i}@mail.com, host 10.0.0.{i}"))
        rows.append((3 * i + 2, f"order AB12CDEFGHIJKLMNO{i:03d} of {'7' * 32} and part 000-00-0000 lot 111 111-{1111}"))
    found = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        more = [(x.kind, text[x.start : x.end]) for x in found[i].spans if x not in found[i].base]
        if i % 3 == 0:
            assert [k for k, _ in more] == ["secret", "iban", "national_id"] and more[1][1] == "DE89370400440532013000", more
        elif i % 3 == 1:
            assert [k for k, _ in more] == ["local_phone"], more
        else:
            assert not [k for k, v in more if k in ("iban", "national_id")], more


def test_pii_features_tell_equal_votes_apart():
    """The classifier has weights for features, fitted to EM's probabilities."""
    counts = {("secret", (1, 1, 1, 1), (1, 0, 0, 0, 1)): 50, ("secret", (0, 0, 0, 1), (1, 1, 0, 0, 0)): 50, ("iban", (0, 1, 0, 1), (1, 0, 0, 0, 0)): 20}
    model = pii.fit_spans(counts)
    assert set(pii.FEATURES) <= set(model.weights) and model.weights["close"] > 0 > model.weights["digits"]
    assert len(model.reliability) == pii.LABELERS and all(0 < a < 1 and 0 < b < 1 for a, b in model.reliability)


def naive_phrases(training, text):
    """Longest matches by trying every length."""
    n = at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[at : end + 1] in training:
            end += 1
        at, n = max(end, at + 1), n + 1
    return n


def test_cross_parse_against_naive():
    """Phrase counts, predictions and scores as by plain substring search, over words and chunk edges."""
    rng = random.Random(8)
    sounds = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "keit", "ver"], "cc": ["éau", "tion", "ment", "oi"]}
    say = lambda k, n: " ".join("".join(rng.choice(sounds[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    training = {k: say(k, 60) for k in sounds}
    model = langid.Model(training)
    for k in [*sounds, "aa", "bb"]:
        for n in (1, 3, 40, 400):
            text = say(k, n) + (" " + say("bb", 2) if n == 40 else "") + " x9 ½ ①!"
            body = " " + " ".join(langid.letters(text)) + " "
            counts = [naive_phrases(f" {training[lang]} ", body) for lang in model.langs]
            assert [langid.phrases(a, body) for a in model.automata] == counts
            costs = [c * math.log2(len(training[lang]) + 2) for c, lang in zip(counts, model.langs, strict=True)]
            got = model.predict(text)
            assert got[0] == model.langs[costs.index(min(costs))] and math.isclose(got[1], 1 / sum(2 ** max(min(costs) - c, -1000) for c in costs))
    assert model.predict("½ ① ² Ⅷ 12") == ("und", 0.0, False) and model.predict(None) == ("und", 0.0, False)
    noise = "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(500))
    assert not model.predict(noise)[2] and model.predict(say("aa", 300))[2] and model.predict("ka")[2]


def test_language(spark, docs, empty):
    rng = random.Random(3)
    sounds = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "keit", "ver"], "cc": ["éau", "tion", "ment", "oi"]}
    say = lambda k, n: " ".join("".join(rng.choice(sounds[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, say(k, rng.randint(3, 60)), k) for i in range(300) for k in [list(sounds)[i % 3]]]
    df = spark.createDataFrame([*rows, (1000, None, "aa"), (1001, "12 !! 3", "bb"), (None, "kato miru", "aa")], "doc_id long, text string, lang string")
    out = langid.held_out("doc_id", 3, 1)
    got = langid.predict_language(df, langid.training_text(df, ~out)).withColumn("held_out", out).collect()
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    truth = {i: k for i, _, k in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (1000, 1001)} == {1000: ("und", 0.0), 1001: ("und", 0.0)}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert langid.training_text(empty, ~out) == {} and langid.predict_language(empty, {}).count() == 0
    assert {r.lang_pred for r in langid.predict_language(df, {}).collect()} == {"und"}
    df, rows = docs
    model = langid.Model({"en": "the cat", "de": "der hund"})
    kept = langid.keep_identified(df, {"en": "the cat", "de": "der hund"})
    assert kept.columns == SCHEMA.names
    want = sorted((str(i), lang or model.predict(t)[0]) for i, t, lang, *_ in rows if model.predict(t)[2])
    assert sorted((str(r.doc_id), r.lang) for r in kept.collect()) == want and 0 < len(want) < len(rows)


def test_training_learns_whole_texts(spark):
    """The body after a long header is learned, and copies of a text are one text of the sample."""
    header = "licence terms " * 100
    rows = [(i, header + f"korpus{'abcdefghij'[i]}", "aa") for i in range(10)] + [(i, "kopya metin", "bb") for i in range(10, 90)] + [(90, "12 !!", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_text(df, F.lit(True))
    assert "korpus" in got["aa"] and all(w in " ".join(header.split()) or w.startswith("korpus") for w in got["aa"].split())
    assert got["bb"] == "kopya metin"
    one = langid.training_text(df, F.lit(True), enough_chars=1)["aa"].split()
    assert len(one) == 201 and one[-1].startswith("korpus")


def test_nothing_learned_keeps_letters(docs):
    df, rows = docs
    assert langid.keep_identified(df, {}).count() == sum(any(c.isalpha() for c in t or "") for _, t, *_ in rows)


def test_suffix_automaton():
    start = langid.suffix_automaton("abracadabra")
    assert langid.phrases(start, "abra") == 1 and langid.phrases(start, "abraabra") == 2 and langid.phrases(start, "zzab") == 3 and langid.phrases(start, "") == 0


def test_media(docs, empty):
    df, rows = docs
    got = {r.doc_id: r for r in media.media_digests(df).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        want = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        stored = media.wave(want)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and r.feature.startswith("audio/wav:8000:")
    assert media.media_digests(empty).count() == 0


def test_sniffing(spark):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = base64.b64decode("R0lGODlhAQABAIAAAAAAAP///yH5BAEAAAAALAAAAAABAAEAAAIBRAA7")
    wav = media.wave(b"\x80" * 576)
    assert [media.media_type(b) for b in (png, gif, wav, b"", b"GIF89a", png[:-4], b"RIFFxxxxWAVE")] == ["image/png", "image/gif", "audio/wav", *["unknown"] * 4]
    zipped = zlib.compressobj(wbits=31)
    packed = zipped.compress(b"hello") + zipped.flush()
    mixed = b"some text" + png + b"GIF89a no" + gif + packed
    assert [(mixed[a:b], k) for a, b, k in media.embedded(mixed)] == [(png, "image/png"), (gif, "image/gif"), (packed, "application/gzip")]
    cells = [(1, "image/png", bytearray(gif)), (2, "image/png", None), (3, None, bytearray(b"x" + png)), (4, "image/gif", bytearray(gif)), (5, None, bytearray(gif + packed))]
    got = {r.doc_id: r for r in media.sniff_column(spark.createDataFrame(cells, "doc_id long, declared string, media binary")).collect()}
    assert {i: (r.declared_type, r.media_type, r.corrected) for i, r in got.items()} == {
        1: ("image/png", "image/gif", True), 2: ("image/png", "image/png", False), 3: (None, "unknown", False), 4: ("image/gif", "image/gif", False), 5: (None, "image/gif", True),
    }
    assert [(x.start, x.end, x.type, bytes(x.media)) for x in got[3].carved] == [(1, 1 + len(png), "image/png", png)]
    assert [(x.type, bytes(x.media)) for x in got[5].carved] == [("application/gzip", packed)]


def test_feature_string(docs):
    """The digest query's feature string, type and carving by plain loops."""
    df, rows = docs
    for r in media.media_digests(df).collect():
        samples = [b - 128 for b in media.padded(((dict((x[0], x[1]) for x in rows)[r.doc_id]) or "").encode())]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
        kind, rate, n, mean, energy, crossed, _ = r.feature.split(":", 6)
        assert (kind, int(rate), int(n), int(mean), int(energy), int(crossed)) == ("audio/wav", 8000, len(samples), sum(samples), sum(x * x for x in samples), crossings)
        assert (r.declared_type, r.media_type, r.corrected, r.n_carved) == ("text/plain", "audio/wav", True, 0)


@pytest.mark.parametrize("hit", [b"%PDF-1", b"GIF89a!!,,", b"GIF89a" + b"\0" * 7 + b"!\xfe\x01", b"BM", b"RIFF", b"\x1f\x8b\x08"])
def test_many_signatures_take_linear_time(hit):
    """Twice the hits take no more than some four times as long."""

    def seconds(n):
        start = time.perf_counter()
        media.sniff(hit * n)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(80_000) < 4 * seconds(40_000) + 0.5


def test_pdf_ends():
    one = b"%PDF-1.4 x startxref 5 %%EOF"
    both = b"a" + one + b"%PDF-1.7 no reference %%EOF" + one
    assert media.sniff(both) == [(1, 1 + len(one), "application/pdf"), (len(both) - len(one), len(both), "application/pdf")]


PIECES = ["", "  a  b ", "a\n\n b", "   ", "▁x ▁▁y", " " * 40 + "a" + " " * 31, "日本語 ﬁ \x00 z", "😀😀 a😀b", "<s> </s> <0x0A> <unk>", "x" * 500, "\ta\tb", "\xa0 x", None]


def test_pieces(spark, docs, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rows = [(i, t) for i, t in enumerate(PIECES + texts() + ODD)]
    got = {r.doc_id: r for r in pieces.encode_decode(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = model.encode(t or "")
        assert (got[i].ids, got[i].decoded) == (want, model.decode(want)), t
    assert pieces.encode_decode(empty).count() == 0


def brute_count(vocab, text):
    """Best segmentation of the whole normalised text: later starts come first, only a better score replaces."""
    s = pieces.SPACE + text.replace(" ", pieces.SPACE) if text else ""
    best = [(0, 0)] + [None] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - 48), end):
            i = vocab.ids.get(s[start:end])
            if i is not None:
                cost, n = vocab.score[i], 1
            elif end - start == 1:
                cost, n = vocab.min_score - 10, len(s[start].encode())
            else:
                continue
            got = best[start][0] + cost
            if best[end] is None or got > best[end][0]:
                best[end] = (got, best[start][1] + n)
    return best[-1][1], best[-1][0]


def test_token_counts(spark, empty):
    vocab = pieces.vocabulary(pieces.default_model())
    rows = [(i, t) for i, t in enumerate(PIECES + texts())]
    got = {r.doc_id: (r.n_tokens, r.score) for r in pieces.count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute_count(vocab, t or "") for i, t in rows}
    assert pieces.count_tokens(empty).count() == 0


def best_fit_decreasing(lengths):
    rooms, n = [], 0
    for s in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, s)
        if at == len(rooms):
            n, room = n + 1, 1024
        else:
            room = rooms.pop(at)
        bisect.insort(rooms, room - s)
    return n


def test_token_ids_of_long_runs():
    """Runs that the rank library cannot match go to the tokenizer; every Unicode class that ranks are used for gives the same ids."""
    ids = token_ids(default_tokenizer())
    for run in (" " * 2_000_000, "a" * 300_000, "1" * 300_000):
        assert len(ids(run)) > 0 and np.frombuffer(ids(run), "<u4").tolist() == ids.tokenizer.encode(run, add_special_tokens=False).ids
    chars = [chr(c) for c in range(0x20, 0x2070) if not OUTSIDE.search(chr(c))]
    classes = defaultdict(list)
    for c in chars:
        classes[unicodedata.category(c)].append(c)
    for some in classes.values():
        for text in ("".join(some), " ".join(some), "a".join(some), "1 ".join(some), "\n".join(some)):
            assert np.frombuffer(ids(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_no_more_sequences_than_best_fit(name):
    """On the lengths of whole tables, the grouping with its default parameters."""
    path = f"/root/testdata/{name}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the test tables")
    ids, lengths = token_ids(default_tokenizer()), []
    for text in pq.read_table(path, columns=["text"]).column(0).to_pylist():
        n = len(ids(text)) // 4 + 1
        lengths += [1024] * (n // 1024) + [n % 1024] * (n % 1024 > 0)
    assert sum(k for _, k in linear_grouping(Counter(lengths), 1024, 4096, 256)) <= best_fit_decreasing(lengths)


def test_packing(docs, empty):
    df, rows = docs
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, places = defaultdict(list), defaultdict(list)
    for r in pack_documents(df).collect():
        got[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, t, *_ in rows:
        ids, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(got[i], key=lambda r: r.piece)):
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(part)) and (r.length == 1024 or k == 0)
            at += r.length
        assert at == len(ids)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(n for spans in places.values() for _, n in spans)
    assert len(places) <= best_fit_decreasing([n for spans in places.values() for _, n in spans]) <= 1.05 * total / 1024 + 2
    assert pack_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_linear_grouping(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 1024): rng.randint(1, 50) for _ in range(rng.choice([1, 5, 200]))}
    classes = linear_grouping(counts, 1024, rng.choice([4, 256]), 64)
    used = defaultdict(int)
    for config, n in classes:
        assert sum(config) <= 1024 and n > 0
        for length in config:
            used[length] += n
    assert dict(used) == counts


def test_toxicity(spark, empty):
    rng = random.Random(1)
    words = ["".join(rng.choice(["an", "er", "th", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        body = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        if toxic:
            body[rng.randrange(len(body))] = rng.choice(["vermin", "V3RMIN!!", "wretch"])
            body[rng.randrange(len(body))] = "wretches"
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (7777, None)], "doc_id long, toxic int")
    out = langid.held_out("doc_id", 5, 0)
    got = toxicity.fit_toxicity(df, known.filter(~out), trees=5).score(df).withColumn("held_out", out).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(rows) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    one = known.filter("toxic = 0")
    assert {r.score for r in toxicity.fit_toxicity(df, one).score(df).collect()} == {0.0}
    assert toxicity.fit_toxicity(empty, one).score(empty).count() == 0


def test_stems():
    assert [toxicity.stem_of(w) for w in ("1d10t", "Idiot!!", "id-iot", "2024", "$cum")] == ["idiot", "idiot", "idiot", "", "scum"]


def plain_features(text, lexicon):
    """The features word by word, without packing or caches."""
    words = (text or "").split()
    n = max(1, len(words))
    sums = defaultdict(float)
    hits, you = [], []
    for at, word in enumerate(words):
        stem = toxicity.stem_of(word)
        weights = [lexicon[stem[:k]] for k in range(4, 9) if len(stem) >= k and stem[:k] in lexicon] if len(stem) >= 4 else [lexicon.get(f"{stem}$", 0.0)]
        w = max(weights, default=0.0)
        letters = "".join(c for c in word if c.isalpha())
        sums["strong"] += w >= 3
        sums["weak"] += 0 < w < 3
        sums["weight"] += round(1000 * w) / 1000
        sums["capitals"] += sum(c.isupper() for c in letters)
        sums["shouted"] += len(letters) > 2 and letters.isupper()
        sums["punctuation"] += len(word) - len(letters)
        sums["exclaimed"] += word.count("!")
        sums["disguised"] += w > 0 and stem != letters.lower()
        sums["second_person"] += stem in toxicity.SECOND_PERSON
        hits += [at] if w > 0 else []
        you += [at] if stem in toxicity.SECOND_PERSON else []
    rates = {k: v / n for k, v in sums.items()}
    near = 1 / (1 + min(abs(a - b) for a in hits for b in you)) if hits and you else 0.0
    best = sums["weight"] / max(1, sums["strong"] + sums["weak"])
    return [rates.get(k, 0.0) if k not in ("best", "nearness", "log_words") else {"best": best, "nearness": near, "log_words": math.log1p(len(words))}[k] for k in toxicity.FEATURES]


def test_toxicity_against_plain_loops(spark):
    """Features by words, the trees' sum, and the isotonic steps by interpolation."""
    rng = random.Random(2)
    words = ["stone", "river", "you", "your", "tree", "WALK", "low", "id", "du"]
    rows, labels = [], []
    for i in range(600):
        body = [rng.choice(words) for _ in range(rng.randint(1, 40))]
        if i % 2:
            body[rng.randrange(len(body))] = rng.choice(["vermin", "V3RMIN!!", "zap", "Zap!"])
        rows.append((i, " ".join(body)))
        labels.append((i, i % 2))
    rows += [(1000, None), (1001, ""), (1002, "zap you"), (1003, "V3rm1n's! YOU?")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"), trees=4)
    assert "zap$" in model.lexicon and any(k.startswith("verm") for k in model.lexicon)
    made = {r.doc_id: [r[n] for n in toxicity.FEATURES] for r in toxicity.feature_rows(df, model.lexicon).collect()}
    for i, t in rows:
        assert np.allclose(made[i], plain_features(t, model.lexicon), atol=1e-9), t
    raw = {r.doc_id: r._raw for r in model.raw(toxicity.feature_rows(df, model.lexicon)).collect()}
    x, y = model.calibration.boundaries.toArray(), model.calibration.predictions.toArray()
    scores = {r.doc_id: (r.score, r.predicted) for r in model.score(df).collect()}
    for i, _ in rows[:40] + rows[-4:]:
        margin = sum(w * t.predict(Vectors.dense(made[i])) for w, t in zip(model.trees.treeWeights, model.trees.trees, strict=True))
        assert math.isclose(raw[i], 1 / (1 + math.exp(-2 * margin)), abs_tol=1e-9)
        assert math.isclose(scores[i][0], min(1.0, max(0.0, float(np.interp(raw[i], x, y)))), abs_tol=1e-9) and scores[i][1] == (scores[i][0] >= 0.5)


def test_toxicity_contradictions_and_no_lexicon(spark):
    """An id with both labels counts as toxic, whatever the order of rows; capitals alone can tell where no word does."""
    rng = random.Random(4)
    text = lambda i: " ".join(w.upper() if i % 2 else w for w in (rng.choice(["stone", "river", "tree", "walk"]) for _ in range(20)))
    df = spark.createDataFrame([(i, text(i)) for i in range(400)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(400)]
    both = [(i, 0) for i in range(1, 400, 8)]
    scores = []
    for rows in (labels + both, both + labels):
        model = toxicity.fit_toxicity(df, spark.createDataFrame(rows, "doc_id long, toxic int"), trees=3)
        assert model.lexicon == {} and model.trees is not None
        scores.append({r.doc_id: (r.score, r.predicted) for r in model.score(df).collect()})
    assert scores[0] == scores[1] and all(p == i % 2 for i, (_, p) in scores[0].items())


def test_queries_return_their_contract(spark, tmp_path, docs):
    """Every registered query on a fixture written as tables: one row a document, the contract's columns first."""
    df, rows = docs
    df.write.parquet(f"{tmp_path}/documents.parquet")
    known = [(i, i % 2) for i, *_ in rows if i is not None]
    spark.createDataFrame(known, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = {
        "op1_ngram_join": ["doc_id", "class_id", "n_links", "n_copies"],
        "op2_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op3_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op4_media_columns": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        "op5_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op7_token_counts": ["doc_id", "n_tokens", "score"],
        "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op9_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
        "op10_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op11_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    }
    for name, wanted in columns.items():
        got = QUERIES[name](spark, str(tmp_path))
        assert set(wanted) <= set(got.columns), name
        assert Counter(r.doc_id for r in got.collect()) == Counter(i for i, *_ in rows), name
    packed = QUERIES["op6_best_fit_packing"](spark, str(tmp_path))
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and {r.doc_id for r in packed.collect()} == {i for i, *_ in rows}
    other_tables = {"op12_ranked_search", "op13_conversation_repair"}  # in test_layout
    assert set(QUERIES) == {*columns, "op6_best_fit_packing", *other_tables}


def test_declared_types_of_a_column(spark, tmp_path):
    """Right, wrong and missing declarations; the same text has the same values wherever it stands."""
    df, _ = documents(spark, tmp_path)
    said = F.when(F.col("doc_id") % 3 == 0, "audio/wav").when(F.col("doc_id") % 3 == 1, "image/png")
    for r in media.media_digests(df, declared=said).collect():
        want = None if r.doc_id is None or r.doc_id % 3 == 2 else "audio/wav" if r.doc_id % 3 == 0 else "image/png"
        assert (r.declared_type, r.media_type, r.corrected) == (want, "audio/wav", want != "audio/wav")


def test_reliabilities_by_plain_loops():
    """Expectation-maximisation row by row, over the same witnesses; labelers that copy each other count once."""
    import itertools


    rng = random.Random(2)
    rows = []
    for _ in range(500):
        true = rng.random() < 0.6
        flip = lambda hit, alarm: int(rng.random() < (hit if true else alarm))  # noqa: E731, B023
        form = flip(0.9, 0.3)
        rows.append((rng.choice(["secret", "iban"]), (form, form if rng.random() < 0.95 else 1 - form, flip(0.7, 0.2), flip(0.95, 0.5))))
    groups = [(0, 1), (2,), (3,)]
    begin = {(side, g, o): math.prod(q if x else 1 - q for x in o) for side, q in ((1, 0.8), (0, 0.3)) for g in groups for o in itertools.product((0, 1), repeat=len(g))}
    share, prior = dict(begin), {"secret": 0.7, "iban": 0.7}
    for _ in range(60):
        belief = []
        for kind, v in rows:
            like = {side: (prior[kind] if side else 1 - prior[kind]) * math.prod(share[side, g, tuple(v[k] for k in g)] for g in groups) for side in (0, 1)}
            belief.append(like[1] / (like[0] + like[1]))
        for kind in prior:
            mine = [b for b, r in zip(belief, rows, strict=True) if r[0] == kind]
            prior[kind] = (sum(mine) + 1.4) / (len(mine) + 2)
        for side, g, o in begin:
            weights = [b if side else 1 - b for b in belief]
            met = sum(w for w, r in zip(weights, rows, strict=True) if tuple(r[1][k] for k in g) == o)
            share[side, g, o] = (met + 2 * begin[side, g, o]) / (sum(weights) + 2)
    p, reliability = pii.estimate(Counter(rows))
    assert all(abs(p[r] - b) < 1e-9 for r, b in zip(rows, belief, strict=True))
    for k, (hit, alarm) in enumerate(reliability):
        g = next(g for g in groups if k in g)
        for side, got in ((1, hit), (0, alarm)):
            assert abs(got - sum(x for (s, h, o), x in share.items() if s == side and h == g and o[g.index(k)])) < 1e-9


def test_runs_of_spaces_meet_the_prefix_table(monkeypatch):
    """Words behind any number of spaces have the library's ids, by the table alone once pairs are known."""
    rng = random.Random(12)
    vocab = pieces.Vocabulary(pieces.default_model())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    some = [p for p in list(vocab.ids)[::97] if pieces.SPACE not in p]
    words = [" " * rng.randint(0, 70) + "".join(rng.choice(some) for _ in range(rng.randint(0, 4))) + rng.choice(["", "é", "日", "😀"]) for _ in range(1500)]
    words += [" " * k for k in range(1, 300)] + ["a" + " " * k + "b" for k in range(1, 60)]
    for w in words:
        assert [i for x in pieces.words_of(w) for i in vocab.encode_word(pieces.whole(x))] == library.encode(w), repr(w)
    seen = []
    merge = vocab.merge
    monkeypatch.setattr(vocab, "merge", lambda w: seen.append(w) or merge(w))
    for w in words:
        for x in pieces.words_of(w):
            vocab.encode_word(pieces.whole(x))
    assert not seen
