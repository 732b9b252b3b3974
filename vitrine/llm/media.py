"""Media columns: signature sniffing and carving (operator 4).

An Aho-Corasick automaton over magic bytes goes over the stored bytes once.  Each hit is handed to the
format's validator, which confirms structure and lengths; what it confirms gives the true type of a
column's value, whatever type was declared, and the spans of media embedded in other bytes.

Texts become media losslessly: the UTF-8 bytes, padded with bytes 255 to a positive multiple of 576, are
the 8-bit samples of a mono WAVE file.  Reading back goes the other way by sniffing: the validator finds
the data chunk, not a fixed offset.

Defined results: a null text is an empty one and gives one block of padding; equal texts give equal
values; bytes without a confirmed signature have the type "unknown" and no spans; hits that no validator
confirms are ignored; spans are reported by start, an embedded one inside another confirmed one too;
other columns are not touched.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import map_texts

BLOCK = 576
RATE = 8000
DECLARED = "text/plain"


def wave(samples: bytes) -> bytes:
    """A mono 8-bit PCM WAVE file of the samples."""
    pad = b"\0" * (len(samples) & 1)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    data = struct.pack("<4sI", b"data", len(samples)) + samples + pad
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + len(data), b"WAVE") + form + data


def wave_chunks(b: bytes, at: int) -> dict[bytes, tuple[int, int]] | None:
    """(start, length) of each chunk of the RIFF/WAVE file at `at`; None if lengths or structure don't hold."""
    if b[at : at + 4] != b"RIFF" or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    chunks, p = {}, at + 12
    while p + 8 <= end:
        size = int.from_bytes(b[p + 4 : p + 8], "little")
        if p + 8 + size > end:
            return None
        chunks.setdefault(b[p : p + 4], (p + 8, size))
        p += 8 + size + (size & 1)
    return chunks if p == end and chunks.get(b"fmt ", (0, 0))[1] >= 16 and b"data" in chunks else None


def _wave_end(b: bytes, at: int, memo: dict) -> int | None:
    return at + 8 + int.from_bytes(b[at + 4 : at + 8], "little") if wave_chunks(b, at) else None


def _png_end(b: bytes, at: int, memo: dict) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if first and (kind != b"IHDR" or size != 13) or p + 12 + size > len(b):
            return None
        if zlib.crc32(b[p + 4 : p + 8 + size]) != int.from_bytes(b[p + 8 + size : p + 12 + size], "big"):
            return None
        p, first = p + 12 + size, False
        if kind == b"IEND":
            return p
    return None


def _gif_end(b: bytes, at: int, memo: dict) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    # what follows a place depends on the place alone, so what earlier hits found out about it holds
    ends, stops = memo.setdefault("gif", {}), memo.setdefault("gif blocks", {})

    def blocks(p: int) -> int:
        seen = []
        while p < len(b) and b[p] and p not in stops:
            seen.append(p)
            p += 1 + b[p]
        stop = stops.get(p, p + 1)
        stops.update(dict.fromkeys(seen, stop))
        return stop

    seen, end = [], None
    while p < len(b):
        if p in ends:
            end = ends[p]
            break
        seen.append(p)
        if b[p] == 0x3B:
            end = p + 1
            break
        if b[p] == 0x21 and p + 2 <= len(b):
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            local = b[p + 9]
            p = blocks(p + 10 + (3 << (local & 7) + 1 if local & 128 else 0) + 1)
        else:
            break
    ends.update(dict.fromkeys(seen, end))
    return end


def _jpeg_end(b: bytes, at: int, memo: dict) -> int | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2
        size = int.from_bytes(b[p + 2 : p + 4], "big")
        if size < 2:
            return None
        p += 2 + size
        if kind == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return None
    return p + 2 if b[p : p + 2] == b"\xff\xd9" else None


def _bmp_end(b: bytes, at: int, memo: dict) -> int | None:
    if at + 54 > len(b):
        return None
    size, start, header = (int.from_bytes(b[at + k : at + k + 4], "little") for k in (2, 10, 14))
    return at + size if header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size and at + size <= len(b) else None


def _pdf_end(b: bytes, at: int, memo: dict) -> int | None:
    if not b[at + 5 : at + 6].isdigit():
        return None
    for mark in (b"%%EOF", b"startxref"):
        if mark not in memo:
            memo[mark] = [m.start() for m in re.finditer(mark, b)]
    k = bisect.bisect_left(memo[b"%%EOF"], at)
    end = memo[b"%%EOF"][k] if k < len(memo[b"%%EOF"]) else None
    k = bisect.bisect_left(memo[b"startxref"], at)
    return end + 5 if end is not None and k < len(memo[b"startxref"]) and memo[b"startxref"][k] + 9 <= end else None


def _gzip_end(b: bytes, at: int, memo: dict) -> int | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    unpack = zlib.decompressobj(31)
    rest = memoryview(b)[at:]
    try:
        while rest and not unpack.eof:
            unpack.decompress(rest, 1 << 20)
            rest = unpack.unconsumed_tail or (unpack.unused_data and b"")
    except zlib.error:
        return None
    return len(b) - len(unpack.unused_data) if unpack.eof else None


#: Magic bytes, media type, validator (bytes, start, what earlier hits in them found out).
SIGNATURES: list[tuple[bytes, str, Callable[[bytes, int, dict], int | None]]] = [
    (b"RIFF", "audio/wav", _wave_end),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png_end),
    (b"GIF87a", "image/gif", _gif_end),
    (b"GIF89a", "image/gif", _gif_end),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg_end),
    (b"BM", "image/bmp", _bmp_end),
    (b"%PDF-", "application/pdf", _pdf_end),
    (b"\x1f\x8b\x08", "application/gzip", _gzip_end),
]


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(SIGNATURES):
        found.add_word(magic.decode("latin-1"), (k, len(magic)))
    found.make_automaton()
    return found


def sniff(b: bytes) -> list[tuple[int, int, str]]:
    """Every confirmed (start, end, type) in the bytes, by start."""
    out, memo = [], {}
    for last, (k, size) in automaton().iter(b.decode("latin-1")):
        start = last + 1 - size
        end = SIGNATURES[k][2](b, start, memo)
        if end is not None:
            out.append((start, end, SIGNATURES[k][1]))
    return sorted(out)


def media_type(b: bytes) -> str:
    """The type that the bytes themselves show, "unknown" without a confirmed signature at their start."""
    return next((kind for start, _, kind in sniff(b) if start == 0), "unknown")


def embedded(b: bytes) -> list[tuple[int, int, str]]:
    """Confirmed media that start inside the bytes, to be carved as b[start:end]."""
    return [x for x in sniff(b) if x[0] > 0]


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("media", pa.binary())])


def sniff_column(docs: DataFrame, declared_col: str = "declared", id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, declared_type, media_type, corrected, carved array<struct<start,end,type,media>> of a binary column.

    media_type is what the bytes show, or else what declared_col says; corrected: whether they differ (a
    declared null counts as another type); carved: the confirmed media inside the bytes.
    """
    row = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{declared_col}`").alias("declared")).alias("_row"), F.col(f"`{media_col}`").alias("_media"))

    def make():
        def run(values):
            kinds, inside = [], []
            for b in values:
                found = sniff(b or b"")
                kinds.append(next((k for s, _, k in found if s == 0), None))
                inside.append([{"start": s, "end": e, "type": k, "media": b[s:e]} for s, e, k in found if s])
            return {"shown": kinds, "carved": inside}

        return run

    cols = [("shown", "string", pa.string()), ("carved", "array<struct<start:long,end:long,type:string,media:binary>>", pa.list_(SPAN))]
    found = map_texts(row, make, cols, "_row", "_media")
    return found.select(
        F.col("_row.id").alias(id_col),
        F.col("_row.declared").alias("declared_type"),
        F.coalesce("shown", "_row.declared", F.lit("unknown")).alias("media_type"),
        (F.col("shown").isNotNull() & ~F.col("shown").eqNullSafe(F.col("_row.declared"))).alias("corrected"),
        "carved",
    )


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media binary: each text as the samples of a WAVE file."""

    def make():
        def run(texts):
            raw = [(t or "").encode("utf-8", "replace") for t in texts]
            return {"n_bytes": [len(b) for b in raw], "media": [wave(padded(b)) for b in raw]}

        return run

    return map_texts(docs, make, [("n_bytes", "long", pa.int64()), ("media", "binary", pa.binary())], id_col, text_col)


def padded(b: bytes) -> bytes:
    return b + b"\xff" * (BLOCK * max(1, -(-len(b) // BLOCK)) - len(b))


def features(samples: bytes, found: list[tuple[int, int, str]]) -> str:
    """type:rate:samples:mean:energy:zero crossings:embedded, all exact integers."""
    x = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
    energy = int(np.square(x, dtype=np.int64).sum())
    crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    kind = next((k for s, _, k in found if s == 0), "unknown")
    inside = "+".join(f"{k}@{s}-{e}" for s, e, k in found if s) or "-"
    return f"{kind}:{RATE}:{len(x)}:{int(x.sum(dtype=np.int64))}:{energy}:{crossings}:{inside}"


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None) -> DataFrame:
    """Store each text as media, sniff the stored bytes, read the payload back from them and describe both.

    declared: the type that each row's media is said to have (null: none said; default: text, as the column was one);
    media_type is what the bytes show, corrected whether that differs, n_carved how many media are embedded in them.
    """
    said = (F.lit(DECLARED) if declared is None else declared).cast("string")
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), said.alias("declared")).alias("_row"), F.col(f"`{text_col}`").alias("_text"))

    def make():
        def run(texts):
            out = {n: [] for n in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "n_carved")}
            for t in texts:
                raw = (t or "").encode("utf-8", "replace")
                media = wave(padded(raw))
                found = sniff(media)
                kind = next((k for s, _, k in found if s == 0), "unknown")
                start, size = wave_chunks(media, found[0][0])[b"data"]
                payload = media[start : start + size]
                for n, v in zip(
                    out,
                    (
                        len(raw),
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-32:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        features(payload, found),
                        kind,
                        sum(s > 0 for s, _, _ in found),
                    ),
                    strict=True,
                ):
                    out[n].append(v)
            return out

        return run

    long, text = ("long", pa.int64()), ("string", pa.string())
    cols = [
        ("n_bytes", *long),
        ("payload_bytes", *long),
        ("payload_sha256", *text),
        ("tail_crc32", *long),
        ("media_bytes", *long),
        ("media_sha256", *text),
        ("feature", *text),
        ("media_type", *text),
        ("n_carved", *long),
    ]
    found = map_texts(rows, make, cols, "_row", "_text").select(F.col("_row.id").alias(id_col), F.col("_row.declared").alias("declared_type"), *(n for n, *_ in cols))
    return found.withColumn("corrected", (F.col("media_type") != "unknown") & ~F.col("media_type").eqNullSafe(F.col("declared_type")))
