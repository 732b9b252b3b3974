"""Colour families and dominant colour of images given as raw square RGB rasters, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.color import FAMILIES

NEUTRAL = ("siyah", "beyaz", "gri", "bej")
#: Least share of a family, most tags, share and number of families that make a pattern, pale saturation.
MIN_SHARE, MAX_TAGS, MULTI_SHARE, MULTI_FAMILIES, PALE = 0.12, 3, 0.1, 3, 0.2
KEYS = list(FAMILIES)


def hsl(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue, saturation and lightness of rows of red, green and blue."""
    c = rgb / 255
    high, low = c.max(1), c.min(1)
    d, light = high - low, (high + low) / 2
    safe = np.where(d == 0, 1, d)
    sat = np.where(d == 0, 0, np.where(light > 0.5, d / np.maximum(2 - high - low, 1e-12), d / np.maximum(high + low, 1e-12)))
    r, g, b = c.T
    hue = np.select([high == r, high == g], [(g - b) / safe + np.where(g < b, 6, 0), (b - r) / safe + 2], (r - g) / safe + 4) * 60
    return np.where(d == 0, 0, hue), sat, light


def families(rgb: np.ndarray) -> np.ndarray:
    """Index of each colour's family, by the same decisions as rgb_to_tag."""
    h, s, v = hsl(rgb)
    grey, red = s < 0.12, (h < 15) | (h >= 345)
    tests = [
        (v <= 0.14, "siyah"), (grey & (v >= 0.86), "beyaz"), (grey & (v >= 0.6) & (h >= 20) & (h <= 70) & (s >= 0.05), "bej"), (grey & (v <= 0.2), "siyah"), (grey, "gri"),
        ((v >= 0.9) & (s < 0.25), "beyaz"), ((h >= 15) & (h < 50) & (s < 0.45) & (v < 0.42), "kahverengi"), ((h >= 15) & (h < 50) & (s < 0.45), "bej"),
        ((h >= 15) & (h < 45) & (v < 0.3), "kahverengi"), (red & (v < 0.3), "bordo"), (red & (v > 0.65) & (s < 0.5), "pembe"), (red, "kirmizi"), (h < 45, "turuncu"), (h < 70, "sari"),
        (h < 170, "yesil"), ((h < 255) & (v < 0.28), "lacivert"), (h < 255, "mavi"), (h < 290, "mor"), ((v > 0.6) | (s < 0.5), "pembe"),
    ]
    return np.select([t for t, _ in tests], [KEYS.index(k) for _, k in tests], KEYS.index("mor"))


def square(raster: bytes) -> np.ndarray | None:
    side = int(round((len(raster) / 3) ** 0.5)) if raster else 0
    return np.frombuffer(raster, np.uint8).reshape(side, side, 3).astype(float) if side >= 8 and side * side * 3 == len(raster) else None


def shares(raster: bytes) -> dict[str, float]:
    """Share of each family among the pixels of the inner part that are neither background nor skin."""
    px = square(raster)
    if px is None:
        return {}
    n = len(px)
    edge = np.ones((n, n), bool)
    edge[2:-2, 2:-2] = False
    ground = px[edge].mean(0)
    lo, hi = int(n * 0.12), -(-n * 88 // 100)
    inner = px[lo:hi, lo:hi].reshape(-1, 3)
    r, g, b = inner.T
    near = (np.abs(inner - ground) < 26).all(1)
    skin = (r > 95) & (g > 40) & (b > 20) & (r > g) & (g > b) & (r - b > 15) & (r - g < 80)
    kept = inner[~near & ~skin]
    if len(kept) < len(inner) * 0.08:
        return {}
    tag = families(kept)
    _, sat, _ = hsl(kept)
    pale = (sat < PALE) & ~np.isin(tag, [KEYS.index(k) for k in NEUTRAL])
    level = np.floor(kept[pale].mean(1) + 0.5)
    tag[pale] = families(np.repeat(level[:, None], 3, 1))
    counts = np.bincount(tag, minlength=len(KEYS))
    return {KEYS[k]: c / len(kept) for k, c in enumerate(counts.tolist()) if c}


def tags(found: dict[str, float]) -> list[str]:
    """Families above the least share, neutrals counted as one; several real colours side by side are a pattern."""
    bright = {k: s for k, s in found.items() if k not in NEUTRAL}
    plain = {k: s for k, s in found.items() if k in NEUTRAL}
    merged = dict(bright)
    if plain:
        merged[max(plain, key=plain.get)] = sum(plain.values())
    order = sorted(merged, key=lambda k: -merged[k])
    out = [k for k in order if merged[k] >= MIN_SHARE][:MAX_TAGS] or order[:1]
    if sum(s >= MULTI_SHARE for s in bright.values()) >= MULTI_FAMILIES:
        out.append("cok-renkli")
    return out


def dominant(raster: bytes) -> str | None:
    """The mean of the fullest 4-bit bucket that is not skin; the background where nothing stands out from it."""
    px = square(raster)
    if px is None:
        return None
    n = len(px)
    edge = np.ones((n, n), bool)
    edge[1:-1, 1:-1] = False
    ground = px[edge].mean(0)
    lo, hi = int(n * 0.15), -(-n * 85 // 100)
    inner = px[lo:hi, lo:hi].reshape(-1, 3)
    far = np.abs(inner - ground).sum(1) >= 40
    as_hex = lambda c: "#" + "".join(f"{int(np.floor(x + 0.5)):02x}" for x in c)
    if not far.any():
        return as_hex(ground)
    rows = inner[far]
    key = (rows.astype(int) >> 4) @ np.array([256, 16, 1])
    buckets, first, inverse, size = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    means = np.stack([np.bincount(inverse, rows[:, k], len(buckets)) / size for k in range(3)], 1)
    r, g, b = means.T
    high, low = means.max(1), means.min(1)
    sat = (high - low) / np.maximum(high, 1)
    skin = (high >= 60) & (high <= 245) & (r > g) & (g > b) & (sat >= 0.12) & (sat <= 0.5)
    order = np.lexsort((first, -size))
    pick = next((k for k in order if not skin[k]), order[0])
    if (~far).mean() > 0.25 and np.abs(means[pick] - ground).sum() < 90:
        return as_hex(ground)
    return as_hex(means[pick])


@F.pandas_udf(T.ArrayType(T.StringType()))
def color_tags(rasters: pd.Series) -> pd.Series:
    """Colour families of each raster."""
    return rasters.map(lambda b: tags(shares(b)))


@F.pandas_udf(T.StringType())
def dominant_color(rasters: pd.Series) -> pd.Series:
    return rasters.map(dominant)
