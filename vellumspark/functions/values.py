"""Hashes, ids, JSON cells, colours and rectangles (H-1..H-10, GEO-1..GEO-2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(document: Column, version: Column, index: Column, content: Column) -> Column:
    """H-1: SHA-256 over the parts with NULs between."""
    return F.sha2(F.concat_ws("\0", document.cast("string"), version.cast("string"), index.cast("string"), content), 256)


def cache_key(*parts: Column) -> Column:
    """H-2, H-3: SHA-256 of the parts as JSON."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def clean_list(c: Column) -> Column:
    """H-18, U-5: trimmed, non-empty, distinct texts in their first order."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))


def millis(c: Column) -> Column:
    """H-7, H-8: epoch milliseconds of a timestamp text; 0 if it is none."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(c)), F.lit(0))


def clamp(c: Column, low, high) -> Column:
    """H-9."""
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def cell(c: Column, flags=("green", "yellow", "red", "grey")) -> Column:
    """H-5: struct(summary, flag, reasoning) from a cell's JSON; text that is no JSON is the summary; unknown flags are grey."""
    j = F.from_json(c, "summary string, value string, flag string, reasoning string")
    ok = F.coalesce(j["summary"], j["value"])
    flag = F.when(j["flag"].isin(*flags), j["flag"]).otherwise("grey")
    return F.struct(F.coalesce(ok, c).alias("summary"), flag.alias("flag"), F.coalesce(j["reasoning"], F.lit("")).alias("reasoning"))


def rgb(c: Column) -> tuple[Column, Column, Column]:
    t = F.trim(c)
    h = F.when(t.rlike("^#[0-9A-Fa-f]{6}$"), F.substring(t, 2, 6))
    return tuple(F.conv(F.substring(h, i, 2), 16, 10).cast("int") for i in (1, 3, 5))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def color_family(c: Column) -> Column:
    """H-10: family of a #rrggbb colour by hue, saturation and lightness; null if it is none."""
    r, g, b = (x / 255.0 for x in rgb(c))

    def spread(x: Column) -> Column:
        hi, lo = F.greatest(x["r"], x["g"], x["b"]), F.least(x["r"], x["g"], x["b"])
        return F.struct(x["r"].alias("r"), x["g"].alias("g"), x["b"].alias("b"), hi.alias("hi"), (hi - lo).alias("d"), ((hi + lo) / 2).alias("light"))

    def hued(x: Column) -> Column:
        d = x["d"]
        sat = F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(2 * x["light"] - 1)))
        hue = F.when(d == 0, 0.0).when(x["hi"] == x["r"], 60 * (((x["g"] - x["b"]) / d + 6) % 6)).when(x["hi"] == x["g"], 60 * ((x["b"] - x["r"]) / d + 2)).otherwise(60 * ((x["r"] - x["g"]) / d + 4))
        return F.struct(sat.alias("sat"), hue.alias("hue"), x["light"].alias("light"), x["r"].alias("r"))

    def named(x: Column) -> Column:
        hue, sat, light = x["hue"], x["sat"] * 100, x["light"] * 100
        return (
            F.when(x["r"].isNull(), F.lit(None).cast("string")).when((sat <= 12) | (light <= 4) | (light >= 98), "gray")
            .when((hue < 15) | (hue >= 345), "red").when(hue < 45, "orange").when(hue < 75, "yellow").when(hue < 165, "green")
            .when(hue < 255, "blue").when(hue < 290, "purple").otherwise("pink")
        )

    return _let(_let(_let(F.struct(r.alias("r"), g.alias("g"), b.alias("b")), spread), hued), named)


FAMILIES = ["red", "orange", "yellow", "green", "blue", "purple", "pink", "gray"]


def rects_ok(c: Column, most: int = 80) -> Column:
    """GEO-1: at most so many rectangles, all finite with positive size."""
    fine = F.forall(c, lambda r: (r["width"] > 0) & (r["height"] > 0) & (F.abs(r["x"]) < 1e308) & (F.abs(r["y"]) < 1e308) & (r["width"] < 1e308) & (r["height"] < 1e308))
    return c.isNotNull() & (F.size(c) <= most) & fine


def scale_rect(r: Column, width: Column, height: Column) -> Column:
    """GEO-2: a normalised box in the units of a page."""
    return F.struct((r["x"] * width).alias("x"), (r["y"] * height).alias("y"), (r["width"] * width).alias("width"), (r["height"] * height).alias("height"))
