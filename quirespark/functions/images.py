"""What the first bytes of images say, by built-in functions over binary columns; null where the bytes are none of the kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How files begin, in hexadecimal digits.
MAGIC = {"89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "474946383761": "image/gif", "474946383961": "image/gif"}


def _hex(data: Column, start: int, size: int) -> Column:
    return F.hex(F.substring(data, start, size))


def _number(digits: Column) -> Column:
    """Hexadecimal digits as a number; no digits are none."""
    return F.when(digits != "", F.conv(digits, 16, 10).cast("bigint"))


def _turned(digits: Column) -> Column:
    """The digits of bytes in the other order."""
    return F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), "")


def image_type(data: Column) -> Column:
    """BIN1: the media type of PNG, JPEG, GIF, WebP and SVG by their bytes."""
    head = _hex(data, 1, 12)
    known = F.coalesce(*[F.when(head.startswith(magic), F.lit(kind)) for magic, kind in MAGIC.items()])
    webp = F.when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")
    text = F.decode(F.substring(data, 1, 1024), "UTF-8")
    svg = F.when(text.rlike(r"(?is)^\x{FEFF}?\s*(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*)*(?:<!DOCTYPE\s+svg[^>\[]*>\s*)?<(?:[a-z]+:)?svg[\s>]"), "image/svg+xml")
    return F.coalesce(known, webp, svg)


def _jpeg(data: Column) -> Column:
    """The digits behind the first frame header of a JPEG: segments of known length are gone over before it."""
    segment = r"FF(?:E.|DB|C4|CC|DD|FE)(....)"
    rest = F.substring(F.hex(data), 5, 2**31 - 1)
    step = lambda state, _: F.when(state.rlike(f"^{segment}"), F.substring(state, F.conv(F.regexp_extract(state, f"^{segment}", 1), 16, 10).cast("int") * 2 + 5, F.lit(2**31 - 1))).otherwise(state)
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), rest, step)


def image_size(data: Column) -> Column:
    """BIN2–4: the struct width, height of a PNG, GIF, WebP (all three forms) or JPEG; null where they aren't there."""
    kind = image_type(data)
    png = (_number(_hex(data, 17, 4)), _number(_hex(data, 21, 4)))
    gif = (_number(_turned(_hex(data, 7, 2))), _number(_turned(_hex(data, 9, 2))))
    form = _hex(data, 13, 4)
    lossy = (_number(_turned(_hex(data, 27, 2))).bitwiseAND(F.lit(0x3FFF)), _number(_turned(_hex(data, 29, 2))).bitwiseAND(F.lit(0x3FFF)))
    bits = _number(_turned(_hex(data, 22, 4)))
    lossless = (bits.bitwiseAND(F.lit(0x3FFF)) + 1, F.shiftright(bits, 14).bitwiseAND(F.lit(0x3FFF)) + 1)
    extended = (_number(_turned(_hex(data, 25, 3))) + 1, _number(_turned(_hex(data, 28, 3))) + 1)
    frame = _jpeg(data)
    found = frame.rlike("^FFC[0-35-7]")
    jpeg = tuple(F.when(found, _number(F.substring(frame, at, 4))) for at in (15, 11))

    def one(i: int) -> Column:
        webp = F.when(form == "56503820", lossy[i]).when(form == "5650384C", lossless[i]).when(form == "56503858", extended[i])
        return F.when(kind == "image/png", png[i]).when(kind == "image/gif", gif[i]).when(kind == "image/webp", webp).when(kind == "image/jpeg", jpeg[i])

    return F.when(one(0).isNotNull() & one(1).isNotNull(), F.struct(one(0).alias("width"), one(1).alias("height")))


def is_passive_svg(data: Column) -> Column:
    """BIN5, BIN9, QLT27: whether an SVG holds no script, handlers, foreign objects or outside references."""
    text = F.decode(data, "UTF-8")
    return ~text.rlike(r"(?is)<(?:\w+:)?(?:script|foreignObject|iframe|animate\w*|set)\b|\son\w+\s*=|javascript:|(?:href|src)\s*=\s*[\"']\s*(?!#|data:image/)[^\"']|@import|url\(\s*[\"']?(?!#)|<!ENTITY")


def svg_length(value: Column) -> Column:
    """BIN6: a length of an SVG in px; percentages have none."""
    number = F.regexp_extract(F.trim(value), r"^([0-9]*\.?[0-9]+)(px|pt|pc|mm|cm|in)?$", 1).try_cast("double")
    unit = F.regexp_extract(F.trim(value), r"^([0-9]*\.?[0-9]+)(px|pt|pc|mm|cm|in)?$", 2)
    scale = F.when(unit == "pt", 4 / 3).when(unit == "pc", 16.0).when(unit == "mm", 96 / 25.4).when(unit == "cm", 96 / 2.54).when(unit == "in", 96.0).otherwise(1.0)
    return F.when(number > 0, number * scale)


def is_within_limits(size: Column, bytes_: Column, most_bytes: int = 16 << 20, most_side: int = 20_000, most_pixels: int = 100_000_000) -> Column:
    """BIN7: whether an image's sides, pixels and bytes are within limits; false where they aren't known."""
    return F.coalesce((size["width"].between(1, most_side)) & (size["height"].between(1, most_side)) & (size["width"] * size["height"] <= most_pixels) & (bytes_ <= most_bytes), F.lit(False))
