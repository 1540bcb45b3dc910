"""Queries of the image functions, over listed bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import images
from quirespark.functions.text import sha256_hex
from quirespark.plans.scalars import _listed

c = F.col
_PNG = "89504E470D0A1A0A0000000D49484452" + "00000140" + "000000F0" + "0802000000"
_JPEG = "FFD8" + "FFE00010" + "00" * 14 + "FFDB0004" + "0000" + "FFC00011" + "08" + "0064" + "00C8" + "03" * 10
CASES = [
    ("png", _PNG, "image/png", 320, 240, True), ("short-png", _PNG[:40], "image/png", None, None, False), ("gif", "474946383961" + "0A00" + "1400" + "000000", "image/gif", 10, 20, True), ("jpeg", _JPEG, "image/jpeg", 200, 100, True),
    ("webp-lossy", "52494646" + "00000000" + "57454250" + "56503820" + "00000000" + "000000" + "9D012A" + "2C01" + "9000", "image/webp", 300, 144, True),
    ("webp-lossless", "52494646" + "00000000" + "57454250" + "5650384C" + "00000000" + "2F" + "1F404900", "image/webp", 32, 294, True), ("webp-extended", "52494646" + "00000000" + "57454250" + "56503858" + "0A000000" + "00000000" + "3F0100" + "EF0000", "image/webp", 320, 240, True),
    ("svg", '<?xml version="1.0"?><svg xmlns="http://www.w3.org/2000/svg"/>'.encode().hex().upper(), "image/svg+xml", None, None, False), ("other", "00010203", None, None, None, False), ("none", None, None, None, None, False),
]
SVGS = [("<svg><path d='M0 0'/></svg>", True), ("<svg onload='x()'/>", False), ("<svg><script/></svg>", False), ("<svg><a xlink:href='#x'/></svg>", True), ("<svg><image href='http://h/x'/></svg>", False), ("<svg><style>a{fill:url(#g)}</style></svg>", True), ("<svg><foreignObject/></svg>", False)]
LENGTHS = [("12", 12.0), ("12px", 12.0), ("3pt", 4.0), ("1in", 96.0), ("50%", None), ("x", None), ("0", None), (None, None)]


def bin_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BIN1–4, BIN7: type, size and limits of images."""
    df = spark.createDataFrame([(n, h) for n, h, *_ in CASES], "name string, digits string").withColumn("data", F.unhex("digits"))
    size = images.image_size(c("data"))
    return df.select("name", images.image_type(c("data")).alias("kind"), size["width"].alias("width"), size["height"].alias("height"), images.is_within_limits(size, F.octet_length("data")).alias("fits"))


def bin_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BIN5, BIN9, QLT27: whether SVGs are passive."""
    df = spark.createDataFrame([(s,) for s, _ in SVGS], "svg string")
    return df.select("svg", images.is_passive_svg(F.encode("svg", "UTF-8")).alias("is_passive"))


def bin_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BIN6: lengths of SVGs."""
    return spark.createDataFrame([(x,) for x, _ in LENGTHS], "length string").select("length", F.round(images.svg_length(c("length")), 6).alias("px"))


def bin_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BIN8, BIN10, AGG23, QLT28: equal bytes as one asset, with the least name, its copies and their base64 form."""
    df = spark.createDataFrame([(n, h) for n, h, *_ in CASES if h] + [("again", _PNG), ("0-first", _PNG)], "name string, digits string").withColumn("data", F.unhex("digits"))
    groups = df.groupBy(sha256_hex(c("data")).alias("sha256")).agg(F.min("name").alias("name"), F.count("*").alias("n_copies"), F.min(F.length(F.regexp_replace(F.base64("data"), r"\s", ""))).alias("n_base64"))
    return groups.select("name", "n_copies", "n_base64")


_COPIES = ", ".join(f"('{n}', '{h}')" for n, h in [(n, h) for n, h, *_ in CASES if h] + [("again", _PNG), ("0-first", _PNG)])
QUERIES = {f.__name__: f for f in (bin_images, bin_svg, bin_lengths, bin_copies)}
SQL = {
    "bin_images": f"SELECT name, kind, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, fits FROM (VALUES {_listed(*[(r[0], *r[2:]) for r in CASES])}) AS t(name, kind, width, height, fits)",
    "bin_svg": f"SELECT * FROM (VALUES {_listed(*SVGS)}) AS t(svg, is_passive)",
    "bin_lengths": f"SELECT * FROM (VALUES {_listed(*LENGTHS)}) AS t(length, px)",
    "bin_copies": f"SELECT min(name) AS name, count(*) AS n_copies, CAST(min(length(base64(unhex(digits)))) AS INTEGER) AS n_base64 FROM (VALUES {_COPIES}) AS t(name, digits) GROUP BY digits",
}
