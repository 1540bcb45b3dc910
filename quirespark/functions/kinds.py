"""Language tags, dates, versions, media types and measures as columns. What is no such thing gives null, or false for tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types by what they are.
FONTS = ("font/otf", "font/ttf", "font/woff", "font/woff2", "application/vnd.ms-opentype", "application/font-woff", "application/x-font-truetype")
PAGE_MAP = "application/oebps-page-map+xml"
XHTML, CSS = "application/xhtml+xml", "text/css"
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg"}
JPEG_NAMES = ("image/jpg", "image/pjpeg")
LANGUAGE = r"^(?:[A-Za-z]{2,8}(?:-[A-Za-z0-9]{1,8})*|[xXiI](?:-[A-Za-z0-9]{1,8})+)$"


def is_language(tag: Column) -> Column:
    """SCL31: whether a text has the form of a language tag."""
    return tag.rlike(LANGUAGE)


def language_tag(tag: Column) -> Column:
    """SCL30: a language tag in its usual case: language small, scripts with a capital, regions in capitals."""
    def part(x: Column, i: Column) -> Column:
        return F.when(i == 0, F.lower(x)).when(x.rlike("^[A-Za-z]{4}$"), F.initcap(x)).when(x.rlike("^[A-Za-z]{2}$"), F.upper(x)).otherwise(F.lower(x))

    return F.when(is_language(tag), F.array_join(F.transform(F.split(tag, "-"), part), "-"))


def text_direction(value: Column) -> Column:
    """SCL32: auto, ltr or rtl."""
    plain = F.lower(F.trim(value))
    return F.when(plain.isin("auto", "ltr", "rtl"), plain)


def is_date(value: Column) -> Column:
    """SCL33: whether a text is a year, a month, a day, or an ISO timestamp; other forms of dates are not accepted."""
    form = r"^\d{4}$|^\d{4}-(?:0[1-9]|1[0-2])$"
    day = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))
    stamp = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?$"), value.try_cast("timestamp"))
    return value.rlike(form) | day.isNotNull() | stamp.isNotNull()


def version_family(version: Column) -> Column:
    """SCL34: the family of a package version."""
    return F.when(version.startswith("2"), "Epub2").when(version.startswith("3"), "Epub3").otherwise("Unknown")


def is_font(media_type: Column) -> Column:
    """SCL36: an embedded font."""
    return F.lower(media_type).isin(*FONTS)


def is_page_map(media_type: Column) -> Column:
    """SCL37: a page map of the second version."""
    return F.lower(media_type) == PAGE_MAP


def is_supported(media_type: Column, is_navigation: Column) -> Column:
    """SCL35: a resource whose kind has a place in the structure."""
    plain = F.lower(media_type)
    return is_navigation | plain.isin(XHTML, CSS) | plain.startswith("image/") | is_font(plain) | is_page_map(plain)


def media_type(value: Column) -> Column:
    """SCL38: a media type without parameters in small letters."""
    return F.lower(F.trim(F.split_part(value, F.lit(";"), F.lit(1))))


def media_type_matches(declared: Column, detected: Column) -> Column:
    """SCL38: whether what is declared is what was found; JPEG has other names."""
    plain = media_type(declared)
    return (plain == detected) | (detected == "image/jpeg") & plain.isin(*JPEG_NAMES)


def file_extension(value: Column) -> Column:
    """SCL39: the file ending of an image."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(value)), F.lit(".bin"))


def safe_media_type(value: Column) -> Column:
    """SCL40: an image type that holds nothing else, otherwise that of unknown bytes."""
    return F.when(value.rlike(r"^(?i:image/)[A-Za-z0-9/+.-]*$"), F.lower(value)).otherwise("application/octet-stream")


LARGEST = 2**63 - 1


def saturating_sum(value: Column) -> Column:
    """SCL43, an aggregate: a sum that stays at the largest whole number of 64 bits."""
    return F.least(F.sum(value.cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("bigint")


def preserved_percentage(kept: Column, total: Column) -> Column:
    """SCL44: a share in percent with six places, cut off, not rounded; 100 of nothing."""
    hundredfold = kept.cast("decimal(20,0)") * F.lit(100_000_000).cast("decimal(12,0)")
    scaled = F.call_function("div", hundredfold, total.cast("decimal(20,0)"))  # "/" would round to some places first
    return F.when(total == 0, F.lit(100.0)).otherwise(scaled.cast("double") / 1e6)


def scaled_length(length: Column, factor: Column) -> Column:
    """SCL53: the struct value, unit of a length times a factor."""
    return F.struct((length["value"] * factor).alias("value"), length["unit"].alias("unit"))


def quoted_argument(text: Column, shell: str) -> Column:
    """SCL54: an argument as it is shown for a shell, "posix" for single quotes doubled, "cmd" for double quotes."""
    if shell == "cmd":
        return F.when(text.rlike(r'^[A-Za-z0-9._:/\\-]+$'), text).otherwise(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(text.rlike(r"^[A-Za-z0-9._:/\\-]+$"), text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")))
