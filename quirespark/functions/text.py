"""Text functions. White space is that of Unicode throughout; a null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for Java's regular expressions; those of DuckDB take the same class.
SPACE = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
VISIBLE = SPACE.replace("[", "[^", 1)
CONTROL = r"[\x{00}-\x{1F}\x{7F}-\x{9F}]"


def normalized(text: Column) -> Column:
    """SCL22: words joined by one blank."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def optional_text(text: Column) -> Column:
    """SCL23: normalized text, null where nothing is left."""
    return F.nullif(normalized(text), F.lit(""))


def significant(text: Column) -> Column:
    """SCL24: the number of code points that are no white space."""
    return F.regexp_count(text, F.lit(VISIBLE)).cast("bigint")


def is_visible(text: Column) -> Column:
    """SCL28: whether a text holds more than white space; false for null."""
    return F.coalesce(text.rlike(VISIBLE), F.lit(False))


def tokens(text: Column) -> Column:
    """The words of an attribute that is a list by white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def has_token(text: Column, token: str) -> Column:
    """SCL25: whether such a list holds a token in any letter case; false for null."""
    return F.coalesce(F.array_contains(tokens(F.lower(text)), token.lower()), F.lit(False))


def has_token_exactly(text: Column, token: str) -> Column:
    """SCL26: whether such a list holds a token as it is written; false for null."""
    return F.coalesce(F.array_contains(tokens(text), token), F.lit(False))


def is_ncname(text: Column) -> Column:
    """SCL29: whether a text is a name without colon as XML has them."""
    return text.rlike(r"^[\p{L}\p{Nl}_][\p{L}\p{M}\p{N}._\x{B7}-]*$")


def html_escaped(text: Column) -> Column:
    """SCL41: text for HTML: & < > and quotes as entities, U+00A0 to U+00FF and all beyond U+FFFF by number."""
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    letters = F.transform(F.split(out, ""), lambda c: F.when(c.between("\u00a0", "\u00ff") | (c >= "\U00010000"), F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c))
    return F.when(out.rlike(r"[\x{A0}-\x{FF}\x{10000}-\x{10FFFF}]"), F.array_join(letters, "")).otherwise(out)


def css_string(text: Column) -> Column:
    """SCL42: a text between quotes for a style sheet; quotes and backslashes are escaped, line breaks by number."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(out, F.lit("\n"), F.lit("\\a ")), F.lit("\r"), F.lit("\\d ")), F.lit('"'))


def css_number(value: Column) -> Column:
    """SCL42: a number without needless zeros."""
    return F.regexp_replace(F.regexp_replace(value.cast("decimal(30,10)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def css_length(value: Column, unit: Column) -> Column:
    """SCL42: a length with its unit."""
    return F.concat(css_number(value), unit)


def utf16_length(text: Column) -> Column:
    """The number of UTF-16 units of a text, in which lengths of produced text are counted."""
    return (F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("bigint")


def sha256_hex(data: Column) -> Column:
    """SCL45: the digest of text or bytes in capital hexadecimal digits."""
    return F.upper(F.sha2(data, 256))


def hash_of_values(values: Column) -> Column:
    """SCL46: the digest of a list of texts, each behind its length in four bytes, so that no two lists run together."""
    each = F.transform(values, lambda x: F.concat(F.lpad(F.hex(F.octet_length(x)), 8, "0"), F.hex(F.encode(x, "UTF-8"))))
    return sha256_hex(F.unhex(F.array_join(each, "")))
