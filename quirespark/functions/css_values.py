"""Values of style properties as typed columns; null where a value is none of its kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
# Names of weights and alignments.
WEIGHTS = {"normal": 400, "bold": 700} | {str(w): w for w in range(100, 1000, 100)}
ALIGNMENTS = {"left": "start", "start": "start", "right": "end", "end": "end", "center": "center", "justify": "justify"}


def _plain(value: Column) -> Column:
    return F.lower(F.trim(value))


def _known(value: Column, names: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), _plain(value))


def font_family(value: Column) -> Column:
    """CSS13: the first family, without quotes."""
    first = F.trim(F.regexp_extract(value, r"""^\s*("[^"]*"|'[^']*'|[^,"']*)""", 1))
    name = F.regexp_replace(first, "^[\"']+|[\"']+$", "")
    return F.when(~name.rlike(r"[,;{}():\\\x{00}-\x{1F}\x{7F}-\x{9F}]") & name.rlike(r"\S"), name)


def length(value: Column, positive: bool = False) -> Column:
    """CSS14: the struct value, unit of px, em, rem and %; 0 may be without."""
    text = _plain(value)
    form = rf"^({_NUMBER})(rem|px|em|%)$"
    number = F.regexp_extract(text, form, 1).try_cast("double")
    good = text.rlike(form) & (number > 0 if positive else F.lit(True))
    zero = text.isin("0", "+0", "-0", "0.0") & F.lit(not positive)
    return F.when(good, F.struct(number.alias("value"), F.regexp_extract(text, form, 2).alias("unit"))).when(zero, F.struct(F.lit(0.0).alias("value"), F.lit("px").alias("unit")))


def letter_spacing(value: Column) -> Column:
    """CSS15: a length; normal is 0em."""
    return F.when(_plain(value) == "normal", F.struct(F.lit(0.0).alias("value"), F.lit("em").alias("unit"))).otherwise(length(value))


def font_weight(value: Column) -> Column:
    """CSS16: a weight from 100 to 900."""
    return _known(value, WEIGHTS)


def font_style(value: Column) -> Column:
    """CSS17: normal, italic or oblique."""
    return F.when(_plain(value).isin("normal", "italic", "oblique"), _plain(value))


def text_transform(value: Column) -> Column:
    """CSS17: none, capitalize, uppercase or lowercase."""
    return F.when(_plain(value).isin("none", "capitalize", "uppercase", "lowercase"), _plain(value))


def line_height(value: Column) -> Column:
    """CSS18: a ratio above 0, from a number or a percentage."""
    text = F.trim(value)
    number = F.when(text.rlike(rf"^{_NUMBER}%$"), F.rtrim(text, F.lit("%")).try_cast("double") / 100).when(text.rlike(f"^{_NUMBER}$"), text.try_cast("double"))
    return F.when(number > 0, number)


def text_align(value: Column) -> Column:
    """CSS19: start, end, center or justify."""
    return _known(value, ALIGNMENTS)


def text_decoration(value: Column) -> Column:
    """CSS20: bits of the lines: 1 below, 2 through; none takes back those before it; null with any other word."""
    words = F.filter(F.split(_plain(value), r"\s+"), lambda x: x != "")
    bits = F.aggregate(words, F.lit(0), lambda b, x: F.when(x == "none", F.lit(0)).when(x == "underline", b.bitwiseOR(F.lit(1))).when(x == "line-through", b.bitwiseOR(F.lit(2))))
    return bits
