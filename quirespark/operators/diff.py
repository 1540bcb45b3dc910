"""Differences between two copies of a table.

Both copies are brought to one notation, and of each key the row that counts is told by its version and a checksum of its
fields; only these are shuffled. The space of 64-bit key hashes is cut into ranges, each with checksums per copy. The
comparison begins with the widest ranges and goes on inside those that differ only, each of which is cut into narrower
ones. Fields are read again, joined and compared in the ranges that still differ at the narrowest level.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.session import cut

#: Rows expected in one range of the narrowest level, and bits by which a level is narrower than the one above it.
LEAF_ROWS, LEVEL_BITS = 1, 4
_HIGHEST_BITS = 60
#: Bits up to which the differing ranges of a level are sent to all tasks: 2 ** 16 numbers of eight bytes at most.
BROADCAST_BITS = 16


def blank_to_null(column: Column) -> Column:
    """Text as it is, null where it holds white space only."""
    return F.when(column.rlike(r"[^\s\p{Z}]"), column)


def canonical_key(column: Column) -> Column:
    """A key in lower case without outer blanks; null where nothing is left."""
    return F.lower(_stripped(column))


#: Zeros of the sets of digits that are read as numbers.
_ZEROS = (0x660, 0x6F0, 0x966, 0xE50, 0xFF10)
_DIGITS = "".join(chr(zero + i) for zero in _ZEROS for i in range(10))
_GROUP_MARKS = r"'’_\x{00A0}\x{202F}\x{2009} "


def _bare_count(column: Column) -> Column:
    """A count with ASCII digits, without outer blanks and plus sign, and with a plain minus."""
    text = F.translate(_stripped(column.cast("string")), _DIGITS + "\u2212", "0123456789" * len(_ZEROS) + "-")
    return F.regexp_replace(text, r"^\+", "")


def point_marks_fractions(df: DataFrame, name: str) -> Column:
    """An aggregate: whether a column's texts use the point before decimals and never between groups of digits.

    12.000 can be twelve or twelve thousand. Values that can't be misread decide: 12.0 and 1,234.00 for decimals, 1.234.567
    and 1.234,00 for groups. Without any such value, or with both kinds, the point stands between groups.
    """
    bare = _bare_count(df[name])
    fraction = bare.rlike(r"^-?\d+\.(\d{1,2}|\d{4,})$") | bare.rlike(r"^-?\d{1,3}(,\d{3})+\.\d+$")
    group = bare.rlike(r"^-?\d{1,3}(\.\d{3}){2,}(,\d+)?$") | bare.rlike(r"^-?\d{1,3}(\.\d{3})+,\d+$")
    return F.coalesce(F.bool_or(fraction), F.lit(False)) & ~F.coalesce(F.bool_or(group), F.lit(False))


def canonical_count(column: Column, point_is_fraction: bool = False) -> Column:
    """A whole number in any usual notation, as text of its digits.

    Accepts signs, outer blanks, digits of other scripts, digit groups by comma, point, apostrophe, underscore or blank, a
    decimal part of zeros after a point or comma, and powers of ten. A point or comma before three digits stands between
    groups, the point before decimals where point_is_fraction. What is no whole number is kept as it is (trimmed), so that
    it equals only the same text.
    """
    bare, text = _bare_count(column), _stripped(column.cast("string"))
    marks = f",{_GROUP_MARKS}" if point_is_fraction else f",.{_GROUP_MARKS}"
    one = lambda x: (
        F.when(x.rlike(rf"^-?\d{{1,3}}([{marks}]\d{{3}})+$"), F.regexp_replace(x, r"[^0-9-]", ""))
        .when(x.rlike(rf"^-?\d{{1,3}}([,{_GROUP_MARKS}]\d{{3}})+\.0*$"), F.regexp_replace(F.regexp_replace(x, r"\.0*$", ""), r"[^0-9-]", ""))
        .when(x.rlike(rf"^-?\d{{1,3}}([.{_GROUP_MARKS}]\d{{3}})+,0*$"), F.regexp_replace(F.regexp_replace(x, r",0*$", ""), r"[^0-9-]", ""))
        .when(x.rlike(r"^-?\d+,0*$"), F.regexp_replace(x, r",0*$", ""))
        .otherwise(x)
    )
    # The expressions are applied through transform so that the intermediate texts are evaluated once.
    whole = F.transform(
        F.transform(F.array(bare), one), lambda x: F.when(x.rlike(r"^-?[0-9]+(\.0*|\.[0-9]+(?=[eE]))?([eE][+-]?[0-9]{1,2})?$"), x.try_cast("decimal(38,6)"))
    ).getItem(0)
    return F.coalesce(F.when(whole == F.floor(whole), F.floor(whole).cast("string")), text)


def canonical_digest(column: Column) -> Column:
    """A digest in upper case, without outer blanks and a leading algorithm name."""
    return F.upper(_stripped(F.regexp_replace(_stripped(column), r"^[A-Za-z][A-Za-z0-9/_-]*\s*[:=]\s*", "")))


CANONICAL = {"key": canonical_key, "digest": canonical_digest, "text": lambda c: blank_to_null(c.cast("string"))}


def _stripped(column: Column) -> Column:
    return blank_to_null(F.regexp_replace(column.cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def canonical_fields(df: DataFrame, fields: Mapping[str, str]) -> list[Column]:
    """The compared columns of a copy in one notation. A count that is text takes one pass over the copy, to tell what the
    point means in it."""
    texts = [n for n, kind in fields.items() if kind == "count" and df.schema[n].dataType.typeName() == "string"]
    told = df.agg(*[point_marks_fractions(df, n).alias(f"c{i}") for i, n in enumerate(texts)]).first() if texts else ()
    fraction = dict(zip(texts, told, strict=True))
    return [
        (canonical_count(df[n], bool(fraction.get(n))) if kind == "count" else CANONICAL[kind](df[n])).alias(n) for n, kind in fields.items()
    ]


def differences(
    left: DataFrame,
    right: DataFrame,
    key: str,
    version: str,
    fields: Mapping[str, str],
    leaf_rows: int = LEAF_ROWS,
    values: bool = False,
) -> DataFrame:
    """key, diff_kind, field_name: what two copies of a table disagree in; with values also left_value, right_value.

    key: the column that names a row in both copies; compared without regard to case and outer blanks.
    version: of the rows of one key in a copy, the one with the greatest version counts. A null version is the least; rows
    of equal version are ordered by the checksum of their fields, so the choice doesn't depend on the row order.
    fields: the compared columns and their notation: "count", "digest" or "text".

    diff_kind is left_only or right_only (field_name '') for a key that one copy has, else differs, with a row for each
    differing field. Null equals null only, and blank text is null. Rows whose key is null or blank are one key, null.
    Columns that aren't named are ignored, whatever their names; repeated rows count once; two empty tables, or equal
    ones, give no row.

    A key with very many rows is no hot task: its greatest row is found by partial aggregation.
    """
    names = list(fields)
    sides = []
    for side, df in (("l", left), ("r", right)):
        own_key = canonical_key(df[key])
        whole = df.select(own_key.alias("key"), df[version].alias("version"), *canonical_fields(df, fields), F.lit(side).alias("side"))
        marked = [x for n in names for x in (F.coalesce(F.col(f"`{n}`"), F.lit("")), F.col(f"`{n}`").isNull())]
        sides.append(
            whole.select(
                "key",
                "side",
                F.struct(
                    "version",
                    F.xxhash64(*marked).alias("sum"),
                    F.struct(*[F.col(f"`{n}`") for n in names]).alias("fields"),
                ).alias("row"),
                _place(F.col("key")).alias("place"),
            )
        )
    each = sides[0].unionByName(sides[1])
    latest = each.groupBy("key", "side").agg(F.max(F.struct("row.version", "row.sum")).alias("row"))
    own = [F.coalesce(F.col("key"), F.lit("")), F.col("key").isNull(), F.col("row.sum")]
    # two independent sums, as equal ones would cancel out in a range
    rows = cut(latest.select("side", _place(F.col("key")).alias("place"), F.xxhash64(*own).alias("sum_a"), F.xxhash64(F.lit("b"), *own).alias("sum_b")))
    suspects, bits = _differing_ranges(rows, max(left.count(), right.count()), leaf_rows)
    narrowed = each.withColumn("span", _span(F.col("place"), bits)).join(_sent(suspects, bits), "span", "left_semi")
    # both copies of a key meet in one partial aggregation
    pairs = narrowed.groupBy("key").agg(
        F.max(F.when(F.col("side") == "l", F.col("row"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("row"))).alias("r")
    )
    pairs = pairs.select("key", F.col("l.fields").alias("a"), F.col("r.fields").alias("b"), F.col("l").isNull().alias("no_l"), F.col("r").isNull().alias("no_r"))

    def found(kind: str, name: str, one: Column, other: Column) -> Column:
        return F.struct(F.lit(kind).alias("k"), F.lit(name).alias("f"), one.alias("x"), other.alias("y"))

    none = F.lit(None).cast("string")
    differing = F.filter(
        F.array(*[F.when(~F.col(f"a.`{n}`").eqNullSafe(F.col(f"b.`{n}`")), found("differs", n, F.col(f"a.`{n}`"), F.col(f"b.`{n}`"))) for n in names]),
        lambda x: x.isNotNull(),
    )
    every = F.when(F.col("no_r"), F.array(found("left_only", "", none, none))).when(F.col("no_l"), F.array(found("right_only", "", none, none))).otherwise(differing)
    out = [F.col("key").alias(key), F.col("d.k").alias("diff_kind"), F.col("d.f").alias("field_name")]
    return pairs.select("key", F.explode(every).alias("d")).select(*out, *([F.col("d.x").alias("left_value"), F.col("d.y").alias("right_value")] if values else []))


def _place(key: Column) -> Column:
    return F.xxhash64(F.coalesce(key, F.lit("")), key.isNull())


def _span(place: Column, bits: int) -> Column:
    """The range of the given level a key hash lies in: its leading bits."""
    return F.shiftrightunsigned(place, 64 - bits)


def _sent(ranges: DataFrame, bits: int) -> DataFrame:
    """Ranges of a level, to be broadcast where they can't be many."""
    return F.broadcast(ranges) if bits <= BROADCAST_BITS else ranges


def _differing_ranges(rows: DataFrame, each: int, leaf_rows: int) -> tuple[DataFrame, int]:
    """The narrowest ranges whose checksums differ (column span), and their bits; each: the rows a copy has at most."""
    levels = max(1, math.ceil(math.log2(max(2.0, each / leaf_rows)) / LEVEL_BITS))
    bits = min(_HIGHEST_BITS, levels * LEVEL_BITS)
    # the sums of the copies are equal when both together come to nothing
    sums = [F.bit_xor("sum_a").alias("a"), F.bit_xor("sum_b").alias("b"), F.sum(F.when(F.col("side") == "l", 1).otherwise(-1)).alias("n")]
    differing: DataFrame | None = None
    for level in range(LEVEL_BITS, bits + 1, LEVEL_BITS):
        at = rows
        if differing is not None:  # only what lies inside a range that differed one level above
            at = rows.withColumn("span", _span(F.col("place"), level - LEVEL_BITS)).join(_sent(differing, level - LEVEL_BITS), "span", "left_semi")
        folded = at.groupBy(_span(F.col("place"), level).alias("span")).agg(*sums)
        differing = folded.where("a <> 0 OR b <> 0 OR n <> 0").select("span")
    assert differing is not None
    return differing, bits


def compared_fields(columns: Sequence[str], without: Sequence[str], counts: Sequence[str], digests: Sequence[str]) -> dict[str, str]:
    """The notation of each column for differences()."""
    return {c: "count" if c in counts else "digest" if c in digests else "text" for c in columns if c not in without}
