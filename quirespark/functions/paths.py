"""Paths inside packages, and what may be linked to. Paths are taken apart and folded by built-in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirespark.functions.identifiers import ANCHOR_SCHEME, anchor_target, is_absolute_uri, is_stable_id
from quirespark.functions.text import CONTROL, SPACE, is_visible


def unescaped(text: Column) -> Column:
    """Percent escapes as the characters they stand for; what is no escape stays, and so does the plus sign."""
    return F.try_url_decode(F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def _folded(base: Column, segments: Column) -> Column:
    """The segments of a path from a base, null where it goes above the root or nothing is left."""
    start = F.struct(F.lit(True).alias("ok"), base.alias("path"))
    out = F.aggregate(
        segments,
        start,
        lambda state, x: F.when(x.isin("", "."), state)
        .when(x == "..", F.struct((state["ok"] & (F.size(state["path"]) > 0)).alias("ok"), F.slice(state["path"], 1, F.greatest(F.size(state["path"]) - 1, F.lit(0))).alias("path")))
        .otherwise(F.struct(state["ok"].alias("ok"), F.array_append(state["path"], x).alias("path"))),
    )
    return F.when(out["ok"] & (F.size(out["path"]) > 0), out["path"])


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def directory(path: Column) -> Column:
    """SCL10: what is before the last slash."""
    return F.regexp_extract(path, "(?s)^(.*)/", 1)


def archive_path(base: Column, value: Column) -> Column:
    """SCL9: a reference as a path from the root, from a base directory (null or empty for the root).

    Null for what is rooted, absolute, blank, has backslashes, goes above the root or names nothing; behind # and ? nothing
    counts. A segment with a colon or a control character is refused.
    """
    plain = unescaped(F.element_at(F.split(value, "[#?]", 2), 1))
    segments = _segments(plain)
    refused = value.startswith("/") | value.contains("\\") | value.contains("\0") | is_absolute_uri(value) | ~is_visible(value)
    odd = F.exists(segments, lambda x: ~x.isin(".", "..") & x.rlike(f":|{CONTROL}"))
    return F.when(~refused & ~odd, F.array_join(_folded(_segments(F.coalesce(base, F.lit(""))), segments), "/"))


def root_path(value: Column) -> Column:
    """SCL12: the same from the root, where a leading slash is allowed and segments are not refused."""
    refused = value.contains("\\") | value.contains("\0") | (is_absolute_uri(value)) | ~is_visible(value)
    return F.when(~refused, F.array_join(_folded(F.array().cast("array<string>"), _segments(unescaped(value))), "/"))


def reference_key(source: Column, href: Column) -> Column:
    """SCL11: the struct target, key of a reference from a file: the path, and the path with its fragment."""
    parts = F.split(href, "#", 2)
    target = F.when(parts[0] == "", source).otherwise(archive_path(directory(source), parts[0]))
    fragment = unescaped(F.get(parts, F.lit(1)))
    key = F.when(F.size(parts) == 1, target).when((fragment != "") & ~fragment.rlike(CONTROL), F.concat(target, F.lit("#"), fragment))
    return F.when(is_visible(href) & ~is_absolute_uri(href) & target.isNotNull() & key.isNotNull(), F.struct(target.alias("target"), key.alias("key")))


def has_valid_escapes(text: Column) -> Column:
    """SCL14: whether each percent sign is followed by two hexadecimal digits."""
    return ~text.rlike("%(?![0-9A-Fa-f]{2})")


def is_safe_relative(path: Column) -> Column:
    """SCL13: whether a path stays below its root, as it is and with its escapes undone; false for null."""
    bad = rf"^/|\\|:|{CONTROL}"
    decoded = unescaped(path)
    steps = F.forall(F.split(decoded, "/"), lambda x: ~x.isin("", ".", ".."))
    return is_visible(path) & ~path.rlike(bad) & has_valid_escapes(path) & ~decoded.rlike(bad) & steps


def relative_reference(source: Column, target: Column) -> Column:
    """SCL15: the shortest reference from one file to another."""
    one, other = F.split(source, "/"), F.split(target, "/")
    most = F.least(F.size(one) - 1, F.size(other) - 1)
    differing = F.filter(F.sequence(F.lit(0), most), lambda i: (i == most) | (F.get(one, i) != F.get(other, i)))
    common = F.array_min(differing)
    return F.concat(F.repeat(F.lit("../"), F.size(one) - 1 - common), F.array_join(F.slice(other, common + 1, F.size(other)), "/"))


def resolved_path(current: Column, relative: Column) -> Column:
    """SCL16: where a reference leads from a file, null where it goes above the root."""
    base = F.split(current, "/")
    return F.array_join(_folded(F.slice(base, 1, F.size(base) - 1), F.split(relative, "/")), "/")


def scheme(href: Column) -> Column:
    """The scheme of an absolute address in small letters."""
    return F.when(is_absolute_uri(href), F.lower(F.regexp_extract(href, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)))


def is_safe_mailto(href: Column) -> Column:
    """SCL18: whether a mail address is one, without control characters or blanks, escaped control characters neither."""
    return F.coalesce(href.rlike("(?i)^mailto:.") & ~href.rlike(f"{CONTROL}|{SPACE}") & ~unescaped(href).rlike(CONTROL), F.lit(False))


def is_external(href: Column) -> Column:
    """SCL17: whether a link leads out of the publication: web, telephone, or a safe mail address."""
    return F.when(href.rlike("(?i)^mailto:"), is_safe_mailto(href)).otherwise(F.coalesce(scheme(href).isin("http", "https", "tel"), F.lit(False)))


def is_safe_external(href: Column) -> Column:
    """SCL19: whether a link may stand in output: web or a safe mail address."""
    return F.when(href.rlike("(?i)^mailto:"), is_safe_mailto(href)).otherwise(F.coalesce(scheme(href).isin("http", "https"), F.lit(False)))


def safe_href(target: Column) -> Column:
    """SCL20: what a link becomes in output: #id for anchors and nodes, external ones as they are, null for all others."""
    inner = F.substring(target, 2, 2**31 - 1)
    return (
        F.when(anchor_target(target).isNotNull(), F.concat(F.lit("#"), anchor_target(target)))
        .when(target.startswith("#") & is_stable_id(inner), target)
        .when(is_safe_external(target), target)
    )


def figure_link(target: Column) -> Column:
    """SCL21: the struct anchor, uri of a figure's link, one of which is set; null where it is neither."""
    inside, outside = F.when(target.startswith(ANCHOR_SCHEME) & anchor_target(target).isNotNull(), target), F.when(is_safe_external(target), target)
    return F.when(inside.isNotNull() | outside.isNotNull(), F.struct(inside.alias("anchor"), outside.alias("uri")))
