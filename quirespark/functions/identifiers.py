"""Identifiers, anchors and codes as columns. A text that is none gives null (or false for tests); null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The form of identifiers and the scheme of anchors.
STABLE_ID = r"[a-z][a-z0-9._-]{0,127}"
TOKEN = r"^[a-z0-9][a-z0-9._-]{0,63}$"
ANCHOR_SCHEME, ANCHOR_SEGMENTS = "flow:", 64
GENERATED_DOCUMENT = "urn:flow:epub:"
SHORTEST_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*:."


def is_stable_id(text: Column) -> Column:
    """SCL1: whether a text is an identifier that may be referred to."""
    return text.rlike(f"^{STABLE_ID}$")


def node_id(text: Column) -> Column:
    """SCL2, SCL3: the identifier of a node or an asset, null where it has not the form of one."""
    return F.when(is_stable_id(text), text)


def is_absolute_uri(text: Column) -> Column:
    """Whether a text begins with a scheme, and for web addresses has a host."""
    return text.rlike(SHORTEST_ABSOLUTE) & ~text.rlike(r"^(?i:https?|ftp):(?!//[^/?#\s])")


def document_id(text: Column) -> Column:
    """SCL4: a document's identifier: an absolute address of 512 characters at most without outer blanks."""
    return F.when(is_absolute_uri(text) & (F.length(text) <= 512) & ~text.rlike(r"^[\s\p{Z}]|[\s\p{Z}]$"), text)


def anchor(ids: Column) -> Column:
    """SCL5: the anchor of a path of identifiers, null where one is none or the path is empty or too long."""
    good = F.forall(ids, lambda x: F.coalesce(is_stable_id(x), F.lit(False))) & F.size(ids).between(1, ANCHOR_SEGMENTS)
    return F.when(good, F.concat(F.lit(ANCHOR_SCHEME), F.array_join(ids, "/")))


def anchor_path(text: Column) -> Column:
    """SCL6: the identifiers of an anchor, null where the text is none."""
    form = f"^{ANCHOR_SCHEME}{STABLE_ID}(/{STABLE_ID}){{0,{ANCHOR_SEGMENTS - 1}}}$"
    return F.when(text.rlike(form), F.split(F.substring(text, len(ANCHOR_SCHEME) + 1, 2**31 - 1), "/"))


def anchor_target(text: Column) -> Column:
    """SCL6: the identifier an anchor leads to."""
    return F.element_at(anchor_path(text), -1)


def slug(text: Column) -> Column:
    """SCL7: small letters, digits, points and underscores; whatever is between becomes one hyphen, outer marks go."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9._]+", "-"), "^[-_.]+|[-_.]+$", "")


def id_base(text: Column) -> Column:
    """SCL8: what an identifier is made of before it is told from others: the slug, begun by a letter, 112 characters at most."""
    plain = slug(text)
    lettered = F.when(plain.rlike("^[a-z]"), plain).otherwise(F.concat(F.lit("epub-"), plain))
    return F.regexp_replace(F.substring(lettered, 1, 112), "[-_.]+$", "")


def publication_id(text: Column) -> Column:
    """SCL49, SCL50: the identifier of a publication, or a feature's token."""
    return F.when(text.rlike(TOKEN), text)


def sha256_value(text: Column) -> Column:
    """SCL48: a SHA-256 digest in capitals."""
    return F.when(text.rlike("^[0-9A-Fa-f]{64}$"), F.upper(text))


def code_between(code: Column, low: int, high: int) -> Column:
    """SCL51: whether a code of four letters and three digits is of a range."""
    return F.coalesce(code.rlike("^EPUB[0-9]{3}$") & F.substring(code, 5, 3).try_cast("int").between(low, high), F.lit(False))


def document_id_or_generated(identifier: Column, path: Column) -> Column:
    """SCL47: an absolute identifier as it is, otherwise one made from the digest of the identifier or, without it, the path."""
    made = F.concat(F.lit(GENERATED_DOCUMENT), F.sha2(F.coalesce(identifier, path), 256))
    return F.when(is_absolute_uri(identifier), identifier).otherwise(made)


_VERSION = r"^[vV]?(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?$"


def semantic_version(text: Column) -> Column:
    """SCL52: a version as a struct that is ordered as versions are: release after its previews, numbers before words."""
    part = [F.regexp_extract(text, _VERSION, i) for i in range(1, 5)]
    words = F.transform(
        F.split(part[3], r"\."),
        lambda x: F.struct(
            (~x.rlike("^[0-9]+$")).alias("is_word"), F.when(x.rlike("^[0-9]+$"), x.try_cast("bigint")).alias("number"), F.when(~x.rlike("^[0-9]+$"), x).alias("word")
        ),
    )
    numbers = [part[i].try_cast("int") for i in range(3)]
    fields = F.struct(numbers[0].alias("major"), numbers[1].alias("minor"), numbers[2].alias("patch"), (part[3] == "").alias("is_release"), F.when(part[3] != "", words).alias("preview"))
    return F.when(text.rlike(_VERSION) & numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull(), fields)
