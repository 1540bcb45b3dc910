"""Packages (ZIP archives with an XML description) as rows: entries, description, manifest, spine, metadata.

Archives and XML are what no built-in function reads: Python goes through them a package at a time, in Arrow batches, and
gives rows. Whatever is made of the rows is joins and aggregations. XML with a document type of its own is refused before
it is parsed, so entities can't be expanded and nothing is fetched.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.functions import kinds
from quirespark.functions.paths import archive_path, directory, reference_key
from quirespark.functions.text import is_visible, optional_text

c = F.col

# Limits of an archive, and names of the format.
LIMITS = {"entries": 2048, "entry_bytes": 16 << 20, "total_bytes": 256 << 20, "ratio": 200, "xml_chars": 8 << 20}
CONTAINER = "META-INF/container.xml"
_OPF, _DC = "{http://www.idpf.org/2007/opf}", "{http://purl.org/dc/elements/1.1/}"
ENTRY_SCHEMA = "pub_id string, ordinal int, path string, compressed_len bigint, len bigint, problem string, data binary"
_PLAIN_DOCTYPE = re.compile(r"<!DOCTYPE\s+[A-Za-z:]+(?:\s+(?:PUBLIC\s+(?:\"[^\"]*\"|'[^']*')\s*)?(?:SYSTEM\s+)?(?:\"[^\"]*\"|'[^']*')?)?\s*>", re.I)


def package_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC17, SRC18: pub_id, content of the archives below a path: the file's name without ending, and its bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.epub$", 1).alias("pub_id"), "content")


def entries(files: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """SRC1–3, STR1: the entries of archives (pub_id, content) in their order; a problem takes the place of the bytes.

    Problems: unreadable (the archive, with ordinal -1), unsafe-path, duplicate-path, too-many-entries, entry-too-large,
    total-too-large, suspicious-ratio, damaged. The running total counts an entry before its own size is judged, and leaves
    out unsafe ones. Directories are none. Null content is unreadable.
    """

    def read(pub: str, content: bytes | None) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content or b""))
        except (zipfile.BadZipFile, OSError, ValueError):
            yield pub, -1, None, None, None, "unreadable", None
            return
        total, seen = 0, set()
        for i, info in enumerate(x for x in archive.infolist() if not x.is_dir()):
            name = info.filename
            parts = name.split("/")
            row = (pub, i, name, info.compress_size, info.file_size)
            if name.startswith("/") or "\\" in name or ":" in name or any(p in ("", ".", "..") for p in parts) or any(ord(ch) < 32 for ch in name):
                yield *row, "unsafe-path", None
                continue
            total += info.file_size
            problem = (
                "too-many-entries" if i >= limits["entries"] else "duplicate-path" if name in seen else "total-too-large" if total > limits["total_bytes"] else "entry-too-large" if info.file_size > limits["entry_bytes"]
                else "suspicious-ratio" if info.file_size > limits["ratio"] * max(1, info.compress_size) else None
            )
            seen.add(name)
            data = None
            if problem is None:
                try:
                    with archive.open(info) as held:
                        data = held.read(limits["entry_bytes"] + 1)
                except (zipfile.BadZipFile, OSError, ValueError, RuntimeError, NotImplementedError):
                    problem = "damaged"
            yield *row, problem, data

    return _rows(files.select("pub_id", "content"), ENTRY_SCHEMA, read)


def _rows(df: DataFrame, schema: str, read: Callable[..., Iterator[tuple]], at_once: int = 64) -> DataFrame:
    """Rows that read gives for each row of df, a bounded number of its rows at a time."""
    kind = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [pa.field(n, kind[k]) for n, k in (f.split() for f in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(batch.num_rows):
                held: list[tuple] = []
                for out in read(*(col[start].as_py() for col in batch.columns)):
                    held.append(out)
                    if len(held) >= at_once:
                        yield _batch(held, fields)
                        held = []
                if held:
                    yield _batch(held, fields)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))


def parsed_xml(data: bytes | None, most: int = LIMITS["xml_chars"]) -> Any:
    """SRC4–6: the root element, or None where the bytes are too many, no XML, or have a document type with a subset."""
    if not data or len(data) > most:
        return None
    head = data[:8192].decode("utf-8", "replace") if data[:2] not in (b"\xff\xfe", b"\xfe\xff") else data[:16384].decode("utf-16", "replace")
    if b"<!ENTITY" in data or "<!DOCTYPE" in head.upper() and not _PLAIN_DOCTYPE.search(head):
        return None
    try:
        return ElementTree.fromstring(data)
    except (ElementTree.ParseError, ValueError, LookupError):
        return None


def package_paths(entry_rows: DataFrame) -> DataFrame:
    """SRC9: pub_id, opf_path of the description that the container names first; null where it names none or isn't there."""

    def read(pub: str, data: bytes | None) -> Iterator[tuple]:
        root = parsed_xml(data)
        paths = [] if root is None else [x.get("full-path") for x in root.iter() if x.tag.endswith("}rootfile") or x.tag == "rootfile"]
        yield pub, next((p for p in paths if p), None)

    found = _rows(entry_rows.where((c("path") == CONTAINER) & c("problem").isNull()).select("pub_id", "data"), "pub_id string, full_path string", read)
    named = found.select(c("pub_id").alias("of"), archive_path(F.lit(None).cast("string"), c("full_path")).alias("opf_path"))
    return entry_rows.select("pub_id").distinct().join(named, c("pub_id") == c("of"), "left").drop("of")


ELEMENT_SCHEMA = "pub_id string, opf_path string, ord int, section string, name string, xml_id string, value string, href string, media_type string, properties string, idref string, fallback string, linear string, refines string, scheme string, role string, file_as string, lang string"


def package_elements(entry_rows: DataFrame) -> DataFrame:
    """SRC8, SRC10: a row for each element of manifest, spine and metadata of each description, in document order.

    A description that isn't there or can't be parsed gives no row.
    """
    opf = package_paths(entry_rows).where("opf_path IS NOT NULL").select(c("pub_id").alias("of"), "opf_path")
    held = entry_rows.where("problem IS NULL").join(opf, (c("pub_id") == c("of")) & (c("path") == c("opf_path"))).select("pub_id", "opf_path", "data")

    def read(pub: str, path: str, data: bytes | None) -> Iterator[tuple]:
        root = parsed_xml(data)
        if root is None:
            return
        yield pub, path, 0, "package", "package", root.get("unique-identifier"), root.get("version"), *[None] * 11
        ord_ = 0
        for section in ("metadata", "manifest", "spine"):
            for top in root.findall(f"{_OPF}{section}"):
                for x in top:
                    if not isinstance(x.tag, str):
                        continue
                    ord_ += 1
                    name = x.tag.replace(_DC, "dc:").replace(_OPF, "")
                    text = "".join(x.itertext())
                    yield (
                        pub, path, ord_, section, name, x.get("id"), x.get("content") if name == "meta" and x.get("content") is not None else text, x.get("href"), x.get("media-type"),
                        x.get("property") or x.get("name") or x.get("properties"), x.get("idref"), x.get("fallback"), x.get("linear"), x.get("refines"), x.get(f"{_OPF}scheme") or x.get("scheme"), x.get(f"{_OPF}role"),
                        x.get(f"{_OPF}file-as"), x.get("{http://www.w3.org/XML/1998/namespace}lang"),
                    )

    return _rows(held, ELEMENT_SCHEMA, read)


def manifest(elements: DataFrame, entry_rows: DataFrame) -> DataFrame:
    """SRC10, JON1, FLT17: pub_id, ord, item_id, path, media_type, properties, fallback_id, exists, is_supported, is_duplicate."""
    items = elements.where("section = 'manifest' AND name = 'item'").select("pub_id", "ord", c("xml_id").alias("item_id"), archive_path(directory(c("opf_path")), c("href")).alias("path"), kinds.media_type(c("media_type")).alias("media_type"), F.coalesce("properties", F.lit("")).alias("properties"), c("fallback").alias("fallback_id"))
    there = entry_rows.where("problem IS NULL").select(c("pub_id").alias("ep"), c("path").alias("ee")).distinct()
    both = items.join(there, (c("pub_id") == c("ep")) & (c("path") == c("ee")), "left")
    nav = F.array_contains(F.split("properties", r"\s+"), "nav")
    # a description is one entry of bounded size, so the items of a publication are few
    first = F.row_number().over(Window.partitionBy("pub_id", "path").orderBy("ord"))
    return both.select("pub_id", "ord", "item_id", "path", "media_type", "properties", "fallback_id", c("ee").isNotNull().alias("exists"), F.coalesce(kinds.is_supported(c("media_type"), nav), F.lit(False)).alias("is_supported"), (c("path").isNotNull() & (first > 1)).alias("is_duplicate"))


def spine(elements: DataFrame, items: DataFrame) -> DataFrame:
    """SRC10, JON2, FLT18, WIN3, WIN4: pub_id, position, idref, path, is_linear, occurrence, problem of the places in reading order."""
    places = elements.where("section = 'spine' AND name = 'itemref'")
    place = F.row_number().over(Window.partitionBy("pub_id").orderBy("ord")) - 1
    nth = F.row_number().over(Window.partitionBy("pub_id", "idref").orderBy("ord"))
    rows = places.select("pub_id", place.alias("position"), "idref", F.coalesce(F.lower(F.trim("linear")) != "no", F.lit(True)).alias("is_linear"), nth.alias("occurrence"), "linear")
    known = items.groupBy(c("pub_id").alias("ip"), c("item_id").alias("ii")).agg(F.min_by("path", "ord").alias("path"))
    both = rows.join(known, (c("pub_id") == c("ip")) & (c("idref") == c("ii")), "left")
    problem = F.when(c("ii").isNull(), "unresolved").when(c("linear").isNotNull() & ~F.lower(F.trim("linear")).isin("yes", "no"), "invalid-linear").when(c("occurrence") > 1, "repeated")
    return both.select("pub_id", "position", "idref", "path", "is_linear", "occurrence", problem.alias("problem"))


def refinements(elements: DataFrame) -> DataFrame:
    """JON6, MET2, AGG13, AGG14: pub_id, target, property, value, ord, is_orphan: what refines which element; identifiers
    that come more than once refine nothing."""
    metas = elements.where("section = 'metadata' AND name = 'meta' AND refines IS NOT NULL").select("pub_id", F.regexp_replace("refines", "^#", "").alias("target"), c("properties").alias("property"), optional_text(c("value")).alias("value"), "ord")
    unique = elements.where("xml_id IS NOT NULL AND section <> 'package'").groupBy(c("pub_id").alias("up"), c("xml_id").alias("ui")).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return metas.join(unique, (c("pub_id") == c("up")) & (c("target") == c("ui")), "left").select("pub_id", "target", "property", "value", "ord", c("ui").isNull().alias("is_orphan"))


def refined(elements: DataFrame, name: str, single: list[str]) -> DataFrame:
    """MET4, MET5, MET10: the elements of a name with the first value of each single refinement, all roles (in any case once),
    and the single ones that come more than once."""
    known = refinements(elements).where("NOT is_orphan AND value IS NOT NULL")
    firsts = [F.min_by(F.when(c("property") == p, c("value")), F.when(c("property") == p, c("ord"))).alias("r_" + p) for p in single]
    many = F.array_compact(F.array(*[F.when(F.count_if(c("property") == p) > 1, F.lit(p)) for p in single]))
    roles = F.transform(F.array_sort(F.collect_list(F.when(c("property") == "role", F.struct("ord", F.lower("value").alias("role"))))), lambda x: x["role"])
    grouped = known.groupBy(c("pub_id").alias("rp"), c("target").alias("rt")).agg(*firsts, F.array_distinct(roles).alias("roles"), many.alias("repeated"))
    own = elements.where((c("section") == "metadata") & (c("name") == name) & is_visible(c("value")))
    both = own.join(grouped, (c("pub_id") == c("rp")) & (c("xml_id") == c("rt")), "left")
    every = F.array_distinct(F.concat(F.coalesce("roles", F.array().cast("array<string>")), F.when(c("role").isNotNull(), F.array(F.lower("role"))).otherwise(F.array().cast("array<string>"))))
    return both.select("pub_id", "ord", "xml_id", optional_text(c("value")).alias("value"), *[c(f"`r_{p}`").alias(p.replace("-", "_")) for p in single], every.alias("roles"), c("file_as").alias("own_file_as"), F.coalesce("repeated", F.array().cast("array<string>")).alias("repeated"), "lang", "scheme")


def metadata(elements: DataFrame) -> DataFrame:
    """MET1, MET3–9, JON7, SRT4: pub_id, title, subtitle, identifier, language, authors, modified, n_dates, n_bad_dates, accessibility.

    The title is that of the least sequence, of equals the first; the subtitle is one of its type. The identifier is the one
    the package names, if it is one single, else the first. Authors are creators without a role or with aut.
    """
    titles = refined(elements, "dc:title", ["title-type", "display-seq"])
    order = F.struct(F.coalesce(c("display_seq").try_cast("int"), F.lit(2**31 - 1)).alias("s"), "ord")
    is_sub = c("title_type") == "subtitle"
    title = titles.groupBy("pub_id").agg(F.coalesce(F.min_by(F.when(~F.coalesce(is_sub, F.lit(False)), c("value")), F.when(~F.coalesce(is_sub, F.lit(False)), order)), F.min_by("value", order)).alias("title"), F.min_by(F.when(is_sub, c("value")), F.when(is_sub, order)).alias("subtitle"))
    wanted = elements.where("section = 'package'").select(c("pub_id").alias("wp"), c("xml_id").alias("wanted"))
    ids = elements.where((c("section") == "metadata") & (c("name") == "dc:identifier") & is_visible(c("value"))).join(wanted, c("pub_id") == c("wp"))
    hit = F.coalesce(c("xml_id") == c("wanted"), F.lit(False))
    identifier = ids.groupBy("pub_id").agg(F.when(F.count_if(hit) == 1, F.max(F.when(hit, optional_text(c("value"))))).otherwise(F.min_by(optional_text(c("value")), "ord")).alias("identifier"))
    creators = refined(elements, "dc:creator", ["file-as"]).where((F.size("roles") == 0) | F.array_contains("roles", "aut"))
    authors = creators.groupBy("pub_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("authors"))
    plain = elements.where("section = 'metadata'")
    modified = F.coalesce(c("properties") == "dcterms:modified", F.lit(False))
    date = c("name") == "dc:date"
    access = F.coalesce(c("properties").startswith("schema:access"), F.lit(False))
    rest = plain.groupBy("pub_id").agg(
        F.min_by(F.when((c("name") == "dc:language") & kinds.is_language(F.trim("value")), F.trim("value")), F.when((c("name") == "dc:language") & kinds.is_language(F.trim("value")), c("ord"))).alias("language"),
        F.min_by(F.when(modified, F.trim("value")), F.when(modified, c("ord"))).alias("modified"), F.count_if(date).alias("n_dates"), F.count_if(date & ~F.coalesce(kinds.is_date(F.trim("value")), F.lit(False))).alias("n_bad_dates"),
        F.transform(F.array_sort(F.collect_list(F.when(access, F.struct("ord", F.concat_ws("=", "properties", F.trim("value")).alias("v"))))), lambda x: x["v"]).alias("accessibility"),
    )
    out = rest
    for part in (title, identifier, authors):
        out = out.join(part.withColumnRenamed("pub_id", "jp"), c("pub_id") == c("jp"), "left").drop("jp")
    return out


NAVIGATION_SCHEMA = "pub_id string, path string, kind string, place int, parent_place int, level int, label string, href string, entry_id string"
_NCX = "application/x-dtbncx+xml"


def navigation(entry_rows: DataFrame, items: DataFrame) -> DataFrame:
    """SRC11, CNV3–6, TRE7, SRT5: pub_id, place, level, label, target, key, kind of the table of contents of each package.

    The navigation document counts, without one that holds entries the NCX. An entry inside one of the same identifier is
    left out with all below it; entries without a link give no row, but those below them keep their level.
    """

    def read(pub: str, path: str, kind: str, data: bytes | None) -> Iterator[tuple]:
        root = parsed_xml(data)
        if root is None:
            return
        if kind == "nav":
            tops = [x for x in root.iter() if isinstance(x.tag, str) and x.tag.endswith("nav") and "toc" in (x.get("{http://www.idpf.org/2007/ops}type") or x.get("role") or "").lower().replace("doc-", "").split()]
            stack = [(li, None, 1, frozenset()) for top in tops[:1] for ol in top if _name(ol) == "ol" for li in reversed(list(ol)) if _name(li) == "li"]
        else:
            stack = [(x, None, 1, frozenset()) for top in root.iter() if _name(top) == "navMap" for x in reversed(list(top)) if _name(x) == "navPoint"]
        place = 0
        while stack:
            x, parent, level, above = stack.pop()
            own = x.get("id")
            if own is not None and own in above:
                continue
            if kind == "nav":
                link = next((y for y in x if _name(y) in ("a", "span")), None)
                label, href = ("", None) if link is None else ("".join(link.itertext()), link.get("href"))
                below = [li for ol in x if _name(ol) == "ol" for li in ol if _name(li) == "li"]
            else:
                label = "".join("".join(y.itertext()) for y in x if _name(y) == "navLabel")
                href = next((y.get("src") for y in x if _name(y) == "content"), None)
                below = [y for y in x if _name(y) == "navPoint"]
            yield pub, path, kind, place, parent, level, " ".join(label.split()), href, own
            stack += [(y, place, level + 1, above | {own} if own is not None else above) for y in reversed(below)]
            place += 1

    nav = F.array_contains(F.split("properties", r"\s+"), "nav")
    wanted = items.where("exists").select(c("pub_id").alias("ip"), c("path").alias("ipath"), F.when(nav, "nav").when(c("media_type") == _NCX, "ncx").alias("kind")).where("kind IS NOT NULL")
    held = entry_rows.where("problem IS NULL").join(wanted, (c("pub_id") == c("ip")) & (c("path") == c("ipath"))).select("pub_id", "path", "kind", "data")
    rows = _rows(held, NAVIGATION_SCHEMA, read).where("href IS NOT NULL")
    best = rows.groupBy(c("pub_id").alias("bp")).agg(F.min(F.struct("kind", "path")).alias("best"))  # nav sorts before ncx
    chosen = rows.join(best, (c("pub_id") == c("bp")) & (c("path") == c("best.path")) & (c("kind") == c("best.kind")))
    key = reference_key(c("path"), c("href"))
    return chosen.select("pub_id", "place", "level", "label", key["target"].alias("target"), key["key"].alias("key"), "kind")


def _name(x: Any) -> str:
    return x.tag.rpartition("}")[2] if isinstance(x.tag, str) else ""
