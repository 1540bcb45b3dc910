"""Queries of the aggregations, ordered state, sorts and set operations, over the whole diagnostics, decisions, catalog and copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import kinds, text
from quirespark.functions.codes import CODES, diagnostic_codes
from quirespark.operators.diff import compared_fields, differences
from quirespark.operators.measures import allocated, measured, normalized_levels, repeated, summary, worst
from quirespark.operators.ordered import numbered, preceded, running
from quirespark.plans.core_problems import BASELINE_COUNTS, differences_sql
from quirespark.session import cut, table

c = F.col


def agg_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2, AGG6, AGG21: rows and counted findings by code, severity and pass."""
    return table(spark, sf_dir, "diagnostics").groupBy(F.coalesce("code", F.lit("none")).alias("code"), "severity", "pass").agg(F.count("*").alias("n_rows"), F.sum("cnt").alias("n_findings"))


AGG_CODES = "SELECT coalesce(code, 'none') AS code, severity, pass, count(*) AS n_rows, CAST(sum(cnt) AS BIGINT) AS n_findings FROM diagnostics GROUP BY 1, 2, 3"


def agg_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19, AGG42: counted findings by code, resource, message and severity."""
    return table(spark, sf_dir, "diagnostics").groupBy("code", "resource", "message", "severity").agg(F.sum("cnt").alias("n_findings"))


AGG_FINDINGS = "SELECT code, resource, message, severity, CAST(sum(cnt) AS BIGINT) AS n_findings FROM diagnostics GROUP BY ALL"

SEVERITIES = ("error", "warning", "information", "fatal")


def agg_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG20: counted findings of each severity there is, 0 for those that didn't come."""
    found = table(spark, sf_dir, "diagnostics").groupBy("severity").agg(F.sum("cnt").alias("n"))
    every = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return every.join(found, "severity", "left").select("severity", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_findings"))


AGG_SEVERITIES = f"SELECT s.severity, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS n_findings FROM (VALUES {', '.join(f"('{s}')" for s in SEVERITIES)}) AS s(severity) LEFT JOIN diagnostics d ON d.severity = s.severity GROUP BY 1"


def agg_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11: the resource of each document with the most rows, the least path of equals, with its share of the findings."""
    by = table(spark, sf_dir, "diagnostics").where("resource IS NOT NULL").groupBy("doc_id", "resource").agg(F.count("*").alias("n"), F.sum("cnt").alias("k"))
    top = by.groupBy("doc_id").agg(F.min(F.struct((-c("n")).alias("n"), "resource", "k")).alias("top"), F.sum("k").alias("every"))
    return top.select("doc_id", c("top.resource").alias("resource"), (-c("top.n")).alias("n_rows"), c("top.k").alias("n_findings"), c("every").alias("n_all"))


AGG_RESOURCES = """SELECT doc_id, resource, n AS n_rows, CAST(k AS BIGINT) AS n_findings, CAST(sum(k) OVER (PARTITION BY doc_id) AS BIGINT) AS n_all
FROM (SELECT doc_id, resource, count(*) AS n, sum(cnt) AS k FROM diagnostics WHERE resource IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, resource) = 1"""


def agg_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4, AGG32, SRT2, WIN7: equal texts as one candidate with its copies, sorted by digest and numbered."""
    texts = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    groups = texts.groupBy(text.sha256_hex(c("text")).alias("sha256")).agg(F.count("*").alias("copy_count"), F.min("doc_id").alias("doc_id"), F.min(F.octet_length("text")).cast("bigint").alias("n_bytes"))
    return numbered(groups, [], ["sha256"]).select(F.format_string("candidate-%04d", "number").alias("candidate_id"), "sha256", "copy_count", "doc_id", "n_bytes")


AGG_INVENTORY = """SELECT printf('candidate-%04d', row_number() OVER (ORDER BY sha256)) AS candidate_id, sha256, copy_count, doc_id, n_bytes
FROM (SELECT upper(sha256(text)) AS sha256, count(*) AS copy_count, min(doc_id) AS doc_id, CAST(min(strlen(text)) AS BIGINT) AS n_bytes FROM documents WHERE text IS NOT NULL GROUP BY 1)"""


def agg_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5, AGG7–9, AGG13, AGG18, AGG24, SET7: keys that come more than once, in four tables."""
    found = [
        repeated(table(spark, sf_dir, "spine_decision"), F.concat_ws("/", "pub_id", "pos")), repeated(table(spark, sf_dir, "baseline_left"), F.lower(F.trim("pub_id"))),
        repeated(table(spark, sf_dir, "metadata_results"), c("pub_id")), repeated(table(spark, sf_dir, "corpus_catalog"), F.lower("relative_path")),
    ]
    named = [f.withColumn("tab_name", F.lit(n)) for f, n in zip(found, ("spine_decision", "baseline_left", "metadata_results", "corpus_catalog"), strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


AGG_REPEATED = " UNION ALL ".join(
    f"SELECT '{t}' AS tab_name, {k} AS key, count(*) AS n_rows FROM {t} WHERE {k} IS NOT NULL GROUP BY 2 HAVING count(*) > 1"
    for t, k in (("spine_decision", "concat_ws('/', pub_id, pos)"), ("baseline_left", "lower(trim(pub_id))"), ("metadata_results", "pub_id"), ("corpus_catalog", "lower(relative_path)"))
)


def agg_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1, AGG12, SRT7, JON17, JON26: for each node that is named, the sorted documents and resources it is named in."""
    named = table(spark, sf_dir, "diagnostics").where("node_id IS NOT NULL").select("node_id", F.concat_ws("#", "doc_id", "resource").alias("place")).distinct()
    return named.groupBy("node_id").agg(F.count("*").alias("n_places"), F.min("place").alias("first_place"), text.sha256_hex(F.array_join(F.array_sort(F.collect_list("place")), "|")).alias("places_sha256"))


AGG_PLACES = """SELECT node_id, count(*) AS n_places, min(place) AS first_place, upper(sha256(string_agg(place, '|' ORDER BY place))) AS places_sha256
FROM (SELECT DISTINCT node_id, concat_ws('#', doc_id, resource) AS place FROM diagnostics WHERE node_id IS NOT NULL) GROUP BY 1"""


def agg_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14, AGG16, AGG17, SRT4, MET4: of each publication the title that comes first: by its sequence, without one last."""
    order = F.struct(F.coalesce("display_sequence", F.lit(2**31 - 1)).alias("s"), c("title_id").alias("i"))
    titles = table(spark, sf_dir, "title_metadata").where(text.is_visible(c("title_value")))
    rows = titles.groupBy("pub_id").agg(F.min_by("title_value", order).alias("title"), F.min_by(F.when(c("title_type") == "subtitle", c("title_value")), F.when(c("title_type") == "subtitle", order)).alias("subtitle"), F.count("*").alias("n_titles"))
    return rows.select("pub_id", "title", "subtitle", "n_titles")


AGG_FIRST = """SELECT pub_id, arg_min(title_value, k) AS title, arg_min(title_value, k) FILTER (WHERE title_type = 'subtitle') AS subtitle, count(*) AS n_titles
FROM (SELECT *, coalesce(display_sequence, 2147483647)::HUGEINT * 1000000000000 + title_id AS k FROM title_metadata WHERE trim(title_value) <> '') GROUP BY pub_id"""


def agg_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15, AGG35, AGG36: resources by ending, and by what they are, for each pass."""
    ending = F.lower(F.regexp_extract("resource", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ending.isin("xhtml", "html"), "page").when(ending == "css", "style").when(ending.isin("png", "jpg", "svg", "gif"), "image").when(ending == "ncx", "navigation").when(ending == "opf", "package").otherwise("other")
    rows = table(spark, sf_dir, "diagnostics").where("resource IS NOT NULL").select("pass", ending.alias("ending"), kind.alias("kind"), "resource").distinct()
    return rows.groupBy("pass", "kind", "ending").agg(F.count("*").alias("n_resources"))


AGG_ENDINGS = r"""SELECT pass, kind, ending, count(DISTINCT resource) AS n_resources FROM (SELECT pass, resource, ending, CASE WHEN ending IN ('xhtml', 'html') THEN 'page' WHEN ending = 'css' THEN 'style'
  WHEN ending IN ('png', 'jpg', 'svg', 'gif') THEN 'image' WHEN ending = 'ncx' THEN 'navigation' WHEN ending = 'opf' THEN 'package' ELSE 'other' END AS kind
  FROM (SELECT *, lower(regexp_extract(resource, '\.([A-Za-z0-9]+)$', 1)) AS ending FROM diagnostics WHERE resource IS NOT NULL)) GROUP BY ALL"""


def agg_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG29, AGG31, AGG37: produced characters, texts and kinds of texts of each publication."""
    rows = table(spark, sf_dir, "documents")
    score = sum((F.max(F.when(c("source") == s, 1).otherwise(0)) for s in ("chapter", "blurb", "footnote", "report")), F.lit(0))
    return rows.groupBy("pub_id").agg(F.sum(F.coalesce(text.utf16_length(c("text")), F.lit(0))).alias("n_characters"), F.count("*").alias("n_texts"), F.count_if(~text.is_visible(c("text"))).alias("n_blank"), score.cast("int").alias("n_kinds"))


AGG_CHARACTERS = f"""SELECT pub_id, CAST(sum(coalesce(length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')), 0)) AS BIGINT) AS n_characters, count(*) AS n_texts,
  count(*) FILTER (WHERE NOT coalesce(regexp_matches(text, '{text.VISIBLE}'), false)) AS n_blank,
  CAST({' + '.join(f"max(CASE WHEN source = '{s}' THEN 1 ELSE 0 END)" for s in ('chapter', 'blurb', 'footnote', 'report'))} AS INTEGER) AS n_kinds FROM documents GROUP BY pub_id"""

#: From the least to the worst.
STATUSES = ("passed", "skipped", "inconclusive", "failed")


def agg_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG33, AGG34, AGG38, AGG39: the worst status of each publication by a fixed order, and how many copies say what."""
    return worst(table(spark, sf_dir, "baseline_left").select(F.lower(F.trim("pub_id")).alias("pub_id"), "status"), ["pub_id"], "status", STATUSES)


AGG_STATUSES = f"""SELECT pub_id, (['none', {', '.join(f"'{s}'" for s in STATUSES)}])[max(r) + 1] AS worst, {', '.join(f"count(*) FILTER (WHERE r = {i}) AS n_{s}" for i, s in enumerate(STATUSES, 1))}
FROM (SELECT lower(trim(pub_id)) AS pub_id, coalesce(list_position([{', '.join(f"'{s}'" for s in STATUSES)}], status), 0) AS r FROM baseline_left) GROUP BY pub_id"""


def agg_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3, AGG40, AGG41: of each document and pass, the microseconds between what is logged and received: sum, longest, rows."""
    span = F.unix_micros(c("received_at").cast("timestamp")) - F.unix_micros(c("logged_at").cast("timestamp"))
    return table(spark, sf_dir, "diagnostics").groupBy("doc_id", "pass").agg(F.sum(span).alias("total_us"), F.max(span).alias("longest_us"), F.count(span).alias("n_timed"))


AGG_PHASES = "SELECT doc_id, pass, CAST(sum(s) AS BIGINT) AS total_us, max(s) AS longest_us, count(s) AS n_timed FROM (SELECT *, epoch_us(received_at) - epoch_us(logged_at) AS s FROM diagnostics) GROUP BY 1, 2"


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What each pass says: the first what was there, with a status that is forced on errors; the second what came out."""
    rows = table(spark, sf_dir, "diagnostics").where("code IS NOT NULL AND cnt > 0")
    forced = F.when(c("severity") == "error", "unsupported").when(c("severity") == "information", "approximated")
    source = rows.where("pass = 'first'").select(c("code").alias("metric"), F.coalesce("resource", F.lit("")).alias("resource"), forced.alias("forced"), "cnt")
    return source.groupBy("metric", "resource", "forced").agg(F.sum("cnt").alias("n")), rows.where("pass = 'second'").groupBy(c("code").alias("metric")).agg(F.sum("cnt").alias("n"))


def agg_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG25–27, QLT6: by code, what was there, what came out, and what is preserved, approximated, unsupported and lost."""
    return measured(*_sources(spark, sf_dir))


_SOURCES = """source AS (SELECT code AS metric, coalesce(resource, '') AS resource, CASE severity WHEN 'error' THEN 'unsupported' WHEN 'information' THEN 'approximated' END AS forced, sum(cnt) AS n
  FROM diagnostics WHERE code IS NOT NULL AND cnt > 0 AND pass = 'first' GROUP BY ALL),
  came AS (SELECT code AS metric, sum(cnt) AS n FROM diagnostics WHERE code IS NOT NULL AND cnt > 0 AND pass = 'second' GROUP BY 1),
  m AS (SELECT metric, total, destination, approximated, unsupported, least(total - approximated - unsupported, destination) AS preserved, total - approximated - unsupported - least(total - approximated - unsupported, destination) AS lost,
    greatest(destination - total, 0) AS excess
    FROM (SELECT s.metric, sum(s.n) AS total, coalesce(max(c.n), 0) AS destination, coalesce(sum(s.n) FILTER (WHERE forced = 'approximated'), 0) AS approximated, coalesce(sum(s.n) FILTER (WHERE forced = 'unsupported'), 0) AS unsupported
      FROM source s LEFT JOIN came c ON c.metric = s.metric GROUP BY 1))"""
_MEASURES = "total destination approximated unsupported preserved lost excess".split()
AGG_MEASURES = f"WITH {_SOURCES} SELECT metric, {', '.join(f'CAST({x} AS BIGINT) AS {x}' for x in _MEASURES)} FROM m"


def agg_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG28: the sums of all measures and the share that is preserved, cut off after six places."""
    return summary(agg_measures(spark, sf_dir))


AGG_SUMMARY = f"""WITH {_SOURCES} SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(preserved) AS BIGINT) AS preserved, CAST(sum(lost) AS BIGINT) AS lost,
  CASE WHEN sum(total) = 0 THEN 100.0 ELSE CAST((CAST(sum(preserved) AS HUGEINT) * 100000000) // CAST(sum(total) AS HUGEINT) AS DOUBLE) / 1000000 END AS preserved_percent FROM m"""


def win_allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN11, QLT7: what is lost of each code, given to its resources in order of their paths until nothing is left."""
    source, came = _sources(spark, sf_dir)
    return allocated(source.groupBy("metric", "resource").agg(F.sum("n").alias("n")), measured(source, came).select("metric", c("lost").alias("most")))


WIN_ALLOCATED = f"""WITH {_SOURCES} SELECT metric, resource, CAST(least(n, lost - before) AS BIGINT) AS allocated
FROM (SELECT r.metric, resource, r.n, lost, coalesce(sum(r.n) OVER (PARTITION BY r.metric ORDER BY resource ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT metric, resource, sum(n) AS n FROM source GROUP BY 1, 2) r JOIN m ON m.metric = r.metric) WHERE lost > before"""

_ORDER = ["ord", "pass", "code", "severity", "message", "resource", "node_id", "cnt", "logged_at", "received_at"]
_SQL_ORDER = ", ".join(f"{x} NULLS FIRST" for x in _ORDER)


def _leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "diagnostics").select("doc_id", *_ORDER).distinct()
    return rows.withColumn("level", (F.coalesce("cnt", F.lit(0)) % 6 + 1).cast("int"))


def win_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1, WIN2, FLT5: levels along each document brought down to one below the level before, and where they jump."""
    rows = preceded(normalized_levels(_leveled(spark, sf_dir), ["doc_id"], _ORDER, "level"), ["doc_id"], _ORDER, {"level_before": "level"})
    jumps = F.coalesce(c("level") > c("level_before") + 1, F.lit(False))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.sum("normal_level").alias("normal_levels"), F.sum("level").alias("levels"), F.count_if(jumps).alias("n_jumps"))


WIN_LEVELS = f"""WITH RECURSIVE l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {_SQL_ORDER}) AS i, coalesce(cnt, 0) % 6 + 1 AS level FROM (SELECT DISTINCT doc_id, {', '.join(_ORDER)} FROM diagnostics)),
  w AS (SELECT doc_id, i, level, least(level, 1) AS normal FROM l WHERE i = 1 UNION ALL SELECT l.doc_id, l.i, l.level, least(l.level, w.normal + 1) FROM w JOIN l ON l.doc_id IS NOT DISTINCT FROM w.doc_id AND l.i = w.i + 1)
SELECT doc_id, count(*) AS n_rows, CAST(sum(normal) AS BIGINT) AS normal_levels, CAST(sum(level) AS BIGINT) AS levels, CAST(sum(jump) AS BIGINT) AS n_jumps
FROM (SELECT *, CASE WHEN level > lag(level) OVER (PARTITION BY doc_id ORDER BY i) + 1 THEN 1 ELSE 0 END AS jump FROM w) GROUP BY doc_id"""


def win_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN3–6, FLT18: which time an item comes in its spine, and the name that tells it from the others."""
    rows = table(spark, sf_dir, "spine_decision").select("pub_id", "pos", "selected_id", "selected_path", "disposition").distinct()
    nth = numbered(rows, ["pub_id", "selected_id"], ["pos", "disposition", "selected_path"], "occurrence")
    name = F.when(c("selected_id").isNull(), F.concat(F.lit("missing-spine-"), c("pos") + 1)).when(c("occurrence") == 1, c("selected_id")).otherwise(F.concat(c("selected_id"), F.lit("-occurrence-"), c("occurrence")))
    return nth.select("pub_id", "pos", "selected_id", "occurrence", name.alias("stable_name"), (c("occurrence") > 1).alias("is_repeated"))


WIN_OCCURRENCES = """SELECT pub_id, pos, selected_id, occurrence, CASE WHEN selected_id IS NULL THEN 'missing-spine-' || (pos + 1) WHEN occurrence = 1 THEN selected_id ELSE selected_id || '-occurrence-' || occurrence END AS stable_name,
  occurrence > 1 AS is_repeated FROM (SELECT *, row_number() OVER (PARTITION BY pub_id, selected_id ORDER BY pos, disposition NULLS FIRST, selected_path NULLS FIRST) AS occurrence
  FROM (SELECT DISTINCT pub_id, pos, selected_id, selected_path, disposition FROM spine_decision))"""


def win_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN12, SRT8, SRT9: the texts of each publication, in order, that still fit a budget of characters."""
    rows = running(table(spark, sf_dir, "documents").select("pub_id", "doc_id", "n_chars"), ["pub_id"], ["doc_id"], {"so_far": ("sum", c("n_chars")), "number": ("count", F.lit(1))})
    return rows.select("pub_id", "doc_id", "number", F.coalesce("so_far", F.lit(0).cast("bigint")).alias("so_far"), (F.coalesce("so_far", F.lit(0)) <= 2000).alias("fits"))


WIN_BUDGET = """SELECT pub_id, doc_id, row_number() OVER w AS number, CAST(coalesce(sum(n_chars) OVER w, 0) AS BIGINT) AS so_far, coalesce(sum(n_chars) OVER w, 0) <= 2000 AS fits
FROM documents WINDOW w AS (PARTITION BY pub_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING)"""


def win_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN8–10: chapters of each publication numbered, with their file names, progress, and the first, middle and last marked."""
    rows = cut(numbered(table(spark, sf_dir, "documents").where("source = 'chapter'").select("pub_id", "doc_id"), ["pub_id"], ["doc_id"]))
    counts = rows.groupBy(c("pub_id").alias("of")).agg(F.count("*").alias("n"))
    sample = F.when(c("number") == 1, "beginning").when(c("number") == c("n"), "end").when(c("number") == F.floor((c("n") - 1) / 2) + 1, "middle")
    both = rows.join(counts, c("pub_id").eqNullSafe(c("of")))
    return both.select("pub_id", "doc_id", F.format_string("chapters/chapter-%03d.html", "number").alias("file_name"), F.concat_ws(" / ", c("number").cast("string"), c("n").cast("string")).alias("progress"), sample.alias("sample"))


WIN_CHAPTERS = """SELECT pub_id, doc_id, printf('chapters/chapter-%03d.html', number) AS file_name, number || ' / ' || n AS progress,
  CASE WHEN number = 1 THEN 'beginning' WHEN number = n THEN 'end' WHEN number = (n - 1) // 2 + 1 THEN 'middle' END AS sample
FROM (SELECT pub_id, doc_id, row_number() OVER (PARTITION BY pub_id ORDER BY doc_id) AS number, count(*) OVER (PARTITION BY pub_id) AS n FROM documents WHERE source = 'chapter')"""


def win_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN13, SET4: how many places of the spines of two runs of a publication agree; a run is the decisions of even or odd rows."""
    rows = table(spark, sf_dir, "spine_decision").select("pub_id", "pos", F.coalesce("selected_path", F.lit("")).alias("path"), F.coalesce("disposition", F.lit("")).alias("what"))
    one = rows.groupBy("pub_id", "pos").agg(F.min("path").alias("a"), F.max("path").alias("b"), F.min("what").alias("wa"), F.max("what").alias("wb"))
    return one.groupBy("pub_id").agg(F.count("*").alias("n_places"), F.count_if((c("a") == c("b")) & (c("wa") == c("wb"))).alias("n_equal"))


WIN_SEQUENCES = """SELECT pub_id, count(*) AS n_places, count(*) FILTER (WHERE a = b AND wa = wb) AS n_equal FROM (SELECT pub_id, pos, min(coalesce(selected_path, '')) AS a, max(coalesce(selected_path, '')) AS b,
  min(coalesce(disposition, '')) AS wa, max(coalesce(disposition, '')) AS wb FROM spine_decision GROUP BY 1, 2) GROUP BY 1"""


def win_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN14, QLT13: whether all captures of a publication in both copies have one digest."""
    digest = F.upper(F.regexp_replace(F.trim("canonical_hash"), "^[A-Za-z0-9-]+:", ""))
    rows = [table(spark, sf_dir, f"baseline_{s}").select(F.lower(F.trim("pub_id")).alias("pub_id"), F.nullif(digest, F.lit("")).alias("digest")) for s in ("left", "right")]
    return rows[0].unionAll(rows[1]).groupBy("pub_id").agg(F.count("*").alias("n_runs"), F.count_distinct("digest").alias("n_digests"), (F.count_distinct("digest") <= 1).alias("is_stable"))


WIN_RUNS = " ".join("""SELECT pub_id, count(*) AS n_runs, count(DISTINCT d) AS n_digests, count(DISTINCT d) <= 1 AS is_stable FROM (SELECT lower(trim(pub_id)) AS pub_id,
  nullif(upper(regexp_replace(trim(canonical_hash), '^[A-Za-z0-9-]+:', '')), '') AS d FROM (SELECT pub_id, canonical_hash FROM baseline_left UNION ALL SELECT pub_id, canonical_hash FROM baseline_right)) GROUP BY 1""".split())


def jon_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON21, SRT6, QLT40: the differences of the copies with the values on both sides, in the order of publication and field."""
    left, right = table(spark, sf_dir, "baseline_left"), table(spark, sf_dir, "baseline_right")
    fields = compared_fields(left.columns, ["pub_id", "captured_at"], BASELINE_COUNTS, ["canonical_hash"])
    return differences(left, right, "pub_id", "captured_at", fields, values=True).orderBy("pub_id", "field_name")


def set_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET1–3, SET5, SET6, SET8: codes of two passes of a document: common to both, in one only, and all of them."""
    rows = table(spark, sf_dir, "diagnostics").where("code IS NOT NULL AND pass IN ('first', 'second')").groupBy("doc_id", "code").agg(F.bool_or(c("pass") == "first").alias("a"), F.bool_or(c("pass") == "second").alias("b"))
    return rows.groupBy("doc_id").agg(
        F.count_if(c("a") & c("b")).alias("n_common"), F.count_if(c("a") & ~c("b")).alias("n_missing"), F.count_if(~c("a") & c("b")).alias("n_new"), F.count("*").alias("n_all"),
        F.array_join(F.array_sort(F.collect_set(F.when(c("a") & ~c("b"), c("code")))), ",").alias("missing"),
    )


SET_CODES = """SELECT doc_id, count(*) FILTER (WHERE a AND b) AS n_common, count(*) FILTER (WHERE a AND NOT b) AS n_missing, count(*) FILTER (WHERE b AND NOT a) AS n_new, count(*) AS n_all,
  coalesce(string_agg(code, ',' ORDER BY code) FILTER (WHERE a AND NOT b), '') AS missing
FROM (SELECT doc_id, code, bool_or(pass = 'first') AS a, bool_or(pass = 'second') AS b FROM diagnostics WHERE code IS NOT NULL AND pass IN ('first', 'second') GROUP BY 1, 2) GROUP BY 1"""


def srt_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT1, SRT3, SRT5: the one publication that comes first by eight keys, of all in the catalog."""
    keys = [c("is_page").desc(), c("n_languages").desc(), c("expected_size_bytes").desc_nulls_last(), c("title").asc_nulls_last(), c("origin").asc_nulls_last(), c("pub_kind").asc_nulls_last(), c("relative_path").asc_nulls_last(), c("pub_id").asc()]
    rows = table(spark, sf_dir, "corpus_catalog").select("*", (c("expected_epub_version") == "epub3").cast("int").alias("is_page"), F.size(F.array_distinct(F.coalesce("languages", F.array().cast("array<string>")))).alias("n_languages"))
    return rows.withColumn("is_page", F.coalesce("is_page", F.lit(0))).orderBy(*keys).limit(1).select("pub_id", "n_languages", "expected_size_bytes")


SRT_TOP = """SELECT pub_id, CAST(n AS INTEGER) AS n_languages, expected_size_bytes FROM (SELECT *, coalesce(CAST(expected_epub_version = 'epub3' AS INTEGER), 0) AS is_page,
  coalesce(len(list_distinct(languages)) + CAST(len(list_filter(languages, lambda x: x IS NULL)) > 0 AS INTEGER), 0) AS n FROM corpus_catalog)
ORDER BY is_page DESC, n DESC, expected_size_bytes DESC NULLS LAST, title NULLS LAST, origin NULLS LAST, pub_kind NULLS LAST, relative_path NULLS LAST, pub_id LIMIT 1"""



def agg_known_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CODES: the findings of each code there is, with its name and family; codes that aren't known have neither."""
    found = table(spark, sf_dir, "diagnostics").groupBy(c("code").alias("found")).agg(F.count("*").alias("n_rows"))
    both = diagnostic_codes(spark).join(found, c("code") == c("found"), "full")
    return both.select(F.coalesce("code", "found").alias("code"), "name", "family", F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"))


_CODE_ROWS = ", ".join("('" + line.replace(" ", "', '") + "')" for line in CODES.strip().splitlines())
AGG_KNOWN_CODES = f"""SELECT coalesce(k.code, d.code) AS code, name, CASE WHEN k.code IS NOT NULL THEN regexp_extract(k.code, '^([A-Z]+)', 1) END AS family, coalesce(n, 0) AS n_rows
FROM (VALUES {_CODE_ROWS}) AS k(code, name) FULL JOIN (SELECT code, count(*) AS n FROM diagnostics GROUP BY 1) d ON d.code = k.code"""

QUERIES = {f.__name__: f for f in (
    agg_codes, agg_findings, agg_severities, agg_resources, agg_inventory, agg_repeated, agg_places, agg_first, agg_endings, agg_characters, agg_statuses, agg_phases, agg_measures, agg_summary,
    win_allocated, win_levels, win_occurrences, win_budget, win_chapters, win_sequences, win_runs, jon_baseline, set_codes, srt_top, agg_known_codes,
)}
SQL = {
    "agg_codes": AGG_CODES, "agg_findings": AGG_FINDINGS, "agg_severities": AGG_SEVERITIES, "agg_resources": AGG_RESOURCES, "agg_inventory": AGG_INVENTORY, "agg_repeated": AGG_REPEATED, "agg_places": AGG_PLACES,
    "agg_first": AGG_FIRST, "agg_endings": AGG_ENDINGS, "agg_characters": AGG_CHARACTERS, "agg_statuses": AGG_STATUSES, "agg_phases": AGG_PHASES, "agg_measures": AGG_MEASURES, "agg_summary": AGG_SUMMARY,
    "win_allocated": WIN_ALLOCATED, "win_levels": WIN_LEVELS, "win_occurrences": WIN_OCCURRENCES, "win_budget": WIN_BUDGET, "win_chapters": WIN_CHAPTERS, "win_sequences": WIN_SEQUENCES, "win_runs": WIN_RUNS,
    "jon_baseline": differences_sql(both_values=True), "set_codes": SET_CODES, "srt_top": SRT_TOP, "agg_known_codes": AGG_KNOWN_CODES,
}
