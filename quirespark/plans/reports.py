"""Queries of reports as JSON lines, and of what is read back from them, over whole tables.

A report is a row a line, which any number of tasks can write and read; none is one text for a whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.session import table

c = F.col

#: The fields of each report, in their order.
REPORTS = {
    "corpus_catalog": ["pub_id", "document_id", "title", "origin", "pub_kind", "redistribution", "relative_path", "expected_epub_version", "expected_size_bytes", "languages", "sha256"],
    "spine_decision": ["pub_id", "pos", "reading_role", "disposition", "reason", "selected_id", "selected_path", "fallback_chain"],
    "diagnostics": ["doc_id", "ord", "pass", "code", "severity", "message", "resource", "node_id", "cnt"],
    "baseline_left": ["pub_id", "status", "epub_version", "manifest_item_count", "spine_item_count", "imported_node_count", "fidelity_lost_unit_count", "document_id", "canonical_hash"],
}


def json_line(fields: list[str]) -> Column:
    """SNK1, SNK8–16: a row as JSON, its fields in order, nulls as null."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def snk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9, SNK11–13, SNK16: the lines of four reports by their digests, with how often each comes."""
    rows = None
    for name, fields in REPORTS.items():
        one = table(spark, sf_dir, name).groupBy(F.lit(name).alias("report"), F.sha2(json_line(fields), 256).alias("line_sha256")).agg(F.count("*").alias("n_lines"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


SNK_LINES = " UNION ALL ".join(
    f"SELECT '{name}' AS report, sha256(CAST(to_json({{{', '.join(f'{chr(39)}{f}{chr(39)}: {f}' for f in fields)}}}) AS VARCHAR)) AS line_sha256, count(*) AS n_lines FROM {name} GROUP BY 2" for name, fields in REPORTS.items()
)


def snk_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12–16, SNK2, INT6: of each report the rows, those that come back from their lines as they were, and those whose line,
    broken off in the middle, is refused."""
    rows = None
    for name, fields in REPORTS.items():
        df = table(spark, sf_dir, name).select(*fields)
        line = json_line(fields)
        back = F.from_json(line, df.schema, {"mode": "PERMISSIVE"})
        whole = F.forall(F.array(*[back[f].eqNullSafe(c(f)) for f in fields]), lambda x: x)
        broken = F.from_json(F.substring(line, 1, 9), df.schema)
        refused = F.forall(F.array(*[broken[f].isNull() for f in fields]), lambda x: x)
        one = df.agg(F.lit(name).alias("report"), F.count("*").alias("n_rows"), F.count_if(whole).alias("n_equal"), F.count_if(refused).alias("n_refused"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


SNK_READ_BACK = " UNION ALL ".join(f"SELECT '{name}' AS report, count(*) AS n_rows, count(*) AS n_equal, count(*) AS n_refused FROM {name}" for name in REPORTS)


def agg_json_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10: in how many payloads each field name comes, in how many more than once, and how often at most."""
    names = F.regexp_extract_all(F.col("payload"), F.lit(r'"([A-Za-z_]+)"\s*:'), F.lit(1))
    each = table(spark, sf_dir, "evidence_raw").where("payload IS NOT NULL").select("record_id", F.explode(names).alias("name"))
    counted = each.groupBy("record_id", "name").agg(F.count("*").alias("n"))
    return counted.groupBy("name").agg(F.count("*").alias("n_records"), F.count_if(c("n") > 1).alias("n_repeated"), F.max("n").alias("most"))


AGG_JSON_NAMES = r"""SELECT name, count(*) AS n_records, count(*) FILTER (WHERE n > 1) AS n_repeated, max(n) AS most FROM (SELECT record_id, name, count(*) AS n
  FROM (SELECT record_id, unnest(regexp_extract_all(payload, '"([A-Za-z_]+)"\s*:', 1)) AS name FROM evidence_raw WHERE payload IS NOT NULL) GROUP BY 1, 2) GROUP BY 1"""

QUERIES = {f.__name__: f for f in (snk_lines, snk_read_back, agg_json_names)}
SQL = {"snk_lines": SNK_LINES, "snk_read_back": SNK_READ_BACK, "agg_json_names": AGG_JSON_NAMES}
