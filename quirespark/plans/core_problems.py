"""Queries of the general data problems, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirespark.operators.diff import compared_fields, differences
from quirespark.operators.nested import REPORT_SHAPE, child_table, report_items
from quirespark.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_items(table(spark, sf_dir, "evidence_raw"))


#: A walk over the JSON trees of all payloads and of the texts in them that are JSON: record_id, path in small letters, type, value.
_JSON_TREE = r"""
WITH RECURSIVE raw AS (SELECT record_id, ltrim(payload, chr(65279) || ' ') AS t FROM evidence_raw WHERE payload IS NOT NULL),
 texts AS (SELECT record_id, t FROM raw WHERE json_valid(t)
  UNION ALL SELECT record_id, ltrim(json_extract_string(t, '$'), chr(65279) || ' ') FROM texts WHERE json_type(t) = 'VARCHAR' AND json_valid(json_extract_string(t, '$'))),
 held AS (SELECT record_id, '' AS prefix, t FROM texts WHERE json_type(t) = 'OBJECT'
  UNION ALL SELECT record_id, prefix || substr(fullkey, 2), atom FROM (SELECT record_id, prefix, j.fullkey, json_extract_string(j.atom, '$') AS atom FROM held, json_tree(t) j WHERE j.type = 'VARCHAR') WHERE regexp_matches(atom, '^[\[{]') AND json_valid(atom)),
 tree AS (SELECT record_id, lower(replace(prefix || substr(j.fullkey, 2), '_', '')) AS k, j.type, json_extract_string(j.atom, '$') AS v FROM held, json_tree(t) j),
"""
P1_FOUND_SQL = _JSON_TREE + r""" items AS (SELECT *, regexp_extract(k, 'publications(?:\[(\d+)\])?\.', 1) AS p, regexp_extract(k, '(orderednodeids|orderedchapterids|fallbackchain)', 1) AS l,
   regexp_extract(k, '(?:orderednodeids|orderedchapterids|fallbackchain)\[(\d+)\]', 1) AS i, regexp_extract(k, '^(.*\.spine(?:\[\d+\])?)\.', 1) AS s
  FROM tree WHERE regexp_matches(k, 'publications(\[\d+\])?\.(evidence\.semantic\.(orderednodeids|orderedchapterids)|packageprocessing\.spine(\[\d+\])?\.fallbackchain)(\[\d+\])?(\.(id|nodeid|chapterid|itemid))?$') AND type NOT IN ('OBJECT', 'ARRAY', 'NULL')),
 positions AS (SELECT record_id, regexp_extract(k, '^(.*)\.position$', 1) AS s, v FROM tree WHERE regexp_matches(k, '\.spine(\[\d+\])?\.position$'))
SELECT i.record_id, CAST(coalesce(nullif(p, ''), '0') AS INTEGER) AS pub_ord, CASE l WHEN 'orderednodeids' THEN 'node' WHEN 'orderedchapterids' THEN 'chapter' ELSE 'fallback' END AS list_name,
 CASE WHEN l = 'fallbackchain' THEN coalesce(TRY_CAST(x.v AS INTEGER), TRY_CAST(regexp_extract(i.s, '\[(\d+)\]$', 1) AS INTEGER), 0) ELSE -1 END AS parent_pos,
 CAST(coalesce(nullif(i.i, ''), '0') AS INTEGER) AS item_ord, i.v AS item_id
FROM items i LEFT JOIN positions x ON x.record_id = i.record_id AND x.s = i.s
"""
P1_DECISIONS_SQL = _JSON_TREE + r""" decisions AS (SELECT DISTINCT record_id, k FROM tree WHERE regexp_matches(k, 'publications(\[\d+\])?\.packageprocessing\.spine(\[\d+\])$') OR regexp_matches(k, 'publications(\[\d+\])?\.packageprocessing\.spine$') AND type = 'OBJECT'),
 fields AS (SELECT record_id, regexp_extract(k, '^(.*)\.[a-z]+$', 1) AS up, regexp_extract(k, '\.([a-z]+)$', 1) AS f, max(v) AS v FROM tree WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL') GROUP BY 1, 2, 3),
 placed AS (SELECT *, regexp_extract(k, '^(.*publications(?:\[\d+\])?)\.', 1) AS pub FROM decisions)
SELECT d.record_id, CAST(coalesce(nullif(regexp_extract(d.k, 'publications\[(\d+)\]', 1), ''), '0') AS BIGINT) AS publications_ord, i.v AS publications_id, s.v AS publications_status,
 CAST(coalesce(nullif(regexp_extract(d.k, 'spine\[(\d+)\]$', 1), ''), '0') AS BIGINT) AS publications_packageprocessing_spine_ord, CAST(p.v AS BIGINT) AS publications_packageprocessing_spine_position,
 a.v AS publications_packageprocessing_spine_disposition, b.v AS publications_packageprocessing_spine_reason, r.v AS publications_packageprocessing_spine_readingrole
FROM placed d LEFT JOIN fields i ON i.record_id = d.record_id AND i.up = d.pub AND i.f = 'id' LEFT JOIN fields s ON s.record_id = d.record_id AND s.up = d.pub AND s.f = 'status'
 LEFT JOIN fields p ON p.record_id = d.record_id AND p.up = d.k AND p.f = 'position'
 LEFT JOIN fields a ON a.record_id = d.record_id AND a.up = d.k AND a.f = 'disposition'
 LEFT JOIN fields b ON b.record_id = d.record_id AND b.up = d.k AND b.f = 'reason'
 LEFT JOIN fields r ON r.record_id = d.record_id AND r.up = d.k AND r.f = 'readingrole'
"""


def p1_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return child_table(table(spark, sf_dir, "evidence_raw"), ["record_id"], "payload", REPORT_SHAPE, "publications.packageprocessing.spine")


BASELINE_COUNTS = (
    "manifest_item_count spine_item_count imported_node_count imported_asset_count validation_diagnostic_count fidelity_lost_unit_count"
).split()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = table(spark, sf_dir, "baseline_left"), table(spark, sf_dir, "baseline_right")
    fields = compared_fields(left.columns, ["pub_id", "captured_at"], BASELINE_COUNTS, ["canonical_hash"])
    return differences(left, right, "pub_id", "captured_at", fields)


def differences_sql(both_values: bool = False) -> str:
    fields = ["status", "epub_version", *BASELINE_COUNTS, "document_id", "canonical_hash"]

    def value(name: str) -> str:
        if name in BASELINE_COUNTS:
            bare = f"trim(CAST({name} AS VARCHAR))"
            return f"TRY_CAST(CASE WHEN regexp_matches({bare}, '^[0-9]{{1,3}}(,[0-9]{{3}})+$') THEN replace({bare}, ',', '') ELSE ltrim({bare}, '+') END AS DECIMAL(38,6))"
        if name == "canonical_hash":
            return f"nullif(upper(trim(regexp_replace(trim({name}), '^[A-Za-z0-9-]+:', ''))), '')"
        return f"CASE WHEN trim({name}) <> '' THEN {name} END"

    order = ", ".join(["captured_at DESC", *[f"{value(f)} DESC NULLS LAST" for f in fields]])
    side = "SELECT lower(trim(pub_id)) AS k, {values} FROM baseline_{side} QUALIFY row_number() OVER (PARTITION BY lower(trim(pub_id)) ORDER BY {order}) = 1"
    values = ", ".join(f"{value(f)} AS {f}" for f in fields)
    none = ", CAST(NULL AS VARCHAR) AS left_value, CAST(NULL AS VARCHAR) AS right_value" if both_values else ""

    def both(name: str) -> str:
        one = [f"CAST(CAST({s}.{name} AS BIGINT) AS VARCHAR)" if name in BASELINE_COUNTS else f"{s}.{name}" for s in "lr"]
        return f", {one[0]} AS left_value, {one[1]} AS right_value" if both_values else ""

    rows = [
        f"SELECT coalesce(l.k, r.k) AS pub_id, CASE WHEN r.k IS NULL THEN 'left_only' ELSE 'right_only' END AS diff_kind, '' AS field_name{none} FROM l FULL JOIN r ON l.k = r.k WHERE l.k IS NULL OR r.k IS NULL"
    ]
    rows += [f"SELECT l.k AS pub_id, 'differs' AS diff_kind, '{f}' AS field_name{both(f)} FROM l JOIN r ON l.k = r.k WHERE l.{f} IS DISTINCT FROM r.{f}" for f in fields]
    return (
        f"WITH l AS ({side.format(values=values, side='left', order=order)}), r AS ({side.format(values=values, side='right', order=order)}) "
        + " UNION ALL ".join(rows)
    )


QUERIES = {"p1_found": p1_found, "p1_decisions": p1_decisions, "p2_found": p2_found}
SQL = {"p1_found": P1_FOUND_SQL, "p1_decisions": P1_DECISIONS_SQL, "p2_found": differences_sql()}
