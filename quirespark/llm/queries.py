"""Queries of the text problems, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.garbled import garbled
from quirespark.llm.languages import detected, label_names, mislabelled, unnamed
from quirespark.llm.lookalikes import unusual
from quirespark.llm.names import variants
from quirespark.llm.packing import containers, pack
from quirespark.llm.sentences import sentences
from quirespark.llm.tokens import encode, token_counts
from quirespark.session import cut, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(table(spark, sf_dir, "metadata_results")).select("record_id", "field_name")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = table(spark, sf_dir, "metadata_results").select(F.explode("authors").alias("name"))
    return variants(authors, table(spark, sf_dir, "title_metadata").select("file_as"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = label_names([tuple(r) for r in table(spark, sf_dir, "languages_ref").select("lang", "iso3", "name_en", "name_native").collect()])
    texts = cut(detected(table(spark, sf_dir, "documents"), "doc_id", "text", ("lang", "pub_id")))
    described = detected(table(spark, sf_dir, "metadata_results"), "record_id", "description", ("language_tag",), ("language_tag", names))
    return (
        mislabelled(texts, "doc_id", "lang", names, "documents")
        .unionAll(mislabelled(described, "record_id", "language_tag", names, "metadata_results"))
        .unionAll(unnamed(texts, table(spark, sf_dir, "corpus_catalog"), "pub_id", "languages", names, "corpus_catalog"))
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = unusual(table(spark, sf_dir, "metadata_results"), "record_id", ("title", "authors"))
    titles = unusual(table(spark, sf_dir, "title_metadata"), "title_id", ("title_value",))
    rows = [f.select(F.lit(name).alias("tab_name"), F.col(key).alias("row_id"), "field_name") for f, name, key in ((read, "metadata_results", "record_id"), (titles, "title_metadata", "title_id"))]
    return rows[0].unionAll(rows[1])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_limits"))


def p7_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, is_empty of p7_ids: what SQL can say of it."""
    return p7_ids(spark, sf_dir).select("doc_id", (F.size("ids") == 0).alias("is_empty"))


def p8_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """limit_id, doc_id, whole, n_over of p8_packing: whether a text is placed once with all its tokens, and how many of the
    containers it is in hold more than they can; what SQL can say of it."""
    packed = cut(p8_packing(spark, sf_dir))
    sizes = token_counts(table(spark, sf_dir, "documents"))
    limits = table(spark, sf_dir, "pack_limits").select("limit_id", "capacity_tokens")
    over = containers(packed).join(limits, "limit_id").select("limit_id", "container", (F.col("used_tokens") > F.col("capacity_tokens")).cast("int").alias("over"))
    # a text is in parts only where it exceeds the capacity, and then in as few as can be
    of_text = packed.join(over, ["limit_id", "container"]).groupBy("limit_id", "doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("parts"), F.sum("over").cast("int").alias("n_over"))
    fewest = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))
    whole = (F.col("placed") == F.col("n_tokens")) & (F.col("parts") == fewest)
    return of_text.join(sizes, "doc_id").join(limits, "limit_id").select("limit_id", "doc_id", whole.alias("whole"), "n_over")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """limit_id, n_containers, fewest, fill of p8_packing: the containers, the fewest the tokens could need, and the share used."""
    packed = containers(p8_packing(spark, sf_dir)).groupBy("limit_id").agg(F.count("*").alias("n_containers"), F.sum("used_tokens").alias("tokens"))
    limits = table(spark, sf_dir, "pack_limits").select("limit_id", "capacity_tokens")
    capacity = F.col("capacity_tokens").cast("double")
    return packed.join(limits, "limit_id").select("limit_id", "n_containers", F.ceil(F.col("tokens") / capacity).alias("fewest"), (F.col("tokens") / (F.col("n_containers") * capacity)).alias("fill"))


def p9_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_visible of p9_found: the code points other than white space that its units cover; what SQL can say of it."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    units = p9_found(spark, sf_dir).join(texts, "doc_id").select("doc_id", F.expr("substring(text, start_char + 1, end_char - start_char)").alias("unit"))
    visible = F.length(F.regexp_replace("unit", r"[\s\x{85}\p{Z}\x{1C}-\x{1F}]", ""))
    return units.groupBy("doc_id").agg(F.sum(visible).alias("n_visible"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"))


QUERIES = {
    "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_ids": p7_ids, "p7_rows": p7_rows, "p8_packing": p8_packing,
    "p8_rows": p8_rows, "p8_fill": p8_fill, "p9_found": p9_found, "p9_rows": p9_rows,
}
SQL: dict[str, str] = {
    "p7_rows": "SELECT doc_id, coalesce(text, '') = '' AS is_empty FROM documents",
    "p8_rows": "SELECT limit_id, doc_id, true AS whole, CAST(0 AS INTEGER) AS n_over FROM documents CROSS JOIN pack_limits",
    "p9_rows": "SELECT doc_id, n_visible FROM (SELECT doc_id, CAST(length(regexp_replace(text, '[\\s\\x{85}\\pZ\\x{0B}\\x{1C}-\\x{1F}]', '', 'g')) AS BIGINT) AS n_visible FROM documents) WHERE n_visible > 0",
}
