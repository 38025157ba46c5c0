"""Corpus readers and finding writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.functions import tables


def read_corpus(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", fmt: str = "parquet") -> DataFrame:
    """(doc_id, text) of a parquet, json or text source; text lines get a hash of file and content as id."""
    if fmt == "text":
        lines = spark.read.text(path)
        return lines.select(F.xxhash64(F.input_file_name(), F.col("value")).alias("doc_id"), F.col("value").alias("text"))
    return spark.read.format(fmt).load(path).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def rules_frame(spark: SparkSession, categories: list[str] | None = None) -> DataFrame:
    """Built-in rules as a table: ord, name, category, severity, description, regex."""
    columns = "name string, category string, severity int, description string, regex string"
    both = tables.frame(spark, "output_rules", columns).withColumn("part", F.lit(0)).unionByName(tables.frame(spark, "input_rules", columns).withColumn("part", F.lit(1)))
    both = both.withColumn("ord", F.col("part") * 1000 + F.col("ord")).drop("part")
    return both if categories is None else both.filter(F.col("category").isin(categories))


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings by category, as Parquet."""
    findings.write.partitionBy("category").parquet(path)


def read_jsonrpc_log(lines: DataFrame, line_col: str) -> DataFrame:
    """Request lines (those that start with {) with their method, id and raw params."""
    fields = [F.get_json_object(line_col, f"$.{x}").alias(x) for x in ("jsonrpc", "method", "params", "id")]
    return lines.filter(F.trim(line_col).startswith("{")).select("*", *fields)


def tool_result_text(results: DataFrame, content_col: str) -> DataFrame:
    """Texts of the content blocks of a tool result, each followed by a space."""
    blocks = F.from_json(content_col, "array<struct<type:string,text:string,data:string,mimeType:string>>")
    texts = F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull())
    return results.withColumn("result_text", F.concat(F.array_join(texts, " "), F.when(F.size(texts) > 0, " ").otherwise("")))


def read_judge_log(replies: DataFrame, response_col: str) -> DataFrame:
    """Stored judge replies as class and confidence: a JSON object, else a bare probability, else a prefix."""
    reply = F.trim(F.col(response_col))
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, "struct<classification:string,confidence:double,reason:string>")
    number = reply.try_cast("double")
    low = F.lower(reply)
    label = F.coalesce(
        F.upper(parsed["classification"]),
        F.when(number > 0.5, "MALICIOUS").when(number.isNotNull(), "SAFE"),
        F.when(low.startswith("unsafe") | low.startswith("jailbreak"), "MALICIOUS").when(low.startswith("safe"), "SAFE"),
    )
    return replies.withColumn("judge_class", label).withColumn("judge_confidence", F.coalesce(parsed["confidence"], number))


def read_drift_log(replies: DataFrame, response_col: str) -> DataFrame:
    """VERDICT, DRIFT and REASON lines of stored replies; a drift of 0.5 where none can be read, 0.8 where only a keyword is there."""
    reply = F.col(response_col)
    verdict = F.upper(F.regexp_extract(reply, r"(?m)^\s*VERDICT:\s*(\w+)", 1))
    drift = F.regexp_extract(reply, r"(?m)^\s*DRIFT:\s*([0-9.]+)", 1).try_cast("double")
    keyword = F.lower(reply).rlike("unsafe|drift detected|suspicious") & (verdict == "")
    return replies.withColumn("verdict", F.when(verdict != "", verdict)).withColumn("drift", F.coalesce(drift, F.when(keyword, F.lit(0.8)), F.lit(0.5))).withColumn("reason", F.regexp_extract(reply, r"(?m)^\s*REASON:\s*(.*)$", 1))


def upsert_seeds(target: DataFrame, updates: DataFrame, key: str = "id", version: str = "updated_at") -> DataFrame:
    """The newest row of every key."""
    newest = F.max_by(F.struct(*target.columns), F.col(version))
    return target.unionByName(updates).groupBy(key).agg(newest.alias("x")).select("x.*")


def delete_seeds(target: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return target.join(gone, key, "left_anti")


def list_seeds(seeds: DataFrame, category: str, limit: int) -> DataFrame:
    """The first seeds of a category, by id."""
    return seeds.filter(F.col("category") == category).orderBy("id").limit(limit)
