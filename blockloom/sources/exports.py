"""Benchmark exports: JSON documents {schema_version, context, samples}."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
_SAMPLE = "struct<workload string, pool string, rep long, cycles string, ns double>"
_GATE = "struct<name string, status string, detail string>"
#: Context fields and what stands for a missing one; {engine} is the name of the measured engine.
_CONTEXT = {
    "tool": ("string", ""), "{engine}_version": ("string", ""), "{engine}_commit": ("string", ""), "{engine}_dirty": ("boolean", False), "datetime_utc": ("string", ""), "hostname": ("string", ""),
    "kernel": ("string", ""), "cpu_model": ("string", ""), "cpu_logical": ("int", 0), "compiler": ("string", ""), "compiler_version": ("string", ""), "build_type": ("string", ""),
    "tsc_cycles_per_ns": ("double", 0.0), "taskset_cpus": ("string", ""),
}


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, root, kind): the files of a path, parsed once; kind tells whether a file is a JSON object."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.expr("try_parse_json(value)").alias("root"))
    return files.withColumn("kind", F.coalesce(F.expr("schema_of_variant(root) LIKE 'OBJECT%'"), F.lit(False)))


def _fields(docs: DataFrame, engine: str) -> DataFrame:
    context = ", ".join(f"`{k.format(engine=engine)}` {t}" for k, (t, _) in _CONTEXT.items()) + f", checklist array<{_GATE}>"
    return docs.select(
        "path",
        "kind",
        F.expr("try_variant_get(root, '$.schema_version', 'int')").alias("version"),
        F.expr("schema_of_variant(try_variant_get(root, '$.context', 'variant')) LIKE 'OBJECT%'").alias("has_context"),
        F.expr("schema_of_variant(try_variant_get(root, '$.samples', 'variant')) LIKE 'ARRAY%'").alias("has_samples"),
        F.from_json("text", f"context struct<{context}>, samples array<{_SAMPLE}>").alias("doc"),
    )


def _samples(fields: DataFrame) -> DataFrame:
    one = fields.select(F.explode("doc.samples").alias("s"))
    return one.select(F.coalesce("s.workload", F.lit("")).alias("workload"), "s.pool", "s.rep", F.col("s.cycles").cast("decimal(20,0)").alias("cycles"), "s.ns")


def read_export(spark: SparkSession, path: str, engine: str = "engine") -> tuple[DataFrame, DataFrame]:
    """(context, samples) of the documents at a path; samples are in the order (workload, pool, rep).

    Missing context fields become "", 0 or false; entries of the checklist that are no objects are left out. ValueError
    for a document that is no JSON object, has another schema_version, or no context or samples.
    """
    fields = _fields(_documents(spark, path), engine)
    wrong = F.when(~F.col("kind"), "no JSON object").when(F.coalesce("version", F.lit(0)) != SCHEMA_VERSION, "unsupported schema_version")
    wrong = wrong.when(~F.coalesce("has_context", F.lit(False)), "no context").when(~F.coalesce("has_samples", F.lit(False)), "no samples")
    if first := fields.select("path", wrong.alias("why")).where("why IS NOT NULL").agg(F.min(F.struct("path", "why"))).first()[0]:
        raise ValueError(f"{first.path}: {first.why}")
    names = {k: k.format(engine=engine) for k in _CONTEXT}
    context = fields.select("path", *[F.coalesce(F.col(f"doc.context.`{names[k]}`"), F.lit(missing)).alias(names[k]) for k, (_, missing) in _CONTEXT.items()], F.filter(F.coalesce("doc.context.checklist", F.array()), lambda g: g.isNotNull()).alias("checklist"))
    return context, _samples(fields).orderBy("workload", "pool", "rep")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The samples of all *.json files of a path. Files that hold no JSON are skipped; missing samples count as none."""
    return _samples(_fields(_documents(spark, path).where("kind"), "engine"))


def write_export(samples: DataFrame, context: dict, path: str, *, per_document: int = 50_000) -> None:
    """Documents of about per_document samples of one workload at most under path, each with the whole context.

    The context has a field at least. NaN and infinite times become null.
    """
    fields = F.from_json(F.lit(json.dumps(context)), _schema(context))
    ns = F.when(F.isnan("ns") | (F.abs("ns") == float("inf")), F.lit(None)).otherwise(F.col("ns"))
    parts = samples.groupBy("workload").agg(F.ceil(F.count("*") / per_document).alias("parts")).withColumnRenamed("workload", "__workload")
    dealt = samples.join(parts, F.col("workload").eqNullSafe(F.col("__workload"))).withColumn("part", F.pmod(F.xxhash64("pool", "rep"), "parts"))
    rows = F.struct("workload", "pool", "rep", F.col("cycles").cast("string").alias("cycles"), ns.alias("ns"))
    docs = dealt.groupBy("workload", "part").agg(F.array_sort(F.collect_list(rows)).alias("samples"))
    file = F.concat(F.regexp_replace("workload", r"[^A-Za-z0-9._-]", "_"), F.lit("-"), F.hex(F.xxhash64("workload", "part")))
    whole = docs.select(file.alias("file"), F.lit(SCHEMA_VERSION).alias("schema_version"), fields.alias("context"), "samples")
    whole.write.partitionBy("file").mode("overwrite").option("ignoreNullFields", "false").json(path)


def _schema(context: dict) -> str:
    kinds = {str: "string", bool: "boolean", int: "long", float: "double"}
    return "struct<" + ", ".join(f"`{k}`: {kinds[type(v)]}" if type(v) in kinds else f"`{k}`: array<{_GATE}>" for k, v in context.items()) + ">"
