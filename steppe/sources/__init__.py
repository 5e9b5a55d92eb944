"""Sources and sinks: plain texts, CoNLL-U files, model catalogs and files of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conllu import parse_conllu, split_documents, to_conllu, to_json


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): every file is one document."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """Documents of CoNLL-U files: (path, doc, text, lang, script, sentences), doc counted from 0 in a file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("__c"))
    parts = files.select("path", F.posexplode(split_documents(F.col("__c"))).alias("doc", "content"))
    return parse_conllu(parts, keep=("path", "doc"))


def write_documents(docs: DataFrame, path: str, output_format: str = "conllu", lang: str = "lang", script: str = "script") -> None:
    """Write annotated documents as text, one to a row: CoNLL-U, or JSON of their words; ``ValueError`` for other formats."""
    if output_format == "conllu":
        out = to_conllu(F.col("sentences"), F.col(lang) if lang in docs.columns else None, F.col(script) if script in docs.columns else None)
    elif output_format == "json":
        out = to_json(F.col("sentences"))
    else:
        raise ValueError(f"unknown format: {output_format}")
    docs.select(out.alias("value")).write.text(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(lang, name, script, is_primary, processor, backend, is_default, type, url, sha256, license) of a JSON catalog.

    The catalog maps languages to {name, scripts {available, primary}, processors {script: {processor:
    {default, backends {backend: {type, url, sha256, license}}}}}}.
    """
    schema = (
        "map<string, struct<name:string, scripts:struct<available:array<string>,primary:string>, processors:map<string, map<string, "
        "struct<default:string, backends:map<string, struct<type:string,url:string,sha256:string,license:string>>>>>>>"
    )
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("lang", "l"))
    scripts = raw.select("lang", "l", F.explode("l.processors").alias("script", "p")).select("lang", "l", "script", F.explode("p").alias("processor", "b"))
    return scripts.select(
        "lang", "l.name", "script", (F.col("script") == F.col("l.scripts.primary")).alias("is_primary"), "processor", F.col("b.default").alias("default_backend"), F.explode_outer("b.backends").alias("backend", "m")
    ).select("lang", "name", "script", "is_primary", "processor", "backend", (F.col("backend") == F.col("default_backend")).alias("is_default"), "m.*")


def list_languages(catalog: DataFrame) -> DataFrame:
    """(lang, name, scripts, processors), by language."""
    return catalog.groupBy("lang").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("script")).alias("scripts"), F.array_sort(F.collect_set("processor")).alias("processors")).orderBy("lang")


def list_processors(catalog: DataFrame, lang: str) -> DataFrame:
    """(processor, backends): backends of all scripts of the language, sorted."""
    return catalog.where(F.col("lang") == lang).groupBy("processor").agg(F.array_sort(F.collect_set("backend")).alias("backends")).orderBy("processor")


def available_for(catalog: DataFrame, lang: str, script: str) -> DataFrame:
    """The processors of a language in a script, or in its first script by name if it lacks that one."""
    own = catalog.where(F.col("lang") == lang)
    first = own.agg(F.coalesce(F.max(F.when(F.col("script") == script, F.col("script"))), F.min("script")).alias("__s"))
    return own.join(F.broadcast(first), F.col("script") == F.col("__s"), "left_semi")


def verified(files: DataFrame, expected: Column) -> DataFrame:
    """Files of a binaryFile source, failing on the first whose SHA-256 isn't the expected one; a null isn't checked."""
    digest = F.sha2("content", 256)
    bad = expected.isNotNull() & (digest != F.lower(expected))
    return files.withColumn("content", F.when(bad, F.raise_error(F.concat(F.lit("checksum of "), F.col("path"), F.lit(" is "), digest)).cast("binary")).otherwise(F.col("content")))
