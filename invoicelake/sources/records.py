"""Extracted records as text or files, and what was extracted before."""

from __future__ import annotations

import json
import re
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import json_text
from ..schema import RAW


def parse(texts: DataFrame) -> DataFrame:
    """(doc_seq, origen, pagina, texto) -> the raw record's fields, null where the text can't be repaired, and ``legible``."""
    fixed = json_text.with_repaired(texts, "texto", "_json")
    rec = fixed.withColumn("_r", F.from_json("_json", RAW))
    return rec.select("doc_seq", "origen", "pagina", "_r.*", F.col("_json").isNotNull().alias("legible"))


def literal(spark: SparkSession, records: list[dict], origin: str = "literal") -> DataFrame:
    """Records written out by hand, as ``parse`` gives them; fields that are left out are null."""
    kept = {f.name for f in StructType.fromDDL(RAW)}
    rows = [(k, origin, 1, json.dumps({f: v for f, v in r.items() if f in kept})) for k, r in enumerate(records)]
    return parse(spark.createDataFrame(rows, "doc_seq long, origen string, pagina int, texto string"))


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath) and fs.getFileStatus(jpath).isDirectory()


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder."""
    fs, jpath = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(jpath) if f.isDirectory()] if fs.exists(jpath) else []


def _object(spark: SparkSession, path: str, value: str, columns: str) -> DataFrame:
    """(clave, v) of a file that holds one JSON object; no rows where it is missing or broken."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], columns)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("clave", "v"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(clave, texto), keyed by file#page: a folder that ``append_cache`` wrote, or a file with one JSON object; no rows where there is
    none. Of several texts of a key the greatest is taken."""
    if is_folder(spark, path):
        lines = spark.read.schema("clave string, texto string").option("recursiveFileLookup", True).json(path)
        return lines.filter("clave is not null").groupBy("clave").agg(F.max("texto").alias("texto"))
    return _object(spark, path, "string", "clave string, v string").select("clave", F.col("v").alias("texto"))


def uncached(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages that the cache doesn't have."""
    return pages.withColumn("clave", F.concat_ws("#", "origen", "pagina")).join(cache.select("clave"), "clave", "left_anti")


def append_cache(records: DataFrame, path: str) -> None:
    """Adds (clave, texto) rows as JSON lines; earlier ones are left alone."""
    records.select("clave", "texto").write.mode("append").json(path)


#: What Spark says of a file that is no Parquet, or not a whole one.
_BROKEN = re.compile(r"CANNOT_READ_FILE_FOOTER|not a Parquet file|UNABLE_TO_INFER_SCHEMA")


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The whole versions of a memory, latest first. Spark writes _SUCCESS last, so one without it isn't whole."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    names = sorted((f.getPath().getName() for f in fs.listStatus(jpath) if f.isDirectory() and f.getPath().getName().startswith("v=")), reverse=True)
    return [n for n in names if fs.exists(_fs(spark, f"{path.rstrip('/')}/{n}/_SUCCESS")[1])]


def read_memory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The latest version of a memory that can be read; empty where there is none."""
    for name in _versions(spark, path):
        held = f"{path.rstrip('/')}/{name}"
        try:
            spark.read.parquet(held).limit(1).count()
        except Exception as e:  # a broken file shows in several kinds of errors; any other reason is not the file's
            if not _BROKEN.search(str(e)):
                raise
            warnings.warn(f"{held} can't be read: {e}", stacklevel=2)
            continue
        return spark.read.schema(schema).parquet(held)
    return spark.createDataFrame([], schema)


def write_memory(memory: DataFrame, path: str, keep: int = 2) -> None:
    """A new version of a memory, which may be derived from the one before. Readers see it once it is whole; a writer that fails leaves the
    one before in place, and of two at once the second fails. ``keep`` versions stay for readers that have begun."""
    spark = memory.sparkSession
    fs, jpath = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(jpath)] if fs.exists(jpath) else []
    number = max((int(n[2:]) for n in names if n.startswith("v=")), default=0) + 1
    memory.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/v={number:09d}")
    for name in _versions(spark, path)[keep:]:
        fs.delete(_fs(spark, f"{path.rstrip('/')}/{name}")[1], True)


def read_provider_json(spark: SparkSession, path: str) -> DataFrame:
    """A memory kept as one JSON object {clave: {nif, nombre, manual}}; empty where it is missing or broken."""
    held = _object(spark, path, "struct<nif:string,nombre:string,manual:boolean>", "clave string, v struct<nif:string,nombre:string,manual:boolean>")
    return held.select("clave", "v.nif", "v.nombre", F.coalesce("v.manual", F.lit(False)).alias("manual"))


def read_client_json(spark: SparkSession, path: str) -> DataFrame:
    """A memory kept as one JSON object {nif: {recargo_equivalencia, nombre}}; empty where it is missing or broken."""
    held = _object(spark, path, "struct<recargo_equivalencia:boolean,nombre:string>", "clave string, v struct<recargo_equivalencia:boolean,nombre:string>")
    return held.select(F.col("clave").alias("nif"), F.coalesce("v.recargo_equivalencia", F.lit(False)).alias("recargo_equivalencia"), F.coalesce("v.nombre", F.lit("")).alias("nombre"))
