"""Readers for JSON record trees, keyed maps, archive manifests and raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceweave import schemas, vocab

_BAD = "__bad"


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``value`` (JSON text) to typed columns, with ``raw``, ``file`` and ``load_error``; bad records stay as rows."""
    full = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    rec = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    df = df.withColumn("__r", rec)
    broken = F.col("__r").isNull() | F.col(f"__r.{_BAD}").isNotNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))
    return df.select(
        "file", F.col("value").alias("raw"), F.when(broken, F.concat(F.col("file"), F.lit(": not readable as JSON"))).alias("load_error"),
        *[F.col(f"__r.{f.name}").alias(f.name) for f in schema.fields])


def scan_entities(spark: SparkSession, path: str, schema: T.StructType, per_file: bool = True) -> DataFrame:
    """One record per file (or per line), typed and with its raw text beside it.

    The raw text keeps what a typed read drops: unknown keys, and null against absent.
    """
    df = spark.read.text(path, wholetext=per_file)
    return _typed(df.select("value", F.col("_metadata.file_name").alias("file")), schema)


def scan_keyed_map(spark: SparkSession, path: str, value: T.StructType, key: str, per_file: bool = True) -> DataFrame:
    """A JSON object of objects to one row per key, with the raw value text.

    A whole file is one object and so one task's work; a map that outgrows a task
    is written as lines, each an object with some of the keys (``per_file=False``),
    which Spark splits.
    """
    text = spark.read.text(path, wholetext=per_file)
    raw = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    rows = text.select(F.explode(raw).alias(key, "raw"))
    rec = F.from_json("raw", value)
    return rows.select(key, "raw", *[rec[f.name].alias(f.name) for f in value.fields])


# ------------------------------------------------------------------ manifests
def scan_manifests(spark: SparkSession, path: str) -> DataFrame:
    """``<path>/<archive>/MANIFEST.json``: the folder names the archive."""
    df = spark.read.text(f"{path}/*/MANIFEST.json", wholetext=True)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return _typed(df.select("value", folder.alias("file")), schemas.MANIFEST).withColumnRenamed("file", "archive_key")


def _first(*cols: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def flatten_manifests(manifests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(archives, items, pages, matches) as flat tables, with the names' fallbacks and the rights in words."""
    a, key = F.col("archive"), F.col("archive_key")
    archives = manifests.select(
        key.alias("archive"), "load_error", _first(a["name"], F.col("collection"), key).alias("name"),
        _first(a["short_name"], a["name"], key).alias("short_name"), F.coalesce(a["collection"], F.lit("")).alias("collection"),
        F.coalesce(_first(a["collection_url"], F.col("download_url")), F.lit("")).alias("collection_url"),
        F.coalesce(a["record_url"], F.lit("")).alias("record_url"), F.coalesce(a["iiif_url"], F.lit("")).alias("iiif_url"))
    flat = manifests.where("load_error IS NULL").select(key.alias("archive"), F.explode("items").alias("i"))
    i = F.col("i")
    items = flat.select("archive", i["itemId"].alias("item"), F.coalesce(i["title"], F.lit("")).alias("title"),
                        F.coalesce(i["boxFolder"], F.lit("")).alias("box_folder"))
    labels = F.create_map(*[F.lit(x) for kv in vocab.RIGHTS_LABEL.items() for x in kv])
    p = F.col("p")
    rights = F.coalesce(p["rights"], F.lit(""))
    pages = flat.select("archive", i["itemId"].alias("item"), F.posexplode(i["pages"]).alias("pos", "p")).select(
        "archive", "item", "pos", p["page"].alias("page"), F.coalesce(p["shelfmark"], F.lit("")).alias("shelfmark"),
        F.coalesce(p["pointer"], F.lit("")).alias("pointer"), rights.alias("rights"),
        F.coalesce(F.try_element_at(labels, rights), rights).alias("rights_label"))
    matches = flat.select("archive", i["itemId"].alias("item"), i["title"].alias("title"), i["boxFolder"].alias("box_folder"), F.explode(i["matches"]).alias("m")).select(
        "archive", "item", "title", "box_folder", "m.letter_id", "m.pages", "m.what", "m.person")
    return archives, items, pages, matches


# ------------------------------------------------------------------ transcriptions
def scan_transcriptions(spark: SparkSession, facsimile_root: str | None, printed_root: str | None) -> DataFrame:
    """Both stores of transcriptions as one table; ``at`` is folder and file, ``store`` the archive folder."""
    out = None
    for origin, root, pattern in (("facsimile store", facsimile_root, "*/transcriptions/*.json"), ("printed store", printed_root, "*/*.json")):
        if root is None:
            continue
        df = spark.read.text(f"{root}/{pattern}", wholetext=True)
        parts = F.split(F.col("_metadata.file_path"), "/")
        at = F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))
        store = F.element_at(parts, -3) if origin == "facsimile store" else F.element_at(parts, -2)
        one = _typed(df.select("value", F.concat_ws("\t", at, store).alias("file")), schemas.TRANSCRIPTION)
        one = one.select(F.split_part("file", F.lit("\t"), F.lit(1)).alias("at"), F.split_part("file", F.lit("\t"), F.lit(2)).alias("store"),
                         F.lit(origin).alias("origin"), *[c for c in one.columns if c != "file"])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------ raw text
def scan_text_files(spark: SparkSession, path: str, suffixes: list[str] | None = None) -> DataFrame:
    """(path, content) of every text file below ``path``, as bytes."""
    glob = "*.{" + ",".join(suffixes or vocab.TEXT_SUFFIXES) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")


def list_files(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Relative paths below ``root`` without reading the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.select(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{root.rstrip('/')}/", "").alias("file"))
