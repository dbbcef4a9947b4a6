"""Snapshots of JSON documents as tables: versions, manifests in both shapes, masters, fields, codes, code tables.

A missing folder is one without snapshots. Readers take a version, so that only its folder is listed and read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

PAGES = "struct<start:int,end:int>"
CODES = "array<struct<code:string,name:string>>"
SOURCES = "array<struct<kind:string,sourcePdf:string,sourceUrl:string,sourceSha256:string,sourceVersion:string,extractedAt:string>>"
MANIFEST = (
    "version string, extractorVersion string, extractedAt string, dependencies map<string,string>, "
    f"sources {SOURCES}, masters array<struct<masterId:string,masterName:string,subName:string,pages:{PAGES},file:string,fieldCount:int>>, "
    f"codeTables array<struct<codeTableId:string,codeTableName:string,kind:string,pages:array<{PAGES}>,file:string,rowCount:int,sourcePdf:string>>, "
    "sourcePdf string, sourceUrl string, sourceSha256 string"
)
MASTER = (
    f"masterId string, masterName string, subName string, version string, pages {PAGES}, "
    f"fields array<struct<seq:int,name:string,shortName:string,mode:string,maxBytes:int,itemFormat:string,description:string,codes:{CODES},flags:map<string,string>>>"
)
CODE_TABLE = (
    f"codeTableId string, codeTableName string, kind string, version string, sourcePdf string, pages array<{PAGES}>, codes {CODES}, rowCount int, "
    "groups array<struct<targetCode:string,targetName:string,sources:array<struct<code:string,name:string>>,note:string>>, groupCount int"
)


def files_at(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern matches, on whatever file system it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or ())


def data_root(spark: SparkSession, given: str | None) -> str:
    """The folder of snapshots: the one given, else `data` here or beside this package, whichever first has a manifest."""
    if given:
        return given if "://" in given else str(Path(given).resolve())
    here, packaged = Path.cwd() / "data", Path(__file__).resolve().parents[1] / "data"
    return str(next((p for p in (here, packaged) if files_at(spark, f"{p}/*/manifest.json")), here))


def _documents(spark: SparkSession, root: str, schema: str, name: str = "*.json", version: str = "*") -> DataFrame:
    """One row for each document; its version is its directory's, which must be eight digits."""
    found = files_at(spark, f"{root}/{version}/{name}")
    if not found:
        return spark.createDataFrame([], f"snapshot string, file_name string, {schema}")
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{root}/{version}/{name}")
    where = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(where, r"/(\d{8})/[^/]+$", 1).alias("snapshot"), F.col("_metadata.file_name").alias("file_name"), "*").filter("snapshot <> ''")


def manifests(spark: SparkSession, root: str, version: str = "*") -> DataFrame:
    """One row for each snapshot, the older shape brought to the newer one while it is read."""
    m = _documents(spark, root, MANIFEST, "manifest.json", version)
    given = F.coalesce("sources", F.array().cast(SOURCES))
    stem = F.coalesce(F.nullif(F.regexp_extract("sourcePdf", r"(\d{8})", 1), F.lit("")), F.col("version"))
    old = F.struct(F.lit("master").alias("kind"), "sourcePdf", "sourceUrl", "sourceSha256", stem.alias("sourceVersion"), "extractedAt")
    lacks = F.col("sourcePdf").isNotNull() & ~F.exists(given, lambda s: s["kind"] == "master")
    whole = F.when(lacks, F.concat(given, F.array(old).cast(SOURCES))).otherwise(given)
    empty = lambda c: F.coalesce(c, F.array().cast(m.schema[c].dataType))
    return m.select("snapshot", "version", "extractorVersion", "extractedAt", "dependencies", whole.alias("sources"), empty("masters").alias("masters"), empty("codeTables").alias("codeTables"))


def versions(spark: SparkSession, root: str) -> DataFrame:
    return manifests(spark, root).select("snapshot").distinct().orderBy("snapshot")


def sources(m: DataFrame) -> DataFrame:
    return m.select("snapshot", F.explode("sources").alias("s")).select("snapshot", "s.*")


def masters(m: DataFrame) -> DataFrame:
    flat = m.select("snapshot", F.posexplode("masters").alias("pos", "x"))
    return flat.select("snapshot", "pos", F.col("x.masterId").alias("master_id"), F.col("x.masterName").alias("master_name"), F.col("x.subName").alias("sub_name"), F.concat_ws(" / ", "x.masterName", F.nullif("x.subName", F.lit(""))).alias("title"), F.col("x.fieldCount").alias("field_count"))


def code_tables(m: DataFrame) -> DataFrame:
    flat = m.select("snapshot", F.posexplode("codeTables").alias("pos", "x"))
    return flat.select("snapshot", "pos", F.col("x.codeTableId").alias("table_id"), F.col("x.codeTableName").alias("table_name"), F.col("x.kind").alias("kind"), F.col("x.rowCount").alias("row_count"))


def fields(spark: SparkSession, root: str, version: str = "*") -> DataFrame:
    docs = _documents(spark, root, MASTER, version=version).filter("masterId is not null")
    flat = docs.select(F.col("snapshot").alias("version"), F.col("masterId").alias("master_id"), F.posexplode("fields").alias("field_pos", "f"))
    return flat.select("version", "master_id", "field_pos", "f.seq", "f.name", F.col("f.shortName").alias("short_name"), "f.mode", F.col("f.maxBytes").alias("max_bytes"), F.col("f.itemFormat").alias("item_format"), "f.description", F.coalesce("f.codes", F.array().cast(CODES)).alias("codes"), "f.flags")


def codes(of: DataFrame) -> DataFrame:
    flat = of.select("version", "master_id", "field_pos", "seq", F.posexplode("codes").alias("code_pos", "c"))
    return flat.select("version", "master_id", "field_pos", "seq", "code_pos", "c.code", T.code_key(F.col("c.code")).alias("code_norm"), "c.name")


def code_pairs(spark: SparkSession, root: str, version: str = "*") -> DataFrame:
    docs = _documents(spark, root, CODE_TABLE, version=version).filter("kind = 'codeNamePairs'")
    flat = docs.select(F.col("snapshot").alias("version"), F.col("codeTableId").alias("table_id"), F.posexplode("codes").alias("pos", "c"))
    return flat.select("version", "table_id", "pos", "c.code", T.code_key(F.col("c.code")).alias("code_norm"), "c.name")


def merge_groups(spark: SparkSession, root: str, version: str = "*") -> DataFrame:
    docs = _documents(spark, root, CODE_TABLE, version=version).filter("kind = 'nayoseGroups'")
    flat = docs.select(F.col("snapshot").alias("version"), F.col("codeTableId").alias("table_id"), F.posexplode("groups").alias("group_pos", "g"))
    return flat.select("version", "table_id", "group_pos", F.col("g.targetCode").alias("target_code"), F.col("g.targetName").alias("target_name"), F.col("g.note").alias("note"), F.col("g.sources").alias("sources"), F.size("g.sources").alias("n_sources"))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_snapshot(of: DataFrame, path: str, keys: list[str]) -> None:
    """Writes rows by version and key; only the partitions that `of` has are replaced."""
    of.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
