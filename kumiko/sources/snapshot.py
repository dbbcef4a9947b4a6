"""Writes snapshots: one folder for each version, one JSON document for each master and code table, and a manifest.

Documents are made in Spark and come one after another to the driver, which writes them by Hadoop's file system; so any scheme
that Spark reads can be written. A snapshot has tens of documents. Each is written beside its name and then renamed.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog

ENGINE = "0.1.0"


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class Folder:
    """A folder on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.at = lambda name="": spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}" if name else path)
        self.fs = self.at().getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at()) if f.isFile() and not f.getPath().getName().startswith(".")) if self.exists() else []

    def read(self, name: str) -> str:
        return "".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect())

    def write(self, name: str, content) -> None:
        out = self.fs.create(self.at(f".{name}.new"), True)
        try:
            out.write(bytearray((json.dumps(content, ensure_ascii=False, indent=2) + "\n").encode()))
        finally:
            out.close()
        self.remove(name)
        self.fs.rename(self.at(f".{name}.new"), self.at(name))

    def copy(self, name: str, to: Folder) -> None:
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.at(name), to.fs, to.at(name), False, True, self.spark._jsc.hadoopConfiguration())

    def remove(self, name: str) -> None:
        if self.exists(name):
            self.fs.delete(self.at(name), False)


def new_manifest(version: str, dependencies: dict[str, str] | None = None) -> dict:
    return {"version": version, "extractorVersion": ENGINE, "extractedAt": utc_now(), "dependencies": dependencies or {}, "sources": [], "masters": [], "codeTables": []}


def read_manifest(spark: SparkSession, root: str, version: str) -> dict | None:
    """A version's manifest in the newer shape, or None where there is none."""
    rows = catalog.manifests(spark, root, version).collect()
    return {k: v for k, v in rows[0].asDict(recursive=True).items() if k != "snapshot"} if rows else None


def put_source(manifest: dict, entry: dict) -> None:
    """Takes the place of the source of its kind, or goes to the end."""
    kinds = [s.get("kind") for s in manifest["sources"]]
    entry = {**entry, "extractedAt": utc_now()}
    if entry["kind"] in kinds:
        manifest["sources"][kinds.index(entry["kind"])] = entry
    else:
        manifest["sources"].append(entry)


def write_manifest(folder: Folder, manifest: dict) -> None:
    manifest["extractedAt"] = utc_now()
    folder.write("manifest.json", manifest)


def seed(spark: SparkSession, root: str, version: str, without: str | None = None) -> None:
    """A new version's folder with what the latest other version has, but for the kind `without` (master or appendix). Nothing
    happens where the folder is there already."""
    to = Folder(spark, f"{root}/{version}")
    if to.exists():
        return
    to.fs.mkdirs(to.at())
    others = [r[0] for r in catalog.versions(spark, root).collect() if r[0] != version]
    if not others:
        return
    old, manifest = Folder(spark, f"{root}/{others[-1]}"), read_manifest(spark, root, others[-1])
    gone = {"master": "masters", "appendix": "codeTables"}.get(without)
    left_out = {x["file"] for x in manifest[gone]} if gone else set()
    for name in old.names():
        if name != "manifest.json" and name not in left_out:
            old.copy(name, to)
    if gone:
        manifest[gone], manifest["sources"] = [], [s for s in manifest["sources"] if s.get("kind") != without]
    write_manifest(to, {**manifest, "version": version})


def _given(manifest: dict | None, version: str, dependencies: dict[str, str] | None) -> dict:
    manifest = {**(manifest or new_manifest(version)), "version": version, "extractorVersion": ENGINE}
    if dependencies is not None:
        manifest["dependencies"] = dependencies
    return manifest


def master_documents(masters: DataFrame, fields: DataFrame) -> DataFrame:
    """master_id and `body` (JSON) of each master, in order of pos.

    masters: pos, master_id, master_name, sub_name, start, stop. fields: master_id, field_pos, seq, name, short_name, mode,
    max_bytes, item_format, description, codes, flags.
    """
    field = F.struct("field_pos", F.struct("seq", "name", F.col("short_name").alias("shortName"), "mode", F.col("max_bytes").alias("maxBytes"), F.col("item_format").alias("itemFormat"), "description", F.when(F.size("codes") > 0, F.col("codes")).alias("codes"), F.when(F.size(F.map_keys("flags")) > 0, F.col("flags")).alias("flags")).alias("f"))
    lists = fields.groupBy("master_id").agg(F.transform(F.array_sort(F.collect_list(field), lambda a, b: a["field_pos"] - b["field_pos"]), lambda x: x["f"]).alias("fields"))
    whole = masters.join(lists, "master_id", "left")
    body = F.struct(F.col("master_id").alias("masterId"), F.col("master_name").alias("masterName"), F.col("sub_name").alias("subName"), F.struct("start", F.col("stop").alias("end")).alias("pages"), F.coalesce("fields", F.array().cast(lists.schema["fields"].dataType)).alias("fields"))
    return whole.orderBy("pos").select("master_id", F.to_json(body).alias("body"))


def write_masters(spark: SparkSession, root: str, version: str, masters: DataFrame, fields: DataFrame, source: dict, stats: Iterable[dict] = (), dependencies: dict[str, str] | None = None) -> int:
    """Writes a version's masters, their statistics and the manifest; code tables and their source stay. Gives the masters."""
    folder = Folder(spark, f"{root}/{version}")
    manifest = _given(read_manifest(spark, root, version), version, dependencies)
    manifest["masters"] = []
    put_source(manifest, source)
    for row in master_documents(masters, fields).toLocalIterator():
        body = json.loads(row["body"])
        body = {"masterId": body["masterId"], "masterName": body["masterName"], "subName": body.get("subName"), "version": version, "pages": body["pages"], "fields": body["fields"]}
        folder.write(f"{row['master_id']}.json", body)
        head = {k: body[k] for k in ("masterId", "masterName", "subName", "pages")}
        manifest["masters"].append({**head, "file": f"{row['master_id']}.json", "fieldCount": len(body["fields"])})
    write_manifest(folder, manifest)
    folder.write("sections.debug.json", list(stats))
    return len(manifest["masters"])


def section_stats(masters: DataFrame, raw: DataFrame, fields: DataFrame) -> list[dict]:
    """What each master's pages held: raw rows, fields, and fields by lineage."""
    lineages = fields.groupBy("master_id", "lineage").agg(F.count("*").alias("n")).groupBy("master_id").agg(F.sum("n").alias("field_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("lineage", "n")))).alias("counts"))
    rows = masters.join(raw.groupBy("master_id").agg(F.count("*").alias("raw_count")), "master_id", "left").join(lineages, "master_id", "left").orderBy("pos").collect()
    return [{"masterId": r["master_id"], "masterName": r["master_name"], "subName": r["sub_name"], "pages": {"start": r["start"], "end": r["stop"]}, "rawRecordCount": r["raw_count"] or 0, "fieldCount": r["field_count"] or 0, "sourceCounts": r["counts"] or {}} for r in rows]


def write_code_tables(spark: SparkSession, root: str, version: str, tables: DataFrame, source: dict, dependencies: dict[str, str] | None = None) -> list[str]:
    """Writes a version's code tables and the manifest; masters and their source stay. Files of tables that the manifest had and
    the new ones don't have are deleted; their names are given.

    tables: pos, table_id, table_name, kind, pages (array of start, end), codes (of pairs) or groups (of groups).
    """
    folder = Folder(spark, f"{root}/{version}")
    manifest = _given(read_manifest(spark, root, version), version, dependencies)
    before = {t["file"] for t in manifest["codeTables"] if t.get("file")}
    manifest["codeTables"] = []
    body = F.to_json(F.struct("table_id", "table_name", "kind", "pages", "codes", "groups"))
    for row in tables.orderBy("pos").select(body).toLocalIterator():
        t = json.loads(row[0])
        rows, count = ("groups", "groupCount") if t["kind"] == "nayoseGroups" else ("codes", "rowCount")
        items = t.get(rows) or []
        head = {"codeTableId": t["table_id"], "codeTableName": t["table_name"], "kind": t["kind"]}
        folder.write(f"{t['table_id']}.json", {**head, "version": version, "sourcePdf": source["sourcePdf"], "pages": t["pages"], rows: items, count: len(items)})
        manifest["codeTables"].append({**head, "pages": t["pages"], "file": f"{t['table_id']}.json", "rowCount": len(items), "sourcePdf": source["sourcePdf"]})
    gone = sorted(before - {t["file"] for t in manifest["codeTables"]})
    for name in gone:
        folder.remove(name)
    put_source(manifest, source)
    write_manifest(folder, manifest)
    return gone
