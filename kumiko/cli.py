"""Commands over JSON snapshots: info, schema, versions, masters, fields, field, code, codetables, codetable, search, verify, fetch
and skill (a printed guide).

Results are JSON on stdout; errors go to stderr with a hint, and the exit code is then 1. It is 1 as well where `verify` finds an
error. Filters run in Spark; only a command's result comes to the driver.
"""

from __future__ import annotations

import argparse
import json
import sys
import unicodedata
from importlib.resources import files
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .operators import quality, search, versioning
from .session import session
from .sources import catalog, fetch, snapshot


class Failure(Exception):
    """What went wrong, and what to do next."""


def _plain(x: Any) -> Any:
    """Rows as objects; keys without a value are left out."""
    if isinstance(x, Row):
        return {k: _plain(v) for k, v in x.asDict().items() if v is not None and v != [] and v != {}}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def _rows(df: DataFrame) -> list[dict]:
    return [_plain(r) for r in df.collect()]


def _key(code: str) -> str:
    return unicodedata.normalize("NFKC", code).strip()


def _version(spark: SparkSession, root: str, wanted: str | None) -> str:
    found = [r[0] for r in catalog.versions(spark, root).collect()]
    if not found:
        raise Failure(f"no versions under {root}\nhint: name the folder of snapshots with --data-dir")
    if wanted and wanted not in found:
        raise Failure(f"version {wanted!r} not found\nhint: available = {found}")
    return wanted or found[-1]


def _one(df: DataFrame, key: str, wanted: str, kind: str) -> DataFrame:
    hit = df.filter(F.col(key) == wanted)
    if hit.isEmpty():
        raise Failure(f"{kind} {wanted!r} not found\nhint: available = {sorted(r[0] for r in df.select(key).filter(F.col(key).isNotNull()).distinct().collect())}")
    return hit


def _shape(kind: DataType) -> Any:
    if isinstance(kind, StructType):
        return {f.name: _shape(f.dataType) for f in kind.fields}
    if isinstance(kind, ArrayType):
        return [_shape(kind.elementType)]
    return {"<key>": _shape(kind.valueType)} if isinstance(kind, MapType) else kind.simpleString()


def schema() -> dict:
    """The shapes of all documents, from the schemas that they are read with."""
    whole = {name: _shape(StructType.fromDDL(ddl)) for name, ddl in (("master", catalog.MASTER), ("codeTable", catalog.CODE_TABLE), ("manifest", catalog.MANIFEST))}
    field = whole["master"]["fields"][0]
    for old in ("sourcePdf", "sourceUrl", "sourceSha256"):  # an older shape's
        whole["manifest"].pop(old)
    return {**whole, "field": field, "code": field["codes"][0]}


def info(spark: SparkSession, root: str) -> dict:
    found = [r[0] for r in catalog.versions(spark, root).collect()]
    out: dict[str, Any] = {"cliVersion": snapshot.ENGINE, "dataDir": root, "availableVersions": found, "latestVersion": found[-1] if found else None}
    if found:
        m = snapshot.read_manifest(spark, root, found[-1])
        out["latest"] = {
            "sources": m["sources"], "extractorVersion": m["extractorVersion"], "extractedAt": m["extractedAt"],
            "masterCount": len(m["masters"]), "masterIds": [x["masterId"] for x in m["masters"]],
            "codeTableCount": len(m["codeTables"]), "codeTableIds": [x["codeTableId"] for x in m["codeTables"]],
        }
    out["hints"] = ["masters and codetables list ids", "fields <masterId>, then field <masterId> <seq>", "codetable <id> [<code>]", "search <keyword>", "schema"]
    return out


def _tables(spark: SparkSession, root: str, version: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(read(spark, root, version) for read in (catalog.fields, catalog.code_pairs, catalog.merge_groups))


def find(spark: SparkSession, root: str, version: str, keyword: str, scope: str = "all", master_id: str | None = None, limit: int | None = None) -> dict:
    """Hits in masters, then code tables, in the manifest's order. A given master leaves code tables out."""
    manifest = catalog.manifests(spark, root, version)
    fields, pairs, groups = _tables(spark, root, version)
    parts = []
    if scope in ("all", "master"):
        heads = F.broadcast(catalog.masters(manifest).select(F.col("pos").alias("entity_pos"), "master_id", "master_name"))  # a row for each master
        if master_id:
            _one(catalog._documents(spark, root, catalog.MASTER, version=version), "masterId", master_id, "master")
            fields = fields.filter(F.col("master_id") == master_id)
        parts.append(search.master_hits(fields.join(heads, "master_id"), keyword).withColumn("scope_no", F.lit(0)))
    if scope in ("all", "codetable") and not master_id:
        heads = F.broadcast(catalog.code_tables(manifest).select(F.col("pos").alias("entity_pos"), "table_id", "table_name", "kind"))
        parts += [search.pair_hits(pairs.join(heads, "table_id"), keyword).withColumn("scope_no", F.lit(1)), search.group_hits(groups.join(heads, "table_id"), keyword).withColumn("scope_no", F.lit(1))]
    most = limit if limit and limit > 0 else None
    rows = search.search(parts).orderBy("scope_no", "entity_pos", "pos") if parts else None
    found = _rows((rows.limit(most + 1) if most else rows).drop("scope_no", "entity_pos", "pos")) if rows is not None else []
    cut = bool(most) and len(found) > most
    found = found[:most] if cut else found
    return {"version": version, "keyword": keyword, "scope": scope, "hitCount": len(found), "truncated": cut, "hits": found}


def verify(spark: SparkSession, root: str, version: str, baseline: str | None = None) -> dict:
    """The report on a version: issues of each master and code table, and what differs from `baseline`."""
    manifest = catalog.manifests(spark, root, version)
    fields, pairs, groups = _tables(spark, root, version)
    masters = catalog.masters(manifest).withColumnRenamed("snapshot", "version")
    tables = catalog.code_tables(manifest).withColumnRenamed("snapshot", "version")
    # the documents tell how many fields there are and which kind a table has, the manifest how many rows
    kinds = catalog._documents(spark, root, catalog.CODE_TABLE, version=version).filter("codeTableId is not null").select(F.col("codeTableId").alias("table_id"), F.col("kind").alias("own_kind"))
    given = tables.join(kinds, "table_id", "left").select("version", "table_id", F.col("own_kind").alias("kind"))
    issues: dict[tuple, list[dict]] = {}
    for r in _rows(quality.table_issues(masters, given, fields, pairs, groups).orderBy("entity_kind", "entity_id", "place", "rank")):
        names = {"severity": "severity", "seq": "seq", "idx": "index", "code": "targetCode" if r["message"] in ("empty targetName", "no sources") else "code", "message": "message", "missing_count": "missingCount", "missing_ratio": "missingRatio"}
        issues.setdefault((r["entity_kind"], r["entity_id"]), []).append({names[k]: v for k, v in r.items() if k in names})
    counts = fields.groupBy("master_id").agg(F.count("*").alias("n"))
    now = masters.join(counts, "master_id", "left").select("pos", F.col("master_id").alias("id"), F.coalesce("n", F.lit(0)).alias("n"))
    rows_now = tables.select("pos", F.col("table_id").alias("id"), "kind", F.col("row_count").alias("n"))
    diffs: tuple[dict, dict] = ({}, {})
    if baseline:
        old = catalog.manifests(spark, root, baseline)
        before = (catalog.masters(old).select(F.col("master_id").alias("id"), F.col("field_count").alias("n")), catalog.code_tables(old).select(F.col("table_id").alias("id"), F.col("row_count").alias("n")))
        diffs = tuple({r["id"]: r for r in versioning.diff_counts(x, y, "id", "n").collect()} for x, y in zip((now, rows_now), before, strict=True))
    report: dict[str, Any] = {"version": version, "masters": [], "codeTables": [], "ok": True}
    for kind, place, key, count, source, found in (("master", "masters", "masterId", "fieldCount", now, diffs[0]), ("codetable", "codeTables", "codeTableId", "rowCount", rows_now, diffs[1])):
        for r in source.orderBy("pos").collect():  # a row for each master or table
            entry = {key: r["id"], **({"kind": r["kind"]} if kind == "codetable" else {}), count: r["n"], "issues": issues.get((kind, r["id"]), [])}
            if baseline:
                d = found[r["id"]]
                name = count[0].upper() + count[1:]
                entry["baselineDiff"] = {"status": "added"} if d["status"] == "added" else {"status": d["status"], f"{count}Delta": d["delta"], f"baseline{name}": d["baseline"]}
                if kind == "master" and d["large"]:
                    entry["issues"].append({"severity": "warning", "message": f"field count changed by {d['delta']:+d} ({d['delta'] * 100 / d['baseline']:+.0f}%) vs {baseline}"})
            report["ok"] &= all(i["severity"] != "error" for i in entry["issues"])
            report[place].append(entry)
    if baseline:
        report["baseline"] = baseline
        for name, x, y in (("baseline", now, before[0]), ("baselineCodeTable", rows_now, before[1])):
            changes = versioning.added_removed(x, y, "id").orderBy("id").collect()
            report[f"{name}Removed"] = [r["id"] for r in changes if r["change"] == "removed"]
            report[f"{name}Added"] = [r["id"] for r in changes if r["change"] == "added"]
    return report


def fetched(spark: SparkSession, root: str, url: str, version: str | None = None, kind: str | None = None, force: bool = False) -> dict:
    """Downloads a source file, or takes it from the cache, and prepares its version's folder with what stays of the last one.

    Its tables are read by a decoder of its format, which this package doesn't have; operators.groups, expand, records, recover
    and sources.snapshot go on from the decoder's tables.
    """
    try:
        name = fetch.file_name(url)
        version, kind = fetch.version_of(name, version), fetch.kind_of(name, kind)
        path, new = fetch.cached(url, Path(root) / "raw", force)
    except (ValueError, OSError) as e:
        raise Failure(str(e)) from e
    snapshot.seed(spark, root, version, kind)
    digest = catalog.content_hashes(spark, str(path)).collect()[0]["sha256"]
    return {"file": str(path), "downloaded": new, "version": version, "kind": kind, "sha256": digest, "folder": f"{root}/{version}"}


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    root = catalog.data_root(spark, a.data_dir)
    if a.command == "info":
        return info(spark, root)
    if a.command == "schema":
        return schema()
    if a.command == "fetch":
        return fetched(spark, root, a.url, a.version, a.kind, a.force)
    if a.command == "versions":
        return {"dataDir": root, "versions": [r[0] for r in catalog.versions(spark, root).collect()]}
    version = _version(spark, root, a.version)
    if a.command == "search":
        return find(spark, root, version, a.keyword, a.scope, a.master_id, a.limit)
    if a.command == "verify":
        return verify(spark, root, version, _version(spark, root, a.baseline) if a.baseline else None)
    if a.command in ("masters", "codetables"):
        column, count = ("masters", "masterCount") if a.command == "masters" else ("codeTables", "codeTableCount")
        rows = _rows(catalog.manifests(spark, root, version).select(F.posexplode(column).alias("pos", "x")).orderBy("pos").select("x.*"))
        if column == "masters":
            rows = [{"masterId": r["masterId"], "masterName": " / ".join(filter(None, (r.get("masterName"), r.get("subName")))), "fieldCount": r.get("fieldCount"), "pages": r.get("pages")} for r in rows]
        return {"version": version, count: len(rows), column: rows}
    if a.command == "codetable":
        table = _one(catalog._documents(spark, root, catalog.CODE_TABLE, version=version), "codeTableId", a.id, "code table")
        head = _rows(table.select("codeTableId", "codeTableName", "kind"))[0]
        pairs = head.get("kind") == "codeNamePairs"
        items = table.select(F.posexplode("codes" if pairs else "groups").alias("pos", "x"))
        if a.code is None:
            total = items.count()
            rows = _rows((items.orderBy("pos").limit(a.limit) if a.limit and a.limit > 0 else items.orderBy("pos")).select("x.*"))
            return {"version": version, **head, "rowCount" if pairs else "groupCount": total, "codes" if pairs else "groups": rows, "truncated": len(rows) < total}
        norm, key = catalog.T.code_key, _key(a.code)
        if pairs:
            hits = [{"match": "code", **r} for r in _rows(items.filter(norm(F.col("x.code")) == key).orderBy("pos").select("x.*"))]
        else:
            # a group's target comes before its sources, and a group is one hit
            sources = items.select("pos", "x", F.posexplode_outer("x.sources").alias("at", "s"))
            marked = sources.withColumn("match", F.when(norm(F.col("x.targetCode")) == key, "target").when(norm(F.col("s.code")) == key, "source")).filter("match is not null")
            best = marked.groupBy("pos").agg(F.min_by(F.struct("match", F.when(F.col("match") == "source", F.col("s")).alias("source"), F.col("x").alias("group")), "at").alias("r"))
            hits = _rows(best.orderBy("pos").select("r.*"))
        if not hits:
            raise Failure(f"code {a.code!r} not found in {a.id}\nhint: codetable {a.id} --limit 5 shows its codes")
        return {"version": version, **head, "hits": hits}
    master = _one(catalog._documents(spark, root, catalog.MASTER, version=version), "masterId", a.id, "master")
    fields = master.select(F.posexplode("fields").alias("pos", "f"))
    if a.command == "fields":
        head = _rows(master.select("masterId", "masterName", "subName"))[0]
        rows = fields.orderBy("pos").select("f.*")
        if a.summary:
            rows = rows.select("seq", "name", "mode", "maxBytes", (F.coalesce(F.size("codes"), F.lit(0)) > 0).alias("hasCodes"))
        out = _rows(rows)
        return {"version": version, **head, "fieldCount": len(out), "fields": out}
    matched = fields.filter(F.col("f.seq") == a.seq).orderBy("pos")
    rows = _rows(matched.select("f.*"))
    if not rows:
        near = [r[0] for r in fields.select(F.col("f.seq").alias("seq")).distinct().orderBy(F.abs(F.col("seq") - a.seq), "seq").limit(5).collect()]
        raise Failure(f"no field with seq={a.seq} in {a.id}\nhint: nearest = {near}")
    if a.command == "field":
        return {"version": version, "masterId": a.id, "fields": rows}
    first = rows[0]  # codes are looked up in the number's first field only
    if not first.get("codes"):
        raise Failure(f"seq={a.seq} ({first['name']!r}) has no codes\nhint: field {a.id} {a.seq} shows it")
    hits = [{"field": first["name"], "code": c} for c in first["codes"] if _key(c["code"]) == _key(a.code)]
    if not hits:
        raise Failure(f"code {a.code!r} not found in {a.id} seq={a.seq}\nhint: available codes = {[c['code'] for c in first['codes']]}")
    return {"version": version, "masterId": a.id, "hits": hits}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kumiko", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--data-dir")
    commands = p.add_subparsers(dest="command", required=True)
    for name, arguments in {"info": (), "schema": (), "skill": (), "search": ("keyword",), "verify": (), "fetch": ("url",), "versions": (), "masters": (), "codetables": (), "fields": ("id",), "field": ("id", "seq"), "code": ("id", "seq", "code"), "codetable": ("id",)}.items():
        c = commands.add_parser(name)
        c.add_argument("--version")
        for x in arguments:
            c.add_argument(x, type=int if x == "seq" else str)
        if name == "fields":
            c.add_argument("--summary", action="store_true")
        if name == "codetable":
            c.add_argument("code", nargs="?")
        if name in ("codetable", "search"):
            c.add_argument("--limit", type=int)
        if name == "search":
            c.add_argument("--scope", choices=["all", "master", "codetable"], default="all")
            c.add_argument("--master-id")
        if name == "verify":
            c.add_argument("--baseline")
        if name == "fetch":
            c.add_argument("--kind", choices=["master", "appendix"])
            c.add_argument("--force", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "skill":
        print((files(__package__) / "GUIDE.md").read_text(encoding="utf-8"), end="")
        return 0
    try:
        result = run(spark or session(), a)
    except Failure as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(result, ensure_ascii=False, indent=2))
    return int(a.command == "verify" and not result["ok"])


if __name__ == "__main__":
    sys.exit(main())
