import json

import pytest

from kumiko import cli


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("snapshots")
    for v in ("20260101", "20260201"):
        (at / v).mkdir()
        files = {
            "manifest": {"version": v, "masters": [{"masterId": "m", "masterName": "N", "subName": "S", "pages": {"start": 1, "end": 2}, "fieldCount": 3}], "codeTables": [{"codeTableId": "p", "codeTableName": "P", "kind": "codeNamePairs", "rowCount": 2}]},
            "m": {"masterId": "m", "masterName": "N", "subName": "S", "fields": [{"seq": 1, "name": "a"}, {"seq": 1, "name": "b", "codes": [{"code": "1", "name": "x"}]}, {"seq": 9, "name": "c", "codes": [{"code": "1", "name": "one"}, {"code": "１", "name": "wide"}]}]},
            "p": {"codeTableId": "p", "codeTableName": "P", "kind": "codeNamePairs", "codes": [{"code": "01", "name": "x"}, {"code": "02", "name": "y"}]},
            "g": {"codeTableId": "g", "codeTableName": "G", "kind": "nayoseGroups", "groups": [{"targetCode": "5", "targetName": "t", "sources": [{"code": "5", "name": "s"}]}, {"targetCode": "6", "targetName": "u", "sources": [{"code": "5", "name": "s"}, {"code": "5", "name": "again"}]}]},
        }
        for name, body in files.items():
            (at / v / f"{name}.json").write_text(json.dumps(body, ensure_ascii=False))
    return str(at)


@pytest.fixture
def call(spark, root, capsys):
    def f(*argv):
        code = cli.main(["--data-dir", root, *argv], spark)
        got = capsys.readouterr()
        return json.loads(got.out) if code == 0 else got.err

    return f


def test_listings(call):
    assert call("versions")["versions"] == ["20260101", "20260201"]
    assert call("masters") == {"version": "20260201", "masterCount": 1, "masters": [{"masterId": "m", "masterName": "N / S", "fieldCount": 3, "pages": {"start": 1, "end": 2}}]}
    assert call("codetables", "--version", "20260101")["codeTableCount"] == 1
    assert [f["hasCodes"] for f in call("fields", "m", "--summary")["fields"]] == [False, True, True]


def test_lookups(call):
    assert [f["name"] for f in call("field", "m", "1")["fields"]] == ["a", "b"]
    assert [h["code"]["name"] for h in call("code", "m", "9", "１")["hits"]] == ["one", "wide"]
    assert call("codetable", "p", " ０２")["hits"] == [{"match": "code", "code": "02", "name": "y"}]
    assert [(h["match"], h["group"]["targetCode"], h.get("source", {}).get("name")) for h in call("codetable", "g", "5")["hits"]] == [("target", "5", None), ("source", "6", "s")]
    got = call("codetable", "p", "--limit", "1")
    assert (got["rowCount"], len(got["codes"]), got["truncated"]) == (2, 1, True)


def test_errors(call):
    assert "available = ['20260101', '20260201']" in call("masters", "--version", "x")
    assert "available = ['m']" in call("fields", "z")
    assert "nearest = [1, 9]" in call("field", "m", "4")
    assert "has no codes" in call("code", "m", "1", "1")  # the number's second field isn't reached
    assert "available codes" in call("code", "m", "9", "2") and "not found" in call("codetable", "p", "9")


@pytest.fixture(scope="module")
def flawed(tmp_path_factory):
    at = tmp_path_factory.mktemp("flawed")

    def put(v, name, body):
        (at / v).mkdir(exist_ok=True)
        (at / v / f"{name}.json").write_text(json.dumps(body, ensure_ascii=False))

    def manifest(v, masters, tables):
        put(v, "manifest", {"version": v, "masters": [{"masterId": m, "masterName": f"N{m}", "fieldCount": n} for m, n in masters], "codeTables": [{"codeTableId": t, "codeTableName": f"T{t}", "kind": k, "rowCount": n} for t, k, n in tables]})

    fields = lambda *seqs: [{"seq": x, "name": f"f{x}", "mode": "text"} for x in seqs]
    manifest("20260101", [("a", 3), ("old", 1), ("big", 10)], [("p", "codeNamePairs", 1), ("gone", "codeNamePairs", 1)])
    put("20260101", "a", {"masterId": "a", "fields": fields(1, 2, 3)})
    put("20260101", "old", {"masterId": "old", "fields": fields(1)})
    put("20260101", "big", {"masterId": "big", "fields": fields(*range(1, 11))})
    put("20260101", "p", {"codeTableId": "p", "kind": "codeNamePairs", "codes": [{"code": "1", "name": "x"}]})
    put("20260101", "gone", {"codeTableId": "gone", "kind": "codeNamePairs", "codes": [{"code": "1", "name": "x"}]})
    manifest("20260201", [("a", 3), ("big", 2), ("none", 0), ("bad", 5)], [("p", "codeNamePairs", 5), ("g", "nayoseGroups", 2), ("odd", "other", 0), ("void", "codeNamePairs", 0)])
    put("20260201", "a", {"masterId": "a", "masterName": "Na", "fields": fields(6, 7, 8)})
    put("20260201", "big", {"masterId": "big", "masterName": "Nbig", "fields": fields(1, 4, 5)})
    put("20260201", "none", {"masterId": "none", "masterName": "Nnone", "fields": []})
    put("20260201", "bad", {"masterId": "bad", "masterName": "Nbad", "fields": [{"seq": 1, "name": ""}, {"seq": 2, "name": "a\nKey word"}, {"seq": 3, "name": "x/グルー"}, {"seq": 4, "name": "ok", "mode": "roman", "shortName": "KEY"}, {"seq": 5, "name": "codes", "description": "line\nwith key here", "codes": [{"code": "7", "name": "n" * 201}, {"code": "8", "name": "a key"}]}, {"seq": 6, "name": "six", "codes": [{"code": str(i), "name": f"key {i}"} for i in range(7)]}]})
    put("20260201", "p", {"codeTableId": "p", "codeTableName": "Tp", "kind": "codeNamePairs", "codes": [{"code": "1", "name": "x"}, {"code": "½", "name": "half"}, {"code": "①", "name": "ring"}, {"code": "", "name": ""}, {"code": "1", "name": "Key again"}]})
    put("20260201", "g", {"codeTableId": "g", "codeTableName": "Tg", "kind": "nayoseGroups", "groups": [{"targetCode": "", "targetName": "t", "sources": [{"code": "5", "name": "the key"}], "note": "no"}, {"targetCode": "6", "targetName": "", "sources": [], "note": "a KEY note"}]})
    put("20260201", "odd", {"codeTableId": "odd", "kind": "other"})
    put("20260201", "void", {"codeTableId": "void", "kind": "codeNamePairs", "codes": []})
    return str(at)


def test_verify(spark, flawed, capsys):
    assert cli.main(["--data-dir", flawed, "verify", "--version", "20260101"], spark) == 0
    assert json.loads(capsys.readouterr().out)["ok"] is True
    assert cli.main(["--data-dir", flawed, "verify", "--baseline", "20260101"], spark) == 1
    got = json.loads(capsys.readouterr().out)
    masters = {m["masterId"]: m for m in got["masters"]}
    # numbers of two versions never meet
    assert masters["a"]["issues"] == [] and masters["a"]["baselineDiff"] == {"status": "same", "fieldCountDelta": 0, "baselineFieldCount": 3}
    assert masters["none"]["issues"] == [{"severity": "error", "message": "no fields extracted"}] and masters["none"]["baselineDiff"] == {"status": "added"}
    assert masters["big"]["issues"] == [{"severity": "error", "message": "missing seq numbers: [2, 3]", "missingCount": 2, "missingRatio": 0.4}, {"severity": "warning", "message": "field count changed by -7 (-70%) vs 20260101"}]
    assert [(i.get("seq"), i["message"].split(":")[0], i.get("code")) for i in masters["bad"]["issues"]] == [(1, "empty name", None), (2, "name contains newline", None), (3, "name may be truncated mid-word", None), (4, "unexpected mode value", None), (5, "code name too long (>200 chars); may contain spillover description", "7")]
    assert masters["bad"]["issues"][1]["message"] == "name contains newline: 'a\\nKey word'"
    tables = {t["codeTableId"]: t["issues"] for t in got["codeTables"]}
    assert tables["p"] == [
        {"severity": "warning", "message": "non-digit code", "index": 1, "code": "½"}, {"severity": "error", "message": "empty code", "index": 3}, {"severity": "error", "message": "empty name", "index": 3, "code": ""},
        {"severity": "warning", "message": "duplicate code (also at index 0)", "code": "1"},
    ]
    assert [i["message"] for i in tables["g"]] == ["empty targetCode", "empty targetName", "no sources"]
    assert [i["message"] for i in tables["odd"]] == ["unknown kind: 'other'"] and [i["message"] for i in tables["void"]] == ["no codes extracted"]
    assert (got["baselineRemoved"], got["baselineAdded"], got["baselineCodeTableRemoved"], got["baselineCodeTableAdded"]) == (["old"], ["bad", "none"], ["gone"], ["g", "odd", "void"])


def test_search(spark, flawed, capsys):
    def call(*argv):
        assert cli.main(["--data-dir", flawed, "search", *argv], spark) == 0
        return json.loads(capsys.readouterr().out)

    got = call("key")
    assert got["hitCount"] == 7 and got["truncated"] is False
    assert [(h["type"], h.get("seq"), h.get("where")) for h in got["hits"]] == [("master", 2, ["name"]), ("master", 4, ["shortName"]), ("master", 5, ["description"]), ("master", 6, ["code"]), ("codeTable", None, None), ("codeTable", None, ["sources"]), ("codeTable", None, ["note"])]
    five = next(h for h in got["hits"] if h.get("seq") == 5)
    assert five["snippet"] == "line with key here" and [c["code"] for c in five["codes"]] == ["8"]
    assert len(next(h for h in got["hits"] if h.get("seq") == 6)["codes"]) == 5
    assert next(h for h in got["hits"] if h.get("where") == ["note"])["snippet"] == "a KEY note"
    assert call("key", "--limit", "2")["truncated"] is True and call("key", "--limit", "2")["hitCount"] == 2
    assert {h["type"] for h in call("key", "--scope", "codetable")["hits"]} == {"codeTable"}
    assert {h["masterId"] for h in call("key", "--master-id", "bad")["hits"]} == {"bad"}
    assert call("a.*b")["hits"] == []


def test_info_schema_guide(spark, flawed, tmp_path, capsys, monkeypatch):
    assert cli.main(["--data-dir", flawed, "info"], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["latestVersion"] == "20260201" and got["latest"]["masterIds"] == ["a", "big", "none", "bad"] and got["latest"]["codeTableCount"] == 4
    assert cli.main(["schema"], spark) == 0
    shape = json.loads(capsys.readouterr().out)
    assert shape["code"] == {"code": "string", "name": "string"} and shape["master"]["fields"][0]["seq"] == "int" and "sourcePdf" not in shape["manifest"]
    assert cli.main(["skill"], spark) == 0 and "kumiko search" in capsys.readouterr().out
    monkeypatch.chdir(tmp_path)
    assert cli.main(["info"], spark) == 0
    assert json.loads(capsys.readouterr().out)["availableVersions"] == []
    assert cli.main(["masters"], spark) == 1 and "no versions" in capsys.readouterr().err
    (tmp_path / "data").symlink_to(flawed)
    monkeypatch.chdir(tmp_path)
    assert cli.main(["versions"], spark) == 0
    assert json.loads(capsys.readouterr().out)["versions"] == ["20260101", "20260201"]


def test_fetch(spark, flawed, tmp_path, capsys):
    import hashlib
    import shutil

    root = tmp_path / "data"
    shutil.copytree(flawed, root)
    source = tmp_path / "master_2_20260301.pdf"
    source.write_bytes(b"%PDF- invented")
    url = source.as_uri()
    assert cli.main(["--data-dir", str(root), "fetch", url], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert (got["kind"], got["version"], got["downloaded"], got["sha256"]) == ("appendix", "20260301", True, hashlib.sha256(b"%PDF- invented").hexdigest())
    manifest = json.loads((root / "20260301" / "manifest.json").read_text())
    # the other kind's documents stay, this one's are to come
    assert manifest["version"] == "20260301" and len(manifest["masters"]) == 4 and manifest["codeTables"] == []
    assert cli.main(["--data-dir", str(root), "fetch", url], spark) == 0
    assert json.loads(capsys.readouterr().out)["downloaded"] is False
    assert cli.main(["--data-dir", str(root), "fetch", (tmp_path / "x.txt").as_uri()], spark) == 1
    assert cli.main(["--data-dir", str(root), "fetch", (tmp_path / "other_20260301.pdf").as_uri()], spark) == 1 and "kind" in capsys.readouterr().err
