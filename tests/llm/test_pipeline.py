import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from kumiko.llm import byte_bpe

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def tables(spark, folder, docs):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int("nastyword" in (t or ""))) for i, t in docs if i is not None and i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("1", " ".join(f"bench{k}" for k in range(14)))], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda n=60: " ".join(word() for _ in range(n))
    docs = [(i, text() + (" nastyword" if i % 8 in (3, 4) else "")) for i in range(120)]
    passage = text(50)
    clean = [(200 + i, text()) for i in range(6)]
    docs += clean + [(300, clean[0][1]), (301, clean[0][1]), (302, text() + " " + passage + " " + text()), (303, text(30) + " " + passage), (304, text(20) + " " + " ".join(f"Bench{k}" for k in range(12)) + " end"), (305, None), (306, ""), (307, "short"), (307, "short"), (None, text())]
    tables(spark, tmp_path, docs)
    root, docs_now, seen = f"file://{tmp_path}", spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs_now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs_now, root)
        out.write.parquet(f"{tmp_path}/{name}")
        docs_now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {x["doc_id"]: x for x in docs_now.collect()}
        if k < 4:
            assert docs_now.columns == columns
    ids = {n: set(x) for n, x in seen.items()}
    toxic = {i for i in range(120) if i % 8 in (3, 4)}
    assert ids["toxicity"] == {i for i, _ in docs} - toxic
    # 305 and 306 have no words and fingerprint zero; of them and of copies the smallest id stays
    assert ids["near_dedup"] == ids["toxicity"] - {300, 301, 306}
    assert docs_now.filter("doc_id = 307").count() == 1
    after = seen["suffix_dedup"]
    assert passage not in after[302]["text"] and passage not in after[303]["text"] and len(after[302]["text"]) > 500
    assert after[302]["n_chars"] == len(after[302]["text"]) and after[305]["text"] is None
    assert after[200]["text"] == clean[0][1]
    assert ids["decontaminate"] == ids["suffix_dedup"] - {304}
    assert ids["encode"] == ids["decontaminate"]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for i, x in seen["encode"].items():
        text = seen["decontaminate"][i]["text"] or ""
        raw = struct.pack(f"<{x['n_tokens']}I", *library.encode_ordinary(text))
        assert (x["ids"], x["ids_sha256"], x["decoded_sha256"]) == (raw, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_extra_columns_and_a_long_text(spark, tmp_path):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    docs = [(i, " ".join(word() for _ in range(40))) for i in range(8)] + [(9, " ".join(word() for _ in range(30_000)))]
    tables(spark, tmp_path, docs)
    names = ["label", "row", "mark", "open", "found", "settled", "spans", "items", "n_words", "fp", "node", "gone", "keys", "h", "at"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", *(f"doc_id + {k} AS {n}" for k, n in enumerate(names)))
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, f"file://{tmp_path}")
        assert now.columns == columns, name
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    assert {x["doc_id"]: (x["text"], x["label"], x["at"]) for x in now.collect()} == {i: (t, i, i + 14) for i, t in docs}


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
