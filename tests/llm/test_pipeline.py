import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm.simhash import fingerprint

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "re", "sa"], "bb": ["zwo", "grü", "ßen", "äch", "pft", "kno"]}


def text(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(n))


def tables(spark, folder):
    """Clean documents 0 to 199; from 300 on a planted case each."""
    r = random.Random(7)
    rows = [(i, f"{text(r, 'aa' if i % 2 else 'bb', 60)}\n{text(r, 'aa' if i % 2 else 'bb', 30)}", "aa" if i % 2 else "bb", f"s{i % 7}", 1) for i in range(200)]
    passage = text(r, "aa", 40)
    long = text(random.Random(1), "aa", 3000)
    assert (fingerprint(long) ^ fingerprint(long + " ka")).bit_count() <= 2
    planted = [
        (300, "123 !! 456", None, "s1", 1),
        (301, rows[10][1], "bb", "s3", 1),  # an exact copy
        (302, long, "aa", "s4", 1),
        (305, long + " ka", "aa", "s5", 1),  # a near copy
        (303, f"{text(r, 'aa', 30)} {passage} {text(r, 'aa', 30)}", "aa", "s5", 1),  # contaminated
        (304, None, None, "s6", 1),
        *((310 + k, f"subscribe to our weekly letter today\n{text(r, 'bb', 50)}", "bb", f"s{k}", 1) for k in range(4)),
    ]
    spark.createDataFrame(rows + planted, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {x[0]: x for x in rows + planted}


def test_stages_and_run(spark, tmp_path):
    given = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    schema, left = docs.schema, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in schema], name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left[name] = {r.doc_id: r for r in docs.collect()} if k < 4 else docs.collect()
    clean = set(range(200))
    assert set(given) - set(left["language"]) == {300, 304}
    assert set(left["line_dedup"]) == set(left["language"])
    assert left["line_dedup"][310].text == given[310][1]
    assert all(left["line_dedup"][k].text == given[k][1].split("\n")[1] for k in (311, 312, 313))
    assert set(left["line_dedup"]) - set(left["near_dedup"]) == {301, 305}
    assert set(left["near_dedup"]) - set(left["decontaminate"]) == {303}
    assert clean <= set(left["decontaminate"]) and all(left["decontaminate"][i].text == given[i][1] for i in clean)
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    pieces = sorted(left["packing"], key=lambda p: (p.doc_id, p.start))
    for i, d in left["decontaminate"].items():
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in pieces if p.doc_id == i])
        assert ids.tolist() == [*encode(d.text, add_special_tokens=False).ids, 1]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, left["packing"]))


def test_empty(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_spans_go_from_documents_that_stay(spark, tmp_path):
    tables(spark, tmp_path)
    passage = spark.read.parquet(f"{tmp_path}/benchmark.parquet").first().text
    r = random.Random(8)
    before, after = text(r, "bb", 1500), text(r, "bb", 1500)
    docs = spark.createDataFrame([(1, f"{before} {passage} {after}"), (2, before), (3, None)], "doc_id long, text string")
    got = {x.doc_id: x.text for x in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()}
    assert got == {1: f"{before}  {after}", 2: before, 3: None}


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Missing ids, repeated rows, rows that repeat an id, very long texts and columns with the stages' own names."""
    tables(spark, tmp_path)
    r = random.Random(9)
    plain, other, huge = (text(r, "aa", n) for n in (60, 60, 120_000))
    one_run = "".join(r.choices("kalomituresa", k=50_000))
    names = ["print", "component_id", "hit_words", "n_words", "lang_pred", "lines_gone", "stays", "one_row", "DOC_id2"]
    rows = [(500, plain), (500, plain), (501, other), (501, other + " ka lo"), (None, text(r, "bb", 50)), (None, text(r, "bb", 50)), (502, huge), (503, one_run), (504, None), (505, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n in names:
        docs = docs.withColumn(n, docs.source)
    docs = docs.unionByName(spark.createDataFrame([(*x, None, None, None, *["x"] * len(names)) for x in rows], schema))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/odd{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/odd{k}")
    left = {x.doc_id: x.text for x in before.where("doc_id >= 500").collect()}
    assert left == {500: plain, 501: min(other, other + " ka lo"), 502: huge, 503: one_run}
    assert before.where("doc_id IS NULL").count() == 2 and before.where("doc_id = 500").count() == 1
    assert docs.where("doc_id IS NULL AND start = 0").count() == 2
    assert docs.where("doc_id = 502").agg({"length": "sum"}).first()[0] == docs.where("doc_id = 502").first().doc_tokens
