"""The stages against brute-force versions of what each one decides."""

import corpus_pipeline as C
from test_decontaminate import plain as plain_contamination
from test_packing import REFERENCE, check
from test_secrets import plain_base
from test_simhash import expected as plain_groups

from pagelens.llm import packing, secrets, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_decide_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, rows, packed = docs.columns, {r.doc_id: r for r in docs.collect()}, None
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    model = secrets.train(docs)  # any model: the masked texts are held against the base rules
    frame = docs
    for name, stage in C.STAGES:
        before = {d: r.text for d, r in rows.items()}
        frame = C.written(stage(spark, frame, SF), f"test-{name}")
        if name == "packing":
            packed = frame.collect()
            break
        assert frame.columns == names
        rows = {r.doc_id: r for r in frame.collect()}
        assert frame.count() == len(rows) > 0.5 * len(before)
        if name == "toxicity":
            assert set(rows) == {d for d in before if not scores[d]}
        elif name == "near_duplicates":
            assert set(rows) == {group for _, _, group in plain_groups(list(before.items()))}
        elif name == "decontamination":
            assert set(rows) == {d for d, *_, hit in plain_contamination(before.items(), items) if not hit}
        elif name == "secrets":
            assert set(rows) == set(before)
            for d, r in rows.items():
                assert not plain_base(r.text) and r.n_chars == len(r.text)
                if not secrets.scan_texts([before[d]], model)[0]:
                    assert r.text == before[d]
    n, total = check(packed, [(d, r.text) for d, r in rows.items()], REFERENCE, packing.CAPACITY)
    assert n <= 1.01 * total / packing.CAPACITY + 1


def test_run_and_awkward_documents(spark, tmp_path):
    for name, rows, schema in (
        ("documents", [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b c d", None, "s", 7), (2, "a b c d", None, "s", 7)],
         "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [(1, "")], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert sorted((r.doc_id, r.length) for r in C.run(spark, str(tmp_path)).collect()) == [(1, 1), (2, 5)]
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
