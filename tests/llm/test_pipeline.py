import corpus_pipeline as C
from shopsmith.llm import rlz, simhash
from shopsmith.llm.common import stage

SF = "/root/testdata/sf0.01"


def test_stages_decide_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, step in C.STAGES[:-1]:
        before = docs
        docs = stage(step(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "simhash_near_dedup":
            want = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "substring_dedup":
            cut = {r["doc_id"]: r["kept_text"] for r in rlz.remove_duplicates(before).filter("n_removed > 0").collect()}
            assert {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in cut} == cut
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4]
    assert docs.filter("text rlike 'token = \"[0-9a-f]{40}\"'").count() == 0


def test_run_packs_what_is_left(spark):
    got = C.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)
    assert got.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0
