import corpus_pipeline
from ledgerlens.llm import decontamination, pii, simhash
from ledgerlens.llm.support import ready, table

SF = "/root/testdata/sf0.01"


def test_every_stage_takes_effect(spark, tmp_path):
    docs = table(ready(spark), SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        seen[name], docs = (docs, spark.read.parquet(path)), spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = seen["language_id"]
    assert after.count() == before.count()  # every document of the table is in a learned language
    before, after = seen["simhash_near_dedup"]
    found = {r.doc_id: r.component_id for r in simhash.simhash_components(before).collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == set(found.values()) and after.count() < before.count()
    before, after = seen["benchmark_decontamination"]
    items = [decontamination.normal(r.text) for r in table(spark, SF, "benchmark").collect()]
    dirty = {r.doc_id for r in before.collect() if any(i in decontamination.normal(r.text) for i in items)}
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert dirty <= gone and len(gone) <= len(dirty) + 3
    before, after = seen["pii"]
    assert before.count() == after.count()
    assert not any(pii.base_spans(r.text) for r in after.collect())
    changed = {r.doc_id for r in after.join(before.select("doc_id", before.text.alias("old")), "doc_id").where("text <> old").collect()}
    assert changed >= {r.doc_id for r in before.collect() if pii.base_spans(r.text)}
    before, after = seen["best_fit_packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_run_on_an_odd_table(spark, docs_of, tmp_path):
    words = "the house and the garden were in the town with all of that".split()
    rows = [(i, " ".join(words[i % 7 :] + [f"w{chr(97 + i)}{chr(97 + j)}" for j in range(20)])) for i in range(20)]
    rows += [(50, None), (51, ""), (52, "123 456"), (None, "the house and some other garden in that town"), (1, rows[1][1])]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out]
    assert not {50, 51, 52} & set(ids) and None in ids and len(ids) == len(set(ids))


#: Names that the stages use inside, for columns that a table may have as well.
INTERNAL = (
    "_version version v row rows spans base found fp fingerprint component_id least least_id count d k s r a b c p x y t o u m n "
    "node root key id words word anchors passage anchor windows kept wanted places place pattern surface kind kinds end at "
    "patterns confidence size weight as_kind more best two wider added block blocks bin bins item item_id island own guest "
    "filled typical squares length piece start sequence_id offset ids ids_crc32 lang_pred held_out score known share label "
    "letters distance passages error budget part seq file shard slot total earlier rank old new keep stay loose"
).split()


def test_every_stage_keeps_columns_of_any_name(spark, docs_of, tmp_path):
    words = "the house and the garden were in the town with all of that".split()
    rows = [(i, " ".join(words[i % 7 :] + [f"w{chr(97 + i)}{chr(97 + j)}" for j in range(20)])) for i in range(12)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, "the house and some other garden in that town"), (20, f"call a{1}@b.de now, the house and the garden were in the town")]
    docs = docs_of(rows).selectExpr("*", *[f"concat('{name}', doc_id) as `{name}`" for name in INTERNAL])
    spark.createDataFrame([(1, "a passage that no text of these here holds")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        if name == corpus_pipeline.STAGES[-1][0]:
            break
        assert out.columns == docs.columns
        docs = spark.read.parquet(path)
        for r in docs.collect():
            assert r.doc_id is None or all(r[n] == f"{n}{r.doc_id}" for n in INTERNAL)
    assert {r.doc_id for r in spark.read.parquet(path).collect()} == {r[0] for r in rows}
