from helpers import SF, no_docs, odd_docs, texts

import corpus_pipeline as p
from trustlens.llm.ngram_jaccard import ngram_components
from trustlens.llm.pii import base_spans
from trustlens.llm.quality_mcd import judged
from trustlens.llm.tiling import contaminated


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, everything = docs.columns, texts()
    for i, (name, stage) in enumerate(p.STAGES[:-1]):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(set(ids)) == len(ids)
        if name == "quality":
            want = {r.doc_id for r in judged(before, "doc_id").filter("kept").collect()}
            assert set(ids) == want
        elif name == "near_duplicates":
            groups = {}
            for r in ngram_components(before).collect():
                groups.setdefault(r.component_id, set()).add(r.doc_id)
            assert all(len(g & set(ids)) == 1 for g in groups.values()) and len(ids) == len(groups)
        elif name == "decontaminate":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            gone = {r.doc_id for r in contaminated(before, bench).collect()}
            assert set(ids) == {r.doc_id for r in before.select("doc_id").collect()} - gone and gone
        else:
            assert set(ids) == {r.doc_id for r in before.select("doc_id").collect()}
            rows = docs.collect()
            assert not any(base_spans(r.text) for r in rows) and any(r.text != everything[r.doc_id] for r in rows)
            assert all(r.text == everything[r.doc_id] for r in rows if not base_spans(everything[r.doc_id]) and "<" not in r.text)
    packed = p.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(ids)


def test_odd_tables(spark):
    odd = odd_docs(spark).withColumn("n_chars", p.F.lit(1).cast("long"))
    for docs in (odd, no_docs(spark)):
        for _, stage in p.STAGES:
            out = stage(spark, docs, SF)
            out.write.format("noop").mode("overwrite").save()
    dup = p.near_duplicates(spark, odd, SF)
    assert dup.columns == odd.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in dup.collect())
    assert len(got) == len(set(got))
    assert sum(r.text is None or not r.text.strip() for r in dup.collect()) == 3
