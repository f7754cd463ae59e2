"""The stages one after the other on small tables, each against what its operator says."""

import corpus_pipeline
from barloom.llm import decontaminate
from barloom.llm.common import settle, table

from .helpers import SMALL
from .test_similar import plain_kept


def test_each_stage_takes_effect(spark):
    docs, seen = table(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, SMALL), name)
        seen[name] = (before, docs)
        if name != "token_records":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    ids = {n: ({r.doc_id for r in a.collect()}, {r.doc_id for r in b.collect()}) for n, (a, b) in seen.items()}
    assert all(after <= before for before, after in ids.values())
    before, after = seen["simhash_near_dedup"]
    assert ids["simhash_near_dedup"][1] == plain_kept([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()])
    before, after = seen["benchmark_decontamination"]
    hit = {r.doc_id for r in decontaminate.report(before, table(spark, SMALL, "benchmark")).filter("contaminated").collect()}
    assert ids["benchmark_decontamination"][1] == ids["benchmark_decontamination"][0] - hit
    before, after = seen["token_records"]
    assert before.count() == after.count() > 0


def test_odd_rows_pass_every_stage(spark):
    """Nulls in every column, empty and repeated rows, clashing columns, and an empty table."""
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text, "en", "a", 1), (2, text, "en", "a", 1), (3, None, None, None, None), (None, "some other words entirely", "en", None, 2), (5, "", "", "", 0), (6, "kept as it is here", "en", "a", 3), (6, "kept as it is here", "en", "a", 3)]
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    wide = spark.createDataFrame(rows, fields).selectExpr("*", "'x' AS node", "1 AS size", "2 AS fp", "3 AS hash", "'y' AS toxic")
    for docs in (wide, wide.limit(0)):
        seen = {}
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, settle(stage(spark, docs, SMALL), name)
            seen[name] = docs.collect()
            if name != "token_records":
                assert docs.columns == before.columns and docs.dtypes == before.dtypes
        if seen["toxicity"]:
            assert sorted((r.doc_id or 0, r.text or "") for r in seen["toxicity"]) == sorted((i or 0, t or "") for i, t, *_ in rows)
            assert sorted((r.doc_id or 0) for r in seen["simhash_near_dedup"]) == [0, 1, 3, 6, 6]
            assert len(seen["benchmark_decontamination"]) == 5
            assert all(r.text for r in seen["mixing"]) and len(seen["token_records"]) == len(seen["mixing"])
        else:
            assert not any(seen.values())
