"""Stages of the corpus pipeline against their operators, run on what the stage before kept."""

from collections import Counter

import corpus_pipeline as p
from loomstead.llm.queries import tokenizer_file

from .helpers import ODD, frame
from .test_operators import brute_base, brute_jaccard, check_pack


def test_pipeline_stage_by_stage(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        steps[name] = (docs, docs := spark.read.parquet(str(tmp_path / name)))
    assert [n for n, _ in p.STAGES] == ["language_id", "quality_rules", "near_duplicates", "best_fit_packing"]
    assert all(steps[n][1].columns == columns for n, _ in p.STAGES[:-1])
    before, after = (x.collect() for x in steps["quality_rules"])
    kept = {r.doc_id for r in after}
    assert not any(brute_base(r.text)[5] for r in after) and len(kept) > 0.5 * len(before)
    before, after = (x.collect() for x in steps["near_duplicates"])
    roots = {root for _, _, _, root in brute_jaccard([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in after) == sorted(roots)
    before, after = (x.collect() for x in steps["best_fit_packing"])
    n, least = check_pack(after, [(r.doc_id, r.text) for r in before])
    assert n <= least + 1
    whole = p.run(spark, sf)
    digest = lambda rows: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert digest(whole.collect()) == digest(after)
    assert tokenizer_file("x", "/somewhere") == "/somewhere/x"


def test_pipeline_odd_rows(spark, sf):
    docs = frame(spark, ODD)
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    rows = docs.collect()
    assert docs.columns == frame(spark, ODD).columns
    assert {r.doc_id for r in rows} <= {1, 8, None, 11, 12} and 1 in {r.doc_id for r in rows}
