"""The pipeline against its stages by brute force, on the smallest documents."""

from __future__ import annotations

import re

import numpy as np
from test_dedup import brute_simhash
from test_formats import check_pack

import corpus_pipeline as pipeline
from larkspur.llm import mixing
from larkspur.llm.tables import load, materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = load(spark, SF, "documents")
    out = dict.fromkeys(name for name, _ in pipeline.STAGES)
    now = docs
    for name, stage in pipeline.STAGES:
        out[name] = now = materialise(stage(spark, now, SF), name)
        assert name == "best_fit_packing" or now.columns == docs.columns
    all_rows = docs.collect()
    kept = {r.doc_id for r in out["language_id"].collect()}
    assert kept == {r.doc_id for r in all_rows if re.search(r"[^\W\d_]", r.text or "")}

    first: dict[str, int] = {}
    for r in sorted((r for r in all_rows if r.doc_id in kept), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    unique = out["exact_dedup"].collect()
    assert {r.doc_id for r in unique} == set(first.values()) and len(unique) == len(first)

    ids = sorted(r.doc_id for r in unique)
    texts = {r.doc_id: r.text for r in unique}
    fps = np.array([brute_simhash(texts[i]) for i in ids], np.uint64)
    root = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4).tolist():
                low = min(root[i], root[j])
                changed |= root[i] != low or root[j] != low
                root[i] = root[j] = low
    assert {r.doc_id for r in out["simhash_near_dedup"].collect()} == {ids[i] for i in set(root)}

    taken = {r.doc_id: int(r.taken / r.size + 0.5) for r in mixing.mix(out["simhash_near_dedup"]).collect() if r.size}
    copies: dict[int, int] = {}
    for r in out["source_mixing"].collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {i: n for i, n in taken.items() if n}
    check_pack(out["source_mixing"], out["best_fit_packing"].collect())


def test_odd_and_empty_tables(spark, odd):
    """Every stage keeps the columns, whatever their names, and takes nulls, blanks, repeats and an empty table."""
    from pyspark.sql import functions as F

    for name in ("_score", "lang_pred", "a.b", "gone_id", "_copy", "_times"):
        odd = odd.withColumn(name, F.lit("clash"))
    for docs in (odd, odd.limit(0)):
        now = docs
        for name, stage in pipeline.STAGES:
            out = materialise(stage(spark, now, SF), name)
            assert out.count() <= now.count() or name in ("source_mixing", "best_fit_packing")
            if name != "best_fit_packing":
                assert out.columns == docs.columns
                assert all(r["a.b"] == r["_score"] == "clash" for r in out.collect())
            now = out
        assert (now.count() > 0) == (docs is odd)
