"""The pipeline's stages against brute force, and on hostile tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import pii, quality
from quillon.llm.common import table

from test_operators import brute, check_packing, measured, slow_fingerprint


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "personal_data", "packing"]

    told = stages["language"](spark, docs, sf)
    assert told.columns == columns and 0.9 * before < told.count() <= before

    ruled = stages["quality"](spark, told, sf)
    assert ruled.columns == columns
    texts = {r["doc_id"]: r["text"] for r in ruled.collect()}
    for t in texts.values():
        n, _, symbols, _, repeated = measured(t)
        assert n >= 20 and 100 * repeated <= 30 * n and symbols <= 0.3 * n
    good = {r["doc_id"] for r in quality.judge(quality.measure(told)).where("kept").collect()}
    assert set(texts) == good

    apart = stages["near_duplicates"](spark, ruled, sf)
    assert apart.columns == columns
    kept = apart.collect()
    rows = sorted(texts)
    prints = [slow_fingerprint(texts[k]) for k in rows]
    root = brute(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    assert {r["doc_id"] for r in kept} == {rows[r] for r in root}
    assert len({r["text"] for r in kept}) == len(kept) and {r["doc_id"] for r in kept} <= set(texts)

    clean = stages["personal_data"](spark, apart, sf)
    assert clean.columns == columns and clean.count() == len(kept)
    assert all(not pii.scan(r["text"]) and r["n_chars"] == len(r["text"]) for r in clean.collect())

    padding, _ = check_packing(clean, stages["packing"](spark, clean, sf))
    assert padding < 0.03


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_empty_and_further_columns(spark, sf):
    docs = table(spark, sf, "documents").withColumns({"score": F.lit(1), "row": F.lit(2), "fp": F.lit(3), "n_words": F.lit("x")})
    for frame in (docs.limit(0), docs.limit(40)):
        out = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, sf)
            assert out.columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, out, sf).count() >= 0
