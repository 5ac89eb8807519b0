"""The pipeline's stages, each against a brute-force version on its own input."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import CLASH, ROWS, brute_join, brute_lines, docs_of, measured, tokens_of


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


@pytest.mark.parametrize("which", ["real", "odd", "empty"])
def test_stages(spark, real, which):
    import hashlib

    import corpus_pipeline as p

    docs = {"real": real, "odd": docs_of(spark, ROWS), "empty": docs_of(spark, [])}[which]
    stages = dict(p.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "best_fit_packing"]
    kept = stages["quality_rules"](spark, docs, "").cache()
    assert kept.columns == docs.columns
    for r in kept.collect():
        n, *_, repeated = measured(r.text)
        assert n >= 20 and 100 * repeated <= 30 * n
    lines = stages["line_dedup"](spark, kept, "").cache()
    assert lines.columns == docs.columns and lines.count() == kept.count()
    want = {(k, h) for k, _, _, h in brute_lines(rows_of(kept))}
    assert {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in lines.collect()} == want
    single = stages["near_duplicates"](spark, lines, "").cache()
    assert single.columns == docs.columns
    named = [(k, t) for k, t, _ in rows_of(lines) if k is not None]
    want = {least for _, _, least in brute_join(named, 5, 80, 100)}
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == sorted(want)
    mixed = stages["mixing"](spark, single, "").cache()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = sum(words(r.text) for r in single.collect()), sum(words(r.text) for r in mixed.collect())
    assert mixed.columns == docs.columns and abs(after - 1.5 * before) <= 0.5 * max(1, single.select("source").distinct().count())
    packed = stages["best_fit_packing"](spark, mixed, "").collect()
    assert sum(r.length for r in packed) == sum(len(tokens_of(r.text)) for r in mixed.collect())
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert not fill or max(fill.values()) <= 2048
    if which == "odd":
        for stage in (kept, lines, single, mixed):
            assert all(r[c] == "clash" for r in stage.collect() for c in CLASH)
    if which == "real":
        texts = {}
        for r in mixed.collect():
            texts.setdefault(r.doc_id, set()).add(zlib.crc32(tokens_of(r.text)[-2048:].tobytes()) if len(tokens_of(r.text)) > 2048 else zlib.crc32(tokens_of(r.text).tobytes()))
        last = {}
        for r in packed:
            last.setdefault(r.doc_id, set()).add(r.ids_crc32)
        assert all(texts[k] <= last[k] for k in texts)
        assert p.run(spark, "/root/testdata/sf0.001").agg(F.sum("length")).first()[0] == sum(r.length for r in packed)
