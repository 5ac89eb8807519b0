"""The registered queries on a whole small table, each against brute force on the columns of its contract."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import CLASH, SF, brute_join, brute_private, docs_of, measured, spans_of, tokens_of

COLUMNS = {
    "op1_token_output": ["doc_id", "start", "n_tokens", "ids_crc32"], "op2_private_terms": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op3_quality_model": ["doc_id", "held_out", "score", "predicted"],
    "op4_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], "op5_url_filter": ["page_id", "host", "path", "rule", "verdict"], "op6_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "op8_ngram_join": ["doc_id", "n_shingles", "component_id"], "op9_exact_topk": ["query_id", "rank", "vec_id", "score"],
    "op10_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
}


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def asked(spark, name):
    from lexgrid.llm.queries import QUERIES

    df = QUERIES[name](spark, SF)
    assert set(COLUMNS[name]) <= set(df.columns)
    return df.collect()


def test_settings_are_as_before(spark):
    from lexgrid.llm.queries import QUERIES

    rows, own = "spark.sql.execution.arrow.maxRecordsPerBatch", lambda: {r.key: r.value for r in spark.sql("set").collect()}
    before = own()
    QUERIES["op9_exact_topk"](spark, SF).collect()
    after = own()
    assert {k: v for k, v in after.items() if k != rows} == {k: v for k, v in before.items() if k != rows} and int(after[rows]) == 1000


def test_op1(spark, texts):
    want, start = [], 0
    for k, t in texts:
        ids = tokens_of(t)
        want.append((k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in asked(spark, "op1_token_output")) == want


def test_op2(spark, texts):
    secrets, terms = brute_private([t for _, t in texts])
    got = {r.doc_id: r for r in asked(spark, "op2_private_terms")}
    for (k, t), s, m in zip(texts, secrets, terms, strict=True):
        base = [f"{kind}:{a}:{b}" for kind, a, b in spans_of(t)]
        r = got[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(kind + ":") for x in base) for kind in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.spans == ",".join(base + [f"secret:{a}:{b}" for a, b in s] + [f"term:{a}:{b}" for a, b, _ in m])
    assert len(got) == len(texts)


def test_op3(spark, texts):
    from lexgrid.llm.quality_model import learn, statistics

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    trees = learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = trees.score(np.array([statistics(t) for _, t in texts], float))
    got = {r.doc_id: r for r in asked(spark, "op3_quality_model")}
    for (k, _), score in zip(texts, want, strict=True):
        assert got[k].score == pytest.approx(score) and got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and got[k].predicted == int(got[k].score >= 0.3)


def test_op4(spark, texts):
    by_doc, by_sequence, total = {}, {}, 0
    for r in asked(spark, "op4_best_fit_packing"):
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    for k, t in texts:
        ids, at = tokens_of(t), 0
        for n, (piece, start, length, crc) in enumerate(sorted(by_doc[k])):
            assert (piece, start) == (n, at) and length <= 2048 and (n == 0 or length == 2048) and crc == zlib.crc32(ids[at : at + length].astype("<u4").tobytes())
            at += length
        assert at == len(ids)
    for held in by_sequence.values():
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 1  # the least possible, and one


def test_op7(spark, texts):
    got = {r.doc_id: r for r in asked(spark, "op7_quality_rules")}
    for k, t in texts:
        r, want = got[k], measured(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_op8(spark, texts):
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in asked(spark, "op8_ngram_join")) == brute_join(texts, 3, 90, 100)


def clashing(name, spark):
    from lexgrid.llm.line_dedup import dedup_lines
    from lexgrid.llm.mixing import mix, take
    from lexgrid.llm.packing import pack
    from lexgrid.llm.privacy import sanitise
    from lexgrid.llm.quality_model import learn, score
    from lexgrid.llm.quality_rules import judge, kept
    from lexgrid.llm.url_filter import filter_urls

    docs = docs_of(spark, [(1, "one two\nthree", "a"), (2, None, None), (None, "", "b")])
    if name == "score":
        return score(docs, learn(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")))
    if name == "pack":
        return pack(docs.withColumn("length", F.lit(3)), capacity=8)
    if name == "filter_urls":
        return filter_urls(docs.withColumn("u", F.lit("http://a.net/")), [("block", "net", "/")], url="u")
    return {"judge": judge, "kept": kept, "dedup_lines": dedup_lines, "mix": mix, "take": take, "sanitise": sanitise}[name](docs)


@pytest.mark.parametrize(("name", "own"), [
    ("judge", {"quality"}), ("kept", set()), ("dedup_lines", {"line_total", "line_dropped"}), ("mix", {"mix_size", "mix_source_size", "mix_target", "mix_taken"}), ("take", set()), ("sanitise", set()),
    ("score", {"score"}), ("pack", {"sequence_id", "offset", "length"}), ("filter_urls", {"url_host", "u"}),
])
def test_clashing_names_keep_their_values(spark, name, own):
    """Columns of an operator's new names are replaced; all others keep values and types, whatever they are called."""
    out = clashing(name, spark)
    types = dict(out.dtypes)
    assert all(types[c] == "string" for c in CLASH if c not in own) and all(r[c] == "clash" for r in out.collect() for c in CLASH if c not in own)
