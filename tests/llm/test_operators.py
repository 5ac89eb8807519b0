"""Each operator against a brute-force version, and on nulls, empty, long, repeated and clashing rows and empty tables."""

import functools
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LONG = "x" * 300_000
CLASH = ["size", "sequence_id", "offset", "quality", "score", "mix_size", "mix_taken", "line_total", "class", "key", "id", "text_key", "start", "base", "length", "h", "u", "url_host", "_u", "_verdict", "before", "first", "sequence", "step_length", "_drop_id", "_drops", "_kept", "_key", "_base", "_terms", "row", "row_id", "rank", "part", "text_hash", "stay_id", "_first", "line_dropped", "mix_size_", "pass", "kept", "rule", "told", "spans", "copies", "drop_id"]


def docs_of(spark, rows):
    """rows: (doc_id, text, source), with columns whose names operators use for their own."""
    full = [(k, t, "en", s, len(t or ""), *["clash"] * len(CLASH)) for k, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH))


PROSE = " ".join(f"word{k} and more of it" for k in range(60))
ROWS = [
    (1, PROSE, "a"), (2, PROSE, "a"), (2, PROSE, "a"), (3, None, "b"), (None, "no id here\nsecond line of it is long", None), (4, "", "b"), (5, " \n\t ", None), (6, LONG, "a"), (7, "1" * 100_000 + " a@b.cd", "c"),
    (8, "é" * 30 + "\nline that many hold, longer than twenty\n\nend", "c"), (9, "Line That Many Hold, Longer Than Twenty  ", "a"), (10, "line that many hold, longer than twenty", "a"), (11, PROSE + " tail", "b"), (12, "single", "b"),
    (13, "tab\tand\rreturn\x0bhere  double  space \n\n<|endoftext|> \x03 mark", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def key(r):
    return tuple((x is None, x) for x in r)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


@functools.cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def tokens_of(text):
    return np.array([*tokenizer().encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_equals_whole_texts():
    import public_tokenizers

    from lexgrid.llm.encoding import Encoder

    e, r = Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(7)
    parts = ["a", "the", "Über", "ß", "漢", "😀", " ", "  ", "\n", "\n\n", "\t", "\xa0", " ", "\x1c", "'s", "'", "12", ".", ",", "!!", "<|endoftext|>", "\x03", "ñandú", "ª", "Ⅷ", "x."]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert e.encode(text) == tokens_of(text)[:-1].tobytes(), repr(text)


def test_encoder_line_ends():
    import public_tokenizers

    from lexgrid.llm.encoding import encoder

    e = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for a in ("", "x", "Über,", "x\n", "12"):
        for ends in ("\n", "\n\n", "\n\n\n", "\n ", "\n\n ", "\n\n\n ", "\n \n", " \n\n"):
            for b in ("", "x", ",", "\xa0x", "'s", " x"):
                assert e.encode(a + ends + b) == tokens_of(a + ends + b)[:-1].tobytes(), repr(a + ends + b)


def test_token_files_round_trip_and_random_access(spark, docs, empty):
    from lexgrid.llm.token_output import read_tokens, write_tokens

    manifest = write_tokens(docs)
    got = read_tokens(manifest).collect()
    want = sorted(((k is not None, k or 0, tokens_of(t).tobytes()) for k, t, _ in ROWS))
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == want
    ordered = sorted(got, key=lambda r: (r.start, r.n_tokens))
    assert [r.doc_id for r in ordered] == sorted((k for k, _, _ in ROWS), key=lambda k: (k is not None, k))
    at = 0
    for r in ordered:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert sorted(r.doc_id for r in read_tokens(manifest, [2, 6]).collect()) == [2, 2, 6]
    assert write_tokens(empty).count() == 0 and read_tokens(write_tokens(empty)).count() == 0


def test_token_file_format_and_checksums():
    import zstandard

    from lexgrid.llm.token_file import Corrupt, Reader, Writer

    out = io.BytesIO()
    w = Writer(out, 2, frame_bytes=64)
    docs = {5: np.arange(100), 7: np.zeros(0, np.int64), None: np.array([9])}
    for k, ids in docs.items():
        w.add(k, ids)
    w.close()
    raw = out.getvalue()
    r = Reader(io.BytesIO(raw), len(raw))
    assert [r.doc_id(k) for k in range(3)] == [5, 7, None] and all((r.tokens(k) == ids).all() for k, ids in enumerate(docs.values()))
    assert len(list(r.find(None))) == 1 and not list(r.find(6))
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(x.astype("<u2").tobytes() for x in docs.values())
    bad = bytearray(raw)
    table = len(raw) - 9 - 12 * len(r.table)
    bad[table + 8] ^= 1
    with pytest.raises(Corrupt):
        Reader(io.BytesIO(bytes(bad)), len(bad)).tokens(0)
    with pytest.raises(Corrupt):
        Reader(io.BytesIO(raw[:-1]), len(raw) - 1)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def spans_of(text):
    tests = {"email": lambda v, d: True, "ip": lambda v, d: all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in v.split(".")), "card": lambda v, d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda v, d: 9 <= len(d) <= 15}
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if tests[k](m[0], re.sub("[^0-9]", "", m[0]))]


def test_base_spans_equal_brute_force(spark):
    from lexgrid.llm.privacy import KINDS, base_spans

    r = random.Random(11)
    parts = ["a@b.c", "@", ".", "-", "a", "b1", "12", "255", "256", "1.2.3.4", "0001.2.3.4", "+", " ", "(", ")", "4041894974608795", "4041 8949 7460 8795", "+1 (456) 555-2186", "é", "😀", "_", "..", "c.d", "x_y@z.w", "%"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(2500)] + ["1" * 200_000, "1 " * 60_000, "a." * 60_000 + "@" + "b." * 60_000 + "c", "+" + "(" * 100_000, "1." * 60_000]
    for row in spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", base_spans(F.col("t")).alias("b")).collect():
        if row.i != 2503:  # where Python's own expression takes quadratic time
            assert [(KINDS[s.kind], s.start, s.end) for s in row.b] == spans_of(texts[row.i]), texts[row.i][:200]


SECRET = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"


def brute_private(texts, generalise=0.75, evidence=7.0):
    """(secrets, terms) of each text, by counting all pairs."""

    def bits(v):
        return sum(-v.count(c) * math.log2(v.count(c) / len(v)) for c in set(v))

    texts = [t or "" for t in texts]
    base = [spans_of(t) for t in texts]
    clear = lambda a, b, spans: not any(x < b and a < y for _, x, y in spans)
    secrets = [[(m.start(), m.end()) for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}", t) if re.search("[A-Za-z]", m[0]) and re.search("[0-9]", m[0]) and bits(m[0]) >= 64 and clear(m.start(), m.end(), s)] for t, s in zip(texts, base, strict=True)]
    words = [{w.lower() for w in regex.findall(r"\p{L}{3,}", t)} for t in texts]
    entities = [{k for k, _, _ in b} | {(k, t[x:y].lower()) for k, x, y in b} | ({"secret"} | {("secret", t[x:y]) for x, y in s} if s else set()) for t, b, s in zip(texts, base, secrets, strict=True)]
    n, n_entity, n_term, both, distinct, per_entity = len(texts), Counter(), Counter(w for ws in words for w in ws), Counter(), {}, {}
    for t, ws, es in zip(texts, words, entities, strict=True):
        for e in es:
            n_entity[e] += 1
            per_entity.setdefault(e, set()).add(t)
            for w in ws:
                both[e, w] += 1
                distinct.setdefault((e, w), set()).add(t)
    told, needed = {}, math.log2(max(1, len(n_term))) + evidence
    for (e, w), k in both.items():
        p = n_entity[e] / n
        if p < 1 and len(per_entity[e]) > 1 and len(distinct[e, w]) > 1:
            pmi = math.log2((k + p) / (n_term[w] + 1) / p)
            if pmi >= generalise * -math.log2(p) and (len(distinct[e, w]) - 1) * pmi >= needed:
                told[w] = max(told.get(w, 0), pmi / -math.log2(p))
    terms = [[(m.start(), m.end(), told[m[0].lower()]) for m in regex.finditer(r"\p{L}{3,}", t) if m[0].lower() in told and clear(m.start(), m.end(), b + [("", *x) for x in s])] for t, b, s in zip(texts, base, secrets, strict=True)]
    return secrets, terms


def check_private(df):
    from lexgrid.llm.privacy import find_personal

    rows = df.select("doc_id", "text").collect()
    secrets, terms = brute_private([r.text for r in rows])
    want = sorted((str(r.doc_id), tuple(s), tuple((a, b, round(d, 9)) for a, b, d in t)) for r, s, t in zip(rows, secrets, terms, strict=True))
    got = sorted((str(r.doc_id), tuple((s.start, s.end) for s in r.secrets), tuple((t.start, t.end, round(t.disclosure, 9)) for t in r.terms)) for r in find_personal(df).collect())
    assert got == want
    return sum(map(len, secrets)), sum(map(len, terms))


def test_secrets_and_terms_equal_brute_force(spark, docs, empty):
    from lexgrid.llm.privacy import find_personal, sanitise

    gap = "common things and weather today " * 20
    filler = [(100 + k, f"ordinary text number{k} {gap}", "a") for k in range(600)]
    far = [(k, f"Quixote {k} {gap} jo@ex.org {gap} QUIXOTE", "a") for k in range(1, 5)]
    others = [(10, f"{gap} only quixote here, and again x.quixote", "a"), (11, None, "a"), (12, "", "a"), (13, f'token = "{SECRET}" and more', "a")]
    tokens = [(20 + k, f'{gap} {k} token = "{SECRET[k:]}{k}a"', "a") for k in range(12)]
    once = [(50, "a singular rarity beside only@once.org here", "a"), (51, "a singular rarity beside only@once.org here", "a")]
    df = docs_of(spark, far + others + tokens + once + filler)
    n_secrets, n_terms = check_private(df)
    assert n_secrets == 13 and n_terms == 8 + 2 + 13
    clean = {r.doc_id: r for r in sanitise(df).collect()}
    assert "[EMAIL]" in clean[1].text and "[SECRET]" in clean[20].text and SECRET[:15] not in clean[13].text and clean[1].size == "clash"
    assert not any(w in (r.text or "").lower() for r in clean.values() for w in ("quixote", "token"))
    assert "rarity" in clean[50].text and clean[100].text == filler[0][1] and clean[11].text is None and clean[12].text == ""
    assert find_personal(docs).count() == len(ROWS) and sanitise(docs).count() == len(ROWS) and sanitise(docs).columns == docs.columns
    assert find_personal(empty).count() == 0 and sanitise(empty).count() == 0


def test_terms_of_a_whole_table_equal_brute_force(spark):
    secrets, terms = check_private(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert secrets and terms


def test_quality_model_held_out_accuracy_and_edges(spark, docs, empty):
    from lexgrid.llm.quality_model import fold, learn, score, statistics

    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = learn(d, labels)
    got = score(d, model).join(labels.filter(fold(F.col("doc_id")) == 0), "doc_id").select("score", "quality").collect()
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in got) / len(got) >= 0.95
    out = score(docs, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out) and score(empty, model).count() == 0
    assert len({r.score for r in out if not (r.text or "").strip()}) == 1
    assert np.isfinite([statistics(t) for _, t, _ in ROWS]).all()
    nothing = learn(docs, labels.limit(0))
    assert all(r.score == 0.5 for r in score(docs, nothing).collect())
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (2, 7)], "doc_id long, quality int")
    assert all(0 < r.score < 1 for r in score(docs, learn(docs, odd)).collect())


def test_trees_learn_and_flat_traversal_agrees():
    from lexgrid.llm.boosted_trees import train

    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = train(x[:1500], y[:1500])
    assert ((t.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    b, i = t.bins(x[1500:1510]), t.feature.shape[1]
    for k, row in enumerate(b):
        total = t.start
        for f, c, v in zip(t.feature, t.cut, t.value, strict=True):
            node = 0
            while node < i:
                node = 2 * node + 1 + (row[f[node]] > c[node])
            total += v[node - i]
        assert t.score(x[1500 + k : 1501 + k])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_packing_covers_all_and_stays_within_capacities(spark, docs, empty):
    from lexgrid.llm.packing import pack, pieces, plan

    out = pack(pieces(docs)).collect()
    by_doc, by_bin = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, t in {(k, t) for k, t, _ in ROWS}:
        ids, copies = tokens_of(t), sum(x == (k, t) for x in ((a, b) for a, b, _ in ROWS))
        cut = sorted(by_doc[k])
        assert sum(n for _, _, n, _ in cut) == copies * len(ids)
        for p, s, n, crc in cut:
            assert n <= 2048 and (p == 0 or n == 2048 or len(ids) <= 2048) and zlib.crc32(ids[s : s + n].tobytes()) == crc
    for x in by_bin.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 2048
    assert pack(pieces(empty)).count() == 0
    items = spark.createDataFrame([(k, 1 + k % 97) for k in range(3000)] + [(9, None), (10, 0)], "k long, length long").withColumn("sequence_id", F.lit("clash"))
    for how in ({"most_docs": 3}, {"most_attention": 10_000}, {"rule": "dot"}, {}):
        bins = pack(items, capacity=128, **how).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("docs"), F.sum(F.col("length") * F.col("length")).alias("cost"))
        worst = bins.filter("sequence_id is not null").agg(F.max("n"), F.max("docs"), F.max("cost"), F.count("*")).first()
        assert worst[0] <= 128 and worst[1] <= how.get("most_docs", 128) and worst[2] <= how.get("most_attention", 128 * 128)
        if not how:
            assert worst[3] <= 1.02 * sum(1 + k % 97 for k in range(3000)) / 128 + 1
    assert pack(items, capacity=128).filter("sequence_id is null").count() == 2
    with pytest.raises(ValueError):
        plan({200: 1}, 128, 128, 128 * 128, (1.0, 0.0, 0.0), "norm")


@pytest.mark.parametrize("most_docs, most_attention", [(128, 128 * 128), (3, 128 * 128), (128, 6000), (2, 9000)])
def test_plan_equals_vector_best_fit_item_by_item(most_docs, most_attention):
    from lexgrid.llm.packing import plan

    r = random.Random(most_docs)
    counts = {n: r.randint(1, 9) for n in r.sample(range(1, 77), 40)}
    capacity, bins = np.array([128, most_docs, most_attention]), []
    for n in sorted(counts, reverse=True):
        need = np.array([n, 1, n * n])
        for _ in range(counts[n]):
            fits = [(float(np.sqrt((((left - need) / capacity) ** 2).sum())), k) for k, (left, _) in enumerate(bins) if (left >= need).all()]
            if not fits:
                bins.append([capacity.copy(), []])
                fits = [(0, len(bins) - 1)]
            left, held = bins[min(fits)[1]]
            left -= need
            held.append(n)
    made = {}
    for n, _, items, first, offset, each in plan(counts, 128, most_docs, most_attention, (1.0, 1.0, 1.0), "norm"):
        for i in range(items):
            made.setdefault(first + i // each, []).append((offset + i % each * n, n))
    for held in made.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(held), sorted(held)[1:], strict=False))
    assert sorted(tuple(n for _, n in sorted(x)) for x in made.values()) == sorted(tuple(x) for _, x in bins)


def test_urls(spark):
    from lexgrid.llm.queries import URL_RULES
    from lexgrid.llm.url_filter import filter_urls

    cases = {
        "http://a.example.net/en/x": ("example.net/en/", "allow"), "http://a.example.net/fr/": ("net/", "block"), "HTTPS://WWW.Example.COM/de/?q": ("example.com/de/", "block"), "http://example.com/de": (None, "allow"),
        "http://net/": ("net/", "block"), "http://internet/": (None, "allow"), "http://x.org/fr/": ("org/fr/", "allow"), "http://x.org": (None, "allow"), "x.net/": (None, "allow"), "http://x.net?/": (None, "allow"),
        None: (None, "allow"), "": (None, "allow"), "://": (None, "allow"), "ftp://.net/a": ("net/", "block"), "http://a.net#/": (None, "allow"), "http://" + "a." * 5000 + "net/" + "p" * 100_000: ("net/", "block"),
    }
    rows = [(k, u, "clash") for k, u in enumerate(cases)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, url_rule string")
    out = filter_urls(df, URL_RULES).collect()
    assert len(out) == len(rows) and all((r.url_rule, r.url_verdict) == cases[r.url] for r in out)
    assert {r.url_host for r in out if r.url and "Example" in r.url} == {"www.example.com"}
    assert filter_urls(df.limit(0), URL_RULES).count() == 0 and {r.url_verdict for r in filter_urls(df, [], default="block").collect()} == {"block"}
    many = [("block", f"h{k}.test", "/") for k in range(50)] + [("allow", "h1.test", "/"), ("block", "h1.test", "/a")]
    assert filter_urls(spark.createDataFrame([(0, "http://h1.test/b"), (1, "http://h1.test/a")], "page_id long, url string"), many).select("url_verdict").distinct().collect()[0][0] == "block"


def test_mix_reaches_targets_exactly(spark, docs, empty):
    from lexgrid.llm.mixing import mix, take

    out = mix(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert len(out) == len(ROWS) and all(r.mix_size == words(r.text) and 0 <= r.mix_taken <= 2 * r.mix_size for r in out)
    per = {}
    for r in out:
        per.setdefault(r.source, [0, r.mix_target, 0])
        per[r.source][0] += r.mix_taken
        per[r.source][2] += r.mix_size
    assert all(abs(taken - target) <= 0.5 and target <= 2 * size for taken, target, size in per.values())
    assert sum(t for _, t, _ in per.values()) == pytest.approx(1.5 * sum(s for _, _, s in per.values()))
    assert collected(mix(docs), "doc_id", "mix_taken") == collected(mix(docs.repartition(3)), "doc_id", "mix_taken")
    small = mix(docs, bucket_rows=1)
    assert collected(small, "doc_id", "mix_taken") == collected(mix(docs), "doc_id", "mix_taken")
    taken = take(docs)
    assert taken.columns == docs.columns and sum(words(r.text) for r in taken.collect()) == sum(r.mix_taken for r in out)
    assert mix(empty).count() == 0 and take(empty).count() == 0


def measured(text):
    w, lines = re.findall(r"[^\x20\x09-\x0D]+", text or ""), (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    at, cover = {}, set()
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    for v in at.values():
        if len(v) > 1:
            for i in v:
                cover.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(cover)


def test_quality_rules_equal_brute_force(spark, docs, empty):
    from lexgrid.llm.quality_rules import judge

    extra = [(20, "a b c d e f g h " * 5 + "x", "a"), (21, "q " * 9, "a"), (22, "l\nl\n\n \nl\nm", "a"), (23, "%%% *** $$$ " * 20, "a")]
    out = judge(docs_of(spark, ROWS + extra)).collect()
    for r in out:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == measured(r.text), r.doc_id
        assert q.base_failed == (q.n_words < 20 or 100 * q.n_repeat_words > 30 * q.n_words) and not (q.base_failed and q.kept)
    assert len(out) == len(ROWS) + 4 and judge(empty).count() == 0
    real = spark.read.parquet(f"{SF}/documents.parquet")
    good = judge(real.join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1"), "doc_id").drop("quality")).select("quality.*")
    assert good.filter("not base_failed and not kept").count() == 0


def brute_join(rows, width, outer, inner):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and inner * len(a & b) >= outer * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("width", "outer"), [(3, 90), (5, 80), (1, 50)])
def test_ngram_join_equals_brute_force(spark, width, outer):
    from lexgrid.llm.ngram_join import join_ngrams

    r, rows = random.Random(width), []
    for g in range(25):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([1, 2, 3, 5, 12, 40, 120, 400]))]
        for _ in range(r.choice([1, 2, 6, 14])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(["NEW", f"n{r.randint(0, 9)}", "w1"])
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " \n", "w1", "W1", "é w1", "a b", "A\tB"])]
    df = docs_of(spark, [(k, t, "a") for k, t in rows])
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in join_ngrams(df, width=width, outer=outer, inner=100).collect())
    assert got == brute_join(rows, width, outer, 100)


def test_ngram_join_in_chunks_and_turns(spark, monkeypatch):
    """A block over many chunks, and links that the first turn's forest doesn't test."""
    from lexgrid.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CHUNK", 2)
    turns, real = [], ngram_join.within
    monkeypatch.setattr(ngram_join, "within", lambda rows, bands, turn: turns.append(turn) or real(rows, bands, turn))
    r, rows = random.Random(8), []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(30)]
        for _ in range(14):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"n{r.randint(0, 50)}"
            rows.append((len(rows), " ".join(w)))
    df = docs_of(spark, [(k, t, "a") for k, t in rows])
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.join_ngrams(df, width=1, outer=80, inner=100).collect())
    assert got == brute_join(rows, 1, 80, 100) and max(turns) >= 1


@pytest.mark.parametrize("held", [1, 40, 1 << 20])
def test_blocks_of_a_part(monkeypatch, held):
    """However few keys are held at a time, each class of a block of two or more is told, with one class of the block, and pairs are pairs."""
    from lexgrid.llm import ngram_join

    monkeypatch.setattr(ngram_join, "FLUSH", 16)
    monkeypatch.setattr(ngram_join, "MOST_HELD", held)
    r = random.Random(3)
    sets = [(c, np.array(sorted({r.randint(0, 60) if r.random() < 0.5 else r.getrandbits(40) for _ in range(8)}), np.uint64) * np.uint64(1 << 20) + np.uint64(1)) for c in range(-20, 40) for _ in range(r.randint(1, 2))]
    bands = type("Whole", (), {"blocks": staticmethod(lambda members: members)})
    part, got = ngram_join.Part(), []
    dealt = [(p, k, c) for batch in ngram_join.dealt_keys(iter(sets), bands, 1) for p, k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
    assert {p for p, _, _ in dealt} == {0} and all(len(k) * 8 == len(c) * 6 for _, k, c in dealt)
    for _, k, c in dealt:
        got += [row for made in part.add(k, c) for row in zip(*(x.tolist() for x in made), strict=True)]
    got += [row for made in part.met(True) for row in zip(*(x.tolist() for x in made), strict=True)]
    want = {}
    for c, members in sets:
        for k in members.tolist():
            want.setdefault(k >> 16 << 16, set()).add(c)
    want = {k: x for k, x in want.items() if len(x) > 1}
    assert {k: {c for key, c, _, _ in got if key == k} for k, *_ in got} == want and any(len(x) == 2 for x in want.values())
    for k, x in want.items():
        lows = {low for key, _, low, _ in got if key == k}
        assert len(lows) == 1 and lows <= x and (held < 1 << 20 or lows == {min(x)})
        assert {pair for key, *_, pair in got if key == k} <= ({len(x) == 2} if held == 1 << 20 else {False, len(x) == 2})


def test_ngram_join_shuffles_keys_once_and_no_sets_that_sketches_refuse(spark):
    """Pairs of texts that share many shingles are candidates, but too far apart: less goes through shuffles than twice their sets."""
    from lexgrid.llm.ngram_join import join_ngrams
    from lexgrid.llm.shared import settings

    r = random.Random(12)
    shared = [" ".join(f"s{r.getrandbits(32)}" for _ in range(260)) for _ in range(300)]
    rows = [(k, " ".join(f"w{r.getrandbits(32)}" for _ in range(180)) + " " + shared[k % 300], "a") for k in range(600)]
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        return store.executorList(True).head().totalShuffleWrite()

    df = docs_of(spark, rows).cache()
    df.count()
    before = shuffled()
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        got = join_ngrams(df).collect()
    assert all(x.component_id == x.doc_id and x.n_shingles == 436 for x in got) and len(got) == 600
    assert shuffled() - before < 2 * 600 * 436 * 8


def test_failed_pairs_that_are_joined_meanwhile_go(spark):
    from lexgrid.llm.ngram_join import still_apart

    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, label long")
    failed = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert sorted(map(tuple, still_apart(failed, labels).collect())) == [(1, 3), (2, 3)]


def test_closed_blocks_take_no_places(spark):
    from lexgrid.llm.ngram_join import next_blocks

    # eight closed blocks of each label are larger than the only open one
    closed = [(10 * label + k, c, label) for label in (1, 2) for k in range(8) for c in range(100 * label, 100 * label + 5)]
    named = spark.createDataFrame([*closed, (99, 100, 1), (99, 200, 2)], "key long, class long, label long")
    blocks = named.groupBy("key").agg(F.count("*").alias("n"))
    assert [tuple(r) for r in next_blocks(named, blocks, 1).collect()] == [(99, 2, True)]


def test_ngram_join_edges(spark, docs, empty):
    from lexgrid.llm.ngram_join import join_ngrams

    out = join_ngrams(docs).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, r)
    assert len(out) == len(ROWS) and by[1].component_id == by[2].component_id == by[11].component_id == 1
    assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and (by[3].component_id, by[4].component_id) == (3, 4)
    assert by[None].component_id is None and join_ngrams(empty).count() == 0


def test_parity_sketches_bound_the_difference():
    from lexgrid.llm.sketches import Bands, folded, parity_bits

    r, bands = np.random.default_rng(2), Bands(90, 100)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 500), dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 2**63, r.integers(0, 60), dtype=np.uint64)]))
        if not len(b):
            continue
        x, y = parity_bits(a, bands), parity_bits(b, bands)
        n = min(len(x), len(y))
        assert np.bitwise_count(folded(x, n) ^ folded(y, n)).sum() <= len(np.setxor1d(a, b))
        if bands.link(len(np.intersect1d(a, b)), len(a), len(b)) and len(np.setxor1d(a, b)):
            assert len(np.intersect1d(bands.blocks(a), bands.blocks(b)))


def test_components(spark):
    from lexgrid.llm.components import components

    r = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 300)] + [(r.randint(1000, 1200), r.randint(1000, 1200)) for _ in range(120)] + [(2000, 2000 + k) for k in range(50)] + [(5, 5), (1, 0)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_top_k_equals_brute_force(spark):
    from lexgrid.llm import exact_topk
    from lexgrid.llm.exact_topk import top_k

    r = random.Random(9)
    rows = [(k, [r.choice([-0.5, 0.0, 0.25, r.random()]) for _ in range(6)], "clash") for k in range(700)]
    rows += [(1000, None, "c"), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0], "c"), (1200, [float("nan")] * 6, "c"), (1300, [float("inf")] * 6, "c"), (1400, [], "c"), (1500, [1.0, 2.0], "c"), (1600, [2.0, 1.0], "c"), (None, [1.0] * 6, "c"), (7, rows[7][1], "c"), (1700, [1e12] * 6, "c"), (1800, [3e7] * 6, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    good = [(k, tuple(int(np.floor(1024 * x)) for x in v)) for k, v, _ in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in sorted({k for k, _ in good if k % 100 == 0}):
        a = min(v for k, v in good if k == q)
        best = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, v, strict=True)))), k) for k, v in good if k != q and len(v) == len(a))[:10]
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    small, exact_topk.SHARD, exact_topk.BLOCK = (exact_topk.SHARD, exact_topk.BLOCK), 100, 3
    try:
        got = top_k(df, F.col("vec_id") % 100 == 0)
        assert collected(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=key)
        assert top_k(df.limit(0), F.lit(True)).count() == 0 and top_k(df, F.lit(False)).count() == 0
    finally:
        exact_topk.SHARD, exact_topk.BLOCK = small


def brute_lines(rows, least_chars=20, least_docs=3):
    at = {}
    k_of = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    low = lambda k: -(1 << 63) if k is None else k
    for k, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(k_of(x)) >= least_chars:
                at.setdefault(k_of(x), set()).add(low(k))
    out = []
    for k, t, _ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(at.get(k_of(x), ())) >= least_docs and low(k) < max(at[k_of(x)]))]
        out.append((k, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=key)


def test_line_dedup_equals_brute_force(spark, docs, empty):
    from lexgrid.llm.line_dedup import dedup_lines

    r = random.Random(6)
    pool = [f"  Shared line number {k} of some length\t" for k in range(12)] + ["short", "", "é" * 19, "É" * 20, "shared LINE number 3 of some length"]
    rows = ROWS + [(200 + k, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9))), "a") for k in range(40)]
    out = dedup_lines(docs_of(spark, rows))
    got = [(x.doc_id, x.line_total, x.line_dropped, hashlib.sha256((x.text or "").encode()).hexdigest()) for x in out.collect()]
    assert sorted(got, key=key) == brute_lines(rows)
    assert all(x.n_chars == len(x.text) for x in out.collect() if x.text is not None)
    assert [x.text for x in out.filter("doc_id = 3").collect()] == [None] and dedup_lines(empty).count() == 0


def test_bloom_filters_have_no_false_negatives():
    from lexgrid.llm.bloom import Seen, places, spread, test

    r = np.random.default_rng(1)
    one, two = (np.unique(r.integers(0, 2**64, 3000, dtype=np.uint64)) for _ in range(2))
    a, b = Seen(1 << 16), Seen(1 << 16)
    a.add(one)
    b.add(np.concatenate([two, one[:500], two[:100]]))
    again = np.concatenate([spread(t) for _, _, t in a.blocks()]) | np.concatenate([spread(t) for _, _, t in b.blocks()]) | (a.once & b.once)
    for some in (one[:500], two[:100]):
        x, y = places(some, 1 << 16)
        assert (test(again, x) & test(again, y)).all()
