"""Hand fixtures and properties of the pattern engine."""

import random

import pytest
from pyspark.sql import functions as F

from lexgrid.functions import bytes as fn
from lexgrid.operators import points as pt
from lexgrid.operators import search, succinct
from lexgrid.operators import suffixes as sx
from lexgrid.sources import text as src


def make(spark, *texts):
    df = spark.createDataFrame([(k, None if t is None else bytearray(t)) for k, t in enumerate(texts)], "id long, t binary")
    return src.corpus(df, F.col("id"), F.col("t"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def naive(texts, patterns):
    return sorted((p, d, i) for p, x in enumerate(patterns) for d, t in enumerate(texts) if t is not None for i in range(len(t)) if t[i : i + len(x)] == x and i + len(x) <= len(t))


def test_suffix_array_and_lcp_of_mississipi(spark):
    c = make(spark, b"mississipi", b"banana")
    s = sx.suffix_array(c)
    got = rows(s, "doc_id", "rank", "pos")
    assert [p for d, _, p in got if d == 0] == [9, 7, 4, 1, 0, 8, 6, 3, 5, 2]
    assert [p for d, _, p in got if d == 1] == [5, 3, 1, 0, 4, 2]
    lcp = rows(sx.with_lcp(c, s), "doc_id", "rank", "lcp")
    assert [x for d, _, x in lcp if d == 0] == [0, 1, 1, 4, 0, 0, 0, 2, 1, 3]
    assert [x for d, _, x in lcp if d == 1] == [0, 1, 3, 0, 0, 2]


def test_samples_and_points_of_mississipi(spark):
    c = make(spark, b"mississipi")
    s = sx.suffix_array(c)
    assert rows(sx.sampled(sx.with_lcp(c, s), 2), "x", "pos", "lcp") == [(0, 4, 0), (1, 0, 0), (2, 8, 0), (3, 6, 0), (4, 2, 1)]
    pts = pt.points(c, sx.suffix_array(c, 2).withColumnRenamed("rank", "x"), 2)
    assert [(x, p, bytes(y).hex(), bytes(a), bytes(b)) for x, p, y, a, b in rows(pts, "x", "pos", "y", "cx", "cy")] == [(0, 4, "7373", b"i", b"s"), (2, 8, "6973", b"p", b"i"), (3, 6, "7369", b"s", b"s"), (4, 2, "696d", b"s", b"i")]
    four = pt.points(c, sx.suffix_array(c, 4).withColumnRenamed("rank", "x"), 4)
    assert [(x, p, bytes(y).hex()) for x, p, y in rows(four, "x", "pos", "y")] == [(0, 4, "7373696d"), (2, 8, "69737369")]


@pytest.mark.parametrize("step", [1, 2, 3, 4, 8])
def test_locate_equals_naive_scan_whatever_the_step(spark, step):
    r = random.Random(step)
    texts = [bytes(r.choice(b"abc\xff\x01") for _ in range(r.randint(0, 60))) for _ in range(25)] + [b"", b"aaaa", b"mississipi", None, b"\xff\xff\xff\xff"]
    patterns = [b"aa", b"issi", b"s", b"i", b"\xff", b"\xff\x01", b"abca", b"mississipi", b"mississipix", b"aa", b"abcabcabcabc", b"c\xff"]
    c, p = make(spark, *texts), src.patterns(spark, patterns)
    want = naive(texts, patterns)
    pts = pt.keyed_points(c, step, 16)
    assert rows(search.locate(pts, c, p, step), "pattern_id", "doc_id", "pos") == want
    assert rows(sx.naive_scan(c, p), "pattern_id", "doc_id", "pos") == want
    long = [x for x in patterns if len(x) >= step]
    samples = sx.suffix_array(c, step).withColumnRenamed("rank", "x")
    two = search.locate_by_ranges(pt.points(c, samples, step), samples, c, src.patterns(spark, long), step)
    assert rows(two, "pattern_id", "doc_id", "pos") == naive(texts, long)
    counts = {k: n for k, n, _ in rows(search.count(pts, c, p, step), "pattern_id", "occurrences", "docs")}
    assert counts == {k: sum(x[0] == k for x in want) for k in range(len(patterns))}


@pytest.mark.parametrize("step", [2, 4])
def test_locate_by_ranges_scans_for_short_patterns(spark, step):
    texts, patterns = [b"mississipi", b"banana", b"", None, b"i"], [b"i", b"na", b"issi", b"x", b"ana"]
    c = make(spark, *texts)
    samples = sx.suffix_array(c, step).withColumnRenamed("rank", "x")
    got = search.locate_by_ranges(pt.points(c, samples, step), samples, c, src.patterns(spark, patterns), step)
    assert rows(got, "pattern_id", "doc_id", "pos") == naive(texts, patterns)


def test_texts_in_pieces(spark, monkeypatch):
    from lexgrid.operators import positions

    monkeypatch.setattr(positions, "PIECE", 7)
    r = random.Random(5)
    texts, patterns = [bytes(r.choice(b"ab") for _ in range(n)) for n in (0, 1, 6, 7, 8, 14, 50)], [b"ab", b"abab", b"a", b"bbabab", b"aabababbab"]
    c, p = make(spark, *texts), src.patterns(spark, patterns)
    want = naive(texts, patterns)
    assert rows(sx.naive_scan(c, p), "pattern_id", "doc_id", "pos") == want
    for step in (1, 3, 4):
        assert rows(search.locate(pt.keyed_points(c, step, 4), c, p, step, 4), "pattern_id", "doc_id", "pos") == want
    assert rows(sx.suffix_array(c, first_bytes=3), "doc_id", "rank", "pos") == sorted((d, k, q) for d, t in enumerate(texts) for k, q in enumerate(sorted(range(len(t)), key=lambda i: t[i:])))


def test_arrays_of_unequal_length_are_an_error(spark):
    one, two = spark.createDataFrame([(0, 0, 1), (0, 1, 0)], "doc_id long, rank long, pos long"), spark.createDataFrame([(0, 0, 9)], "doc_id long, rank long, lcp long")
    with pytest.raises(Exception, match="differ in length"):
        sx.merged(one, two).collect()
    assert rows(sx.merged(one.filter("rank = 0"), two), "pos", "lcp") == [(1, 0)]


def test_verify_finds_a_wrong_order(spark):
    c = make(spark, b"banana", b"abc")
    s = sx.suffix_array(c)
    assert rows(sx.verified(c, s), "doc_id", "ordered", "permutation") == [(0, True, True), (1, True, True)]
    bad = s.withColumn("pos", F.when((F.col("doc_id") == 0) & (F.col("rank") == 0), 3).when((F.col("doc_id") == 0) & (F.col("rank") == 1), 5).otherwise(F.col("pos")))
    assert rows(sx.verified(c, bad), "doc_id", "ordered", "permutation") == [(0, False, True), (1, True, True)]


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from lexgrid.sources import store

    class Context:
        def getCheckpointDir(self):
            return type("none", (), {"isDefined": lambda self: False})()

        def isLocal(self):
            return False

    fake = type("s", (), {"sparkContext": type("c", (), {"_jsc": type("j", (), {"sc": lambda self: Context()})()})(), "conf": type("f", (), {"get": lambda self, k, d=None: d})()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_folder(fake)


def test_empty_and_null_patterns(spark):
    c = make(spark, b"ab", b"")
    p = spark.createDataFrame([(0, bytearray(b"")), (1, None)], "pattern_id long, p binary").withColumn("m", F.octet_length("p").cast("long"))
    assert rows(sx.naive_scan(c, p), "pattern_id", "doc_id", "pos") == [(0, 0, 0), (0, 0, 1)]


@pytest.mark.parametrize("how", [{}, {"first_bytes": 1}, {"first_bytes": 2, "window_bytes": 0}])
def test_suffix_arrays_agree_however_they_are_sorted(spark, how):
    r = random.Random(3)
    texts = [b"ab" * 40, b"a" * 70, b"", bytes(r.choice(b"ab") for _ in range(200)), b"\xff\x01\xff", b"banana"]
    got = rows(sx.suffix_array(make(spark, *texts), **how), "doc_id", "rank", "pos")
    assert got == sorted((d, k, p) for d, t in enumerate(texts) for k, p in enumerate(sorted(range(len(t)), key=lambda i: t[i:])))
    some = rows(sx.suffix_array(make(spark, *texts), 3, **how), "doc_id", "rank", "pos")
    assert some == sorted((d, k, p) for d, t in enumerate(texts) for k, p in enumerate(sorted(range(0, len(t), 3), key=lambda i: t[i:])))


def test_suffix_ranges_and_backward_search_agree(spark):
    texts, patterns = [b"mississipi", b"banana", b"aaaa", b"b"], [b"i", b"issi", b"a", b"na", b"aa", b"zz", b"b"]
    c, p = make(spark, *texts), src.patterns(spark, patterns)
    s = sx.suffix_array(c)
    ranges = {(d, k): (lo, hi) for d, k, lo, hi in rows(search.suffix_range(s, c, p), "doc_id", "pattern_id", "lo", "hi")}
    assert len(ranges) == len(texts) * len(patterns) and ranges[0, 5] == (-1, -2)
    assert {k: v for k, v in ranges.items() if v[0] >= 0} == {(d, k): (lo, hi) for d, k, lo, hi in rows(succinct.backward_search(c, s, p), "doc_id", "pattern_id", "lo", "hi")}
    assert rows(search.prefix_suffixes(s, c, src.patterns(spark, [b"issi", b""])).filter("pattern_id = 0"), "doc_id", "pos") == [(0, 1), (0, 4)]


def test_insert_and_delete_are_sets(spark):
    c = make(spark, b"mississipi")
    s = sx.suffix_array(c)
    one = s.filter("pos = 1")
    less = sx.delete(s, one)
    assert rows(less, "pos") == [(k,) for k in range(10) if k != 1] and rows(sx.delete(less, one), "pos") == rows(less, "pos")
    assert rows(sx.insert(sx.insert(less, one), one), "pos") == [(k,) for k in range(10)]


def test_first_differing_bits(spark):
    pairs = [("a", "t", 3), ("a", "z", 3), ("a", ",", 1), ("t", "z", 4), ("t", ",", 1), ("z", ",", 1), (",", "\xd4", 0), ("t", "u", 7)]
    df = spark.createDataFrame([(ord(a), ord(b), k) for a, b, k in pairs], "a int, b int, k int")
    assert all(r[0] == r[1] for r in df.select(fn.first_differing_bit(F.col("a"), F.col("b")), "k").collect())
    assert spark.range(1).select(fn.log2_ceiling(F.lit(8)), fn.log2_ceiling(F.lit(9)), fn.bit_length(F.lit(0)), fn.test_bit(F.lit(128), 0)).first()[:] == (3, 4, 1, 1)


def test_smaller_neighbours_with_ties(spark):
    v = [3, 3, 1, 1, 2, 2, 5, 1]
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "g long, i long, v double")
    got = rows(succinct.smaller_neighbours(df, "g", "i", "v"), "i", "psv", "nsv")
    want = [(i, max((j for j in range(i) if v[j] < x), default=None), min((j for j in range(i + 1, len(v)) if v[j] < x), default=None)) for i, x in enumerate(v)]
    assert got == want


def test_smaller_neighbours_of_many_groups_in_a_batch(spark):
    r = random.Random(2)
    sizes = [1, 1, 2, 0, 3, 40, 1, 700, 5, 2, 90, 1]
    data = [(None if g == 4 else f"g{g}", 2 * i, float(r.randint(0, 5))) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(data, "g string, i long, v double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        near = succinct.smaller_neighbours(df, "g", "i", "v")
        got = sorted((str(g), i, psv, nsv) for g, i, psv, nsv in near.select("g", "i", "psv", "nsv").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for g, i, x in data:
        own = {j: y for h, j, y in data if h == g}
        want.append((str(g), i, max((j for j in own if j < i and own[j] < x), default=None), min((j for j in own if j > i and own[j] < x), default=None)))
    assert got == sorted(want)
    # one call of Python for a batch of rows, not one for each group
    assert "FlatMapGroups" not in near._jdf.queryExecution().toString()


def test_settled_tables_and_corpora_are_not_broadcast_by_the_size_of_their_file(spark, tmp_path):
    make(spark, b"mississipi", b"banana").write.parquet(str(tmp_path / "texts"))
    c = src.corpus(spark.read.parquet(str(tmp_path / "texts")), F.col("doc_id"), F.col("text"))
    s = sx.suffix_array(c)
    for df in (succinct.bwt(c, s), succinct.psi(s), sx.with_lcp(c, s), search.suffix_range(s, c, src.patterns(spark, [b"i"])).filter("lo >= 0")):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin [doc_id" not in plan and "SortMergeJoin [doc_id" in plan


def test_range_join_equals_a_scan(spark):
    r = random.Random(1)
    pts = [(k, r.randint(0, 99), r.randint(0, 99)) for k in range(300)]
    rects = [(k, *sorted((r.randint(0, 99), r.randint(0, 99))), *sorted((r.randint(0, 99), r.randint(0, 99)))) for k in range(20)] + [(99, 5, 1, 0, 9)]
    got = rows(pt.range_join(spark.createDataFrame(pts, "id long, x long, y long"), spark.createDataFrame(rects, "rect_id long, lx long, hx long, ly long, hy long"), 7), "rect_id", "id")
    assert got == sorted((a, p) for a, lx, hx, ly, hy in rects for p, x, y in pts if lx <= x <= hx and ly <= y <= hy)


def test_integer_files(spark, tmp_path):
    values = [0, 1, 255, 256, 2**32, 2**39 + 5]
    (tmp_path / "a.sa5").write_bytes(b"".join(v.to_bytes(5, "little") for v in values))
    got = rows(src.integers(spark, str(tmp_path / "a.sa5"), 5), "rank", "value")
    assert got == list(enumerate(values))


def test_index_round_trip_and_stream(spark, tmp_path):
    from lexgrid.sources.index_store import Index, build
    from lexgrid.streaming.patterns import stream_locate

    texts, patterns = [b"mississipi", b"banana", "é ciónes é".encode()], ["issi", "ana", "é", "nesx"]
    c = make(spark, *texts)
    build(c, str(tmp_path / "index"), 2, 8)
    index = Index(spark, str(tmp_path / "index"))
    want = naive(texts, [p.encode() for p in patterns])
    assert rows(index.locate(src.patterns(spark, patterns)), "pattern_id", "doc_id", "pos") == want
    long = ["mississipi", "mississipx", "longer than keys"]
    assert rows(index.locate(src.patterns(spark, long)), "pattern_id", "doc_id", "pos") == naive(texts, [p.encode() for p in long])
    assert {r["part"] for r in index.sizes().filter("files > 0 and bytes > 0").collect()} == {"points", "corpus", "meta", "builds"}
    plan = index.asked(src.patterns(spark, ["issi"]))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan and "EqualTo(cx" in plan
    src.patterns(spark, patterns).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pattern_id long, p binary, m long").parquet(str(tmp_path / "in"))
    q = stream_locate(stream, index.points, 2).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("hits"), "pattern_id", "doc_id", "pos") == [x for x in want if len(patterns[x[0]].encode()) >= 2]


def test_stream_of_short_and_long_patterns(spark, tmp_path):
    from lexgrid.streaming.patterns import stream_locate

    texts, patterns = [b"mississipi banana mississipi", b"banana", b"issi"], [b"i", b"na", b"sissipi banana miss", b"mississipi banana", b"sissipi bananas", b"issippy", b""]
    c, pts = make(spark, *texts), pt.keyed_points(make(spark, *texts), 3, 4)

    def hits(some, name, *corpus):
        src.patterns(spark, some).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema("pattern_id long, p binary, m long").parquet(str(tmp_path / name))
        q = stream_locate(stream, pts, 3, *corpus).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}_cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return rows(spark.table(name), "pattern_id", "doc_id", "pos")

    assert hits(patterns, "all_hits", c) == naive(texts, patterns)
    assert hits([b"issi"], "fits") == naive(texts, [b"issi"])
    for name, some in (("too_short", [b"na"]), ("too_long", [b"mississipi banana"])):
        with pytest.raises(Exception, match="needs the corpus"):
            hits(some, name)


def test_matching_statistics_of_long_texts(spark, tmp_path):
    from lexgrid.plans.queries import v29_matching_statistics

    name = "".join(chr(97 + k * k % 23) + str(k) for k in range(60))
    spark.createDataFrame([(1, name, "x" + name[5:120] + "y"), (2, "", "z")], "p_partkey long, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    t = "x" + name[5:120] + "y"
    want = [(1, i, max(k for k in range(len(name) - i + 1) if name[i : i + k] in t)) for i in range(len(name))]
    assert max(k for _, _, k in want) > 64 and rows(v29_matching_statistics(spark, str(tmp_path)), "doc_id", "pos", "longest") == want


def test_vectors_are_scaled_in_their_own_type(spark, tmp_path):
    from lexgrid.plans.relations import l1_vectors

    spark.createDataFrame([(1, [0.18, 0.29, 0.57, 0.58, -0.07, 1.0, 0.0, 2.5, -0.18])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert l1_vectors(spark, str(tmp_path)).first()["cut"] == "18,29,57,58,-7"


def test_open_rectangles_are_all_pairs_that_touch(spark, tmp_path):
    from lexgrid.plans.relations import f4_open_rectangles

    orders = [(k, k * k % 977) for k in range(120)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    want = sorted((a, b) for a, c in orders for b, e in orders if a != b and c % 50 == e % 50 + b % 9)
    assert rows(f4_open_rectangles(spark, str(tmp_path)), "one", "two") == want and any(a % 16 != b % 16 for a, b in want)


@pytest.mark.parametrize("step", [1, 3, 4])
def test_points_that_a_batch_asks_for(spark, monkeypatch, step):
    from lexgrid.operators import positions

    monkeypatch.setattr(positions, "PIECE", 7)
    monkeypatch.setattr(positions, "AT_ONCE", 20)
    r = random.Random(step)
    texts = [bytes(r.choice(b"abc\xff") for _ in range(n)) for n in (0, 1, 6, 7, 8, 14, 50, 90, 3, 3, 3)] + [None]
    patterns = [b"abca", b"aaaa", b"bcab", b"\xffab\xff", b"cbaabc", b"ba", b"aaa"]
    c, p = make(spark, *texts), src.patterns(spark, patterns)
    every, some = pt.keyed_points(c, step, 8), pt.keyed_points(c, step, 8, p)
    columns = ("doc_id", "pos", "cx", "cy", "key", "y")
    want = [(d, q, t[q : q + 1], t[q - 1 : q] if q else None, t[q : q + 8], t[max(0, q - step) : q][::-1] if q else None) for d, t in enumerate(texts) if t for q in range(0, len(t), step)]
    plain = lambda df: [tuple(bytes(x) if isinstance(x, bytearray) else x for x in row) for row in rows(df, *columns)]
    assert plain(every) == sorted(want)
    asked = {(d, -(-i // step) * step) for k, d, i in naive(texts, patterns) if len(patterns[k]) >= step}
    assert plain(some) == sorted(x for x in want if x[:2] in asked)
    assert rows(search.locate(some, c, p, step), "pattern_id", "doc_id", "pos") == naive(texts, patterns)
    # texts are searched; no row is made for each of their positions
    for df in (search.locate(some, c, p, step), sx.naive_scan(c, p)):
        assert "explode(transform(CASE" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_doubling_sorts_only_ties(spark, monkeypatch):
    sizes, true = [], sx.ranked

    def ranked(rows, *more):
        sizes.append(rows.count())
        return true(rows, *more)

    monkeypatch.setattr(sx, "ranked", ranked)
    texts = [b"abcdefghijklmnopqrstuvwxyz" * 2, b"the quick brown fox", b"aaaa"]
    for how in ({}, {"window_bytes": 0}):
        sizes.clear()
        got = rows(sx.suffix_array(make(spark, *texts), first_bytes=2, **how), "doc_id", "rank", "pos")
        assert got == sorted((d, k, p) for d, t in enumerate(texts) for k, p in enumerate(sorted(range(len(t)), key=lambda i: t[i:])))
        # 25 pairs of letters stand twice in the first text, none in the second, one three times in the third
        rounds = [x for x in sizes if x]
        assert rounds[0] == 75 and rounds[1] == 53 and rounds == sorted(rounds, reverse=True)


def test_tasks_are_bounded_by_bytes_of_text(spark, monkeypatch):
    from lexgrid.operators import batches

    monkeypatch.setattr(batches, "PART", 100)
    c = make(spark, *[b"large ring"] * 100)
    assert [x.rdd.getNumPartitions() for x in batches.dealt(c, c.select("doc_id"))] == [10, 10]
    plan = succinct.entropy(c, 0)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1
    samples = sx.suffix_array(c, 2).withColumnRenamed("rank", "x")
    assert "REPARTITION_BY_NUM" in pt.directory(samples, c)._jdf.queryExecution().executedPlan().toString()


def test_entries(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
