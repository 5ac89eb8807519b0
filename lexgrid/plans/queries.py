"""Queries of the pattern engine over whole tables, and DuckDB SQL for them.

Binary results are shown as upper-case hex. `names` are the short texts of `part`; `long names` those of `customer`, which repeat much.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.functions import bytes as fn
from lexgrid.operators import points as pt
from lexgrid.operators import search, succinct
from lexgrid.operators import suffixes as sx
from lexgrid.sources import text as src

STEP = 4
#: Patterns for documents and conversations, and for names: frequent, rare, absent, overlapping, of several bytes a letter, shorter than a step.
TEXT_PATTERNS = [" the ", "tion", "é", "aa", "zzzzqqqq", "and the", "thth", "ciónes"]
NAME_PATTERNS = ["e", "er", "part", "ar", "000", "xyzzy", "00"]

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def documents(spark, d):
    return src.corpus(read(spark, d, "documents"), F.col("doc_id"), F.col("text"))


def names(spark, d):
    return src.corpus(read(spark, d, "part"), F.col("p_partkey"), F.col("p_name"))


def long_names(spark, d):
    return src.corpus(read(spark, d, "customer"), F.col("c_custkey"), F.col("c_name"))


def turns(spark, d):
    return src.corpus(read(spark, d, "conversations"), F.concat_ws("/", "conv_id", "turn"), F.col("text"))


def name_suffixes(spark, d, step=1):
    return sx.suffix_array(names(spark, d), step)


def name_samples(spark, d, step=2):
    return sx.suffix_array(names(spark, d), step).withColumnRenamed("rank", "x")


def hexed(df: DataFrame) -> DataFrame:
    return df.select(*[F.hex(c).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes])


def named(df: DataFrame, patterns: list[str]) -> DataFrame:
    """pattern_id as the pattern."""
    return df.withColumn("pattern", F.element_at(F.array(*[F.lit(p) for p in patterns]), (F.col("pattern_id") + 1).cast("int"))).drop("pattern_id")


# SQL in parts
B = "b as (select p_partkey as doc_id, encode(p_name) as t, strlen(p_name) as n from part where p_name is not null)"
CUST = "b as (select c_custkey as doc_id, encode(c_name) as t, strlen(c_name) as n from customer where c_name is not null)"
SA = "s as (select doc_id, i as pos, t[i+1:] as suf, t, n from b, range(n) r(i)), sa as (select doc_id, row_number() over (partition by doc_id order by suf) - 1 as rank, pos, suf, t, n from s)"
LCP = "l as (select *, lag(suf) over w as prv, lag(pos) over w as prev from sa window w as (partition by doc_id order by rank)), lc as (select doc_id, rank, pos, prev, case when prv is null then 0 else (select count(*) from range(1, least(octet_length(suf), octet_length(prv)) + 1) q(k) where suf[1:k] = prv[1:k]) end as lcp from l)"
SAMPLES = "sm as (select doc_id, row_number() over (partition by doc_id order by suf) - 1 as x, pos, t, n from s where pos % 2 = 0)"
POINTS = "pts as (select doc_id, t[pos+1:pos+1] as cx, t[pos:pos] as cy, x, t[pos:pos] || t[pos-1:pos-1] as y, pos from sm where pos > 0)"
values = lambda items: "p(pattern) as (values " + ", ".join(f"('{x}')" for x in items) + ")"
WITH_SA, WITH_POINTS = f"with {B}, {SA}", f"with {B}, {SA}, {SAMPLES}, {POINTS}"
NAMES_P = values(NAME_PATTERNS)
HITS = "hits as (select p.pattern, sa.doc_id, sa.rank, sa.pos from sa, p where suf[1:strlen(pattern)] = encode(pattern))"
OCCURRENCES = f"""with recursive {values(TEXT_PATTERNS)}, f as (
  select pattern, doc_id, text as rest, 0::bigint as off, instr(text, pattern) as spot from documents, p where contains(text, pattern)
  union all
  select pattern, doc_id, substr(rest, spot + 1), off + strlen(substr(rest, 1, spot)), instr(substr(rest, spot + 1), pattern) from f where spot > 0),
o as (select pattern, doc_id, off + strlen(substr(rest, 1, spot - 1)) as pos from f where spot > 0)"""


@query("select doc_id, strlen(text) as n, md5(text) as md5 from documents where text is not null")
def src1_read_text(spark, d):
    return documents(spark, d).select("doc_id", "n", F.md5("text").alias("md5"))


@query(f"with {CUST}, {SA}, {LCP} select max(lcp)::bigint as max_lcp, (length(bin(max(lcp))) + 3)::int as bits from lc")
def src9_max_lcp(spark, d):
    c = long_names(spark, d)
    x = sx.with_lcp(c, sx.suffix_array(c)).agg(F.max("lcp").alias("max_lcp"))
    return x.select("max_lcp", (fn.bit_length(F.col("max_lcp")) + 3).alias("bits"))


@query("""with recursive p(pattern) as (values ('e'), ('he'), ('aa'), ('tion'), ('zzqq')), f as (
  select pattern, conv_id, turn, text as rest, 0::bigint as off, instr(text, pattern) as spot from conversations, p where contains(text, pattern)
  union all select pattern, conv_id, turn, substr(rest, spot + 1), off + strlen(substr(rest, 1, spot)), instr(substr(rest, spot + 1), pattern) from f where spot > 0)
select pattern, conv_id || '/' || turn as doc_id, off + strlen(substr(rest, 1, spot - 1)) as pos from f where spot > 0""")
def o1_naive_scan(spark, d):
    asked = ["e", "he", "aa", "tion", "zzqq"]
    return named(sx.naive_scan(turns(spark, d), src.patterns(spark, asked)), asked)


@query(f"{WITH_SA} select doc_id, rank, pos from sa")
def o2_suffix_array(spark, d):
    return name_suffixes(spark, d)


@query(f"with {CUST}, {SA} select doc_id, rank, pos from sa")
def o2_suffix_array_by_doubling(spark, d):
    """First bytes so few that every text ties: ranks come from doubling, by ranges over all tasks."""
    return sx.suffix_array(long_names(spark, d), first_bytes=2, window_bytes=0)


@query("with b as (select conv_id || '/' || turn as doc_id, encode(text) as t, strlen(text) as n from conversations where text is not null), s as (select doc_id, i as pos, t[i+1:] as suf from b, range(n) r(i)) select doc_id, row_number() over (partition by doc_id order by suf) - 1 as rank, pos from s")
def o2_suffix_array_conversations(spark, d):
    return sx.suffix_array(turns(spark, d))


@query(f"{WITH_SA} select doc_id, pos, rank as isa from sa")
def v2_inverse(spark, d):
    return sx.inverse(name_suffixes(spark, d))


@query(f"with {CUST}, {SA}, {LCP} select doc_id, rank, pos, prev, lcp from lc")
def w1_lcp(spark, d):
    c = long_names(spark, d)
    return sx.with_lcp(c, sx.suffix_array(c))


@query(f"with {CUST}, {SA}, {LCP}, g as (select *, coalesce(sum(case when pos % 4 = 0 then 1 else 0 end) over (partition by doc_id order by rank rows between unbounded preceding and 1 preceding), 0) as grp from lc), m as (select doc_id, grp, min(lcp) as least, max(case when pos % 4 = 0 then pos end) as pos from g group by doc_id, grp) select doc_id, grp::bigint as x, pos, case when grp = 0 then 0 else least end as lcp from m where pos is not null")
def w2_sampled_lcp(spark, d):
    c = long_names(spark, d)
    return sx.sampled(sx.with_lcp(c, sx.suffix_array(c)), 4)


@query(f"{WITH_SA}, {SAMPLES} select doc_id, x, pos from sm")
def f1_sampled_suffixes(spark, d):
    return name_samples(spark, d)


@query(f"{WITH_POINTS} select doc_id, hex(cx) as cx, hex(cy) as cy, x, hex(y) as y, pos from pts")
def b5_points(spark, d):
    return hexed(pt.points(names(spark, d), name_samples(spark, d), 2))


@query(f"{WITH_SA}, {SAMPLES} select doc_id, hex(t[pos+1:pos+1]) as ch, min(x) as lo, max(x) as hi from sm group by 1, 2")
def a4_directory(spark, d):
    return hexed(pt.directory(name_samples(spark, d), names(spark, d)))


@query(f"{WITH_POINTS} select doc_id, hex(cx) as cx, hex(cy) as cy, count(*) as points from pts group by 1, 2, 3")
def a5_cells(spark, d):
    return hexed(pt.cells(pt.points(names(spark, d), name_samples(spark, d), 2)))


@query(f"{WITH_POINTS}, c as (select doc_id, cx, cy, count(*) as points from pts group by 1, 2, 3) select doc_id, max(points) as most, count(*) as cells, sum(points)::bigint as points from c group by 1")
def a6_cell_totals(spark, d):
    c = pt.cells(pt.points(names(spark, d), name_samples(spark, d), 2))
    return c.groupBy("doc_id").agg(F.max("points").alias("most"), F.count(F.lit(1)).alias("cells"), F.sum("points").alias("points"))


@query(f"{WITH_POINTS} select doc_id, min(x) as min_x, max(x) as max_x, hex(min(y)) as min_y, hex(max(y)) as max_y, count(*) as points from pts group by 1")
def a9_bounds(spark, d):
    return hexed(pt.bounds(pt.points(names(spark, d), name_samples(spark, d), 2)))


@query(f"{WITH_SA}, {NAMES_P}, {HITS} select b.doc_id, p.pattern, coalesce(min(rank), -1) as lo, coalesce(max(rank), -2) as hi from b cross join p left join hits h on h.doc_id = b.doc_id and h.pattern = p.pattern group by 1, 2")
def j3_suffix_range(spark, d):
    return named(search.suffix_range(name_suffixes(spark, d), names(spark, d), src.patterns(spark, NAME_PATTERNS)), NAME_PATTERNS)


@query(f"{WITH_SA}, {NAMES_P}, {HITS} select pattern, doc_id, rank, pos from hits")
def j10_prefix_suffixes(spark, d):
    return named(search.prefix_suffixes(name_suffixes(spark, d), names(spark, d), src.patterns(spark, NAME_PATTERNS)), NAME_PATTERNS)


@query(f"{WITH_SA}, {NAMES_P}, {HITS} select distinct pattern, doc_id from hits")
def f7_contains(spark, d):
    return named(search.prefix_suffixes(name_suffixes(spark, d), names(spark, d), src.patterns(spark, NAME_PATTERNS)).select("doc_id", "pattern_id").distinct(), NAME_PATTERNS)


RECTS = [(0, 10, 60, 0, 5), (1, 100, 900, 3, 9), (2, 50, 50, 1, 100), (3, 9, 3, 0, 10), (4, 0, 100000, 7, 7)]
RECTS_SQL = "rects(rect_id, lx, hx, ly, hy) as (values " + ", ".join(map(str, RECTS)) + ")"


def rectangles(spark):
    return spark.createDataFrame(RECTS, "rect_id long, lx long, hx long, ly long, hy long")


@query(f"with {RECTS_SQL} select rect_id::bigint as rect_id, l_orderkey, l_linenumber, l_partkey as x, l_suppkey as y from lineitem, rects where l_partkey between lx and hx and l_suppkey between ly and hy")
def j6_range_join(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))
    return pt.range_join(rows, rectangles(spark), 1000)


@query(f"with {RECTS_SQL} select a.rect_id::bigint as a, b.rect_id::bigint as b, greatest(a.lx, b.lx) <= least(a.hx, b.hx) and greatest(a.ly, b.ly) <= least(a.hy, b.hy) as meet, a.lx <= b.lx and b.hx <= a.hx and a.ly <= b.ly and b.hy <= a.hy as holds from rects a, rects b where a.rect_id < b.rect_id")
def f4_rectangles(spark, d):
    r = rectangles(spark)
    one, two = r.select([F.col(c).alias(f"a_{c}") for c in r.columns]), r.select([F.col(c).alias(f"b_{c}") for c in r.columns])
    return one.join(F.broadcast(two), F.col("a_rect_id") < F.col("b_rect_id")).select(F.col("a_rect_id").alias("a"), F.col("b_rect_id").alias("b"), pt.intersect("a_", "b_").alias("meet"), pt.contains("a_", "b_").alias("holds"))


def document_points(spark, d, step=STEP):
    return pt.keyed_points(documents(spark, d), step, max(len(p.encode()) for p in TEXT_PATTERNS), src.patterns(spark, TEXT_PATTERNS))


@query(f"{OCCURRENCES} select p.pattern, count(o.pos) as occurrences, count(distinct o.doc_id) as docs from p left join o using (pattern) group by 1")
def a1_count(spark, d):
    return named(search.count(document_points(spark, d), documents(spark, d), src.patterns(spark, TEXT_PATTERNS), STEP), TEXT_PATTERNS)


@query(f"{OCCURRENCES} select pattern, doc_id, pos from o")
def a3_locate(spark, d):
    return named(search.locate(document_points(spark, d, 3), documents(spark, d), src.patterns(spark, TEXT_PATTERNS), 3).drop("k"), TEXT_PATTERNS)


@query(f"{OCCURRENCES} select pattern, case when strlen(pattern) < 4 then 0 else case when pos % 4 = 0 then 1 else (pos % 4) + 1 end end::int as k, count(*) as n from o group by 1, 2")
def u1_cases(spark, d):
    hits = search.locate(document_points(spark, d), documents(spark, d), src.patterns(spark, TEXT_PATTERNS), STEP)
    return named(hits.groupBy("pattern_id", "k").agg(F.count(F.lit(1)).alias("n")), TEXT_PATTERNS)


@query(f"{WITH_SA} select distinct doc_id, pos from (select doc_id, pos from sa where pos % 3 = 0 union all select doc_id, pos from sa where pos % 2 = 0)")
def u2_insert(spark, d):
    s = name_suffixes(spark, d)
    return sx.insert(s.filter("pos % 3 = 0"), s.filter("pos % 2 = 0"))


@query(f"{WITH_SA} select doc_id, pos from sa where pos % 2 <> 0")
def u3_delete(spark, d):
    s = name_suffixes(spark, d)
    return sx.delete(s, s.filter("pos % 2 = 0"))


@query(f"with {CUST}, {SA}, {LCP} select doc_id, rank // 5 as block, arg_min(pos, rank) as first_pos, min(lcp) as min_lcp, count(*) as size from lc group by 1, 2")
def a11_blocks(spark, d):
    c = long_names(spark, d)
    return sx.blocks(sx.with_lcp(c, sx.suffix_array(c)), 5)


@query("with x as (select o_orderkey as k, o_custkey as c from orders) select k, length(bin(k))::int as bits, case when k <= 1 then 0 else length(bin(k - 1)) end::int as log2c, k % 256 + (c % 256) * 4294967296 as joined, case when k % 256 <> c % 256 then 8 - length(bin(xor(k % 256, c % 256))) end::int as bit, ((k % 256) >> 5 & 1)::int as third, floor((4096 - 72) * 8 / (4 + length(bin(k)) + length(bin(c))))::bigint as fan, floor(((4096 - 24) * 8 - 192) / (length(bin(k)) + 24 + length(bin(c))))::bigint as leaf, (k % 256) * 8 + c % 8 as packed from x")
def s6_bits_and_sizes(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    one, two = k % 256, c % 256
    page = F.lit(4096)
    return read(spark, d, "orders").select(k.alias("k"), fn.bit_length(k).alias("bits"), fn.log2_ceiling(k).alias("log2c"), fn.low_high(one, two).alias("joined"), fn.first_differing_bit(one, two).alias("bit"), fn.test_bit(one, 2).alias("third"), fn.branching(page, fn.bit_length(k), fn.bit_length(c)).alias("fan"), fn.leaf_points(page, fn.bit_length(k), F.lit(24), fn.bit_length(c)).alias("leaf"), (F.shiftleft(one, 3) + c % 8).alias("packed"))


@query("with x as (select l_orderkey, l_linenumber, l_partkey as l, l_partkey + l_suppkey * 7 as r from lineitem) select l_orderkey, l_linenumber, case when l = r then 0 else greatest(0, ceil(r / 50) - ceil(l / 50) - 1) end::bigint as leaves, (floor(ln(r + 2) / ln(50)) + 1)::bigint as height from x")
def s20_page_arithmetic(spark, d):
    left, right = F.col("l_partkey"), F.col("l_partkey") + F.col("l_suppkey") * 7
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.extra_leaves(left, right, F.lit(50)).alias("leaves"), fn.tree_height(right + 2, F.lit(50)).alias("height"))


@query(f"{WITH_SA} select doc_id, rank, case when pos = 0 then '' else hex(t[pos:pos]) end as ch from sa")
def v3_bwt(spark, d):
    return hexed(succinct.bwt(names(spark, d), name_suffixes(spark, d)))


@query(f"{WITH_SA} select a.doc_id, a.rank, b.rank as psi from sa a join sa b on a.doc_id = b.doc_id and b.pos = (a.pos + 1) % a.n")
def v4_psi(spark, d):
    return succinct.psi(name_suffixes(spark, d))


@query(f"{WITH_SA} select a.doc_id, b.rank, a.rank as lf from sa a join sa b on a.doc_id = b.doc_id and b.pos = (a.pos + 1) % a.n")
def v4_lf(spark, d):
    return succinct.lf(name_suffixes(spark, d))


@query(f"{WITH_SA}, c as (select doc_id, t[pos+1:pos+1] as ch, count(*) as n from sa group by 1, 2) select doc_id, hex(ch) as ch, n, coalesce(sum(n) over (partition by doc_id order by ch rows between unbounded preceding and 1 preceding), 0)::bigint as c from c")
def v6_symbol_counts(spark, d):
    return hexed(succinct.symbol_counts(names(spark, d), name_suffixes(spark, d)))


@query(f"{WITH_SA}, w as (select doc_id, rank, case when pos = 0 then '' else hex(t[pos:pos]) end as ch from sa) select doc_id, rank, ch, row_number() over (partition by doc_id, ch order by rank) - 1 as before, row_number() over (partition by doc_id, ch order by rank) as nth from w")
def v7_rank_select(spark, d):
    return hexed(succinct.rank_select(succinct.bwt(names(spark, d), name_suffixes(spark, d))))


@query(f"{WITH_SA}, {NAMES_P}, {HITS} select doc_id, pattern, min(rank) as lo, max(rank) as hi from hits group by 1, 2")
def v8_backward_search(spark, d):
    found = succinct.backward_search(names(spark, d), name_suffixes(spark, d), src.patterns(spark, NAME_PATTERNS))
    return named(found, NAME_PATTERNS)


@query("select item_id as doc_id, hex(encode(text)[11:31]) as bytes from benchmark where text is not null")
def v11_extract(spark, d):
    c = src.corpus(read(spark, d, "benchmark"), F.col("item_id"), F.col("text"))
    return hexed(c.select("doc_id", succinct.extract(F.col("text"), F.lit(10), F.lit(30)).alias("bytes")))


def entropy_sql(k: int) -> str:
    return f"""with {B}, x as (select doc_id, t[i-{k}+1:i] as context, t[i+1:i+1] as ch from b, range({k}, n) r(i)), c as (select doc_id, context, ch, count(*) as n from x group by 1, 2, 3),
s as (select *, n / sum(n) over (partition by doc_id, context) as share, sum(n) over (partition by doc_id) as total from c) select doc_id, round(sum(-n * log2(share) / total), 9) as entropy from s group by 1"""


@query(entropy_sql(0))
def v12_entropy(spark, d):
    return succinct.entropy(names(spark, d), 0).withColumn("entropy", F.round("entropy", 9))


@query(entropy_sql(2))
def v12_entropy_of_contexts(spark, d):
    return succinct.entropy(names(spark, d), 2).withColumn("entropy", F.round("entropy", 9))


@query("with e as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as i, value as v from events where value is not null) select user_id, i, v, (select max(b.i) from e b where b.user_id = a.user_id and b.i < a.i and b.v < a.v) as psv, (select min(b.i) from e b where b.user_id = a.user_id and b.i > a.i and b.v < a.v) as nsv from e a")
def v13_smaller_neighbours(spark, d):
    return succinct.smaller_neighbours(event_series(spark, d), "user_id", "i", "v")


def event_series(spark, d):
    from pyspark.sql import Window as W

    e = read(spark, d, "events").filter("value is not null")
    return e.select("user_id", (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("i"), F.col("value").alias("v"))


@query("with e as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as i, value as v from events where value is not null), q as (select user_id, min(i) + 1 as l, max(i) as r from e group by 1) select user_id as query_id, arg_min(i, (v, i)) as least, arg_min(i, (-v, i)) as most from e join q using (user_id) where i between l and r group by 1")
def v14_range_minimum(spark, d):
    e = event_series(spark, d)
    q = e.groupBy("user_id").agg((F.min("i") + 1).alias("l"), F.max("i").alias("r")).withColumn("query_id", F.col("user_id"))
    least = succinct.range_minimum(e, q, "user_id").withColumnRenamed("at", "least")
    return least.join(succinct.range_minimum(e, q, "user_id", most=True).withColumnRenamed("at", "most"), "query_id")


@query(f"{WITH_SA}, w as (select doc_id, rank, case when pos = 0 then '' else hex(t[pos:pos]) end as ch from sa) select doc_id as query_id, ch, count(*) filter (rank < 2) as before, count(*) filter (rank >= 2) as inside from w where rank < 6 group by 1, 2 having count(*) filter (rank >= 2) > 0")
def v15_interval_symbols(spark, d):
    c = names(spark, d)
    q = c.select("doc_id", F.col("doc_id").alias("query_id"), F.lit(2).alias("l"), F.lit(6).alias("r"))
    return hexed(succinct.interval_symbols(succinct.bwt(c, name_suffixes(spark, d)), q))


BITS = "e as (select user_id as doc_id, row_number() over (partition by user_id order by event_id) - 1 as i, case when event_id % 3 = 0 then 1 else 0 end as bit from events)"


def bits(spark, d):
    from pyspark.sql import Window as W

    return read(spark, d, "events").select(F.col("user_id").alias("doc_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("i"), F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("bit"))


@query(f"with {BITS}, f as (select *, case when bit = 0 and lag(bit) over (partition by doc_id order by i) = 1 then 1 else 0 end as fall from e) select doc_id, i, bit, coalesce(sum(bit) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as rank1, sum(fall) over (partition by doc_id order by i)::bigint as rank10, max(case when bit = 1 then i end) over (partition by doc_id order by i) as prev1, min(case when bit = 1 then i end) over (partition by doc_id order by i rows between current row and unbounded following) as next1 from f")
def v16_bit_ranks(spark, d):
    return succinct.bit_ranks(bits(spark, d))


@query(f"with {BITS} select doc_id, row_number() over (partition by doc_id order by i) as k, i from e where bit = 1")
def v16_bit_select(spark, d):
    return succinct.bit_select(bits(spark, d))


INTERVALS = "iv as (select distinct doc_id, lcp as depth, coalesce((select max(b.rank) from lc b where b.doc_id = a.doc_id and b.rank < a.rank and b.rank > 0 and b.lcp < a.lcp), 0) as lb, coalesce((select min(b.rank) from lc b where b.doc_id = a.doc_id and b.rank > a.rank and b.lcp < a.lcp), n) - 1 as rb from lc a join (select doc_id, count(*) as n from lc group by 1) using (doc_id) where rank > 0 union select doc_id, 0, 0, count(*) - 1 from lc group by 1 having count(*) > 1)"


def name_nodes(spark, d):
    c = names(spark, d)
    return succinct.lcp_intervals(sx.with_lcp(c, sx.suffix_array(c)))


@query(f"{WITH_SA}, {LCP}, {INTERVALS} select doc_id, depth, lb, rb from iv")
def v21_tree_nodes(spark, d):
    return name_nodes(spark, d)


PARENS = "par as (select doc_id, row_number() over (partition by doc_id order by spot, side, tie) - 1 as i, bit from (select doc_id, lb as spot, 0 as side, -rb as tie, 1 as bit from iv union all select doc_id, rb, 1, -lb, 0 from iv))"


@query(f"{WITH_SA}, {LCP}, {INTERVALS}, {PARENS}, x as (select *, sum(case when bit = 1 then 1 else -1 end) over (partition by doc_id order by i) as e from par) select a.doc_id, a.i as open, min(b.i) as close from x a join x b on a.doc_id = b.doc_id and b.i > a.i and b.e = a.e - 1 where a.bit = 1 group by 1, 2")
def v24_matching_parentheses(spark, d):
    return succinct.matching_parentheses(succinct.parentheses(name_nodes(spark, d)))


@query("with b as (select p_partkey as doc_id, encode(p_name) as t, strlen(p_name) as n, encode(p_type) as o from part where p_name is not null and p_type is not null) select doc_id, i as pos, coalesce((select max(k) from range(1, n - i + 1) q(k) where contains(hex(o), hex(t[i+1:i+k])) and (select bool_or(o[j:j+k-1] = t[i+1:i+k]) from range(1, octet_length(o) + 1) z(j))), 0)::bigint as longest from b, range(n) r(i)")
def v29_matching_statistics(spark, d):
    types = src.corpus(read(spark, d, "part").filter("p_name is not null"), F.col("p_partkey"), F.col("p_type"))
    other = src.corpus(read(spark, d, "part").filter("p_type is not null"), F.col("p_partkey"), F.col("p_name"))
    return succinct.matching_statistics(types, other)


@query(f"{OCCURRENCES} select p.pattern, count(o.pos) as occurrences from p left join o using (pattern) group by 1")
def snk_index_round_trip(spark, d):
    """Written, opened and asked: the same counts."""
    import uuid

    from lexgrid.sources.index_store import Index, build
    from lexgrid.sources.store import shared_folder

    path = f"{shared_folder(spark)}/lexgrid/{uuid.uuid4().hex}/index"
    build(documents(spark, d), path, STEP, 8)
    asked = src.patterns(spark, TEXT_PATTERNS)
    hits = Index(spark, path).locate(asked).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    return named(asked.join(hits, "pattern_id", "left").select("pattern_id", F.coalesce("n", F.lit(0).cast("long")).alias("occurrences")), TEXT_PATTERNS)
