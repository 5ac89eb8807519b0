"""Further queries over whole tables: trees, parentheses, arrays as files, the stored index and its statistics, selection, bits; and DuckDB SQL for them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexgrid.functions import bits as bt
from lexgrid.functions import bytes as fn
from lexgrid.operators import points as pt
from lexgrid.operators import search, selection, succinct, trees
from lexgrid.operators import suffixes as sx
from lexgrid.plans.queries import BITS, HITS, INTERVALS, LCP, NAME_PATTERNS, NAMES_P, POINTS, QUERIES, SA, SAMPLES, SQL, WITH_POINTS, WITH_SA, B, bits, event_series, hexed, name_samples, name_suffixes, named, names, query, read
from lexgrid.sources import arrays
from lexgrid.sources import text as src
from lexgrid.sources.index_store import Index, build, page_statistics
from lexgrid.sources.store import settled, shared_folder

__all__ = ["QUERIES", "SQL"]

WITH_LCP = f"{WITH_SA}, {LCP}"
ND = "nd as (select doc_id, lb, rb, max(depth) as depth from (select doc_id, lb, rb, depth from iv union all select doc_id, rank, rank, n - pos from sa) group by 1, 2, 3)"
UP = "up as (select a.doc_id, a.lb, a.rb, arg_min((b.lb, b.rb), b.rb - b.lb) as up from nd a join nd b on a.doc_id = b.doc_id and b.lb <= a.lb and a.rb <= b.rb and (b.lb < a.lb or a.rb < b.rb) group by 1, 2, 3)"
TR = "tr as (select nd.doc_id, nd.lb, nd.rb, nd.depth, up.up[1] as plb, up.up[2] as prb from nd left join up using (doc_id, lb, rb))"
WITH_TREE = f"{WITH_LCP}, {INTERVALS}, {ND}, {UP}, {TR}"
MEASURES = """ms as (select a.doc_id, a.lb, a.rb, a.rb - a.lb + 1 as leaves, (select count(*) from tr c where c.doc_id = a.doc_id and c.plb = a.lb and c.prb = a.rb) as degree,
  (select count(*) from nd c where c.doc_id = a.doc_id and c.lb <= a.lb and a.rb <= c.rb and (c.lb < a.lb or a.rb < c.rb)) as node_depth from tr a),
mo as (select *, row_number() over (partition by doc_id order by lb, rb desc) - 1 as pre, row_number() over (partition by doc_id order by rb, lb desc) - 1 as post, row_number() over (partition by doc_id order by node_depth, lb) - 1 as bfs from ms)"""
PARENS = "par as (select doc_id, row_number() over (partition by doc_id order by spot, side, tie) - 1 as i, bit from (select doc_id, lb as spot, 0 as side, -rb as tie, 1 as bit from nd union all select doc_id, rb, 1, -lb, 0 from nd)), px as (select *, sum(case when bit = 1 then 1 else -1 end) over (partition by doc_id order by i) as e from par), pm as (select a.doc_id, a.i as open, min(b.i) as close, any_value(a.e) as excess from px a join px b on a.doc_id = b.doc_id and b.i > a.i and b.e = a.e - 1 where a.bit = 1 group by 1, 2)"


def name_lcps(spark, d):
    c = names(spark, d)
    return settled(sx.with_lcp(c, name_suffixes(spark, d)))


def name_tree(spark, d):
    lcps = name_lcps(spark, d)
    return settled(trees.tree(names(spark, d), lcps)), lcps


@query(f"{WITH_TREE} select * from tr")
def v21_tree(spark, d):
    return name_tree(spark, d)[0]


@query(f"{WITH_TREE} select *, case when plb is not null then row_number() over w end as ith, case when plb is not null then lead(lb) over w end as slb, case when plb is not null then lead(rb) over w end as srb from tr window w as (partition by doc_id, plb, prb order by lb)")
def v21_children(spark, d):
    return trees.children(name_tree(spark, d)[0])


@query(f"{WITH_TREE} select c.doc_id, c.plb, c.prb, case when c.depth > p.depth then hex(t[pos + p.depth + 1 : pos + p.depth + 1]) else '' end as ch, c.lb, c.rb from tr c join tr p on p.doc_id = c.doc_id and p.lb = c.plb and p.rb = c.prb join sa on sa.doc_id = c.doc_id and sa.rank = c.lb")
def v21_edges(spark, d):
    return hexed(trees.edges(name_tree(spark, d)[0], name_suffixes(spark, d), names(spark, d)))


@query(f"{WITH_TREE} select tr.doc_id, lb, rb, hex(t[pos + 1 : pos + depth]) as label from tr join sa on sa.doc_id = tr.doc_id and sa.rank = tr.lb")
def v11_path_labels(spark, d):
    return hexed(trees.labels(name_tree(spark, d)[0], name_suffixes(spark, d), names(spark, d)))


@query(f"{WITH_TREE}, {MEASURES} select * from mo")
def v22_measures_and_orders(spark, d):
    return trees.measures(name_tree(spark, d)[0])


@query(f"{WITH_TREE}, {MEASURES} select a.doc_id, a.lb, a.rb, a.bfs as nr, (a.bfs + coalesce(sum(a.degree) over (partition by a.doc_id order by a.bfs rows between unbounded preceding and 1 preceding), 0))::bigint as pos, a.degree, coalesce(p.bfs, 0) as parent_nr from mo a join tr using (doc_id, lb, rb) left join mo p on p.doc_id = a.doc_id and p.lb = tr.plb and p.rb = tr.prb")
def v26_level_order_bits(spark, d):
    return trees.level_order_bits(name_tree(spark, d)[0])


@query(f"{WITH_TREE}, {PARENS} select a.doc_id, a.open, a.close, a.excess::bigint as excess, max(b.open) as enclose from pm a left join pm b on b.doc_id = a.doc_id and b.open < a.open and b.close > a.close group by 1, 2, 3, 4")
def v24_parentheses(spark, d):
    return trees.matches(name_tree(spark, d)[0])


@query(f"{WITH_TREE}, q as (select a.doc_id, a.rank as i, a.rank + 2 as j from lc a join lc b on a.doc_id = b.doc_id and b.rank = a.rank + 2) select q.doc_id, i, j, arg_min(nd.lb, nd.rb - nd.lb) as lb, arg_min(nd.rb, nd.rb - nd.lb) as rb, (select min(lcp) from lc where lc.doc_id = q.doc_id and lc.rank > i and lc.rank <= j)::bigint as depth from q join nd on nd.doc_id = q.doc_id and nd.lb <= i and nd.rb >= j group by 1, 2, 3")
def v21_lowest_common(spark, d):
    lcps = name_lcps(spark, d)
    n = lcps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = lcps.join(n, "doc_id").filter("rank + 2 < n").select(F.struct("doc_id", "rank").alias("query_id"), "doc_id", F.col("rank").alias("i"), (F.col("rank") + 2).alias("j"))
    return trees.lowest_common(lcps, pairs).drop("query_id")


@query(f"{WITH_TREE}, q as (select nd.doc_id, nd.lb, nd.rb, least(c.rank, e.rank) as i, greatest(c.rank, e.rank) as j from nd join sa a on a.doc_id = nd.doc_id and a.rank = nd.lb join sa b on b.doc_id = nd.doc_id and b.rank = nd.rb join sa c on c.doc_id = nd.doc_id and c.pos = a.pos + 1 join sa e on e.doc_id = nd.doc_id and e.pos = b.pos + 1 where nd.depth > 0 and nd.lb < nd.rb) select q.doc_id, q.lb, q.rb, arg_min(x.lb, x.rb - x.lb) as slb, arg_min(x.rb, x.rb - x.lb) as srb from q join nd x on x.doc_id = q.doc_id and x.lb <= i and x.rb >= j group by 1, 2, 3")
def v21_suffix_links(spark, d):
    nodes, lcps = name_tree(spark, d)
    return trees.suffix_links(nodes, name_suffixes(spark, d), lcps)


@query(f"{WITH_TREE} select nd.doc_id, nd.lb, nd.rb, hex(b.t[b.pos + 1 : b.pos + 1]) as ch, min(b.rank) as wlb, max(b.rank) as wrb from nd join sa a on a.doc_id = nd.doc_id and a.rank between nd.lb and nd.rb join sa b on b.doc_id = a.doc_id and b.pos = a.pos - 1 where nd.depth > 0 group by 1, 2, 3, 4")
def v21_weiner_links(spark, d):
    c, s = names(spark, d), settled(name_suffixes(spark, d))
    return hexed(trees.weiner_links(name_tree(spark, d)[0], settled(succinct.bwt(c, s)), settled(succinct.with_tails(c, s))))


EVENTS = "e as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as i, value as v from events where value is not null)"


@query(f"with {EVENTS}, near as (select user_id, i, v, coalesce((select max(b.i) from e b where b.user_id = a.user_id and b.i < a.i and b.v < a.v), -1) as psv, coalesce((select min(b.i) from e b where b.user_id = a.user_id and b.i > a.i and b.v < a.v), (select max(i) + 1 from e b where b.user_id = a.user_id)) as stop from e a), f as (select *, case when row_number() over (partition by user_id, psv, v, stop order by i) = 1 then 1 else 0 end as first from near), pr as (select user_id, i as spot, 1 as side, 0 as tie, 1 as bit, i, null::int as first from f union all select user_id, stop, 0, -i, 0, i, first from f) select user_id, row_number() over (partition by user_id order by spot, side, tie) - 1 as k, bit, i, first from pr")
def v25_cartesian_parentheses(spark, d):
    return trees.cartesian_parens(event_series(spark, d), "user_id")


@query(f"{WITH_SA}, {NAMES_P}, h as (select sa.doc_id, pattern, k, rank from sa, p, range(1, 10) r(k) where k <= strlen(pattern) and suf[1:k] = encode(pattern)[1:k]) select doc_id, pattern, k, min(rank) as lo, max(rank) as hi from h group by 1, 2, 3")
def v10_forward_search(spark, d):
    return named(succinct.forward_search(names(spark, d), name_suffixes(spark, d), src.patterns(spark, NAME_PATTERNS)), NAME_PATTERNS)


@query(f"{WITH_SA}, w as (select doc_id, rank, case when pos = 0 then '' else hex(t[pos:pos]) end as ch from sa) select doc_id, rank, ch, row_number() over (partition by doc_id, ch order by rank) - 1 as before from w")
def v15_rank_of_each_symbol(spark, d):
    return hexed(succinct.rank_select(succinct.bwt(names(spark, d), name_suffixes(spark, d))).drop("nth"))


@query(f"with {BITS}, f as (select *, lag(bit) over (partition by doc_id order by i) as was from e), h as (select doc_id, i, '0' as pattern from f where bit = 0 union all select doc_id, i, '10' from f where was = 1 and bit = 0 union all select doc_id, i, '01' from f where was = 0 and bit = 1) select doc_id, pattern, row_number() over (partition by doc_id, pattern order by i) as k, i from h")
def v16_select_patterns(spark, d):
    one = lambda p: succinct.bit_places(bits(spark, d), p).withColumn("pattern", F.lit(p))
    return one("0").unionByName(one("10")).unionByName(one("01"))


@query(f"with {BITS}, g as (select doc_id, i, case when i % 5 = 0 then 0 when i % 7 = 0 then 1 else bit end as bit from e) select doc_id, i, bit, max(case when bit = 1 then i end) over (partition by doc_id order by i) as prev1, min(case when bit = 1 then i end) over (partition by doc_id order by i rows between current row and unbounded following) as next1 from g")
def v17_dynamic_dictionary(spark, d):
    b = bits(spark, d)
    put, gone = b.filter("i % 7 = 0").select("doc_id", "i"), b.filter("i % 5 = 0").select("doc_id", "i")
    return succinct.bit_ranks(succinct.with_bits(b, put, gone)).select("doc_id", "i", "bit", "prev1", "next1")


@query(f"{WITH_SA} select a.doc_id, a.rank, a.pos, i.rank as isa, p.rank as psi, case when a.pos = 0 then '' else hex(a.t[a.pos:a.pos]) end as ch from sa a join sa i on i.doc_id = a.doc_id and i.pos = a.rank join sa p on p.doc_id = a.doc_id and p.pos = (a.pos + 1) % a.n")
def v20_compressed_array(spark, d):
    return hexed(succinct.compressed_array(names(spark, d), settled(name_suffixes(spark, d))))


@query("with b as (select p_partkey as doc_id, encode(reverse(p_name)) as t, strlen(p_name) as n from part where p_name is not null), " + f"{SA} select doc_id, rank, pos, hex(t) as reversed from sa")
def v20_reversed_text(spark, d):
    c = settled(succinct.reversed_text(names(spark, d)))
    return hexed(sx.suffix_array(c).join(c.select("doc_id", F.col("text").alias("reversed")), "doc_id"))


@query(f"with {EVENTS} select a.user_id, a.i, coalesce(c.v < a.v and b.v >= a.v, false) as holds from e a left join e b on b.user_id = a.user_id and b.i = a.i - 1 left join e c on c.user_id = a.user_id and c.i = a.i - 2")
def v28_verify_neighbours(spark, d):
    """Claims that the nearest smaller value before stands two in front."""
    e = settled(event_series(spark, d))
    return succinct.neighbours_hold(e, e.select("user_id", "i", (F.col("i") - 2).alias("psv")), "user_id")


@query("with b as (select p_partkey as doc_id, encode(p_name) as t, strlen(p_name) as n, encode(p_type) as o from part where p_name is not null and p_type is not null), x as (select doc_id, i as pos, coalesce((select max(k) from range(1, n - i + 1) q(k) where (select bool_or(o[j:j+k-1] = t[i+1:i+k]) from range(1, octet_length(o) + 1) z(j))), 0)::bigint as longest from b, range(n) r(i)) select doc_id, sum(longest)::bigint as total from x group by 1")
def v29_statistics_sums(spark, d):
    types = src.corpus(read(spark, d, "part").filter("p_name is not null"), F.col("p_partkey"), F.col("p_type"))
    other = src.corpus(read(spark, d, "part").filter("p_type is not null"), F.col("p_partkey"), F.col("p_name"))
    return succinct.statistics_sums(succinct.matching_statistics(types, other))


NAT = "b as (select n_nationkey as doc_id, encode(n_name) as t, strlen(n_name) as n from nation where n_name is not null)"


@query(f"with {NAT}, {SA}, {LCP} select doc_id, rank, pos, lcp from lc")
def src6_import_arrays(spark, d):
    """Suffix and LCP arrays written as files of 5-byte integers, read again in lock-step."""
    c = src.corpus(read(spark, d, "nation"), F.col("n_nationkey").cast("long"), F.col("n_name"))
    lcps, top = settled(sx.with_lcp(c, sx.suffix_array(c))), f"{shared_folder(spark)}/lexgrid/{uuid.uuid4().hex}"
    both = []
    for column in ("pos", "lcp"):
        files = settled(arrays.write_integers(lcps.select("doc_id", "rank", F.col(column).alias("value")), f"{top}/{column}", 5))
        both.append(arrays.read_integers(files, f"{top}/{column}", 5))
    return arrays.imported(*both)


@query(f"{WITH_SA}, {LCP} select doc_id, rank, pos, lcp from lc")
def j11_merge_arrays(spark, d):
    lcps = name_lcps(spark, d)
    return sx.merged(lcps.select("doc_id", "rank", "pos"), lcps.select("doc_id", "rank", "lcp"))


@query(f"with {B} select hex(t[pos + 1 : pos + 4]) as p, count(*) as n from (select t, (doc_id * 40503 + k * 2654435761 + 1) % (n - 3) as pos from b, range(3) r(k) where n >= 4) group by 1")
def s21_pattern_positions(spark, d):
    c = names(spark, d)
    return hexed(src.pattern_positions(c, src.random_positions(c, 4, 3).select("doc_id", "pos"), 4).groupBy("p").agg(F.count(F.lit(1)).alias("n")))


@query(f"{WITH_POINTS}, dir as (select doc_id, t[pos+1:pos+1] as ch, min(x) as lo from sm group by 1, 2) select pts.doc_id, hex(cx) as cx, hex(cy) as cy, x - lo as x, hex(y[2:]) as y, pos from pts join dir on dir.doc_id = pts.doc_id and dir.ch = pts.cx")
def f10_rebased_points(spark, d):
    c, s = names(spark, d), settled(name_samples(spark, d))
    return hexed(pt.rebased(pt.points(c, s, 2), pt.directory(s, c)))


@query(f"{WITH_SA}, {SAMPLES} select doc_id, x, pos // 2 as slot, (pos // 2) * 2 as pos from sm")
def f11_sample_slots(spark, d):
    x = name_samples(spark, d).withColumn("slot", F.expr("pos div 2"))
    return x.select("doc_id", "x", "slot", (F.col("slot") * 2).alias("pos"))


@query(f"{WITH_SA} select doc_id, rank, pos from sa where rank between 1 and 3")
def j9_interval_positions(spark, d):
    q = names(spark, d).select("doc_id", F.col("doc_id").alias("query_id"), F.lit(1).cast("long").alias("lo"), F.lit(3).cast("long").alias("hi"))
    return sx.interval_positions(name_suffixes(spark, d), q).withColumnRenamed("query_id", "doc_id")


@query(f"{WITH_SA}, {NAMES_P}, {HITS} select doc_id, pattern, max(rank) - min(rank) + 1 as size from hits group by 1, 2")
def a2_range_sizes(spark, d):
    r = search.suffix_range(name_suffixes(spark, d), names(spark, d), src.patterns(spark, NAME_PATTERNS)).filter("lo >= 0")
    return named(r.select("doc_id", "pattern_id", (F.col("hi") - F.col("lo") + 1).alias("size")), NAME_PATTERNS)


@query(f"{WITH_SA} select doc_id, rank, rank // 5 as block, rank % 5 as place from sa")
def w6_places_in_blocks(spark, d):
    return name_suffixes(spark, d).select("doc_id", "rank", F.expr("rank div 5").alias("block"), (F.col("rank") % 5).alias("place"))


@query(f"{WITH_SA}, {SAMPLES}, g as (select doc_id, x // 3 as page, count(*) as n from sm group by 1, 2) select doc_id, count(*) as pages, count(*) filter (n = 3) as full, sum(n)::bigint as rows from g group by 1")
def a15_page_statistics(spark, d):
    return page_statistics(name_samples(spark, d), 3)


def name_index(spark, d, ranks=True):
    path = f"{shared_folder(spark)}/lexgrid/{uuid.uuid4().hex}/index"
    build(names(spark, d), path, 2, 4, ranks=ranks)
    return Index(spark, path)


@query(f"{WITH_SA}, {SAMPLES} select 'corpus' as part, (select count(*) from b) as rows union all select 'points', (select count(*) from sm) union all select 'samples', (select count(*) from sm) union all select 'directory', (select count(*) from (select distinct doc_id, t[pos+1:pos+1] from sm))")
def snk13_build_statistics(spark, d):
    return name_index(spark, d).part("builds").select("part", "rows")


@query(f"{WITH_LCP}, g as (select *, coalesce(sum(case when pos % 2 = 0 then 1 else 0 end) over (partition by doc_id order by rank rows between unbounded preceding and 1 preceding), 0) as grp from lc), m as (select doc_id, grp, min(lcp) as least, max(case when pos % 2 = 0 then pos end) as pos from g group by doc_id, grp) select doc_id, grp::bigint as x, pos, case when grp = 0 then 0 else least end as lcp from m where pos is not null")
def b1_stored_samples(spark, d):
    return name_index(spark, d).part("samples")


@query(f"{WITH_SA}, {SAMPLES} select doc_id, hex(t[pos+1:pos+1]) as ch, min(x) as lo, max(x) as hi from sm group by 1, 2")
def src13_stored_directory(spark, d):
    return hexed(name_index(spark, d).part("directory"))


METRICS = f"""{WITH_SA}, {NAMES_P}, kp as (select t[pos+1:pos+1] as cx, case when pos > 0 then t[pos:pos] end as cy from s where pos % 2 = 0),
c as (select pattern, (select count(*) from kp where cx = encode(pattern)[1:1]) as one, (select count(*) from kp where cx = encode(pattern)[2:2] and cy = encode(pattern)[1:1]) as two from p where strlen(pattern) >= 2),
mt as (select pattern, (one > 0)::int + (two > 0)::int as cells, one + two as candidates, (select count(*) from sa where suf[1:strlen(pattern)] = encode(pattern)) as matches from c)"""


@query(f"{METRICS} select pattern, cells::bigint as cells, candidates, matches from mt")
def m1_query_metrics(spark, d):
    return named(name_index(spark, d, False).metrics(src.patterns(spark, NAME_PATTERNS)), NAME_PATTERNS)


@query(f"{METRICS} select count(*) as queries, sum(candidates)::bigint as candidates, round(avg(candidates), 6) as mean_candidates, max(candidates) as most_candidates, sum(matches)::bigint as matches from mt")
def a14_query_statistics(spark, d):
    x = name_index(spark, d, False).record(src.patterns(spark, NAME_PATTERNS))
    return x.agg(F.count(F.lit(1)).alias("queries"), F.sum("candidates").alias("candidates"), F.round(F.avg("candidates"), 6).alias("mean_candidates"), F.max("candidates").alias("most_candidates"), F.sum("matches").alias("matches"))


@query("with recursive p(pattern) as (values ('the '), ('ation of the '), ('zzzzqqqqzzzz'), (' the '), ('e')), f as (select pattern, item_id, text as rest, 0::bigint as off, instr(text, pattern) as spot from benchmark, p where contains(text, pattern) union all select pattern, item_id, substr(rest, spot + 1), off + strlen(substr(rest, 1, spot)), instr(substr(rest, spot + 1), pattern) from f where spot > 0) select pattern, item_id as doc_id, off + strlen(substr(rest, 1, spot - 1)) as pos from f where spot > 0")
def src11_pruned_index(spark, d):
    """Patterns longer than the index's keys and shorter than its step among those asked."""
    asked, path = ["the ", "ation of the ", "zzzzqqqqzzzz", " the ", "e"], f"{shared_folder(spark)}/lexgrid/{uuid.uuid4().hex}/index"
    build(src.corpus(read(spark, d, "benchmark"), F.col("item_id"), F.col("text")), path, 3, 4)
    return named(Index(spark, path).locate(src.patterns(spark, asked)).drop("k"), asked)


@query("select l_partkey as x, l_suppkey as y, l_orderkey * 10 + l_linenumber as id from lineitem order by 1, 2, 3 limit 1 offset 1234")
def o3_kth_point_by_x(spark, d):
    return selection.kth_point(line_points(spark, d), 1234, 1)


@query("select l_partkey as x, l_suppkey as y, l_orderkey * 10 + l_linenumber as id from lineitem order by 2, 1, 3 limit 1 offset 1234")
def o3_kth_point_by_y(spark, d):
    return selection.kth_point(line_points(spark, d), 1234, 2)


def line_points(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("x"), F.col("l_suppkey").cast("long").alias("y"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"))


@query("select o_custkey, o_orderkey from orders order by 1, 2 limit 1 offset 777")
def o5_kth_smallest(spark, d):
    return selection.kth(read(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], 777)


@query("with q as (select median(v) as mid from (select arg_min(o_custkey, o_orderkey) as v from orders union all select arg_max(o_custkey, o_orderkey) from orders union all select max(o_custkey) // 2 from orders)) select o_orderkey, o_custkey, sign(o_custkey - mid)::int as side from orders, q")
def o6_three_way_split(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    pivot = o.agg(selection.median_of_three(F.min_by("o_custkey", "o_orderkey"), F.expr("max(o_custkey) div 2"), F.max_by("o_custkey", "o_orderkey")).alias("pivot")).first()[0]
    return selection.split(o, "o_custkey", F.lit(pivot))


@query(f"with {B} select doc_id, i as p, (i + 3) % n as q, case when i = (i + 3) % n then 0 when t[i+1:] < t[(i + 3) % n + 1:] then -1 else 1 end::int as side from b, range(n) r(i)")
def o7_compare_suffixes(spark, d):
    c = names(spark, d)
    x = sx.positions(c).join(c, "doc_id").withColumn("q", (F.col("pos") + 3) % F.col("n"))
    return x.select("doc_id", F.col("pos").alias("p"), "q", selection.compare_suffixes(F.col("text"), F.col("pos"), F.col("q"), F.col("n")).alias("side"))


NODE_BITS = "(ceil((np + nc) / 64) * 64 + ceil(np * 40 / 64) * 64 + (33 + 8) * 8 + 23 * 8)"


@query(f"with x as (select o_orderkey as k, o_custkey % 300 as np, o_custkey % 300 + 1 as nc, (1024 + o_orderkey % 4 * 1024) as page from orders) select k, {NODE_BITS} > page * 8 as over, (floor((page * 8 - (23 * 8 + 41 * 8) - 129) / 42) + 1)::bigint as children, (1 + (select count(*) from (select h, (1::bigint << (h - 1)) - 1 as np, 1::bigint << (h - 1) as nc from range(2, 41) r(h)) where {NODE_BITS} <= page * 8))::int as levels, 4096 + k * page as offs, (1::bigint << (case when k % 20 > 5 then case when (k % 20 - 5 + 1) % 4 = 0 then 4 else (k % 20 - 5 + 1) % 4 end else 4 end)::int) as root from x")
def s16_point_pages(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    page, np = F.lit(1024) + k % 4 * 1024, c % 300
    return read(spark, d, "orders").select(k.alias("k"), fn.overflows(np, np + 1, 40, page).alias("over"), fn.most_children(page, 40).alias("children"), fn.page_height(page, 40).alias("levels"), fn.page_offset(k, page, F.lit(4096)).alias("offs"), fn.root_leaves(k % 20, F.lit(5)).alias("root"))


def log_sql(x: str, base: int) -> str:
    """The largest k with base^k <= x, by trying."""
    return f"(select max(k) from range(-12, 60) q(k) where pow({base}::double, k) <= {x})"


@query(f"with x as (select o_orderkey as k, (o_orderkey + 1)::double as n from orders), y as (select k, n, {log_sql('n / 200', 8)} as half, 100 * pow(8::double, {log_sql('n / 100', 8)}) as power from x) select k, (case when power < n and n < 2 * power then half + 1 else half end)::bigint as level from y")
def s17_node_levels(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(k.alias("k"), fn.node_level((k + 1).cast("double"), 100, 8).alias("level"))


@query("with x as (select o_orderkey as k, (o_orderkey * 2654435761 + o_custkey) as w from orders) select k, bit_count(w)::int as ones, bit_count(w & (w << 1))::int as p11, bit_count(~w & (w << 1))::int as p10, bit_count(w & ~((w << 1) | 1))::int as p01, list_filter(range(64), lambda i: (w >> i) & 1 = 1)[1]::int as low, (length(bin(w)) - 1)::int as high, list_filter(range(64), lambda i: (w >> i) & 1 = 1)[3]::int as third, (w >> 3) & 31 as some, (w & ~(31::bigint << 3)) | ((k % 32) << 3) as put from x")
def l4_words(spark, d):
    k = F.col("o_orderkey").cast("long")
    w = k * 2654435761 + F.col("o_custkey")
    return read(spark, d, "orders").select(k.alias("k"), bt.ones(w).alias("ones"), bt.pairs_11(w).alias("p11"), bt.pairs_10(w).alias("p10"), bt.pairs_01(w).alias("p01"), bt.lowest(w).alias("low"), bt.highest(w).alias("high"), bt.place_of(w, F.lit(3)).alias("third"), bt.read_bits(w, 3, 5).alias("some"), bt.written_bits(w, 3, 5, k % 32).alias("put"))


@query("with x as (select vec_id, list_transform(embedding, lambda x: floor(x * 100)::bigint) as v from embeddings where embedding is not null and len(embedding) > 8 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0) select vec_id, array_to_string(list_transform(v, lambda x: x % 7), ',') as modulo, array_to_string(list_concat(list_concat(v[:2], [99]), v[4:]), ',') as put, array_to_string(v[:5], ',') as cut, len(v)::int as size, v[3] as third from x")
def l1_vectors(spark, d):
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    # in the entries' own type, as 0.18 of four bytes times 100 is 18 there, and under it in eight
    v = F.transform("embedding", lambda x: F.floor(x * F.lit(100.0).cast("float")).cast("long"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    rows = read(spark, d, "embeddings").filter((F.size("embedding") > 8) & ~bad).select("vec_id", v.alias("v"))
    return rows.select("vec_id", joined(bt.all_modulo(F.col("v"), 7)).alias("modulo"), joined(bt.with_entry(F.col("v"), F.lit(2), F.lit(99).cast("long"))).alias("put"), joined(bt.resized(F.col("v"), 5)).alias("cut"), F.size("v").alias("size"), F.get("v", F.lit(2)).alias("third"))


#: Parts of each side of pairs that have few keys, and tasks that make the pairs; Spark would take fewer, by the size of the sides.
SIDES, PAIR_TASKS = 4, 400
OPEN = "select o_orderkey as k, o_custkey % 50 as lx, o_custkey % 50 + o_orderkey % 9 as hx, o_orderkey % 40 as ly, o_orderkey % 40 + o_custkey % 7 as hy, o_orderkey % 2 = 0 as lx_in, o_orderkey % 3 = 0 as hx_in, o_custkey % 2 = 0 as ly_in, o_custkey % 3 = 0 as hy_in from orders"


@query(f"with r as ({OPEN}), x as (select a.k, greatest(a.lx, b.lx) as x1, least(a.hx, b.hx) as x2, greatest(a.ly, b.ly) as y1, least(a.hy, b.hy) as y2, a, b from r a join r b on a.lx = b.hx) select a.k as one, b.k as two, x1 <= x2 and y1 <= y2 and not (x1 = x2 and ((a.hx < b.hx and not (a.hx_in and b.lx_in)) or (b.hx < a.hx and not (b.hx_in and a.lx_in)))) and not (y1 = y2 and ((a.hy < b.hy and not (a.hy_in and b.ly_in)) or (b.hy < a.hy and not (b.hy_in and a.ly_in)))) as meet from x where a.k <> b.k")
def f4_open_rectangles(spark, d):
    """All pairs of rectangles of orders of which one begins at the x where the other ends. There are but some fifty such x, and pairs grow with the square of the orders: each side is dealt into SIDES parts, and each part meets each of the other's as a key of its own, so no task holds more than a part of those of an x."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = read(spark, d, "orders").select(k.alias("k"), (c % 50).alias("lx"), (c % 50 + k % 9).alias("hx"), (k % 40).alias("ly"), (k % 40 + c % 7).alias("hy"), (k % 2 == 0).alias("lx_in"), (k % 3 == 0).alias("hx_in"), (c % 2 == 0).alias("ly_in"), (c % 3 == 0).alias("hy_in"))
    part, every = F.pmod(F.xxhash64("k"), F.lit(SIDES)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SIDES - 1)))
    one = r.select([F.col(x).alias(f"a_{x}") for x in r.columns] + [part.alias("a_part"), every.alias("b_part")])
    two = r.select([F.col(x).alias(f"b_{x}") for x in r.columns] + [part.alias("b_part"), every.alias("a_part")])
    key = ["b_hx", "a_part", "b_part"]
    one, two = one.withColumn("b_hx", F.col("a_lx")).repartition(PAIR_TASKS, *key), two.repartition(PAIR_TASKS, *key)
    met = one.join(two.hint("merge"), key).filter("a_k <> b_k")
    return met.select(F.col("a_k").alias("one"), F.col("b_k").alias("two"), pt.intersect_open("a_", "b_").alias("meet"))


@query("select doc_id, hex(encode(text)[4001:4300]) as bytes, case when strlen(text) <= 4000 then 0 else (4000 + least(strlen(text) - 4000, 300) - 1) // 4096 - 4000 // 4096 + 1 end::bigint as pages from documents where text is not null")
def src2_byte_range(spark, d):
    """A range across a page's end, which many texts end before or in."""
    from lexgrid.plans.queries import documents

    at, n = F.lit(4000), F.lit(300)
    return hexed(documents(spark, d).select("doc_id", src.byte_range(F.col("text"), at, n).alias("bytes"), src.pages(F.col("n"), at, n, 4096).alias("pages")))


@query(f"{WITH_SA}, x as (select doc_id, rank, pos, lag(suf) over (partition by doc_id order by rank) < suf as up, n from sa) select doc_id, bool_and(coalesce(up, true)) as ordered, count(distinct pos) = any_value(n) and min(pos) = 0 and max(pos) = any_value(n) - 1 as permutation from x group by 1")
def v28_verify(spark, d):
    return sx.verified(names(spark, d), name_suffixes(spark, d))


@query(f"{WITH_SA}, {NAMES_P}, {HITS} select pattern, doc_id, pos from hits")
def j6_two_step_locate(spark, d):
    """Shorter patterns than a step among those asked."""
    c, s = names(spark, d), name_samples(spark, d)
    return named(search.locate_by_ranges(pt.points(c, s, 2), s, c, src.patterns(spark, NAME_PATTERNS), 2).drop("k"), NAME_PATTERNS)
