"""The queries opN_<name>: each operator over its whole table, with the digest columns of its contract; and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm.shared import LOWER, UPPER, table, word_count, written

#: Fixed values of the contract: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, written to files and read back: null text is empty, rows of null id come first, repeated rows are written as often, an empty table gives an empty one."""
    from lexgrid.llm.token_output import read_tokens, write_tokens

    read = read_tokens(write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans, secrets and revealing terms of every document; null text is empty, copies have the same spans, an empty table gives an empty one."""
    from lexgrid.llm.privacy import KINDS, find_personal

    found = find_personal(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda kind, s: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("base", lambda s: told(F.get(names, s["kind"]), s))
    of_kind = lambda column, kind: F.transform(column, lambda s: told(F.lit(kind), s))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    sizes = [F.size(c).cast("long") for c in ("base", "secrets", "terms")]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, of_kind("secrets", "secret"), of_kind("terms", "term")), ",").alias("spans"), sizes[1].alias("n_secret"), sizes[2].alias("n_term"), (sizes[0] + sizes[1]).alias("n_entity"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every whole document by a model of the labels outside the held-out fold: null and empty texts have the score of no words, repeated rows are scored each, an empty table gives an empty one."""
    from lexgrid.llm.quality_model import HELD_OUT, THRESHOLD, fold, learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole document in sequences: null text is one token, repeated rows are packed each, an empty table gives an empty one."""
    from lexgrid.llm.packing import pack, pieces

    return pack(pieces(table(spark, sf_dir, "documents")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every URL: null or without :// has empty host and path and the default verdict, repeated rows are judged each, an empty table gives an empty one."""
    from lexgrid.llm.url_filter import filter_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


OP5_SQL = f"""
with cut as (select page_id, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages),
hosts as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from cut),
parts as (select page_id, translate(raw, '{UPPER}', '{LOWER}') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from hosts),
rules(rule, rule_host, rule_path, verdict) as (values {", ".join(f"('{h + p}', '{h}', '{p}', '{v}')" for v, h, p in URL_RULES)}),
fits as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from parts, rules
  where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id)
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict from parts p left join fits f using (page_id)
"""


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document: null text has none, null source is the last one, rows that agree in id, source and size count as copies, an empty table gives an empty one."""
    from lexgrid.llm.mixing import mix

    sizes = written(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mix(sizes, size=F.col("size")).select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


OP6_SQL = r"""
with docs as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(concat_ws('|', 'mix', doc_id::varchar)) as k from documents),
src as (select source, sum(size)::bigint as source_size from docs group by source),
weighed as (select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as weight,
    2.0::double * source_size as top, 1.5::double * sum(source_size) over () as total from src),
ratios as (select *, top / weight as ratio from weighed),
levels as (select *, row_number() over w as n,
    (total - coalesce(sum(top) over (order by ratio, source asc nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by ratio, source asc nulls last rows between current row and unbounded following) as level
    from ratios window w as (order by ratio, source asc nulls last)),
water as (select arg_min(level, n) as water from levels where ratio >= level),
goals as (select source, source_size, coalesce(least(weight * water, top), top) as target from levels, water),
budgets as (select *, floor(target + 0.5)::bigint as budget, case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 0 end as epochs from goals),
placed as (select d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size as rest,
    coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as start
    from docs d join budgets b on d.source is not distinct from b.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - start)))::bigint as taken from placed
"""

def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every whole document: null and empty texts have no words and fail, repeated rows are judged each, an empty table gives an empty one."""
    from lexgrid.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality.*")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every whole document: null and empty texts link with nothing, repeated rows are one class, an empty table gives an empty one."""
    from lexgrid.llm.ngram_join import join_ngrams

    return join_ngrams(table(spark, sf_dir, "documents"), width=3, outer=90, inner=100).select("doc_id", "n_shingles", "component_id")


#: Words of a text in lower case, and its distinct shingles of three; fewer words make one of all.
OP8_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as s from w),
sized as (select doc_id, s, len(s)::bigint as n, hash(list_sort(s)) as h from sh),
classes as (select h, min(doc_id) as doc_id, any_value(s) as s, any_value(n) as n from sized where n > 0 group by h),
e as (select h, n, unnest(s) as x from classes),
rare as (select x from e group by x having count(*) > 1),
pairs as (select a.h as a, b.h as b from e a join e b on a.x = b.x and a.h < b.h and 10 * a.n >= 9 * b.n and 10 * b.n >= 9 * a.n join rare on rare.x = a.x group by a.h, b.h, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links as (select a, b from pairs union select b, a from pairs),
reach(h, r) as (select h, h from classes union select reach.h, links.b from reach join links on reach.r = links.a),
parts as (select reach.h, min(c.doc_id) as component_id from reach join classes c on c.h = reach.r group by reach.h)
select doc_id, n as n_shingles, coalesce(component_id, doc_id) as component_id from sized left join parts on n > 0 and parts.h = sized.h
"""


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten of every query vector: null, empty and non-finite vectors take no part, nor do null ids; ties go to the smaller id; an empty table gives an empty one."""
    from lexgrid.llm.exact_topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP9_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024.0::double * x::double)::bigint) as v from embeddings
    where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
    from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from pairs)
select * from ranked where rank <= 10
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from every whole document: null text is one empty line, rows of one id are one document, an empty table gives an empty one."""
    from lexgrid.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("line_total").alias("n_lines"), F.col("line_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Blanks as DuckDB SQL.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP10_SQL = f"""
with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n from documents),
keyed as (select *, translate(trim(line, {_BLANKS}), '{UPPER}', '{LOWER}') as k from lines),
holders as (select k, max(doc_id) as holder from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select doc_id, line, n, holder is not null and doc_id <> holder as gone from keyed left join holders using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone)::bigint as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by n) filter (not gone), '')) as kept_sha256 from marked group by doc_id
"""

QUERIES = {"op1_token_output": op1_token_output, "op2_private_terms": op2_private_terms, "op3_quality_model": op3_quality_model, "op4_best_fit_packing": op4_best_fit_packing, "op5_url_filter": op5_url_filter, "op6_mix_sources": op6_mix_sources, "op7_quality_rules": op7_quality_rules, "op8_ngram_join": op8_ngram_join, "op9_exact_topk": op9_exact_topk, "op10_line_dedup": op10_line_dedup}
SQL = {"op5_url_filter": OP5_SQL, "op6_mix_sources": OP6_SQL, "op8_ngram_join": OP8_SQL, "op9_exact_topk": OP9_SQL, "op10_line_dedup": OP10_SQL}
