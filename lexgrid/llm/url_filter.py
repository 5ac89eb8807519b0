"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.shared import as_row, local, lower_az, of_row

#: Rules up to this many are broadcast (under 100 bytes each, so 10 MB); more are joined by a shuffle.
BROADCAST_RULES = 100_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first :// up to /, ?, # or the end, A-Z in lower case. Path: from there to ?, # or the end. Both are empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*+", 0)
    return lower_az(host), path


def expressions(host: Column, path: Column, most_labels: int, path_lengths: list[int]) -> Column:
    """Every host suffix at a label's start, of up to most_labels labels, followed by every prefix of the path that has one of path_lengths.

    Longer ones can't equal a rule, so a host of thousands of labels or a path of megabytes makes no more expressions than the rules have shapes.
    """
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    ends = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most_labels))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    heads = F.transform(F.filter(F.array(*[F.lit(x) for x in path_lengths]), lambda x: x <= F.length(path)), lambda x: path.substr(F.lit(1), x))
    return F.flatten(F.transform(ends, lambda e: F.transform(heads, lambda h: F.concat(e, h))))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, url: str = "url", default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """Judge each row's URL by rules (verdict, host, path): pages' columns, then url_host, url_path, url_rule, url_verdict.

    A rule fits its host and all subdomains if the URL's path starts with the rule's. Of the rules that fit, the longest wins (host and path together, then the longer host, then block). Without one the verdict is `default`.
    Only expressions whose first digits of SHA-256 equal a rule's meet that rule, and then all digits must agree. Matches are reduced to one for each distinct URL before the rows are joined, on the URL.
    Null URLs, URLs without :// and empty hosts fit no rule. Repeated rows stay, each judged. An empty table gives an empty one. Columns of pages that have the new names are dropped. No rules: all get `default`.
    """
    spark, new = pages.sparkSession, ("url_host", "url_path", "url_rule", "url_verdict")
    u, kept = F.col(f"row.`{url}`"), of_row(pages.columns, new)
    rows = as_row(pages)
    host, path = split_url(u)
    if not rules:
        return rows.select(*kept, host.alias("url_host"), path.alias("url_path"), F.lit(None).cast("string").alias("url_rule"), F.lit(default).alias("url_verdict"))
    shapes = sorted({len(p) for _, _, p in rules})
    made = F.explode(expressions(F.col("host"), F.col("path"), max(h.count(".") + 1 for _, h, _ in rules), shapes))
    digest = F.sha2(F.col("expression"), 256)
    asked = (
        rows.select(u.alias("u"), host.alias("host"), path.alias("path"))
        .filter("host <> ''")
        .select("u", made.alias("expression"))
        .select("u", digest.alias("digest"))
        .select("u", "digest", F.substring("digest", 1, prefix_digits).alias("prefix"))
    )
    known = local(spark, [(h + p, v, len(h)) for v, h, p in rules], "rule string, verdict string, host_length int").select("*", F.sha2("rule", 256).alias("rule_digest"))
    known = known.withColumn("prefix", F.substring("rule_digest", 1, prefix_digits))
    met = asked.join(F.broadcast(known) if len(rules) <= BROADCAST_RULES else known, "prefix").filter(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(F.length("rule").alias("n"), F.col("host_length"), (F.col("verdict") == "block").alias("b"), F.col("rule"), F.col("verdict"))
    best = met.groupBy("u").agg(F.max(rank).alias("best")).select("u", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    met = rows.join(best, u == F.col("u"), "left")
    return met.select(*kept, host.alias("url_host"), path.alias("url_path"), F.col("rule").alias("url_rule"), F.coalesce("verdict", F.lit(default)).alias("url_verdict"))
