"""Personal data: patterns for protected entities, and terms that reveal them by co-occurrence. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.shared import as_row, of_row_with_text, written

#: Fixed values of the contract, in its order. Java's possessive quantifiers keep long texts from deep recursion and from quadratic time; what matches is the same: a match starts where a run of the first class starts, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
TERM = r"\p{L}{3,}"
#: A secret: letters and digits in one run, of at least so many bits: its length times the entropy of its characters.
SECRET, SECRET_BITS = r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+", 64
#: Matches are placed in blocks of so many, so that a text of n matches takes n * BLOCK steps and not n * n.
BLOCK = 128
FOUND = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: (start, end, value), in code points from 0. What stands between them, by split(), tells where they are."""

    lengths = lambda parts, at, n: F.aggregate(F.slice(parts, at + 1, n), F.lit(0), lambda acc, x: acc + F.length(x))
    none = F.array().cast(FOUND)

    def placed(m: Column) -> Column:
        def blocks(p: Column) -> Column:
            def add(acc: Column, i: Column) -> Column:
                s = acc["at"] + F.length(F.get(p, i))
                e = s + F.length(F.get(m, i))
                return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end"), F.get(m, i).alias("value")))).alias("out"))

            def block(sums: Column, k: Column) -> Column:
                start = F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda acc, x: acc + x)
                return F.aggregate(F.sequence(k * BLOCK, F.least(k * BLOCK + BLOCK, F.size(m)) - 1), F.struct(start.alias("at"), none.alias("out")), add, lambda acc: acc["out"])

            each = F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int"))
            return let(F.transform(each, lambda k: lengths(p, k * BLOCK, BLOCK) + lengths(m, k * BLOCK, BLOCK)), lambda sums: F.flatten(F.transform(each, lambda k: block(sums, k))))

        return F.when(F.size(m) > 0, let(F.split(text, pattern, -1), blocks)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        v = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((F.length(digits) - i) % 2 == 1, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """Protected entities of a text: (kind, start, end, value), by kind as listed, then start. Matches that fail their kind's test are dropped."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    card = lambda v: F.when(F.length(digits(v)).between(13, 19), luhn(digits(v))).otherwise(False)
    tests = {"email": None, "ip": lambda v: F.rlike(v, F.lit(PARTS)), "card": card, "phone": lambda v: F.length(digits(v)).between(9, 15)}
    def of_kind(number: int, kind: str, pattern: str) -> Column:
        got = matches(text, pattern)
        if tests[kind]:
            got = F.filter(got, lambda s: tests[kind](s["value"]))
        return F.transform(got, lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    out = [of_kind(k, *x) for k, x in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))]
    return F.concat(*out)


def bits_of(value: Column) -> Column:
    """Length times entropy of the characters, in bits."""
    n = lambda chars: F.size(chars).cast("double")
    count = lambda chars, c: F.size(F.filter(chars, lambda x: x == c)).cast("double")
    told = lambda chars: F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + let(count(chars, c), lambda k: k * F.log2(n(chars) / k)))
    return let(F.split(value, "", -1), told)


def secret_spans(text: Column, base: Column) -> Column:
    """Secrets of a text (start, end, value) that no base span overlaps."""
    mixed = lambda v: F.rlike(v, F.lit("[A-Za-z]")) & F.rlike(v, F.lit("[0-9]"))
    return F.filter(matches(text, SECRET), lambda s: mixed(s["value"]) & (bits_of(s["value"]) >= SECRET_BITS) & free_of(s, base))


def free_of(span: Column, others: Column) -> Column:
    return ~F.exists(others, lambda s: (s["start"] < span["end"]) & (span["start"] < s["end"]))


def located(docs: DataFrame, text: str, generalise: float, evidence: float) -> DataFrame:
    """(row, text_key, base, secrets, terms) of each row; see find_personal."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.md5(t.cast("binary"))
    words = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all("t", F.lit(TERM), F.lit(0))), F.lower))
    rows = docs.select(t.alias("t")).select(F.md5(F.col("t").cast("binary")).alias("text_key"), base_spans(F.col("t")).alias("base"), "t", words.alias("words"))
    rows = rows.select("text_key", "base", secret_spans(F.col("t"), F.col("base")).alias("secrets"), "words")
    rows = written(rows.select("text_key", "words", F.when((F.size("base") > 0) | (F.size("secrets") > 0), F.struct("base", "secrets")).alias("spans")), "spans")
    n = rows.count()
    kind = lambda k: F.concat(k.cast("string"), F.lit(":"))
    values = F.transform("spans.base", lambda s: F.concat(kind(s["kind"]), F.lower(s["value"])))
    secrets = F.transform("spans.secrets", lambda s: F.concat(kind(F.lit(len(KINDS))), s["value"]))
    entity = F.array_distinct(F.concat(values, secrets, F.transform("spans.base", lambda s: kind(s["kind"])), F.transform("spans.secrets", lambda s: kind(F.lit(len(KINDS))))))
    # copies of a text are one text here: held once, with their number
    held = written(rows.filter("spans is not null").groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct("words", "spans")).alias("x")).select("text_key", "copies", "x.words", "x.spans"), "held")
    each = written(held.select("text_key", "copies", F.explode(entity).alias("entity")), "entities")
    entities = each.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count(F.lit(1)).alias("texts")).filter("texts > 1").drop("texts")
    asked = each.join(entities, "entity").groupBy("text_key").agg(F.collect_list("entity").alias("entities"))
    pairs = held.join(asked, "text_key").select("copies", "entities", F.explode("words").alias("term")).select("copies", F.explode("entities").alias("entity"), "term")
    pairs = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    terms = written(rows.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")), "terms")
    needed = math.log2(max(1, terms.count())) + evidence
    share = F.col("n_entity") / F.lit(float(n))
    content = -F.log2(share)
    told = F.log2((F.col("n_both") + share) / (F.col("n_term") + 1) / share)
    flagged = pairs.join(entities, "entity").join(terms, "term").filter(content > 0).filter(told >= generalise * content).filter((F.col("texts") - 1) * told >= needed)
    flagged = written(flagged.groupBy("term").agg(F.max(told / content).alias("disclosure")), "flagged")
    asked = rows.select("text_key", F.explode("words").alias("term")).join(flagged, "term").groupBy("text_key").agg(F.map_from_entries(F.collect_set(F.struct("term", "disclosure"))).alias("told"))
    # one row for each text with anything to report; each copy meets it, and Spark splits the partition of a text of very many copies
    texts = held.select("text_key", "spans").join(asked, "text_key", "full_outer").select(F.col("text_key").alias("key"), "spans", "told")
    met = as_row(docs, text_key=key).join(written(texts, "texts"), F.col("text_key") == F.col("key"), "left")
    base = F.coalesce("spans.base", F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>"))
    secret = F.coalesce("spans.secrets", F.array().cast(FOUND))
    places = F.transform(matches(F.col(f"row.`{text}`"), TERM), lambda s: let(F.lower(s["value"]), lambda v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value"), F.try_element_at("told", v).alias("disclosure"))))
    hits = F.filter(places, lambda h: h["disclosure"].isNotNull() & free_of(h, base) & free_of(h, secret))
    none = F.array().cast("array<struct<start:int,end:int,value:string,disclosure:double>>")
    return met.select("row", "text_key", base.alias("base"), secret.alias("secrets"), F.when(F.col("told").isNotNull(), hits).otherwise(none).alias("terms"))


def find_personal(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", generalise: float = 0.75, evidence: float = 7.0) -> DataFrame:
    """(doc_id, text_key, base, secrets, terms) for each row. base: protected entities (kind, start, end, value); secrets: (start, end, value), protected too; terms: (start, end, value, disclosure) that reveal one. text_key is a hash of the text.

    An entity is a kind (email, IP, card, phone number, secret), or a value of one that stands in two different texts or more. A term is a whole run of three letters or more, in lower case. A term of some of the documents of an entity e, however far from it, tells PMI(e; t) = log2(p(e | t) / p(e)) about it, of the IC(e) = -log2 p(e) that the entity holds; p are shares of all documents, and p(e | t) is smoothed by one document more that has t and, at e's share, e. The first text proposes a pair; each further different text that holds both confirms it by PMI bits, of which it needs log2(number of terms) + `evidence`: so chance leaves less than 2^-evidence pairs of an entity. A single text and its copies confirm nothing.
    Where PMI / IC reaches `generalise` so confirmed, every occurrence of the term in every document is reported, with the largest such ratio as disclosure.
    Occurrences that overlap entities aren't reported. Null text is empty and has no spans. Copies and repeated rows have the same spans. An empty table gives an empty one. Texts of any length are searched whole. Other columns are not read. Entities and distinct terms of each text are found once and written to the shared folder. The pairs are pre-aggregated before they are shuffled. Only texts that hold a reported term are searched for its places.
    """
    found = located(docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), text, generalise, evidence)
    return found.select(F.col(f"row.`{doc_id}`").alias("doc_id"), "text_key", "base", "secrets", "terms")


def sanitise(docs: DataFrame, *, text: str = "text", generalise: float = 0.75, remove: float = 0.9, evidence: float = 7.0) -> DataFrame:
    """docs' columns with `text` sanitised (and n_chars to match, where it exists): entities become [EMAIL], [IP], [CARD], [PHONE] or [SECRET]; terms of a disclosure of `remove` or more [TERM], others their first letter and a star for each letter more.

    Where spans overlap, the one that starts first stands and the others add nothing but their length. Null text stays null. Other columns are as they were, whatever their names. Empty tables, repeated rows and long texts are as in find_personal.
    """
    t = F.col(f"row.`{text}`")
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    span = lambda s, new: F.struct(s["start"].alias("start"), s["end"].alias("end"), new.alias("new"))
    star = lambda v: F.concat(F.substring(v, F.lit(1), F.lit(1)), F.repeat(F.lit("*"), F.length(v) - 1))
    spans = F.sort_array(F.concat(
        F.transform("base", lambda s: span(s, F.get(marks, s["kind"]))),
        F.transform("secrets", lambda s: span(s, F.lit("[SECRET]"))),
        F.transform("terms", lambda s: span(s, F.when(s["disclosure"] >= remove, F.lit("[TERM]")).otherwise(star(s["value"])))),
    ))

    def step(acc: Column, s: Column) -> Column:
        new = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), s["new"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out"))

    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    return located(docs, text, generalise, evidence).select(*of_row_with_text(docs, F.when(F.size(spans) > 0, clean).otherwise(t), text))
