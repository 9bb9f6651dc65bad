"""Queries of the training-data operators (problems 1, 3, 4, 6, 8, 9 and 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_review_id, nonblank
from ..plans.registry import Registry
from ..session import checkpoint, table
from .baskets import item_pairs
from .language import declared, identify
from .leakage import leaked_items
from .neardup import near_duplicate_records
from .packing import pack, token_counts
from .places import match_places
from .survivors import surviving_records
from .text import words

R = Registry()


@R.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "members").select("id", "location")
    return match_places(members, "id", "location", table(spark, sf_dir, "places")).select(F.col("id").alias("member_id"), "place_id").distinct()


@R.add("p1_unmatched")
def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The locations that match no town, with the number of members who typed them."""
    members = table(spark, sf_dir, "members").select("id", "location")
    return match_places(members, "id", "location", table(spark, sf_dir, "places")).where("place_id = 0").groupBy("location").agg(F.countDistinct("id").alias("members"))


_P3 = """
with r as (select distinct memberId as m, productId as p from reviews
  where regexp_matches(memberId, '[^[:space:]]') and regexp_matches(productId, '[^[:space:]]')),
n as (select count(distinct m) as n_all from r), c as (select p, count(*) as n from r group by p),
s as (select a.p as product_a, b.p as product_b, count(*) as shared from r a join r b on a.m = b.m and a.p < b.p group by all having count(*) >= 6),
f as (select s.*, ca.n as n_a, cb.n as n_b, n_all from s join c ca on ca.p = product_a join c cb on cb.p = product_b, n where shared * n_all >= 5 * ca.n * cb.n)
"""


def product_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = table(spark, sf_dir, "reviews").select("memberId", "productId")
    return item_pairs(reviews, "memberId", "productId", 6, 5.0)


@R.add("p3_found", _P3 + "select product_a, product_b from f")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_pairs(spark, sf_dir).select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"))


@R.add("p3_pair_scores", _P3 + """select product_a, product_b, shared, n_a, n_b, n_all, round(shared * n_all / (n_a * n_b), 6) as lift,
  round(greatest((1 - n_b / n_all) / nullif(1 - shared / n_a, 0), (1 - n_a / n_all) / nullif(1 - shared / n_b, 0)), 6) as conviction from f""")
def p3_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = product_pairs(spark, sf_dir).withColumnsRenamed({"item_a": "product_a", "item_b": "product_b"})
    return scored.withColumns({c: F.round(c, 6) for c in ("lift", "conviction")})


@R.add("p6_found", """
with r as (select nullif(upper(regexp_extract(id, '(?i)(^|[^a-z0-9])(r[a-z0-9]{10})($|[^a-z0-9])', 2)), '') as rid, * from reviews),
k as (select rid, memberId, page_type, crawled_at, row_no, helpful[1] as y, helpful[2] as t,
  case when regexp_matches(memberId, '[^[:space:]]') then memberId end as m,
  coalesce(len(helpful) = 2 and helpful[1] >= 0 and helpful[2] >= helpful[1], false) as good from r where rid is not null)
select rid as review_id,
  (array_agg(m order by (page_type = 'm') desc, crawled_at desc, row_no desc) filter (where m is not null and page_type in ('m', 'p')))[1] as member_id,
  (array_agg(y order by crawled_at desc, row_no desc) filter (where good))[1] as helpful_yes,
  (array_agg(t order by crawled_at desc, row_no desc) filter (where good))[1] as helpful_total
from k group by rid having count(*) >= 2""")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "reviews").select("row_no", "id", "memberId", "helpful", "page_type", "crawled_at")
    h = F.col("helpful")
    good = (F.size(h) == 2) & (F.get(h, F.lit(0)) >= 0) & (F.get(h, F.lit(1)) >= F.get(h, F.lit(0)))
    votes = F.when(good, F.struct(F.get(h, F.lit(0)).alias("yes"), F.get(h, F.lit(1)).alias("total")))
    member = F.when(F.col("page_type").isin("m", "p"), nonblank(F.col("memberId")))
    fields = {"member_id": (member, F.col("page_type") == "m"), "helpful": (votes, F.lit(0))}
    best = surviving_records(rows, clean_review_id(F.col("id")), fields, [F.col("crawled_at"), F.col("row_no")])
    return best.select(F.col("group").alias("review_id"), "member_id", F.col("helpful.yes").alias("helpful_yes"), F.col("helpful.total").alias("helpful_total"))


# exact: texts that agree share one of their rarest words (each word with its number in the text), as many as may be lost and one
_PLAIN = r"lower(replace(replace(regexp_replace({}, '<[/!a-zA-Z][^<>]*>|&#?\w{{1,8}};', ' ', 'g'), '''', ''), '’', ''))"
_APART = r"[^a-z0-9À-\x{1fff}\x{2c00}-\x{2fdf}\x{3040}-\x{ffdc}]+"
_P4 = rf"""
with t as (select nullif(upper(regexp_extract(id, '(?i)(^|[^a-z0-9])(r[a-z0-9]{{10}})($|[^a-z0-9])', 2)), '') as rid,
  list_filter(regexp_split_to_array({_PLAIN.format("concat_ws(' ', title, reviewTxt)")}, '{_APART}'), lambda x: x <> '') as w, len(list_filter(regexp_split_to_array({_PLAIN.format("coalesce(title, '')")}, '{_APART}'), lambda x: x <> '')) as o from reviews),
b as (select distinct rid, list_sort(w) as w from t where rid is not null and len(w) - o >= 30 and len(w) > 0),
g as (select w, row_number() over () as t from (select distinct w from b)), k as (select rid, t from b join g using (w)),
u as (select t, len(w) as n, unnest(w) as x from g), v as (select t, n, x || ' ' || row_number() over (partition by t, x) as x from u),
d as (select x, count(*) as df from v group by x), r as (select t, n, x, row_number() over (partition by t order by df, x) as r from v join d using (x)),
c as (select distinct a.t as a, e.t as e, a.n as n, e.n as m from r a join r e on a.x = e.x and a.t < e.t where a.r <= a.n - ceil(0.7 * a.n) + 1 and e.r <= e.n - ceil(0.7 * e.n) + 1 and least(a.n, e.n) >= 0.7 * greatest(a.n, e.n)),
h as (select c.a, c.e from c join v x on x.t = a join v y on y.t = e and x.x = y.x group by c.a, c.e having count(*) >= 0.7 * max(greatest(c.n, c.m))),
l as (select a, e from h union all select t, t from g)
select distinct least(x.rid, y.rid) as id_a, greatest(x.rid, y.rid) as id_b from l join k x on x.t = a join k y on y.t = e where x.rid <> y.rid"""


@R.add("p4_found", _P4)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = table(spark, sf_dir, "reviews").select("id", "title", "reviewTxt")
    both = words(F.concat_ws(" ", "title", "reviewTxt"))
    pairs = near_duplicate_records(reviews, clean_review_id(F.col("id")), both, words(F.col("title")), ["title", "reviewTxt"], 30, 0.7)
    return pairs.select(F.col("key_a").alias("id_a"), F.col("key_b").alias("id_b"))


@R.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "text")
    return leaked_items(docs, "doc_id", "text", items, "item_id", "text").select("doc_id", "item_id")


@R.add("p9_leaked_items")
def p9_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation item with the number of documents it leaked into, and the most words of it found in one."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "task", "text")
    leaks = leaked_items(docs, "doc_id", "text", items, "item_id", "text").groupBy("item_id").agg(F.count("*").alias("documents"), F.max("matched").alias("most_words"))
    return items.select("item_id", "task").join(leaks, "item_id", "left").select("item_id", "task", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_words", F.lit(0)).alias("most_words"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "kind")
    return identify(docs, "doc_id", "text", "lang", "source", "kind")


@R.add("p10_passages")
def p10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of every document with its language and confidence."""
    return passages(spark, sf_dir)


@R.add("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checkpoint(passages(spark, sf_dir).groupBy("doc_id", "lang").agg(F.sum("n_words").alias("n")))
    labels = table(spark, sf_dir, "documents").where(F.size(words(F.col("text"))) >= 8).select("doc_id", declared(F.col("lang")).alias("declared"))
    several = found.groupBy("doc_id").agg(F.count("*").alias("langs"))
    joined = found.join(labels, "doc_id").join(several, "doc_id")
    return joined.where((F.col("langs") > 1) | F.col("declared").isNull() | (F.col("declared") != F.col("lang"))).select("doc_id", "lang")


@R.add("p8_containers")
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (or part of one longer than a container) with its tokens and container of 2,048 tokens."""
    counts = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return pack(counts, "doc_id", "n_tokens", 2048).withColumnRenamed("size", "n_tokens")
