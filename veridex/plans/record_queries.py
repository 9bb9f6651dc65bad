"""Queries of extraction, field cleaning and crawl dataflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions.fields import register
from ..functions.pages import member_profiles, page_fields, product_details, review_rows
from ..operators import crawl as C
from ..operators import graph as G
from ..session import table
from .registry import Registry

R = Registry()
_BASE = "http://shop.example"


@R.add("ascii_clean", "select doc_id, md5(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) as text_md5 from documents")
def ascii_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.ascii_only(F.col("text")).cast("binary")).alias("text_md5"))


@R.add("date_to_epoch", "select o_orderkey, cast(epoch(date_trunc('day', o_orderdate)) as bigint) as epoch from orders")
def date_to_epoch(spark, sf_dir):
    written = F.date_format("o_orderdate", "MMMM d, yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.epoch_seconds(written).alias("epoch"))


@R.add("date_to_epoch_bad", """select row_no, case when regexp_full_match(date, '(January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4}')
  then cast(epoch(try_strptime(date, '%B %d, %Y')) as bigint) end as epoch from reviews""")
def date_to_epoch_bad(spark, sf_dir):
    """One strict format over mixed notations: whatever is not 'Month d, yyyy' gives null."""
    strict = F.when(F.col("date").rlike(r"^(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}$"), F.col("date"))
    return table(spark, sf_dir, "reviews").select("row_no", X.epoch_seconds(strict).alias("epoch"))


@R.add("number_regex", "select p_partkey, nullif(regexp_extract(p_name, '[0-9]+(,[0-9]+)*'), '') as first_number, array_to_string(regexp_extract_all(p_brand || ' 1,234 of 56', '[0-9]+(?:,[0-9]+)*'), ';') as numbers from part")
def number_regex(spark, sf_dir):
    text = F.concat("p_brand", F.lit(" 1,234 of 56"))
    return table(spark, sf_dir, "part").select("p_partkey", X.first_match(F.col("p_name"), X.GROUPED_NUMBER, 0).alias("first_number"), F.array_join(F.regexp_extract_all(text, F.lit(f"({X.GROUPED_NUMBER})"), F.lit(1)), ";").alias("numbers"))


@R.add("all_numbers", "select p_partkey, cast(list_sum(list_transform(regexp_extract_all(p_brand || ' 1,234 of 56', '[0-9]+(?:,[0-9]+)*'), lambda x: cast(replace(x, ',', '') as bigint))) as bigint) as total from part")
def all_numbers(spark, sf_dir):
    numbers = X.all_numbers(F.concat("p_brand", F.lit(" 1,234 of 56")))
    return table(spark, sf_dir, "part").select("p_partkey", F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@R.add("star_regex", "select row_no, try_cast(nullif(regexp_extract(starRating || ' out of 5 stars', '([0-9]+(\\.[0-9]+)?)\\s+out\\s+of', 1), '') as double) as stars from reviews")
def star_regex(spark, sf_dir):
    return table(spark, sf_dir, "reviews").select("row_no", X.first_match(F.concat(F.col("starRating").cast("string"), F.lit(" out of 5 stars")), X.STARS).try_cast("double").alias("stars"))


@R.add("id_regex", """select row_no, nullif(regexp_extract(id, 'review/(\\w+)/', 1), '') as review_id, nullif(regexp_extract('/dp/' || productId || '/x', '(?:/gp/product/glance/|/gp/product/|/dp/)(\\w+)', 1), '') as product_id,
  nullif(regexp_extract('/pdp/profile/' || memberId, 'profile/(\\w+)', 1), '') as member_id from reviews""")
def id_regex(spark, sf_dir):
    r = table(spark, sf_dir, "reviews")
    product, member = F.concat(F.lit("/dp/"), "productId", F.lit("/x")), F.concat(F.lit("/pdp/profile/"), "memberId")
    return r.select("row_no", X.first_match(F.col("id"), X.REVIEW_ID).alias("review_id"), X.first_match(product, X.PRODUCT_URL_ID).alias("product_id"), X.first_match(member, X.MEMBER_URL_ID).alias("member_id"))


@R.add("rank_and_price_regex", """with t as (select id, '#' || salesRank || ' Free in ' || cat || ' (See Top 100)' as rank_text, 'List: $' || cast(cast(price as decimal(12,2)) as varchar) as price_text from products)
select distinct id, try_cast(nullif(regexp_extract(rank_text, '#([0-9]+(?:,[0-9]+)*)\\s+(?:\\w+\\s+)?in\\s+(\\w+(?:\\s+(?:\\w+|&))*)', 1), '') as int) as sales_rank,
  nullif(regexp_extract(rank_text, '#([0-9]+(?:,[0-9]+)*)\\s+(?:\\w+\\s+)?in\\s+(\\w+(?:\\s+(?:\\w+|&))*)', 2), '') as category,
  try_cast(nullif(regexp_extract(price_text, '\\$([0-9]+(?:,[0-9]+)*\\.[0-9][0-9])', 1), '') as double) as price from t""")
def rank_and_price_regex(spark, sf_dir):
    p = table(spark, sf_dir, "products")
    rank = F.concat(F.lit("#"), F.col("salesRank").cast("string"), F.lit(" Free in "), "cat", F.lit(" (See Top 100)"))
    price = F.concat(F.lit("List: $"), F.col("price").cast("decimal(12,2)").cast("string"))
    return p.select("id", X.grouped_int(X.first_match(rank, X.SALES_RANK, 1)).alias("sales_rank"), X.first_match(rank, X.SALES_RANK, 2).alias("category"), X.first_match(price, X.PRICE).try_cast("double").alias("price")).distinct()


@R.add("text_join_strip", "select doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^[\\s]+|[\\s]+$', '', 'g')), lambda x: x <> ''), ' ')) as text_md5 from documents")
def text_join_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.join_texts(F.split("text", r"\.")).cast("binary")).alias("text_md5"))


@R.add("member_fields", """select id, regexp_replace(fullname, '^\\s+|\\s+$', '', 'g') as fullname, nullif(regexp_replace(location, '^\\s+|\\s+$', '', 'g'), '') as location,
  array_to_string(list_transform(badges, lambda x: upper(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), ';') as badges, ranking, reviewStat as review_stat from members""")
def member_fields(spark, sf_dir):
    m = table(spark, sf_dir, "members")
    ranking = X.grouped_int(F.format_number("ranking", 0))
    return m.select("id", X.strip(F.col("fullname")).alias("fullname"), X.keep_value(X.strip(F.col("location"))).alias("location"), F.array_join(X.badges(F.col("badges")), ";").alias("badges"), ranking.alias("ranking"), F.col("reviewStat").alias("review_stat"))


@R.add("product_fields", """select id, name, price, avgStars as avg_stars, nReviews as n_reviews, salesRank as sales_rank, subCatRank as sub_cat_rank, regexp_replace(subCat, '^\\s+|\\s+$', '', 'g') as sub_cat,
  regexp_replace(manufact, '^\\s+|\\s+$', '', 'g') as manufact from products""")
def product_fields(spark, sf_dir):
    p = table(spark, sf_dir, "products")
    return p.select("id", F.get(F.array("name"), F.lit(0)).alias("name"), F.col("price").cast("string").try_cast("double").alias("price"), F.col("avgStars").alias("avg_stars"), X.grouped_int(F.format_number("nReviews", 0)).alias("n_reviews"), F.col("salesRank").alias("sales_rank"), F.col("subCatRank").alias("sub_cat_rank"), X.strip(F.col("subCat")).alias("sub_cat"), X.strip(F.col("manufact")).alias("manufact"))


@R.add("review_fields", """select row_no, regexp_replace(title, '^\\s+|\\s+$', '', 'g') as title, coalesce(nComments, 0) as n_comments, coalesce(verifiedPurchase, false) as verified, coalesce(vine, false) as vine, len(helpful) > 0 as has_votes from reviews""")
def review_fields(spark, sf_dir):
    r = table(spark, sf_dir, "reviews")
    votes = F.when(F.col("helpful").isNotNull(), F.size("helpful") > 0)
    comments = X.only_element_or(F.array_compact(F.array("nComments")), F.lit(0))
    return r.select("row_no", X.strip(F.col("title")).alias("title"), comments.alias("n_comments"), F.coalesce("verifiedPurchase", F.lit(False)).alias("verified"), F.coalesce("vine", F.lit(False)).alias("vine"), votes.alias("has_votes"))


@R.add("extract_fallback", "select distinct id, coalesce(nullif(trim(subCat), ''), nullif(trim(cat), ''), nullif(trim(manufact), ''), 'none') as label from products")
def extract_fallback(spark, sf_dir):
    p = table(spark, sf_dir, "products")
    return p.select("id", F.coalesce(X.first_of(X.strip(F.col("subCat")), X.strip(F.col("cat")), X.strip(F.col("manufact"))), F.lit("none")).alias("label")).distinct()


@R.add("url_build", f"""select distinct Type as type, ID as id, '{_BASE}/' || case when Type = 'm' then 'member-reviews/' else 'product-reviews/' end || ID || '?page=2' as next_page,
  '{_BASE}/' || case when Type = 'm' then 'profile/' else 'dp/' end || ID as item_page from seeds""")
def url_build(spark, sf_dir):
    s = C.checked_seeds(table(spark, sf_dir, "seeds"), "Type", "ID")
    return s.select("type", "id", C.page_url(_BASE, F.col("type"), F.col("id"), F.lit(1) + 1).alias("next_page"), C.item_url(_BASE, F.col("type"), F.col("id")).alias("item_page"))


@R.add("url_resolve", f"""select s_suppkey, case s_suppkey % 4 when 0 then 'http://other.example/x' when 1 then '{_BASE}/dp/' || s_suppkey when 2 then 'http://cdn.example/i.png' else '{_BASE}/list/item' || s_suppkey end as url from supplier""")
def url_resolve(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    href = F.when(F.col("s_suppkey") % 4 == 0, "http://other.example/x").when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("/dp/"), k)).when(F.col("s_suppkey") % 4 == 2, "//cdn.example/i.png").otherwise(F.concat(F.lit("item"), k))
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.absolute_url(F.lit(f"{_BASE}/list/page.html?x=1"), href).alias("url"))


_PAGES = "(select p_partkey, case when p_partkey % 3 = 0 then '<html><title>t</title><h1> ' || p_name || ' </h1>' else '<html><title>' || p_name || '</title>' end || '<a href=\"/dp/' || p_partkey || '\">x</a><br><a href=\"/profile/A' || p_size || '\">y</a><img src=1>' as html from part)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small pages built from parts, not well-formed XML."""
    p = table(spark, sf_dir, "part")
    head = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("<html><title>t</title><h1> "), "p_name", F.lit(" </h1>"))).otherwise(F.concat(F.lit("<html><title>"), "p_name", F.lit("</title>")))
    return p.select("p_partkey", F.concat(head, F.lit('<a href="/dp/'), F.col("p_partkey").cast("string"), F.lit('">x</a><br><a href="/profile/A'), F.col("p_size").cast("string"), F.lit('">y</a><img src=1>')).alias("html"))


@R.add("page_title_links", f"""select p_partkey, trim(coalesce(nullif(regexp_extract(html, '<h1>([^<]*)', 1), ''), regexp_extract(html, '<title>([^<]*)', 1))) as title,
  unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as href from {_PAGES}""")
def page_title_links(spark, sf_dir):
    html = F.col("html")
    title = F.trim(X.first_of(X.first_match(html, "<h1>([^<]*)"), X.first_match(html, "<title>([^<]*)")))
    return _pages(spark, sf_dir).select("p_partkey", title.alias("title"), F.explode(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))


@R.add("page_struct_html", f"""select cast(p_partkey as varchar) as key, trim(coalesce(nullif(regexp_extract(html, '<h1>([^<]*)', 1), ''), regexp_extract(html, '<title>([^<]*)', 1))) as title, 2::int as links, 1::int as images from {_PAGES}""")
def page_struct_html(spark, sf_dir):
    return page_fields(_pages(spark, sf_dir), "p_partkey", "html").drop("text_length")


@R.add("page_review_rows", """with t as (select s_suppkey, s_suppkey % 5 + 1 as stars from supplier) select cast(s_suppkey as varchar) as key, 0::int as pos, cast(stars as double) as stars, 'Review ' || s_suppkey as text, (s_suppkey % 3)::int as n_comments, 1200::int as helpful_yes from t
union all select cast(s_suppkey as varchar), 2, 1.5, 'Last', 0, null from t""")
def page_review_rows(spark, sf_dir):
    """Review blocks of pages: head and body paired by position, a block without stars skipped."""
    k = F.col("s_suppkey").cast("string")
    comments = F.concat(F.lit('<span class="comments">'), (F.col("s_suppkey") % 3).cast("string"), F.lit(" comments</span>"))
    head = F.concat(F.lit('<div class="review-head">'), (F.col("s_suppkey") % 5 + 1).cast("string"), F.lit(' out of 5</div><div class="review-body">Review '), k, F.lit('</div><span class="votes">1,200 of 1,300</span>'), comments)
    html = F.concat(head, F.lit('<div class="review-head">no stars</div><div class="review-body">skipped</div><div class="review-head">1.5 out of 5</div><div class="review-body">Last<br></div>'))
    rows = review_rows(table(spark, sf_dir, "supplier").select("s_suppkey", html.alias("html")), "s_suppkey", "html")
    return rows.select("key", "pos", "stars", "text", "n_comments", F.get("helpful", F.lit(0)).alias("helpful_yes"))


@R.add("page_unavailable", "select id from (select distinct id, coalesce(name, '') as name from products) where not contains(name, 'Dusty')")
def page_unavailable(spark, sf_dir):
    """Pages that hold the mark of an unavailable one are dropped."""
    return table(spark, sf_dir, "products").select("id", F.coalesce("name", F.lit("")).alias("name")).distinct().where(~F.col("name").contains("Dusty")).select("id")


@R.add("same_cat_first_k", "select p_type, p_partkey from (select p_type, p_partkey, row_number() over (partition by p_type order by p_partkey) as r from part) where r <= 6")
def same_cat_first_k(spark, sf_dir):
    return C.first_related(table(spark, sf_dir, "part").select("p_type", "p_partkey"), "p_type", "p_partkey")


@R.add("pagination_pages", """with n as (select o_custkey, count(*) as n from orders group by o_custkey) select o_custkey, n, unnest(range(1, cast(greatest(1, least(30, ceil(n / 10))) as bigint) + 1))::int as page from n""")
def pagination_pages(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return C.pages_of(n, F.col("n"))


_LINKS = """links as (select distinct 'm' as src_type, 'm' || o_custkey as src, 'p' as dst_type, 'p' || l_partkey as dst from lineitem join orders on l_orderkey = o_orderkey
  union select distinct 'p', 'p' || l_partkey, 'm', 'm' || o_custkey from lineitem join orders on l_orderkey = o_orderkey)"""


def _links(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("m"), "o_custkey").alias("m"))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("p"), "l_partkey").alias("p"))  # noqa: E741
    e = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("m", "p").distinct()
    one = e.select(F.lit("m").alias("src_type"), F.col("m").alias("src"), F.lit("p").alias("dst_type"), F.col("p").alias("dst"))
    return one.unionByName(e.select(F.lit("p").alias("src_type"), F.col("p").alias("src"), F.lit("m").alias("dst_type"), F.col("m").alias("dst")))


_FRONTIER = f"""with {_LINKS}, d0 as (select 'm' as type, 'm' || min(o_custkey) as id from orders),
d1 as (select distinct dst_type as type, dst as id from links join d0 on src = d0.id), d2 as (select distinct dst_type as type, dst as id from links join d1 on src = d1.id),
a as (select type, id, min(depth) as depth from (select *, 0::int as depth from d0 union all select *, 1 from d1 union all select *, 2 from d2) group by type, id)"""


@R.add("crawl_frontier", f"{_FRONTIER} select type, id, depth from a")
def crawl_frontier(spark, sf_dir):
    seed = table(spark, sf_dir, "orders").agg(F.concat(F.lit("m"), F.min("o_custkey")).alias("id")).withColumn("type", F.lit("m"))
    return C.frontier(_links(spark, sf_dir), seed)


@R.add("depth_histogram", f"{_FRONTIER} select depth, count(*) as requests from a group by depth")
def depth_histogram(spark, sf_dir):
    return C.depth_histogram(crawl_frontier(spark, sf_dir))


@R.add("max_page_filter", f"{_FRONTIER}, r as (select type, id, depth, unnest([1, 31, null])::int as page from a) select type, id, page, depth, -depth as priority from r where depth <= 2 and not (page is not null and depth >= 2) and (page is null or page <= 30)")
def max_page_filter(spark, sf_dir):
    requests = crawl_frontier(spark, sf_dir).withColumn("page", F.explode(F.array(F.lit(1), F.lit(31), F.lit(None).cast("int"))))
    return C.allowed_requests(requests).select("type", "id", "page", "depth", "priority")


@R.add("dedup_first", "select id, row_no from (select id, row_no, row_number() over (partition by id order by row_no) as r from reviews) where r = 1")
def dedup_first(spark, sf_dir):
    return C.first_items(table(spark, sf_dir, "reviews").select("id", "row_no"), ["id"], ["row_no"])


@R.add("seed_scan", "select distinct Type as type, ID as id from seeds")
def seed_scan(spark, sf_dir):
    return C.checked_seeds(table(spark, sf_dir, "seeds"), "Type", "ID")


# --- pages of three layouts, built from parts; what they hold is known ---


def _product_pages(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, layout = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    price = F.concat(F.lit("$"), F.format_number("p_retailprice", 2))
    stars = F.concat((F.col("p_size") % 5 + 1).cast("string"), F.lit(".5 out of 5 stars"))
    reviews = F.concat(F.lit('<a href="/product-reviews/'), k, F.lit('">'), F.format_number(F.col("p_partkey") * 7 + 1, 0), F.lit(" reviews</a>"))
    rank = F.concat(F.lit("<b>Best Sellers Rank:</b> #"), F.format_number(F.col("p_partkey") + 1, 0), F.lit(" in "), "p_type", F.lit(' (<a href="/best-sellers/'), k, F.lit('">See Top 100</a>)'))
    ladder = F.concat(F.lit('<ul><li class="zg_hrsr_item"><span class="zg_hrsr_rank">#'), F.col("p_size").cast("string"), F.lit('</span><span class="zg_hrsr_ladder">in <a href="/up">Up</a> &gt; <a href="/down/'), k, F.lit('">Down &amp; Out</a></span></li></ul>'))
    ladder = F.when(F.col("p_partkey") % 2 == 0, ladder).otherwise("")
    first = F.concat(F.lit('<body><div class="buying"><h1 class="parseasinTitle"><span id="btAsinTitle"> '), "p_name", F.lit(' </span></h1><a href="/maker/1">'), "p_brand", F.lit('</a></div><b id="x"><span id="actualPriceValue"><i>'), price, F.lit('</i></span></b><div id="centerCol"><div id="averageCustomerReviews"><span title="'), stars, F.lit('"></span>'), reviews, F.lit('</div></div><ul><li id="SalesRank">'), rank, ladder, F.lit("</li></ul>"))
    second = F.concat(F.lit('<body><div id="title_feature_div"><h1>'), "p_name", F.lit('</h1></div><div id="brandByline_feature_div"><a id="brand" href="/maker/2">'), "p_brand", F.lit('</a></div><div id="price"><span class="a-color-price a-size">'), price, F.lit('</span></div><form id="handleBuy"><span class="crAvgStars"><span title="'), stars, F.lit('"></span>'), reviews, F.lit('</span></form><div id="detailBullets"><span><b>Weight</b> 2</span><span>'), rank, ladder, F.lit("</span></div>"))
    third = F.concat(F.lit("<head><title>Shop: "), "p_name", F.lit(': Home</title></head><body><span class="contributorNameTrigger"><a href="/maker/3">'), "p_brand", F.lit('</a></span><table><tr id="SalesRank"><td>'), rank, ladder, F.lit("</td></tr></table>"))
    return p.select("p_partkey", F.when(layout == 0, first).when(layout == 1, second).otherwise(third).alias("html"))


_DETAILS = f"""select cast(p_partkey as varchar) as key, p_name as name, case when p_partkey % 3 < 2 then p_retailprice end as price, p_brand as maker, '/maker/' || (p_partkey % 3 + 1) as maker_href,
  case when p_partkey % 3 < 2 then p_size % 5 + 1.5::double end as avg_stars, case when p_partkey % 3 < 2 then (p_partkey * 7 + 1)::int end as n_reviews, (p_partkey + 1)::int as sales_rank, p_type as category,
  case when p_partkey % 2 = 0 then p_size end as sub_rank, case when p_partkey % 2 = 0 then 'Down & Out' end as sub_category, case when p_partkey % 2 = 0 then '/down/' else '/best-sellers/' end || p_partkey as category_href from part"""


@R.add("product_page_details", _DETAILS)
def product_page_details(spark, sf_dir):
    return product_details(_product_pages(spark, sf_dir), "p_partkey", "html")


@R.add("product_page_requests", f"""with d as ({_DETAILS}) select key, 'category' as kind, '{_BASE}' || category_href as url from d union all select key, 'maker', '{_BASE}' || maker_href from d
union all select key, 'reviews', '{_BASE}/product-reviews/' || key || '?page=1' from d""")
def product_page_requests(spark, sf_dir):
    """What the pages of products lead to."""
    return C.follow_ups(product_details(_product_pages(spark, sf_dir), "p_partkey", "html"), _BASE)


@R.add("member_page_profiles", """select cast(c_custkey as varchar) as key, c_name as fullname, case when c_custkey % 2 = 0 then 'REAL NAME;TOP 100' else '' end as badges, (c_custkey + 5000)::int as ranking, (c_custkey % 9)::int as votes, (c_custkey % 9 + 3)::int as voters,
  case when c_custkey % 3 > 0 then c_mktsegment || ', X' end as location, (case when c_custkey % 4 = 0 then 2 else c_custkey + 10 end)::int as review_stat from customer where c_custkey % 7 <> 6""")
def member_page_profiles(spark, sf_dir):
    """Profiles of members; those that are not available are left out."""
    k = F.col("c_custkey")
    n = lambda c: F.format_number(c, 0)
    badges = F.when(k % 2 == 0, '<div class="badges"><a><img alt="badge (REAL NAME)"></a><a><img alt="other"></a><a><img alt="x (TOP 100)"></a></div>').otherwise("")
    ranking = F.when(k % 2 == 0, F.concat(F.lit("Top Reviewer Ranking: "), n(k + 5000))).otherwise(F.concat(F.lit("Reviewer Ranking: <a>#"), n(k + 5000), F.lit("</a>")))
    votes = F.concat(F.lit(" Helpful Votes: "), (k % 9).cast("string"), F.lit(" of "), (k % 9 + 3).cast("string"))
    seen = F.when(k % 4 == 0, '<div class="stripeContent"><span><img alt="5 stars"></span><span><img alt="3 stars"></span></div>').otherwise(F.concat(F.lit('<div class="seeAll"><a>See all '), n(k + 10), F.lit(" reviews</a></div>")))
    place = F.when(k % 3 > 0, F.concat(F.lit("<b>Location:</b> "), "c_mktsegment", F.lit(", X"))).otherwise("<i>none</i>")
    page = F.concat(F.lit('<div id="profileHeader"><h1><b>'), "c_name", F.lit("</b></h1>"), badges, F.lit('</div><td id="pdpLeftColumn"><div class="personalDetails big">'), place, F.lit('</div></td><div id="reviewsStripe"><div class="stripeContent"><div>'), ranking, votes, F.lit("</div></div>"), seen, F.lit("</div>"))
    gone = F.lit('<b class="h1">Sorry, this customer\'s list of reviews is currently not available</b>')
    found = member_profiles(table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 7 == 6, gone).otherwise(page).alias("html")), "c_custkey", "html")
    return found.select("key", "fullname", F.array_join("badges", ";").alias("badges"), "ranking", F.get("helpful", F.lit(0)).alias("votes"), F.get("helpful", F.lit(1)).alias("voters"), "location", "review_stat")


@R.add("related_fallback", """with t as (select p_partkey, case when p_partkey % 2 = 0 then list_transform(range(0, p_size), lambda x: 'a' || x) when p_partkey % 3 = 0 then null else [] end as a, list_transform(range(0, p_size // 5), lambda x: 'b' || x) as b from part)
select p_partkey, unnest((case when len(a) > 0 then a else b end)[:6]) as link from t""")
def related_fallback(spark, sf_dir):
    """Links of the same maker: the second place to look where the first has none, and the first six."""
    numbered = lambda n, c: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.concat(F.lit(c), x.cast("string")))).otherwise(F.array().cast("array<string>"))
    first = F.when(F.col("p_partkey") % 2 == 0, numbered(F.col("p_size"), "a")).when(F.col("p_partkey") % 3 != 0, F.array().cast("array<string>"))
    second = numbered(F.floor(F.col("p_size") / 5).cast("int"), "b")
    return C.related_links(table(spark, sf_dir, "part"), first, second).select("p_partkey", "link")


@R.add("next_pages", """select o_orderkey, o_orderkey % 9 + 1 < case when o_orderkey % 4 = 0 then 1 else o_custkey % 12 end as product_more, o_orderkey % 3 = 0 as member_more from orders""")
def next_pages(spark, sf_dir):
    """Whether a page of reviews is followed by another, by the rule of product pages and by that of member pages."""
    o = F.col("o_orderkey")
    link = F.when(o % 4 != 0, F.concat(F.lit(" "), (F.col("o_custkey") % 12).cast("string"), F.lit(" "))).otherwise(F.when(o % 8 == 0, "none"))
    bar = F.when(o % 3 == 0, F.concat(F.lit("1 "), F.lit(" 2 | Next"))).when(o % 3 == 1, "1 2")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.more_product_pages(o % 9 + 1, link).alias("product_more"), C.more_member_pages(bar).alias("member_more"))


@R.add("max_page_by_type", "select Type as type, ID as id, p::int as page from (select distinct Type, ID from seeds), unnest([1, 5, 20, 31]) t(p) where p <= case when Type = 'm' then 5 else 30 end")
def max_page_by_type(spark, sf_dir):
    s = C.checked_seeds(table(spark, sf_dir, "seeds"), "Type", "ID")
    requests = s.withColumn("page", F.explode(F.array(*map(F.lit, (1, 5, 20, 31))))).withColumn("depth", F.lit(0))
    return C.allowed_requests(requests, max_pages={"m": 5, "p": 30}).select("type", "id", "page")


@R.add("registered_functions", "select distinct id, lower(cat) as cat, nullif(trim(subCat), '') as sub_cat from products")
def registered_functions(spark, sf_dir):
    """The scalar functions registered for SQL."""
    register(spark)
    table(spark, sf_dir, "products").createOrReplaceTempView("veridex_products")
    return spark.sql("select distinct id, lower_case(cat) as cat, keep_text(trim(subCat)) as sub_cat from veridex_products")


# --- crawled records to a graph in one call ---


def _graph(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return G.review_graph(t("reviews").drop("page_type", "site", "crawled_at"), t("members"), t("products"), ["row_no"])


_GRAPH = """with r as (select coalesce(memberId, id) as m, coalesce(productId, id) as p, * from reviews where coalesce(memberId, id) is not null and coalesce(productId, id) is not null),
e as (select m as member, p as product, arg_max(starRating, row_no) as star, arg_max(case when regexp_full_match(date, '(?i)(January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4}') then cast(epoch(try_strptime(date, '%B %d, %Y')) as bigint) end, row_no) as seconds,
  round(arg_max(case when len(helpful) >= 2 and helpful[2] <> 0 then helpful[1] / helpful[2] end, row_no), 8) as helpful_ratio, md5(arg_max(regexp_replace(reviewTxt, '[^\\x00-\\x7F]', '', 'g'), row_no)) as text_md5 from r group by all),
i as (select memberId as id, 'member' as kind from r where memberId is not null union select productId, 'product' from r where productId is not null union select id, 'member' from members union select id, 'product' from products)
"""


@R.add("crawl_graph_edges", _GRAPH + "select * from e")
def crawl_graph_edges(spark, sf_dir):
    e = _graph(spark, sf_dir).edges
    return e.select("member", "product", F.col("starRating").alias("star"), "seconds", F.round("helpful_ratio", 8).alias("helpful_ratio"), F.md5(F.col("reviewTxt").cast("binary")).alias("text_md5"))


@R.add("crawl_graph_ids", _GRAPH + "select * from i where id is not null")
def crawl_graph_ids(spark, sf_dir):
    return _graph(spark, sf_dir).ids


@R.add("crawl_graph_members", _GRAPH + """, d as (select member, count(*) as d from e group by member), a as (select id, max(fullname) as fullname, max(reviewStat) as s from members group by id)
select i.id, fullname, greatest(coalesce(s, 0), coalesce(d, 0))::bigint as review_stat from i left join a using (id) left join d on d.member = i.id where kind = 'member' and i.id is not null""")
def crawl_graph_members(spark, sf_dir):
    return _graph(spark, sf_dir).members.select("id", "fullname", F.col("reviewStat").alias("review_stat"))


@R.add("crawl_graph_products", _GRAPH + """, d as (select product, count(*) as d from e group by product), a as (select id, max(name) as name, max(price) as price, max(nReviews) as s from products group by id)
select i.id, name, price, greatest(coalesce(s, 0), coalesce(d, 0))::bigint as n_reviews from i left join a using (id) left join d on d.product = i.id where kind = 'product' and i.id is not null""")
def crawl_graph_products(spark, sf_dir):
    return _graph(spark, sf_dir).products.select("id", "name", "price", F.col("nReviews").alias("n_reviews"))
