"""Structured extraction from product, review and member pages, as table functions over batches of HTML."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fields import GROUPED_NUMBER, PRICE, SALES_RANK, STARS

# fixed values: where pages of each layout hold a value, the first that is there counts
NAME = ["span#btAsinTitle", "div#title_feature_div h1"]
PRICES = ["span#actualPriceValue", "div#price span.a-color-price", "div#priceBlock span.priceLarge"]
MAKER = ["div.buying h1.parseasinTitle", "div#brandByline_feature_div a#brand", "span.contributorNameTrigger a"]
RATINGS = ["div#centerCol div#averageCustomerReviews", "div.buying span.crAvgStars", "form#handleBuy span.crAvgStars"]
RANKS = ["li#SalesRank", "div#detailBullets span", "tr#SalesRank"]
RANK_TITLE = "Best Sellers Rank"
SUB_RANK = ["li.zg_hrsr_item", "span.zg_hrsr_rank", "span.zg_hrsr_ladder a"]
UNAVAILABLE = "list of reviews is currently not available"
PROFILE_NAME, PROFILE_BADGES, PROFILE_STRIPE, PROFILE_DETAILS = "div#profileHeader h1 b", "div#profileHeader div.badges img", "div#reviewsStripe", "td#pdpLeftColumn div.personalDetails"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Tree(HTMLParser):
    """Nodes of a page in document order as (depth, tag, attributes, [text pieces], parent)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.nodes.append([len(self.open), tag, {k: v or "" for k, v in attrs}, [], self.open[-1] if self.open else -1])
        if tag not in _VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[i]][1] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        for i in self.open:
            self.nodes[i][3].append(data)


def parse(html: str) -> list[list]:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.nodes


def select(nodes: list[list], tag: str, class_: str | None = None) -> list[str]:
    """The stripped texts of all elements of a tag (and class), in order."""
    return ["".join(n[3]).strip() for n in nodes if n[1] == tag and (class_ is None or class_ in n[2].get("class", "").split())]


def page_fields(df: DataFrame, key: str, html: str) -> DataFrame:
    """One row per page: title (the first heading, else the title element), number of links and images, and its text length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, page in zip(b["key"], b["html"], strict=True):
                nodes = parse(page)
                title = next(iter([t for t in select(nodes, "h1") if t] + [t for t in select(nodes, "title") if t]), None)
                out.append((k, title, sum(n[1] == "a" and "href" in n[2] for n in nodes), sum(n[1] == "img" for n in nodes), sum(len("".join(n[3])) for n in nodes if n[0] == 0)))
            yield pd.DataFrame(out, columns=["key", "title", "links", "images", "text_length"])

    return df.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html")).mapInPandas(run, "key string, title string, links int, images int, text_length int")


def review_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """One row per review block (a div of class review) of a page: blocks without stars are skipped, comments default to 0.

    Headers and bodies of member pages are separate lists, paired by position; a page's surplus of either is dropped.
    """
    stars, number = re.compile(STARS), re.compile(GROUPED_NUMBER)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, page in zip(b["key"], b["html"], strict=True):
                nodes = parse(page)
                heads, bodies = select(nodes, "div", "review-head"), select(nodes, "div", "review-body")
                votes, comments = select(nodes, "span", "votes"), select(nodes, "span", "comments")
                for i, (head, body) in enumerate(zip(heads, bodies)):
                    m = stars.search(head)
                    if m:
                        helpful = [int(x.replace(",", "")) for x in number.findall(votes[i])] if i < len(votes) else []
                        said = number.search(comments[i]) if i < len(comments) else None
                        out.append((k, i, float(m.group(1)), helpful, body, int(said.group().replace(",", "")) if said else 0))
            yield pd.DataFrame(out, columns=["key", "pos", "stars", "helpful", "text", "n_comments"])

    return df.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html")).mapInPandas(run, "key string, pos int, stars double, helpful array<int>, text string, n_comments int")


def css(nodes: list[list], path: str, root: int = -1) -> list[int]:
    """Places of the elements that a path of steps 'tag#id' or 'tag.class', each inside the one before, leads to below ``root``."""
    steps = [re.fullmatch(r"(\w+)(?:#([\w-]+))?(?:\.([\w-]+))?", s).groups() for s in path.split()]

    def fits(node: list, step: tuple) -> bool:
        tag, id_, class_ = step
        return node[1] == tag and (id_ is None or node[2].get("id") == id_) and (class_ is None or class_ in node[2].get("class", "").split())

    def above(i: int) -> Iterator[int]:
        while (i := nodes[i][4]) >= 0 and i != root:
            yield i

    out = []
    for i in range(root + 1, len(nodes)):
        if root >= 0 and nodes[i][0] <= nodes[root][0]:
            break
        if fits(nodes[i], steps[-1]):
            left = steps[:-1]
            for j in above(i):
                if left and fits(nodes[j], left[-1]):
                    left = left[:-1]
            if not left:
                out.append(i)
    return out


def _text(nodes: list[list], i: int) -> str:
    return " ".join("".join(nodes[i][3]).split())


def _first(pattern: str, texts: list[str], group: int = 1) -> str | None:
    return next((m.group(group) for t in texts if (m := re.search(pattern, t))), None)


def _number(text: str | None) -> int | None:
    return int(text.replace(",", "")) if text else None


def product_page(html: str) -> dict:
    """The values of a product's page: each from the first layout that holds it; absent ones are None."""
    nodes = parse(html)
    texts = lambda places: [_text(nodes, i) for i in places]
    layouts = lambda paths: next((found for p in paths if (found := css(nodes, p))), [])
    out = dict.fromkeys(("name", "price", "maker", "maker_href", "avg_stars", "n_reviews", "sales_rank", "category", "sub_rank", "sub_category", "category_href"))
    name = [t for t in texts(layouts(NAME)) if t]
    out["name"] = name[0] if name else _first(r"^(?:\w+:\s+)?([^:]+)", texts(css(nodes, "title")))
    price = next((x for p in PRICES if (x := _first(PRICE, texts(css(nodes, p))))), None)
    out["price"] = float(price.replace(",", "")) if price else None
    for path in MAKER:
        found = css(nodes, path)
        if found and nodes[found[0]][1] == "h1":  # the heading marks the box whose first link is meant
            found = css(nodes, "a", nodes[found[0]][4])
        if found:
            out["maker"], out["maker_href"] = _text(nodes, found[0]) or None, nodes[found[0]][2].get("href")
            break
    for i in layouts(RATINGS)[:1]:
        titles = [nodes[j][2].get("title", "") for j in css(nodes, "span", i)]
        stars = _first(STARS, [t for t in titles if "star" in t])
        out["avg_stars"] = float(stars) if stars else None
        out["n_reviews"] = _number(_first(f"({GROUPED_NUMBER})", texts(j for j in css(nodes, "a", i) if "product-reviews" in nodes[j][2].get("href", ""))))
    for path in RANKS:
        places = [i for i in css(nodes, path) if not path.endswith("span") or any(RANK_TITLE in t for t in texts(css(nodes, "b", i)))]
        if places:
            i = places[0]
            m = re.search(SALES_RANK, _text(nodes, i))
            out["sales_rank"], out["category"] = (_number(m.group(1)), m.group(2)) if m else (None, None)
            hrefs = [nodes[j][2].get("href", "") for j in css(nodes, "a", i) if "see top" in _text(nodes, j).lower()]
            out["category_href"] = next((h for h in hrefs if "/best-sellers" in h or "/bestsellers" in h), None)
            for j in css(nodes, SUB_RANK[0], i)[:1]:
                out["sub_rank"] = _number(_first(f"({GROUPED_NUMBER})", texts(css(nodes, SUB_RANK[1], j))))
                ladder = css(nodes, SUB_RANK[2], j)
                if ladder:
                    out["sub_category"], out["category_href"] = _text(nodes, ladder[-1]), nodes[ladder[-1]][2].get("href") or out["category_href"]
            break
    return out


def member_page(html: str) -> dict | None:
    """The values of a member's profile; None where the page says that it is not available."""
    nodes = parse(html)
    if any(UNAVAILABLE in _text(nodes, i) for i in css(nodes, "b.h1")):
        return None
    stripe = " ".join(_text(nodes, i) for i in css(nodes, PROFILE_STRIPE))
    details = " ".join(_text(nodes, i) for i in css(nodes, PROFILE_DETAILS))
    place = re.search(r"Location:?\s*(.+)", details)
    votes = re.search(r"Helpful Votes:?\s*(\d+)\D+(\d+)", stripe)
    count = _first(rf"See all\s+({GROUPED_NUMBER})", [stripe])
    stars = sum("stars" in nodes[i][2].get("alt", "") for i in css(nodes, PROFILE_STRIPE + " span img"))
    return {
        "fullname": next(iter(_text(nodes, i) for i in css(nodes, PROFILE_NAME)), None),
        "badges": [m.group(1) for i in css(nodes, PROFILE_BADGES) if (m := re.search(r"\((.+)\)", nodes[i][2].get("alt", "")))],
        # the ranking is a link of its own or part of the text
        "ranking": _number(_first(rf"Reviewer Ranking:?\s+#?({GROUPED_NUMBER})", [stripe])),
        "helpful": [int(votes.group(1)), int(votes.group(2))] if votes else None,
        "location": place.group(1).strip() if place else None,
        "review_stat": _number(count) if count else stars,
    }


PRODUCT_PAGE = "name string, price double, maker string, maker_href string, avg_stars double, n_reviews int, sales_rank int, category string, sub_rank int, sub_category string, category_href string"
MEMBER_PAGE = "fullname string, badges array<string>, ranking int, helpful array<int>, location string, review_stat int"


def _extracted(df: DataFrame, key: str, html: str, one, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *(r[c] for c in names)) for k, page in zip(b["key"], b["html"], strict=True) if (r := one(page)) is not None]
            frame = pd.DataFrame(rows, columns=["key", *names], dtype=object)
            yield frame

    return df.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key string, {schema}")


def product_details(df: DataFrame, key: str, html: str) -> DataFrame:
    """One row per product page (:func:`product_page`); a null page gives a row of nulls."""
    return _extracted(df, key, html, product_page, PRODUCT_PAGE)


def member_profiles(df: DataFrame, key: str, html: str) -> DataFrame:
    """One row per member page (:func:`member_page`); pages that are not available give none."""
    return _extracted(df, key, html, member_page, MEMBER_PAGE)
