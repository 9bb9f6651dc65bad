import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veridex.llm import neardup
from veridex.llm.baskets import item_pairs
from veridex.llm.neardup import near_duplicate_records
from veridex.llm.places import closest_names, folded, match_places
from veridex.llm.survivors import surviving_records
from veridex.llm.text import words

PLACES = [
    (1, "Mount Qùeaskobridge", "Howindwold", "HO", "Nostbrioia", None),
    (2, "Meardale", "Jiorleara", "JI", "Dustklivstan", ["Oldname"]),
    (3, "Meardale", "Liorheavwold", "LI", "Zovquyndland", None),
    (4, "Fiohaven", "Gralflairkara", "GR", "Nostbrioia", []),
    (5, "Naíxhaven", "Mastsendshire", "MA", "Dustklivstan", None),
]


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame(PLACES, "place_id int, city string, region string, region_code string, country string, aliases array<string>")


def test_places(spark, places):
    typed = {
        "Mt. Queaskobridge, HO": 1, "MOUNT QUEASKOBRIDGE": 1, "mt queaskobirdge": 1, "Meardale": 0, "Meardale, JI": 2, "meardale (Liorheavwold)": 3, "Oldname": 2, "living in Meardael, Zovquyndland :)": 3,
        "Fihoaven": 4, "Fiohaven GR 30203": 4, "Fiohaven, JI": 0, "Howindwold": 0, "the moon": 0, "-": 0, "NaÃ­xhaven": 5, "Naíxhaven": 5, "Nostbrioia - Gralflairkara - Fiohaven": 4, "x" * 50_000: 0,
    }
    rows = [(f"m{i}", t, 1, 2) for i, t in enumerate(typed)] + [("m0", next(iter(typed)), 1, 2), ("n1", None, 1, 2), ("n2", " \t", 1, 2), (None, "Oldname", 1, 2)]
    df = spark.createDataFrame(rows, "id string, location string, place_id int, city int")
    got = match_places(df, "id", "location", places)
    assert {r.location: r.place_id for r in got.where("id is not null").collect()} == typed
    assert got.count() == len(typed) + 1 and got.where("id is null").first().place_id == 2
    assert match_places(df.limit(0), "id", "location", places).count() == 0
    assert {r.place_id for r in match_places(df, "id", "location", places.limit(0)).collect()} == {0}


def test_closest_names_against_all_pairs(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 14))) for _ in range(60)]

    def edit(s):
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(s) + 1)
            s = rng.choice([s[:i] + rng.choice("abcde") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("abcde") + s[i + 1 :]]) or "a"
        return s

    typed = [edit(rng.choice(names)) for _ in range(300)] + ["", None]
    t, n = spark.createDataFrame([(x,) for x in typed], "t string"), spark.createDataFrame([(x,) for x in names], "name string")
    got = {(r.t, r.name, r.dist) for r in closest_names(t, n).collect()}
    k = lambda x: 4 if x >= 12 else 3 if x >= 8 else 2 if x >= 6 else 1
    pairs = t.where("t <> ''").distinct().crossJoin(n.distinct()).select("t", "name", F.levenshtein("t", "name").alias("d")).collect()
    want = set()
    for r in pairs:
        letters = sum(((Counter(r.t) - Counter(r.name)) + (Counter(r.name) - Counter(r.t))).values())
        if r.d <= min(2, k(len(r.name))) or r.d <= k(len(r.name)) and r.d == 3 and letters <= 1 or r.d <= 4 and letters == 0 and len(r.name) >= 6:
            want.add((r.t, r.name, r.d))
    assert want <= got and all(d <= max(k(len(n)), 4 if len(n) >= 6 else 0) for _, n, d in got)
    assert {x for x in got if x[2] <= 2} == {x for x in want if x[2] <= 2}


def test_names_of_many_words_and_two_swaps(spark):
    listed = [(1, "Santa Maria del Rio Verde", "North", "NO", "Here", None), (2, "Quiolbridge", "South", "SO", "Here", None), (3, "Kloumholm", "South", "SO", "Here", ["Upper Town on the Old Long Hill"])]
    p = spark.createDataFrame(listed, "place_id int, city string, region string, region_code string, country string, aliases array<string>")
    typed = {"Santa Maria del Rio Verde": 1, "santa mraia del rio vrede, NO": 1, "quilobrideg": 2, "kluomhlom": 3, "upper town on the old long hill": 3, "verde": 0}
    df = spark.createDataFrame([(k, k) for k in typed], "id string, location string")
    assert {r.location: r.place_id for r in match_places(df, "id", "location", p).collect()} == typed


def test_folding(spark):
    df = spark.createDataFrame([("  ÀÉ-ß, O'Neil 12 ",), ("Kã¶lello",), (None,), ("♥",)], "s string")
    assert [r[0] for r in df.select(folded(F.col("s"))).collect()] == ["ae ss oneil", "kolello", None, ""]


@pytest.mark.parametrize("large", [100, 30, 3])
def test_item_pairs_against_counting(spark, monkeypatch, large):
    monkeypatch.setattr("veridex.llm.baskets.LARGE", large)
    rng = random.Random(large)
    groups = [[f"i{g}{k}" for k in range(4)] for g in range(8)]
    rows = []
    for b in range(400):
        g = rng.choice(groups)
        rows += [(f"b{b}", x) for x in rng.sample(g, rng.randint(1, 4))] + [(f"b{b}", rng.choice(["hot", "cold", g[0], None, " "]))]
    rows += [(f"big{k}", x) for k in range(12) for g in groups for x in g] * 2 + [(None, "i00"), ("", "i01")]
    own = defaultdict(set)
    for b, i in rows:
        if b and i and b.strip() and i.strip():
            own[b].add(i)
    n = Counter(i for s in own.values() for i in s)
    shared = Counter((a, c) for s in own.values() for a in s for c in s if a < c)
    want = {(a, c, k, n[a], n[c]) for (a, c), k in shared.items() if k >= 6 and k * len(own) >= 3 * n[a] * n[c]}
    df = spark.createDataFrame(rows, "b string, i string").withColumn("w", F.lit(1)).withColumn("items", F.lit(2))
    got = item_pairs(df, "b", "i", 6, 3.0)
    assert {(r.item_a, r.item_b, r.shared, r.n_a, r.n_b) for r in got.collect()} == want and want
    assert item_pairs(df.limit(0), "b", "i").count() == 0


def test_survivors(spark):
    rows = [("a", "x", 0, 1, 5), ("a", None, 1, 9, 6), ("a", "y", 1, 2, 7), ("a", "z", 1, 2, 8), ("b", "q", 1, 1, 1), (None, "q", 1, 1, 1), (None, "q", 1, 1, 1), ("c", None, 0, None, 1), ("c", None, 0, None, 1), ("d", "u", 0, 3, 3), ("d", "v", 0, 3, 3)]
    df = spark.createDataFrame(rows, "g string, v string, t int, at int, no int").withColumn("n_rows", F.lit("x")).withColumn("rank", F.lit(1))
    got = surviving_records(df, F.col("g"), {"v": (F.col("v"), F.col("t") == 1)}, [F.col("at"), F.col("no")])
    assert {(r["group"], r.n_rows, r.v) for r in got.collect()} == {("a", 4, "z"), ("c", 2, None), ("d", 2, "v")}
    assert surviving_records(df.limit(0), F.col("g"), {"v": (F.col("v"), F.lit(0))}, [F.col("no")]).count() == 0


def test_words(spark):
    df = spark.createDataFrame([("<p>It's  A&amp;B—x_1, ÉÉ!</p>\n",), (None,), ("",), ("♥ ?",)], "s string")
    assert [list(r[0]) for r in df.select(words(F.col("s"))).collect()] == [["its", "a", "b", "x", "1", "éé"], [], [], []]


@pytest.mark.parametrize("region", [20, 2])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, region):
    monkeypatch.setattr(neardup, "NEIGHBOURS", region)
    rng = random.Random(region)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "a", "of"] * 20
    texts = []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(60)]
        for j in range(rng.choice([1, 1, 2, 4])):
            t = base[:]
            for _ in range(rng.randint(0, 8)):
                t[rng.randrange(60)] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                rng.shuffle(t)
            texts.append((f"r{i:02}{j}", rng.choice([None, "Title", "<b>Title!</b>"]), " ".join(t).upper() if rng.random() < 0.3 else ", ".join(t)))
    texts += [("s1", None, texts[0][2]), ("s2", "Short", "one two"), ("s3", "Short", "one two"), (None, None, texts[0][2]), ("s4", None, None), ("s5", "", ""), texts[3]]
    df = spark.createDataFrame(texts, "id string, title string, txt string").withColumn("t", F.lit(1)).withColumn("raw", F.lit(2)).withColumn("key", F.lit(3))
    bags = [(i, Counter(f"{'title ' if t and 'itle' in t else ''}{x or ''}".lower().replace(",", "").split()), len((x or "").split())) for i, t, x in texts if i]
    want = {tuple(sorted((a, b))) for a, x, n in bags for b, y, m in bags if a != b and n >= 30 and m >= 30 and sum((x & y).values()) >= 0.7 * max(x.total(), y.total())}
    got = near_duplicate_records(df, F.col("id"), words(F.concat_ws(" ", "title", "txt")), words(F.col("title")), ["title", "txt"])
    found = {(r.key_a, r.key_b) for r in got.collect()}
    assert found <= want and len(found) >= (0.97 if region == 20 else 0.9) * len(want) and ("r000", "s1") in found
    assert near_duplicate_records(df.limit(0), F.col("id"), words(F.col("txt")), words(F.col("title")), ["title", "txt"]).count() == 0
