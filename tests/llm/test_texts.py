import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridex.llm.language import declared, identify, sentences
from veridex.llm.leakage import align, holds_passage, leaked_items
from veridex.llm.packing import pack, pack_stream, token_counts


def _words(rng, n, k=3000):
    return [f"w{rng.randrange(k)}" for _ in range(n)]


def test_align():
    a = np.arange(30)
    edited = a.copy()
    edited[10] = 99
    doc = np.concatenate([[200, 201], edited[5:28], [202]])
    assert align([doc, np.array([1]), np.array([500])], [a, a, a]).tolist() == [[22, 23], [1, 1], [0, 0]]
    dropped = np.concatenate([np.arange(0, 12), np.arange(13, 25)])
    assert align([dropped], [a]).tolist() == [[24, 25]]


def test_leaks(spark):
    rng = random.Random(1)
    items = [(i, _words(rng, 60)) for i in range(6)]
    stock = "i was given a sample in exchange for my opinion".split()
    items[4] = (4, _words(rng, 20) + stock + _words(rng, 20))
    items[5] = (5, _words(rng, 15) + stock + _words(rng, 25))
    docs, want = [], set()
    for d in range(300):
        body = _words(rng, rng.randint(0, 200))
        if d % 10 == 1:
            i, w = items[d // 10 % 6]
            n = rng.randint(26, len(w))
            part = w[:n]
            for k in range(7, n - 3, 9):
                part[k] = "changed" if k % 2 else ""
            body[3:3] = [p for p in part if p]
            want.add((d, i))
        elif d % 10 == 2:
            body[1:1] = stock
        elif d % 10 == 3:
            body += items[d // 10 % 4][1][:12]
        elif d % 3 == 0:  # a third of all documents quote one item
            body += items[0][1]
            want.add((d, 0))
        docs.append((d, " ".join(body).title().replace(" W1", ",\n<br>W1")))
    docs += [(900, None), (901, ""), (None, " ".join(items[1][1])), (902, "x " * 30_000)]
    want_all = want
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("g", F.lit(1))
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(7, None), (8, ""), (9, "too short"), (None, "a b c d e")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaked_items(d, "doc_id", "text", it, "item_id", "text").collect()} == want_all
    assert leaked_items(d.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert leaked_items(d, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_passages_of_twenty_words_with_two_edits_anywhere(spark):
    rng = random.Random(7)
    stock = "i was given a sample in exchange for my opinion".split()
    items = [(i, (w := _words(rng, 50))[:20] + (stock if i < 8 else []) + w[20:]) for i in range(12)]
    docs, want = [], set()
    for d, (x, y) in enumerate((x, y) for x in range(20) for y in range(x)):
        i, w = items[8 + d % 4]
        part = w[15:35]
        part[x] = "changed"
        part[y] = "other" if d % 2 else ""
        docs.append((d, _words(rng, 30) + [p for p in part if p] + _words(rng, 30)))
        want.add((d, i))
    for d in range(1000, 1000 + 3 * len(want)):  # a third of all hold the stock phrase, others a passage too short or with too many edits
        i, w = rng.choice(items)
        part = w[22:38] if d % 3 == 1 else [x if k % 5 else "edit" for k, x in enumerate(w[20:50])]
        docs.append((d, _words(rng, 20) + (stock if d % 3 == 0 else part) + _words(rng, 40)))
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaked_items(frame, "doc_id", "text", it, "item_id", "text").collect()} == want


def test_holds_passage():
    item = np.arange(100, 140)
    doc = np.concatenate([[1, 2, 3], item[5:25], [4, 5]])
    assert holds_passage(doc, item, -3, 1) == (20, 22)  # two words beside the passage may be lost
    for x in range(20):
        for y in range(x):
            left_out = np.delete(doc, [3 + y, 3 + x])
            assert holds_passage(left_out, item, -7, 1)[1] >= 20, (x, y)
    assert holds_passage(np.concatenate([[1], item[5:22], [2]]), item, -6, -2) == (0, 0)
    assert holds_passage(item[:10], item[:10], -2, 2) == (0, 0)


SENTENCES = {
    "en": ["The lamp stopped working after two weeks", "I would buy this bag again", "It is not worth the money", "My children love the new chair"],
    "de": ["Die Lampe hat nach zwei Wochen versagt", "Ich würde diese Tasche wieder kaufen", "Das ist sein Geld nicht wert", "Meine Kinder lieben den neuen Stuhl"],
    "fr": ["La lampe ne marche plus depuis deux semaines", "Je rachèterais ce sac sans hésiter", "Cela ne vaut pas son prix", "Mes enfants adorent la nouvelle chaise"],
}


def test_languages(spark):
    rng = random.Random(2)
    make = lambda lang, n: ". ".join(rng.choice(SENTENCES[lang]) for _ in range(n)) + ". "
    rows, want = [], {}
    for i in range(300):
        lang = rng.choice(list(SENTENCES))
        rows.append((i, make(lang, 5), rng.choice([lang, lang, lang.upper(), {"en": "English", "de": "ger", "fr": "fr-CA"}[lang], None, "??", rng.choice(list(SENTENCES))]), f"h{i % 3}", "k"))
        want[i] = [lang]
    rows += [(400, make("en", 4) + "\n\n" + make("de", 3), "en", "h1", "k"), (401, make("en", 3) + 'They call it "Mes enfants adorent la nouvelle chaise". ' + make("en", 3), "en", None, None)]
    want |= {400: ["en", "de"], 401: ["en"]}
    rows += [(500, None, "en", "h1", "k"), (501, "", "en", "h1", "k"), (502, "12 !!", "en", "h1", "k"), (503, "zzyzx", "fr", "h1", "k"), (None, make("en", 2), "en", "h1", "k"), (504, make("de", 2000), "en", "h2", "k")]
    df = spark.createDataFrame(rows, "id long, text string, lang string, host string, kind string").withColumn("doc_id", F.lit("x")).withColumn("first", F.lit(1))
    out = identify(df, "id", "text", "lang", "host", "kind").collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.doc_id, r.first)):
        got[r.doc_id].append(r.lang)
        assert 0 < r.confidence <= 1
    assert {i: got[i] for i in want} == want and got[504] == ["de"] and got[503] == ["fr"]
    assert not {500, 501, 502} & set(got)
    assert identify(df.limit(0), "id", "text", "lang").count() == 0


def test_markup_and_address_are_evidence(spark):
    rng = random.Random(5)
    make = lambda lang, n: ". ".join(rng.choice(SENTENCES[lang]) for _ in range(n)) + ". "
    rows = []
    for i in range(300):
        lang = rng.choice(list(SENTENCES))
        page = f'<p lang="{lang}-XX">' if i % 2 else f"http://www.shop.example.{'us' if lang == 'en' else lang}/x "
        rows.append((i, page + make(lang, 4), lang, f"h{i}"))  # as many hosts as documents
    rows += [(1000, '<div class=x lang="de">zzyzx qwrtz</div>', None, None), (1001, "zzyzx qwrtz https://a.b.fr/c?d", None, None), (1002, "zzyzx qwrtz", None, "shop.example.de")]
    df = spark.createDataFrame(rows, "id long, text string, lang string, host string")
    got = {r.doc_id: r.lang for r in identify(df, "id", "text", "lang", "host").where("doc_id >= 1000").collect()}
    assert got == {1000: "de", 1001: "fr", 1002: "de"}


def test_labels(spark):
    labels = ["en", "EN ", "en-US", "es_419", "Deutsch", "ger", "und", "??", "", None, "ja", "русский"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in df.select(declared(F.col("l"))).collect()] == ["en", "en", "en", "es", "de", "de", None, None, None, None, "?", "ru"]


def test_sentences():
    assert sentences('<p>One two. "Quoted words here" Three!</p>\nFour http://a.example/x') == [["one", "two"], ["three"], ["four"]]
    assert sentences("") == [] and sentences('"Only a quote."') == [["only", "a", "quote"]]


def test_pack_stream_matches_the_rule():
    rng = np.random.default_rng(0)
    sizes, cap = rng.integers(1, 21, 400), 20
    got = pack_stream(sizes, cap)
    fill, want = {}, []
    for s in sizes.tolist():  # the rule by trying every level
        counts = np.bincount([f for f in fill.values() if f < cap], minlength=cap + 1)
        best = None
        for h in range(cap - s, -1, -1):
            if h and not counts[h]:
                continue
            after = counts.copy()
            after[h] -= h > 0
            after[h + s] += h + s < cap
            score = int((after[1:cap] ** 2).sum())
            if best is None or score < best[0]:
                best = (score, h)
        want.append(best[1])
        box = max((b for b, f in fill.items() if f == best[1]), default=None) if best[1] else None
        fill[len(fill) if box is None else box] = best[1] + s
    fills, levels = {}, []
    for s, b in zip(sizes.tolist(), got.tolist(), strict=True):
        levels.append(fills.get(b, 0))
        fills[b] = fills.get(b, 0) + s
    assert levels == want and max(fills.values()) <= cap


def test_pack(spark, monkeypatch):
    monkeypatch.setattr("veridex.llm.packing.STREAM", 300)
    rng = random.Random(0)
    rows = [(i, min(2000, int(rng.expovariate(1 / 150)) + 1), "x") for i in range(3000)] + [(5000, 5000, "x"), (5001, 2048, "x"), (5002, 4096, "x"), (5003, 0, "x"), (5004, None, "x"), (None, 7, "x"), (5005, 9, "x"), (5005, 9, "x")]
    df = spark.createDataFrame(rows, "id long, n long, part string").withColumn("stream", F.lit(1)).withColumn("size", F.lit(1))
    out = pack(df, "id", "n", 2048).collect()
    fill, per = defaultdict(int), defaultdict(list)
    for r in out:
        fill[r.container] += r["size"]
        per[r.id].append((r.part, r["size"]))
    assert max(fill.values()) <= 2048 and sorted(per[5000]) == [(1, 2048), (2, 2048), (3, 904)] and sorted(per[5002]) == [(1, 2048), (2, 2048)]
    assert per[5001] == [(0, 2048)] and per[5005] == [(0, 9), (0, 9)] and 5003 not in per and 5004 not in per
    assert sum(fill.values()) == sum(n for i, n, _ in rows if i is not None and n) and sum(fill.values()) / 2048 / len(fill) > 0.98
    assert pack(df.limit(0), "id", "n").count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (None, "x"), (4, "<|endoftext|>"), (5, "a" * 100_000)], "id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, "id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 0 and len(got) == 5
