"""Mapping freely typed locations to a reference list of towns (problem 1), in SQL expressions only."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import bounded, checkpoint, materialize
from .text import with_once

#: Levenshtein distance allowed by the length of the reference name, blanks and punctuation not counted. Beyond 2, the
#: letters must agree so far that swapped neighbours (two edits each here) explain the rest: two slips of the keyboard in all.
EDITS = [(0, 0), (4, 1), (6, 2), (8, 3), (12, 4)]
MAX_EDITS = EDITS[-1][1]
#: Letters from which a name may hold two swaps of neighbours, whatever EDITS allows: its letters are all there, in an order of at most four edits.
SWAPS = 6

# fixed values: short forms of the words that begin town names
_SHORT = {
    "mt": "mount", "mnt": "mount", "st": "saint", "snt": "saint", "ste": "sainte", "ft": "fort", "frt": "fort", "pt": "port", "prt": "port", "lk": "lake",
    "no": "north", "n": "north", "nth": "north", "so": "south", "s": "south", "sth": "south", "nw": "new", "e": "east", "w": "west", "gt": "great", "upr": "upper", "lwr": "lower",
}


def _base(ch: str) -> str:
    return unicodedata.normalize("NFD", ch)[0].lower()


def _fold_tables() -> tuple[str, str, str, str, str]:
    """Accented letters and their base letters; second bytes of UTF-8 letters read as Latin-1 or cp1252 and theirs."""
    accented = "".join(chr(c) for c in range(0xC0, 0x180) if _base(chr(c)).isascii() and _base(chr(c)).isalpha())
    second, meant = "", ""
    for b in range(0x80, 0xC0):
        letter = _base(chr(b + 0x40))
        letter = letter if letter.isascii() and letter.isalpha() else "s" if b == 0x9F else "o" if b in (0x98, 0xB8) else " "
        for shown in {chr(b), bytes([b]).decode("cp1252", "ignore")} - {""}:
            second, meant = second + shown, meant + letter
    return accented, "".join(map(_base, accented)), "[Ãã](?=[" + second.replace("]", r"\\]").replace("^", r"\\^").replace("-", r"\\-") + "])", second, meant


def folded(c: Column) -> Column:
    """Lower-case ASCII words of ``c``, one blank between; accents, mojibake, digits, marks and apostrophes undone."""
    accented, plain, broken, second, meant = _fold_tables()
    c = F.when(c.rlike(broken), F.translate(F.regexp_replace(c, broken, ""), second, meant)).otherwise(c)
    c = F.translate(F.regexp_replace(c, r"[̀-ͯ'’`]", ""), accented + "øØłŁđĐ", plain + "oollddd"[:6])
    c = F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae"))
    return F.trim(F.regexp_replace(c, "[^a-z]+", " "))


def _words(c: Column) -> Column:
    """Words of a folded text with short forms of leading words written out where another word follows."""
    short = F.create_map(*[F.lit(x) for kv in _SHORT.items() for x in kv])
    w = F.filter(F.split(c, " "), lambda x: x != "")
    return F.transform(w, lambda x, i: F.when(i < F.size(w) - 1, F.coalesce(F.try_element_at(short, x), x)).otherwise(x))


def _edits(length: Column) -> Column:
    k = F.lit(0)
    for least, n in EDITS:
        k = F.when(length >= least, n).otherwise(k)
    return k


def _segments(length: Column) -> Column:
    """Segments of a reference name of ``length``: k + 1 pieces (no, start, len) of even length, the last ones longer."""
    k1 = _edits(length) + 1
    short = F.floor(length / k1).cast("int")
    longer = (length - short * k1).cast("int")

    def piece(i: Column) -> Column:
        plain_before = F.least(i, k1 - longer)
        return F.struct(i.alias("no"), (plain_before * short + (i - plain_before) * (short + 1) + 1).cast("int").alias("start"), (short + F.when(i >= k1 - longer, 1).otherwise(0)).alias("len"))

    return F.transform(F.sequence(F.lit(0), (k1 - 1).cast("int")), piece)


def closest_names(typed: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (t, name, dist) of distinct strings of ``typed.t`` and ``names.name`` within the allowed edits of the name.

    Partition-based pigeonhole join: a reference name is cut into k + 1 segments; whatever lies within k edits holds one
    segment unchanged, shifted by no more than the edits before and after it allow. The shifted substrings meet the segments in an
    equality join on (length, segment number, substring); ``levenshtein`` verifies each candidate. Two swaps of neighbours in a name of
    SWAPS letters or more, four edits, leave no segment for sure but all letters: strings of equal letters meet in an equality join as well.
    Nulls and empty strings match nothing; repeated strings count once.
    """
    letters = lambda c: F.array_join(F.sort_array(F.split(c, "")), "")
    ref = names.select("name").where("name <> ''").distinct().select("name", F.length("name").alias("L"))
    pieces = ref.select("name", "L", F.explode(_segments(F.col("L"))).alias("s")).select("name", "L", F.col("s.no").alias("no"), F.expr("substring(name, s.start, s.len)").alias("piece"))
    # strings are spread evenly before they are cut: a string becomes some hundred probes, so small inputs are not small
    spread = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = typed.select("t").where("t <> ''").distinct().repartition(spread, F.xxhash64("t")).select("t", F.length("t").alias("n"))
    lengths = t.select("t", "n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - MAX_EDITS), F.col("n") + MAX_EDITS)).alias("L"))
    known = bounded(ref.select("L").distinct())  # at most as many rows as there are lengths of names
    near = lengths.join(known, "L", "left_semi").withColumn("k", _edits(F.col("L"))).where("abs(n - L) <= k")
    cut = near.select("t", "L", "n", "k", F.explode(_segments(F.col("L"))).alias("s"))
    shift = F.explode(F.expr("sequence(greatest(-s.no, n - L - (k - s.no)), least(s.no, n - L + (k - s.no)))"))
    probes = cut.where("greatest(-s.no, n - L - (k - s.no)) <= least(s.no, n - L + (k - s.no))").select("t", "L", "n", "s", shift.alias("by"))
    probes = probes.where("s.start + by >= 1 and s.start + by + s.len - 1 <= n").select("t", "L", F.col("s.no").alias("no"), F.expr("substring(t, s.start + by, s.len)").alias("piece"))
    swapped = t.select("t", letters(F.col("t")).alias("s")).join(ref.where(F.col("L") >= SWAPS).select("name", "L", letters(F.col("name")).alias("s")), "s").select("t", "name", "L")
    pairs = probes.join(pieces, ["L", "no", "piece"]).select("t", "name", "L").unionByName(swapped)
    near = with_once(pairs, "dist", F.levenshtein("t", "name")).where(F.col("dist") <= MAX_EDITS).distinct()
    far = F.when(F.col("dist") > 2, F.levenshtein(letters(F.col("t")), letters(F.col("name")))).otherwise(0)  # only these are weighed by their letters
    near = with_once(near, "others", far)
    good = (F.col("dist") <= _edits(F.col("L"))) & ((F.col("dist") <= 2) | ((F.col("dist") == 3) & (F.col("others") <= 2))) | ((F.col("L") >= SWAPS) & (F.col("others") == 0) & (F.col("dist") > 2))
    return near.where(good).select("t", "name", "dist")


def match_places(df: DataFrame, key: str, location: str, places: DataFrame) -> DataFrame:
    """The town of ``places`` each location means, or 0.

    ``places`` has place_id, city, region, region_code, country, aliases. A location is folded to plain words; every run of as
    many words as the longest listed name has is compared with the names and aliases of towns (by :func:`closest_names`), with regions and
    countries and, letter by letter, with region codes. Of the towns that contradict no region or country named beside
    them, the closest name wins, then the longer one; 0 is reported where none is left (an anti-join keeps those) or where two towns tie.

    Result: (key, location, place_id, dist), one row per distinct (key, location) with a location that is not blank. ``dist`` is null where
    place_id is 0. Null keys are kept. Any other columns of ``df`` are ignored; empty tables give an empty result or zeros only.
    """
    people = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{location}`").cast("string").alias("loc")).where(F.col("loc").rlike(r"(?U)[^\s]")).distinct()
    people = materialize(people.withColumn("f", folded(F.col("loc"))))
    texts = people.select("f").distinct().withColumn("w", _words(F.col("f")))

    town = places.select("place_id", "region_code", "country", F.explode(F.concat(F.array("city"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    joined = lambda c: F.array_join(_words(folded(c)), "")
    towns = town.select("place_id", "region_code", "country", joined(F.col("n")).alias("name")).where("name <> ''").distinct()
    regions = places.select("region_code", "country", joined(F.col("region")).alias("name")).where("name <> ''").distinct()
    codes = places.select("region_code", "country", F.lower("region_code").alias("name")).where("name <> ''").distinct()
    countries = places.select("country", joined(F.col("country")).alias("name")).where("name <> ''").distinct()

    listed = places.select(F.explode(F.concat(F.array("city", "region", "country"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    span = listed.agg(F.max(F.size(_words(folded(F.col("n")))))).first()[0] or 1
    # one word more, for a name may be typed with a blank too many
    runs = F.expr(f"""flatten(transform(sequence(1, size(w)), i ->
        transform(sequence(i, least(i + {span}, size(w))), j -> named_struct('i', i, 'j', j, 't', array_join(slice(w, i, j - i + 1), '')))))""")
    # each step is used more than once, and is cut here so that it is planned and run once
    spans = checkpoint(texts.where("size(w) > 0").select("f", F.explode(runs).alias("s")).select("f", "s.i", "s.j", "s.t"))
    near = checkpoint(closest_names(spans.select("t"), towns.select("name").unionByName(regions.select("name")).unionByName(countries.select("name"))))

    entries = (
        towns.select("name", F.lit("t").alias("kind"), "place_id", "region_code", "country")
        .unionByName(regions.select("name", F.lit("r").alias("kind"), F.lit(None).cast("int").alias("place_id"), "region_code", "country"))
        .unionByName(countries.select("name", F.lit("c").alias("kind"), F.lit(None).cast("int").alias("place_id"), F.lit(None).cast("string").alias("region_code"), "country"))
    )
    coded = codes.select(F.col("name").alias("t"), F.lit("r").alias("kind"), F.lit(None).cast("int").alias("place_id"), "region_code", "country", F.lit(0).alias("dist"))
    meant = near.join(entries, "name").select("t", "kind", "place_id", "region_code", "country", "dist").unionByName(coded)
    found = spans.join(meant, "t")
    # a location holds few words, so its matches are few: they are compared within one array
    per = found.groupBy("f").agg(F.collect_set(F.struct("dist", (-F.length("t")).alias("less"), "kind", "place_id", "region_code", "country", "i", "j")).alias("m"))
    # of the words that may name a town, those closest to it count; what stands beside them are hints
    named = "filter(m, x -> x.kind = 't')"
    best = F.expr(f"filter({named}, x -> not exists({named}, y -> y.place_id = x.place_id and struct(y.dist, y.less, y.i, y.j) < struct(x.dist, x.less, x.i, x.j)))")
    towns_of = per.select("f", "m", F.explode(best).alias("x"))
    apart = "(h.j < x.i or h.i > x.j)"
    judged = towns_of.select(
        "f", "x",
        F.expr(f"exists(m, h -> h.kind = 'r' and {apart} and h.region_code = x.region_code)").alias("in_region"),
        F.expr(f"exists(m, h -> h.kind = 'r' and {apart})").alias("names_region"),
        F.expr(f"exists(m, h -> h.kind = 'c' and {apart} and h.country = x.country)").alias("in_country"),
        F.expr(f"exists(m, h -> h.kind = 'c' and {apart})").alias("names_country"),
    )
    fitting = judged.where("(in_region or not names_region) and (in_country or not names_country)")
    ranked = fitting.groupBy("f", "x.place_id").agg(F.min(F.struct("x.dist", "x.less")).alias("best"))
    top = ranked.withColumn("r", F.rank().over(W.partitionBy("f").orderBy("best"))).where("r = 1")
    one = top.groupBy("f").agg(F.count("*").alias("n"), F.min("place_id").alias("place_id"), F.min("best.dist").alias("dist"))
    sure = checkpoint(one.where("n = 1").select("f", "place_id", "dist"))
    hit = people.join(sure, "f").select("k", "loc", "place_id", "dist")
    missed = people.join(sure, "f", "left_anti").select("k", "loc", F.lit(0).alias("place_id"), F.lit(None).cast("int").alias("dist"))
    return hit.unionByName(missed).select(F.col("k").alias(key), F.col("loc").alias(location), "place_id", "dist")
