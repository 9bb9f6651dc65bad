"""The language of each text and of each passage of a mixed text, whatever its label says (problem 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import bounded, checkpoint, materialize
from .text import words

# fixed values: ISO 639-1 codes told apart, and the ways their labels are written
LANGUAGES = {
    "en": "en eng english englisch anglais",
    "de": "de deu ger german deutsch allemand",
    "fr": "fr fra fre french français francais französisch",
    "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands",
    "sv": "sv swe swedish svenska",
    "ru": "ru rus russian русский",
}
# fixed values: labels that name no language
_NONE = ["", "und", "unknown", "unk", "mul", "mis", "zxx", "xx", "none", "null", "n/a", "na", "-", "other"]

#: Labelled documents per language from which the word model is fitted (about; all, where there are fewer).
SAMPLE = 3_000
#: Words per language the model keeps, the most frequent first.
VOCABULARY = 20_000
#: Logarithm of the odds of one sentence continuing the language of the last.
STAY = 4.0
#: Strength, in documents, of the parent level's distribution in a host's prior.
SMOOTHING = 50.0
#: Sentences that make a passage.
PASSAGE = 2
#: Posterior of a text alone from which it tells whether its label can be trusted.
SURE = 0.99

# fixed values: endings of addresses under which one of these languages is written
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "pt": "pt", "br": "pt", "it": "it", "nl": "nl", "se": "sv", "ru": "ru", "uk": "en", "ie": "en", "us": "en", "au": "en"}

_NOISE = re.compile(r"<[/!]?[a-zA-Z][^<>]*>|&(?:[a-zA-Z]{2,8}|#\d{1,6});|(?:https?://|www\.)\S+")
_QUOTED = re.compile(r"\"[^\"\n]{1,160}\"|“[^”\n]{1,160}”|„[^“”\n]{1,160}[“”]|«[^»\n]{1,160}»")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+")


def declared(label: Column) -> Column:
    """The ISO 639-1 code a label names, '?' if it names another language, null if it names none."""
    named = F.create_map(*[F.lit(x) for code, ways in LANGUAGES.items() for way in ways.split() for x in (way, code)])
    low = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    base = F.regexp_extract(low, r"^(\p{L}{2,3})[-_](?:\p{L}{2,4}|\d{3})$", 1)
    code = F.coalesce(F.try_element_at(named, low), F.try_element_at(named, base))
    return F.when(low.isNull() | low.isin(_NONE) | ~low.rlike(r"\p{L}"), None).otherwise(F.coalesce(code, F.lit("?")))


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence that has any; tags, addresses and quoted phrases do not count."""
    bare = _QUOTED.sub(" ", _NOISE.sub(" ", text))
    if not _WORD.search(bare):
        bare = _NOISE.sub(" ", text)
    return [w for s in _SENTENCE.split(bare) if (w := _WORD.findall(s.lower()))]


def _decode(scores: np.ndarray, prior: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, last, language) runs of the most likely sequence of languages, runs shorter than a passage joined to a neighbour."""
    n, k = scores.shape
    top = scores.argmax(1)
    if n == 1 or (top == top[0]).all():
        return [(0, n - 1, int((scores.sum(0) + prior).argmax()))]
    total, back = scores[0] + prior, np.zeros((n, k), np.int64)
    for i in range(1, n):
        j = int(total.argmax())
        moved = total[j] - STAY
        back[i] = np.where(total >= moved, np.arange(k), j)
        total = np.maximum(total, moved) + scores[i]
    path = [int(total.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    path.reverse()
    runs: list[list[int]] = []
    for i, lang in enumerate(path):
        if runs and runs[-1][2] == lang:
            runs[-1][1] = i
        else:
            runs.append([i, i, lang])
    while len(runs) > 1 and any(r[1] - r[0] + 1 < PASSAGE for r in runs):
        i = min((r[1] - r[0], j) for j, r in enumerate(runs) if r[1] - r[0] + 1 < PASSAGE)[1]
        a, b = runs[i][0], runs[i][1]
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(runs)]
        into = max(near, key=lambda j: scores[a : b + 1, runs[j][2]].sum())
        runs[into][0], runs[into][1] = min(runs[into][0], a), max(runs[into][1], b)
        del runs[i]
        merged: list[list[int]] = []
        for r in runs:
            if merged and merged[-1][2] == r[2]:
                merged[-1][1] = r[1]
            else:
                merged.append(r)
        runs = merged
    return [tuple(r) for r in runs]


class WordModel:
    """Log-likelihoods of words by language."""

    def __init__(self, counts: Sequence[tuple[str, str, int]], langs: Sequence[str]) -> None:
        self.langs = list(langs)
        at = {x: i for i, x in enumerate(self.langs)}
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for w, _, _ in counts))}
        table = np.zeros((len(self.ids) + 1, len(self.langs)))
        for w, lang, n in counts:
            table[self.ids[w], at[lang]] += n
        # half a count for unseen words, scaled so that they are equally unlikely in a language of few texts and in one of many
        totals = table.sum(0)
        table = (table + 0.5 * totals / max(totals.max(), 1.0)) / np.maximum(totals * (1 + 0.5 * len(table) / max(totals.max(), 1.0)), 1e-9)
        self.table = np.log(np.maximum(table, 1e-12))
        self.table -= self.table.max(1, keepdims=True)
        self.table[len(self.ids)] = 0.0  # unknown words say nothing

    def score(self, texts: list[list[list[str]]]) -> tuple[np.ndarray, list[int]]:
        """Log-likelihoods per sentence and the number of sentences of each text."""
        get, unknown = self.ids.get, len(self.ids)
        flat = np.fromiter((get(w, unknown) for t in texts for s in t for w in s), np.int64)
        starts = np.cumsum([0, *[len(s) for t in texts for s in t]])[:-1]
        return np.add.reduceat(self.table[flat], starts, axis=0) if len(flat) else np.zeros((0, len(self.langs))), [len(t) for t in texts]


def _passages(batches: Iterator[pa.RecordBatch], model: WordModel) -> Iterator[pa.RecordBatch]:
    """The words of each passage found by the text alone, with its language."""
    even = np.zeros(len(model.langs))
    for b in batches:
        texts = [sentences(t or "") for t in b.column("text").to_pylist()]
        scores, sizes = model.score(texts)
        out, row = [], 0
        for text, n in zip(texts, sizes, strict=True):
            if n:
                out += [(model.langs[k], [x for s in text[i : j + 1] for x in s]) for i, j, k in _decode(scores[row : row + n], even)]
                row += n
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([w for _, w in out], pa.list_(pa.string()))], names=["lang", "w"])


_KEPT = ["doc_id", "declared", "markup", "suffix", "host", "kind"]
_SCORED = "doc_id long, declared string, markup string, suffix string, host string, kind string, scores array<float>, sizes array<int>, top string, sure boolean"


def _scored(batches: Iterator[pa.RecordBatch], model: WordModel) -> Iterator[pa.RecordBatch]:
    """Every document that has words: log-likelihoods by sentence and language, words by sentence, the language of the text alone and whether that is sure."""
    k = len(model.langs)
    for b in batches:
        texts = [sentences(t or "") for t in b.column("text").to_pylist()]
        scores, sizes = model.score(texts)
        n = np.array(sizes, np.int64)
        at = np.flatnonzero(n)
        ends = np.concatenate([[0], np.cumsum(n[at])])
        total = np.add.reduceat(scores, ends[:-1], axis=0) if len(at) else np.zeros((0, k))
        e = np.exp(total - total.max(1, keepdims=True)) if len(at) else total
        top, sure = total.argmax(1) if len(at) else np.zeros(0, np.int64), 1 / e.sum(1) >= SURE if len(at) else np.zeros(0, bool)
        words_in = np.array([len(x) for t in texts for x in t], np.int32)
        flat = pa.ListArray.from_arrays(pa.array((ends * k).astype(np.int32)), pa.array(scores.astype(np.float32).ravel()))
        lengths = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words_in))
        took = [b.column(c).take(pa.array(at)) for c in _KEPT]
        yield pa.RecordBatch.from_arrays([*took, flat, lengths, pa.array([model.langs[x] for x in top], pa.string()), pa.array(sure)], names=[*_KEPT, "scores", "sizes", "top", "sure"])


def _decoded(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[pa.RecordBatch]:
    """Passages of scored documents, each with its prior. Texts of one language are settled for a batch at once, mixed ones one by one."""
    k = len(langs)
    for b in batches:
        m = b.num_rows
        if not m:
            continue
        doc, prior = b.column("doc_id").to_numpy(), b.column("prior").flatten().to_numpy().reshape(m, k)
        scores = b.column("scores").flatten().to_numpy().astype(float).reshape(-1, k)
        words_in = b.column("sizes").flatten().to_numpy().astype(np.int64)
        n = b.column("sizes").value_lengths().to_numpy().astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        tops = scores.argmax(1)
        one = np.minimum.reduceat(tops, starts) == np.maximum.reduceat(tops, starts)
        total, all_words = np.add.reduceat(scores, starts, axis=0) + prior, np.add.reduceat(words_in, starts)
        best = total.argmax(1)
        sure = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        at = np.flatnonzero(one)
        rows = [doc[at], np.zeros(len(at), np.int64), n[at] - 1, all_words[at], best[at], sure[at]]
        more: list[tuple] = []
        for i in np.flatnonzero(~one):
            own = scores[starts[i] : starts[i] + n[i]]
            for first, last, lang in _decode(own, prior[i]):
                t = own[first : last + 1].sum(0) + prior[i]
                e = np.exp(t - t.max())
                more.append((doc[i], first, last, words_in[starts[i] + first : starts[i] + last + 1].sum(), lang, e[lang] / e.sum()))
        cols = [np.concatenate([r, np.array(c, r.dtype)]) for r, c in zip(rows, zip(*more, strict=True) if more else [[]] * 6, strict=True)]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
        cols[4] = np.array(langs, object)[cols[4].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "first", "last", "n_words", "lang", "confidence"])


_SCHEMA = "doc_id long, first int, last int, n_words int, lang string, confidence double"


def _fit(labelled: DataFrame) -> WordModel:
    """Fit the word model on (lang, w ARRAY): a bounded table of the words most frequent in each language."""
    counts = labelled.select("lang", F.explode("w").alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("r") <= VOCABULARY)
    return WordModel([(r.w, r.lang, r.n) for r in ranked.select("w", "lang", "n").orderBy("w", "lang").collect()], list(LANGUAGES))


def _evidence(scored: DataFrame, langs: list[str]) -> DataFrame:
    """``scored`` with ``prior``, what is known of each document beside its text: ARRAY of logarithms by language.

    Counted over all documents, in grouped aggregates: labels by host and kind of text, each level's shares smoothed towards the level above by
    SMOOTHING documents; how often the labels of a host, declarations in the markup and endings of addresses agree with texts that are sure by
    themselves. All hosts and kinds count, whatever their number; the table of them meets the documents by a join.
    """
    k = len(langs)
    own = [F.sum((F.col("declared") == x).cast("double")) for x in langs]
    tested = F.col("sure") & F.col("declared").isin(langs)
    sums = lambda c, of: [F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0.0)) for i in range(of)]
    by_kind = checkpoint(scored.groupBy("host", "kind").agg(
        F.array(*[F.coalesce(x, F.lit(0.0)) for x in own]).alias("c"),
        F.array(*[F.coalesce(F.sum(x.cast("double")), F.lit(0.0)) for x in (tested, tested & (F.col("declared") == F.col("top")))]).alias("t"),
        F.array(*[F.coalesce(F.sum(x.cast("double")), F.lit(0.0)) for e in ("markup", "suffix") for x in (F.col("sure") & F.col(e).isNotNull(), F.col("sure") & (F.col(e) == F.col("top")))]).alias("e"),
    ))
    whole = by_kind.agg(F.array(*sums("c", k)).alias("c"), F.array(*sums("t", 2)).alias("t"), F.array(*sums("e", 4)).alias("e")).first()
    rate = lambda n, same: min(0.99, (same + 8) / (n + 10))
    everywhere = F.array(*[F.lit((x + 1.0) / (sum(whole.c) + k)) for x in whole.c])
    overall, marked, ended = rate(*whole.t), rate(*whole.e[:2]), rate(*whole.e[2:])
    smooth = lambda c, above: F.transform(c, lambda x, i: (x + SMOOTHING * F.get(above, i)) / (F.aggregate(c, F.lit(0.0), lambda a, y: a + y) + SMOOTHING))
    hosts = by_kind.groupBy("host").agg(F.array(*sums("c", k)).alias("hc"), F.array(*sums("t", 2)).alias("ht"))
    hosts = hosts.select(F.col("host").alias("h"), smooth(F.col("hc"), everywhere).alias("share"), F.least(F.lit(0.99), (F.get("ht", F.lit(1)) + SMOOTHING * overall) / (F.get("ht", F.lit(0)) + SMOOTHING)).alias("trust"))
    known = by_kind.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select(F.col("host").alias("h"), F.col("kind").alias("k"), smooth(F.col("c"), F.col("share")).alias("share"), "trust")
    met = scored.join(bounded(known), F.col("host").eqNullSafe(F.col("h")) & F.col("kind").eqNullSafe(F.col("k")))
    says = lambda c, r, x: F.when(c.isin(langs), F.when(c == x, F.ln(r)).otherwise(F.ln((1 - r) / (k - 1)))).otherwise(0.0)
    prior = [F.ln(F.get("share", F.lit(i))) + says(F.col("declared"), F.col("trust"), x) + says(F.col("markup"), F.lit(marked), x) + says(F.col("suffix"), F.lit(ended), x) for i, x in enumerate(langs)]
    return met.select("doc_id", "scores", "sizes", F.array(*prior).alias("prior"))


def identify(df: DataFrame, doc_id: str, text: str, label: str, host: str | None = None, kind: str | None = None) -> DataFrame:
    """Passages of every text with their language and a confidence.

    Bayesian evidence fusion. The likelihood of a sentence comes from words by language, fitted on a sample of about SAMPLE labelled
    documents per language and fitted once more on the passages it finds there, which rids it of wrong labels and mixed texts. All documents are
    scored by it once; the prior of a document (:func:`_evidence`) joins labels counted over all documents of its host and kind of text, smoothed
    level by level, its own label as far as labels of its host agree with their texts, a language declared in its markup, and the ending of the
    first address in it (of the host, if that is an address). The most likely sequence of languages over the sentences gives the
    passages; fewer than PASSAGE sentences make none, and quoted phrases, tags and addresses are left out of the likelihood.

    Result: doc_id, first, last (sentences, from 0), n_words INT, lang (ISO 639-1), confidence DOUBLE. Texts that are null, empty or
    without letters give no row; a text of unknown words gets the language its prior favours, with that confidence. Rows with a null id are
    left out; repeated rows give repeated passages. Other columns, whatever their names, are ignored. An empty table gives none.
    """
    column = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")
    d = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), column(text).alias("text"), declared(column(label)).alias("declared"), column(host).alias("host"), column(kind).alias("kind")).where("doc_id is not null")
    t = F.col("text")
    stated = F.when(F.contains(t, F.lit("lang")), declared(F.regexp_extract(t, r"(?i)<[a-z][^<>]*\slang\s*=\s*[\"']?([\p{L}_-]+)", 1)))
    ending = F.when(F.contains(t, F.lit("//")), F.nullif(F.regexp_extract(t, r"(?i)https?://[\w.-]+\.([a-z]{2})(?![\w.-])", 1), F.lit("")))
    ending = F.coalesce(ending, F.nullif(F.regexp_extract("host", r"(?i)^(?:https?://)?[\w-]+(?:\.[\w-]+)*\.([a-z]{2})(?![\w.-])", 1), F.lit("")))
    country = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    d = d.withColumn("markup", stated).withColumn("suffix", F.try_element_at(country, F.lower(ending)))
    langs = list(LANGUAGES)
    usable = d.where(F.col("declared").isin(langs) & t.isNotNull() & (F.length(t) > 20))
    # a share of each language's documents by a hash of their ids: nothing is moved, and the draw does not depend on the order of rows
    sizes = {r.declared: r.n for r in usable.groupBy("declared").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, SAMPLE / max(1, sizes.get(lang, 0))))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000.0
    sample = checkpoint(usable.where(drawn < F.element_at(share, F.col("declared"))).select("text", F.col("declared").alias("lang")))
    rough = _fit(sample.select("lang", words(t).alias("w")))
    model = _fit(sample.select("text").mapInArrow(lambda it: _passages(it, rough), "lang string, w array<string>"))
    scored = materialize(d.select(*_KEPT, "text").mapInArrow(lambda it: _scored(it, model), _SCORED))
    return _evidence(scored, langs).mapInArrow(lambda it: _decoded(it, langs), _SCHEMA)
