"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with
those of each language, summed over all documents that bear the language, by Jensen-Shannon
distance (base 2). A document is rejected if it is far from every language, and long enough for
the distance to mean something; short ones are left to the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragweave.session import cut_lineage

#: Common function words of each language. They only name the bins of the word
#: histogram; how often each is used is measured on the corpus.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "para"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans"],
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Character classes of the histogram: capitals, other letters, white space, symbols, and of what remains these and the rest.
CLASSES = {"digit": r"\p{Nd}", "mark": "[.,;:!?'\"()-]"}
N_CLASSES = 6

#: A language needs as many words in all its documents to serve as a reference.
MIN_REFERENCE = 2000
#: Documents of fewer words aren't judged by distance; of n words, up to (first + second / sqrt(n)) passes,
#: since a short sample strays from its source by the order of 1 / sqrt(n) anyway.
MIN_WORDS = 40
CHARS_LIMIT = (0.14, 1.2)
WORDS_LIMIT = (0.15, 1.05)


def _kept(text: Column, cls: str) -> Column:
    """Code points of a class in a text."""
    negated = cls.replace("[", "[^", 1) if cls.startswith("[") else cls.replace(r"\p", r"\P")
    return F.length(F.regexp_replace(text, f"{negated}+", "")).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, lang, the counts of the base rules, chars and words histograms (arrays of long).

    n_repeat_words looks at 5-word windows by 64-bit hash: sorted with their positions only where
    a document has a repeated one, then swept once, so the cost stays n log n for any text.
    """
    d = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("w", F.array_remove(F.split("text", f"{SPACE}+"), ""))
    d = d.withColumn("n", F.size("w"))
    no_longs, window = F.array().cast("array<bigint>"), 5
    d = d.withColumn("h", F.when(F.col("n") >= window, F.transform(F.sequence(F.lit(0), F.col("n") - window), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(window)]))).otherwise(no_longs))
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs))
    same = lambda p, k: F.coalesce(p["x"] == F.get("s", k)["x"], F.lit(False))
    again = F.sort_array(F.transform(F.filter("s", lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"]))
    swept = F.aggregate(
        again,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, p: F.struct((a["n"] + p + window - F.greatest(p, a["upto"])).alias("n"), (p + window).alias("upto")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    tokens = F.filter(F.transform("w", F.lower), lambda x: x.isin(WORDS))
    d = d.withColumn("lines", lines).withColumn("common", tokens)
    d = d.withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
    # what is neither a letter nor white space is short, so the finer classes are counted there
    d = d.withColumn("odd", F.regexp_replace("text", r"[\p{L}\x20\x09-\x0D]+", "")).withColumn("n_symbols", _kept(F.col("odd"), SYMBOLS))
    d = d.withColumn("upper", _kept(F.col("text"), r"\p{Lu}")).withColumn("n_odd", F.length("odd").cast("long"))
    for k, cls in CLASSES.items():
        d = d.withColumn(k, _kept(F.col("odd"), cls))
    space = F.length("text").cast("long") - F.col("word_chars")
    named = [F.col("upper"), F.col("word_chars") - F.col("n_odd") - F.col("upper"), space, F.col("n_symbols"), *map(F.col, CLASSES)]
    rest = F.col("n_odd") - F.col("n_symbols") - sum(map(F.col, CLASSES), F.lit(0))
    count = lambda w: (F.size("common") - F.size(F.array_remove("common", w))).cast("long")
    return d.select(
        "doc_id",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(swept, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*named, rest).alias("chars"),
        F.array(*[count(w) for w in WORDS]).alias("words"),
    )


def references(found: DataFrame) -> list[tuple[str, list[int], list[int], int]]:
    """(language, chars, words, n_words) summed over all documents of each language; a row per language."""
    n_chars = N_CLASSES + 1
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(n_chars)] + [F.sum(F.col("words")[i]).alias(f"w{i}") for i in range(len(WORDS))]
    rows = found.where("lang is not null").groupBy("lang").agg(*sums, F.sum("n_words").alias("n")).where(F.col("n") >= MIN_REFERENCE).collect()
    return sorted((r.lang, [r[f"c{i}"] for i in range(n_chars)], [r[f"w{i}"] for i in range(len(WORDS))], r.n) for r in rows)


def _distance(p: list[Column], q: list[float]) -> Column:
    """Jensen-Shannon distance of a row's distribution and a constant one, base 2."""

    def half(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = [half(a, F.lit(b)) + half(F.lit(b), a) for a, b in zip(p, q)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def judge(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    chars_distance, words_distance (to the nearest language; null without one), kept. A row per row.

    Null texts are empty and so fail the base rules. Documents without lang are judged and not
    learnt from. Without a language of MIN_REFERENCE words only the base rules reject.
    """
    found = cut_lineage(features(docs))
    refs = references(found)
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    d = found.withColumn("n_chars", n_chars)
    share = lambda c, i, n: F.col(c)[i] / F.greatest(F.col(n), F.lit(1))
    by_chars, by_words = [], []
    for lang, chars, words, n in refs:
        by_chars.append(_distance([share("chars", i, "n_chars") for i in range(len(chars))], [c / max(1, sum(chars)) for c in chars]))
        # bins: the language's own common words (all of them for a language without a list), then all others
        own = [i for i, w in enumerate(WORDS) if w in COMMON.get(lang, WORDS)]
        p = [share("words", i, "n_words") for i in own]
        q = [min(1.0, words[i] / n) for i in own]
        rest = F.lit(1.0)
        for x in p:
            rest = rest - x
        by_words.append(_distance([*p, F.greatest(rest, F.lit(0.0))], [*q, max(0.0, 1 - sum(q))]))
    nearest = lambda ds: F.array_min(F.array(*ds)) if ds else F.lit(None).cast("double")
    d = d.withColumn("chars_distance", nearest(by_chars)).withColumn("words_distance", nearest(by_words))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    over = lambda c, limit: F.coalesce(F.col(c) > limit[0] + limit[1] / F.sqrt(F.greatest("n_words", F.lit(1))), F.lit(False))
    far = (F.col("n_words") >= MIN_WORDS) & (over("chars_distance", CHARS_LIMIT) | over("words_distance", WORDS_LIMIT))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "chars_distance", "words_distance", (~base & ~far).alias("kept"))
