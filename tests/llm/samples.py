"""Small document tables: prose of invented syllables, copies, junk and the odd cases."""

import random

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string"
SYLLABLES = {"en": ["the ", "of ", "th", "ing", "er", "an", "re "], "de": ["der ", "und ", "sch", "ei", "en ", "ung", "ä"], "fr": ["les ", "de ", "eau", "ai", "é", "tion ", "ou"]}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))).strip() or "x" for _ in range(words))


def rows(n=90, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        out.append([i, prose(rng, lang, rng.randrange(20, 120)), lang])
    for i in range(0, n, 9):
        words = out[i][1].split(" ")
        words[len(words) // 2] = "changed"
        out.append([n + i, " ".join(words), out[i][2]])
        out.append([n + i + 1, out[i][1], out[i][2]])
    return out


ODD = [[9001, None, "en"], [9002, "", None], [9003, " \t\n", "en"], [9004, "x", None], [9005, "word " * 3000, "en"], [9006, "日本 ж 🙂 <|endoftext|> Σς", "de"], [9007, "1234 !!", "fr"], [9008, "same text twice", "en"], [9008, "same text twice", "en"]]


def table(spark, data):
    """Documents with two more columns whose names results use too."""
    return spark.createDataFrame([(*r, "s", len(r[1] or ""), 0.5, "clash") for r in data], KIND)


def empty(spark):
    return spark.createDataFrame([], KIND)
