"""Small tables."""

import random
import re

WORDS = {"en": "the of and to in is that it was for with as on at by".split(), "fr": "le la les des une que est dans pour qui sur pas plus avec".split()}


def prose(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "s", "ed" if lang == "en" else "ez"]) for _ in range(n))


def corpus(seed=1, n=120):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(["en", "fr"])
        rows.append((i, prose(r, lang, r.randint(20, 80)), lang, r.choice(["b", "a", "c", None])))
    for i in range(n, n + 40):  # near and exact copies
        words = rows[r.randint(0, 5)][1].split(" ")
        for _ in range(r.randint(0, 3)):
            words[r.randint(0, len(words) - 1)] = r.choice("xyz") * 3
        rows.append((i, r.choice([" ", "  ", "\n"]).join(words), "en", "a"))
    return rows + [(900, None, "en", "a"), (901, "", None, None), (902, " \n\t ", "fr", "b"), (903, "12 34 !!", "en", "c"), (904, "Word", "en", "a"), (905, "word", "en", "a"), (906, "two words", "en", "a")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "q", 1.5) for r in rows], "doc_id long, text string, lang string, source string, score string, size double")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])
