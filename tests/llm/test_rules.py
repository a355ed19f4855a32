"""op13_rules: counts against patterns, distances against a plain version of the steps, junk rejected and prose kept."""

import random
import re

import numpy as np
import pytest

from strandline.llm import rules

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, distance string, g int, x0 double"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    held = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(held), n < 50 or 100 * len(held) > 50 * n


def prose(r, n):
    out = []
    for k in range(n):
        w = "".join(r.choice(["th", "an", "e", "ré", "o", "ing", "s"]) for _ in range(r.randint(1, 5)))
        out.append((w.capitalize() if k % 9 == 0 else w) + (". " if k % 9 == 8 else " ") + ("\n" if k % 27 == 26 else ""))
    return "".join(out)


def corpus(seed=1, n=260):
    r = random.Random(seed)
    rows = [(i, prose(r, r.randint(55, 300)), r.choice(["en", "en", "fr", None]), r.choice(["a", "a", "a", "b", None])) for i in range(n)]
    rows += [(1000 + i, " ".join(f"{w}{r.choice(['$$$', '%%', '***'])}" for w in prose(r, 90).split()), "en", "a") for i in range(8)]
    rows += [(2000 + i, prose(r, 120).upper().replace(" ", "!! "), "fr", "a") for i in range(4)]
    line = prose(r, 26).replace("\n", " ")
    rows += [(3000, "\n".join([line] * 9), "en", "a"), (3001, None, "en", "a"), (3002, "", None, None), (3003, " \t\n ", "en", "b"), rows[0], (None, rows[1][1], "en", "a")]
    rows += [(4000 + i, prose(r, 80), "de", f"only{i}") for i in range(3)]  # languages too small for an estimate
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "q", "w", 1, 2.5) for r in rows], SCHEMA)


def plain(rows):
    """Distances by (doc_id, text) from numpy, one group after another."""
    xs = {k: np.rint(np.array(rules.measures(r[1] or "")[1]) * rules.SCALE) / rules.SCALE for k, r in enumerate(rows)}
    passed = [k for k, r in enumerate(rows) if not counts(r[1])[5]]
    out = {}
    for k, (i, text, lang, source) in enumerate(rows):
        own = [m for m in passed if rows[m][2:] == (lang, source)]
        same = [m for m in passed if rows[m][2] == lang]
        held = next((g for g in (own, same, passed) if len(g) >= rules.LEAST), None)
        key = (i, text or "")
        if held is None:
            out[key] = None
            continue
        gap = xs[k] - 0
        mean, inv = estimate(tuple(held), xs)
        out[key] = float((gap - mean) @ inv @ (gap - mean))
    return out


def estimate(held, xs, seen={}):  # noqa: B006
    if (key := (held, len(xs))) in seen:
        return seen[key]
    x = np.array([xs[m] for m in held])
    coarse = np.fix(x * rules.SCALE / rules.COARSE)
    q = [np.sort(coarse, axis=0)[int(np.ceil(s * len(x) - 1e-9)) - 1] * rules.COARSE / rules.SCALE for s in (0.25, 0.5, 0.75)]
    floors = np.diag(np.square(rules.FLOORS))
    mean, inv = q[1], np.linalg.inv(np.diag(np.maximum((q[2] - q[0]) / 1.349, rules.FLOORS) ** 2))

    def d2():
        return np.einsum("ni,ij,nj->n", x - mean, inv, x - mean)

    def fit(some, factor):
        return some.mean(0), np.linalg.inv(factor * np.cov(some.T, bias=True) + floors)

    for _ in range(rules.STEPS):
        bins = np.minimum(np.floor(np.log1p(d2()) * rules.PER_E), rules.BINS - 1)
        below = np.array([(bins < b).sum() for b in bins])
        mean, inv = fit(x[below < rules.KEPT_SHARE * len(x)], rules.consistency(rules.KEPT_SHARE))
    seen[key] = fit(x[d2() <= rules.chi_square(rules.REWEIGHT, rules.SIZE)], rules.consistency(rules.REWEIGHT))
    return seen[key]


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_counts_distances_and_verdicts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(rules, "BROADCAST_GROUPS", broadcast)
    rows = corpus()
    got = rules.judge(table(spark, rows)).collect()
    text = {r[0]: r[1] for r in rows}
    want = plain(rows)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        t = text[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(t)
        far = want[(r.doc_id, t or "")]
        assert (r.distance is None) == (far is None) and (far is None or abs(r.distance - far) < 1e-6 * (1 + far))
        assert r.kept == (not r.base_failed and not (far is not None and far > rules.LIMIT))
    kept = {r.doc_id for r in got if r.kept}
    assert kept.isdisjoint(range(1000, 2010)) and {i for i, *_ in rows if i is not None and i < 1000 or i in (4000, 4001, 4002)} <= kept


def test_rows_dealt_otherwise_give_the_same(spark):
    rows = corpus(2, 150)
    a, b = ({(r.doc_id, r.n_words): r.distance for r in rules.judge(table(spark, rows).repartition(n)).collect()} for n in (1, 7))
    assert a == b


def test_small_and_empty_tables(spark):
    assert rules.judge(table(spark, [])).collect() == []
    r = random.Random(5)
    got = rules.judge(table(spark, [(i, prose(r, 70), None, None) for i in range(5)] + [(9, None, None, None)])).collect()
    assert sorted((x.doc_id, x.kept, x.distance) for x in got) == [(i, True, None) for i in range(5)] + [(9, False, None)]


def test_repeated_words_of_a_long_text():
    words = [b"w%d" % (k % 50_000) for k in range(120_000)]
    assert rules.repeated_words(words) == 120_000
    assert rules.repeated_words(words[:50_000]) == 0
    r = random.Random(1)
    for _ in range(300):
        w = [r.choice("ab") for _ in range(r.randint(0, 12))]
        assert rules.repeated_words([x.encode() for x in w]) == counts(" ".join(w))[4]


def test_quantiles_of_chi_square():
    assert abs(rules.chi_square(0.975, 7) - 16.0128) < 1e-3 and abs(rules.chi_square(0.5, 2) - 1.386294) < 1e-5
