"""Pointer sort against sorted strings, counts against a plain count, and the audit against its definition."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from appfacts.llm import source_audit
from appfacts.llm.bytehash import LOWER
from appfacts.llm.source_audit import audit_sources, count_terms, sort_pointers, term_pointers

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def terms_of(text):
    return TERM.findall((text or "").translate(FOLD))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, term string, n string")


def test_pointer_sort():
    pick = random.Random(3)
    words = ["".join(pick.choices("ab", k=pick.randint(1, 40))) for _ in range(500)] + ["é" * 50, "é" * 50, "x" * 5000, "x" * 5000, "x" * 4999]
    data = LOWER[np.frombuffer(" ".join(words).encode(), np.uint8)]
    starts, sizes = term_pointers(data, np.array([0, len(data)]))
    order, run = sort_pointers(data, starts, sizes)
    got = [data[starts[i] : starts[i] + sizes[i]].tobytes() for i in order]
    assert got == sorted(w.encode() for w in words)
    assert all((a == b) == (r == s) for a, b, r, s in zip(got, got[1:], run, run[1:], strict=False))


def brute_counts(rows):
    n, held = Counter(), Counter()
    for _, text, lang, source, *_ in rows:
        found = Counter(terms_of(text))
        for t, k in found.items():
            n[lang or "", source or "", t] += k
            held[lang or "", source or "", t] += 1
    return n, held


def test_counts(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "SHARD_BYTES", 2000)
    pick = random.Random(5)
    rows = []
    for i in range(60):
        text = " ".join(pick.choice(["Aa", "b", "ça", "Été", "x1y", "long" * 30, "-"]) for _ in range(pick.choice([0, 3, 50, 900])))
        rows.append((i, text, pick.choice(["en", None, ""]), pick.choice(["s", "t", None]), "t", "n"))
    rows += [(90, None, "en", "s", "", ""), (91, "", "en", "s", "", ""), (92, "w" * 30_000, "en", "s", "", ""), rows[0], rows[0]]
    got = count_terms(table(spark, rows)).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("d"))
    n, held = brute_counts(rows)
    assert {(r.lang, r.source, r.term): (r.n, r.d) for r in got.collect()} == {k: (n[k], held[k]) for k in n}


def brute_audit(rows, least=10, top=10):
    n, held = brute_counts(rows)
    docs = Counter()
    for (lang, _, t), d in held.items():
        docs[lang, t] += d
    groups = defaultdict(set)
    for _, _, lang, source, *_ in rows:
        groups[lang or ""].add(source or "")
    out = set()
    for lang, sources in groups.items():
        kept = [t for (g, t), d in docs.items() if g == lang and d >= least]
        v, p = len(kept), {}
        for s in [*sources, None]:
            count = {t: sum(n[lang, x, t] for x in ([s] if s is not None else sources)) for t in kept}
            total = sum(count.values())
            p[s] = {t: (1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * v), count[t]) for t in kept}
        for s in sources:
            pairs = [(-sum((p[s][t][0] - p[q][t][0]) ** 2 // (p[s][t][0] + p[q][t][0]) for t in kept), q.encode()) for q in sources - {s}]
            told = [(-((p[s][t][0] - p[None][t][0]) ** 2 // (p[s][t][0] + p[None][t][0])), t.encode()) for t in kept if p[s][t][1] and p[s][t][0] > p[None][t][0]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(told)[:top])):
                out |= {(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


def test_audit(spark):
    pick = random.Random(7)
    words = ["the", "The", "été", "tea", "ß", "zz", "rare", "c" * 20, "c" * 21]
    rows = []
    for i in range(160):
        source = pick.choice(["a", "b", "é", None, "only"])
        lang = "xx" if source == "only" else pick.choice(["en", "en", "de", None])
        weights = [3, 1, 2 + (source == "a"), 1, 1 + (source == "b"), 1, 0.05, 1, 1]
        rows.append((i, " ".join(pick.choices(words, weights, k=pick.randint(0, 12))), lang, source, "t", "n"))
    rows += [(500, None, "silent", "a", "", ""), (501, "", "silent", "b", "", ""), (502, "once", None, "c", "", ""), rows[3], rows[3]]
    got = [tuple(r) for r in audit_sources(table(spark, rows)).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows)
    assert {r for r in got if r[0] == "silent"} == {("silent", "a", "pair", "b", 0, 1), ("silent", "b", "pair", "a", 0, 1)}
    assert audit_sources(table(spark, [])).count() == 0
