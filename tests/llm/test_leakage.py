import itertools
import random
import re
import unicodedata

from leafmill.functions.lookalike import fold_text
from leafmill.llm.leakage import leaked_items

DOCS, ITEMS = "doc long, text string, item int", "item long, passage string, doc int"


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, 0) for x in docs], DOCS)
    i = spark.createDataFrame([(*x, 0) for x in items], ITEMS)
    return {(r.d, r.i) for r in leaked_items(d.withColumnRenamed("doc", "d"), "d", "text", i.withColumnRenamed("item", "i"), "i", "passage", **kw).collect()}


def plain(text):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFC", fold_text(text)).lower())


def brute(docs, items, least=10):
    out = set()
    for d, t in docs:
        body = " " + " ".join(plain(t)) + " " if t else ""
        for i, p in items:
            words = [" ".join(plain(w)) for w in (p or "").split() if plain(w)]
            if any(f" {' '.join(words[k : k + least])} " in body for k in range(len(words) - least + 1)):
                out.add((d, i))
    return out


def test_forms_of_the_same_passage(spark):
    p = "A 7-month-old baker from Tarkimar was brought to a clinic near Queskiba after six nights"
    docs = [(1, f"See: {p}."), (2, p.upper().replace(" ", "\n")), (3, p.replace("a", "а").replace(" ", " ")), (4, " ".join(p.split()[:9])), (5, " ".join(p.split()[2:12])), (6, None), (7, ""), (8, p.replace("baker", "cook")), (1, f"See: {p}."), (9, "x " * 50_000 + p)]
    assert leaks(spark, docs, [(1, p)]) == {(1, 1), (2, 1), (3, 1), (5, 1), (8, 1), (9, 1)} == brute(docs, [(1, p)])


def test_against_brute_force_with_shared_phrases(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(25))) for i in range(8)]
    docs = []
    for d in range(150):
        words = [rng.choice(vocabulary) for _ in range(40)]
        if rng.random() < 0.6:
            p = rng.choice(items)[1].split()
            k, n = rng.randrange(10), rng.choice([8, 9, 10, 11, 15])
            words[5:5] = p[k : k + n]
        docs.append((d, " ".join(words)))
    assert leaks(spark, docs, items) == brute(docs, items)


def test_nothing_to_find(spark):
    assert leaks(spark, [], [(1, "a b c d e f g h i j k")]) == set()
    assert leaks(spark, [(1, "a b c d e f g h i j k")], []) == set()
    assert leaks(spark, [(1, "a b c d e f g h i j k")], [(1, "a b c"), (2, None), (3, "")]) == set()
    assert list(itertools.chain(leaks(spark, [(1, "a b c d e f g h i j k")], [(1, "a b c d e f g h i j k")]))) == [(1, 1)]
