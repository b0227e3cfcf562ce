import random

import numpy as np
import pyarrow as pa

from leafmill.operators import quality, substrings


def test_words_of_any_length_are_found_in_one_pass(monkeypatch):
    monkeypatch.setattr(substrings, "BYTES", 50)
    rng = random.Random(5)
    letters = ["a", "b", "é", "τ", "​", " ", "😀"]
    made = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = ["", *(made(rng.randrange(120)) for _ in range(150)), "x" * 700]
    cut = [t[i : i + rng.randrange(1, 70)] for t in texts for i in [rng.randrange(len(t) + 1)]]
    words = sorted({w for w in [*cut, *(made(rng.randrange(1, 9)) for _ in range(100)), "x" * 512, "x" * 513, "x" * 701, "mg"] if w})
    bits, lengths = substrings.asked_bits(pa.array(words))
    bitmap = np.zeros(1 << (substrings.FILTER_BITS - 3), dtype=np.uint8)
    np.bitwise_or.at(bitmap, bits >> np.uint64(3), (1 << (bits & np.uint64(7))).astype(np.uint8))
    array = pa.array(["skipped", *texts]).slice(1)
    offsets, data = substrings.buffers(array)
    row, start, n = substrings.finds(data, offsets, bitmap, lengths.tolist())
    got = {(i, bytes(data[s : s + m]).decode(errors="replace")) for i, s, m in zip(row.tolist(), start.tolist(), n.tolist(), strict=True)}
    want = {(i, w) for i, t in enumerate(texts) for w in words if w in t}
    assert want <= got and {(i, w) for i, w in got if w in words} == want and len(got) < 2 * len(want)
    assert [len(x) for x in substrings.finds(*substrings.buffers(pa.array([], pa.string()))[::-1], bitmap, lengths.tolist())] == [0, 0, 0]


def test_a_space_of_many_words_is_not_searched_word_by_word(spark):
    rng = random.Random(6)
    words = [f"Dose of {a}{b} + {c} (mg)" for a in "abcdefghij" for b in "stuvwxyz" for c in ("αβ", "é", "ı")]
    items = spark.createDataFrame([(f"{d}{i}", d, i % 2, ["dose", w, None]) for d in "de" for i, w in enumerate(words)] + [("few", "f", 1, ["Dose", "x"])], "item string, doc string, page int, words array<string>")
    texts = [("d", i % 2, f"| {rng.choice(words).upper()} | {rng.choice(words)} |") for i in range(60)] + [("e", 0, words[0]), ("e", 1, None), ("f", 1, "DOSE")]
    spaces = spark.createDataFrame(texts, "doc string, page int, space string")
    held = quality.held_words(items, spaces, ["doc", "page"])
    asked = {(r.doc, r.page, w) for r in items.collect() for w in r.words if w}
    want = {(d, p, w) for d, p, w in asked if any((d, p) == (e, q) and t and w.lower() in t.lower() for e, q, t in texts)}
    got = [tuple(r) for r in held.collect()]
    assert set(got) == want and len(got) == len(want) > 40
    assert "MapInArrow" in held._jdf.queryExecution().toString()
