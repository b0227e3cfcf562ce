import random

from pyspark.sql import functions as F

from leafmill.llm.truncation import cut_shares, cut_texts, length_spikes

SENTENCES = ["The nurse checks the weight of every child twice a day.", "Store the ampoules below thirty degrees away from light.", "Missed doses are taken as soon as remembered but never doubled.", "Refer without delay if the fever lasts longer than two days."]
LINES = ["- cold-chain register", "## Danger signs", "See also: Follow-up", "Revision 4"]


def corpus():
    rng = random.Random(4)
    rows = []
    for k in range(400):
        parts = [rng.choice(SENTENCES) for _ in range(rng.randrange(2, 8))]
        text = " ".join(parts) + "\n\n" + rng.choice(LINES) + ("" if k % 2 else "\n\n" + rng.choice(SENTENCES))
        rows.append((k, text, "whole", False))
    for k in range(400, 600):
        text = " ".join(rng.choice(SENTENCES) for _ in range(9))[:200]
        rows.append((k, text, "limited", text[-1] != "."))
    for k in range(600, 640):
        text = " ".join(rng.choice(SENTENCES) for _ in range(4))
        text = text[: rng.randrange(100, 180)]
        rows.append((k, text, "fax", text[-1] != "."))
    for k in range(640, 700):
        rows.append((k, " ".join(rng.choice(SENTENCES) for _ in range(2)).rstrip("."), "sms", False))
    rows += [(800, None, "fax", False), (801, "", "fax", False), (802, " \n ", "fax", False), (803, "The nurse checks the weig�", "fax", True), (804, "| a | b |\n| 1 | 2 |", "fax", False), (805, SENTENCES[0] * 5000, None, False)]
    return rows


def test_cut_texts_against_the_truth(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, b, c, 0) for a, b, c, _ in rows], "id long, text string, src string, key int").withColumn("shape", F.lit(1))
    got = {r.id: r.reason for r in cut_texts(df, "id", "text", "src").collect()}
    want = {a for a, _, _, cut in rows if cut}
    complete_words = {a for a, b, _, cut in rows if cut and any(s.startswith(b[b.rfind(". ") + 2 :].strip()) and b[-1] == " " for s in SENTENCES)}
    assert set(got) - want == set()
    assert len(want - set(got) - complete_words) <= 0.03 * len(want)
    assert {got[k] for k in got if 400 <= k < 600} == {"limit"}
    shares = {r.src: (r.texts, r.cut_texts) for r in cut_shares(df, "id", "text", "src").collect()}
    assert shares["whole"] == (400, 0) and shares["sms"] == (60, 0) and shares[None] == (1, 0)


def test_spikes(spark):
    rows = [("a", 100 + k % 37, 100 + k % 37) for k in range(300)] + [("a", 200, 200)] * 40 + [("b", 5, 6)] * 3
    got = {tuple(r) for r in length_spikes(spark.createDataFrame(rows, "source string, chars int, bytes int")).collect()}
    assert got == {("a", "chars", 200), ("a", "bytes", 200)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, text string, src string")
    assert cut_texts(df, "id", "text", "src").count() == 0 and cut_shares(df, "id", "text", "src").count() == 0


def test_a_repeated_cut_is_no_whole_line(spark):
    """Cuts soon after a line's start repeat; neither they nor a text delivered again are whole lines."""
    asks = ["Q: What should the nurse check on day 3?", "Q: What should the family watch for at home?", "Q: Where is the register of the ward kept?"]
    rows = [(k, f"{SENTENCES[k % 4]} {SENTENCES[k % 3]}\n{asks[k % 3]}\nA: {SENTENCES[k % 4]}\n- cold-chain register\n{SENTENCES[k % 2]}", "a") for k in range(60)]
    cuts = {100 + k: f"{SENTENCES[k % 4]}\n{end}" for k, end in enumerate(["Q: Wh", "Q: What should", "A:"] * 5)}
    cuts |= {200: f"{SENTENCES[1]}\nThe panel judged"}
    whole = {300 + k: f"{SENTENCES[k % 4]}\n- cold-chain register" for k in range(4)}
    limited = {400 + k: f"{SENTENCES[0][: 43 - k % 2]}{'.' * (k % 2)}\nQ: What should" for k in range(12)}
    rows += [(k, t, "a") for k, t in (cuts | whole).items()] + [(200, cuts[200], "a")] * 3 + [(k, t, "b") for k, t in limited.items()]
    df = spark.createDataFrame(rows, "id long, text string, src string")
    got = {r.id: r.reason for r in cut_texts(df, "id", "text", "src").collect()}
    assert set(got) == set(cuts) | set(limited)
    assert {got[k] for k in limited} == {"limit"}


def test_no_line_clears_a_text_at_a_spike(spark):
    rows = [(k, f"{SENTENCES[k % 4]}{' Good.' * (k % 9)}", "a") for k in range(90)] + [(100 + k, "See also: Foll", "b") for k in range(12)]
    df = spark.createDataFrame(rows, "id long, text string, src string")
    assert {(r.id, r.reason) for r in cut_texts(df, "id", "text", "src").collect()} == {(100 + k, "limit") for k in range(12)}


def test_limits_do_not_depend_on_the_number_of_texts(spark):
    """The same limits from a tenth of the texts; chance alone gives none."""
    rng = random.Random(7)
    rows = [(s, n, n) for s, most in (("a", 400), ("b", 900)) for n in (min(most, int(rng.gauss(0.8 * most, 0.2 * most))) for _ in range(1500)) if n > 0]
    rows += [("c", n, n) for n in (rng.randrange(100, 700) for _ in range(3000))]
    want = {("a", "chars", 400), ("a", "bytes", 400), ("b", "chars", 900), ("b", "bytes", 900)}
    for part in (rows, rows[::10]):
        got = {tuple(r) for r in length_spikes(spark.createDataFrame(part, "source string, chars int, bytes int")).collect()}
        assert got == want


def test_digests_see_whole_lines_and_words(spark):
    """A very long line and clashing column names; a context reaches over no line break."""
    long = "word " * 20000
    rows = [(1, long + "end.", "a", 1), (2, "One two\nthree fo", "a", 1), (3, "One two\rthree fo", "a", 1), (4, "Figures 12 and 4.", "a", 1)]
    df = spark.createDataFrame(rows, "key long, text string, source string, digest int")
    assert {r.key for r in cut_texts(df, "key", "text", "source").collect()} == {2, 3}
