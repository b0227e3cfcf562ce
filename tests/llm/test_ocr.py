import itertools
import math
import random

from pyspark.sql import functions as F

from leafmill.llm import ocr
from leafmill.llm.digests import word_digest

SENTENCES = ["The clinical officer should refer without delay when fever lasts longer than 14 days.", "Store the ampoules below thirty degrees and protect them from light.", "Give 250 mg twice-daily for 10 days and write the result on the chart.", "Supervision visits verify that every midwife can repeat the observation."]
TITLE, SHORT = "Regional handbook for marsh fever, edition 1", "REG-MF-1H"


def test_layout():
    text = "REG-MF-1H\nA plain li-\n17\nne of text.\nMarsh fever handbook - edition 1 | 17\n\nDose (mg)\n17\n25\nper intake\nPage 17\n| 17 | 18 |"
    body, header, pageno = ocr.read_layout(text, 17, TITLE, SHORT)
    assert header and pageno
    assert [t for line in body for t in line] == ["A", "plain", "li-" + ocr.BREAK + "ne", "of", "text.", "Dose", "(mg)", "17", "25", "per", "intake", "|", "17", "|", "18", "|"]


def test_layout_keeps_body_lines():
    for line in ("uncomplicated marsh fever.", "longer than 17 days.", "Severe marsh fever is suspected whenever", "17 tablets"):
        assert ocr.read_layout(line, 17, TITLE, SHORT) == ([line.split()], False, False)
    assert ocr.read_layout("REG-MF-1H", None, None, None)[1:] == (False, False)


def test_misread_headers_and_page_forms():
    for line in ("Marsh fcver handbook - edltion 1", "REGIONAL HANDBOOK FOR MARSH FEVER", "17   Reglonal handbook for marsh fever", "REG-MF-1H ........ 17"):
        assert ocr.read_layout(line, 17, TITLE, SHORT)[1], line
    for line in ("17", "- 17 -", "– 17 –", "[17]", "p. 17", "Page 17", "page 17 of 150", "17 / 150"):
        assert ocr.read_layout("Text.\n" + line, 17, TITLE, SHORT)[2], line
    for line in ("18", "page 18 of 17", "117"):
        assert not ocr.read_layout("Text.\n" + line, 17, TITLE, SHORT)[2], line


def test_confusions():
    for seen, meant in {"fcver": "fever", "†es†": "test", "wliether": "whether", "recluced": "reduced", "retum": "return", "bl0od": "blood", "1oss": "loss"}.items():
        assert ocr.confusions(seen, meant), seen
    for seen, number in {"1O": "10", "l4": "14", "5O0": "500"}.items():
        assert ocr.figures_meant(seen)[0] == number
    assert ocr.figures_meant("G6PD") is None and ocr.figures_meant("14") is None and ocr.confusions("cat", "dog") is None
    # any number of them, in words of any length
    assert ocr.confusions("rninirnurn" * 9, "minimum" * 9) == ("rn=m",) * 27
    assert ocr.confusions("l", "i") == ("l=i",)


def test_counts_beyond_misreadings():
    assert ocr.beyond(7.0, 7.0) == 0.0 and ocr.beyond(500.0, 1.0) > 480.0
    options = [[("the", 0.0)], [("lie", 0.0), ("he", 1.0)], [("down", 0.0)]]
    counts = {("the", "lie"): 40.0, ("the", "he"): 50.0, ("he", "down"): 1.0, ("lie", "down"): 40.0}
    assert ocr.true_bigrams(options, counts)["the", "lie"] > 30.0
    assert ocr.true_bigrams(options, counts | {("the", "lie"): 1.0})["the", "lie"] == 0.0
    n = {"the": 900.0, "lie": 40.0, "he": 3000.0, "down": 90.0}
    assert ocr.viterbi(options, ocr.true_bigrams(options, counts), n, 9000.0, None) == [0, 0, 0]


def test_viterbi_is_exact():
    rng = random.Random(1)
    words = ["a", "b", "c", "d"]
    for _ in range(60):
        options = [[(rng.choice(words), rng.randrange(3)) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 5))]
        bigrams = {(x, y): float(rng.randrange(0, 9)) for x in words for y in words}
        counts = {w: float(rng.randrange(1, 40)) for w in words}

        def score(path, options=options, bigrams=bigrams, counts=counts):
            total, before = 0.0, "a"
            for o, i in zip(options, path, strict=True):
                w, k = o[i]
                p = (counts.get(w, 0) + 0.1) / 101.0
                total += math.log((bigrams.get((before, w), 0) + ocr.SMOOTH * p) / (counts.get(before, 0) + ocr.SMOOTH)) + k * math.log(ocr.CONFUSION_P)
                before = w
            return total

        best = max(itertools.product(*(range(len(o)) for o in options)), key=score)
        got = ocr.viterbi(options, bigrams, counts, 100.0, "a")
        assert math.isclose(score(got), score(best), rel_tol=1e-9)


def records():
    rng = random.Random(6)
    rows = [("chunk", f"c{k}", "D", 3, " ".join(rng.choice(SENTENCES) for _ in range(4))) for k in range(200)]
    rows += [
        ("images", "hyphen", "D", 3, "The clini-\ncal officer should refer without delay."),
        ("images", "soft", "D", 3, "Supervision vi­\r\nsits verify that every midwife can repeat."),
        ("images", "own", "D", 3, "Give 250 mg twice-\ndaily for 10 days."),
        ("images", "misread", "D", 3, "Store tlie ampou1es below thirty degrees."),
        ("images", "figure", "D", 3, "Give 25O mg twice-daily for 1O days."),
        ("images", "header", "D", 3, "REG-MF-1H\nStore the ampoules below thirty degrees."),
        ("images", "pageno", "D", 3, "Store the ampoules below\n- 3 -\nthirty degrees."),
        ("images", "both", "D", 3, "3   Reglonal handbook for marsh fever\nStore the am-\npoules below thirty degrees."),
        ("images", "null", "D", 3, None),
        ("images", "empty", "D", 3, ""),
        ("images", "unknown", None, None, "Store the ampoules below thirty degrees."),
        ("images", "long", "D", 3, (SENTENCES[0] + "\n\n") * 3000),
    ]
    return rows + rows[-12:]


WANT = {("hyphen", "hyphen"), ("soft", "hyphen"), ("misread", "misread"), ("figure", "misread"), ("header", "header"), ("pageno", "pageno"), ("both", "header"), ("both", "pageno"), ("both", "hyphen")}


def test_repair(spark):
    df = spark.createDataFrame([(*r, 0) for r in records()], "rec_table string, rec_id string, doc_id string, page int, text string, title int")
    guides = spark.createDataFrame([("D", TITLE, SHORT), ("E", None, None)], "doc_id string, title string, short_name string")
    done = ocr.repair(df, guides).cache()
    assert {(r.rec_id, r.noise_kind) for r in ocr.noise_kinds(done).collect()} == WANT
    text = {r.rec_id: r.repaired for r in done.collect()}
    assert text["hyphen"] == "The clinical officer should refer without delay."
    assert text["own"] == "Give 250 mg twice-daily for 10 days."
    assert text["misread"] == text["header"] == text["pageno"] == text["both"] == "Store the ampoules below thirty degrees."
    assert text["figure"] == "Give 250 mg twice-daily for 10 days."
    assert text["long"] == "\n\n".join([SENTENCES[0]] * 3000)
    assert len(text) == 210


def test_empty_tables(spark):
    df = spark.createDataFrame([], "rec_table string, rec_id string, doc_id string, page int, text string")
    guides = spark.createDataFrame([], "doc_id string, title string, short_name string")
    assert ocr.repair(df, guides).count() == 0


def test_mostly_misread_and_long_headers():
    line = "Regionol handbaok for morsh fever"
    assert ocr.read_layout(f"17   {line}\nText.", 17, TITLE, SHORT)[1:] == (True, True)
    title = "Regional handbook for the prevention, recognition, treatment and referral of marsh fever in children and pregnant women, second revised edition"
    assert len(title) > 120 and ocr.read_layout(f"{title} | 17\nText.", 17, title, SHORT)[1:] == (True, True)
    assert not ocr.read_layout("Marsh fever in children is treated without delay at the nearest health post. " * 3, 17, title, SHORT)[1]


def test_repeated_confusions():
    assert ocr.confusions("ciinicai", "clinical") == ("i=l", "i=l")


def test_spellings_meet(spark):
    pairs = [("ciinicai", "clinical"), ("fcver", "fever"), ("wliether", "whether"), ("recluced", "reduced"), ("retum", "return"), ("revievv", "review"), ("ſor", "for"), ("vi5i†s", "visits")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(ocr.spread(F.col("a")) == ocr.spread(F.col("b"))).count() == len(pairs)


def test_digest_is_that_of_sql(spark):
    words = ["fever", "", "sévère", "a" * 100, "<num>"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.d % 2**64 for r in df.select("w", F.xxhash64("w").alias("d")).collect()} == {w: word_digest(w) for w in words}


def test_a_real_word_beside_its_look_alike_stays(spark):
    """`ear` and `car` may be misread for each other, but the corpus writes both; `eai` it doesn't."""
    rows = [("chunk", f"a{k}", "D", 3, "The nurse looks into the ear of the child. The family comes by car to the ward.") for k in range(300)]
    rows += [("chunk", "odd", "D", 3, "The family comes by ear to the ward."), ("chunk", "even", "D", 3, "The nurse looks into thc ear of the chi1d.")]
    df = spark.createDataFrame(rows, "rec_table string, rec_id string, doc_id string, page int, text string")
    guides = spark.createDataFrame([("D", TITLE, SHORT)], "doc_id string, title string, short_name string")
    text = {r.rec_id: r.repaired for r in ocr.repair(df, guides).collect()}
    assert text["a7"] == rows[7][4] and text["even"] == "The nurse looks into the ear of the child."
    assert text["odd"] == "The family comes by car to the ward."
    told = ocr.decisions(df, guides).first()
    assert told.choices >= told.changed >= 2
    assert {(r.rec_id, r.noise_kind) for r in ocr.found_noise(df, guides).collect()} == {("odd", "misread"), ("even", "misread")}


def test_text_of_every_record(spark):
    df = spark.createDataFrame(records(), "rec_table string, rec_id string, doc_id string, page int, text string")
    guides = spark.createDataFrame([("D", TITLE, SHORT)], "doc_id string, title string, short_name string")
    got = [(r.rec_id, r.repaired) for r in ocr.continuous_text(df, guides).collect()]
    assert len(got) == len(dict(got)) == 212 and {r[1] for r in records()} == set(dict(got))
    assert dict(got)["null"] is None and dict(got)["empty"] == ""
