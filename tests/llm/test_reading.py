import random

import numpy as np

from ordinalis.llm import reading
from ordinalis.llm.langid import fit

EASY = ["The cat sat on the mat.", "It is a big dog.", "We like to run and play.", "Do you see the red ball?", "Mum has a hat."]
MIDDLE = ["A nervous cat can easily hide under the sofa when visitors come to the house.", "The foster family was happy to share a quiet corner with the older dog.", "Try to feed it at the same time every morning because a routine helps."]
HARD = ["Experience from earlier adoption drives suggests that families return animals less frequently when somebody visits them, whereas punishment usually makes matters worse.", "Although most complaints are resolved informally, the coordinator ought to be informed about the expenses that arise in the first year."]
HARDEST = ["Notwithstanding the comparatively favourable prognosis associated with early intervention, clinicians reported substantial heterogeneity in postoperative convalescence, attributable predominantly to inconsistent analgesic administration.", "Pharmacokinetic extrapolation from canine populations remains methodologically indefensible, considering the pronounced hepatic glucuronidation deficiency characteristic of domesticated felids."]


def corpus(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(240):
        band = 1 + k % 4
        text = ""
        while len(text.split()) < 60:
            text += " " + rng.choice((EASY, MIDDLE, HARD, HARDEST)[band - 1])
        rows.append((k, text, "en" if k % 5 else None, "src", "clash"))
        labels += [(k, f"rater_{r}", band) for r in "ab"] if k // 4 % 2 else []
    rows += [(900, None, "en", "src", ""), (901, "", "en", "src", ""), (902, "too short", "en", "src", ""), (903, "Kami jumpa anak kucing ini di tepi sungai dan bawa balik ke rumah. " * 8, "en", None, ""), (None, rows[0][1], "en", "src", ""), (904, rows[0][1] * 800, None, None, "")]
    labels += [(1, "rater_a", None), (None, "rater_a", 2), (5, "rater_a", 99), (1, "rater_a", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string"), spark.createDataFrame(labels, "doc_id long, rater string, band int")


def test_levels(spark):
    documents, labels = corpus(spark)
    levels = reading.reading_levels(documents, labels)
    got = {r.doc_id: r.band for r in levels.collect()}
    assert set(got) == {*range(240), 904}
    held_out = [k for k in range(240) if k // 4 % 2 == 0]
    assert np.mean([got[k] == 1 + k % 4 for k in held_out]) >= 0.9 and set(got.values()) <= {1, 2, 3, 4}
    shares = reading.profile(documents, levels).collect()
    assert sum(r.n_docs for r in shares) == 241


def test_empty_inputs(spark):
    documents, labels = corpus(spark)
    assert reading.reading_levels(documents.limit(0), labels).count() == 0
    assert reading.reading_levels(documents, labels.limit(0)).count() > 0


def test_rarity_counts_all_words(spark):
    letters = "abcdefghij"
    rare = ["r" + "".join(letters[int(d)] for d in f"{k:06}") for k in range(150_000)]
    rows = [(" ".join(rare[k : k + 1000]),) for k in range(0, len(rare), 1000)] + [("common " * 40_000,)] * 100 + [("twice twice " + "five " * 5,), (None,)]
    rarity = reading.corpus_rarity(spark.createDataFrame(rows, "text string"))
    total = 4_150_007
    assert abs(rarity("common") + np.log(4_000_000 / total)) < 1e-9 and abs(rarity("five") + np.log(5 / total)) < 1e-9
    assert all(abs(rarity(w) + np.log(reading.LEAST_SHARE)) < 1e-9 for w in ("twice", "absent", *rare[::5000]))
    assert len(rarity.hashes) == 2  # what is sent out is bounded by the least share


def test_features_do_not_depend_on_the_cache():
    rarity = reading.Rarity(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
    scores = fit([(t, "en") for t in EASY + MIDDLE + HARD + HARDEST])
    texts = [" ".join(part) for part in (EASY, MIDDLE, HARD, HARDEST, EASY)]
    wide, narrow = reading.WordFacts(rarity, scores), reading.WordFacts(rarity, scores, most=3)
    for t in texts:
        x, y = (reading.features(reading.Reading(t, f)) for f in (wide, narrow))
        assert len(x) == reading.FEATURES and np.array_equal(x, y)
    many = " ".join("x" + chr(97 + k % 26) + chr(97 + k // 26 % 26) + chr(97 + k // 676) for k in range(5000))
    assert reading.Reading(many, wide).facts.shape == (5000, 10) and (reading.Reading(many, narrow).facts == reading.Reading(many, wide).facts).all()
    assert reading.Reading("", wide).english() == 0 and reading.Reading("12 !? 34", wide).english() == 0
