import random
import time

import pytest

from ordinalis.llm import langid

EN = ["The shelter found a small cat near the river and took it home.", "She is very friendly with children but not with other dogs.", "We can deliver the cage to your house on Sunday."]
MS = ["Kami jumpa anak kucing ini di tepi sungai dan bawa balik ke rumah.", "Dia sangat manja dengan kanak-kanak tetapi takut kepada anjing.", "Boleh datang ke rumah kami pada hari Ahad untuk melihat kucing."]
DE = ["Wir haben die kleine Katze neben dem Fluss gefunden und nach Hause gebracht.", "Mit Kindern ist sie sehr lieb, vor anderen Hunden hat sie Angst.", "Bitte schreiben Sie uns, wenn Sie eine ruhige Familie sind."]
ZH, TA = "它最喜欢吃鸡肉，也喜欢玩纸箱。请不要整天把它关在笼子里。", "இதன் தாய் விபத்தில் இறந்துவிட்டது, குட்டிகள் மட்டுமே உள்ளன."


@pytest.fixture(scope="module")
def scores():
    return langid.fit([(t, lang) for lang, ts in (("en", EN), ("ms", MS), ("de", DE)) for t in ts * 3] + [(ZH, "zh"), (EN[0], "ms")])


@pytest.mark.parametrize(("text", "want"), [(" ".join(EN), ["en"]), (" ".join(MS), ["ms"]), (" ".join(DE), ["de"]), (ZH, ["zh"]), (TA, ["ta"]), (f"{EN[0]} {ZH} {EN[1]}", ["en", "zh", "en"]), (f"{MS[0]} {MS[1]} {EN[0]} {EN[1]}", ["ms", "en"]), (f"Kampung Lupu {ZH} Call 016-107 5658", ["zh"]), ("", []), (None, []), ("12345 😺 !!! -- 678 90 @name", [])])
def test_spans(scores, text, want):
    found = langid.spans(text, scores)
    assert [s[2] for s in found] == want
    assert all(0 <= a < b <= len(text) and 0 < c <= 1 for a, b, _, c in found)


def test_found(spark):
    rows = [(f"{k:x}", t, "en") for k, t in enumerate(EN * 4)] + [(f"1{k:x}", t, "ms") for k, t in enumerate(MS * 4)] + [(f"2{k:x}", t, "de") for k, t in enumerate(DE * 4)]
    rows += [("AA", ZH, "en"), ("ab", f"{EN[0]} {EN[1]} {ZH}", "en"), ("ac", " ".join(EN), None), ("ad", " ".join(EN), ""), ("ae", "short", None), ("af", None, "en"), (None, ZH, "en"), ("AA", ZH, "en"), ("b0", ZH * 4000, "zh")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "PetID string, Description string, lang string, run_no int")
    got = sorted(map(tuple, langid.found(df).collect()))
    z = lambda s: s.rjust(9, "0")
    assert got == [(z("aa"), 1, "zh"), (z("ab"), 1, "en"), (z("ab"), 2, "zh"), (z("ac"), 1, "en"), (z("ad"), 1, "en")]
    assert langid.found(df.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "want"), [(f"{EN[0]} 它最喜欢吃新鲜的鸡肉。 {EN[1]}", ["en", "zh", "en"]), (f"{ZH} She is very friendly. {ZH}", ["zh", "en", "zh"]), (f"{EN[0]} 小花 {EN[1]}", ["en"]), (f"{ZH} Kampung Lupu Taman Sri. {ZH}", ["zh"]), (f"{ZH} Please call us at 016-107 5658. {ZH}", ["zh"])])
def test_whole_sentences_in_the_middle(scores, text, want):
    assert [s[2] for s in langid.spans(text, scores)] == want


@pytest.mark.parametrize(("text", "want"), [
    ("Мы нашли маленькую кошку у реки и взяли её домой.", ["und"]),
    ("この猫はとても人懐っこいです。よろしくお願いします。", ["und"]),
    ("이 고양이는 아이들과 잘 지냅니다.", ["und"]),
    ("القطة الصغيرة تحب الأطفال كثيرا", ["und"]),
    (f"{ZH} Мы нашли маленькую кошку у реки и взяли её домой.", ["zh", "und"]),
    (f"{EN[0]} кит cat {EN[1]}", ["en"]),
    ("La petite chatte adore dormir près du feu quand arrivent les longues soirées pluvieuses", ["und"]),
    ("Nuestra perrita busca hogar donde pueda correr libremente junto al campo", ["und"]),
    ("豈有此理，這隻貓很可愛，請聯絡我們。", ["zh"]),
])
def test_other_languages_are_not_one_of_ours(scores, text, want):
    assert [s[2] for s in langid.spans(text, scores)] == want


def test_one_language_only_in_the_fit():
    scores = langid.fit([(t, "en") for t in EN * 5])
    for text in ("La petite chatte adore dormir près du feu quand arrivent les longues soirées pluvieuses", "Nuestra perrita busca hogar donde pueda correr libremente junto al campo"):
        assert [s[2] for s in langid.spans(text, scores)] == ["und"]


@pytest.mark.parametrize("unit", ["a-", "a ", "....", "x1", "<", "&a", "字。", "b@"])
def test_long_runs_take_linear_time(scores, unit):
    began = time.time()
    langid.spans(unit * (200_000 // len(unit)) + " end", scores)
    assert time.time() - began < 8


def test_documents(spark):
    rows = [(f"{k:x}", t, "en") for k, t in enumerate(EN * 4)] + [("aa", f"{EN[0]} {ZH * 3}", None), ("ab", None, "en"), ("ac", "12345", "en"), ("ad", "Мы нашли маленькую кошку у реки и взяли её домой.", "en"), (None, EN[0], "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "PetID string, Description string, lang string, n_langs int")
    got = {r.petid.lstrip("0"): (r.lang, r.n_langs) for r in langid.documents(df).collect()}
    assert got["aa"] == ("zh", 2) and got["ac"] == ("und", 0) and got["ad"] == ("und", 1) and "ab" not in got and len(got) == 15
    assert all(0 <= r.confidence <= 1 for r in langid.documents(df).collect())
    assert langid.documents(df.limit(0)).count() == 0


def test_confidence_is_calibrated():
    """On words that point at each language with known odds, the confidence is the share of right answers."""
    rng = random.Random(3)
    vocabulary = {"en": [f"e{chr(97 + k)}n" for k in range(20)], "ms": [f"m{chr(97 + k)}s" for k in range(20)], "de": [f"d{chr(97 + k)}e" for k in range(20)]}

    def text(lang):
        other = rng.choice([x for x in vocabulary if x != lang])
        return " ".join(" ".join(rng.choice(vocabulary[lang if rng.random() < 0.7 else other]) for _ in range(6)).capitalize() + "." for _ in range(5))

    rows = [(text(lang), lang) for lang in vocabulary for _ in range(120)]
    scores = langid.fit(rows[::2])
    sure, right = [], []
    for t, lang in rows[1::2]:
        for s in langid.sentences(t):
            sums = [sum(x) for x in zip(*map(scores.score, s[:2]), strict=True)]
            order = sorted(sums)
            sure.append(scores.sure(order[-1] - order[-2]))
            right.append(sums.index(order[-1]) == langid.LATIN.index(lang))
    assert abs(sum(sure) / len(sure) - sum(right) / len(right)) < 0.06 and (scores.rates[1:] >= scores.rates[:-1]).all()
