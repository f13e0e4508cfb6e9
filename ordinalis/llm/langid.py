"""Problem 6: the language of every text and of every stretch of it.

Script ranges narrow the candidates of each word (Han without kana means zh, Tamil means ta, Latin leaves en, ms and de, told apart by
word scores with a trigram fallback; any other script means a language not known here, ``und``); a Viterbi pass over the words with a
penalty for switching, small between sentences and large inside one, labels the stretches. A stretch in Latin script whose words are
mostly unknown is ``und`` too, rather than the least wrong of three. Contact details, mark-up, numbers and handles are blanked before,
so they start no stretch. The word scores are fitted on a bounded sample of labelled rows; as labels are unreliable, the sample is
relabelled sentence by sentence and counted again.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalis.llm.pii import detect
from ordinalis.sources.tables import canonical_id

LANGS = ("en", "ms", "zh", "ta", "de")
#: A language that is none of these; the last state of the Viterbi pass.
UNKNOWN = "und"
STATES = (*LANGS, UNKNOWN)
LATIN = ("en", "ms", "de")
#: At most this many labelled rows are used to fit the word scores; they are those with the smallest hashes.
SAMPLE = 6000
#: So many of them calibrate the confidence.
CALIBRATION = 1500
#: Penalties for a switch between and inside sentences, and the length from which texts are judged.
BETWEEN, INSIDE, MIN_CHARS = 4.0, 14.0, 20
#: What the words of a stretch must add up to in favour of its language.
EVIDENCE = 3.0
#: A Latin stretch of at least so many words is of an unknown language if less than this share of them is known.
STRETCH, KNOWN = 6, 0.3
#: Words of the shortest sentence in Latin script that can stand between two of another script.
SENTENCE = 4

# Frequent function words that anchor the fit where labels are few or wrong.
ANCHORS = {
    "en": "the a an and is are was were to of in on at with for from by she he it we they my his her our their this that who not but so if be been has have had will can would all very one as or no you your its when what".split(),
    "ms": "yang dan di ke untuk dengan ini itu saya kami ada tidak sudah akan dari pada ialah seekor ekor anak kucing anjing atau oleh boleh dia mereka tetapi sangat suka sekali lagi kalau bila tak dah sgt utk dgn je jgn juga hari semua masih sahaja kepada".split(),
    "de": "der die das und ist ein eine einen einem einer mit von für nicht wir sie er es ihr ihre im am auf den dem des hat haben sucht bitte sehr aus zu zum zur nach bei wegen noch schon nur auch wird werden kann sich seit".split(),
}

FUNCTION = frozenset().union(*ANCHORS.values())

_STOPS = re.compile(r"(?<![.!?。！？…])[.!?。！？…]+(?=\s|$|[^\x00-\x7f])|\n|<br>|[。！？]")
_NOISE = re.compile(r"<[^<>]*>|https?://\S+|www\.\S+|[@#]\w+|(?<![^\s>])\S*\d\S*|&\w+;")
# Ranges of Han, kana and Tamil in Unicode. Hangul and the private use area lie between the first and the last of Han.
_HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_KANA = "぀-ヿㇰ-ㇿｦ-ﾟ"
_TAMIL = "஀-௿"
_JOINERS = "‌‍"
_ELSE = rf"[^\W\d_{_HAN}{_KANA}{_TAMIL}]"
_PIECE = re.compile(rf"[{_HAN}{_KANA}]+|[{_TAMIL}{_JOINERS}]+|{_ELSE}+(?:['’-]{_ELSE}+)*")
_OF_HAN, _OF_KANA, _OF_TAMIL, _OF_LATIN = (re.compile(f"[{r}]") for r in (_HAN, _KANA, _TAMIL + _JOINERS, "a-zA-ZªºÀ-ɏḀ-ỿＡ-Ｚａ-ｚ"))


def _kind(piece: str) -> str:
    c = piece[0]
    if _OF_LATIN.match(c):
        return "latin"
    if _OF_KANA.search(piece):
        return "other"
    return "zh" if _OF_HAN.match(c) else "ta" if _OF_TAMIL.match(c) else "other"


def pieces(text: str) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, word, script, begins a sentence) of the words that can tell a language.

    Words of another script count only in sentences that hold more letters of it than of the known ones. Han in a sentence with kana is
    Japanese and counts as another script.
    """
    hidden = text
    if found := detect(text):
        parts, at = [], 0
        for _, a, b in found:
            parts += [text[at:a], " " * (b - a)]
            at = b
        hidden = "".join([*parts, text[at:]])
    blank = _NOISE.sub(lambda m: m.group() if m.group() == "<br>" else (re.sub(r"[\x21-\x7e]", " ", m.group()) if not m.group().isascii() else " " * len(m.group())), hidden)
    stops = [m.end() for m in _STOPS.finditer(blank)]
    blank = blank.replace("<br>", "    ")
    out, k, fresh, others = [], 0, True, False
    for m in _PIECE.finditer(blank):
        while k < len(stops) and stops[k] <= m.start():
            k, fresh = k + 1, True
        script = _kind(m.group())
        others = others or script == "other"
        out.append((m.start(), m.end(), m.group().lower(), script, fresh))
        fresh = False
    return _weigh_others(out) if others else out


def _weigh_others(words: list[tuple[int, int, str, str, bool]]) -> list[tuple[int, int, str, str, bool]]:
    starts = [0, *(k for k in range(1, len(words)) if words[k][4]), len(words)]
    out = []
    for a, b in zip(starts, starts[1:], strict=False):
        part = words[a:b]
        if any(_OF_KANA.search(w[2]) for w in part):
            part = [(*w[:3], "other" if w[3] == "zh" else w[3], w[4]) for w in part]
        letters = sum(len(w[2]) if w[3] == "other" else -len(w[2]) for w in part)
        kept = [w for w in part if letters > 0 or w[3] != "other"]
        out += [(*w[:4], k == 0) for k, w in enumerate(kept)]
    return out


class WordScores:
    """Log-likelihoods of words under the Latin-script languages, relative to the best one, and a trigram fallback."""

    def __init__(self, counts: dict[str, Counter]) -> None:
        totals = {lang: sum(counts[lang].values()) + 50.0 for lang in LATIN}
        self.words: dict[str, tuple[float, ...]] = {}
        grams: dict[str, Counter] = {lang: Counter() for lang in LATIN}
        for w in set().union(*counts.values()):
            logs = [math.log((counts[lang][w] + 0.1) / totals[lang]) for lang in LATIN]
            best = max(logs)
            n = sum(counts[lang][w] for lang in LATIN)
            weight = n / (n + 3.0)
            self.words[w] = tuple(max(weight * (x - best), -5.0) for x in logs)
            for lang in LATIN:
                if c := counts[lang][w]:
                    for i in range(len(w)):
                        grams[lang][f"^{w}$"[i : i + 3]] += math.log1p(c)
        whole = {lang: sum(grams[lang].values()) + 100.0 for lang in LATIN}
        self.leads, self.rates = np.zeros(0), np.zeros(0)
        self.grams = {}
        for g in set().union(*grams.values()):
            logs = [math.log((grams[lang][g] + 0.5) / whole[lang]) for lang in LATIN]
            self.grams[g] = tuple(x - max(logs) for x in logs)

    def sure(self, lead: float) -> float:
        """The confidence in a language that leads the next best one by so much."""
        if len(self.leads):
            return float(np.interp(lead, self.leads, self.rates))
        return float(1 / (1 + np.exp(-np.clip(lead, -30.0, 30.0))))

    def score(self, word: str) -> tuple[float, ...]:
        if (known := self.words.get(word)) is not None:
            return known
        seen = [self.grams[g] for i in range(len(word)) if (g := f"^{word}$"[i : i + 3]) in self.grams]
        if len(seen) < 2:
            return (0.0, 0.0, 0.0)
        sums = [sum(x) for x in zip(*seen, strict=True)]
        return tuple(max(0.5 * (x - max(sums)), -1.5) for x in sums)


def calibrate(scores: WordScores, parsed: list[tuple[list[list[str]], str]], bins: int = 40) -> None:
    """Fit the confidence: how often the beginning of a sentence, of 1, 2, 4, 8 words or the whole, points at the language of its text, by
    the lead of the best language over the next, as a rising line through bins of equal size. Only texts count whose label and words
    agree on their language; with fewer than 100 beginnings the confidence stays the logistic function of the lead."""
    leads, right = [], []
    for said, label in parsed:
        if label not in LATIN or not said:
            continue
        k = LATIN.index(label)
        table = [np.array([scores.score(w) for w in s]) for s in said]
        if sum(t.sum(axis=0) for t in table).argmax() != k:
            continue
        for t in table:
            for n in {1, 2, 4, 8, len(t)}:
                if n <= len(t):
                    sums = t[:n].sum(axis=0)
                    leads.append(sums.max() - np.sort(sums)[-2])
                    right.append(sums.argmax() == k)
    if len(leads) < 100:
        return
    order = np.argsort(leads, kind="stable")
    parts = [(x.mean(), (y.sum() + 1) / (len(y) + 2), len(y)) for x, y in zip(np.array_split(np.array(leads)[order], bins), np.array_split(np.array(right, float)[order], bins), strict=True)]
    pooled: list[list[float]] = []
    for x, rate, n in parts:  # neighbours that fall are pooled
        pooled.append([x, rate, n])
        while len(pooled) > 1 and pooled[-2][1] > pooled[-1][1]:
            x2, r2, n2 = pooled.pop()
            x1, r1, n1 = pooled.pop()
            pooled.append([(x1 * n1 + x2 * n2) / (n1 + n2), (r1 * n1 + r2 * n2) / (n1 + n2), n1 + n2])
    scores.leads, scores.rates = np.array([p[0] for p in pooled]), np.array([p[1] for p in pooled])


def emissions(word: str, script: str, scores: WordScores) -> tuple[float, ...]:
    """One value per language of STATES."""
    if script == "latin":
        en, ms, de = scores.score(word)
        return (en, ms, -1.2, -1.2, de, -1.2)
    if script == "other":
        cost = -min(1.0 * len(word), 6.0)
        return (cost, cost, cost, cost, cost, 0.0)
    cost = -min(1.5 * len(word), 8.0) if script == "zh" else -min(1.0 * len(word), 6.0)
    return tuple(0.0 if lang == script else cost for lang in STATES)


def _whole_sentences(text: str, words: list[tuple[int, int, str, str, bool]], rows: list[tuple[float, ...]]) -> None:
    """Raise the evidence of sentences wholly in one script, so that one between two of another language can be a stretch.

    A Chinese one counts all its characters. One in Latin script counts as much as two switches cost, if it has at least SENTENCE words,
    a function word among them, and no blanked detail: contact lines and addresses are no sentences.
    """
    starts = [0, *(k for k in range(1, len(words)) if words[k][4]), len(words)]
    for a, b in zip(starts, starts[1:], strict=False):
        script = words[a][3]
        if any(w[3] != script for w in words[a:b]):
            continue
        if script == "zh":
            rows[a:b] = [tuple(0.0 if lang == "zh" else -1.5 * len(w[2]) for lang in STATES) for w in words[a:b]]
        elif script == "latin" and b - a >= SENTENCE and any(w[2] in FUNCTION for w in words[a:b]):
            ends = [*(w[0] for w in words[a + 1 : b]), words[b][0] if b < len(words) else len(text)]
            if not any(c.isalnum() for w, end in zip(words[a:b], ends, strict=True) for c in text[w[1] : end]):
                cost = min(-1.2, -(2 * BETWEEN + 1) / (b - a))
                rows[a:b] = [(en, ms, cost, cost, de, cost) for en, ms, _, _, de, _ in rows[a:b]]


def _absorb(path: list[int], rows: list[tuple[float, ...]]) -> None:
    """Stretches with too little of their own language are no stretches: they join the one before, or else the one after."""
    edges = [0, *(k for k in range(1, len(path)) if path[k] != path[k - 1]), len(path)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a < len(path) and sum(max(rows[k][path[a]] - max(x for s, x in enumerate(rows[k]) if s != path[a]), 0.0) for k in range(a, b)) < EVIDENCE:
            path[a:b] = [path[a - 1] if a else path[b]] * (b - a)


def _best_path(words: list[tuple[int, int, str, str, bool]], rows: list[tuple[float, ...]], table: np.ndarray) -> list[int]:
    """The state of every word on the best path.

    If no other state leads the best single state by half a switch in any stretch of words, no path with k switches, so at most k + 1
    other stretches, can win back what its switches cost, and the whole text is one stretch.
    """
    states = range(len(STATES))
    first = int(table.sum(axis=0).argmax())
    lead = np.cumsum(table - table[:, first : first + 1], axis=0)
    least = np.minimum.accumulate(np.concatenate([np.zeros((1, len(STATES))), lead[:-1]]), axis=0)
    if (lead - least).max() < BETWEEN / 2:
        return [first] * len(words)
    now = list(rows[0])
    back: list[list[int]] = []
    for k in range(1, len(words)):
        lead = max(states, key=now.__getitem__)
        jump = now[lead] - (BETWEEN if words[k][4] else INSIDE)
        back.append([s if now[s] >= jump else lead for s in states])
        now = [max(now[s], jump) + rows[k][s] for s in states]
    state = max(states, key=now.__getitem__)
    path = [state]
    for step in reversed(back):
        state = step[state]
        path.append(state)
    path.reverse()
    _absorb(path, rows)
    return path


def spans(text: str | None, scores: WordScores) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the maximal stretches in one language; none for texts without words.

    The confidence is calibrated on the lead of the stretch's language over the next best one, from the stretch's own words (see
    ``calibrate``); that of ``und`` in Latin script is the share of unknown words.
    """
    words = pieces(text) if text else []
    if not words:
        return []
    rows = [emissions(w, script, scores) for _, _, w, script, _ in words]
    _whole_sentences(text, words, rows)
    table = np.array(rows)
    path = _best_path(words, rows, table)
    edges = [0, *(k for k in range(1, len(path)) if path[k] != path[k - 1]), len(path)]
    out: list[tuple[int, int, str, float]] = []
    for a, b in zip(edges, edges[1:], strict=False):
        sums = table[a:b].sum(axis=0)
        lang = STATES[path[a]]
        gap = sums[path[a]] - np.delete(sums, path[a]).max()
        sure = scores.sure(gap)
        if lang in LATIN and b - a >= STRETCH:
            known = sum(w[2] in scores.words for w in words[a:b]) / (b - a)
            if known < KNOWN:
                lang, sure = UNKNOWN, 1 - known
        if out and out[-1][2] == lang:
            out[-1] = (out[-1][0], words[b - 1][1], lang, max(out[-1][3], sure))
        else:
            out.append((words[a][0], words[b - 1][1], lang, sure))
    return out


def fit(texts: list[tuple[str, str]], rounds: int = 3) -> WordScores:
    """Word scores from (text, label) rows; labels outside LATIN count for nothing in the first round, later rounds relabel all."""
    return fit_sentences([(sentences(t), label) for t, label in texts if t], rounds)


def sentences(text: str) -> list[list[str]]:
    """The words in Latin script of every sentence; what follows a word of another script inside a sentence tells nothing."""
    out, now, foreign = [], [], False
    for _, _, w, script, fresh in pieces(text):
        if fresh:
            if now:
                out.append(now)
            now, foreign = [], False
        if script != "latin":
            foreign, now = True, []
        elif not foreign:
            now.append(w)
    return [*out, now] if now else out


def fit_sentences(parsed: list[tuple[list[list[str]], str]], rounds: int = 3) -> WordScores:
    counts = {lang: Counter({w: 40 for w in ANCHORS[lang]}) for lang in LATIN}
    for said, label in parsed:
        if label in LATIN:
            for sentence in said:
                counts[label].update(sentence)
    scores = WordScores(counts)
    for _ in range(rounds):
        counts = {lang: Counter({w: 3 for w in ANCHORS[lang]}) for lang in LATIN}
        for said, _ in parsed:
            for sentence in said:
                sums = [sum(x) for x in zip(*map(scores.score, sentence), strict=True)]
                order = sorted(range(3), key=lambda s: -sums[s])
                if sums[order[0]] - sums[order[1]] > 3.0:
                    counts[LATIN[order[0]]].update(sentence)
        scores = WordScores(counts)
    calibrate(scores, parsed[:CALIBRATION])
    return scores


def fit_on(rows: DataFrame, key: str, text: str, label: str, *, sample: int = SAMPLE) -> WordScores:
    """Fit on the ``sample`` labelled rows with the smallest hashes of their keys; their words are found by the executors, and only
    these reach the driver."""
    known = rows.where(F.col(label).isin(*LANGS) & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(label).alias("l"), F.xxhash64(key, text).alias("h"))
    picked = known.orderBy("h", "t", "l").limit(sample).repartition(32, "h").select("t", "l")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"t": batch["t"], "l": batch["l"], "s": ["\n".join(" ".join(s) for s in sentences(t)) for t in batch["t"]]})

    made = picked.mapInPandas(parse, "t string, l string, s string").select("s", "l").toPandas().sort_values(["s", "l"]).sample(frac=1.0, random_state=0)
    return fit_sentences([([line.split(" ") for line in s.split("\n") if line], label) for s, label in made.itertuples(index=False)])


def language_spans(rows: DataFrame, key: str, text: str, scores: WordScores, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """(rec, run_no, first, last, lang, confidence, n_runs) per maximal stretch of each text with at least ``min_chars`` characters.

    Null, empty and short texts, and texts without any word in a known script, have no rows. Positions are code points.
    """
    sent = rows.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rec, t in zip(batch["rec"], batch["txt"], strict=True):
                if t and len(t) >= min_chars:
                    found = spans(t, sent.value)
                    out += [(rec, k, a, b, lang, sure, len(found)) for k, (a, b, lang, sure) in enumerate(found, 1)]
            yield pd.DataFrame(out, columns=["rec", "run_no", "first", "last", "lang", "confidence", "n_runs"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("rec"), F.col(text).alias("txt")).where("rec is not null and txt is not null").mapInPandas(run, f"rec {kind}, run_no int, first int, last int, lang string, confidence double, n_runs int")


def relabelled(train: DataFrame) -> DataFrame:
    """(petid, run_no, first, last, lang, confidence, n_runs, label) of every listing."""
    rows = train.select(F.struct(canonical_id("PetID").alias("petid"), F.col("lang").alias("label")).alias("rec"), "Description").distinct()
    rows = rows.where("rec.petid is not null")
    scores = fit_on(train.select("PetID", "Description", "lang").distinct(), "PetID", "Description", "lang")
    packed = rows.select(F.to_json("rec").alias("rec"), "Description")
    found = language_spans(packed, "rec", "Description", scores)
    names = F.from_json("rec", "petid string, label string")
    return found.withColumn("rec", names).select("rec.petid", "run_no", "first", "last", "lang", "confidence", "n_runs", "rec.label")


def found(train: DataFrame) -> DataFrame:
    """(petid, run_no, lang) of the records whose label is not the language of their text, or whose text has several. Stretches in a
    language that is not one of LANGS are not listed, but they count as a language of their text."""
    wrong = (F.col("n_runs") > 1) | F.coalesce(F.col("label") != F.col("lang"), F.lit(True))
    return relabelled(train).where(wrong & (F.col("lang") != UNKNOWN)).select("petid", "run_no", "lang").distinct()


def documents(train: DataFrame) -> DataFrame:
    """(petid, lang, confidence, n_langs): one row per record with a text; the language of most of its characters, ties by name, and the
    mean confidence of that language's stretches times its share of the characters. Records without judgeable words are ``und``, with
    a confidence of 0. Several texts of one record count together."""
    runs = relabelled(train).select("petid", "lang", (F.col("last") - F.col("first")).alias("n"), "confidence").distinct()
    per = runs.groupBy("petid", "lang").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("confidence"))).alias("sure"))
    best = per.groupBy("petid").agg(F.max_by(F.struct("lang", "sure"), F.struct("n", "lang")).alias("b"), F.sum("n").alias("all"), F.count("*").alias("n_langs"))
    every = train.where("Description is not null").select(canonical_id("PetID").alias("petid")).where("petid is not null").distinct()
    return every.join(best, "petid", "left").select("petid", F.coalesce("b.lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("b.sure") / F.col("all"), F.lit(0.0)).alias("confidence"), F.coalesce("n_langs", F.lit(0)).alias("n_langs"))
