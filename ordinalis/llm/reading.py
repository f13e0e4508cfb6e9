"""Problem 9: reading level, by regularised ordinal regression over features of the text.

Features are lexical diversity, word rarity against the whole corpus, connectives, a proxy of clause depth, and lengths of words and
sentences, with quantiles and the shares of a plain grid over the sentences because documents mix simple and demanding ones. A
proportional-odds model maps them to the bands of the graded sample. All text is read by the executors: the driver sees the feature
rows of the graded sample and the counts of words that make up a millionth of the corpus or more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordinalis.llm.langid import WordScores, fit_on
from ordinalis.session import cut

#: Most graded documents used for the fit, words a task counts before it passes them on, shortest text in words, least share of English.
GRADED, HELD, MIN_WORDS, ENGLISH = 12_000, 200_000, 40, 0.85

#: The smallest share of the corpus that is told apart from smaller ones. At most 1 / LEAST_SHARE words have it, 16 bytes each, which
#: bounds what is broadcast whatever the corpus.
LEAST_SHARE = 1e-6

#: A sentence counts as foreign only if its words prefer another language by more than this.
SLACK = 2.0

# English words that join sentences, open clauses, or refer to persons.
CONNECTIVES = frozenset("however therefore moreover furthermore although though whereas nevertheless nonetheless consequently thus hence notwithstanding inasmuch insofar considering despite unless because since while yet so and but or then".split())
HARD_CONNECTIVES = frozenset("however therefore moreover furthermore although whereas nevertheless nonetheless consequently thus hence notwithstanding inasmuch insofar considering despite irrespective pursuant thereof herein wherein whereby".split())
SUBORDINATORS = frozenset("that which who whom whose where when while because although though if unless until since whereas before after whether so as than".split())
PERSONS = frozenset("i you he she it we they me him her us them my your his our their its mum dad".split())

_WORD = re.compile(r"[a-z]+(?:['’-][a-z]+)*")
_END = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|\n+|<br>")


class Rarity:
    """Minus the log share of a word in the corpus, by 64-bit hash; a word that is not listed has LEAST_SHARE."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int) -> None:
        order = np.argsort(hashes)
        self.hashes, self.counts, self.total = hashes[order], counts[order], max(total, 1)

    def __call__(self, word: str) -> float:
        h = hashed(word)
        at = int(np.searchsorted(self.hashes, h))
        known = at < len(self.hashes) and self.hashes[at] == h
        return -float(np.log(max(self.counts[at] / self.total, LEAST_SHARE) if known else LEAST_SHARE))


def hashed(word: str) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


_VOWELS = re.compile(r"[aeiouy]+")
#: Columns of the facts of a word.
LENGTH, RARE, SYLLABLES, CONNECTS, HARD, CLAUSE, PERSON, EN, MS, DE = range(10)


class WordFacts:
    """Per word its length, rarity, syllables, the lists it stands on and its language scores, as rows of a table that is filled as words
    come up and begun anew when it holds ``most`` of them."""

    def __init__(self, rarity: Rarity, scores: WordScores, most: int = 200_000) -> None:
        self.rarity, self.scores, self.most = rarity, scores, most
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, 10))

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.at) + len(words) > max(self.most, len(words)):
            self.at = {}
        at = [self.at[w] if w in self.at else self._add(w) for w in words]  # may replace the table
        return self.table[np.array(at, np.int64)]

    def _add(self, word: str) -> int:
        k = self.at[word] = len(self.at)
        if k >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[k] = (len(word), self.rarity(word), len(_VOWELS.findall(word)), word in CONNECTIVES, word in HARD_CONNECTIVES, word in SUBORDINATORS, word in PERSONS, *self.scores.score(word))
        return k


class Reading:
    """A text cut into sentences and words, with the facts of its words."""

    def __init__(self, text: str, facts: WordFacts) -> None:
        self.low = text.lower()
        self.words: list[str] = []
        self.firsts, self.letters, self.marks, self.wordless = [], [], [], 0
        for s in _END.split(self.low):
            w = _WORD.findall(s)
            letters = sum(map(str.isalpha, s))
            if w:
                self.firsts.append(len(self.words))
                self.words += w
                self.letters.append(letters)
                self.marks.append(s.count(",") + 2 * s.count(";"))
            elif letters >= 8:
                self.wordless += letters
        self.facts = facts.rows(self.words)
        self.sums = np.add.reduceat(self.facts, self.firsts, axis=0) if self.words else self.facts

    def english(self) -> float:
        """Share of letters that stand in sentences whose words speak for English rather than another language or script."""
        letters = np.array(self.letters, float)
        letters[letters < 8] = 0
        whole = letters.sum() + self.wordless
        if not whole:
            return 0.0
        said = self.sums[:, [EN, MS, DE]]
        speaks = (2 * self.sums[:, LENGTH] > letters) & (said[:, 0] >= said.max(axis=1) - SLACK)
        return float((letters * speaks).sum() / whole)


def _quantiles(table: np.ndarray, shares: list[float]) -> np.ndarray:
    """Linear quantiles of every column, one after another."""
    ordered = np.sort(table, axis=0)
    place = np.array(shares) * (len(ordered) - 1)
    low = place.astype(int)
    part = (place - low)[:, None]
    return (ordered[low] * (1 - part) + ordered[np.minimum(low + 1, len(ordered) - 1)] * part).ravel()


#: The grid of sentences: mean letters of a word in steps of 0.75, times words of the sentence in steps of 6.
LETTER_GRID, WORD_GRID = np.arange(3.5, 8.1, 0.75), np.arange(8.5, 21, 6)
CELLS = (len(LETTER_GRID) + 1) * (len(WORD_GRID) + 1)


def features(reading: Reading) -> np.ndarray:
    """The feature vector of a text with words."""
    words, table, sums = reading.words, reading.facts, reading.sums
    n, sentences = len(words), len(reading.firsts)
    length, rare, syllables = table[:, LENGTH], table[:, RARE], table[:, SYLLABLES]
    sizes = np.diff([*reading.firsts, n]).astype(float)
    long_share = np.add.reduceat((length >= 9).astype(float), reading.firsts) / sizes
    mean_length = sums[:, LENGTH] / sizes
    weight = sizes / n
    quart = _quantiles(np.column_stack([sizes, mean_length, long_share, sums[:, RARE] / sizes]), [0.15, 0.5, 0.85])
    cell = np.searchsorted(LETTER_GRID, mean_length) * (len(WORD_GRID) + 1) + np.searchsorted(WORD_GRID, sizes)
    window = 40
    kinds = [len(set(part)) / len(part) for i in range(0, max(1, n - window // 2), window // 2) if (part := words[i : i + window])]
    low, means = reading.low, table[:, CONNECTS : PERSON + 1].mean(axis=0)
    return np.concatenate(
        [
            [np.log1p(n), np.log(n / sentences), length.mean(), length.std(), (length >= 7).mean(), (length >= 10).mean(), (length >= 13).mean()],
            [syllables.mean(), (syllables >= 4).mean(), (syllables <= 1).mean(), rare.mean(), _quantiles(rare[:, None], [0.9])[0], (rare > 10).mean()],
            [sum(kinds) / len(kinds), len(set(words)) / np.sqrt(n), sums[:, CLAUSE].mean(), sum(reading.marks) / sentences, low.count(",") / n, sum(map(low.count, ";:()")) / n],
            means, quart, np.bincount(cell, weight, CELLS),
        ]
    )


FEATURES = 19 + 4 + 12 + CELLS


class OrdinalModel:
    """Proportional odds: P(band <= k) = sigmoid(cut_k - w.x), with an L2 penalty, over standardised features and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 20.0, steps: int = 600) -> None:
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._design(x)
        n, d = z.shape
        self.w, cuts = np.zeros(d), np.array([-1.5, 0.0, 1.5])
        free = np.array([cuts[0], np.log(cuts[1] - cuts[0]), np.log(cuts[2] - cuts[1])])
        m, v = np.zeros(d + 3), np.zeros(d + 3)
        sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -35, 35)))
        for t in range(1, steps + 1):
            c = np.array([free[0], free[0] + np.exp(free[1]), free[0] + np.exp(free[1]) + np.exp(free[2])])
            eta = z @ self.w
            up = np.where(y <= 3, sigmoid(c[np.minimum(y, 3) - 1] - eta), 1.0)
            lo = np.where(y >= 2, sigmoid(c[np.maximum(y, 2) - 2] - eta), 0.0)
            p = np.maximum(up - lo, 1e-9)
            du, dl = up * (1 - up) / p, lo * (1 - lo) / p
            g_eta = du - dl
            g_c = np.zeros(3)
            for k in range(3):
                g_c[k] = -du[y == k + 1].sum() + dl[y == k + 2].sum()
            g = np.concatenate([z.T @ g_eta / n + penalty * self.w / n, np.array([g_c.sum(), (g_c[1] + g_c[2]) * np.exp(free[1]), g_c[2] * np.exp(free[2])]) / n])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.05 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.w, free = self.w - step[:d], free - step[d:]
        self.cuts = np.array([free[0], free[0] + np.exp(free[1]), free[0] + np.exp(free[1]) + np.exp(free[2])])

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -4, 4)
        return np.concatenate([z, z * z - 1], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.w

    def bands(self, x: np.ndarray) -> np.ndarray:
        return 1 + np.searchsorted(self.cuts, self.score(x)).astype(np.int32)


def corpus_rarity(documents: DataFrame, text: str = "text") -> Rarity:
    """Exact counts of the words of all documents; those with LEAST_SHARE or more reach the driver, a bounded number."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        part = lambda: pd.DataFrame({"h": np.array([hashed(w) for w in seen], np.int64), "n": np.array(list(seen.values()), np.int64)})
        for batch in batches:
            for t in batch["txt"]:
                seen.update(_WORD.findall(t.lower()))
                if len(seen) >= HELD:
                    yield part()
                    seen.clear()
        yield part()

    rows = cut(documents.where(F.col(text).isNotNull()).select(F.col(text).alias("txt")).mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = rows.where(F.col("n") >= total * LEAST_SHARE).toPandas()
    return Rarity(often["h"].to_numpy(np.int64), often["n"].to_numpy(np.int64), total)


def graded_documents(documents: DataFrame, labels: DataFrame, sample: int = GRADED) -> DataFrame:
    """(doc_id, text, band) of at most ``sample`` graded documents, those with the smallest hashes; the band is the median judgement,
    each rater's repeats counting once and ties going to the lower band; null bands and ids do not count."""
    graded = labels.where("doc_id is not null and band between 1 and 4").select("doc_id", "rater", "band").distinct().groupBy("doc_id").agg(F.expr("percentile(band, 0.5)").alias("median"))
    graded = graded.select("doc_id", F.ceil(F.col("median") - 0.5).cast("int").alias("band")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return documents.where("text is not null").join(F.broadcast(graded), "doc_id").select("doc_id", "text", "band")


def english_texts(rows: DataFrame, key: str, schema: str, rarity: Rarity, scores: WordScores, finish) -> DataFrame:
    """What ``finish`` makes of a batch's (``key`` and other columns, their matrix of features), over the English documents of ``rows`` with
    at least MIN_WORDS words between white space."""
    sent = rows.sparkSession.sparkContext.broadcast((rarity, scores))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        facts = WordFacts(*sent.value)
        for batch in batches:
            use, made = [], []
            for t in batch["text"]:
                reading = Reading(t, facts) if len(t.split()) >= MIN_WORDS else None
                use.append(reading is not None and reading.english() >= ENGLISH)
                if use[-1]:
                    made.append(features(reading))
            if made:
                yield finish(batch[use], np.stack(made))

    return rows.where(F.col(key).isNotNull() & F.col("text").isNotNull()).mapInPandas(run, schema)


def fit(graded: pd.DataFrame) -> OrdinalModel:
    """The model of the graded features; of none, one that calls everything band 2."""
    if not len(graded):
        return OrdinalModel(np.zeros((1, FEATURES)), np.array([2]), steps=1)
    graded = graded.sort_values("doc_id", kind="stable")
    return OrdinalModel(np.stack(graded["x"]), graded["band"].to_numpy(np.int64))


def reading_levels(documents: DataFrame, labels: DataFrame, *, sample: int = GRADED) -> DataFrame:
    """(doc_id, band, score) of every English document with at least MIN_WORDS words between white space.

    Null, empty, short and foreign texts have no row. Band runs from 1 (easiest) to 4, score is the position on the model's scale.
    """
    scores = fit_on(documents, "doc_id", "text", "lang")
    rarity = corpus_rarity(documents)
    graded = graded_documents(documents, labels, sample).repartition(32, "doc_id")
    known = english_texts(graded, "doc_id", "doc_id long, band int, x array<double>", rarity, scores, lambda rows, x: rows[["doc_id", "band"]].assign(x=list(x)))
    model = fit(known.toPandas())
    grade = lambda rows, x: rows[["doc_id"]].assign(band=model.bands(x), score=model.score(x))
    return english_texts(documents.select("doc_id", "text"), "doc_id", "doc_id long, band int, score double", rarity, scores, grade)


def profile(documents: DataFrame, levels: DataFrame) -> DataFrame:
    """(source, band, n_docs, share) over the documents that have a level; a null source is its own row."""
    counts = documents.select("doc_id", "source").join(levels, "doc_id").groupBy("source", "band").agg(F.count("*").alias("n_docs"))
    return counts.withColumn("share", F.col("n_docs") / F.sum("n_docs").over(W.partitionBy("source")))
