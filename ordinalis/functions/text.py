"""Text features as built-in column expressions; nothing leaves the JVM.

Patterns are meant as Python's Unicode-aware ``re`` reads them. Java and RE2 disagree with it on ``\\b`` and ``\\w`` beyond ASCII, so the
text is first brought to a form on which all agree: letters and digits outside ASCII become ``_`` (a word character everywhere), all
white space becomes a blank, and full-width digits become ASCII digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words, age units in months, keyword patterns and stop words of the feature set.
NUMBER_WORDS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "satu": 1, "dua": 2, "tiga": 3, "empat": 4, "lima": 5, "enam": 6, "half": 0.5,
}
AGE_UNITS = {"(?:weeks?|wks?|minggu)": 12 / 52, "(?:months?|mths?|mos?|bulan)": 1.0, "(?:years?|yrs?|tahun)": 12.0}
KEYWORDS = {
    "kw_cat": r"\b(?:cats?|kittens?|kitty|kitties|meow|kucing)\b",
    "kw_dog": r"\b(?:dogs?|pupp(?:y|ies)|pups?|doggy|anjing)\b",
    "kw_baby": r"\b(?:kittens?|pupp(?:y|ies)|pups?|babies|baby|newborn)\b",
    "kw_adult": r"\b(?:adult|senior|old (?:cat|dog)|elderly|mother cat|mama)\b",
    "kw_male": r"\b(?:male|boy|he|him|his|jantan)\b",
    "kw_female": r"\b(?:female|girl|she|her|betina)\b",
    "kw_pure": r"persian|siamese|british short ?hair|maine coon|bengal|ragdoll|scottish fold|husky|poodle|shih ?tzu|golden retriever|labrador|rottweiler|german shepherd|beagle|chihuahua|pomeranian|dachshund|terrier|schnauzer|corgi|pug|spitz|pure ?bre(?:e)?d|pedigree",
    "kw_mixed": r"\bmix(?:ed)?\b|cross ?breed|\blocal\b|domestic (?:short|medium|long)|\bdsh\b|kampung",
    "kw_vaccinated": r"vaccin|vacinat|jab|injection",
    "kw_dewormed": r"de-?worm",
    "kw_sterilized": r"spay|neuter|steril|castrat|desex",
    "kw_healthy": r"\bhealthy\b|\bhealth\b",
    "kw_sick": r"\bsick|injur|wound|blind|lame|limp|disease|virus|parvo|skin problem|fractur|paraly|surgery|vet",
    "kw_trained": r"toilet|litter|potty|house ?trained|obedien",
    "kw_friendly": r"friendly|playful|active|manja|affection|cute|adorable|lovely|sweet|gentle",
    "kw_rescued": r"rescu|abandon|stray|dump|found|street",
    "kw_fee": r"\bfee\b|\brm ?\d|\bcharge",
    "kw_free": r"\bfree\b|percuma",
    "kw_urgent": r"urgent|asap|immediately|pls|please",
    "kw_contact": r"call|whatsapp|\bwa\b|sms|contact|email|\bpm\b|text me",
    "kw_group": r"\b(?:them|siblings|litter|brothers|sisters|each|both|all of them)\b",
}
MALAY = r"\b(?:dan|untuk|yang|anak|ini|saya|ada|tak|nak|sangat|comel|dengan)\b"
COUNTED = "(?:kittens|puppies|pups|cats|dogs|siblings|babies|of them)"

# The number pattern and, in age_months and pet_count below, what may stand between a number and its unit.
NUMBER = r"(\d+(?:\.\d+)?|" + "|".join(NUMBER_WORDS) + ")"
SPACES = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def filled(text: Column | str) -> Column:
    """Null text counts as empty."""
    return F.coalesce(_c(text), F.lit(""))


def normalized(text: Column | str) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(filled(text)), SPACES + "+", " "))


def matchable(text: Column | str) -> Column:
    """The lower-cased form on which all regular-expression engines agree."""
    digits = F.translate(F.lower(filled(text)), "０１２３４５６７８９", "0123456789")
    return F.regexp_replace(F.regexp_replace(digits, SPACES, " "), r"[\p{L}\p{N}&&[^\x00-\x7F]]", "_")


def count(text: Column, pattern: str) -> Column:
    """Matches of ``pattern``, leftmost and not overlapping."""
    return F.regexp_count(text, F.lit(pattern))


def ratio(part: Column, text: Column) -> Column:
    return part / F.greatest(F.length(text), F.lit(1))


def meta_features(text: Column | str) -> dict[str, Column]:
    """Length, words, upper-case share, marks, digits, emptiness and the share outside ASCII."""
    t = filled(text)
    return {
        "desc_len": F.length(t).cast("long"),
        "desc_words": count(F.regexp_replace(t, SPACES, " "), r"\S+").cast("long"),
        "desc_upper_ratio": ratio(count(t, r"\p{IsUppercase}"), t),
        "desc_excl": count(t, "!").cast("long"),
        "desc_digits": count(t, r"\p{Nd}").cast("long"),
        "desc_is_empty": (F.trim(F.regexp_replace(t, SPACES, " ")) == "").cast("int"),
        "desc_non_ascii": ratio(count(t, r"[^\x00-\x7F]"), t),
    }


def keyword_features(low: Column, patterns: dict[str, str] = KEYWORDS) -> dict[str, Column]:
    """Counts per keyword group over a ``matchable`` text."""
    return {name: count(low, pattern).cast("long") for name, pattern in patterns.items()}


def _numbers(found: Column, factor: float) -> Column:
    words = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in (pair[0], float(pair[1]))))

    def value(token: Column) -> Column:  # one argument only: a second would be taken for the index
        return F.coalesce(F.try_element_at(words, token), token.try_cast("double")) * F.lit(factor)

    return F.transform(found, value)


def age_months(low: Column) -> Column:
    """The smallest age mentioned, in months; null if none. Mentions of weeks, months and years are pooled, 0 < age <= 240."""
    mentions = [_numbers(F.regexp_extract_all(low, F.lit(NUMBER + r"\s*(?:-|\+|and a half)?\s*" + unit + r"\b"), F.lit(1)), factor) for unit, factor in AGE_UNITS.items()]
    return F.array_min(F.filter(F.concat(*mentions), lambda a: (a > 0) & (a <= 240)))


def pet_count(low: Column) -> Column:
    """The largest number of animals mentioned, 1 to 20; null if none."""
    found = F.regexp_extract_all(low, F.lit(NUMBER + r"\s+(?:\w+\s+)?" + COUNTED + r"\b"), F.lit(1))
    return F.array_max(F.filter(_numbers(found, 1.0), lambda n: (n >= 1) & (n <= 20)))


def parsed_features(text: Column | str, low: Column) -> dict[str, Column]:
    t = filled(text)
    age = age_months(low)
    return {
        "age_months": age,
        "age_missing": age.isNull().cast("int"),
        "pet_count": pet_count(low),
        "cjk_ratio": ratio(count(t, "[\\x{4E00}-\\x{9FFF}]"), t),
        "malay_words": count(low, MALAY).cast("long"),
        "n_sentences": (count(t, "[.!?]+") + 1).cast("long"),
    }
