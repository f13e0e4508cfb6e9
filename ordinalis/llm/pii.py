"""Problem 2: personal information in free text, by offset-preserving deobfuscation.

A text runs through a chain of small transducers. Each rewrites disguises (full-width and look-alike characters, invisible characters,
spelled-out digits, letters standing for digits, "at" and "dot") and keeps, for every character it writes, the span of source
characters it came from. Detection works on the plain form; the spans found are mapped back, so values are exact substrings of the
source and masking leaves everything else untouched. Every pattern is linear in the length of the text: words are matched without
backtracking, and what may stand before a cue is bounded.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordinalis.sources.tables import canonical_id

KINDS = ("email", "phone", "id_number", "address", "name")

# Characters drawn like Latin letters, and the digit words of English, Malay and German.
LOOK_ALIKE = str.maketrans("аеорсухіјѕԁһԛԝьВЕКМНОРСТХАαορνικτΑΒΕΗΙΚΜΝΟΡΤΧΥΖ", "aeopcyxijsdhqwbbekmhopctxaaopviktabehikmnoptxyz")
INVISIBLE = frozenset("​‌‍⁠﻿­")
DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
DIGIT_WORDS |= {"oh": "0", "kosong": "0", "sifar": "0", "satu": "1", "dua": "2", "tiga": "3", "empat": "4", "lima": "5", "enam": "6", "tujuh": "7", "lapan": "8", "sembilan": "9"}
DIGIT_WORDS |= {"null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"}


class Traced:
    """A string whose every character remembers the source span it stands for."""

    __slots__ = ("end", "start", "text")

    def __init__(self, text: str, start: list[int], end: list[int]) -> None:
        self.text, self.start, self.end = text, start, end

    def rewrite(self, pattern: re.Pattern, pieces) -> Traced:
        """Replace each match by the (string, from, to) pieces that ``pieces`` gives; a piece's characters share its span."""
        out: list[str] = []
        start: list[int] = []
        end: list[int] = []
        at = 0
        for m in pattern.finditer(self.text):
            made = pieces(m)
            if made is None:
                continue
            out.append(self.text[at : m.start()])
            start += self.start[at : m.start()]
            end += self.end[at : m.start()]
            for s, a, b in made:
                if s == self.text[a:b]:
                    start += self.start[a:b]
                    end += self.end[a:b]
                else:
                    start += [self.start[a]] * len(s)
                    end += [self.end[b - 1]] * len(s)
                out.append(s)
            at = m.end()
        if not out:
            return self
        out.append(self.text[at:])
        start += self.start[at:]
        end += self.end[at:]
        return Traced("".join(out), start, end)

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def _plain(text: str) -> Traced:
    """First transducer: compatibility forms, look-alikes, lower case; invisible characters vanish."""
    if text.isascii():
        n = len(text)
        return Traced(text.lower(), list(range(n)), list(range(1, n + 1)))
    out: list[str] = []
    start: list[int] = []
    for i, c in enumerate(text):
        if c in INVISIBLE:
            continue
        if not c.isascii():
            c = "\n" if c in "  \x85" else " " if c.isspace() else (unicodedata.normalize("NFKC", c).translate(LOOK_ALIKE) or c)
        c = c.lower()
        out.append(c)
        start += [i] * len(c)
    return Traced("".join(out), start, [i + 1 for i in start])


_WORD = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(rf"\b(?:{_WORD})(?:[\s-]+(?:{_WORD})){{6,}}\b")
_ONE_WORD = re.compile(_WORD)
_MIXED = re.compile(r"(?<![a-z0-9])[+(]?[0-9oil](?:[ .()-]{0,2}[0-9oil]){7,15}(?![a-z0-9])")
_HP_MIXED = re.compile(r"(?<=hp)[+(]?[0-9oil](?:[ .()-]{0,2}[0-9oil]){7,15}(?![a-z0-9])")
_LOCAL = r"[a-z0-9](?:[a-z0-9._+%-]*[a-z0-9])?"
_AT = r"(?:\s*[(\[{]\s*at\s*[)\]}]\s*|\s+@\s+|@)"
_SAID_DOT = r"(?:\s*[(\[{]\s*dot\s*[)\]}]\s*|\s+dot\s+)"
_DOT = rf"(?:{_SAID_DOT}|\.)"
# A plain "at" needs a spoken dot behind it: in "mail me at ann.lee @ post.net" the first one is a word.
_DISGUISED = re.compile(
    rf"(?<![a-z0-9._+%-])({_LOCAL}(?:\s+dot\s+{_LOCAL}){{0,3}})"
    rf"(?:({_AT})([a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+)|(\s+at\s+)([a-z0-9-]+(?:\.[a-z0-9-]+)*{_SAID_DOT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*))"
)
_ANY_DOT = re.compile(_DOT)


def _digits(m: re.Match) -> list:
    return [(DIGIT_WORDS[w.group()], m.start() + w.start(), m.start() + w.end()) for w in _ONE_WORD.finditer(m.group())]


def _letters(m: re.Match) -> list | None:
    s = m.group()
    if s.count("0") + sum(c in "123456789" for c in s) < 4 or not any(c in "oil" for c in s):
        return None
    return [({"o": "0", "i": "1", "l": "1"}.get(c, c), m.start() + k, m.start() + k + 1) for k, c in enumerate(s)]


def _dotted(m: re.Match, group: int) -> list:
    """The pieces of a group with every kind of dot written as one."""
    made, k = [], m.start(group)
    for d in _ANY_DOT.finditer(m.group(group)):
        a, b = m.start(group) + d.start(), m.start(group) + d.end()
        made += [(m.string[k:a], k, a), (".", a, b)]
        k = b
    return [*made, (m.string[k : m.end(group)], k, m.end(group))]


def _at_dot(m: re.Match) -> list:
    at = 2 if m.group(2) else 4
    return [*_dotted(m, 1), ("@", m.start(at), m.end(at)), *_dotted(m, at + 1)]


def deobfuscate(text: str) -> Traced:
    """The whole chain of transducers."""
    t = _plain(text)
    t = t.rewrite(_SPELLED, _digits).rewrite(_MIXED, _letters)
    if "hp" in t.text:
        t = t.rewrite(_HP_MIXED, _letters)
    return t.rewrite(_DISGUISED, _at_dot)


_EMAIL = re.compile(rf"(?<![a-z0-9._+%-]){_LOCAL}@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{{2,}}(?![a-z0-9])")
_ID = re.compile(
    r"(?<![0-9+-])\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])([- ]?)\d{2}\1\d{4}(?![0-9]|-\d)"  # date, place, serial number
    r"|(?<![a-z0-9])[a-z]\d{8}(?![a-z0-9])"  # passport
    r"|(?<![0-9+-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![0-9]|-\d)"  # three, two, four digits
    r"|(?<![a-z0-9])[stfgm]\d{7}[a-z](?![a-z0-9])"  # letter, seven digits, letter
    r"|(?<![a-z0-9])\d{8}-?[a-z](?![a-z0-9])"  # eight digits, check letter
    r"|(?<![a-z0-9])[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d](?![a-z0-9])"  # insurance number
)
_LABELLED_ID = re.compile(r"\b(?:passport|pasport|nric|identity card|id card|national id|ssn|personalausweis|reisepass)(?: (?:no|number|nr|nombor)\b\.?)?[ :#]{1,3}([a-z]{0,3}\d[a-z0-9-]{4,14}[a-z0-9])(?![a-z0-9])")
_PHONE = re.compile(
    r"(?<![0-9+/.-])(?:"
    r"\+60[ -]?1?\d[ -]?\d{3,4}[ -]?\d{4}"
    r"|00?6-0\d{1,2}-\d{3,4}-\d{4}"
    r"|\(0\d{1,2}\) ?\d{3,4}[ -]?\d{4}"
    r"|0\d{1,2}([-. ])\d{3,4}[ .-]\d{4}"
    r"|01\d \d{2} \d{2} \d{3}"
    r"|01\d-\d{5}-\d{2}"
    r"|0\d{8,10}"
    r"|\+[1-9](?:[ .-]?\(?\d\)?){7,14}"  # any country
    r"|00[1-9]\d{0,2}[ -](?:[ -]?\d){7,11}"
    r"|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}([-.])\d{3}\2\d{4}"
    r"|0\d{2,4} \d{3,4} \d{3,4}|0\d{3,4}[ /-]\d{6,8}"
    r")(?![0-9]|[-/]\d)"
)
_STREET = r"(?:jalan|jln\.?|jl\.?|lorong|lrg\.?|lebuh|persiaran|psn\.?|pangsapuri|apartmen|kondominium)"
_TAIL_WORD = r"[^\W\d_][\w'-]{0,60}+"
_HOUSE = r"(?:(?:no\.?|lot|unit|blok|block|blk)\s*)?(?:[a-z]-)?\d+[a-z]?(?:-\d+){0,2}"
_FREE = r"(?<![^\W一-鿿])(?<![/.-])"  # not inside a word; Chinese may stand right before one
_ADDRESS = re.compile(
    rf"{_FREE}{_HOUSE},?\s+{_STREET}\s+{_TAIL_WORD}(?:[ ]{_TAIL_WORD})?(?:\s\d+/\d+[a-z]?)?"
    rf"|{_FREE}{_HOUSE},?\s+{_TAIL_WORD}(?:[ ]{_TAIL_WORD})?\s(?:street|lane|road|crescent|avenue|drive|close|court|terrace)\b"
    rf"|{_STREET}\s+{_TAIL_WORD}(?:[ ]{_TAIL_WORD})?(?:\s\d+/\d+[a-z]?)?,\s*(?:no\.?|lot|unit|blok|block)\s*(?:[a-z]-)?\d+[a-z]?(?:-\d+){{0,2}}"
    r"|[一-鿿]{2}(?:大道|[街路巷])\s?\d+[号號]"
)
# Street forms of other countries; they count only where the source has a capital, so that no ordinary word is taken for a street.
_CAPITAL_ADDRESS = re.compile(
    rf"(?<![\w/.-])\d{{1,5}}[a-z]?,?\s(?P<a>{_TAIL_WORD})(?:[ ]{_TAIL_WORD})?[ ](?:st|rd|ave|blvd|boulevard|square|parade|way)\b"
    r"|(?<![\w/.-])\d{1,5}(?: (?:bis|ter))?,?\s(?:rue|avenue|boulevard|chemin|impasse|quai|allée)\s(?:de la |de l'|des |de |du |d')?(?P<b>[^\W\d_][\w'-]{0,40}+)(?:[ ][^\W\d_][\w'-]{0,40}+)?"
    r"|(?<!\w)(?P<c>[^\W\d_]{2,30}(?:straße|strasse|str\.|weg|gasse|platz|allee))\s\d{1,4}[a-z]?(?!\w)"
    r"|(?<!\w)(?P<d>calle|avenida|plaza|paseo|via|viale|piazza|corso)\s(?:de la |del |de |della )?[^\W\d_][\w'-]{0,40}+(?:[ ][^\W\d_][\w'-]{0,40}+)?,?\s\d{1,4}(?!\w)"
)
_STREET_CUES = (" st ", " st,", " st.", " rd", " ave", " blvd", " square", " parade", " way", "rue ", "avenue ", "boulevard ", "chemin ", "impasse ", "quai ", "allée ", "straße", "strasse", "str.", "weg ", "gasse ", "platz ", "allee ", "calle ", "avenida ", "plaza ", "paseo ", "via ", "viale ", "piazza ", "corso ")
_STOP = frozenset(
    "whatsapp only saya and at for is are was has have will who runs the a an in on of to di akan yang untuk pada dan ist im in am please pls ring gate near from with or you we she he it i so if my her his our your this that they can may see ask email write call contact photos sie".split()
)
_NO_NAME = frozenset("monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december vet clinic shelter tel hp phone mobile email not please our no all any there these those what when where why how then also but".split())
_PART = r"(?:bin|binti|bte|a/l|a/p|s/o|d/o)"
_W = r"[a-z][a-z'-]{1,40}+"
_FULL = rf"(?:[a-z]\.\s?(?:{_PART}\s)?{_W}|{_W}(?:\s{_PART})?\s{_W})"
_TITLED = rf"(?:[a-z]\.\s?{_W}|{_W}(?:(?:\s{_PART})?\s{_W})?)"
_TITLE = r"(?:mr|mrs|ms|mdm|madam|dr|encik|en\.|puan|pn\.|cik|tuan|frau|herr)\.?"
_NUMBER = r"[+(]?0[0-9 ().-]{7,17}\d|\+60[0-9 ().-]{7,14}\d|00?6-[0-9-]{9,14}\d"
_GAP = r"[ \t]*(?:\n|<br>)[ \t]*"
#: (words of which one must stand in the text, pattern) of the contexts that tell a person's name.
_NAMES = [
    (cues, re.compile(p))
    for cues, p in (
        ((), rf"(?<![^\W一-鿿]){_TITLE}\s(?P<n>{_TITLED})(?![\w@])"),
        (("请联系",), rf"请联系\s*(?P<n>{_TITLED})\s*(?:小姐|先生|女士)"),
        (("我叫",), rf"我叫\s*(?P<n>{_FULL})(?![\w@])"),
        (("தொடர்புக்கு",), rf"தொடர்புக்கு\s*(?P<n>{_TITLED})\s*அவர்கள்"),
        (("my name is", "nama saya", "ich heiße", "ask for", "on behalf of"), rf"\b(?:my name is|nama saya|ich heiße|ask for|on behalf of)\s(?P<n>{_FULL})(?![\w@])"),
        (("regards", "ikhlas", "sincerely", "grüße", "gruß"), rf"\b(?:regards|ikhlas|sincerely|grüße|gruß),\s(?P<n>{_FULL})(?![\w@])"),
        (("thanks to ",), rf"\bthanks to (?P<n>{_FULL}) for\b"),
        (("terima kasih kepada",), rf"\bterima kasih kepada (?P<n>{_FULL}) yang\b"),
        (("landlady", "landlord", "neighbour", "aunt", "uncle"), rf"\b(?:landlady|landlord|neighbour|aunt|uncle), (?P<n>{_FULL}), "),
        (("~",), rf"~ ?(?P<n>{_FULL}) ?~"),
        ((" has fostered",), rf"\b(?P<n>{_FULL}) has fostered\b"),
        (("call ",), rf"\bcall (?P<n>{_FULL}) \((?={_NUMBER})"),
        ((" (",), rf"(?:{_NUMBER}) \((?P<n>{_FULL})\)"),
        (("whatsapp", "wasap"), rf"\b(?:whatsapp|wasap) (?P<n>{_FULL}) - (?={_NUMBER})"),
        (("whatsapp", "wasap"), rf"\b(?:whatsapp|wasap) (?:{_NUMBER}) - (?P<n>{_FULL})(?![\w@])"),
        (("enquiries",), rf"\benquiries (?P<n>{_FULL}), (?={_NUMBER})"),
        (("enquiries",), rf"\benquiries (?:{_NUMBER}), (?P<n>{_FULL})(?![\w@])"),
        ((" / ",), rf"(?<![\w.])(?P<n>{_FULL}) / (?={_NUMBER})"),
        ((" / ",), rf"(?:{_NUMBER}) / (?P<n>{_FULL})(?![\w@])"),
        (("contact:",), rf"\bcontact:(?:{_GAP}|\s)(?P<n>{_FULL})(?:{_GAP}|\s)(?={_NUMBER})"),
        (("contact:",), rf"\bcontact:(?:{_GAP}|\s)(?:{_NUMBER})(?:{_GAP}|\s)(?P<n>{_FULL})(?![\w@])"),
    )
]
# Frequent given names; with a capital and a surname behind them they need no cue.
GIVEN = frozenset(
    "aaron adam ahmad aisha alan alex alexander ali alice amanda amy andrea andrew angela anita ann anna anne anthony arun barbara ben benjamin betty brian carlos carol caroline catherine charles charlotte christian christine christopher claire daniel david deborah diana donald donna dorothy edward elena elizabeth emily emma eric eva fatimah frank frederick george grace hannah hans harry hassan heather helen henry ibrahim ismail jack jacob james jane jason jean jennifer jessica joan john jonathan jose joseph joshua juan julia julie karen karl katherine kavitha keith kenneth kevin klaus kumar laura lauren linda lisa louise lucas lucy luis margaret maria marie mark martin mary matthew megan melissa michael michelle mohamed mohammad muhammad nancy natalie nicholas nicole norman nurul olivia oliver oscar pamela patricia patrick paul pedro peter philip priya rachel rajesh ravi rebecca richard robert ruth ryan samantha samuel sandra sara sarah scott sharon simon siti sofia sophia sophie stefan stephanie stephen steven stuart susan suresh thomas timothy victor victoria vincent virginia walter william yusof zoe".split()
)
_NEXT_WORD = re.compile(rf" ({_W})(?![\w@])")


def _capitalised(word: str) -> bool:
    return word[:1].isupper() and not word.isupper()


def _third_part(t: Traced, text: str, a: int, b: int) -> int:
    """Take a third word into a name of three syllables in capitals, as Tan Ah Kow: no part has more than five letters."""
    said = text[t.start[a] : t.end[b - 1]].split(" ")
    m = _NEXT_WORD.match(t.text, b) if len(said) == 2 else None
    if m is None or m.group(1) in _STOP or m.group(1) in _NO_NAME:
        return b
    said.append(text[t.start[m.start(1)] : t.end[m.end(1) - 1]])
    return m.end(1) if all(_capitalised(w) and len(w) <= 5 for w in said) else b


def _trim_tail(t: Traced, text: str, a: int, b: int) -> int:
    """Give back a second word that is no part of the name: a function word, or small beside a capital."""
    s = t.text[a:b]
    head, _, last = s.rpartition(" ")
    if not head:
        return b
    first, tail = text[t.start[a]], text[t.start[b - len(last)]]
    if last in _STOP or (first.isupper() and tail.islower()):
        head = re.sub(rf"\s{_PART}$", "", head.rstrip())
        return a + len(head)
    return b


def detect(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) spans of ``text`` in order, without overlaps; earlier kinds of the list email, id_number, phone, address,
    name win. Null, empty and blank texts have none."""
    if not text:
        return []
    t = deobfuscate(text)
    s = t.text
    taken = bytearray(len(text) + 1)
    found: list[tuple[str, int, int]] = []

    def take(kind: str, a: int, b: int) -> None:
        x, y = t.source(a, b)
        if not any(taken[x:y]):
            taken[x:y] = b"\x01" * (y - x)
            found.append((kind, x, y))

    if "@" in s:
        for m in _EMAIL.finditer(s):
            take("email", m.start(), m.end())
    for m in _ID.finditer(s):
        take("id_number", m.start(), m.end())
    for m in _LABELLED_ID.finditer(s):
        take("id_number", *m.span(1))
    for m in _PHONE.finditer(s):
        take("phone", m.start(), m.end())
    for m in _ADDRESS.finditer(s):
        a, b = m.start(), m.end()
        if s[b - 1].isalpha():
            b = _trim_tail(t, text, a + (m.group().find(" ") + 1 if text[t.start[a]].islower() or text[t.start[a]].isdigit() else 0), b)
        take("address", a, b)
    for m in _CAPITAL_ADDRESS.finditer(s) if any(c in s for c in _STREET_CUES) else ():
        if text[t.start[m.start(m.lastgroup)]].isupper():
            take("address", m.start(), m.end())
    for cues, p in _NAMES:
        if cues and not any(c in s for c in cues):
            continue
        for m in p.finditer(s):
            a, b = m.span("n")
            b = _third_part(t, text, a, _trim_tail(t, text, a, b))
            if s[a:b].split(" ")[0] not in _STOP:
                take("name", a, b)
    for given in GIVEN.intersection(s.replace("(", " ").split()):
        for m in re.finditer(rf"\b{given}\s({_W})(?![\w@])", s):
            (a, b), last = m.span(), m.group(1)
            if last not in _STOP and last not in _NO_NAME and all(_capitalised(text[t.start[x] : t.end[y - 1]]) for x, y in ((a, a + len(given)), m.span(1))):
                take("name", a, _third_part(t, text, a, b))
    return sorted(found, key=lambda f: f[1])


def mask(text: str | None) -> str | None:
    """``text`` with every item replaced by its typed placeholder, for instance ``[EMAIL]``; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in detect(text):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def pii_items(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, value) once per distinct item; other columns of ``rows`` are ignored, rows with a null key or text have none."""
    schema = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(k, kind, t[a:b]) for k, t in zip(batch["key"], batch["text"], strict=True) for kind, a, b in detect(t)]
            yield pd.DataFrame(made, columns=["key", "kind", "value"])

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null").mapInPandas(scan, schema).distinct()


def masked(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, masked) for every row of ``rows``, repeats included; null, empty and blank texts stay as they are."""

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        return texts.map(mask, na_action="ignore")

    return rows.select(F.col(key).alias("key"), hide(F.col(text)).alias("masked"))


def train_items(train: DataFrame) -> DataFrame:
    return pii_items(train.select(canonical_id("PetID").alias("petid"), "Description"), "petid", "Description").withColumnRenamed("key", "petid")
