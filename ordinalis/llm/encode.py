"""Problem 7: exact encoding by a public byte-level BPE tokenizer, as a monoid tree reduction.

A text is halved until pieces are small; pieces are encoded alone and neighbours are joined up the tree. The tokenizer cuts a text into
words by a regular expression and encodes every word alone. No alternative of that expression goes on from a character that is no
white space to white space, so a word begins at every white space right behind such a character, whatever stands before or after: a
place where the tokens on both sides are stable. A join looks for the nearest such place on either side of the seam, in a window that
grows from it, and encodes only what lies between the two anew; the tokens outside are kept as they are. Without such a place, as in
a text that has no white space, the window grows to the whole piece. Pieces are smaller than most documents, so all but the
shortest texts pass through joins.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The vocabulary, unless the session names another one in ``VOCABULARY_SETTING``.
VOCABULARY, VOCABULARY_SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.ordinalis.vocabulary"
#: Pieces of at most this many characters are the leaves of the tree.
LEAF = 256
#: First width of a boundary window; it doubles until it holds a stable place.
WINDOW = 64
# Fixed value: the word pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    """The vocabulary as a ready encoder; one per Python worker."""
    import tiktoken

    with Path(path).open("rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A place where a word begins in any context; white space that both the expression and Python take for such.
_STABLE = re.compile(r"(?<=\S)[ \t\n\r]")


def _last_stable(text: str, a: int, b: int) -> int:
    """The last stable place inside the piece a to b, or its beginning."""
    width = WINDOW
    while True:
        low, found = max(a + 1, b - width), None
        for found in _STABLE.finditer(text, low, b):
            pass
        if found:
            return found.start()
        if low == a + 1:
            return a
        width *= 2


def _tree(text: str, a: int, b: int, enc, leaf: int) -> list[int]:
    """The ids of the piece a to b."""
    if b - a <= leaf:
        return enc.encode_ordinary(text[a:b])
    seam = (a + b) // 2
    left, right = _tree(text, a, seam, enc, leaf), _tree(text, seam, b, enc, leaf)
    begin, found = _last_stable(text, a, seam), _STABLE.search(text, seam + 1, b)
    end = found.start() if found else b
    kept = len(left) - len(enc.encode_ordinary(text[begin:seam]))
    return [*left[:kept], *enc.encode_ordinary(text[begin:end]), *right[len(enc.encode_ordinary(text[seam:end])) :]]


def encode(text: str | None, path: str = VOCABULARY, leaf: int = LEAF) -> list[int]:
    """Token ids of ``text`` without special tokens; null and empty texts have none ([])."""
    return _tree(text, 0, len(text), encoder(path), leaf) if text else []


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of ``ids``: the bytes of all tokens, concatenated."""
    return encoder(path).decode_bytes(list(ids)).decode("utf-8")


def encode_column(df: DataFrame, keep: list[str], text: str = "text", *, path: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """``keep`` plus the token ids of ``text`` for every row; nothing is shuffled."""
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = batch[keep].copy()
            made[ids] = [encode(t, path) for t in batch["__text"]]
            yield made

    return df.select(*keep, F.col(text).alias("__text")).mapInPandas(run, schema)


def vocabulary_of(spark: SparkSession) -> str:
    """The vocabulary file that the session names, on every machine of the cluster, or else the public one's usual place."""
    return spark.conf.get(VOCABULARY_SETTING, VOCABULARY)


def document_ids(documents: DataFrame, *, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encode_column(documents, ["doc_id"], path=path or vocabulary_of(documents.sparkSession))
