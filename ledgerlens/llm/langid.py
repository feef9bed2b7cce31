"""Language identification with rank-order n-gram profiles (operator 1).

A language's profile is the list of its ``top`` most frequent n-grams (n = 1 to 3) by rank. A document's own most
frequent n-grams are ranked the same way, and its distance to a profile is the sum over them of how far each is out of place,
``top`` for those that the profile lacks. The nearest profile names the language.

Text is folded to lower case; every run of characters that are no letters (or marks) is one blank, words have a blank on both
sides, and an n-gram never reaches over a blank. An n-gram is one integer: three code points of 21 bits, so nothing
is hashed and nothing collides. Equal frequencies rank by that integer, equal distances by the language's name.

Profiles count every training row: tasks sum up their own texts per language, Spark adds these sums, and only the profiles (at
most ``top`` rows for each of at most ``most_languages`` languages, which is checked) reach the driver and the tasks.

Defined results: a null text, or one without letters, is ``und`` with score 0, as is every text when there is nothing to learn
from; repeated rows count as often as they stand there; a text longer than ``PIECE`` characters is counted in pieces that end at white
space, so beside it only one piece and the sums are held; an empty table gives an empty table; other columns are ignored and may have any name.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import in_chunks, tidied
from ledgerlens.llm.tokens import forget

UNKNOWN = "und"
TOP = 400
MOST_LANGUAGES = 1000
#: Characters of a text that are worked on at once, about; a run without white space stays whole.
PIECE = 1 << 20
_BLANK = 32
_BREAK = re.compile(r"\s")


@functools.cache
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case, or a blank if it is no letter or mark; and whether it is a letter."""
    fold = np.full(sys.maxunicode + 1, _BLANK, np.uint32)
    letter = np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            fold[c] = ord(chr(c).lower()[0])
            letter[c] = kind == "L"
    return fold, letter


def pieces(text: str) -> Iterator[str]:
    """A text in pieces that end at white space: no word, and so no n-gram, lies in two of them."""
    start = 0
    while len(text) - start > PIECE and (stop := _BREAK.search(text, start + PIECE)):
        yield text[start : stop.end()]
        start = stop.end()
    yield text[start:] if start else text


def folded(text: str) -> np.ndarray | None:
    """Code points of the folded text with single blanks around each word; None without a letter."""
    fold, letter = _folding()
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if not letter[raw].any():
        return None
    x = np.concatenate(([_BLANK], fold[raw], [_BLANK])).astype(np.int64)
    keep = x != _BLANK
    keep[1:] |= keep[:-1].copy()
    keep[0] = True
    return x[keep]


def grams(x: np.ndarray) -> np.ndarray:
    """All 1-, 2- and 3-grams of folded text as integers."""
    blank = x == _BLANK
    one = x[~blank]
    two = (x[:-1] << 21 | x[1:])[~(blank[:-1] & blank[1:])]
    three = (x[:-2] << 42 | x[1:-1] << 21 | x[2:])[~blank[1:-1]]
    return np.concatenate((one, two, three))


def added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of two (codes, counts)."""
    codes, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return codes, np.bincount(at, np.concatenate((a[1], b[1]))).astype(np.int64)


def ranked(text: str, top: int) -> np.ndarray | None:
    """The most frequent n-grams of a text, in order; None without a letter."""
    sums: tuple[np.ndarray, np.ndarray] | None = None
    for piece in pieces(text):
        if (x := folded(piece)) is not None:
            own = np.unique(grams(x), return_counts=True)
            sums = own if sums is None else added(sums, own)
    return None if sums is None else sums[0][np.argsort(-sums[1], kind="stable")[:top]]


class Profiles:
    """Ranks of every profile's n-grams, as one table over all of them."""

    def __init__(self, rows: Iterable[tuple[str, int, int]], top: int):
        rows = sorted(rows)
        self.top = top
        self.languages = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, np.int64)
        for language, code, rank in rows:
            self.ranks[np.searchsorted(self.codes, code), self.languages.index(language)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language; the score is 1 minus the distance over the largest possible one."""
        own = ranked(text, self.top) if text and self.languages else None
        if own is None:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at[self.codes[at] != own] = len(self.codes)
        ranks = self.ranks[at]
        out = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(out.argmin())
        return self.languages[best], 1.0 - float(out[best]) / (self.top * len(own))


def learn_profiles(docs: DataFrame, training: Column, top: int = TOP, most_languages: int = MOST_LANGUAGES) -> Profiles:
    """Profiles from all rows of ``docs`` (text, lang) where ``training`` holds and lang is not null."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def add() -> None:
            """Sum up what is held, so that a task keeps one number for each n-gram."""
            for language, parts in held.items():
                codes, counts = np.unique(np.concatenate(parts), return_counts=True)
                sums[language] = added(sums[language], (codes, counts)) if language in sums else (codes, counts)
            held.clear()

        def flushed() -> Iterator[pa.RecordBatch]:
            add()
            for language, (codes, counts) in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(codes)), pa.array(codes), pa.array(counts)], ["language", "code", "n"]
                )
            sums.clear()

        for batch in in_chunks(iter(batches), "text", 1 << 20):
            for text, language in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                for x in filter(lambda x: x is not None, map(folded, pieces(text))):
                    held.setdefault(language, []).append(grams(x))
                    size += 3 * len(x)
                    if size > 1 << 20:
                        add()
                        size = 0
            if sum(len(c) for c, _ in sums.values()) > 1 << 20:
                yield from flushed()
        yield from flushed()

    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = rows.mapInArrow(tidied(count), "language string, code long, n long").groupBy("language", "code").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("language", F.pmod(F.hash("code"), F.lit(64))).orderBy(F.desc("n"), "code")
    then = Window.partitionBy("language").orderBy(F.desc("n"), "code")
    best = (
        sums.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(then)).where(F.col("rank") <= top)
        .select("language", "code", F.col("rank") - 1)
    )
    found = best.limit(top * most_languages + 1).collect()
    if len(found) > top * most_languages:
        raise ValueError(f"more than {most_languages} languages to learn")
    return Profiles(found, top)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str] | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` of each whole text beside the columns ``keep`` (all if not given; these two are replaced)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    schema = docs.select(keep).schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(iter(batches), "text", 4 << 20):
            found = [shared.value.predict(t) for t in batch["text"].to_pylist()]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *new], [*keep, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(tidied(run), schema)


def least_score(docs: DataFrame, profiles: Profiles, margin: float = 0.75) -> float:
    """A score below which a text is in none of the languages: ``margin`` times what 99 of 100 rows of ``docs`` (text, lang) reach whose language is
    named rightly by ``profiles`` that have not counted them; 0 without such rows."""
    found = identify(docs.where(F.col("lang").isNotNull()).select("lang", "text"), profiles, keep=["lang"]).where("lang_pred = lang")
    return margin * (found.agg(F.percentile_approx("score", 0.01, 10_000)).first()[0] or 0.0)
