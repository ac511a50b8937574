"""Toxicity of strip transcripts: noisy-channel restoration, then a score of the restored words."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cardloom.llm.common import words
from cardloom.plans.session import stage

#: Labelled rows the lexicon is fitted on, at most: those with the smallest hash of their id.
FIT_ROWS = 12_000
#: Places a stem must be seen at, pseudo-places of the prior, and its rate of toxic ones.
MIN_PLACES, PRIOR_PLACES, PRIOR_RATE = 4, 2.0, 0.05
STEMS = (4, 5, 6)
#: Places that one word may add to its stems.
MOST = 2

# Letters that a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y"}
SEPARATORS = " .-_*~'`^·•​"
#: Log chances of the channel: letter kept, doubled letter kept or dropped, sign read as a
#: letter or as noise, separator inside a word or between two.
KEPT, DOUBLED, DROPPED, READ, NOISE, INSIDE, BETWEEN = (
    math.log(x) for x in (0.95, 0.9, 0.1, 0.8, 0.001, 0.9, 0.02))

LETTERS = "abcdefghijklmnopqrstuvwxyz"
_EDGE = ".,;:?!\"'()[]{}*#%&/\\-_~=<>«»“”„…"
_RUN = re.compile(r"^([$@|+])\1+|([$@|+])\2+$")
_TRIPLE = re.compile(r"(.)\1\1")
_ODD = re.compile(r"[^\W\d_][0-9@$!|+(<€£¥]|[0-9@$!|+(<€£¥][^\W\d_]|([^\W\d_])\1\1|[^\W\d_][.\-_*~'`^·•​]", re.U)
_SPACED = re.compile(r"(?<!\S)\S(?:[ ]\S){3,}(?!\S)")


@lru_cache(1)
def _fold() -> dict[int, int | None]:
    """Code point -> code of a letter's base form, for accented Latin letters."""
    table: dict[int, int | None] = {}
    for c in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(c).lower())[0]
        if base in LETTERS:
            table[c] = ord(base)
    return table


@lru_cache(1)
def _bytes() -> tuple[bytes, bytes]:
    """(code of each byte, the bytes of texts in Latin-1 letters): what follows the byte 0xC3 in
    UTF-8 is an accented letter, and that byte itself is skipped."""
    code = bytearray(256)
    for i, x in enumerate(LETTERS):
        code[ord(x)] = code[ord(x.upper())] = i + 1
    for i in range(64):
        base = chr(_fold().get(0xC0 + i, 0) or 0)
        code[0x80 + i] = LETTERS.find(base) + 1 if base in LETTERS else 0
    return bytes(code), bytes([*range(128), *range(0x80, 0xC0), 0xC3])


def _codes(text: str) -> np.ndarray:
    """0 for what is no letter, else 1 to 26, by base letter."""
    code, plain = _bytes()
    raw = text.encode("utf-8", "replace")
    if raw.translate(None, plain):     # other letters: dash and quotes, other scripts
        raw = "".join(c if c.isascii() or "\xc0" <= c <= "\xff" else " " for c in text).encode("utf-8")
    return np.frombuffer(raw.translate(code, b"\xc3"), np.uint8).astype(np.int32)


def character_counts(strips: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): counts of letter trigrams over every text in whole, by number in base 27. At
    most 27^3 rows whatever the input; each task sends its own sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, edge = np.zeros(27 ** 3, np.int64), np.zeros(2, np.int32)
        for batch in batches:
            for t in batch.column(0):
                c = np.concatenate((edge, _codes(t.as_py() or ""), edge))
                total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27 ** 3)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    return (strips.select(F.col(text).cast("string")).mapInArrow(run, "gram long, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")))


def language_model(counts: DataFrame) -> np.ndarray:
    """log P(c | a, b) as a 27 x 27 x 27 array, add-half smoothed; the 27^3 counts are brought
    to the driver, a size that no input exceeds."""
    n = np.full(27 ** 3, 0.5)
    for r in counts.collect():
        n[r["gram"]] += r["n"]
    n = n.reshape(27, 27, 27)
    return np.log(n / n.sum(2, keepdims=True))


def restore(token: str, model: np.ndarray) -> list[str]:
    """The likeliest words behind an obfuscated token, by Viterbi over a lattice of letters.

    Each character is a step: a letter stands for itself, or for nothing where it repeats the one
    before; a sign for one of its letters, or for noise; a separator for nothing, or for the end of
    a word. States are the last two letters; ``model`` weighs each new letter, the channel each
    reading. Steps and states are bounded per character, so time is linear in the token."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for ch in token:
        base = ch.translate(_fold())
        readings: list[tuple[str, float]] = []     # what is written, log chance
        if len(base) == 1 and base in LETTERS:
            same = before == base
            readings.append((base, DOUBLED if same else KEPT))
            if same:
                readings.append(("", DROPPED))
        elif ch in LEET:
            letters = LEET[ch]
            readings += [(x, READ - math.log(len(letters))) for x in letters] + [("", NOISE)]
        elif ch in SEPARATORS:
            readings += [("", INSIDE), (" ", BETWEEN)]
        else:
            readings.append(("", NOISE))
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (p, path) in best.items():
            for letter, cost in readings:
                if not letter:
                    state, q, way = (a, b), p + cost, path
                elif letter == " ":
                    state, q, way = (0, 0), p + cost + (model[a, b, 0] if b else 0.0), (path, " ")
                else:
                    c = ord(letter) - 96
                    state, q, way = (b, c), p + cost + model[a, b, c], (path, letter)
                if state not in step or q > step[state][0]:
                    step[state] = (q, way)
        best = step
        before = base
    _, path = max(((p + model[a, b, 0], w) for (a, b), (p, w) in best.items()), key=lambda x: x[0])
    out = []
    while path is not None:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out)).split()


class Restorer:
    """Restored words of tokens and texts; remembers tokens up to a bound."""

    def __init__(self, model: np.ndarray, value=None):
        self.model, self.value, self.known = model, value or (lambda words: words), {}

    def token(self, token: str):
        """``value`` of the token's restored words: a plain word is its own."""
        found = self.known.get(token)
        if found is None:
            bare = token.strip(_EDGE)
            if not bare.isalpha():
                bare = _RUN.sub("", bare)
                odd = _ODD.search(bare)
            else:
                odd = _TRIPLE.search(bare)
            words = restore(bare, self.model) if odd else [bare if bare.isascii() else bare.translate(_fold())] if bare else []
            found = self.value(words)
            if len(self.known) >= 400_000:
                self.known.clear()
            self.known[token] = found
        return found

    def values(self, text: str) -> list:
        """``value`` of each distinct token of a text and of each run of spaced-out letters."""
        tokens = set(text.lower().split())
        found = [self.token(t) for t in tokens]
        if sum(len(t) == 1 for t in tokens) >= 3:
            for m in set(_SPACED.findall(text.lower())):
                found.append(self.value(restore(m, self.model)))
        return found


def stems(words: list[str]) -> set[str]:
    """Features of restored words: the words and their beginnings."""
    out = set()
    for w in words:
        out.add(w)
        out.update(w[:n] + "-" for n in STEMS if len(w) >= n)
    return out


def held_out(strip_id):
    """True where crc32 of the id as text leaves 1 modulo 3 (NULL: as the empty text)."""
    return F.crc32(F.coalesce(strip_id.cast("string"), F.lit(""))) % 3 == 1


def fit_lexicon(strips: DataFrame, labels: DataFrame, model: np.ndarray, strip_id: str = "strip_id", text: str = "text",
                toxic: str = "toxic", fit_rows: int = FIT_ROWS) -> dict[str, float]:
    """Feature -> chance that a text with it is toxic, from labelled rows that are not held out.

    Fitted on ``fit_rows`` labelled ids at most (a documented bound; the ids are broadcast). Units
    are distinct places: a word with its two neighbours. So a text with a thousand near copies
    counts about once, and a place that also stands in a clean text is clean. A feature's chance
    is its share of toxic places, shrunk. An id labelled twice is toxic if any label says so."""
    ids = (labels.filter(F.col(strip_id).isNotNull() & F.col(toxic).isNotNull() & ~held_out(F.col(strip_id)))
           .groupBy(F.col(strip_id).alias("_id")).agg(F.max(F.col(toxic).cast("int")).alias("_toxic"))
           .orderBy(F.xxhash64("_id"), "_id").limit(fit_rows))
    ids = stage(ids, "fit")
    held = strips.join(F.broadcast(ids), F.col(strip_id) == F.col("_id")) \
        .select("_toxic", words(F.lower(F.col(text))).alias("w"))
    around = F.transform("w", lambda x, i: F.struct(
        x.alias("word"), F.xxhash64(x, F.get(F.col("w"), i - 1), F.get(F.col("w"), i + 1)).alias("place")))
    places = (held.select("_toxic", F.explode(F.array_distinct(around)).alias("p"))
              .groupBy("p.word", "p.place").agg(F.min("_toxic").alias("toxic"))
              .groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, n, bad = Restorer(model, stems), Counter(), Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.float64()),
                                               pa.array([bad[f] for f in n], pa.float64())], names=["feature", "n", "bad"])
        for batch in batches:
            for word, count, toxic_count in zip(*(c.to_pylist() for c in batch.columns)):
                for f in restorer.token(word):
                    # A stem stands for many words, so none of them may speak for it alone.
                    few = min(1.0, MOST / count) if f.endswith("-") else 1.0
                    n[f] += count * few
                    bad[f] += toxic_count * few
            if len(n) > 200_000:
                yield sent()
                n, bad = Counter(), Counter()
        if n:
            yield sent()

    # Sums of doubles are rounded, so that their order does not matter.
    counts = places.mapInArrow(run, "feature string, n double, bad double").groupBy("feature").agg(
        F.round(F.sum("n"), 3).alias("n"), F.round(F.sum("bad"), 3).alias("bad"))
    chance = (F.col("bad") + PRIOR_PLACES * PRIOR_RATE) / (F.col("n") + PRIOR_PLACES)
    found = (counts.filter(F.col("n") >= MIN_PLACES).select("feature", chance.alias("chance"))
             .filter(F.col("chance") >= 0.5))
    # All features: their number is bounded by the words of ``fit_rows`` texts.
    return {r["feature"]: r["chance"] for r in found.collect()}


def score_toxicity(strips: DataFrame, labels: DataFrame, strip_id: str = "strip_id", text: str = "text",
                   toxic: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """(strip_id, held_out, score, predicted) for every strip transcript.

    A character model is counted over all texts; tokens in leetspeak, spaced out or with repeated
    letters are restored by ``restore``; the score is the strongest chance in the lexicon of any
    restored word or its beginning, and a tenth of the prior where there is none, empty and NULL
    texts included. Labels of held-out ids are never read. Rows repeat as they come."""
    model = language_model(character_counts(strips, text))
    lexicon = fit_lexicon(strips, labels, model, strip_id, text, toxic)
    floor = PRIOR_RATE / 10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model, lambda words: max((lexicon.get(f, floor) for f in stems(words)), default=floor))
        for batch in batches:
            score = [max(restorer.values(t.as_py() or ""), default=floor) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["strip_id", "score"])

    rows = strips.select(F.col(strip_id).alias("strip_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["strip_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"strip_id {kind}, score double")
    return scored.select("strip_id", held_out(F.col("strip_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
