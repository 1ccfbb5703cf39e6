"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.shipping import ship

from .common import slices, written
from .language import held_out

#: Labelled documents of each class that training reads, as expected by a hash of the id.
TRAIN_PER_CLASS = 5_000
#: A term's log odds are at least so high, and by so many standard errors above the least that counts at all.
LEAST_ODDS, ERRORS, SURE = 1.5, 2.0, 0.5
#: Letters of the longest word starts; longer words are terms as wholes.
LONGEST = 24
#: Letters that pass for Latin ones, and digits and signs that stand for letters (fixed values).
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ɡ": "g", "в": "b", "н": "h", "к": "k", "м": "m", "т": "t", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_HIDDEN = "­​‌‍⁠﻿"
_TABLE = str.maketrans({c: " " for c in [*string.punctuation, *string.whitespace, *"«»“”„–—…¿¡|"]} | LOOKALIKES | DIGITS | dict.fromkeys(_HIDDEN) | {chr(c): chr(c - 0xFEE0) for c in range(0xFF41, 0xFF5B)})


def folded(text: str | None) -> str:
    """Lower case, lookalikes and digits as letters, hidden signs gone, punctuation as single spaces.

    A sign that stands for a letter counts as one only beside letters: `$$$` after a word is
    punctuation, as is a lone number.
    """
    words = (text or "").lower().split()
    return f" {' '.join(' '.join(w.rstrip('$@!.,;:?').translate(_TABLE) for w in words).split())} "


def _starts(word: str) -> Iterator[str]:
    """The starts of a word from 3 letters on, and the word as a whole."""
    for n in range(3, min(len(word), LONGEST) + 1):
        yield " " + word[:n]
    yield f" {word} "


def _sampled(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(toxic, text) of about per_class labelled documents of each class, written once.

    That bounds the chosen labels, which go to all tasks, so that texts stay where they are.
    """
    counts = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for k in (0, 1):
        share = F.when(F.col("toxic") == k, F.lit(min(1.0, per_class / max(1, counts.get(k, 0))))).otherwise(share)
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30))
    return written(docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "tox-sample")


def _counted(sample: DataFrame, items) -> DataFrame:
    """(item, toxic, clean): in how many documents of each class items(text) has an item."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for b in slices(batches):
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for x in items(text):
                    found.setdefault(x, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v[1] for v in found.values()], pa.int64()), pa.array([v[0] for v in found.values()], pa.int64())], names=["item", "toxic", "clean"])

    return sample.mapInArrow(count, "item string, toxic long, clean long").groupBy("item").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass
class Lexicon:
    """Weights of the terms (word starts, and words with a blank at their end), phrases that are exceptions, and the final scale."""

    terms: dict[str, float]
    exceptions: frozenset[str]
    scale: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, w in self.terms.items():
            found.add_word(term, (len(term), w))
        found.make_automaton()
        return found


def matches(automaton, lexicon: Lexicon, text: str) -> list[tuple[int, float]]:
    """(start, weight) of each matched word of folded text: its heaviest term, exceptions left out."""
    best: dict[int, float] = {}
    for end, (n, w) in automaton.iter(text):
        at = end - n + 1
        if w > best.get(at, 0.0):
            best[at] = w
    if best and lexicon.exceptions:
        best = {at: w for at, w in best.items() if not phrases(text, at) & lexicon.exceptions}
    return list(best.items())


def phrases(text: str, at: int) -> set[str]:
    """The matched word with the word before it, and with the word after it."""
    end = text.index(" ", at + 1)
    after, before = text.find(" ", end + 1), text.rfind(" ", 0, at)
    return ({text[at + 1 : after]} if after >= 0 else set()) | ({text[before + 1 : end]} if before >= 0 else set())


def features(found: list[tuple[int, float]], words: int) -> tuple[float, float]:
    """The weight per word, and in all, on log scales."""
    total = sum(w for _, w in found)
    return math.log(1e-3 + total / (words + 20)), math.log1p(total)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, design.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Lexicon:
    """A lexicon from labelled documents; docs (doc_id, text), labels (doc_id, toxic 0 or 1).

    Terms are whole words, and word starts of 3 letters and more, whose log odds of standing in a
    toxic document are high, and surely so: a few standard errors must not take them below SURE.
    A start that tells no more than the one before it is left out. Exceptions are the two-word
    phrases around a term that only clean documents have. All that the sample supports is kept.
    """
    ship(docs.sparkSession)
    sample = _sampled(docs.select("doc_id", "text"), labels, per_class)
    sizes = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    toxic, clean = sizes[0] or 0, sizes[1] or 0
    if not toxic or not clean:
        p = (toxic + 0.5) / (toxic + clean + 1)
        return Lexicon({}, frozenset(), (math.log(p / (1 - p)), 0.0, 0.0))
    starts = lambda text: {p for w in set(folded(text).split()) for p in _starts(w)}
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(t / (toxic + 1)) - F.log(c / (clean + 1))
    error = F.sqrt(1 / t + 1 / c)
    # Without clean documents the odds of an item are at their highest; what isn't sure then never is.
    hopeful = (F.log(t / (toxic + 1)) - math.log(0.5 / (clean + 1)) - ERRORS * F.sqrt(1 / t + 2)) >= SURE
    many = {r[0] for r in _counted(sample.where("toxic = 1"), starts).where(hopeful).select("item").collect()}
    rows = _counted(sample, lambda text: starts(text) & many).where((odds >= LEAST_ODDS) & (odds - ERRORS * error >= SURE))
    found = {r["item"]: (float(r["w"]), r["toxic"], r["clean"]) for r in rows.withColumn("w", odds).collect()}
    terms = {x: w for x, (w, *n) in found.items() if x[:-1] not in found or [*found[x[:-1]][1:]] != n}
    rough = Lexicon(terms, frozenset())

    made: list = []  # the automaton of a task

    def around(text: str) -> set[str]:
        if not terms:
            return set()
        if not made:
            made.append(rough.automaton())
        text = folded(text)
        return set().union(*(phrases(text, at) for at, _ in matches(made[0], rough, text)))

    quiet = _counted(sample, around).where("clean >= 5 and toxic = 0")
    lexicon = Lexicon(terms, frozenset(r["item"] for r in quiet.collect()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton() if terms else None
        for b in slices(batches):
            x = []
            for text in b.column(1).to_pylist():
                text = folded(text)
                x.append(features(matches(automaton, lexicon, text) if automaton else [], len(text.split())))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64())], names=["toxic", "a", "b"])

    points = sample.mapInArrow(measure, "toxic int, a double, b double").groupBy("toxic", F.round("a", 3).alias("a"), F.round("b", 3).alias("b")).count().toPandas()
    x, y, n = points[["a", "b"]].to_numpy(float), points["toxic"].to_numpy(float), points["count"].to_numpy(int)
    return Lexicon(terms, lexicon.exceptions, _fit(np.repeat(x, n, 0), np.repeat(y, n)))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), n_matches, words.

    The whole text is folded and run through the automaton once; each matched word counts with its
    heaviest term, unless it stands in an exception phrase. The sum, by the number of words and in
    all, gives the score. Null and empty texts have no match and get the score of such texts. Very
    long texts are scored whole. Only the text is read; rows that repeat get the same score each.
    """
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_matches", pa.int64()), ("words", pa.int64())])
    c, a, b_ = lexicon.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton() if lexicon.terms else None
        for b in slices(batches):
            out = []
            for text in b.column(1).to_pylist():
                text = folded(text)
                found, words = matches(automaton, lexicon, text) if automaton else [], text.count(" ") - 1
                x, y = features(found, words)
                out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, c + a * x + b_ * y)))), len(found), words))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array([o[i] for o in out], schema.types[i + 1]) for i in range(3))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, n_matches long, words long")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """score() of all rows, with a lexicon learned from labels that aren't held out (crc32 of the id mod 5 is not 0).

    Null labels are left out; several labels of one id count as the highest. Without labels of both
    classes there is no lexicon, and all rows get the share of the class that there is.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), 5, 0))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    lexicon = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), known, per_class)
    return score(docs, lexicon, id_col, text_col)
