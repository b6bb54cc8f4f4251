"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

1. A lexicon is learned: whole words and word beginnings that labelled toxic documents hold
   far more often than clean ones, each with its log odds.
2. Every whole text becomes a few numbers: how dense lexicon words are and how strong, how
   many show only after masking is undone (``1d10t``, ``st*pid``, ``idiooot``, ``i d i o t``), how many stand
   near a second person, capitals, punctuation, repeats and length.
3. Spark's boosted trees learn from them, an isotonic regression over documents that the
   trees have not seen turns their margin into the score.

Learning takes at most about ``most`` labelled rows, chosen by a hash of the id (the bound is
the parameter); the lexicon is bounded by ``entries``. A document that the lexicon was learned
from is described with its own counts taken out, so that the trees see the lexicon as it does
on new documents. Scoring covers all rows and whole texts, one pass without a shuffle.

Defined results: a null or empty text has no words and gets the score of a text without any
sign; null labels, null ids and the held-out fold are never learned from; ids with several
labels count as toxic if one says so; without both labels the score is the share of toxic rows
(0 if there are none); repeated rows and null ids are scored row by row; ``keep`` carries columns
of any name along; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved

#: Bytes of lower-cased words: ASCII letters and what lies beyond ASCII; all else is a space.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
SPACES = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))
#: Signs beyond ASCII that are no letters: Latin-1 signs, general punctuation, wide punctuation.
SIGNS = re.compile(rb"\xc2[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf]|\xc3[\x97\xb7]|\xe2[\x80-\xaf][\x80-\xbf]|\xe3\x80[\x80-\xbf]|\xef\xbc[\x81-\x8f]")
#: Bytes that may stand for a letter or cut a word.
MASK = np.isin(np.arange(256), list(b"0123456789@$!|+*._#%^~-"))
LETTER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
RUN = re.compile(r"(.)\1\1+")
LOUD = re.compile(r"\b[A-Z]{2,}\b")
#: A longer token is not looked at for masks.
LONGEST = 40
#: What stands for which letter.
MASKS = str.maketrans("0134578@$!|+", "oieastbasiit", "*._-#%^~'\"")
#: Pronouns of the second person, as fixed values.
YOU = frozenset(w.encode() for w in "you your yours yourself du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros os".split())
PUNCTUATION = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
NEAR = 6
FEATURES = ("hits", "hit_words", "strength", "strongest", "hits_per_word", "strength_per_word", "masked_hits", "masked_per_word", "near_you", "you_per_word", "capitals", "loud_words", "exclaimed", "punctuation", "masked_words", "repeats", "digits", "words", "distinct", "word_length")


def learned_from(id_col: Column) -> Column:
    """Not of the held-out fold."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 != 0


def fragments(word: str) -> list[str]:
    """The word itself and its beginnings of 3 to 8 letters."""
    return [f"={word}", *(word[:n] for n in range(3, min(8, len(word)) + 1))]


@dataclass
class Lexicon:
    """Log odds of fragments: for any text, and without one document of the label itself."""

    any: dict[str, float]
    less: tuple[dict[str, float], dict[str, float]]  # by the label taken out

    @staticmethod
    def of(counts: list[tuple[str, int, int]], clean: int, toxic: int) -> Lexicon:
        odds = lambda t, c, tn, cn: math.log((max(t, 0) + 0.5) / (tn + 1)) - math.log((max(c, 0) + 0.5) / (cn + 1))
        return Lexicon({f: odds(t, c, toxic, clean) for f, c, t in counts}, ({f: odds(t, c - 1, toxic, clean - 1) for f, c, t in counts}, {f: odds(t - 1, c, toxic - 1, clean) for f, c, t in counts}))


def signless(text: str) -> bytes:
    """Lower-cased bytes with the signs beyond ASCII as spaces."""
    low = text.lower().encode(errors="replace")
    return low if text.isascii() else SIGNS.sub(b" ", low)


class Describer:
    """Features of texts under one set of weights."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.known: dict[bytes, float] = {}

    def weight(self, word: bytes) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= 500_000:
                self.known.clear()
            found = self.known[word] = max(self.weights.get(f, 0.0) for f in fragments(word.decode(errors="replace")))
        return found

    def masked(self, low: bytes, words: list[bytes], count: Counter, starts: np.ndarray) -> tuple[int, int]:
        """(words that hide letters, those of them in the lexicon)."""
        low = low.translate(SPACES)
        tokens: dict[int, bytes] = {}
        for at in starts.tolist():
            first = low.rfind(b" ", max(0, at - LONGEST), at + 1) + 1
            last = low.find(b" ", at, at + LONGEST)
            last = len(low) if last < 0 and at + LONGEST >= len(low) else last
            if (first or at < LONGEST) and 0 < last - first <= LONGEST:
                tokens[first] = low[first:last]
        seen = hits = 0
        for token in tokens.values():
            core = token.decode(errors="replace").strip(".,;:!?\"'()[]{}<>|-_*#%&$~")
            if "://" in core or "@" in core and "." in core.rpartition("@")[2]:
                continue
            plain = RUN.sub(r"\1", core.translate(MASKS))
            if not plain.isalpha() or plain == core:
                continue
            seen += 1
            hits += self.weight(plain.encode()) > 0 and not any(self.weight(w) > 0 for w in token.translate(LETTERS).split())
        if sum(c for w, c in count.items() if len(w) == 1) < 3:
            return seen, hits
        size = np.fromiter(map(len, words), np.int64, len(words))
        single = np.flatnonzero(np.diff(np.r_[0, size == 1, 0]))
        for first, last in zip(single[::2].tolist(), single[1::2].tolist()):
            if last - first >= 3:
                seen += 1
                hits += self.weight(b"".join(words[first : min(last, first + LONGEST)])) > 0
        return seen, hits

    def features(self, raw: str | None) -> list[float]:
        raw = raw or ""
        low = signless(raw)
        words = low.translate(LETTERS).split()
        n, length = max(1, len(words)), max(1, len(raw))
        count = Counter(words)
        known, weight = self.known.get, self.weight
        hit = {}
        for w, c in count.items():
            x = known(w)
            if x is None:
                x = weight(w)
            if x:
                hit[w] = (x, c)
        hits, strength = sum(c for _, c in hit.values()), sum(w * c for w, c in hit.values())
        you = sum(count[w] for w in YOU & count.keys())
        near = 0
        if hits and you:
            at = [k for k, w in enumerate(words) if w in YOU]
            for k, w in enumerate(words):
                if w in hit:
                    p = bisect_left(at, k - NEAR)
                    near += p < len(at) and at[p] <= k + NEAR
        bytes_ = np.frombuffer(raw.encode(errors="replace"), np.uint8)
        of = np.bincount(bytes_, minlength=256)
        capitals = int(of[65:91].sum())
        letters = capitals + int(of[97:123].sum() + of[0xC3:].sum())
        if of[0xC3]:
            capitals += int(((bytes_[:-1] == 0xC3) & (bytes_[1:] >= 0x80) & (bytes_[1:] <= 0x9E) & (bytes_[1:] != 0x97)).sum())
        loud = len(LOUD.findall(raw)) if capitals > 1 else 0
        b = np.frombuffer(low, np.uint8)
        letter, equal = LETTER[b], b[1:] == b[:-1]
        same = equal[1:] & equal[:-1] & letter[2:]
        same[1:] &= ~same[:-1].copy()  # the first place of each run
        runs = np.flatnonzero(same)
        hidden, hidden_hits = self.masked(low, words, count, np.concatenate([runs, np.flatnonzero(MASK[b[:-1]] & letter[1:])]))
        return [
            float(hits), float(len(hit)), strength, max((w for w, _ in hit.values()), default=0.0), hits / n, strength / n, float(hidden_hits), hidden_hits / n, near / max(1, hits), you / n,
            capitals / max(1, letters), loud / n, int(of[33] + of[63]) / n, int(of[PUNCTUATION].sum()) / length, hidden / n, len(runs) / n, int(of[48:58].sum()) / length, math.log1p(len(words)), len(count) / n, letters / n,
        ]


def _fragment_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fragment, clean, toxic) documents, summed within a task as far as memory allows."""

    def flushed(held):
        return pa.RecordBatch.from_arrays([pa.array([*held]), pa.array([c for c, _ in held.values()], pa.int64()), pa.array([t for _, t in held.values()], pa.int64())], names=["fragment", "clean", "toxic"])

    held: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column("_text"), batch.column("_toxic").to_pylist()):
            for f in {f for w in set(signless(text.as_py() or "").translate(LETTERS).split()) for f in fragments(w.decode(errors="replace"))}:
                held.setdefault(f, [0, 0])[toxic] += 1
            if len(held) > 300_000:
                yield flushed(held)
                held = {}
    if held:
        yield flushed(held)


def _described(lexicon: Lexicon, labelled: bool) -> Callable:
    """Adds the features; labelled rows without their own share of the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Describer(w) for w in lexicon.less] if labelled else [Describer(lexicon.any)]
        for batch in batches:
            which = batch.column("_toxic").to_pylist() if labelled else [0] * batch.num_rows
            found = [tables[k].features(text.as_py()) for text, k in zip(batch.column("_text"), which)]
            rest = [k for k, c in enumerate(batch.schema.names) if c != "_text"]
            columns = [*(batch.column(k) for k in rest), pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[k] for k in rest), "_features"])

    return run


class Model:
    """A lexicon, boosted trees and their calibration."""

    def __init__(self, lexicon: Lexicon, share: float, trees=None, calibration=None):
        self.lexicon, self.share, self.trees, self.calibration = lexicon, share, trees, calibration

    def score(self, documents: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
        """The kept columns as _0, _1, ... and _score."""
        rows = documents.select(*(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(keep)), F.col(text_col).alias("_text"))
        if self.trees is None:
            return rows.drop("_text").withColumn("_score", F.lit(float(self.share)))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("_text").schema)
        rows = rows.mapInArrow(_described(self.lexicon, False), f"{kinds}{', ' if keep else ''}_features array<double>")
        return _margins(self.trees, self.calibration, rows).drop("_features")


def _margins(trees, calibration, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    found = trees.transform(rows.withColumn("_vector", array_to_vector("_features"))).withColumn("_margin", vector_to_array("_raw")[1])
    if calibration is None:
        out = found.withColumn("_score", vector_to_array("_probability")[1])
    else:
        out = calibration.transform(found)
    return out.withColumn("_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "_score"))).drop("_vector", "_raw", "_probability", "_prediction", "_margin")


def trained(documents: DataFrame, labels: DataFrame, most: int = 16_000, entries: int = 1_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rounds: int = 25, depth: int = 3) -> Model:
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).filter("_id IS NOT NULL AND _toxic IN (0, 1)").filter(learned_from(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    place = F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(1 << 20))
    n = known.count()
    if n > most:
        known = known.filter(place < int(most / n * (1 << 20)))
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")  # about ``most`` ids
    sample = saved(texts.select("_toxic", (F.pmod(F.xxhash64("_id", F.lit(29)), F.lit(4)) == 0).alias("_calibrates"), "_text"), "labelled")
    count = {r._toxic: r.n for r in sample.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = count.get(0, 0), count.get(1, 0)
    if not clean or not toxic:
        discard(sample)
        return Model(Lexicon({}, ({}, {})), toxic / max(1, clean + toxic))
    counts = sample.mapInArrow(_fragment_counts, "fragment string, clean long, toxic long").groupBy("fragment").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    t, c = F.col("toxic"), F.col("clean")
    expected = (t + c) * (toxic / (clean + toxic))
    surprise = 2 * (t * F.log(t / expected) + F.when(c > 0, c * F.log(c / (t + c - expected))).otherwise(0.0))  # likelihood ratio
    told = counts.filter((t >= 4) & ((t + 0.5) / (toxic + 1) >= 4 * (c + 0.5) / (clean + 1))).withColumn("surprise", surprise).filter("surprise >= 24")
    lexicon = Lexicon.of([(r.fragment, r.clean, r.toxic) for r in told.orderBy(F.desc("surprise"), "fragment").limit(entries).collect()], clean, toxic)
    described = saved(sample.mapInArrow(_described(lexicon, True), "_toxic int, _calibrates boolean, _features array<double>"), "described")
    discard(sample)
    rows = described.withColumn("_vector", array_to_vector("_features"))
    fit = lambda df: GBTClassifier(featuresCol="_vector", labelCol="_toxic", predictionCol="_prediction", maxIter=rounds, maxDepth=depth, stepSize=0.2, maxBins=64, minInstancesPerNode=3, seed=7).setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(df)
    part = {(r._calibrates, r._toxic) for r in described.groupBy("_calibrates", "_toxic").count().filter("count >= 5").collect()}
    calibration = None
    if len(part) == 4:  # enough of both labels on both sides
        trees = fit(rows.filter("NOT _calibrates").coalesce(4))
        seen = _margin_rows(trees, rows.filter("_calibrates"))
        calibration = IsotonicRegression(featuresCol="_margin", labelCol="_toxic", predictionCol="_score").fit(seen)
    else:
        trees = fit(rows.coalesce(4))
    discard(described)
    return Model(lexicon, toxic / (clean + toxic), trees, calibration)


def _margin_rows(trees, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return trees.transform(rows).select(F.col("_toxic").cast("double"), vector_to_array("_raw")[1].alias("_margin")).coalesce(4)


def scored(documents: DataFrame, labels: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score", threshold: float = 0.5, **options) -> DataFrame:
    """The kept columns (the id), the score and ``predicted``."""
    keep = [id_col] if keep is None else keep
    taken = {c.lower() for c in keep}
    predicted = next(c for c in ("predicted", "_predicted", "__predicted") if c not in taken)
    if score_col.lower() in taken:
        raise ValueError(f"{score_col} is a kept column; name the score otherwise")
    found = trained(documents, labels, id_col=id_col, text_col=text_col, **options).score(documents, text_col, keep)
    return found.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(keep)), F.col("_score").alias(score_col), F.when(F.col("_score") >= threshold, 1).otherwise(0).alias(predicted))
