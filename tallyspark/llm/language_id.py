"""Hierarchical language identification with linear support vector machines.

A text is seen as its byte trigrams: A-Z lower-cased, every other ASCII
character that is no letter read as a space, runs without letters left out. The
first level tells language families apart (one machine for each family against
the rest); within the chosen family one machine for each pair of languages votes.

The machines learn from a bounded sample of labelled rows, at most about
``per_language`` for each language, chosen by a hash of the id; counting and
prediction cover all rows and whole texts. A prediction is the mean weight of a
text's trigrams, so texts of any length cost a few numpy passes and bounded memory.

Defined results: a text that is null or has no letter is ``und`` with score 0, and
so is every text if nothing could be learned; null labels and rows of the held-out
fold are never learned from; a null id is neither held out nor learned from; ties
go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .common import forget_pieces

BITS = 15
#: Families of languages, as fixed values; a language without an entry is its own family.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature of the trigram at each byte, row offsets). Feature 0 has no weight."""
    b = np.full(len(raw) + 2, 32, dtype=np.uint32)
    b[1:-1] = _FOLD[raw]
    gram = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    feature = (gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    feature[b[1:-1] == 32] = 0  # the middle must be a letter, or every gap would count thrice
    return feature, rows


def learned_from(id_col: Column) -> Column:
    """Not of the held-out fold."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 != 2


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each text as (features, counts)."""
    forget_pieces()
    for batch in batches:
        for first, last, raw, rows in bytehash.slices(batch.column("_text")):
            feature, at = trigrams(raw, rows)
            found = [np.unique(feature[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:])]
            found = [(u[u > 0], c[u > 0]) for u, c in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_lang").slice(first, last - first), pa.array([u.astype("<i4").tobytes() for u, _ in found], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())],
                names=["_lang", "features", "counts"],
            )


def support_vector_machine(examples: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, c: float = 10.0, epochs: int = 15) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by dual coordinate descent."""
    w = np.zeros(1 << BITS)
    alpha = np.zeros(len(examples))
    weight = c / np.maximum(np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum()), 1) * len(examples) / 2
    square = np.array([float(v @ v) for _, v in examples]) + 0.5 / weight
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            f, v = examples[i]
            gradient = sign[i] * float(w[f] @ v) - 1 + alpha[i] * 0.5 / weight[i]
            new = max(alpha[i] - gradient / square[i], 0.0)
            if new != alpha[i]:
                w[f] += (new - alpha[i]) * sign[i] * v
                alpha[i] = new
    return w.astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    columns: list[tuple]  # ("family", k) or ("pair", i, j), as the rows of weights
    weights: np.ndarray


def train(rows: list) -> Model | None:
    """``rows``: (language, features, counts)."""
    examples, names = [], []
    for lang, f, n in rows:
        f, n = np.frombuffer(f, "<i4"), np.frombuffer(n, "<i4").astype(np.float64)
        if len(f):
            examples.append((f, n / n.sum() * 10))
            names.append(lang)
    if not examples:
        return None
    languages = sorted(set(names))
    of = [FAMILY_OF.get(x, x) for x in languages]
    families = sorted(set(of))
    names_at = np.array([languages.index(x) for x in names])
    family_at = np.array([families.index(of[k]) for k in names_at])
    columns, weights = [], []
    for k in range(len(families) if len(families) > 1 else 0):
        columns.append(("family", k))
        weights.append(support_vector_machine(examples, np.where(family_at == k, 1.0, -1.0)))
    for i in range(len(languages)):
        for j in range(i + 1, len(languages)):
            if of[i] == of[j]:
                take = np.flatnonzero((names_at == i) | (names_at == j))
                columns.append(("pair", i, j))
                weights.append(support_vector_machine([examples[t] for t in take], np.where(names_at[take] == i, 1.0, -1.0)))
    table = np.array(weights, dtype=np.float32).reshape(len(weights), 1 << BITS)
    if len(table):
        table[:, 0] = 0
    return Model(languages, families, columns, table)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * np.clip(x, -30, 30)))


def predict(model: Model | None, raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the language, score) for each row; -1 where there is no trigram."""
    n = len(rows) - 1
    if model is None:
        return np.full(n, -1), np.zeros(n)
    feature, at = trigrams(raw, rows)
    counts = np.concatenate([[0], np.cumsum(feature > 0)])
    counts = counts[at[1:]] - counts[at[:-1]]
    scores = np.zeros((len(model.columns), n))
    for k, w in enumerate(model.weights):
        total = np.concatenate([[0.0], np.cumsum(w[feature], dtype=np.float64)])
        scores[k] = (total[at[1:]] - total[at[:-1]]) / np.maximum(counts, 1) * 10
    of = np.array([model.families.index(FAMILY_OF.get(x, x)) for x in model.languages])
    first = [k for k, c in enumerate(model.columns) if c[0] == "family"]
    family = np.argmax(scores[first], axis=0) if first else np.zeros(n, dtype=np.int64)
    sure = _sigmoid(scores[first].max(axis=0)) if first else np.ones(n)
    votes, support = np.zeros((len(model.languages), n)), np.zeros((len(model.languages), n))
    met = np.zeros(len(model.languages))
    for k, c in enumerate(model.columns):
        if c[0] == "pair":
            p = _sigmoid(scores[k])
            for lang, q in ((c[1], p), (c[2], 1 - p)):
                votes[lang] += (q > 0.5) if lang == c[2] else (q >= 0.5)
                support[lang] += q
                met[lang] += 1
    votes = np.where(of[:, None] == family[None, :], votes, -1)
    best = np.argmax(votes, axis=0)
    inside = np.where(met[best] > 0, support[best, np.arange(n)] / np.maximum(met[best], 1), 1.0)
    return np.where(counts > 0, best, -1), np.where(counts > 0, sure * inside, 0.0)


def _predictions(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_pieces()
        for batch in batches:
            texts = batch.column("_text")
            for first, last, raw, rows in bytehash.slices(texts):
                lang, score = predict(model.value, raw, rows)
                letters = np.concatenate([[0], np.cumsum((_FOLD[raw] > 32) & (raw < 128))])
                for k in np.flatnonzero((letters[rows[1:]] == letters[rows[:-1]]) & (lang >= 0)):
                    if not any(c.isalpha() for c in texts[first + int(k)].as_py() or ""):
                        lang[k], score[k] = -1, 0.0
                names = [model.value.languages[k] if k >= 0 else "und" for k in lang]
                yield pa.RecordBatch.from_arrays([c.slice(first, last - first) for c in batch.columns[1:]] + [pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[1:], "_pred", "_score"])

    return run


def identified(documents: DataFrame, per_language: int = 1000, max_languages: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", pred_col: str = "lang_pred", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: the id) with the predicted language and its score.

    ``per_language``: rows to learn a language from, on the average, as the model is
    fitted on a bounded sample; more than ``max_languages`` languages are an error.
    """
    spark = documents.sparkSession
    fold = documents.filter(learned_from(F.col(id_col)) & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    sizes = {r[0]: r[1] for r in fold.groupBy("_lang").count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} values in {lang_col}: the model learns a machine for each pair within a family on the driver")
    sample = None
    for lang, size in sorted(sizes.items()):
        # a share of the hash range gives the sample's size on the average
        part = (F.col("_lang") == lang) & (F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, per_language / size)))
        sample = part if sample is None else sample | part
    rows = fold.filter(sample).select("_lang", "_text").mapInArrow(_sparse, "_lang string, features binary, counts binary").collect() if sizes else []
    model = spark.sparkContext.broadcast(train(sorted(rows)))
    keep = [id_col] if keep is None else keep
    source = documents.select(F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    out = source.mapInArrow(_predictions(model), f"{kinds}, _pred string, _score double")
    return out.select(*[F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)], F.col("_pred").alias(pred_col), F.col("_score").alias(score_col))
