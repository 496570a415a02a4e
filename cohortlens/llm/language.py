"""Language identification: the family first, then pairwise linear SVMs inside it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.stage import field, in_struct, lean, staged, with_fields
from cohortlens.llm.words import byte_rows, random_numbers, slices

#: Hashed character n-grams of 1 to 3 letters.
DIMS = 2048
#: Labelled rows that a model is fitted on, over all languages.
SAMPLE_ROWS = 4000
#: Languages that a model learns.
LANGUAGES = 200
#: Numbers that rows are drawn by; far more than there are rows.
DRAWS = 1 << 62
UNKNOWN = "und"

# Families of ISO 639-1 codes. A code that isn't here is its own family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "indo-aryan": "hi bn ur mr ne pa gu si",
    "iranian": "fa ku ps tg",
    "turkic": "tr az kk ky uz tk tt",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "semitic": "ar he mt am ti",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms jv tl mg",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)
_MIX = random_numbers(4, 21) | np.uint64(1)


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the texts, and which texts have a letter.

    Lower-cased; every stretch of other characters than letters counts as one space.
    """
    codes = np.frombuffer("\0".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    # a letter may lower-case to several characters, so rows are found by their separators
    letter = _LETTER[codes]
    row = np.cumsum(codes == 0)
    clean = np.where(letter, codes, 32).astype(np.uint64)
    keep = letter | np.concatenate(([True], letter[:-1]))
    clean, row = clean[keep], row[keep] - 1
    h = np.zeros_like(clean)
    out = np.zeros(len(texts) * DIMS)
    for n in range(3):
        h = h[: len(clean) - n] * _MIX[n] + clean[n:] * _MIX[3]
        slot = ((h ^ (h >> np.uint64(29))) * _MIX[3] >> np.uint64(53)).astype(np.int64)
        inside = (row[n:] == row[: len(row) - n]) & (row[n:] < len(texts))
        inside &= (clean[n:] != 32) | (n > 0)
        out += np.bincount(row[n:][inside] * DIMS + slot[inside], minlength=len(out))
    x = np.sqrt(out.reshape(-1, DIMS))
    has = np.bincount(row[(clean != 32) & (row < len(texts))], minlength=len(texts))[: len(texts)] > 0
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), has


def text_slices(column: pa.Array, most: int = 1 << 19, rows: int = 256) -> Iterator[tuple[int, list[str]]]:
    """The column in slices of bounded bytes and rows; a zero character reads as a space."""
    data, off = byte_rows(column)
    for a, b in slices(off, most):
        for k in range(a, b, rows):
            raw = [data[off[i] : off[i + 1]].tobytes().decode().replace("\0", " ") for i in range(k, min(b, k + rows))]
            yield k, raw


class Model(NamedTuple):
    families: list[str]
    family_weights: np.ndarray  # a column for each family, the last row is the constant
    languages: dict[str, list[str]]
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]]  # weights, scale of the margin


def _descend(gradient, w: np.ndarray, step: float, rounds: int) -> np.ndarray:
    """Accelerated gradient descent."""
    last, ahead = w, w
    for k in range(rounds):
        w = ahead - step * gradient(ahead)
        ahead = w + k / (k + 3) * (w - last)
        last = w
    return w


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, langs: list[str], ridge: float = 1e-4, rounds: int = 150) -> Model:
    """Multinomial regression for the family; a squared-hinge SVM for each pair in one.

    ``x`` has a column of ones last, and a language's rows stand together: a pair is fitted
    on two views of them.
    """
    langs = np.array(langs)
    own = np.array([family_of(s) for s in langs])
    rows_of = {s: slice(int(at[0]), int(at[-1]) + 1) for s in sorted(set(langs)) for at in [np.flatnonzero(langs == s)]}
    families = sorted(set(own))
    y = (own[:, None] == np.array(families)).astype(float)
    weights = _descend(
        lambda w: x.T @ (softmax(x @ w) - y) / len(x) + ridge * w, np.zeros((x.shape[1], len(families))), 1.0, rounds
    )
    languages = {f: sorted(set(langs[own == f])) for f in families}
    pairs = {}
    for names in languages.values():
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                sides = [(x[rows_of[s]], t) for s, t in ((a, 1.0), (b, -1.0))]
                w = _descend(
                    lambda w: sum(-2 * z.T @ ((0.5 / len(z) * t) * np.maximum(0, 1 - t * (z @ w))) for z, t in sides) + ridge * w,
                    np.zeros(x.shape[1]), 0.2, rounds,
                )
                pairs[a, b] = (w, 4.0)
    return Model(families, weights, languages, pairs)


def predict(model: Model, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language with most won pairs in the likeliest family (ties: larger margins).

    Score: the family's probability times the mean of the winner's pairwise probabilities.
    """
    shares = softmax(x @ model.family_weights[:-1] + model.family_weights[-1])
    best, names, score = shares.argmax(axis=1), [""] * len(x), shares.max(axis=1)
    for k, family in enumerate(model.families):
        rows = np.flatnonzero(best == k)
        langs = model.languages[family]
        wins, sums = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
        for (a, b), (w, scale) in model.pairs.items():
            if a in langs and b in langs:
                share = 1 / (1 + np.exp(-scale * np.clip(x[rows] @ w[:-1] + w[-1], -50, 50)))
                for lang, s in ((a, share), (b, 1 - share)):
                    wins[:, langs.index(lang)] += s > 0.5
                    sums[:, langs.index(lang)] += s
        top = (wins + sums / (len(langs) + 1)).argmax(axis=1)
        for i, t in zip(rows, top):
            names[i] = langs[t]
        if len(langs) > 1:
            score[rows] *= sums[np.arange(len(rows)), top] / (len(langs) - 1)
    return names, score


def is_held_out(doc_id: Column, of: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == rest, F.lit(False))


def trained(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, most_languages: int = LANGUAGES) -> Model | None:
    """A model of the labelled ``rows`` (doc_id, text, lang), or None without any.

    Every language gives at most its equal part of ``sample_rows``, by the order of a hash
    of id and text; features are of whole texts and made by the tasks. Rows that repeat both
    are drawn once, so the rows that reach the driver are bounded whatever repeats. How many
    to draw follows from the distinct rows with a letter, estimated to a few hundredths.
    Where ``lang`` has more than ``most_languages`` values, those with the most such rows
    are learned; rows of the others are still predicted, as one of these.
    """
    rows = rows.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit("draw")), F.lit(DRAWS))
    usable = F.approx_count_distinct(F.when(F.col("text").rlike("\\p{L}"), drawn), 0.02)
    ranked = rows.groupBy("lang").agg(usable.alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    counts = {r["lang"]: max(1, r["n"]) for r in ranked.collect()}
    if not counts:
        return None
    most = max(1, sample_rows // len(counts))
    limit = F.create_map(*[v for s, n in counts.items() for v in (F.lit(s), F.lit(min(1.0, 1.3 * most / n + 20 / n) * DRAWS))])
    rows = rows.withColumn("drawn", drawn).filter(F.col("drawn") < limit[F.col("lang")]).dropDuplicates(["lang", "drawn"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch.column("text")):
                x, has = features(texts)
                part = batch.slice(at, len(texts))
                out = pa.array([v.astype(np.float32).tobytes() if h else None for v, h in zip(x, has)], pa.binary())
                yield pa.record_batch([part.column("lang"), part.column("drawn"), out], ["lang", "drawn", "x"])

    found = staged(rows.mapInArrow(of, "lang string, drawn long, x binary").filter("x is not null"), "drawn")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "x"))
    found = found.withColumn("nth", first).filter(F.col("nth") <= most).drop("nth")
    sizes = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    # one matrix, filled row by row: nothing else of the sample is held here
    at = dict(zip(sorted(sizes), np.concatenate(([0], np.cumsum([sizes[s] for s in sorted(sizes)])))[:-1].tolist()))
    x = np.ones((sum(sizes.values()), DIMS + 1))
    for r in found.orderBy("lang", "drawn", "x").coalesce(4).toLocalIterator():
        x[at[r["lang"]], :DIMS] = np.frombuffer(r["x"], np.float32)
        at[r["lang"]] += 1
    return fit(x, [s for s in sorted(sizes) for _ in range(sizes[s])])


def identified(docs: DataFrame, model: Model | None, unnamed: str | None = UNKNOWN) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the whole text alone.

    Null texts and texts without a letter: ``und``, score 0. Where there is no model, all
    others: ``unnamed``, score 0. Columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return _identified(in_struct(docs, kept), model, unnamed).select("row.*", "lang_pred", "score")


def _identified(carried: DataFrame, model: Model | None, unnamed: str | None) -> DataFrame:
    """``row, lang_pred, score`` of rows ``row``, a struct with a ``text``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(field(batch, "text")):
                x, has = features(texts)
                names, score = predict(model, x) if model else ([unnamed] * len(texts), np.zeros(len(texts)))
                names = [n if h else UNKNOWN for n, h in zip(names, has)]
                yield pa.record_batch(
                    [batch.column("row").slice(at, len(texts)), pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0))],
                    ["row", "lang_pred", "score"],
                )

    return carried.mapInArrow(lean(of), with_fields(carried, "row", lang_pred=T.StringType(), score=T.DoubleType()))


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each document.

    Fitted on documents whose crc32(doc_id) mod 4 isn't 2 and that have a ``lang``.
    """
    docs = docs.select("doc_id", "text", "lang")
    held = is_held_out(F.col("doc_id"), 4, 2)
    model = trained(docs.filter(~held))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def in_known_language(docs: DataFrame) -> DataFrame:
    """``docs`` without those that have no letter; a null ``lang`` becomes the predicted one.

    Without any labelled row there is no model: the same rows stay and ``lang`` stays null.
    """
    model = trained(docs.filter(~is_held_out(F.col("doc_id"), 4, 2)))
    found = _identified(in_struct(docs, docs.columns), model, None).filter(~F.col("lang_pred").eqNullSafe(UNKNOWN))
    return found.select(*[F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns])
