"""Quality by co-training two views of a page, and one calibrated score from both.

The text view is the content: the square roots of hashed byte-pair shares. The metadata view is what a crawler records
about the page: language, source, length and layout (shares of upper case, digits, symbols and line ends, word lengths,
shares of distinct and of repeated words). Both are logistic regressions. In every round both classifiers score every
unlabelled document. Each hands to the other one the documents it is surest of: round r takes the outermost r * ``take``
of all scores, cut at exact quantiles over all documents in the proportion of the classes, and only beyond ``sure``. A
held-out part of the labelled sample, three tenths of each class and never trained on, then calibrates each view (Platt)
and fits the weights of the two calibrated log odds.

Only what a regression is fitted on is bounded: at most ``labelled`` labelled documents, and of the pseudo-labelled ones
of each view and round a sample by hash of about ``pseudo`` rows, drawn alike from all of them. Scores, quantiles and the
choice of the surest cover all documents and grow with them: a round is one pass over the texts.

Null text, language, source or length count as empty, a value of their own and zero. A document with several labels
has their mean, rounded half up; null labels are no labels. Rows with a null id are scored but lend no pseudo-label. With
labels of one class only, or none, every document gets that class (none: 1). A class of a single labelled document uses it
both to fit and to calibrate. Repeated rows get equal scores. No rows in, no rows out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgewater.llm.words import buffers, fresh, row_chunks, words_of
from ridgewater.operators.scale import exact_quantiles
from ridgewater.session import stage

# Rows that a regression is fitted on at most: labelled ones, and about so many pseudo-labelled ones.
LABELLED = 10_000
PSEUDO = 5_000
ROUNDS = 3
# Share of all unlabelled documents that is handed over in the first round; round r takes r times as many.
TAKE = 0.1
SURE = 0.95
HELD_OUT = 0.3
VIEWS = ("text_view", "meta_view")
PAIRS, LANGS, SOURCES = 512, 8, 16
_LEFT = np.random.default_rng(5).integers(0, PAIRS, 256)
_RIGHT = np.random.default_rng(6).integers(0, PAIRS, 256)
_CLASSES = np.zeros((4, 256), np.int64)
_CLASSES[0, 65:91] = 1
_CLASSES[1, 48:58] = 1
_CLASSES[2, [b for b in range(33, 127) if not chr(b).isalnum()]] = 1
_CLASSES[3, 10] = 1


def text_view(column: pa.Array) -> np.ndarray:
    data, offsets = buffers(column)
    out = np.zeros((len(offsets) - 1, PAIRS))
    for i, j in row_chunks(offsets):
        part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(part) < 2:
            continue
        row = np.repeat(np.arange(j - i), np.diff(bounds))
        inside = row[1:] == row[:-1]
        code = row[:-1] * PAIRS + (_LEFT[part[:-1]] ^ _RIGHT[part[1:]])
        counts = np.bincount(code[inside], minlength=(j - i) * PAIRS).reshape(j - i, PAIRS)
        out[i:j] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    return out


def meta_view(texts: pa.Array, langs: list, sources: list, lengths: list) -> np.ndarray:
    data, offsets = buffers(texts)
    n = len(offsets) - 1
    out = np.zeros((n, 10 + LANGS + SOURCES))
    for i, j in row_chunks(offsets):
        part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        size = np.maximum(np.diff(bounds), 1)
        for c in range(4):
            sums = np.concatenate([[0], np.cumsum(_CLASSES[c][part])])
            out[i:j, c] = (sums[bounds[1:]] - sums[bounds[:-1]]) / size
    for words in words_of(texts):
        for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            own = words.hashes[a:b]
            if b > a:
                same = float((own[1:] == own[:-1]).mean()) if b - a > 1 else 0.0
                mean = float((words.ends[a:b] - words.starts[a:b]).mean())
                distinct = len(np.unique(own)) / (b - a)
                out[words.row + k, 4:9] = math.log1p(b - a), min(mean, 50.0) / 10, distinct, same, 1.0 - distinct**4
    out[:, 9] = [math.log1p(max(float(x or 0), 0.0)) for x in lengths]
    for i, (lang, source) in enumerate(zip(langs, sources)):
        out[i, 10 + zlib.crc32(str(lang).encode()) % LANGS] = 1
        out[i, 10 + LANGS + zlib.crc32(str(source).encode()) % SOURCES] = 1
    return out


class Line(NamedTuple):
    """A linear score: log odds = features @ weights + intercept."""

    weights: np.ndarray
    intercept: float


class Model(NamedTuple):
    text: Line
    meta: Line
    text_scale: Line
    meta_scale: Line
    both: Line
    constant: float | None

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.constant is not None:
            return (np.full(len(text), self.constant),) * 3
        t = (text @ self.text.weights + self.text.intercept) * self.text_scale.weights[0] + self.text_scale.intercept
        m = (meta @ self.meta.weights + self.meta.intercept) * self.meta_scale.weights[0] + self.meta_scale.intercept
        b = t * self.both.weights[0] + m * self.both.weights[1] + self.both.intercept
        return tuple(1 / (1 + np.exp(-np.clip(x, -50, 50))) for x in (t, m, b))


def _views(docs: DataFrame, columns: tuple[str, str, str, str, str]) -> DataFrame:
    """id, text_view, meta_view of (few) documents."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                few = batch.slice(at, 500)
                text = text_view(few.column(1))
                meta = meta_view(few.column(1), *[few.column(c).to_pylist() for c in (2, 3, 4)])
                yield pa.RecordBatch.from_arrays(
                    [few.column(0), pa.array(list(text), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.float64()))],
                    ["id", "text_view", "meta_view"],
                )

    kind = dict(docs.dtypes)[columns[0]]
    return docs.select(*columns).mapInArrow(make, f"id {kind}, text_view array<double>, meta_view array<double>")


def _fit(rows: DataFrame, view: str, strength: float = 1e-4) -> Line:
    rows = rows.select(array_to_vector(view).alias("features"), F.col("label").cast("double").alias("label"))
    fitted = LogisticRegression(maxIter=40, regParam=strength).fit(rows)
    return Line(fitted.coefficients.toArray(), float(fitted.intercept))


def _odds(rows: DataFrame, view: str, line: Line) -> DataFrame:
    weights = F.array(*[F.lit(float(w)) for w in line.weights])
    pairs = F.zip_with(F.col(view), weights, lambda x, w: x * w)
    return rows.withColumn("odds", F.aggregate(pairs, F.lit(line.intercept), lambda total, x: total + x))


def all_odds(docs: DataFrame, columns: tuple[str, str, str, str, str], lines: dict[str, Line]) -> DataFrame:
    """id, text_view and meta_view: the log odds that each view gives every document, in one pass over the texts."""
    kind = dict(docs.dtypes)[columns[0]]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                few = batch.slice(at, 500)
                views = text_view(few.column(1)), meta_view(few.column(1), *[few.column(c).to_pylist() for c in (2, 3, 4)])
                odds = [pa.array(made @ lines[view].weights + lines[view].intercept) for view, made in zip(VIEWS, views)]
                yield pa.RecordBatch.from_arrays([few.column(0), *odds], ["id", *VIEWS])

    return docs.select(*columns).mapInArrow(make, f"id {kind}, text_view double, meta_view double")


def surest(odds: DataFrame, share: float, take: float, sure: float = SURE) -> dict[str, tuple[float, float]]:
    """For each view the log odds at or below which a document is surely bad, and at or above which it is surely good.

    The outermost ``take`` of all documents, in the proportion of the classes, by exact quantiles; never within ``sure``.
    """
    limit = math.log(sure / (1 - sure))
    long = odds.select(F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("odds")) for v in VIEWS])).alias("x")).select("x.*")
    low, high = take * (1 - share), 1 - take * share
    found = {(r.view, r.p): r["quantile"] for r in exact_quantiles(long, ["view"], "odds", [low, high]).collect()}
    return {v: (min(-limit, found.get((v, low), -limit)), max(limit, found.get((v, high), limit))) for v in VIEWS}


def handed_over(odds: DataFrame, cuts: dict[str, tuple[float, float]], share: float, pseudo: int, seed: int) -> DataFrame:
    """id, view (the one that learns) and label of a sample of the documents that the other view is sure of."""
    sides = []
    for view, other in (VIEWS, VIEWS[::-1]):
        low, high = cuts[view]
        label = F.when(F.col(view) >= high, 1).when(F.col(view) <= low, 0)
        sides.append(F.struct(F.lit(other).alias("view"), label.alias("label")))
    sure = odds.select("id", F.explode(F.array(*sides)).alias("x")).select("id", "x.*").filter("label is not null")
    counts = {(r.view, r.label): r.n for r in sure.groupBy("view", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    most = F.lit(0)
    for (view, label), n in counts.items():
        wanted = max(1, pseudo * (share if label else 1 - share))
        most = F.when((F.col("view") == view) & (F.col("label") == label), math.ceil(min(1.0, wanted / n) * (1 << 30))).otherwise(most)
    return sure.filter(part < most).distinct()


def _sampled(known: DataFrame, labelled: int) -> DataFrame:
    """The ``labelled`` labelled rows with the lowest hashes; most others are cut by their hash before any is sorted."""
    n, order = known.count(), F.xxhash64("id", F.lit(7))
    if n > labelled:
        known = known.filter(F.pmod(order, F.lit(1 << 30)) < math.ceil(min(1.0, 1.5 * labelled / n) * (1 << 30)))
    return known.orderBy(F.pmod(order, F.lit(1 << 30)), "id").limit(labelled)


def train(
    docs: DataFrame,
    labels: DataFrame,
    columns: tuple[str, str, str, str, str] = ("doc_id", "text", "lang", "source", "n_chars"),
    label_id: str = "doc_id",
    label_col: str = "quality",
    labelled: int = LABELLED,
    pseudo: int = PSEUDO,
    rounds: int = ROUNDS,
    take: float = TAKE,
    sure: float = SURE,
) -> Model:
    named = labels.filter(F.col(label_col).isNotNull() & F.col(label_id).isNotNull())
    named = named.groupBy(F.col(label_id).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    here = docs.select(F.col(columns[0]).alias("id")).filter("id is not null").distinct()
    known = stage(here.join(named, "id"), "labelled")
    sample = stage(_sampled(known, labelled), "sample")
    classes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        none = Line(np.zeros(1), 0.0)
        return Model(none, none, none, none, none, float(1 in classes or not classes))
    share = classes[1] / (classes[0] + classes[1])
    # The sample is bounded, so its rows may be ranked in one task.
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit(8)), "id"))
    parts = F.when(F.col("label") == 1, classes[1]).otherwise(classes[0])
    ranked = sample.withColumn("rank", rank).withColumn("of", parts)
    judge = F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("of") * HELD_OUT))
    ranked = ranked.select("id", "label", judge.alias("held_out"), (~judge | (F.col("of") == 1)).alias("fits"))
    given = stage(_of_ids(docs, columns, ranked), "given")
    fitted_on = given.filter("fits").select("id", "label", *VIEWS)
    extra: DataFrame | None = None
    for number in range(rounds + 1):
        lines = {}
        for view in VIEWS:
            more = None if extra is None else extra.filter(F.col("view") == view).select("id", "label", *VIEWS)
            lines[view] = _fit(fitted_on if more is None else fitted_on.unionByName(more), view)
        if number < rounds:
            odds = all_odds(docs.filter(F.col(columns[0]).isNotNull()), columns, lines)
            odds = stage(odds, "odds").join(known.select("id"), "id", "left_anti")
            cuts = surest(odds, share, min(1.0, take * (number + 1)), sure)
            extra = stage(_of_ids(docs, columns, stage(handed_over(odds, cuts, share, pseudo, number), "pseudo")), "pseudo-views")

    judged = given.filter("held_out")
    scales = {}
    for view in VIEWS:
        scales[view] = _fit(_odds(judged, view, lines[view]).withColumn("one", F.array("odds")), "one")
    both = judged
    for view in VIEWS:
        scale = scales[view]
        both = _odds(both, view, lines[view]).withColumn(f"{view}_odds", F.col("odds") * float(scale.weights[0]) + scale.intercept)
    both = both.withColumn("two", F.array("text_view_odds", "meta_view_odds"))
    return Model(lines["text_view"], lines["meta_view"], scales["text_view"], scales["meta_view"], _fit(both, "two"), None)


def _of_ids(docs: DataFrame, columns: tuple[str, str, str, str, str], ids: DataFrame) -> DataFrame:
    """The views of the documents of a bounded sample, with the sample's columns; of rows with one id any one counts."""
    wanted = ids.select(F.col("id").alias("_wanted")).distinct()
    found = docs.select(*columns)
    found = found.join(F.broadcast(wanted), F.col(columns[0]) == F.col("_wanted"), "left_semi")
    return _views(found, columns).dropDuplicates(["id"]).join(F.broadcast(ids), "id").coalesce(12)


SCORES = ("__text_score", "__meta_score", "__score")


def scored(
    docs: DataFrame,
    model: Model,
    columns: tuple[str, str, str, str, str] = ("doc_id", "text", "lang", "source", "n_chars"),
    names: tuple[str, str, str] = SCORES,
) -> DataFrame:
    """Every row with all its columns and both views' and the joint chance of good quality, under ``names``."""
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType(list(docs.schema.fields))
    for name in names:
        schema = schema.add(name, DoubleType())
    at = [docs.columns.index(c) for c in columns]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                few = batch.slice(start, 500)
                text = text_view(few.column(at[1]))
                meta = meta_view(few.column(at[1]), *[few.column(c).to_pylist() for c in at[2:]])
                made = [pa.array(np.asarray(s, np.float64)) for s in model.scores(text, meta)]
                yield pa.RecordBatch.from_arrays([*few.columns, *made], [*few.schema.names, *names])

    return docs.mapInArrow(score, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose chance of good quality is at least one half, with their columns."""
    names = tuple(fresh(docs.columns, *SCORES))
    return scored(docs, train(docs, labels), names=names).filter(F.col(names[2]) >= 0.5).select(*docs.columns)
