"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a text are densities of lexicon words, how near such words stand to second-person
pronouns, and rates of capitals, punctuation and obfuscated spellings. One lexicon is fixed (plain
insults); the other is learned: word beginnings of 3 to 8 letters and whole words that labelled
toxic texts use far more often than others. Trees, lexicon and calibration learn from labelled rows
only; the calibration rows are not used for trees or lexicon.

Fitting reads a bounded sample: ``max_rows`` labelled rows, chosen by a hash of the id; the learned
lexicon has at most ``LEXICON`` entries. Scoring is one pass over all whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.storage import stored
from fleetlens.llm.text import Prefixes, slices, small_batches, widened
from fleetlens.llm.tokens import DIGIT, LOWER, MARK, UPPER, Words

MAX_ROWS = 20_000
FOLDS = 5
HELD_OUT, CALIBRATION = 0, 1
LEXICON = 2000
MIN_DOCS, MIN_Z, MIN_LOG_ODDS = 4, 3.0, 2.0
STEMS = range(3, 9)
NEAR_WORDS = 5
TIE_SHARE = 0.02
READ_AT_ONCE = 1 << 20  # bytes of text
TREES, TREE_DEPTH = 20, 4

INSULTS = (
    "arschloch bastard bête bitch cabrón clown connard crétin cretin débil degenerate disgusting dreck dumb dumm "
    "dummkopf estúpido filth fool freak garbage gilipollas idiot idiota idiote imbecile imbécile imbécil jerk "
    "loser maldito moron nutzlos pathetic pendejo pig salaud scum stupid stupide trash trottel ugly vermin wertlos worthless"
).split()
SECOND_PERSON = (
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer eure tu te toi ton ta tes "
    "vous votre vos tú ti tuyo tuya usted ustedes vosotros vosotras vuestro vuestra"
).split()
FEATURES = (
    "insults", "learned_hits", "learned_weight", "learned_log_count", "learned_most", "second_person", "near_second_person",
    "capitals", "shouted_words", "punctuation", "exclamations", "obfuscated", "stretched", "digits", "log_words",
)
DISGUISES = "@$*!#013457|"


def _hash_words(words: list[str]) -> np.ndarray:
    out = [Prefixes(np.array([ord(c) for c in w], np.uint32)).run(np.array([0]), np.array([len(w)]))[0] for w in words]
    return np.sort(np.array(out, np.uint64))


def _found(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of the hashes in a sorted table; -1 where they are not in it."""
    if not len(table):
        return np.full(len(hashes), -1)
    rough = np.zeros(1 << 16, bool)
    rough[(table & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = np.full(len(hashes), -1)
    maybe = np.flatnonzero(rough[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.searchsorted(table, hashes[maybe])
    at[at == len(table)] = 0
    good = table[at] == hashes[maybe]
    out[maybe[good]] = at[good]
    return out


def features(texts: pa.Array, entries: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text. ``entries`` are sorted hashes of the learned lexicon."""
    words = Words(texts)
    docs, n_words = len(words.bounds) - 1, np.diff(words.first)
    out = np.zeros((docs, len(FEATURES)))
    per_word = np.maximum(n_words, 1)

    def by_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc, values, docs)

    whole = words.whole()
    insult = _found(whole, _hash_words(INSULTS)) >= 0
    person = _found(whole, _hash_words(SECOND_PERSON)) >= 0
    weight = np.zeros(len(whole))
    for which, hashes in words.stems(STEMS):
        place = _found(hashes, entries)
        hit = np.flatnonzero(place >= 0)
        weight[which[hit]] = np.maximum(weight[which[hit]], weights[place[hit]])
    learned = weight > 0

    out[:, 0] = by_doc(insult) / per_word
    out[:, 1] = by_doc(learned) / per_word
    out[:, 2] = by_doc(weight) / per_word
    out[:, 3] = np.log1p(by_doc(learned))
    np.maximum.at(out[:, 4], words.doc, weight)
    out[:, 5] = by_doc(person) / per_word
    bad = learned | insult
    people = np.flatnonzero(person)
    if len(people) and bad.any():
        hits = np.flatnonzero(bad)
        after = np.searchsorted(people, hits)
        near = np.zeros(len(hits), bool)
        for side in (np.maximum(after - 1, 0), np.minimum(after, len(people) - 1)):
            near |= (np.abs(people[side] - hits) <= NEAR_WORDS) & (words.doc[people[side]] == words.doc[hits])
        out[:, 6] = np.bincount(words.doc[hits[near]], minlength=docs) / per_word

    doc_of_point = np.repeat(np.arange(docs), np.diff(words.bounds))
    points = np.maximum(np.diff(words.bounds), 1)

    def of_points(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc_of_point[mask], minlength=docs)

    upper = words.kind == UPPER
    letters = np.maximum(of_points(upper | (words.kind == LOWER)), 1)
    out[:, 7] = of_points(upper) / letters
    uppers = np.concatenate(([0], np.cumsum(upper)))
    size = words.ends - words.starts
    out[:, 8] = by_doc((size > 1) & (uppers[words.ends] - uppers[words.starts] == size)) / per_word
    out[:, 9] = of_points(words.kind == MARK) / points
    out[:, 10] = of_points((words.points == ord("!")) | (words.points == ord("?"))) / points
    disguise = np.isin(words.points, [ord(c) for c in DISGUISES])
    letter = upper | (words.kind == LOWER)
    if len(letter) > 2:
        same_doc = doc_of_point[:-2] == doc_of_point[2:]
        swapped = np.flatnonzero(letter[:-2] & disguise[1:-1] & letter[2:] & same_doc)
        out[:, 11] = np.bincount(doc_of_point[swapped], minlength=docs) / per_word
        drawn = letter[:-2] & (words.lower[:-2] == words.lower[1:-1]) & (words.lower[1:-1] == words.lower[2:]) & same_doc
        out[:, 12] = np.bincount(doc_of_point[np.flatnonzero(drawn)], minlength=docs) / per_word
    out[:, 13] = of_points(words.kind == DIGIT) / points
    out[:, 14] = np.log1p(n_words)
    return out


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids have none."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


@dataclass(frozen=True)
class Model:
    """``trees`` and ``calibration`` are None where there was nothing to learn from; ``prior`` is the share of toxic rows."""

    entries: np.ndarray
    weights: np.ndarray
    trees: Any
    calibration: Any
    prior: float


def _lexicon(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Stems that toxic rows use more often, by the log-odds of the texts that have them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=READ_AT_ONCE):
                words = Words(part.column("text"))
                toxic = np.asarray(part.column("toxic")).astype(bool)
                stems = [np.unique(np.stack((h, words.doc[w].astype(np.uint64))), axis=1) for w, h in _chunks(words)]
                if not stems:
                    continue
                hashes, doc = np.concatenate(stems, axis=1)
                values, which, n = np.unique(hashes, return_inverse=True, return_counts=True)
                a = np.bincount(which, toxic[doc.astype(np.int64)], len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), pa.array(a), pa.array(n)], ["stem", "a", "n"]
                )

    def _chunks(words: Words):
        return [(w, h) for w, h in words.stems(STEMS) if len(w)]

    totals = rows.agg(F.sum("toxic"), F.count("*")).first()
    toxic, others = float(totals[0] or 0), float(totals[1] - (totals[0] or 0))
    counts = rows.mapInArrow(counted, "stem long, a long, n long").groupBy("stem").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    a, b, half = F.col("a"), F.col("n") - F.col("a"), F.lit(0.5)
    odds = F.log((a + half) / (F.lit(toxic) - a + half)) - F.log((b + half) / (F.lit(others) - b + half))
    z = odds / F.sqrt(F.lit(1.0) / (a + half) + F.lit(1.0) / (b + half))
    best = (
        counts.where(a >= MIN_DOCS).select("stem", odds.alias("odds"), z.alias("z"))
        .where((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_LOG_ODDS)).orderBy(F.desc("z"), "stem").limit(LEXICON).collect()
    )
    stems = np.array([r.stem for r in best], np.int64).view(np.uint64)
    order = np.argsort(stems)
    return stems[order], np.array([r.odds for r in best], float)[order]


def _featured(rows: DataFrame, entries: np.ndarray, weights: np.ndarray) -> DataFrame:
    rest = rows.drop("__features")
    columns = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=READ_AT_ONCE):
                values = features(part.column("text"), entries, weights)
                ends = pa.array(np.arange(0, values.size + 1, len(FEATURES), dtype=np.int32))
                made = pa.ListArray.from_arrays(ends, pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*columns, "__features"])

    return rest.mapInArrow(run, widened(rest, "__features array<double>"))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, seed: int = 7) -> Model:
    """Learn from ``labels`` (``doc_id``, ``toxic``) of documents outside the held-out fold.

    Null labels and labels without a document are left out; of contradicting labels of one id the
    toxic one counts. With no labelled rows, or rows of one class only, the model gives every text
    the share of toxic rows (0 without rows).
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    small_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    usable = (
        labels.select(doc_id.alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    )
    share = min(1.0, max_rows / max(usable.count(), 1))
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(sample), "doc_id").dropDuplicates(["text", "toxic"])  # sample: about max_rows rows at most
    rows = stored(rows.withColumn("fold", remainder(F.col("doc_id"), FOLDS)), "labelled")
    learn = rows.where(F.col("fold") != CALIBRATION)
    counts = {r.toxic: r["count"] for r in learn.groupBy("toxic").count().collect()}
    prior = counts.get(1, 0) / max(sum(counts.values()), 1)
    nothing = np.zeros(0, np.uint64), np.zeros(0)
    if len(counts) < 2:
        return Model(*nothing, None, None, prior)
    entries, weights = _lexicon(learn)
    ready = stored(_featured(rows, entries, weights).select("fold", "toxic", F.col("__features").alias("f")).coalesce(2), "features")
    vectors = ready.select("fold", F.col("toxic").cast("double").alias("label"), array_to_vector("f").alias("features"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=0.3, maxBins=64, seed=seed).fit(
        vectors.where(F.col("fold") != CALIBRATION)
    )
    held = trees.transform(vectors.where(F.col("fold") == CALIBRATION)).select(
        "label", vector_to_array("probability")[1].alias("features")
    )
    held = stored(held, "calibration")
    calibration = None if held.isEmpty() else IsotonicRegression().fit(held)
    return Model(entries, weights, trees, calibration, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5, else 0) from each whole ``text``.

    The calibrated value counts for 98 %, the trees' own probability for 2 %, so that texts on one
    step of the calibration keep their order. Null texts are scored as empty ones. Columns of these
    two names are replaced; no other column is read.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rest = docs.drop("score", "predicted")
    columns = [F.col(f"`{c}`") for c in rest.columns]
    if model.trees is None:
        value = F.lit(float(model.prior))
        return rest.select(*columns, value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))
    kept = F.struct(*columns).alias("__row")
    text = rest.select(kept, F.col("text").cast("string").alias("text"))
    ready = _featured(text, model.entries, model.weights).select("__row", array_to_vector("__features").alias("features"))
    judged = model.trees.transform(ready).select("__row", vector_to_array("probability")[1].alias("features"))
    value = F.col("features")
    if model.calibration is not None:
        judged = model.calibration.transform(judged)
        value = F.lit(1 - TIE_SHARE) * F.col("prediction") + F.lit(TIE_SHARE) * F.col("features")
    judged = judged.select("__row", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("score"))
    return judged.select("__row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
