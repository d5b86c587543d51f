"""Language identification by compression: the language whose dictionary compresses a text best.

Each language has a zstandard raw-content dictionary made of training texts. A text, in
lower case and with one space for whatever is no letter, is cut into chunks, every chunk is compressed with every dictionary, and the language with the fewest bytes in
all wins. The margin to the second is the confidence; narrow margins are marked as rejected.

Fitting is bounded: ``DOCS_PER_LANG`` texts for each language, each giving up to ``SAMPLE_CHARS``
characters from a hashed place in it, so dictionaries take ``DICTIONARY_BYTES`` each at most. Every language with labelled rows is
learned. Classifying reads every whole text, without a shuffle; its time grows with the number of languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.text import slices, widened

FOLDS, HELD_OUT = 4, 2
DOCS_PER_LANG = 96
SAMPLE_CHARS = 1500
DICTIONARY_BYTES = 112 << 10
CHUNK = 4096
LEVEL, MIN_MATCH = 9, 4
MIN_MARGIN = 0.02
SHARPNESS = 0.25
UNDETERMINED = "und"
LETTER = r"\p{L}"  # no numerals such as ½, which are word characters
BETWEEN_LETTERS = r"[\W\d_]+"


def plain(text: str) -> bytes:
    """Letters in lower case, whatever stands between them as one space."""
    return re.sub(BETWEEN_LETTERS, " ", text.lower()).encode()


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; null ids have none."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, *, docs_per_lang: int = DOCS_PER_LANG) -> dict[str, bytes]:
    """Dictionaries by language, from texts with a letter and a ``lang`` outside the held-out fold.

    Rows, and the place of the excerpt of each, are chosen by a hash of id and text, so the same rows give the
    same dictionaries.
    """
    text = F.col("text").cast("string")
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & text.rlike(LETTER)).select(
        F.col("lang").cast("string").alias("lang"), text.alias("text"), F.xxhash64("doc_id", text).alias("place")
    )
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return {}
    space = 1 << 30
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, int(space * min(1.0, 4 * docs_per_lang / r["count"])))])
    few = rows.where(F.pmod("place", F.lit(space)) < F.element_at(shares, F.col("lang")))
    begin = F.pmod(F.xxhash64("place"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    few = few.select("lang", F.substring(F.col("text"), begin, F.lit(SAMPLE_CHARS)).alias("text"), "place").dropDuplicates(["lang", "text"])
    order = Window.partitionBy("lang").orderBy("place", "text")  # about 4 * docs_per_lang rows for each language
    best = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_lang).collect()
    out: dict[str, bytes] = {}
    for row in sorted(best, key=lambda r: (r.lang, -r.n)):
        out[row.lang] = (out.get(row.lang, b"") + plain(row.text) + b" ")[-DICTIONARY_BYTES:]
    return {lang: content for lang, content in out.items() if len(content) >= 8}


class Classifier:
    """Compressors by language."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import regex
        import zstandard

        self.letter = regex.compile(LETTER).search
        self.langs = sorted(dictionaries)
        self.compressors = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            self.compressors.append(zstandard.ZstdCompressor(dict_data=content, compression_params=params).compress)

    def sizes(self, text: bytes) -> np.ndarray:
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        return np.array([sum([len(compress(c)) for c in chunks]) for compress in self.compressors], float)

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin: how much larger the second-smallest result is."""
        if text is None or not self.langs or not self.letter(text):
            return UNDETERMINED, 0.0, 0.0
        sizes = self.sizes(plain(text))
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        margin = float(sizes[order[1]] / best - 1) if len(order) > 1 else 1.0
        score = float(1 / np.exp(-SHARPNESS * np.minimum(sizes - best, 2000)).sum())
        return self.langs[order[0]], score, margin


def classify(docs: DataFrame, dictionaries: dict[str, bytes], *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected`` for each whole text.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned.
    ``rejected`` marks these and margins under ``MIN_MARGIN``; ties go to the first language by name.
    Only ``text`` is read; columns of these four names are replaced.
    """
    new = ("lang_pred", "score", "margin", "rejected")
    rest = docs.drop(*new)
    columns = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(dictionaries)
        for batch in batches:
            for part in slices(batch, text):
                found = [judge.classify(t) for t in part.column(text).to_pylist()]
                lang, score, margin = ([f[i] for f in found] for i in range(3))
                rejected = [f[0] == UNDETERMINED or f[2] < MIN_MARGIN for f in found]
                made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*columns, *new])

    return rest.mapInArrow(run, widened(rest, "lang_pred string, score double, margin double, rejected boolean"))
