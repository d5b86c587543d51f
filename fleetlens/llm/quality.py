"""Quality rules with built-in functions only: text statistics and distance from a language's usual distributions.

A document fails the base rules when it has few words or repeats itself. One that passes is
compared with its language: the shares of its character classes, and of the language's common
words, against those of all the language's documents, by Jensen-Shannon distance (the square root
of the divergence to base 2, so 0 to 1). Short documents are not compared: their histograms say little.

Words are counted first, over all documents; then every document is measured, once, into a small row without its
text, and the class shares are sums of those rows. Common words are those with at least one word in
``COMMON`` of their language, so there are at most ``COMMON`` for each; languages with fewer than
``MIN_LANG_DOCS`` documents, and those after the ``MAX_LANGS`` most frequent, share the reference ``*`` of all
documents. Only sums are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.storage import stored

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
REPEATED_PERCENT = 30
# Character classes besides white space: lower and upper case, other characters beyond ASCII, digits. The rest is
# ASCII punctuation and symbols. The frequent first one is counted by what is left without its runs.
CLASSES = (r"\p{Ll}+", r"\p{Lu}", r"[^\x00-\x7F\p{Ll}\p{Lu}\p{N}]", r"\p{N}")
N_CLASSES = len(CLASSES) + 2
COMMON = 400
MIN_LANG_DOCS = 20
ALL = "*"
MIN_CHARS_COMPARED, MIN_WORDS_COMPARED = 100, 50
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.27, 0.45


def spaced(text: Column) -> Column:
    """The text with a space for every white space character."""
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """Words as they are; none for a null text."""
    return F.filter(F.split(spaced(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, without a further projection."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _neighbours(array: Column, step: int) -> Column:
    """Hashes of pairs of elements that are ``step`` apart."""
    n = F.greatest(F.size(array) - step, F.lit(0))
    return F.zip_with(F.slice(array, 1, n), F.slice(array, 1 + step, n), lambda x, y: F.xxhash64(x, y))


def repeated_words(array: Column) -> Column:
    """Words in windows that occur twice or more in an array of words.

    Windows are told apart by 64-bit hashes, doubled from words to pairs, fours and eights.
    """

    def covered(places: Column) -> Column:  # sorted
        n = F.size(places)
        gap = lambda i: F.least(F.lit(WINDOW), F.get(places, i) - F.get(places, i - 1))
        return F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(WINDOW), lambda total, i: total + F.when(i < n, F.coalesce(gap(i), F.lit(0))).otherwise(0))

    def placed(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return _let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def counted(h: Column) -> Column:
        every = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(every, placed)).otherwise(0)  # few documents repeat a window

    hashes = F.transform(array, lambda w: F.xxhash64(w))
    pairs = lambda h: _let(_neighbours(h, 1), fours)
    fours = lambda h: _let(_neighbours(h, 2), eights)
    eights = lambda h: _let(_neighbours(h, 4), counted)
    return _let(hashes, pairs).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measured(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with the base columns ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``.

    The text's length, its words and its class counts stay as ``__size``, ``__words`` and ``__classes``.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rest = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    columns = [F.col(f"`{c}`") for c in rest.columns]
    rest = rest.select(
        *columns,
        F.length(body).alias("__size"),
        words(body).alias("__words"),
        F.array(*class_counts(body)).alias("__classes"),
        F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        duplicate_lines(body).alias("n_dup_lines"),
    )
    return rest.select(
        *columns, "__size", "__words", "__classes",
        F.size("__words").cast("long").alias("n_words"),
        (F.col("__size") - F.element_at("__classes", N_CLASSES - 1)).cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines",
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def class_counts(text: Column) -> list[Column]:
    """Characters of each class, then white space, then the rest."""
    size = F.length(text)
    counts = [
        (size - F.length(F.regexp_replace(text, c, "")) if c.endswith("+") else F.regexp_count(text, F.lit(c))).cast("long")
        for c in CLASSES
    ]
    blank = (size - F.length(F.replace(spaced(text), F.lit(" "), F.lit("")))).cast("long")
    return [*counts, blank]


def common_words(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> tuple[list[str], dict[str, dict[str, float]]]:
    """The languages with a reference of their own, and for each and for ``*`` the shares of its common words.

    Counted over all words of all documents. Every language with ``MIN_LANG_DOCS`` documents has a reference of at most
    ``COMMON`` words, so their size grows with the number of languages only. Null languages count for ``*`` only.
    """
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    top = rows.where(F.col("lang").isNotNull() & (F.col("lang") != ALL)).groupBy("lang").agg(F.count("*").alias("docs"))
    top = top.where(F.col("docs") >= MIN_LANG_DOCS)
    langs = sorted(r.lang for r in top.collect())
    counted = rows.select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang", "word").count()
    counted = stored(counted, "word-counts")
    sums = counted.where(F.col("lang").isin(langs)).groupBy(F.col("lang").alias("ref")).agg(F.sum("count").alias("n"))
    sums = sums.unionAll(counted.agg(F.sum("count").alias("n")).select(F.lit(ALL).alias("ref"), "n"))
    totals = {r.ref: r.n or 0 for r in sums.collect()}
    least = F.create_map(*[F.lit(x) for ref, n in totals.items() for x in (ref, n / COMMON)])
    own = counted.where(F.col("lang").isin(langs) & (F.col("count") >= F.element_at(least, F.col("lang"))))
    pooled = counted.groupBy("word").agg(F.sum("count").alias("count")).where(F.col("count") >= F.lit(totals[ALL] / COMMON))
    found = own.select(F.col("lang").alias("ref"), "word", "count").unionAll(pooled.select(F.lit(ALL).alias("ref"), "word", "count"))
    shares: dict[str, dict[str, float]] = {ref: {} for ref in (*langs, ALL)}
    for r in found.collect():
        shares[r.ref][r.word] = r["count"] / totals[r.ref]
    return langs, shares


def _part(p: Column, q: Column) -> Column:
    """The share of one cell in the Jensen-Shannon divergence of p and q."""
    mean = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / mean)).otherwise(0.0) / 2 + F.when(q > 0, q * F.log2(q / mean)).otherwise(0.0) / 2


def class_distance(counts: Column, size: Column, usual: Column) -> Column:
    """Distance of a document's class shares, and what is left of each, from the shares ``usual``."""
    total, p_rest, q_rest = F.lit(0.0), F.lit(1.0), F.lit(1.0)
    for i in range(N_CLASSES - 1):
        p, q = F.element_at(counts, i + 1) / size, F.element_at(usual, i + 1)
        total, p_rest, q_rest = total + _part(p, q), p_rest - p, q_rest - q
    total = total + _part(F.greatest(p_rest, F.lit(0.0)), F.greatest(q_rest, F.lit(0.0)))
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def common_cells(kept: Column, n_words: Column, common: Column) -> Column:
    """For the common words a document has: their part of the divergence, and their shares here and in the reference.

    ``kept`` holds the document's common words, sorted; ``common`` the reference's shares.
    """
    n = F.size(kept)
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(kept, i) != F.get(kept, i - 1)))
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q"), n.alias("next"), F.lit(0.0).alias("p"))

    def step(a: Column, i: Column) -> Column:
        q = F.coalesce(F.element_at(common, F.get(kept, i)), F.lit(0.0))
        p = F.when(q > 0, (a["next"] - i) / n_words).otherwise(0.0)
        return F.struct((a["d"] + _part(p, q)).alias("d"), (a["q"] + q).alias("q"), i.alias("next"), (a["p"] + p).alias("p"))

    # From the last run to the first, so that each run's length is known.
    return F.when(n > 0, F.aggregate(F.reverse(begins), zero, step)).otherwise(zero)


def word_distance(cells: Column, known: Column) -> Column:
    """Distance of the shares of common words, everything else being one more cell.

    ``cells`` is made by ``common_cells``; ``known`` is the share of all common words in the reference. Words
    the document does not have add half their share.
    """
    absent = F.greatest(known - cells["q"], F.lit(0.0)) / 2
    other = _part(F.greatest(1 - cells["p"], F.lit(0.0)), F.greatest(1 - known, F.lit(0.0)))
    return F.sqrt(F.greatest(cells["d"] + absent + other, F.lit(0.0)))


def judge(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The columns of ``docs`` but ``text``, with the base columns, ``base_failed``, ``class_distance``, ``word_distance`` and ``kept``.

    Null texts are empty and fail the base rules. Distances are null where a document is too short
    to compare (under ``MIN_CHARS_COMPARED`` characters or ``MIN_WORDS_COMPARED`` words); it is then kept if it
    passes the base rules. Repeated rows get the same result. Columns of these names are replaced.
    """
    langs, shares = common_words(docs, text=text, lang=lang)
    common = sorted({w for words_ in shares.values() for w in words_})
    rows = measured(docs.drop("base_failed", "class_distance", "word_distance", "kept"), text=text)
    own = F.col(f"`{lang}`").cast("string")
    ref = F.when(own.isin(langs), own).otherwise(ALL) if langs else F.lit(ALL)
    kept_words = F.filter("__words", lambda x: x.isin(common)) if common else F.array().cast("array<string>")
    usual = docs.sparkSession.createDataFrame(
        [(r, s, float(sum(s.values()))) for r, s in shares.items()], "__ref string, __common map<string,double>, __known double"
    )
    rows = rows.select("*", ref.alias("__ref"), F.sort_array(kept_words).alias("__kept")).drop("__words")
    rows = rows.join(F.broadcast(usual), "__ref", "left")  # one row for each language
    rows = rows.withColumn("__cells", common_cells(F.col("__kept"), F.col("n_words"), F.col("__common")))
    odd = F.when(F.col("n_words") >= MIN_WORDS_COMPARED, word_distance(F.col("__cells"), F.col("__known")))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own_columns = [c for c in docs.columns if c not in (text, *base, "base_failed", "class_distance", "word_distance", "kept")]
    columns = [F.col(f"`{c}`") for c in own_columns]
    rows = stored(rows.select(*columns, *base, odd.alias("word_distance"), "__ref", "__size", "__classes"), "measures")

    cells = [F.sum(F.element_at("__classes", i + 1)).alias(f"c{i}") for i in range(N_CLASSES - 1)]
    sums = rows.groupBy(own.alias("lang")).agg(F.sum("__size").alias("size"), *cells)
    part = [F.sum(f"c{i}").alias(f"c{i}") for i in range(N_CLASSES - 1)]
    every = sums.agg(F.sum("size").alias("size"), *part).select(F.lit(ALL).alias("lang"), "size", *[f"c{i}" for i in range(N_CLASSES - 1)])
    sums = sums.where(F.col("lang").isin(langs)).unionAll(every) if langs else every
    means = F.array(*[F.coalesce(F.col(f"c{i}") / F.nullif("size", F.lit(0)), F.lit(0.0)) for i in range(N_CLASSES - 1)])
    usual = F.broadcast(sums.select(F.col("lang").alias("__ref"), means.alias("__usual")))  # one row for each language
    far = F.when(F.col("__size") >= MIN_CHARS_COMPARED, class_distance(F.col("__classes"), F.col("__size"), F.col("__usual")))
    rows = rows.join(usual, "__ref", "left").select(*columns, *base, base_failed().alias("base_failed"), far.alias("class_distance"), "word_distance")
    fine = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return rows.select("*", (~F.col("base_failed") & fine).alias("kept"))
