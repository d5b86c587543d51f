"""The registered queries of this subpackage, each an operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, decontam, langid, line_dedup, packing, quality, runs, secret_scan, simhash, substring, toxicity, trie, url_filter

RANKS = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    held = F.coalesce(toxicity.remainder(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.removed(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(key,) for key in url_filter.LISTED], "key string")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.classify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("th")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return done.select("doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


def looped(docs: DataFrame) -> DataFrame:
    """``docs`` with every tenth text, by its id's checksum, ending in a loop; its words are joined by one space."""
    h = F.crc32(F.col("doc_id").cast("string"))
    whole = lambda a, b: F.call_function("div", a, b).cast("int")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = (
        docs.withColumn("__g", whole(h, F.lit(10))).withColumn("__words", F.when(h % 10 == 0, words))
        .withColumn("__n", F.nullif(F.size("__words"), F.lit(0)))
        .withColumn("__a", F.col("__g") % F.col("__n"))
        .withColumn("__p", 1 + whole(F.col("__n") - F.col("__a"), 3 + F.col("__g") % 8))
    )
    block = F.slice("__words", F.col("__a") + 1, F.col("__p"))
    times = F.ceil((F.col("__n") - F.col("__a")) / F.col("__p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), F.col("__n") - F.col("__a"))
    text = F.array_join(F.concat(F.slice("__words", F.lit(1), F.col("__a")), tail), " ")
    return cut.select(*[F.when(F.col("__n") > 0, text).otherwise(F.col(c)).alias(c) if c == "text" else c for c in docs.columns])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(looped(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    # Quotients of equal fractions are equal doubles, and others of such lengths differ.
    order = F.transform("runs", lambda r: F.struct(
        (r.length / r.period).alias("exponent"), (-r.start).alias("start"), (-r.period).alias("period"), r.length.alias("length")
    ))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    best = F.col("best")
    return found.withColumn("best", F.array_max(order)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best.start).alias("start"), best.length.alias("length"),
        (-best.period).alias("period"), F.call_function("div", 1000 * best.length, -best.period).alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


HEADS = 9  # a rebuilt conversation takes 0 to 8 turns of its base
LENDERS = 5  # every fifth conversation lends its head


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(
        _table(spark, sf_dir, "conversations"), base=lambda c: c - c % LENDERS, head=lambda c: F.crc32(c.cast("string")) % HEADS, longest=HEADS - 1
    )


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return packing.pack(cut)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_bpe, op3_substring, op4_url_filter, op5_simhash,
        op6_quality, op7_langid, op8_decontamination, op9_secrets, op10_line_dedup, op11_periodic_runs,
        op12_conversation_trie, op13_best_fit_packing,
    )
}

WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _substring_sql(window: int = substring.WINDOW) -> str:
    return f"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - {window} + 2)) AS i FROM w),
k AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + {window - 1}], ' ')) AS h FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS i FROM r WHERE n > 1),
c AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
j AS (
  SELECT w.doc_id, len(words) AS n, list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)) AS left_, words
  FROM w LEFT JOIN c USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_words, (n - len(left_))::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_transform(left_, lambda i: words[i]), ' '), '')) AS kept_sha256
FROM j
"""


def _url_sql() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    name = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rules))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules))
    listed = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in url_filter.LISTED)
    return f"""
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM b
)
SELECT page_id, host, path, CASE {name} END AS rule, CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM c
"""


def _quality_sql() -> str:
    counts = ", ".join(f"length(t) - length(regexp_replace(t, '{c}', '', 'g')) AS c{i}" for i, c in enumerate(quality.CLASSES))
    last = quality.N_CLASSES - 1
    names = [f"c{i}" for i in range(last + 1)]
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    counts += f", length(t) - length(translate(t, {blanks}, '')) AS c{last - 1}"
    part = lambda p, q: (
        f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END / 2 + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END / 2)"
    )
    far = " + ".join(part(f"(f.{n} / length(t))", f"(u.{n} / u.size)") for n in names)
    sums = ", ".join(f"sum({n}) AS {n}" for n in names)
    size = " + ".join(f"sum({n})" for n in names)
    w = quality.WINDOW
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS_SQL} AS words FROM documents),
f0 AS (SELECT *, len(words) AS n, {counts} FROM d),
f AS (SELECT *, length(t) - {' - '.join(names[:-1])} AS c{last} FROM f0),
top AS (SELECT lang FROM f WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {quality.MIN_LANG_DOCS}),
u AS (
  SELECT lang AS ref, sum(n) AS n, {size} AS size, {sums} FROM f WHERE lang IN (SELECT lang FROM top) GROUP BY lang
  UNION ALL SELECT '{quality.ALL}', sum(n), {size}, {sums} FROM f
),
e AS (SELECT lang, unnest(words) AS word FROM d),
k AS (
  SELECT lang AS ref, word, count(*) AS times FROM e WHERE lang IN (SELECT lang FROM top) GROUP BY lang, word
  UNION ALL SELECT '{quality.ALL}', word, count(*) FROM e GROUP BY word
),
q AS (SELECT k.ref, word, times / u.n AS q FROM k JOIN u ON k.ref = u.ref WHERE times >= u.n / {quality.COMMON}),
known AS (SELECT u.ref, coalesce(sum(q.q), 0) AS known FROM u LEFT JOIN q ON u.ref = q.ref GROUP BY u.ref),
m AS (SELECT *, CASE WHEN lang IN (SELECT lang FROM top) THEN lang ELSE '{quality.ALL}' END AS ref FROM f),
own AS (SELECT doc_id, ref, n, unnest(words) AS word FROM m),
p AS (SELECT own.doc_id, own.word, count(*) / any_value(own.n) AS p, any_value(q.q) AS q FROM own JOIN q ON own.ref = q.ref AND own.word = q.word GROUP BY own.doc_id, own.word),
s AS (SELECT doc_id, sum({part('p', 'q')}) AS dist, sum(p) AS p, sum(q) AS q FROM p GROUP BY doc_id),
z AS (
  SELECT m.doc_id, coalesce(dist, 0) AS dist, greatest(1 - coalesce(s.p, 0), 0) AS rest_p, greatest(1 - known, 0) AS rest_q, greatest(known - coalesce(s.q, 0), 0) AS absent
  FROM m JOIN known ON m.ref = known.ref LEFT JOIN s ON m.doc_id = s.doc_id
),
v AS (SELECT doc_id, sqrt(greatest(dist + absent / 2 + {part('rest_p', 'rest_q')}, 0)) AS odd FROM z),
x AS (SELECT doc_id, unnest(range(1, n - {w - 2})) AS i, words FROM m),
y AS (SELECT doc_id, i, array_to_string(words[i:i + {w - 1}], ' ') AS win FROM x),
y2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS times FROM y),
y3 AS (SELECT doc_id, count(DISTINCT j) AS repeated FROM (SELECT doc_id, unnest(range(i, i + {w})) AS j FROM y2 WHERE times > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE translate(line, {blanks}, '') <> '' GROUP BY doc_id),
b AS (
  SELECT m.doc_id, m.n::BIGINT AS n_words, length(translate(t, {blanks}, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(repeated, 0)::BIGINT AS n_repeat_words,
    m.n < {quality.MIN_WORDS} OR 100 * coalesce(repeated, 0) > {quality.REPEATED_PERCENT} * m.n AS base_failed,
    (length(t) < {quality.MIN_CHARS_COMPARED} OR sqrt(greatest({far.replace('f.', 'm.')}, 0)) <= {quality.MAX_CLASS_DISTANCE})
      AND (m.n < {quality.MIN_WORDS_COMPARED} OR odd <= {quality.MAX_WORD_DISTANCE}) AS fine
  FROM m JOIN u ON m.ref = u.ref JOIN v ON m.doc_id = v.doc_id LEFT JOIN y3 ON m.doc_id = y3.doc_id LEFT JOIN l ON m.doc_id = l.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM b
"""


def _crc32_sql(number: str) -> str:
    """CRC-32 of the decimal digits of a number, bit by bit."""
    bit = "lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(list_concat([xor(c, b)], [0::BIGINT for i in range(8)]), {bit})"
    digits = f"[ascii(d)::BIGINT for d in string_split(({number})::VARCHAR, '')]"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {digits}), lambda c, b: {byte}), 4294967295)"


def _runs_sql(length: int = runs.MIN_LENGTH, exponent: int = runs.MIN_EXPONENT) -> str:
    return f"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS words, {_crc32_sql("doc_id")} AS h FROM documents),
g AS (SELECT doc_id, words, len(words) AS n, h % 10 = 0 AS looped, h // 10 AS g FROM w),
a AS (SELECT *, CASE WHEN looped AND n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN words ELSE [words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] for i in range(n)] END AS words FROM p),
e AS (SELECT doc_id, unnest(words) AS word, unnest(range(n)) AS i FROM d),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
t AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({length}, {exponent} * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM t GROUP BY doc_id, start, length),
k AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first([start, length, period] ORDER BY length / period DESC, start, period) AS best
  FROM r GROUP BY doc_id
),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM e ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[1]::BIGINT AS start, best[2]::BIGINT AS length, best[3]::BIGINT AS period,
  (1000 * best[2] // best[3])::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.words, '')) AS collapsed_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _trie_sql(lenders: int = LENDERS, heads: int = HEADS) -> str:
    return f"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS ref,
    octet_length(encode(coalesce(text, ''))) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL
),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
v AS (SELECT c, c - c % {lenders} AS b, {_crc32_sql("c")} % {heads} AS h FROM n),
k AS (SELECT v.*, least(h, coalesce(n.n, 0)) AS k FROM v LEFT JOIN n ON n.c = v.b),
r AS (
  SELECT k.c, t.i AS d, ref, bytes FROM k JOIN t ON t.c = k.b AND t.i <= k.h
  UNION ALL SELECT k.c, k.k + t.i - k.h, ref, bytes FROM k JOIN t ON t.c = k.c AND t.i > k.h
),
p AS (
  SELECT c, 0::BIGINT AS d, '' AS node, NULL::VARCHAR AS above, 0::BIGINT AS bytes FROM k
  UNION ALL SELECT p.c, p.d + 1, sha256(p.node || r.ref), p.node, r.bytes FROM p JOIN r ON r.c = p.c AND r.d = p.d + 1
),
whole AS (SELECT c, max(d) AS d FROM p GROUP BY c),
a AS (
  SELECT p.d, node, min(p.c) AS conv_id, count(*) AS n_convs, any_value(above) AS above, any_value(bytes) AS bytes,
    string_agg(CASE WHEN p.d = whole.d THEN p.c END, ',' ORDER BY p.c) AS ends
  FROM p JOIN whole ON p.c = whole.c GROUP BY p.d, node
),
kids AS (SELECT d - 1 AS d, above AS node, count(*) AS n FROM a WHERE d > 0 GROUP BY 1, 2),
b AS (SELECT a.*, coalesce(kids.n, 0) AS n_children FROM a LEFT JOIN kids ON kids.d = a.d AND kids.node = a.node),
below AS (
  SELECT p.d, p.node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved
  FROM b JOIN p ON p.c = b.conv_id AND p.d <= b.d GROUP BY p.d, p.node
)
SELECT b.conv_id, b.d AS depth, up.conv_id AS parent_conv_id, b.n_convs, b.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(b.ends, '')) AS ends_sha256
FROM b JOIN below ON below.d = b.d AND below.node = b.node LEFT JOIN a up ON up.d = b.d - 1 AND up.node = b.above
"""


ORACLES: dict[str, str] = {
    "op3_substring": _substring_sql(),
    "op4_url_filter": _url_sql(),
    "op6_quality": _quality_sql(),
    "op11_periodic_runs": _runs_sql(),
    "op12_conversation_trie": _trie_sql(),
}
