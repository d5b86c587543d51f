"""Operators against brute-force versions, libraries or planted cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN, path

from fleetlens.llm import bpe, decontam, langid, line_dedup, queries, secret_scan, simhash, substring, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list(" '\n\tstremvld1²a!　é漢😀")), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_bpe_is_the_library(library, some):
    words = bpe.Vocabulary.__new__(bpe.Vocabulary)
    words.__dict__.update(bpe.vocabulary(RANKS).__dict__)
    ids, offsets, bounds = bpe.encode_texts(pa.array(some, pa.string()), words, bpe.class_ranges())
    for i, text in enumerate(some):
        own = ids[bounds[i] : bounds[i + 1]]
        assert own.tolist() == library.encode_ordinary(text)
        assert words.decode(own, offsets[bounds[i] : bounds[i + 1]]).tobytes() == text.encode()


def test_bpe_query(spark, texts, library):
    for row in queries.op2_bpe(spark, SF).collect():
        ids = np.array(library.encode_ordinary(texts[row.doc_id]), "<u4").tobytes()
        assert (row.n_tokens, row.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_bpe_decodes_in_a_pass_of_its_own(spark):
    docs = spark.createDataFrame([(1, "Hello wörld" * 50), (2, None), (3, "")], "doc_id long, text string")
    found = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert [bytes(r.decoded).decode() for r in found] == [r.text or "" for r in found]


def simhash_of(text):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query(spark, texts):
    prints = {i: simhash_of(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, SF).collect()}
    assert found == {i: (f"{prints[i]:016x}", find(i)) for i in texts}


def test_simhash_links_in_dense_groups(spark):
    dice = random.Random(2)
    centre = dice.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in dice.sample(range(64), dice.randrange(5))) for _ in range(400)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert found == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2}


def test_substring_with_hot_anchors_is_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = {r.doc_id: tuple(r) for r in substring.removed(docs).collect()}
    assert plain == {r.doc_id: tuple(r) for r in substring.removed(docs, hot_segments=2).collect()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abé", max_size=12), st.text("abé", max_size=12)), min_size=1, max_size=8), st.integers(1, 4))
def test_banded_distance(pairs, edits):
    found = line_dedup.within([a for a, _ in pairs], [b for _, b in pairs], edits)
    assert found.tolist() == [min(distance(a, b), edits + 1) for a, b in pairs]


@pytest.mark.parametrize("edits, least", [(1, 8), (2, 8), (3, 10)])
def test_line_dedup(spark, edits, least):
    dice = random.Random(edits)
    base = ["".join(dice.choice("abcdef ") for _ in range(dice.randrange(8, 30))) for _ in range(30)]
    rows = []
    for doc in range(90):
        lines = []
        for _ in range(dice.randrange(0, 7)):
            line = list(dice.choice(base))
            for _ in range(dice.choice([0, 0, 1, 2, 3, 4])):
                at = dice.randrange(len(line) + 1)
                line[at : at + dice.choice([0, 1, 1])] = dice.choice(["", "é", "b"])
            lines.append("".join(line))
        rows.append((doc, "\n".join(lines)))
    first, gone = {}, {}
    for doc, text in rows:
        for line in text.split("\n"):
            if len(line) >= least:
                first.setdefault(line, len(first))
    order = list(first)
    late = {x for i, x in enumerate(order) if any(abs(len(x) - len(y)) <= edits and distance(x, y) <= edits for y in order[:i])}
    seen, expected = set(), {}
    for doc, text in rows:
        kept = []
        for line in text.split("\n"):
            if len(line) < least or (line not in late and line not in seen):
                kept.append(line)
            seen.add(line)
        expected[doc] = "\n".join(kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.text for r in line_dedup.deduplicated(docs, max_edits=edits, min_chars=least).collect()}
    assert found == expected


def test_decontamination_recall_against_brute_force(spark):
    dice = random.Random(3)
    words = ["".join(dice.choice("aeioulnrst") for _ in range(dice.randrange(2, 9))) for _ in range(800)]
    items = [(i, " ".join(dice.choices(words, k=dice.randrange(10, 50)))) for i in range(40)]
    rows, expected = [], set()
    for doc in range(400):
        i, text = dice.choice(items)
        body = text.split()
        for _ in range(dice.randrange(0, len(body) // 5 + 3)):
            at = dice.randrange(len(body))
            body[at : at + 1] = dice.choice([[], [dice.choice(words)], [body[at], dice.choice(words)]])
            body = body or ["x"]
        full = dice.choices(words, k=dice.randrange(60)) + body + dice.choices(words, k=dice.randrange(60))
        rows.append((doc, " ".join(full)))
        for j, other in items:
            if decontam.edit_match(other.split(), full)[0] <= decontam.allowed_edits(len(other.split())):
                expected.add((doc, j))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found <= expected and len(found) >= 0.9 * len(expected)


def test_decontamination_finds_every_verbatim_item(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    planted = {(d, i) for d, t in texts.items() for i, item in items.items() if item in t and len(item.split()) >= 8}
    assert planted <= {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, SF).collect()}


def test_secrets_base(spark, texts):
    for row in queries.op9_secrets(spark, SF).collect():
        text, spans = texts[row.doc_id], []
        for kind, (name, pattern, flags, group, least) in enumerate((
            ("assign", secret_scan.ASSIGN, re.I | re.A, 2, 8), ("access", secret_scan.ACCESS, 0, 0, 16), ("hex", secret_scan.HEX, 0, 0, 32),
        )):
            spans += [(m.start(), kind, m.end(), name) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
        base = ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(spans))
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert set(filter(None, base.split(","))) <= set(row.spans.split(","))


def test_grammar_inference_tells_formats_apart(spark):
    dice = random.Random(1)
    hexes = ["".join(dice.choice("0123456789abcdef") for _ in range(40)) for _ in range(120)]
    plain = ["".join(dice.choice("etaoinshrdlu") for _ in range(18)) for _ in range(300)]
    body = [f"token = {h} and {w}1" for h, w in zip(hexes, plain)] + [f"see {w} {w[::-1]}9z" for w in plain]
    docs = spark.createDataFrame(list(enumerate(body)), "doc_id long, text string")
    formats = secret_scan.fit(docs)
    new = ["".join(dice.choice("0123456789abcdef") for _ in range(31)) for _ in range(50)]  # too short for the fixed pattern
    found = [secret_scan.written(secret_scan.spans(f"x {n} y", formats)[1]) for n in new]
    assert set(found) <= {"", "format:2:33"} and found.count("format:2:33") >= 35
    assert formats.score("thesearewordslikeothers1") < formats.threshold
    automaton = secret_scan.infer(["ab", "abab", "ababab"] * 30)
    assert automaton.log2("abababab") > automaton.log2("aabb")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = [r for r in queries.op7_langid(spark, sf).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == langid.HELD_OUT for r in found)
    assert np.mean([langs[r.doc_id] == r.lang_pred for r in found]) > 0.95
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in queries.op1_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in toxic]
    bad = np.array([r.score for r in rows if toxic[r.doc_id]])
    good = np.array([r.score for r in rows if not toxic[r.doc_id]])
    assert (bad[:, None] > good[None, :]).mean() > 0.97 and (good >= 0.5).mean() < 0.02
    assert all((r.predicted == 1) == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_ignores_everything_but_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    one = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    other = docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source")
    assert one == {r.doc_id: r.score for r in toxicity.score(other, model).collect()}
