"""The prefix trie of rebuilt conversations, from fingerprints that compose.

A rebuilt conversation is the head of another one (its base) followed by its own turns after the
head. The texts are read once, for the reference of each turn: the SHA-256 of role and text. A sequence of turns
is an element ``(length, sum of turn * B**place)`` of a monoid, in four lanes modulo a prime each; elements multiply as
``(m, F) (n, G) = (m + n, F + B**m G)``, and a power of B has an inverse. Prefixes of the stored
conversations are running products. The prefix of a rebuilt conversation beyond its head is then

    head of the base  x  inverse of own head  x  own prefix

in symbols, a handful of integers for each turn; no rebuilt text or list of turns is ever made.

Prefixes with one depth and fingerprint are a node. A node whose members all have one parent
fingerprint and one reference of the last turn holds, by induction along its depth, equal sequences only; where
this fails for any node, all is done again with other bases. Sums over subtrees go up the trie in jumps of
1, 2, 4, ... turns over the nodes with two members at least; below a node with one there is one leaf.

No conversation has to fit in a task: turns are sorted over all tasks, running products are
made within a task, and one row for each conversation that ends in another task carries on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.storage import stored
from fleetlens.llm.text import small_batches

PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
LANES = 4
HALF = np.uint64(31)
ENDS_PIECE = 65536  # characters of a stretch of ids that is hashed in one step
MAX_TRIES = 8


class Products:
    """The monoid of turn sequences, for arrays of elements with one column a lane."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.base = np.array([int(rng.integers(1 << 20, int(p) - 1)) for p in PRIMES], np.uint64)
        self.inverse = np.array([pow(int(b), -1, int(p)) for b, p in zip(self.base, PRIMES)], np.uint64)

    def power(self, exponent: np.ndarray) -> np.ndarray:
        """B to any whole exponents, negative ones too."""
        out = np.ones((len(exponent), LANES), np.uint64)
        left = np.abs(exponent)
        square = np.where((exponent < 0)[:, None], self.inverse, self.base)
        while left.any():
            odd = (left & 1).astype(bool)
            out[odd] = out[odd] * square[odd] % PRIMES
            square = square * square % PRIMES
            left >>= 1
        return out

    def then(self, length: np.ndarray, value: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Value of the element ``(length, value)`` followed by one of value ``other``."""
        return (value + self.power(length) * other) % PRIMES

    def without(self, length: np.ndarray, value: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """What follows the element ``(length, value)`` in one of value ``whole``: its inverse, then ``whole``."""
        return self.power(-length) * ((whole + PRIMES - value) % PRIMES) % PRIMES


def pack(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four lanes as two longs."""
    return tuple((lanes[:, i] << HALF | lanes[:, i + 1]).astype(np.int64) for i in (0, 2))


def unpack(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    low = np.uint64((1 << 31) - 1)
    parts = [half for x in (first, second) for half in (x.astype(np.uint64) >> HALF, x.astype(np.uint64) & low)]
    return np.stack(parts, axis=1)


def turn_value(refs: np.ndarray) -> np.ndarray:
    """Lanes of single turns, from the four longs of their references."""
    return refs.view(np.uint64) % PRIMES


REFS = ["r0", "r1", "r2", "r3"]


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _lanes(batch: pa.RecordBatch, first: str, second: str) -> np.ndarray:
    return unpack(*_numbers(batch, first, second))


def _references(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack(_numbers(batch, *REFS), axis=1)


def _turns(conversations: DataFrame) -> DataFrame:
    """One row a turn: conversation, order, reference and bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn"), F.unhex(F.sha2(F.encode(content, "UTF-8"), 256)).alias("ref"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def _products_in_tasks(turns: DataFrame, seed: int) -> DataFrame:
    """Turns sorted over all tasks, each with its task, and place and running product within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = Products(seed)
        conv, length, value = None, 0, np.zeros((1, LANES), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            convs, part, size = _numbers(batch, "conv", "part", "bytes")
            refs = np.frombuffer(b"".join(batch.column("ref").to_pylist()), ">u8").reshape(-1, 4).astype(np.uint64).view(np.int64)
            first = np.flatnonzero(np.diff(convs, prepend=convs[0] - 1))
            segment = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(convs))))
            goes_on = conv is not None and convs[0] == conv
            have = np.zeros(len(first), np.int64)
            have[0] = length if goes_on else 0
            place = np.arange(len(convs)) - first[segment] + 1 + have[segment]
            sums = np.cumsum(turn_value(refs) * products.power(place) % PRIMES, axis=0, dtype=np.uint64)
            before = np.where((first > 0)[:, None], sums[np.maximum(first, 1) - 1], 0).astype(np.uint64)
            lanes = sums - before[segment]
            if goes_on:
                lanes[segment == 0] += value
            lanes %= PRIMES
            conv, length, value = convs[-1], int(place[-1]), lanes[-1:]
            made = [convs, part, place, *pack(lanes), *refs.T, size]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(m), pa.int64()) for m in made], ["conv", "part", "place", "g1", "g2", *REFS, "bytes"])

    spread = turns.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "ref")
    ordered = spread.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "ref")
    rows = ordered.select("conv", F.spark_partition_id().cast("long").alias("part"), "ref", "bytes")
    longs = ["conv", "part", "place", "g1", "g2", *REFS, "bytes"]
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in longs))


def _carried(rows: DataFrame, seed: int) -> DataFrame:
    """The product of all earlier tasks, for each conversation and task after its first.

    A task is between the ends of at most two conversations, so there are no more rows than tasks.
    """
    ends = rows.groupBy("conv", "part").agg(F.max("place").alias("n"), F.max_by(F.struct("g1", "g2"), "place").alias("g"))
    over = ends.withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy("conv"))).where("parts > 1")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = Products(seed)
        table = pa.Table.from_batches(batches).sort_by("part")
        conv, part, n, g1, g2 = (table.column(c).to_numpy() for c in ("conv", "part", "n", "g1", "g2"))
        length, value, out = 0, np.zeros((1, LANES), np.uint64), []
        for i, own in enumerate(unpack(g1, g2)):
            if i:
                out.append((int(conv[i]), int(part[i]), length, *(int(x[0]) for x in pack(value))))
            value = products.then(np.array([length]), value, own[None])
            length += int(n[i])
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["conv", "part", "n0", "b1", "b2"])

    flat = over.select("conv", "part", "n", "g.g1", "g.g2")
    return flat.groupBy("conv").applyInArrow(scan, "conv long, part long, n0 long, b1 long, b2 long")


def prefixes(turns: DataFrame, seed: int) -> DataFrame:
    """Every turn with its place in its conversation, from 1, and the product of the turns up to it."""
    local = stored(_products_in_tasks(turns, seed), "trie-local")
    joined = local.join(F.broadcast(_carried(local, seed)), ["conv", "part"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = Products(seed)
        for batch in batches:
            conv, place, n0, size = _numbers(batch, "conv", "place", "n0", "bytes")
            whole = products.then(n0, _lanes(batch, "b1", "b2"), _lanes(batch, "g1", "g2"))
            made = [conv, place + n0, *pack(whole), *_references(batch).T, size]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(m), pa.int64()) for m in made], ["conv", "place", "g1", "g2", *REFS, "bytes"])

    filled = joined.select("conv", "place", "g1", "g2", *REFS, "bytes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n0", "b1", "b2")])
    return filled.mapInArrow(run, ", ".join(f"{c} long" for c in ["conv", "place", "g1", "g2", *REFS, "bytes"]))


def _members(turns: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], longest: int, seed: int) -> DataFrame:
    """Every prefix of every rebuilt conversation: depth, its fingerprint and its parent's, the last turn, and whether it is the whole."""
    rows = stored(prefixes(turns, seed), "trie-prefixes")
    early = F.when(F.col("place") <= longest, F.struct("place", "g1", "g2", *REFS, "bytes"))
    per_conv = rows.groupBy("conv").agg(F.max("place").alias("n"), F.array_sort(F.collect_list(early)).alias("turns"))
    own = per_conv.select("conv", "n", "turns", base(F.col("conv")).cast("long").alias("base"), head(F.col("conv")).cast("int").alias("h"))
    lent = per_conv.select(F.col("conv").alias("base"), F.col("turns").alias("lent"))
    plan = own.join(lent, "base", "left").withColumn("lent", F.slice(F.coalesce("lent", F.array().cast(own.schema["turns"].dataType)), F.lit(1), F.col("h")))
    plan = plan.withColumn("k", F.size("lent")).withColumn("whole", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    zero = F.lit(0).cast("long")
    at = lambda array, i, name: F.coalesce(F.try_element_at(F.col(array), F.nullif(i, F.lit(0)))[name], zero)
    plan = plan.select(
        "conv", "h", "k", "whole", "lent",
        *[at("lent", F.col("k"), g).alias(f"k{g}") for g in ("g1", "g2")], *[at("turns", F.col("h"), g).alias(f"h{g}") for g in ("g1", "g2")],
    )
    plan = stored(plan, "trie-plan")
    symbols = ["conv", "depth", "g1", "g2", *REFS, "bytes", "h", "k", "kg1", "kg2", "hg1", "hg2", "whole"]
    roots = plan.select("conv", *[zero.alias(c) for c in ("depth", "g1", "g2", *REFS, "bytes", "h", "k", "kg1", "kg2", "hg1", "hg2")], "whole")
    heads = plan.select("conv", "whole", F.explode("lent").alias("t")).select(
        "conv", F.col("t.place").alias("depth"), "t.g1", "t.g2", *[f"t.{r}" for r in REFS], "t.bytes", *[zero.alias(c) for c in ("h", "k", "kg1", "kg2", "hg1", "hg2")], "whole"
    )
    tails = rows.where(F.col("place") > head(F.col("conv"))).join(plan.drop("lent"), "conv").select(
        "conv", (F.col("k") + F.col("place") - F.col("h")).cast("long").alias("depth"), "g1", "g2", *REFS, "bytes",
        *[F.col(c).cast("long").alias(c) for c in ("h", "k")], "kg1", "kg2", "hg1", "hg2", "whole",
    )
    every = tails.unionAll(heads.select(*symbols)).unionAll(roots.select(*symbols)).withColumn("whole", F.col("whole").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = Products(seed)
        for batch in batches:
            conv, depth, h, k, whole, size = _numbers(batch, "conv", "depth", "h", "k", "whole", "bytes")
            refs = _references(batch)
            after = products.without(h, _lanes(batch, "hg1", "hg2"), _lanes(batch, "g1", "g2"))
            value = products.then(k, _lanes(batch, "kg1", "kg2"), after)
            last = turn_value(refs) * products.power(depth) % PRIMES
            parent = np.where((depth > 0)[:, None], (value + PRIMES - last) % PRIMES, np.uint64(0))
            made = [conv, depth, *pack(value), *pack(parent), *refs.T, size, (depth == whole).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(m), pa.int64()) for m in made], ["conv", *KEY, "p1", "p2", *REFS, "bytes", "ends"])

    return every.mapInArrow(run, ", ".join(f"{c} long" for c in ["conv", *KEY, "p1", "p2", *REFS, "bytes", "ends"]))


KEY = ["depth", "f1", "f2"]


def _nodes(members: DataFrame) -> DataFrame:
    same = ["p1", "p2", *REFS]
    differs = F.lit(False)
    for c in same:
        differs = differs | (F.min(c) != F.max(c))
    return members.groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.min("bytes").alias("bytes"), differs.alias("differs"),
    )


def _ends(members: DataFrame) -> DataFrame:
    """Per node at which conversations end: SHA-256 of their ids, ascending, joined by commas.

    Ids are sorted over all tasks and joined to stretches, so that a node where very many conversations end costs
    the last task few rows; that one hashes stretch after stretch.
    """

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            depth, f1, f2, conv = _numbers(batch, *KEY, "conv")
            new = np.ones(len(conv), bool)
            new[1:] = (np.diff(depth) != 0) | (np.diff(f1) != 0) | (np.diff(f2) != 0)
            texts = [str(c) for c in conv.tolist()]
            width = np.cumsum([len(t) + 1 for t in texts])
            first = np.flatnonzero(new | (np.diff(width // ENDS_PIECE, prepend=-1) != 0))
            bounds = np.append(first, len(conv)).tolist()
            joined = [",".join(texts[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(x[first], pa.int64()) for x in (depth, f1, f2, conv)], pa.array(joined, pa.string())], [*KEY, "conv", "ids"]
            )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []

        def rows() -> pa.RecordBatch:
            columns = [pa.array([n[i] for n, _ in done], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([s for _, s in done], pa.string())], [*KEY, "ends_sha256"])

        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in KEY]))
            for key, ids in zip(keys, batch.column("ids")):
                if key != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_buffer())
            if done:
                yield rows()
                done = []
        if node is not None:
            done.append((node, state.hexdigest()))
            yield rows()

    order = [*KEY, "conv"]
    ids = members.where("ends = 1").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ids.mapInArrow(stretches, "depth long, f1 long, f2 long, conv long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*order).mapInArrow(hashed, "depth long, f1 long, f2 long, ends_sha256 string")


def _subtree_sums(shared: DataFrame) -> DataFrame:
    """``leaves`` and ``saved`` summed over the subtree of each node; ``(p1, p2)`` is the parent.

    After round k a node has the sums of its subtree down to 2**(k+1) - 1 turns below, and the fingerprint of the
    ancestor 2**(k+1) turns above. Only this bounded number of rounds, one more than the binary digits of the depth, is run.
    """
    sums = stored(shared.withColumnsRenamed({"p1": "j1", "p2": "j2"}), "trie-sums")
    deepest = sums.agg(F.max("depth")).first()[0] or 0
    jump = 1
    while jump <= deepest:
        above = F.col("depth") - jump
        up = sums.where(F.col("depth") >= jump).groupBy(above.alias("depth"), F.col("j1").alias("f1"), F.col("j2").alias("f2"))
        more = up.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        grown = sums.join(more, KEY, "left").select(
            *KEY, "j1", "j2", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        )
        # The ancestor's ancestor: the root is known, others are looked up.
        far = grown.where(F.col("depth") > 2 * jump).withColumn("above", above)
        ancestors = sums.where(F.col("depth") > jump).select(
            F.col("depth").alias("above"), F.col("f1").alias("j1"), F.col("f2").alias("j2"), F.col("j1").alias("a1"), F.col("j2").alias("a2")
        )
        moved = far.join(ancestors, ["above", "j1", "j2"]).select(*KEY, F.col("a1").alias("j1"), F.col("a2").alias("j2"), "leaves", "saved")
        near = grown.where(F.col("depth") <= 2 * jump).withColumns({"j1": F.lit(0).cast("long"), "j2": F.lit(0).cast("long")})
        sums = stored(moved.unionByName(near), "trie-sums")
        jump *= 2
    return sums.select(*KEY, "leaves", "saved")


def prefix_trie(
    conversations: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], longest: int
) -> DataFrame:
    """The nodes of the prefix trie of rebuilt conversations.

    ``conversations`` has ``conv_id``, ``turn``, ``role`` and ``text``, one row a turn; other columns are left
    out. Turns are ordered by ``turn``, null first, equal ones by their content; a null role or text is empty, and a repeated
    row is another turn. Rows without a ``conv_id`` belong to no conversation and are left out. ``base`` and
    ``head`` give, for the column of ids, the conversation that lends its first turns and
    their number, from 0 to ``longest``. Conversation c becomes the first ``head`` turns of its base (all, if
    the base has fewer; none, if it is absent), then its own turns after the first ``head``.

    One row for each distinct sequence of first turns, the empty one (the root) included: ``conv_id``, the smallest member;
    ``depth``; ``parent_conv_id``; ``n_convs``; ``n_children``; ``n_leaves``, childless nodes in the subtree with the node
    itself; ``saved_tokens``, summed over that subtree: members but one, times the bytes of the last turn's text;
    ``ends_sha256``, of the ids of members that end here. No conversations have no nodes, not even a root.
    """
    small_batches(conversations.sparkSession)
    turns = _turns(conversations)
    for seed in range(MAX_TRIES):
        members = stored(_members(turns, base, head, longest, seed), "trie-members")
        nodes = stored(_nodes(members), "trie-nodes")
        if nodes.where("differs").isEmpty():
            break
    else:
        raise RuntimeError(f"different sequences had equal fingerprints for {MAX_TRIES} choices of bases")
    above = (F.col("depth") - 1).alias("depth")
    children = nodes.where("depth > 0").groupBy(above, F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single")
    )
    known = stored(nodes.drop("differs").join(children, KEY, "left").join(_ends(members), KEY, "left").fillna(0, ["n_children", "single"]), "trie-known")
    shared = known.where("n_convs > 1").select(
        *KEY, "p1", "p2", (F.col("single") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    parents = known.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id")
    )
    root = known.where("depth = 0").first()
    summed = known.join(_subtree_sums(shared), KEY, "left")
    top = summed.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    first = summed.where("depth = 1").withColumn("parent_conv_id", F.lit(root and root.conv_id).cast("long"))
    deeper = summed.where("depth > 1").join(parents.where("depth > 1"), ["depth", "p1", "p2"], "left")
    found = top.unionByName(first).unionByName(deeper)
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
