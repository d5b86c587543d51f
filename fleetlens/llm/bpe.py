"""Byte-level BPE: encoding and decoding of whole texts.

Texts are split as the GPT-2 pattern splits them, but without a regular expression: every code
point gets a class, classes and the few following ones give a symbol, and each symbol is a
transition function over eight states. Functions compose associatively, so the states of all
positions come from a blocked scan over arrays: compositions inside blocks, then over the
blocks, then the block's entry state is applied. Where the transition begins a token the text
is cut. Slices are looked up in a cache of merged pieces; a piece seen first is merged pair by pair.

Offsets (the byte where each token begins) are kept with the ids; decoding writes each token's
bytes at its offset.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.text import code_points, once, slices, text_buffer, widened

CACHE_PIECES = 250_000
CACHED_BYTES = 64
BLOCK = 64
ENCODED_AT_ONCE = 1 << 20  # bytes of text, or of ids

# Classes of code points.
LETTER, NUMBER, BLANK, SPACE, QUOTE, OTHER = range(6)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# Symbols: a code point with what follows it. BREAK stands between texts.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_SPACE_LAST, S_BLANK_LAST, S_BLANK, S_BREAK = range(9)
# States after a code point: a new token is due, inside a run, after a joining space, or one or two letters of a contraction are due.
DUE, LETTERS, NUMBERS, OTHERS, BLANKS, JOINING, ONE_MORE, TWO_MORE = range(8)


def _step(state: int, symbol: int) -> int:
    if symbol == S_BREAK:
        return DUE
    if symbol == S_LETTER:
        return {TWO_MORE: ONE_MORE, ONE_MORE: DUE}.get(state, LETTERS)
    if symbol in (S_QUOTE1, S_QUOTE2):
        if state in (JOINING, OTHERS):
            return OTHERS
        return ONE_MORE if symbol == S_QUOTE1 else TWO_MORE
    return {S_NUMBER: NUMBERS, S_OTHER: OTHERS, S_SPACE_LAST: JOINING, S_BLANK_LAST: DUE, S_BLANK: BLANKS}[symbol]


def _begins(state: int, symbol: int) -> bool:
    """Whether a code point with this symbol begins a token after this state."""
    if symbol == S_LETTER:
        return state not in (LETTERS, JOINING, ONE_MORE, TWO_MORE)
    if symbol == S_NUMBER:
        return state not in (NUMBERS, JOINING)
    if symbol in (S_OTHER, S_QUOTE1, S_QUOTE2):
        return state not in (OTHERS, JOINING)
    if symbol == S_BLANK:
        return state != BLANKS
    return symbol != S_BREAK


def _monoid():
    return once("bpe monoid", _generated)


def _generated() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The transition functions that the symbols generate.

    Gives the function of each symbol, the composition table (first, then second), the functions'
    values by state, and the table of token beginnings by state and symbol.
    """
    states = range(8)
    found: dict[tuple[int, ...], int] = {tuple(states): 0}
    generators = [tuple(_step(q, s) for q in states) for s in range(9)]
    queue = [tuple(states)]
    while queue:
        f = queue.pop()
        for g in generators:
            h = tuple(g[q] for q in f)
            if h not in found:
                found[h] = len(found)
                queue.append(h)
    functions = list(found)
    compose = np.array([[found[tuple(g[q] for q in f)] for g in functions] for f in functions], np.uint8)
    of_symbol = np.array([found[g] for g in generators], np.uint8)
    begins = np.array([[_begins(q, s) for s in range(9)] for q in states])
    return of_symbol, compose, np.array(functions, np.uint8), begins


def _scan(functions: np.ndarray) -> np.ndarray:
    """Compositions of all prefixes of a sequence of transition functions."""
    _, compose, _, _ = _monoid()
    if len(functions) <= BLOCK:
        out = functions.copy()
        for i in range(1, len(out)):
            out[i] = compose[out[i - 1], out[i]]
        return out
    rows = -(-len(functions) // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)  # function 0 is the identity
    grid[: len(functions)] = functions
    across = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    for i in range(1, BLOCK):
        across[i] = compose[across[i - 1], across[i]]
    carried = _scan(across[-1])
    across[:, 1:] = compose[carried[:-1], across[:, 1:]]
    return np.ascontiguousarray(across.T).ravel()[: len(functions)]


def class_ranges() -> tuple[tuple[int, int, int], ...]:
    return once("bpe classes", _library_classes)


def _library_classes() -> tuple[tuple[int, int, int], ...]:
    """(first, last, class) of the code points that are letters, numbers or blanks in the tiktoken library."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = "".join(map(chr, points))
    out = []
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        engine = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        members = np.frombuffer(bytes(engine.encode_ordinary(everything)).decode().encode("utf-32-le"), np.uint32)
        cuts = np.flatnonzero(np.diff(members.astype(np.int64), prepend=-9) != 1)
        for a, b in zip(cuts, np.append(cuts[1:], len(members))):
            out.append((int(members[a]), int(members[b - 1]), kind))
    return tuple(out)


def _class_table(ranges: tuple[tuple[int, int, int], ...]) -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for first, last, kind in ranges:
        table[first : last + 1] = kind
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    return table


def token_starts(points: np.ndarray, offsets: np.ndarray, ranges: tuple[tuple[int, int, int], ...]) -> np.ndarray:
    """Whether each code point begins a token; ``offsets`` are the bounds of the texts."""
    if not len(points):
        return np.zeros(0, bool)
    of_symbol, _, values, begins = _monoid()
    n, texts = len(points), len(offsets) - 1
    place = np.arange(n) + np.repeat(np.arange(texts), np.diff(offsets)) + 1  # one break before each text
    kind = np.full(n + texts + 3, 255, np.uint8)
    kind[place] = once("bpe class table", lambda: _class_table(ranges))[points]
    letters = np.zeros(n + texts + 3, np.uint32)
    letters[place] = points
    after, after2 = letters[1:], letters[2:]
    size = n + texts
    kind, follows = kind[:size], kind[1 : size + 1]
    blank = (kind == BLANK) | (kind == SPACE)
    ends_run = blank & (follows != BLANK) & (follows != SPACE) & (follows != 255)
    one, two = np.zeros(size, bool), np.zeros(size, bool)
    for word in CONTRACTIONS:
        fits = after[:size] == ord(word[0])
        if len(word) == 1:
            one |= fits
        else:
            two |= fits & (after2[:size] == ord(word[1]))
    symbol = np.select(
        [kind == 255, kind == LETTER, kind == NUMBER, kind == QUOTE, blank & ~ends_run, kind == SPACE, kind == BLANK],
        [S_BREAK, S_LETTER, S_NUMBER, np.where(one, S_QUOTE1, np.where(two, S_QUOTE2, S_OTHER)), S_BLANK, S_SPACE_LAST, S_BLANK_LAST],
        S_OTHER,
    ).astype(np.uint8)
    state = values[_scan(of_symbol[symbol]), DUE]
    before = np.empty_like(state)
    before[0], before[1:] = DUE, state[:-1]
    return begins[before, symbol][place]


class Vocabulary:
    """Ranks of a byte-level BPE file, the merging of pieces, and the bytes of tokens."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.tokens[rank] = piece
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.cache: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece: the pair with the lowest rank is merged first, the leftmost of equal ones."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 200:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.tokens)
        pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs:
            lowest = min(pairs)
            if lowest == none:
                break
            i = pairs.index(lowest)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """As ``merge`` with a heap of pairs, so that a very long piece takes n log n steps."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, pieces: list[bytes]) -> bytes:
        """Ids of pieces one after the other, as little-endian unsigned 32-bit numbers."""
        cache = self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        new = {p for p in set(pieces) if p not in cache}
        long = {}
        for piece in new:
            (cache if len(piece) <= CACHED_BYTES else long)[piece] = np.array(self.merge(piece), "<u4").tobytes()
        if long:
            return b"".join([long[p] if p in long else cache[p] for p in pieces])
        return b"".join(map(cache.__getitem__, pieces))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, each written at its offset."""
        if not len(ids):
            return np.zeros(0, np.uint8)
        lengths = self.lengths[ids]
        out = np.empty(int(offsets[-1] + lengths[-1]), np.uint8)
        at = np.repeat(offsets, lengths)
        source = np.repeat(self.begins[ids], lengths)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[at + inside] = self.bytes[source + inside]
        return out


def vocabulary(path: str) -> Vocabulary:
    return once(f"bpe vocabulary {path}", lambda: Vocabulary(path))


def encode_texts(texts: pa.Array, words: Vocabulary, ranges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and byte offsets of all tokens of the texts, and the bounds of the texts among them."""
    data, bounds = text_buffer(texts)
    points, begin, point_bounds = code_points(data, bounds)
    cuts = np.append(begin[np.flatnonzero(token_starts(points, point_bounds, ranges))], len(data))
    body = data.tobytes()
    where = cuts.tolist()
    ids = np.frombuffer(words.encode([body[a:b] for a, b in zip(where, where[1:])]), "<u4")
    lengths = words.lengths[ids]
    offsets = np.cumsum(lengths) - lengths
    per_text = np.searchsorted(offsets, bounds)
    return ids, offsets - np.repeat(bounds[:-1], np.diff(per_text)), per_text


def _packed(values: np.ndarray, bounds: np.ndarray, kind: str) -> pa.Array:
    size = np.dtype(kind).itemsize
    buffers = [None, pa.py_buffer((bounds * size).astype(np.int32).tobytes()), pa.py_buffer(values.astype(kind).tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers)


def encode(docs: DataFrame, path: str, *, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` and ``offsets``, both as packed little-endian 32-bit numbers.

    ``offsets`` holds the byte of the text at which each token begins. With ``decoded`` the bytes that the
    ids stand for are added in the same pass, as ``decode`` would add them. Null texts are encoded as empty
    ones: no tokens. Columns of these names in ``docs`` are replaced. ``path`` is the rank file; it has to be
    readable on the executors.
    """
    ranges = class_ranges()
    new = ("n_tokens", "ids", "offsets", "decoded")[: 4 if decoded else 3]
    rest = docs.drop(*new)
    columns = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for part in slices(batch, text, ENCODED_AT_ONCE):
                ids, offsets, bounds = encode_texts(part.column(text), words, ranges)
                made = [pa.array(np.diff(bounds)), _packed(ids, bounds, "<u4"), _packed(offsets, bounds, "<u4")]
                if decoded:
                    spans = zip(bounds[:-1].tolist(), bounds[1:].tolist())
                    made.append(pa.array([words.decode(ids[a:b], offsets[a:b]).tobytes() for a, b in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + made, [*columns, *new])

    more = "n_tokens long, ids binary, offsets binary" + ", decoded binary" * decoded
    return rest.mapInArrow(run, widened(rest, more))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that ``ids`` and ``offsets`` stand for. Null ids give null."""
    rest = encoded.drop("decoded")
    columns = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for part in slices(batch, "ids", ENCODED_AT_ONCE):
                pairs = zip(part.column("ids").to_pylist(), part.column("offsets").to_pylist())
                made = [
                    None if i is None or o is None
                    else words.decode(np.frombuffer(i, "<u4"), np.frombuffer(o, "<u4").astype(np.int64)).tobytes()
                    for i, o in pairs
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], [*columns, "decoded"])

    return rest.mapInArrow(run, widened(rest, "decoded binary"))


def unpacked(numbers: bytes) -> list[int]:
    """The numbers of a packed column."""
    return np.frombuffer(numbers, "<u4").tolist()


def digests(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: its key, ``n_tokens``, and SHA-256 of the packed ids and of the decoded bytes."""
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("text"))
    done = encode(rows, path, decoded=True)
    return done.select(
        key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
