"""Byte-level BPE encoding and decoding.

The pair ranks of a piece are the leaves of a segment tree over its byte positions. Each
node holds the least (rank, position) below it, so the root is the leftmost minimum. A
merge changes three leaves (the merged part, its live left neighbour, the part that went)
and updates their ancestors: O(log n) per merge, also for a piece of a million bytes.
Short pieces are merged in lockstep, many trees in one array; long ones one at a time.

Null and empty texts have no tokens. Repeated rows are encoded one by one. A null id is
carried through.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A vocabulary file larger than this is refused, as it is sent to every executor.
MAX_VOCAB_BYTES = 64 << 20
#: Pieces kept encoded in a task; the store is emptied when it holds more.
CACHE_PIECES = 150_000
#: Pieces of more bytes than this are merged one at a time.
LOCKSTEP_BYTES = 256
_NONE = np.int64(1) << 60


def _ranges(points: list[int]) -> str:
    """A character class body for sorted code points."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}-\\U{points[j]:08x}")
        i = j + 1
    return "".join(out)


_splitters: dict[str, tuple[re.Pattern, re.Pattern, np.ndarray]] = {}


def splitter(pattern: str) -> tuple[re.Pattern, re.Pattern, np.ndarray]:
    r"""The pattern for ``re``: exact, short, and the code points that
    make the short one wrong.

    ``re`` has no ``\p{L}`` or ``\p{N}``, its ``\w`` and ``\d`` differ from them by the
    letter-like and other numbers, and its ``\s`` takes four control characters more. The
    exact form spells these out by category; it is needed only for texts that hold them.
    """
    if pattern not in _splitters:
        numbers, odds, missed = [], [], []
        for c in range(128, sys.maxunicode + 1):
            kind, alnum = unicodedata.category(chr(c)), chr(c).isalnum()
            if kind in ("Nl", "No"):
                numbers.append(c)
            if alnum and kind[0] not in "LN":
                odds.append(c)
            if not alnum and kind[0] in "LN":
                missed.append(c)
        if any(unicodedata.category(chr(c))[0] == "L" for c in missed):
            raise ValueError("this Python's letters don't follow the Unicode categories")
        number, odd = _ranges(numbers), _ranges(odds)
        space = r"\t-\r \x85\xa0" + _ranges([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])

        def spelled(letter: str, digit: str, other: str, white: str, solid: str) -> re.Pattern:
            out = pattern.replace(r"[^\s\p{L}\p{N}]", other).replace(r"\p{L}", letter)
            out = out.replace(r"\p{N}", digit).replace(r"\S", solid).replace(r"\s", white)
            if r"\p{" in out:
                raise ValueError("the pattern has a property other than letters and numbers")
            return re.compile(out)

        exact = spelled(rf"[^\W\d_{number}{odd}]", rf"[\d{number}{_ranges(missed)}]",
                        rf"(?:[^\w{space}{_ranges(missed)}]|[_{odd}])", f"[{space}]", f"[^{space}]")
        short = spelled(r"[^\W\d_]", r"\d", r"(?:[^\w\s]|_)", r"\s", r"\S")
        rare = np.zeros(sys.maxunicode + 1, bool)
        rare[[*range(0x1C, 0x20), *numbers, *odds, *missed]] = True
        _splitters[pattern] = (exact, short, rare)
    return _splitters[pattern]


class Vocabulary:
    """Token bytes by rank, and the rank of each pair of tokens that joins into a token."""

    def __init__(self, blob: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}
        self.bytes = {r: t for t, r in self.ranks.items()}
        self.size = max(self.bytes) + 1
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        keys, joined = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    joined.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.joined = np.array(joined, np.int64)[order]
        self.pairs = dict(zip(keys, joined))
        self.byte_pairs = np.full((256, 256), _NONE, np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each joined pair, or _NONE."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], _NONE)

    # -------------------------------------------------- merging

    def _lockstep(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Merge pieces of 2 to ``width`` bytes together, one tree a row."""
        m = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, m)
        inside = np.arange(width) < lens[:, None]
        first = np.zeros((m, width), np.uint8)
        first[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        tree = np.full((m, 2 * width), _NONE, np.int64)
        rank = self.byte_pairs[first[:, :-1], first[:, 1:]]
        place = np.arange(width - 1)
        tree[:, width:-1] = np.where(inside[:, 1:] & (rank < _NONE), rank * width + place, _NONE)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        # flat views: leaf (row, place) is at row * width + place, node at row * 2 * width + node
        text, tree, inside = self.single[first.reshape(-1)], tree.reshape(-1), inside.reshape(-1)
        leaf = np.arange(m * width)
        after, before = leaf + 1, leaf - 1
        ends = np.arange(m) * width + lens
        levels = width.bit_length() - 1

        def put(root: np.ndarray, spot: np.ndarray, value: np.ndarray) -> None:
            node = spot + width
            tree[root + node] = value
            for _ in range(levels):
                low = root + (node & -2)
                node = node >> 1
                tree[root + node] = np.minimum(tree[low], tree[low + 1])

        rows = np.flatnonzero(tree[1::2 * width] < _NONE)
        while len(rows):
            root, start = rows * (2 * width), rows * width
            top = tree[root + 1]
            spot = top & (width - 1)
            at = start + spot
            gone = after[at]
            nxt = after[gone]
            token = top >> levels
            text[at] = token
            inside[gone] = False
            after[at] = nxt
            put(root, gone - start, _NONE)
            more = nxt < ends[rows]
            nxt = np.where(more, nxt, at)
            before[nxt[more]] = at[more]
            rank = np.where(more, self.pair_rank(token, text[nxt]), _NONE)
            put(root, spot, np.where(rank < _NONE, rank * width + spot, _NONE))
            has = before[at] >= start
            left, root = before[at[has]], root[has]
            rank = self.pair_rank(text[left], token[has])
            spot = left - start[has]
            put(root, spot, np.where(rank < _NONE, rank * width + spot, _NONE))
            rows = rows[tree[rows * (2 * width) + 1] < _NONE]
        tokens = text[inside].astype(np.int32).tobytes()
        cuts = np.concatenate([[0], 4 * np.cumsum(inside.reshape(m, width).sum(1))]).tolist()
        return [tokens[a:b] for a, b in zip(cuts, cuts[1:])]

    def _alone(self, piece: bytes) -> bytes:
        """Merge one long piece; the same tree in a list of (rank * width + position)."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        none, pairs, size = int(_NONE), self.pairs, self.size
        text = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get(text[i] * size + text[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(spot: int, rank: int | None) -> None:
            node = spot + width
            tree[node] = none if rank is None else rank * width + spot
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        live = [True] * n
        while tree[1] < none:
            token, spot = divmod(tree[1], width)
            gone = after[spot]
            nxt = after[gone]
            text[spot], live[gone], after[spot] = token, False, nxt
            put(gone, None)
            if nxt < n:
                before[nxt] = spot
                put(spot, pairs.get(token * size + text[nxt]))
            else:
                put(spot, None)
            if before[spot] >= 0:
                put(before[spot], pairs.get(text[before[spot]] * size + token))
        return np.array([t for t, ok in zip(text, live) if ok], np.int32).tobytes()

    def encode(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        """The tokens (as int32 bytes) of distinct non-empty pieces; a whole token stays whole."""
        out: dict[bytes, bytes] = {}
        by_width: dict[int, list[bytes]] = {}
        for piece in pieces:
            rank = self.ranks.get(piece)
            if rank is not None:
                out[piece] = rank.to_bytes(4, sys.byteorder)
            elif len(piece) > LOCKSTEP_BYTES:
                out[piece] = self._alone(piece)
            else:
                by_width.setdefault((len(piece) - 1).bit_length(), []).append(piece)
        for bits, group in by_width.items():
            step = max(1, (1 << 17) >> bits)
            for k in range(0, len(group), step):
                out.update(zip(group[k:k + step], self._lockstep(group[k:k + step], 1 << bits)))
        return out


_vocabularies: dict[bytes, Vocabulary] = {}


def _vocabulary(blob: bytes) -> Vocabulary:
    """The worker's vocabulary, read once. Encoded pieces are kept for one task only, so that
    a worker that goes on with other work doesn't hold them."""
    if blob not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[blob] = Vocabulary(blob)
    return _vocabularies[blob]


def read_vocabulary(path: str) -> bytes:
    """The bytes of a ranks file on the driver, within MAX_VOCAB_BYTES."""
    with open(path, "rb") as f:
        blob = f.read(MAX_VOCAB_BYTES + 1)
    if len(blob) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    return blob


def encode_texts(texts: list[str], vocabulary: Vocabulary, store: dict, pattern: str) -> list[bytes]:
    """The tokens of each text, as int32 bytes."""
    exact, short, rare = splitter(pattern)
    split = [(exact if rare[np.frombuffer(t.encode("utf-32-le"), np.uint32)].any() else short).findall(t)
             for t in texts]
    if len(store) > CACHE_PIECES:
        store.clear()
    found = [list(map(store.get, own)) for own in split]
    wait = [i for i, own in enumerate(found) if None in own]
    new = {p: p.encode() for i in wait for p, t in zip(split[i], found[i]) if t is None}
    tokens = vocabulary.encode(new.values())
    store.update((p, tokens[b]) for p, b in new.items())
    for i in wait:
        found[i] = map(store.__getitem__, split[i])
    return [b"".join(own) for own in found]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the tokens of every whole text, each match of ``pattern`` by itself."""
    spark = docs.sparkSession
    common.prepare(spark)
    blob = spark.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, store = _vocabulary(blob.value), {}
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = encode_texts(texts, vocabulary, store, pattern)
                flat = np.frombuffer(b"".join(rows), np.int32)
                offsets = np.cumsum([0, *map(len, rows)]) // 4
                offsets = offsets.astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("id"), ids], ["id", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The input's first column and ``ids`` with the bytes they stand for in ``decoded``.

    Null ids decode to no bytes; an id outside the vocabulary fails the job.
    """
    spark = tokens.sparkSession
    common.prepare(spark)
    blob = spark.sparkContext.broadcast(read_vocabulary(path))
    first = tokens.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _vocabulary(blob.value).bytes.__getitem__
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                out = [b"".join(map(token, ids or ())) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(out, pa.binary())], ["id", "ids", "decoded"])

    source = tokens.select(F.col(first).alias("id"), F.col(ids_col).alias("ids"))
    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary")
    return out.withColumnRenamed("id", first)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and the digests of its ids and of their decoded bytes."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode, and digest both."""
    both = decode(encode(docs, path, pattern), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
