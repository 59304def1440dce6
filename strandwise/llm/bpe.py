"""Byte-level BPE encoding and decoding with the ranks of a given vocabulary.

A piece of text starts as single bytes. A segment tree over its byte positions stores, for each live part, the
rank of the pair that it forms with the next live one; the root is the leftmost pair of least rank. A merge
changes three leaves: the pair merged, the pair before it and the position that is no part any more, so a piece
of n bytes costs n log n, however long it is.
"""

from __future__ import annotations

import base64
import sys
import uuid
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, pieces

#: Pieces of a generation kept with their ids, and the bytes of the longest kept.
KEPT, KEPT_BYTES = 500_000, 48
#: A vocabulary is read by the driver and sent to each worker; larger files are an error, not a larger broadcast.
MAX_VOCABULARY_BYTES = 64 << 20


def load_ranks(path: str, max_bytes: int = MAX_VOCABULARY_BYTES) -> dict[bytes, int]:
    """token -> rank of a vocabulary file of lines `base64 rank`."""
    with open(path, "rb") as f:
        data = f.read(max_bytes + 1)
    if len(data) > max_bytes:
        raise ValueError(f"a vocabulary of over {max_bytes} bytes is not sent to the workers")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


#: Key of a position that begins no pair.
NONE = 1 << 62


class PairTree:
    """Leftmost minimum over positions; a key is rank and position in one number, so that of equal ranks the first is least."""

    def __init__(self, keys: list[int]):
        self.size = size = 1 << (len(keys) - 1).bit_length()
        self.node = node = [NONE] * size + keys + [NONE] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b

    def least(self) -> int:
        return self.node[1]

    def put(self, at: int, key: int) -> None:
        node, i = self.node, self.size + at
        node[i] = key
        while i > 1:
            other = node[i ^ 1]
            if other < key:
                key = other
            i >>= 1
            if node[i] == key:
                return
            node[i] = key


def merge_bytes(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one piece: a whole token as such, else pairs merged by rank, the leftmost of equal rank first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, rank_of = len(piece), ranks.get
    end, before = list(range(1, n + 2)), list(range(-1, n))

    def key(i: int) -> int:
        mid = end[i]
        if mid >= n or end[mid] - i > longest:
            return NONE
        rank = rank_of(piece[i : end[mid]])
        return NONE if rank is None else rank << 32 | i

    tree = PairTree([NONE if (rank := rank_of(piece[i : i + 2])) is None else rank << 32 | i for i in range(n - 1)] + [NONE])
    put = tree.put
    while (low := tree.least()) < NONE:
        i = low & 0xFFFFFFFF
        gone, left = end[i], before[i]
        end[i] = after = end[gone]
        before[after] = i
        put(gone, NONE)
        put(i, key(i))
        if left >= 0:
            put(left, key(left))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder(dict):
    """A worker's encoder: the split pattern, the ranks, and, as this dict, pieces with their packed ids.

    What was seen is kept in two generations of KEPT pieces, so that memory is bounded and frequent pieces stay.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.longest, self.split = ranks, max(map(len, ranks), default=0), regex.compile(pattern).findall
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = packed(array("I", merge_bytes(raw, self.ranks, self.longest)))
            if len(raw) > KEPT_BYTES:
                return ids
        if len(self) >= KEPT:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed."""
        return b"".join(map(self.__getitem__, self.split(text)))


#: The encoder of the last vocabulary that this worker has used; tasks of one job share it.
_LAST: dict[str, Encoder] = {}


def worker_encoder(name: str, ranks: dict[bytes, int], pattern: str) -> Encoder:
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Encoder(ranks, pattern)
    return _LAST[name]


def packed(ids: array) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def unpacked(data: bytes) -> array:
    ids = array("I")
    ids.frombytes(data)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of every row's whole text.

    A null text is empty and has no ids; repeated rows stay, a null doc_id stays null, extra columns are left out; an
    empty table gives no rows. No shuffle: a row is encoded where it is read. Special tokens are ordinary text.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(ranks), uuid.uuid4().hex
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encode_text = worker_encoder(name, shared.value, pattern).encode
        for b in pieces(batches, 256):
            yield batch(schema, doc_id=b.column(0), ids=[encode_text(t.as_py() or "") for t in b.column(1)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int], keep_ids: bool = True) -> DataFrame:
    """encoded (doc_id, ids) with the bytes that its ids stand for, as column decoded; null ids give null, an unknown id is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})
    fields = [("doc_id", pa.int64()), *([("ids", pa.binary())] if keep_ids else []), ("decoded", pa.binary())]
    schema = pa.schema(fields)

    def run(batches):
        token = shared.value.__getitem__
        for b in pieces(batches, 256):
            text = [None if x is None else b"".join(map(token, unpacked(x))) for x in b.column(1).to_pylist()]
            yield batch(schema, **{n: text if n == "decoded" else b.column(i) for i, n in enumerate(schema.names)})

    return encoded.select("doc_id", "ids").mapInArrow(run, ", ".join(f"{n} {'long' if n == 'doc_id' else 'binary'}" for n, _ in fields))


def bpe_digest(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    ranks = load_ranks(path)
    both = decode(encode(docs, ranks, pattern), ranks)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
