"""Byte-level BPE encoding in linear time, equal to the tiktoken library's, and decoding.

Text is cut by the public pattern. A piece that is itself in the vocabulary is that token. Any other
piece is encoded by backtracking: the longest token at each place (found in one Aho-Corasick pass
over the piece's bytes, mapped to Latin-1 characters) is tried first, and it stands if merging could
leave it next to the token before it; else a shorter one is tried, and where none stands, the last
token is taken back. A place from which no encoding ends well is marked once and never tried again,
which keeps the whole linear. Whether two tokens can stand side by side is worked out by undoing
their merges, and remembered.

Vocabularies are rank files read on the driver and broadcast: their size is fixed by the vocabulary.

Defined cases: a null text counts as empty; an empty text has no ids; a text of any length is encoded
whole; rows repeat as they come; a null doc_id stays null; other columns are ignored (or kept, in
``with_ids``); an empty table gives an empty result.
"""


import base64
import hashlib
from array import array
from itertools import accumulate

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Pieces (and token pairs) remembered by one Python worker; beyond this the memory starts anew.
MEMORY = 1_000_000
#: Rows encoded at once.
SLICE = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_split(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes ``token``; None if merging its bytes does not end in it."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 62))
        if ranks.get(parts[best] + parts[best + 1], 1 << 62) >= ranks[token]:
            return None
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Codec:
    """Encodes and decodes with one vocabulary and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        reachable = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
                reachable[token] = rank
            elif split := merge_split(token, ranks):
                self.halves[rank] = tuple(ranks[x] for x in split)
                self.pairs[self.halves[rank]] = rank
                reachable[token] = rank
        self.finder = ahocorasick.Automaton()
        for token, rank in reachable.items():
            self.finder.add_word(token.decode("latin-1"), (len(token), rank))
        self.finder.make_automaton()
        #: The next shorter token that starts a token.
        self.shorter = {rank: next((reachable[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in reachable), -1)
                        for token, rank in reachable.items()}
        self.length = {rank: len(token) for token, rank in reachable.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` side by side; remembered in ``fits``."""
        if len(self.fits) >= MEMORY:
            self.fits.clear()
        self.fits[left, right] = answer = self._stay_apart(left, right)
        return answer

    def _stay_apart(self, left: int, right: int) -> bool:
        # Undo the later merge of the two, again and again. At each step the parts that touch must
        # not have had an earlier merge with each other than the one that took either of them in.
        bound = 1 << 62
        while True:
            if self.pairs.get((left, right), 1 << 62) < bound:
                return False
            if left > right:
                bound, left = left, self.halves[left][1]
                if left == bound:
                    bound, right = right + 1, self.halves[right][0]
                    if right + 1 == bound:
                        return True
            else:
                bound, right = right + 1, self.halves[right][0]
                if right + 1 == bound:
                    bound, left = left, self.halves[left][1]
                    if left == bound:
                        return True

    def _backtrack(self, piece: bytes) -> list[int]:
        end = len(piece)
        longest = [-1] * (end + 1)
        widest = [0] * end
        for last, (size, rank) in self.finder.iter(piece.decode("latin-1")):
            start = last - size + 1
            if size > widest[start]:
                widest[start], longest[start] = size, rank
        length, shorter, fits, compatible = self.length, self.shorter, self.fits, self.compatible
        open_, out, at, token, before = bytearray(b"\1") * (end + 1), [], 0, longest[0], -1
        while at < end:
            while token >= 0:
                stop = at + length[token]
                if open_[stop]:
                    fit = True if before < 0 else fits.get((before, token))
                    if fit or fit is None and compatible(before, token):
                        out.append(token)
                        at, before, token = stop, token, longest[stop]
                        break
                token = shorter[token]
            else:
                open_[at] = 0
                token = out.pop()
                before = out[-1] if out else -1
                at -= length[token]
                token = shorter[token]
        return out

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one piece as little-endian unsigned 32-bit numbers."""
        raw = piece.encode("utf-8", "replace")
        rank = self.ranks.get(raw)
        out = array("I", [rank] if rank is not None else self._backtrack(raw)).tobytes()
        if len(self.pieces) >= MEMORY:
            self.pieces.clear()
        if len(piece) <= 64:
            self.pieces[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        known, fresh = self.pieces.get, self.encode_piece
        return b"".join([known(p) or fresh(p) for p in self.pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_CODECS: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """One codec for each vocabulary in a Python worker."""
    ranks, pattern, name = shared.value
    if name not in _CODECS:
        _CODECS[name] = Codec(ranks, pattern)
    return _CODECS[name]


def share(spark: SparkSession, path: str, pattern: str):
    ranks = read_ranks(path)
    name = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    return spark.sparkContext.broadcast((ranks, pattern, name))


def _digest_rows(shared):
    def rows(batches):
        codec = _codec(shared)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n, coded, decoded = [], [], []
            for text in texts:
                out = codec.encode(text.as_py() or "")
                n.append(len(out) // 4)
                coded.append(hashlib.sha256(out).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(out)).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return rows


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: texts encoded whole, ids decoded again."""
    shared = share(docs.sparkSession, path, pattern)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _digest_rows(shared), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _id_rows(shared):
    def rows(batches):
        codec = _codec(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                coded = [codec.encode(text or "") for text in part.column("_bpe_text").to_pylist()]
                ends = pa.array([0, *accumulate(len(x) // 4 for x in coded)], pa.int32())
                ids = pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join(coded))])
                kept = [c for c in part.schema.names if c != "_bpe_text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.ListArray.from_arrays(ends, ids)], [*kept, "input_ids"])
    return rows


def with_ids(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``input_ids``, the token ids of its text; ids never become Python numbers."""
    shared = share(docs.sparkSession, path, pattern)
    given = docs.select(*keep, F.col("text").alias("_bpe_text"))
    schema = StructType([*(given.schema[c] for c in keep), StructField("input_ids", ArrayType(IntegerType(), False))])
    return given.mapInArrow(_id_rows(shared), schema)


def decoder(spark: SparkSession, path: str, pattern: str):
    """A column function: array of token ids -> bytes."""
    shared = share(spark, path, pattern)

    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        codec = _codec(shared)
        return ids.map(lambda x: codec.decode(array("I", [] if x is None else [int(i) for i in x]).tobytes()))
    return decode
