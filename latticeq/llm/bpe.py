"""Byte-level BPE by monoid tree reduction.

A piece of bytes is encoded by halves: each half is encoded by itself, and two neighbours are joined by
re-encoding a window around the boundary that grows until the tokens outside it provably stabilise.

Why that is exact: a token sequence is the BPE encoding of its bytes if and only if every two adjacent tokens
encode, as a pair, to themselves (M. Berglund and B. van der Merwe, "Formalizing BPE Tokenization", 2023). Inside
each half and inside the re-encoded window all adjacent pairs are of that kind, so only the two pairs at the
window's edges are left to be checked; if one fails, the window doubles. The window is the whole piece at last.

Pieces of up to ``LEAF_BYTES`` bytes are leaves of the tree, and encoded by the definition of BPE; longer ones are
joined from halves.

Defined cases: a null or empty text has no tokens; ids pass through, nulls included, and repeated rows give a row each;
texts and pieces of any length are encoded whole, in parts of bounded size; null ids to decode give no bytes; other
columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_rows

LEAF_BYTES = 12
NO_RANK = 1 << 60
CACHE_PIECES = 800_000
CHUNK_PIECES = 200_000


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines ``base64 rank`` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


class TreeBPE:
    """Encoder and decoder over one rank table; holds bounded caches, one instance per Python worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.fits = lru_cache(maxsize=200_000)(self._fits)

    def direct(self, data: bytes) -> list[bytes]:
        """BPE by its definition: merge the pair of least rank, leftmost first, until none is left."""
        if len(data) > 2 * LEAF_BYTES:
            return self._by_heap(data)
        rank, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        order = [rank(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while order and (best := min(order)) != NO_RANK:
            at = order.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at:
                order[at - 1] = rank(parts[at - 1] + parts[at], NO_RANK)
            if at < len(order):
                order[at] = rank(parts[at] + parts[at + 1], NO_RANK)
        return parts

    def _by_heap(self, data: bytes) -> list[bytes]:
        n, ranks = len(data), self.ranks
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i], after[i] = end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [data[i : end[i]] for i in range(n) if alive[i]]

    def _fits(self, a: bytes, b: bytes) -> bool:
        return self.direct(a + b) == [a, b]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The monoid's product: the encoding of both byte strings put together."""
        if not left or not right:
            return left or right
        k = 2
        while True:
            middle = self.direct(b"".join([*left[-k:], *right[:k]]))
            whole_left, whole_right = k >= len(left), k >= len(right)
            if (whole_left or self.fits(left[-k - 1], middle[0])) and (whole_right or self.fits(middle[-1], right[k])):
                return [*(() if whole_left else left[:-k]), *middle, *right[k:]]
            k *= 2

    def reduce(self, data: bytes) -> list[bytes]:
        """Encode by halves; the depth is the logarithm of the length."""
        if len(data) <= LEAF_BYTES:
            return self.direct(data)
        half = len(data) // 2
        if half > 128:
            half -= half % 64  # runs of one character then fall into whole tokens on both sides
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token; a piece that is a token itself is that token."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return [self.ranks[t] for t in self.reduce(data)] if data else []

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """Bytes of ids, concatenated up a tree."""
        if len(ids) <= 4096:
            tokens = self.tokens
            return b"".join([tokens[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class TextEncoder:
    """Whole texts: every match of ``pattern`` by itself, ids packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.bpe = TreeBPE(ranks)
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}

    def packed(self, pieces: list[str]) -> bytes:
        cache = self.cache
        try:
            return b"".join([cache[p] for p in pieces])
        except KeyError:
            out = []
            for p in pieces:
                if (got := cache.get(p)) is None:
                    got = np.array(self.bpe.encode_piece(p.encode("utf-8", "surrogatepass")), "<u4").tobytes()
                    if len(p) <= 64 and len(cache) < CACHE_PIECES:  # frequent pieces come early and stay
                        cache[p] = got
                out.append(got)
            return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) < 1_000_000:
            return self.packed(self.pattern.findall(text))
        found, parts = (m.group() for m in self.pattern.finditer(text)), []
        while pieces := list(islice(found, CHUNK_PIECES)):
            parts.append(self.packed(pieces))
        return b"".join(parts)

    def decode(self, packed: bytes) -> bytes:
        return self.bpe.decode(np.frombuffer(packed, "<u4").tolist())


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder_for(path: str, pattern: str) -> TextEncoder:
    """The worker's encoder for a rank file that is installed on every machine; kept between tasks."""
    if (path, pattern) not in _ENCODERS:
        with open(path, "rb") as f:
            _ENCODERS[path, pattern] = TextEncoder(parse_ranks(f.read()), pattern)
    return _ENCODERS[path, pattern]


def default_ranks() -> tuple[str, str]:
    """Path of the multilingual rank file and the pre-token pattern, from the installed tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids``: the packed ids of each whole text."""
    own = default_ranks() if path is None or pattern is None else None
    path, pattern = path or own[0], pattern or own[1]
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def make():
        enc = encoder_for(path, pattern)
        return lambda ids, texts: [ids, [enc.encode(t) for t in texts]]

    return docs.selectExpr(f"cast(`{id_col}` as bigint) AS doc_id", f"cast(`{text_col}` as string) AS text").mapInArrow(arrow_rows(make, schema), "doc_id bigint, ids binary")


def decode_ids(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``: the bytes that packed ids stand for (null ids: none)."""
    own = default_ranks() if path is None or pattern is None else None
    path, pattern = path or own[0], pattern or own[1]
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def make():
        enc = encoder_for(path, pattern)
        return lambda ids, packed: [ids, packed, [enc.decode(p or b"") for p in packed]]

    return encoded.select("doc_id", "ids").mapInArrow(arrow_rows(make, schema), "doc_id bigint, ids binary, decoded binary")


def round_trip_digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode in one pass and keep digests only; the bytes never leave the worker."""
    own = default_ranks() if path is None or pattern is None else None
    path, pattern = path or own[0], pattern or own[1]
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def make():
        enc = encoder_for(path, pattern)

        def work(ids, texts):
            packed = [enc.encode(t) for t in texts]
            return [ids, [len(p) // 4 for p in packed], [hashlib.sha256(p).hexdigest() for p in packed], [hashlib.sha256(enc.decode(p)).hexdigest() for p in packed]]

        return work

    return docs.selectExpr("cast(doc_id as bigint) AS doc_id", "cast(text as string) AS text").mapInArrow(arrow_rows(make, schema), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 9 over all documents."""
    return round_trip_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
