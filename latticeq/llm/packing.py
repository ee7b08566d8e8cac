"""Sum-of-squares packing of tokenised documents into sequences of bounded length.

Documents become pieces: only a document of more than ``capacity`` tokens is cut, into full pieces, of which the
first may be shorter. Pieces are dealt at random into groups of some 16,000 sequences each (the number of groups
follows the input, a group's size does not), and every group is packed by itself: larger pieces first, each into
the open sequence that makes the sum of the squared counts of open sequences per residual gap smallest; a new
sequence is opened only if no open one has room. A group's few open sequences are the only loss.

Defined cases: a null or empty text is one piece holding only the end token; equal lengths are placed in the order
of id and piece; repeated rows and null ids are packed as often as they come, and dealt to groups like all others;
columns with the new names give way; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import column_index, cut, free_names, in_slices, numbered

CAPACITY = 2048
END_ID = 0
GROUP_TOKENS = 2048 * 16384
GROUP_PIECES = 250_000
#: Text of these blocks is encoded by the fast path; the rest goes through the tokenizers library itself.
PLAIN = re.compile(r"[\u0000-\u052f\u2000-\u206f\u20a0-\u20bf\u4e00-\u9fff]*")


class Ids:
    """Ids of whole texts by a ``tokenizers`` file.

    A byte-level BPE file whose merges stand in the order of their ids gives the same ids through a rank encoder,
    which is over three times as fast; that order is checked, and texts that hold an added token or come from rarer
    blocks of Unicode go through the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            content = f.read()
        self.library = Tokenizer.from_str(content.decode("utf-8"))
        self.fast = self._ranked(json.loads(content))

    def _ranked(self, spec: dict):
        import public_tokenizers
        import tiktoken

        model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocab = model["vocab"]
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [vocab["".join(m)] for m in merges]
        if any(a >= b for a, b in zip(order, order[1:])) or order[0] < 256:
            return None
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if token not in self.added}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is not None and PLAIN.fullmatch(text) and not any(t in text for t in self.added):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_IDS: dict[str, Ids] = {}


def ids_for(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: whole if it fits, else the short piece first and full ones after."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids`` of every piece; ids are little-endian unsigned 32-bit integers."""
    path = path or default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_for(path)
        for batch in in_slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    for c, v in zip(out, (doc_id, k, start, length, ids[start : start + length].tobytes())):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return docs.selectExpr(f"cast(`{id_col}` as bigint) AS doc_id", f"cast(`{text_col}` as string) AS text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, taken in the order given; see the module's text for the rule."""
    count = np.zeros(capacity + 1, np.int64)  # open bins per residual gap; a gap of 0 is not open
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, total = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        here = count[s:]
        fits = np.flatnonzero(here)
        if len(fits):
            # moving a bin from gap g to gap g - s changes the sum of squares by 2 * (N[g - s] - N[g]) + 2, or by 1 - 2 * N[g] if it closes
            change = 2 * (count[fits] - here[fits]) + 2
            if fits[0] == 0:
                change[0] = 1 - 2 * here[0]
            gap = s + int(fits[int(np.argmin(change))])
            b = opened[gap].pop()
            count[gap] -= 1
        else:
            gap, b, total = capacity, total, total + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            count[gap - s] += 1
            opened[gap - s].append(b)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (with ``doc_id``, ``piece`` and ``length``; other columns are carried) plus ``sequence_id`` and ``offset``.

    Columns that have these names already stay, the new ones then get an underscore before theirs.
    A group's rows are held by one task: at most about ``group_pieces`` of them, so carry no long columns.
    """
    pieces = cut(pieces)  # rows are dealt by their place in it
    n, tokens = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, -(-tokens // group_tokens), -(-n // group_pieces))
    names = pieces.columns
    length, doc_id, piece = (f"c{column_index(names, c)}" for c in ("length", "doc_id", "piece"))
    plain = numbered(pieces)
    schema = StructType([*plain.schema.fields, StructField("sequence", LongType()), StructField("offset", LongType())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.drop_columns(["group"]).append_column("row", pa.array(np.arange(table.num_rows)))
        order = table.sort_by([(length, "descending"), (doc_id, "ascending"), (piece, "ascending"), ("row", "ascending")]).drop_columns(["row"])
        bins, offsets = sum_of_squares(order.column(length).to_numpy(), capacity)
        return order.append_column("sequence", pa.array((np.int64(key[0].as_py()) << 40) + bins)).append_column("offset", pa.array(offsets))

    group = F.pmod(F.xxhash64(F.lit(7), F.monotonically_increasing_id()), F.lit(groups))
    packed = plain.withColumn("group", group).groupBy("group").applyInArrow(run, schema)
    return packed.toDF(*names, *free_names(names, "sequence_id", "offset"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 7 over all documents; the ids' digest is taken before the exchange."""
    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_digest(docs: DataFrame) -> DataFrame:
    """Pieces, their place and the CRC-32 of their ids."""
    return pack(tokenize_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
