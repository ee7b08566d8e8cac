"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes, each at its position. Two fingerprints that differ in at most two bits share
at least six of the eight positional bytes.

Postings. A posting list of a single positional byte holds 1/256 of all fingerprints, so its pairs grow with the
square of the corpus. Lists are therefore addressed by five positional bytes together: a fingerprint stands in 56
lists, one for each five of the eight positions, and two fingerprints that share ``m`` positional bytes meet in
``C(m, 5)`` of them. The lists in which a pair meets are tallied; a pair that shares six bytes has at least
``C(6, 5) = 6``, so pairs that reach six are retained and verified bit by bit, and all others are dropped.

Long lists. A list of more than ``LIST_MOST`` fingerprints is split by its free bytes: each member stands in a
sub-list for itself and for each of the 24 fingerprints one free bit away. Two members meet there if and only if
they differ in at most two bits, at most 25 can meet in one sub-list whatever the data, and the pair counts once for
its list. So a linked pair gets its six counts from short and long lists alike, and nothing is lost.

Copies meet in one fingerprint before any of this, so their number does not matter.

Defined cases: a null, empty or word-less text has fingerprint zero and is linked like any other; a row without
a doc_id keeps its fingerprint, has no component and links nothing; equal doc_ids may repeat; an empty table gives
an empty table; other columns, whatever their names, are not looked at.

Similar texts. :func:`similar_documents` and :func:`keep_one` work on sets of five-word shingles at a Jaccard
similarity of 0.8. Fingerprints alone reach few of those pairs (some five to twelve bits differ), so the fingerprint
index gives the first links there and an exact prefix filter the rest; see :func:`similar_links`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import arrow_rows, cut, free_names, in_slices, release

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
MOST_BITS = 2
BYTES, TAKEN = 8, 5
LISTS = tuple(combinations(range(BYTES), TAKEN))
LEAST_LISTS = comb(BYTES - MOST_BITS, TAKEN)
LIST_MOST = 64
OFTEN = 10_000
CHUNK = 1 << 18
SIMILARITY, SIMILAR_WIDTH = 0.8, 5
BUCKET_BITS = 16
LOOKS, PART_ROUNDS = 64, 2
BROADCAST_NODES = 200_000
SLACK = 1e-6


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the lower-cased text's word shingles, repeats included, in blocks; none for a text without words."""
    from xxhash import xxh64_intdigest

    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # on bytes, A-Z alone change
    if not words:
        return
    n = max(1, len(words) - width + 1)
    for at in range(0, n, CHUNK):
        some = words[at : at + CHUNK + width - 1]
        shingles = map(b" ".join, zip(*(some[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
        yield np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), "<u8")


def _majority(blocks: list[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), sum(map(len, blocks))
    for h in blocks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the text's word shingles, as an unsigned integer: a bit is set if it is in over half the hashes."""
    return _majority(list(shingle_hashes(text, width)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint's bits as a signed 64-bit integer, of each row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def work(ids, texts):
        return [ids, np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)]

    return docs.selectExpr(f"cast(`{id_col}` as bigint) AS doc_id", f"cast(`{text_col}` as string) AS text").mapInArrow(arrow_rows(lambda: work, schema), "doc_id bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(positions: tuple[int, ...]) -> int:
    return _signed(sum(0xFF << (8 * p) for p in positions))


def _free_flips(positions: tuple[int, ...]) -> list[int]:
    """Zero, and each bit of the bytes that a list does not fix."""
    return [0, *(_signed(1 << (8 * p + k)) for p in range(BYTES) if p not in positions for k in range(8))]


def _pairs(members: str) -> Column:
    """All pairs of a sorted list's fingerprints, the lesser first."""
    return F.flatten(F.transform(members, lambda x, i: F.transform(F.slice(members, i + 2, F.size(members)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def tallied(prints: DataFrame, list_most: int = LIST_MOST) -> DataFrame:
    """``a, b, lists``: pairs of the distinct fingerprints ``fp`` and in how many posting lists they meet.

    Pairs that differ in more than two bits are counted in short lists only, so their tally may be too low; that of
    all others is exact.
    """
    at = F.array(*(F.struct(F.lit(k).alias("list"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("key")) for k, p in enumerate(LISTS)))
    postings = prints.select("fp", F.explode(at).alias("at")).select("fp", "at.list", "at.key")
    held = cut(postings.withColumn("size", F.count("*").over(Window.partitionBy("list", "key"))).where("size > 1"))
    short = held.where(F.col("size") <= list_most).groupBy("list", "key").agg(F.sort_array(F.collect_list("fp")).alias("members"))
    flips = F.array(*(F.array(*map(F.lit, _free_flips(p))) for p in LISTS))
    near = held.where(F.col("size") > list_most).select("list", "fp", F.explode(F.transform(F.element_at(flips, F.col("list") + 1), lambda f: F.col("fp").bitwiseXOR(f))).alias("near"))
    split = near.groupBy("list", "near").agg(F.sort_array(F.collect_list("fp")).alias("members")).where(F.size("members") > 1)
    found = [x.select("list", F.explode(_pairs("members")).alias("p")).select("list", "p.*") for x in (short, split)]
    return found[0].unionByName(found[1].distinct()).groupBy("a", "b").agg(F.count("*").alias("lists"))


def links(prints: DataFrame, list_most: int = LIST_MOST) -> DataFrame:
    """``a, b``: the fingerprints of ``prints`` (a row each, ``fp``) that differ in at most two bits."""
    kept = tallied(prints, list_most).where(F.col("lists") >= LEAST_LISTS)
    return kept.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, list_most: int = LIST_MOST) -> DataFrame:
    """``doc_id, fp, component_id`` of each row: the smallest doc_id reachable over links, itself included."""
    made = cut(fingerprints(docs, id_col, text_col, width))
    prints = cut(made.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")))
    found = components(links(prints.select("fp"), list_most)).withColumnRenamed("node", "fp")
    least = prints.join(found, "fp").groupBy("component").agg(F.min("node").alias("least"))
    linked = found.join(least, "component").select("fp", "least")
    often = F.col("rows") * OFTEN > made.count()  # of at most so many fingerprints, the copies of a text among them
    classes = cut(prints.join(linked, "fp", "left").select("fp", F.coalesce("least", "node").alias("component_id"), often.alias("often")))
    met = made.join(F.broadcast(classes.where("often").select("fp", F.col("component_id").alias("common_id"))), "fp", "left")
    rest = met.where("common_id IS NULL").join(classes.where("NOT often").select("fp", "component_id"), "fp", "left")
    met = met.where("common_id IS NOT NULL").withColumn("component_id", F.col("common_id"))
    return met.unionByName(rest).select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _copy(blocks: list[np.ndarray]) -> int:
    """Hash of the lower-cased word sequence; equal ones are copies."""
    from xxhash import xxh64_intdigest

    return _signed(xxh64_intdigest(b"".join(b.tobytes() for b in blocks), 1))


def _set(blocks: list[np.ndarray]) -> np.ndarray:
    """The sorted distinct shingle hashes; a text without words has one of its own."""
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(1, np.uint64)


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``tid`` (a hash of the text as it is) and ``text``."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SIMILAR_WIDTH) -> DataFrame:
    """``doc_id, tid, copy, fp`` of each row and, in rows of their own, ``bucket, n``: each task's shingles by bucket.

    The buckets are the first ``BUCKET_BITS`` bits of the shingles' hashes; every shingle of every text is counted.
    """
    kinds = [("doc_id", pa.int64()), ("tid", pa.int64()), ("copy", pa.int64()), ("fp", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BUCKET_BITS, np.int64)
        for piece in in_slices(batches):
            copies, prints, sets = [], [], []
            for text in piece.column(2).to_pylist():
                blocks = list(shingle_hashes(text, width))
                copies.append(_copy(blocks))
                prints.append(_signed(_majority(blocks)))
                sets.append(_set(blocks))
            if sets:
                seen += np.bincount((np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(seen))
            none = pa.nulls(piece.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(copies, pa.int64()), pa.array(prints, pa.int64()), none.cast(pa.int32()), none], schema=schema)
        held = np.flatnonzero(seen)
        none = pa.nulls(len(held), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(held, pa.int32()), pa.array(seen[held])], schema=schema)

    return _read(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, tid bigint, copy bigint, fp bigint, bucket int, n bigint")


def prefix(grams: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest ``n - similarity * n`` shingles (and one more) of a set of ``n``, by their buckets' counts.

    In one order of all shingles two sets of that similarity share one of these, whatever the order is; rare ones
    first makes short lists.
    """
    order = np.lexsort((grams, common[(grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))
    return grams[order[: len(grams) - int(np.ceil(similarity * len(grams) - SLACK)) + 1]]


def prefixes(docs: DataFrame, common: np.ndarray, text_col: str = "text", width: int = SIMILAR_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``key, node, n, at``: each text's prefix shingles, its copy hash, the size of its set, and the shingle's place.

    A task writes copies once; those of other tasks repeat the same rows.
    """
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for piece in in_slices(batches):
            keys, nodes, sizes = [], [], []
            for text in piece.column(0).to_pylist():
                blocks = list(shingle_hashes(text, width))
                if (copy := _copy(blocks)) not in known:
                    known.add(copy)
                    grams = _set(blocks)
                    keys.append(prefix(grams, common, similarity).view(np.int64))
                    nodes.append(copy)
                    sizes.append(len(grams))
            if keys:
                each = np.array([len(k) for k in keys])
                at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((np.concatenate(keys), np.repeat(np.array(nodes, np.int64), each), np.repeat(sizes, each), at), schema)], schema=schema)

    return docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "key bigint, node bigint, n int, at int")


def _overlap(n: Column, m: Column, similarity: float) -> Column:
    """What sets of these sizes must have in common to be that similar."""
    return (n + m) * (similarity / (1 + similarity)) - SLACK


def shared_postings(found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``key, node, n, at, early`` of the prefix lists of two texts and more, every text once in a list.

    A pair of sizes ``n <= m`` shares at least ``_overlap(n, n)``, so the first shingle that it has in common lies
    so early in the lesser set that as many are left. ``early`` says whether a list has such a member; a pair meets
    first in a list that has.
    """
    in_order, whole = Window.partitionBy("key").orderBy("node"), Window.partitionBy("key")
    rows = found.withColumn("before", F.lag("node").over(in_order)).where("before IS NULL OR before <> node")
    early = F.col("n") - F.col("at") >= _overlap(F.col("n"), F.col("n"), similarity)
    rows = rows.withColumn("size", F.count("*").over(whole)).withColumn("early", F.max(early).over(whole))
    return rows.where("size > 1").select("key", "node", "n", "at", "early")


def shingle_sets(docs: DataFrame, width: int = SIMILAR_WIDTH) -> DataFrame:
    """``node, grams``: the sorted distinct shingle hashes of whole texts; ``docs`` has ``node`` and ``text``."""
    schema = pa.schema([("node", pa.int64()), ("grams", pa.binary())])

    def work(nodes, texts):
        return [nodes, [_set(list(shingle_hashes(t, width))).tobytes() for t in texts]]

    return docs.select("node", "text").mapInArrow(arrow_rows(lambda: work, schema), "node bigint, grams binary")


def verified(pairs: DataFrame, texts: DataFrame, own: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``a, b`` of ``pairs`` whose shingle sets have at least that Jaccard similarity.

    ``texts`` has ``doc_id, tid, text``, and ``own`` a ``doc_id`` and ``tid`` for each node. Whole texts are read
    again for the nodes of pairs, which are few; no other sets are made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_slices(batches):
            ok = []
            for x, y in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = 0
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - SLACK:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - SLACK)
            kept = piece.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    mine = cut(own.join(nodes, "node", "left_semi"))
    small = mine.count() <= BROADCAST_NODES  # of three numbers each
    sets = cut(shingle_sets(texts.join(F.broadcast(mine) if small else mine, ["doc_id", "tid"]).select("node", "text")))
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    found = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct())
    release(pairs.sparkSession)
    return found


def _left(n: Column, similarity: float) -> Column:
    """How many shingles of a set stand behind its prefix."""
    return F.ceil(n * similarity - SLACK) - 1


def plausible(pairs: DataFrame, lists: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``a, b`` of ``pairs`` that their whole prefixes do not rule out; ``lists``: ``node, n, keys``, all shared ones.

    Up to where the first of the two prefixes ends, what they have in common is counted; from there on it is at most
    what that set has left.
    """
    left = lists.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("keys").alias("keys1"))
    met = pairs.join(left, "a").join(lists.withColumnRenamed("node", "b"), "b")
    both = F.size(F.array_intersect("keys", "keys1")) + F.greatest(_left(F.col("n"), similarity), _left(F.col("n1"), similarity))
    return met.where(both >= _overlap(F.col("n"), F.col("n1"), similarity)).select("a", "b")


def _with_parts(shared: DataFrame, found: DataFrame) -> DataFrame:
    """``shared`` with the part of each node under the links ``found``, without lists of one part.

    Nodes of one part are linked; nodes of different ones may be, which costs a look more.
    """
    rows = shared.join(components(found, rounds=PART_ROUNDS), "node", "left").select("key", "node", "n", "at", F.coalesce("component", "node").alias("part"))
    mixed = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    return cut(rows.join(mixed.select("key"), "key", "left_semi"))


def _can(n: Column, at: Column, m: Column, to: Column, similarity: float) -> Column:
    """Whether sets of sizes ``n`` and ``m`` with a first common shingle at these places can be that similar.

    What they have in common is at most what is left in the shorter rest from there on.
    """
    sizes = F.least(n, m) >= F.greatest(n, m) * similarity - SLACK
    return sizes & (F.least(n - at, m - to) >= _overlap(n, m, similarity))


def _met(one: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: pairs of a row of ``one`` (``node1, n1, at1, part1``) and one of ``rows`` of its list that can be similar."""
    met = one.join(rows, "key").where("part1 <> part").where(_can(F.col("n1"), F.col("at1"), F.col("n"), F.col("at"), similarity))
    return met.select(F.greatest("node", "node1").alias("a"), F.least("node", "node1").alias("b")).distinct()


def _to_leaders(rows: DataFrame, turn: int, similarity: float) -> DataFrame:
    """``a, b``: the members of each list and its leader of this turn, where they are of different parts.

    The first leader is the member with the fewest rarer shingles of its own, so the one that the others are changed
    copies of; after it, others by a hash that goes by the turn.
    """
    rank = (F.col("at") / F.col("n")) if not turn else F.xxhash64(F.lit(turn), "node")
    first = rows.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "node", "n", "at", "part")).alias("lead"))
    return _met(first.select("key", *(F.col(f"lead.{c}").alias(f"{c}1") for c in ("node", "n", "at", "part"))), rows, similarity)


def _across(rows: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: all pairs of a list's members of different parts that their sizes and places do not rule out.

    Members of a list's largest part meet only those of other parts, so a large group that is one part already costs
    its number of members, not the square of it.
    """
    most = rows.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("most"))
    one = rows.join(most, "key").where("part <> most").select("key", *(F.col(c).alias(f"{c}1") for c in ("node", "n", "at", "part")))
    return _met(one, rows, similarity)


def _looks(rows: DataFrame, similarity: float) -> int:
    """A bound on the pairs that :func:`_across` finds: one of a pair has its place early, and parts differ."""
    early = (F.col("n") - F.col("at") >= _overlap(F.col("n"), F.col("n"), similarity)).cast("bigint")
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum(early).alias("early"))
    lists = parts.groupBy("key").agg((F.sum("n") * F.sum("early") - F.sum(F.col("n") * F.col("early"))).alias("looks"))
    return lists.agg(F.sum("looks")).first()[0] or 0


def _by_fingerprint(made: DataFrame, list_most: int) -> DataFrame:
    """``a, b``: texts and the least one of those that the SimHash index joins them with."""
    nodes = cut(made.select(F.col("copy").alias("a"), "fp").distinct())
    found = components(links(nodes.select("fp").distinct(), list_most), rounds=PART_ROUNDS)
    rows = nodes.join(found, F.col("fp") == F.col("node"), "left").select("a", F.coalesce("component", "fp").alias("group"))
    least = rows.groupBy("group").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(least, "group").where("a <> b").select("a", "b")


def similar_links(docs: DataFrame, made: DataFrame, text_col: str = "text", list_most: int = LIST_MOST, similarity: float = SIMILARITY) -> DataFrame:
    """``a, b``: links between texts (by copy hash) whose components are those of all pairs of that similarity.

    ``made`` has the rows of :func:`sketches`, ``docs`` the texts. Links come in three steps, each verified on whole
    shingle sets: (1) the components of the SimHash index; (2) in each list of the prefix filter, the members to the
    list's leader, for as many turns as find links and leave step 3 much to look at; (3) all pairs of a list that are in different components by
    then and that sizes and places cannot rule out. Steps 1 and 2 only spare step 3 the pairs of large groups: the
    prefix filter alone misses no pair, and no list of any length is cut.
    """
    counts = made.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
    common = np.zeros(1 << BUCKET_BITS, np.int64)
    common[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    made = made.where("bucket IS NULL")
    shared = cut(shared_postings(prefixes(docs, common, text_col, similarity=similarity), similarity))
    lists = cut(shared.groupBy("node").agg(F.max("n").alias("n"), F.collect_list("key").alias("keys")))  # a text's prefix at most
    own = cut(made.groupBy(F.col("copy").alias("node")).agg(F.min(F.struct("doc_id", "tid")).alias("own")).select("node", "own.*"))
    texts = _read(docs, "doc_id", text_col)
    release(docs.sparkSession)

    def tested(pairs: DataFrame) -> DataFrame:
        return cut(plausible(pairs, lists, similarity))

    size = shared.count()
    rows, found, turn = shared.where("early").select("key", "node", "n", "at", F.col("node").alias("part")), None, 0
    while True:
        met = _to_leaders(rows, turn, similarity)
        met = tested(met if turn else met.unionByName(_by_fingerprint(made, list_most)).distinct())
        near = verified(met, texts, own, similarity)
        found, turn = near if found is None else found.unionByName(near), turn + 1
        rows = _with_parts(rows.drop("part"), found)
        release(docs.sparkSession)
        if _looks(rows, similarity) <= LOOKS * size or near.isEmpty():
            return found.unionByName(verified(tested(_across(rows, similarity)), texts, own, similarity))


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, list_most: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, tid, copy`` of the rows with an id, and ``copy, component`` of the texts that are linked."""
    named = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    made = cut(sketches(named))
    found = components(similar_links(named, made, "text", list_most, similarity)).withColumnRenamed("node", "copy")
    return made.where("bucket IS NULL").select("doc_id", "tid", "copy"), found


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, list_most: int = LIST_MOST) -> DataFrame:
    """``doc_id, component_id``: components of documents whose five-word shingle sets are that similar.

    The component's id is the least doc_id in it. Rows without a doc_id are left out.
    """
    made, found = _classes(docs, id_col, text_col, similarity, list_most)
    copies = made.groupBy("copy").agg(F.min("doc_id").alias("least")).join(found, "copy", "left")
    copies = copies.select("copy", "least", F.coalesce("component", "copy").alias("component"))
    ids = copies.groupBy("component").agg(F.min("least").alias("component_id"))
    return made.join(copies.join(ids, "component").select("copy", "component_id"), "copy").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of similar documents, that of its smallest doc_id; same columns.

    Of rows that repeat that doc_id with similar texts, one stays; rows with one doc_id and different texts are
    different documents. Rows without a doc_id all stay.
    """
    made, found = _classes(docs, id_col, text_col, SIMILARITY, LIST_MOST)
    first = made.groupBy("copy").agg(F.min(F.struct("doc_id", "copy", "tid")).alias("first")).join(found, "copy", "left")
    keep = first.groupBy(F.coalesce("component", "copy").alias("component")).agg(F.min("first").alias("first"))
    named = free_names(docs.columns, "kept_id", "kept_tid", "rank")
    kept_id, kept_tid, rank = named
    keep = keep.select(F.col("first.doc_id").alias(kept_id), F.col("first.tid").alias(kept_tid))
    own, tid = F.col(f"`{id_col}`").cast("bigint"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).join(keep, (own == F.col(kept_id)) & (tid == F.col(kept_tid)), "left_semi")
    rows = rows.withColumn(rank, F.row_number().over(Window.partitionBy(own, tid).orderBy(F.lit(0)))).where(F.col(rank) == 1).drop(rank)
    return rows.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 1 over all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
