"""Similarity join on word n-gram sets by Jaccard, with set-relation skipping.

Exact for every pair of documents whose sets have a Jaccard similarity of
``percent`` or more; the result is the component that a document is in.

1. Sets: the distinct ``words``-word shingles of the whole text, as 64-bit hashes.
   Equal sets are one from here on, whatever their number of copies.
2. Survivors: in a linked pair (J >= t) at most ``n - ceil(t n)`` shingles of a set
   are missing from the other. So of the ``n - ceil(t n) + l`` lowest hashes of
   each, ``l`` (a tenth of the set) are common. Only those enter the index, and a set whose lowest
   hashes are not shared often enough with any other set is out.
3. Index lists: the survivors' shared hashes, rarest first, only as many as the
   prefix bound asks for. A list is kept in blocks by size class (a set meets its
   own class and the one below) and a busy list is split into pairs of blocks.
4. Round one, answers for others: each block's sets are verified against one
   pivot, the set that shares most of its hashes with others: of a family of
   near copies the one nearest to what they come from. Sets that are linked to
   it are answered by it: whatever is in one component already is not compared again.
5. Round two: the pairs of a list that are in different components. A list is
   sorted by size and by what may follow, and cut into blocks; from the blocks'
   least and greatest values whole pairs of blocks are skipped, and then single
   pairs, that fail by size, by position in the list
   (what may follow can't reach ``l``), or by their distances to the list's first
   set, whose answers bound theirs (triangle inequality on parity bitmaps). Of
   the rest, pairs whose bitmaps differ in more bits than linked sets may are
   dropped; what is left is verified on the whole sets.
6. Components by alternating star contraction, on links only.

Pairs are made inside tasks, in pieces; only the few that pass the filters are
rows. Lists and bitmaps are bounded in size; no list is cut.

Defined cases: a null or wordless text has an empty set and is alone; fewer
words than ``words`` make one shingle; repeated rows are equal sets; rows of one
id with different texts count as one document; rows with a null id are alone,
their component is null; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.frames import column, only, released, slices, text_of, written
from gridwright.llm.shingles import shingle_sets
from gridwright.session import checkpoint

#: Bytes of text hashed at once, a longer text apart.
TEXT_RUN = 1 << 20
#: Largest number of bits in a parity bitmap.
MOST_BITS = 4096
#: Sets of a list that one task compares with each other; longer lists are split.
LIST_SETS = 4000
#: Sets of a list, by size and by what may follow, whose least and greatest values are compared before any pair of them is made.
BLOCK_SETS = 64
#: Pairs looked at together.
PAIR_RUN = 1 << 18


def may_miss(size: int, percent: int) -> int:
    """How many elements of a set may be missing from a linked one."""
    return size - -(-size * percent // 100)


def asked_for(size: int, percent: int) -> int:
    """How many of the lowest hashes a set of this size wants in common (``l``)."""
    return max(1, size // 10)


def class_bounds(percent: int, until: int = 1 << 40) -> np.ndarray:
    """Lowest sizes of the size classes: linked sets are in one class or in neighbouring ones."""
    bounds = [1]
    while bounds[-1] < until:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return np.array(bounds)


def bitmap_bits(size_class: int, bounds: np.ndarray) -> int:
    """Length of the parity bitmaps of a class, a power of two from 64 to ``MOST_BITS``, four times its sizes or more."""
    return int(min(MOST_BITS, max(64, 1 << (int(bounds[size_class]).bit_length() + 2))))


def parity(hashes: np.ndarray, bits: int) -> bytes:
    """Bit i tells whether an odd number of hashes fall on i: two bitmaps differ in no more bits than the sets in elements."""
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _summaries(docs: DataFrame, words: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """Per row: its number, id, set size, set key, size class, lowest hashes and bitmap."""
    bounds = class_bounds(percent)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_RUN):
                rows = []
                for hashes in shingle_sets(part.column("text"), words):
                    n = len(hashes)
                    size_class = int(np.searchsorted(bounds, n, side="right")) - 1
                    low = hashes[: may_miss(n, percent) + asked_for(n, percent)] if n else hashes
                    rows.append((
                        n, hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest() if n else None, size_class,
                        low.view(np.int64), parity(hashes, bitmap_bits(size_class, bounds)) if n else None))
                n, key, size_class, low, bits = zip(*rows)
                offsets = np.cumsum([0, *map(len, low)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(n, type=pa.int64()), pa.array(key, type=pa.string()),
                    pa.array(size_class, type=pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(low))), pa.array(bits, type=pa.binary()),
                ], ["doc_id", "n", "set_key", "size_class", "low", "bits"])

    rows = docs.select(column(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(summarise), f"doc_id {kind}, n long, set_key string, size_class int, low array<long>, bits binary").withColumn(
        "row", F.monotonically_increasing_id())  # fixed once the rows are written


def _index(low: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """List entries of the surviving sets: hash, id, size, size class, what may follow, ``l``, shared hashes, frequency."""
    tokens = low.select(F.col("doc_id").cast("long").alias("id"), F.explode("low").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    found = tokens.join(often, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("found"))
    n, shared = F.col("n"), F.size("found")

    def least(size: F.Column) -> F.Column:
        return F.greatest(F.lit(1), F.floor(size / 10))

    need = least(F.ceil(n * percent / 100))  # the least `l` of any set that may be linked
    return sets.select("id", "n", "size_class").join(found, "id").filter(shared >= need).select(
        "id", "n", "size_class", least(n).alias("l"), shared.alias("shared"),
        F.posexplode(F.slice("found", F.lit(1), F.greatest(F.lit(0), shared - need.cast("int") + 1))).alias("place", "entry"),
    ).select("id", "n", "size_class", "l", "shared", (F.col("shared") - F.col("place")).alias("rest"), "entry.token", "entry.df")


def _verified(docs_sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which the whole sets are linked."""
    left = docs_sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    right = docs_sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").filter(
        100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def _whole_sets(docs: DataFrame, ids: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """The whole sets of the documents in ``ids``, from their texts."""
    rows = only(docs.select(column(id_column).cast("long").alias("id"), text_of(text_column).alias("text")), checkpoint(ids), "id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_RUN):
                sets = [x.view(np.int64) for x in shingle_sets(part.column("text"), words)]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["id", "grams"])

    return written(rows.mapInArrow(released(hashed), "id long, grams array<long>"), "sets")


def _fold(bits: list[bytes], wide: int) -> np.ndarray:
    """Bitmaps of ``wide`` bits as rows of 64-bit words; longer ones are folded, which keeps parity."""
    out = np.empty((len(bits), wide // 64), dtype=np.uint64)
    sizes = np.array([len(b) * 8 for b in bits])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        rows = np.frombuffer(b"".join(bits[i] for i in at), dtype=np.uint64).reshape(len(at), -1, wide // 64)
        out[at] = np.bitwise_xor.reduce(rows, axis=1)
    return out


def _list_pairs(groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows in one group, in runs; ``groups`` is sorted."""
    count = len(groups)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ends = np.r_[starts[1:], count]
    end_of = np.repeat(ends, ends - starts)
    width = end_of - np.arange(count) - 1  # rows that follow in the group
    until = np.cumsum(width)
    row = 0
    while row < count:
        before = until[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(until, before + PAIR_RUN, side="right")))
        left = np.repeat(np.arange(row, stop), width[row:stop])
        if len(left):
            first = np.repeat(until[row:stop] - width[row:stop] - before, width[row:stop])
            yield left, left + 1 + np.arange(len(left)) - first
        row = stop


def _block_pairs(group: np.ndarray, x: dict[str, np.ndarray], to_first: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows in one group, in runs, without those of blocks whose bounds rule all their pairs out.

    Groups are in order and within each the sizes ``n`` are.
    """
    place = np.arange(len(group)) - np.searchsorted(group, group)
    starts = np.flatnonzero(place % BLOCK_SETS == 0)
    sizes = np.diff(np.r_[starts, len(group)])

    def least(values: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(values, starts)

    def most(values: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values, starts)

    n, n_most, rest, l, visitors = least(x["n"]), most(x["n"]), most(x["rest"]), least(x["l"]), least(x["visitor"])
    near, far, component = least(to_first), most(to_first), least(x["component"])
    alone = component == most(x["component"])

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.arange(len(starts)), np.arange(len(starts))
        yield from _list_pairs(group[starts])

    for a, b in blocks():
        open_ = (
            (100 * n_most[a] >= percent * n[b]) & ~(alone[a] & alone[b] & (component[a] == component[b])) & ~(visitors[a] & visitors[b])
            & (np.minimum(rest[a], rest[b]) >= np.minimum(l[a], l[b]))
            & (np.maximum(near[a], near[b]) - np.minimum(far[a], far[b]) <= (n_most[a] + n_most[b]) * (100 - percent) // (100 + percent))
        )
        a, b = a[open_], b[open_]
        step = max(1, PAIR_RUN // BLOCK_SETS**2)
        for k in range(0, len(a), step):
            one, two = a[k: k + step], b[k: k + step]
            made = sizes[one] * sizes[two]
            pair = np.repeat(np.arange(len(one)), made)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(made) - made, made)
            i, j = starts[one][pair] + at // sizes[two][pair], starts[two][pair] + at % sizes[two][pair]
            yield i[i < j], j[i < j]


def _compare(rows: pa.Table, percent: int, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of whole groups that no filter rules out, each run without repeats."""
    out, held = [], 0
    get = {c: rows.column(c).to_numpy() for c in ("token", "list_class", "block", "other", "id", "n", "rest", "l", "visitor", "side", "component")}
    keys = np.stack([get[c] for c in ("token", "list_class", "block", "other")])
    groups = np.cumsum(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) - 1
    bits = rows.column("bits").to_pylist()
    wide = np.array([bitmap_bits(max(0, c - 1), bounds) for c in get["list_class"]])
    for width in np.unique(wide):
        at = np.flatnonzero(wide == width)
        at = at[np.lexsort((get["rest"][at], get["n"][at], groups[at]))]
        x = {c: v[at] for c, v in get.items()}
        group = groups[at]
        maps = _fold([bits[i] for i in at], int(width))
        first = np.searchsorted(group, group)
        to_first = np.bitwise_count(maps ^ maps[first]).sum(axis=1).astype(np.int64)
        for i, j in _block_pairs(group, x, to_first, percent):
            low, high = np.minimum(x["n"][i], x["n"][j]), np.maximum(x["n"][i], x["n"][j])
            # of two linked sets no more elements than this differ
            allowed = (x["n"][i] + x["n"][j]) * (100 - percent) // (100 + percent)
            keep = (
                (100 * low >= percent * high) & (x["component"][i] != x["component"][j]) & ~(x["visitor"][i] & x["visitor"][j])
                & ((x["block"][i] == x["other"][i]) | (x["side"][i] != x["side"][j]))
                & (np.minimum(x["rest"][i], x["rest"][j]) >= np.minimum(x["l"][i], x["l"][j]))
                & (np.abs(to_first[i] - to_first[j]) <= allowed)
            )
            i, j, allowed = i[keep], j[keep], allowed[keep]
            step = max(1, (1 << 24) // int(width))
            for k in range(0, len(i), step):
                differ = np.bitwise_count(maps[i[k: k + step]] ^ maps[j[k: k + step]]).sum(axis=1)
                ok = differ <= allowed[k: k + step]
                a, b = x["id"][i[k: k + step][ok]], x["id"][j[k: k + step][ok]]
                out.append(np.column_stack([np.minimum(a, b), np.maximum(a, b)]))
                held += len(a)
                if held > PAIR_RUN:
                    yield np.unique(np.concatenate(out), axis=0)
                    out, held = [], 0
    if held:
        yield np.unique(np.concatenate(out), axis=0)


def _in_lists(entries: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of round two, each list compared in a task of its own (or several, by pairs of blocks)."""
    bounds = class_bounds(percent)
    parts = F.ceil(F.col("df") / LIST_SETS).cast("int")
    side = F.pmod(F.xxhash64("id"), parts).cast("int")
    spread = entries.withColumns({"side": side, "parts": parts}).withColumn("visitor", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "token", (F.col("size_class") + F.col("visitor").cast("int")).alias("list_class"),
        F.least("side", "with").alias("block"), F.greatest("side", "with").alias("other"),
        "id", "n", "rest", "l", "visitor", "side", "component", "bits")
    key = ["token", "list_class", "block", "other"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def last_key(batch: pa.RecordBatch, row: int) -> tuple:
            return tuple(batch.column(c)[row].as_py() for c in key)

        def pairs(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts:
                for found in _compare(pa.Table.from_batches(parts), percent, bounds):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            # whole groups only: the last group of a batch waits for the next
            start = batch.num_rows - 1
            same = np.ones(batch.num_rows, dtype=bool)
            for c in key:
                values = batch.column(c).to_numpy(zero_copy_only=False)
                same &= values == values[-1]
            start = int(np.argmax(same))
            if held and start == 0 and last_key(held[-1], held[-1].num_rows - 1) == last_key(batch, 0):
                held.append(batch)
                continue
            yield from pairs([*held, batch.slice(0, start)])
            held = [batch.slice(start)]
        yield from pairs(held)

    return spread.repartition(*key).sortWithinPartitions(*key).mapInArrow(released(compared), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every id in ``links`` (a, b).

    Alternating large and small stars: every round hangs all neighbours of a node
    below its smallest one, until each component is one star.
    """
    edges = checkpoint(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lowest, "u")
        small = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpoint(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def join(docs: DataFrame, words: int = 3, percent: int = 90, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row. Ids are integers."""
    summaries = written(_summaries(docs, words, percent, id_column, text_column), "summaries")
    full = summaries.filter("n > 0 AND doc_id IS NOT NULL")
    best = F.min(F.struct(F.col("doc_id").cast("long").alias("id"), "row"))
    sets = checkpoint(full.groupBy("set_key", "n", "size_class").agg(best.alias("best")).select(
        "set_key", "n", "size_class", "best.id", "best.row"))
    entries = written(_index(only(full, sets.select("row"), "row"), sets, percent), "entries")

    central = F.min(F.struct((-F.col("shared") / F.col("n")).alias("private"), "id"))
    pivots = entries.groupBy("token", "size_class").agg(central["id"].alias("pivot"), F.count("*").alias("sets"))
    near = entries.select("token", "size_class", "id", "n")
    stars = near.join(pivots.filter("sets > 1").drop("sets"), ["token", "size_class"]).filter("id <> pivot").select(
        F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    stars = checkpoint(stars)

    def linked(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        return checkpoint(_verified(_whole_sets(docs, ids, words, id_column, text_column), pairs, percent))

    first = linked(stars)
    known = components(first)
    named = entries.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # lists whose sets are all in one component are answered
    open_ = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    active = checkpoint(named.join(open_.select("token"), "token"))
    chosen = only(sets, checkpoint(active.select("id").distinct()), "id").select("id", "n", "row")
    maps = only(summaries.select("row", "bits"), chosen.select("row"), "row").join(chosen, "row").drop("row")
    second = linked(checkpoint(_in_lists(active.join(maps, ["id", "n"]), percent)))
    final = components(first.union(second))

    classes = sets.select("set_key", "id").join(final, "id", "left").select(
        "set_key", F.coalesce("component", "id").alias("component_id"))
    alone = summaries.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.join(classes, "set_key").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
