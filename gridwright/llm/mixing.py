"""Mixing sources to target weights by blocks.

1. Targets: sources in code-point order, null last, weigh ``weights`` in turn and
   share ``total_share`` of all words; a target above ``repeat_limit`` times its
   source stops there and the excess is shared anew by weight.
2. Blocks: the words of a source, document after document, are cut into blocks
   of ``block_words``. A document's place is the sum of the sizes before it,
   taken in two levels (hash buckets of documents, then the buckets), so no task
   holds a source.
3. Shards: the mix is a sequence of slots, ``shard_blocks`` to an output shard.
   For every shard a multinomial draw says how many slots each source gets.
4. Slots: a source's slots, numbered over the shards, are mapped through
   pseudorandom permutations of its blocks, one permutation for each pass over
   the source. So a block never comes again before all others have come. Draws
   beyond a source's quota pass their slots to sources below theirs; the quotas
   are met to the slot.
5. Slots and documents meet in a join by source and block.

Everything follows from the ids, sizes and ``seed``; reruns agree. One row per
source is held on the driver (``max_sources`` at most, else an error).

Defined cases: a null text has size 0 and is never taken, an empty one as well;
a null source is a source of its own; identical rows are laid out one after the
other as separate documents; rows of one id with other texts are separate
documents; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.frames import WORD, column, map_columns, released, text_of
from gridwright.session import checkpoint

#: Slots that one task maps to blocks.
SLOTS_PER_TASK = 250_000
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def share_out(sizes: Sequence[int], weights: Sequence[float], total: float, limit: float) -> list[float]:
    """Targets by weight, none above ``limit`` times its size; the excess goes to the others by weight."""
    targets = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0]
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > limit * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(limit * sizes[i])
        left -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def permuted(index: np.ndarray, size: int, key: Sequence[int]) -> np.ndarray:
    """The places of ``index`` under a keyed pseudorandom permutation of ``range(size)``.

    A four-round Feistel network over the next even number of bits; what falls
    outside the range goes through it again.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.SeedSequence([int(k) for k in key]).generate_state(4, dtype=np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> np.uint64(half), out[todo] & mask
            for k in keys:
                mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, (left ^ (mixed >> np.uint64(32))) & mask
            out[todo] = (left << np.uint64(half)) | right
            todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Mix:
    """``documents``: each with its number of source, its place there and its row key.
    ``slots``: source number, block and pass of every slot. ``sources``: size and target by source."""

    documents: DataFrame
    slots: DataFrame
    sources: list[dict]
    block_words: int


def _row_key(id_column: str, source_column: str, text: Column) -> Column:
    return F.xxhash64(column(id_column), column(source_column), text)


def plan(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total_share: float = 1.5, repeat_limit: int = 2,
    block_words: int = 128, shard_blocks: int = 4096, seed: int = 7, id_column: str = "doc_id",
    text_column: str = "text", source_column: str = "source", bucket_rows: int = 4_000, max_sources: int = 100_000,
) -> Mix:
    spark = docs.sparkSession
    text = text_of(text_column)
    sized = checkpoint(docs.select(
        column(id_column).alias("doc_id"), column(source_column).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), _row_key(id_column, source_column, text).alias("row_key"),
    ).groupBy("doc_id", "source", "size", "row_key").agg(F.count("*").alias("copies")))
    found = sized.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("size"), F.count("*").alias("rows"),
    ).orderBy(F.asc_nulls_last("source")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = [r["size"] for r in found]
    targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(found))], total_share * sum(sizes), repeat_limit)
    blocks = [-(-n // block_words) for n in sizes]
    quotas = [min(repeat_limit * b, round(t * b / n)) if n else 0 for n, t, b in zip(sizes, targets, blocks)]
    sources = [
        {"number": i, "source": r["source"], "size": n, "target": t, "blocks": b, "quota": q}
        for i, (r, n, t, b, q) in enumerate(zip(found, sizes, targets, blocks, quotas))
    ]
    numbered = spark.createDataFrame(
        [(s["number"], s["source"]) for s in sources], "number int, source string")

    # places: sums inside hash buckets, then over the buckets of a source
    buckets = max(1, sum(r["rows"] for r in found) // bucket_rows)
    at = sized.withColumnRenamed("source", "name").join(
        F.broadcast(numbered), F.col("name").eqNullSafe(F.col("source"))).drop("name", "source").withColumn(
        "bucket", F.pmod("row_key", F.lit(buckets)))
    inside = Window.partitionBy("number", "bucket").orderBy("doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("copies")
    bases = at.groupBy("number", "bucket").agg(F.sum(words).alias("words")).select(
        "number", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("base"))
    placed = at.withColumn("before", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(bases, ["number", "bucket"]).select(
        "doc_id", "number", "size", "row_key",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), (F.col("base") + F.col("before")).alias("first"),
    ).select("doc_id", "number", "size", "row_key", "copy", (F.col("first") + F.col("copy") * F.col("size")).alias("start"))

    slots = _slots(docs, sources, shard_blocks, seed)
    return Mix(placed, slots, sources, block_words)


def _slots(docs: DataFrame, sources: list[dict], shard_blocks: int, seed: int) -> DataFrame:
    """Source number, pass and block of each slot."""
    spark = docs.sparkSession
    quotas = np.array([s["quota"] for s in sources], dtype=np.int64)
    blocks = np.array([s["blocks"] for s in sources], dtype=np.int64)
    total = int(quotas.sum())
    shards = -(-total // shard_blocks)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                wanted = min(shard_blocks, total - shard * shard_blocks)
                counts = np.random.default_rng([seed, shard]).multinomial(wanted, quotas / total)
                use = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(use), shard)), pa.array(use), pa.array(counts[use])], ["shard", "number", "slots"])

    drawn = checkpoint(spark.range(shards).mapInArrow(released(draw), "shard long, number long, slots long"))
    got = np.zeros(len(sources), dtype=np.int64)
    for r in drawn.groupBy("number").agg(F.sum("slots").alias("slots")).collect():  # one row a source
        got[r["number"]] = r["slots"]
    surplus, short = np.maximum(got - quotas, 0), np.maximum(quotas - got, 0)
    surplus_before, short_until = np.cumsum(surplus) - surplus, np.cumsum(short)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, before, count in zip(*(c.to_pylist() for c in batch.columns)):
                index = np.arange(before, before + count)
                owner = np.full(count, number)
                extra = np.flatnonzero(index >= quotas[number])
                rank = surplus_before[number] + index[extra] - quotas[number]
                owner[extra] = np.searchsorted(short_until, rank, side="right")
                to = owner[extra]
                index[extra] = got[to] + rank - (short_until[to] - short[to])
                turn = index // blocks[owner]
                place = np.empty(count, dtype=np.int64)
                for source, visit in set(zip(owner.tolist(), turn.tolist())):
                    here = (owner == source) & (turn == visit)
                    place[here] = permuted(index[here] % blocks[source], int(blocks[source]), (seed, source, visit))
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(turn), pa.array(place)], ["number", "turn", "block"])

    sofar = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return drawn.select(
        "number", F.coalesce(F.sum("slots").over(sofar), F.lit(0)).alias("before"), "slots",
    ).repartition(max(1, total // SLOTS_PER_TASK), "number", "before").mapInArrow(released(mapped), "number long, turn long, block long")


def _on_blocks(mix: Mix) -> DataFrame:
    """Documents with words, once for each block that they reach into: the words of the document in it."""
    size, start, wide = F.col("size"), F.col("start"), F.lit(mix.block_words)
    until = start + size
    return mix.documents.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(start / wide), F.floor((until - 1) / wide)))).withColumn(
        "from_word", F.greatest(F.lit(0).cast("long"), F.col("block") * wide - start)).withColumn(
        "to_word", F.least(size, (F.col("block") + 1) * wide - start))


def taken(mix: Mix) -> DataFrame:
    """Per document: ``doc_id``, ``size``, its source's ``source_size`` and ``target``, and the words ``taken``."""
    spark = mix.documents.sparkSession
    counts = mix.slots.groupBy("number", "block").agg(F.count("*").alias("visits"))
    # counts grow with the input whatever their plan's estimate says: never a broadcast
    parts = _on_blocks(mix).join(counts.hint("merge"), ["number", "block"]).select(
        "doc_id", "number", "size", "row_key", "copy", "start", ((F.col("to_word") - F.col("from_word")) * F.col("visits")).alias("words"))
    none = mix.documents.select("doc_id", "number", "size", "row_key", "copy", "start", F.lit(0).cast("long").alias("words"))
    facts = spark.createDataFrame(
        [(s["number"], s["source"], s["size"], s["target"]) for s in mix.sources],
        "number long, source string, source_size long, target double")
    return parts.unionByName(none).groupBy("doc_id", "number", "size", "row_key", "copy", "start").agg(
        F.sum("words").alias("taken")).join(F.broadcast(facts), "number").select(
        "doc_id", "size", "source_size", "target", "taken", "source")


def texts(
    docs: DataFrame, mix: Mix, keep: Sequence[str], id_column: str = "doc_id", text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """The mixed texts: a row for each document and pass, with the words that this pass takes of it.

    A document that a pass takes whole keeps its text as it is; of others, the
    runs of words taken stand one below the other. ``keep`` are the columns to
    return, the text column among them.
    """
    key = ["row_key", "doc_id"]
    runs = _on_blocks(mix).join(mix.slots.hint("merge"), ["number", "block"]).groupBy(*key, "copy", "turn", "size").agg(
        F.array_sort(F.collect_list(F.struct("from_word", "to_word"))).alias("runs"))
    runs = runs.groupBy(*key, "size").agg(F.collect_list("runs").alias("visits"))
    rows = docs.withColumns({
        " key": _row_key(id_column, source_column, text_of(text_column)), " id": column(id_column),
    }).dropDuplicates([" key", " id"]).select(" key", " id", F.struct(*[column(c) for c in keep]).alias("kept"))
    both = rows.join(runs.hint("merge"), (rows[" key"] == runs["row_key"]) & rows[" id"].eqNullSafe(runs["doc_id"]))
    part = both.select("kept", "size", F.explode("visits").alias("runs")).select("kept.*", "size", "runs")
    place = list(keep).index(text_column)

    def cut(columns: list[pa.Array]) -> list[pa.Array]:
        out = []
        for text, size, runs in zip(*(columns[i].to_pylist() for i in (place, len(keep), len(keep) + 1))):
            joined: list[list[int]] = []
            for run in runs:
                if joined and joined[-1][1] == run["from_word"]:
                    joined[-1][1] = run["to_word"]
                else:
                    joined.append([run["from_word"], run["to_word"]])
            if joined != [[0, size]]:
                spans = [m.span() for m in _WORDS.finditer(text)]
                text = "\n".join(text[spans[a][0]: spans[b - 1][1]] for a, b in joined)
            out.append(text)
        columns = list(columns[: len(keep)])
        columns[place] = pa.array(out, type=columns[place].type)
        return columns

    return map_columns(part, cut, docs.select(*[column(c) for c in keep]).schema)
