"""Hierarchical packing into windows of several lengths.

A document is the ids of a public tokenizer followed by an end id. Windows have
the lengths ``tiers`` (powers of two, the longest is the context size):

1. Routing: a document gives as many full longest windows as it holds; what is
   left goes to the smallest tier that it fits in.
2. Packing: each tier is packed from its longest pieces down. A piece leaves a
   gap of less than half its window.
3. Gap filling: the gap takes the longest pieces of shorter tiers that fit; when
   none fits, the head of the longest shorter piece is cut off to fill it exactly.
4. Balance: windows of one tier are dealt into step groups of ``step_tokens``
   tokens each, so the ranks of a step carry equal tokens and equal windows.

Work is local to a task: it reads its rows once, tokenizes and packs them in
runs of about ``run_tokens`` tokens and keeps what a run leaves over for the
next, so there is no shuffle and memory is bounded by a run and the longest
document. What a task has left over at its end, less than one longest window
for each tier, is cut into windows of smaller powers of two, which need no
padding either. A window's id is the task's number times 2^33 plus its own.

Defined cases: a null text is an empty one, that is the end id alone; repeated
rows are packed each; extra columns are ignored; empty tables give no pieces.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridwright.llm.frames import column, ragged, released, slices, text_of

TIERS = (4096, 2048, 1024, 512, 256)
#: Distinct words whose ids a worker keeps.
WORD_CACHE = 400_000
#: Bytes of text tokenized at once, a longer text apart.
TEXT_RUN = 4 << 20


#: A small letter that always ends a token where a point or comma, the last of a word, follows.
_SIGNED = "[a-z\u00df-\u00f6\u00f8-\u00ff][.,]$"


class WordIds:
    """The ids of words, each tokenized once; a worker keeps them over its tasks.

    Word ``k`` has ``lengths[k]`` ids from ``starts[k]`` of ``flat``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, dtype=np.uint32)
        self.starts = np.empty(0, dtype=np.int64)
        self.lengths = np.empty(0, dtype=np.int64)

    def numbers(self, words: Sequence[str]) -> np.ndarray:
        """The number of each of some distinct words; new ones are tokenized."""
        found = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            made, sizes = [self.flat], []
            for at in range(0, len(fresh), 4000):  # what the tokenizer returns for a word is far larger than its ids
                ids = [x.ids for x in self.tokenizer.encode_batch_fast(fresh[at: at + 4000], add_special_tokens=False)]
                sizes += map(len, ids)
                made.append(np.fromiter(chain.from_iterable(ids), dtype=np.uint32))
            lengths = np.array(sizes, dtype=np.int64)
            found[new] = len(self.known) + np.arange(len(new))
            self.known.update(zip(fresh, found[new].tolist()))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate(made)
        return found


_WORDS: dict[str, WordIds] = {}


def token_ids(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, each text followed by ``end_id``, and where each text ends.

    The tokenizer puts everything in small letters, drops white space and lets
    nothing span it, so a text's ids are those of its words in turn. Every
    distinct word is tokenized once, without the point or comma that ends it.
    (Capitals stay where a text may hold a special token.)
    """
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    known = _WORDS[path]
    if len(known.known) > WORD_CACHE:
        known.clear()
    split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary
    signed = pc.match_substring_regex(words, _SIGNED)
    stems = pc.if_else(signed, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
    point = pc.ends_with(words, ".").to_numpy(zero_copy_only=False)
    stem = known.numbers(stems.dictionary.to_pylist())[stems.indices.to_numpy(zero_copy_only=False)]
    sign = known.numbers(["", ".", ","])[np.where(signed.to_numpy(zero_copy_only=False), np.where(point, 1, 2), 0)]
    use = coded.indices.to_numpy(zero_copy_only=False)
    parts = np.column_stack([stem[use], sign[use]]).ravel()  # each word, then its sign
    sizes = known.lengths[parts]
    ids = ragged(known.flat, known.starts[parts], sizes)
    reached = np.concatenate([[0], np.cumsum(sizes)])
    ends = reached[2 * np.cumsum(counts)]
    return np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)


@dataclass(order=True)
class Piece:
    """``length`` ids from ``start`` of a document."""

    length: int
    start: int
    doc: object = field(compare=False)
    ids: np.ndarray = field(compare=False, repr=False)
    doc_tokens: int = field(compare=False)

    def cut(self, length: int) -> tuple[Piece, Piece]:
        rest = Piece(self.length - length, self.start + length, self.doc, self.ids[length:], self.doc_tokens)
        return Piece(length, self.start, self.doc, self.ids[:length], self.doc_tokens), rest


class Packer:
    """Pieces by tier, and the windows made of them."""

    def __init__(self, tiers: Sequence[int]):
        self.tiers = sorted(tiers, reverse=True)
        self.pools: dict[int, list[Piece]] = {t: [] for t in self.tiers}
        self.tokens = 0

    def add(self, piece: Piece) -> Iterator[tuple[int, list[Piece]]]:
        """Route a document; its full longest windows come out at once."""
        longest = self.tiers[0]
        while piece.length > longest:
            head, piece = piece.cut(longest)
            yield longest, [head]
        self._put(piece)

    def _put(self, piece: Piece) -> None:
        insort(self.pools[min(t for t in self.tiers if t >= piece.length)], piece)
        self.tokens += piece.length

    def _fill(self, gap: int, below: Sequence[int]) -> Piece | None:
        """The longest piece of the tiers ``below`` that fits, or a head cut off to size."""
        for tier in below:
            pool = self.pools[tier]
            at = bisect_right(pool, gap, key=lambda p: p.length)
            if at:
                piece = pool.pop(at - 1)
                self.tokens -= piece.length
                return piece
        for tier in below:
            if self.pools[tier]:
                piece = self.pools[tier].pop()
                self.tokens -= piece.length
                head, rest = piece.cut(gap)
                self._put(rest)
                return head
        return None

    def pack(self) -> Iterator[tuple[int, list[Piece]]]:
        """All windows that can be filled; the rest stays for the next run."""
        for k, tier in enumerate(self.tiers):
            held: list[Piece] = []
            while self.pools[tier]:
                window = [self.pools[tier].pop()]
                self.tokens -= window[0].length
                gap = tier - window[0].length
                while gap:
                    # the shortest tier has none below it, so it fills its gaps from itself
                    piece = self._fill(gap, self.tiers[k + 1:] or [tier])
                    if piece is None:
                        break
                    window.append(piece)
                    gap -= piece.length
                if gap:
                    held += window
                    break
                yield tier, window
            for piece in held:
                self._put(piece)
            if held and k + 1 < len(self.tiers):
                return  # no shorter piece is left, so no shorter tier has any

    def rest(self) -> Iterator[tuple[int, list[Piece]]]:
        """At the end of a task: what is left, in windows that are powers of two."""
        left = [p for t in self.tiers for p in reversed(self.pools[t])]
        while left:
            size = min(self.tiers[0], 1 << (sum(p.length for p in left).bit_length() - 1))
            window, gap = [], size
            while gap:
                piece = left.pop(0)
                if piece.length > gap:
                    piece, over = piece.cut(gap)
                    left.insert(0, over)
                window.append(piece)
                gap -= piece.length
            yield size, window


def pack(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
    end_id: int = 2, tiers: Sequence[int] = TIERS, run_tokens: int = 1 << 19, step_tokens: int = 1 << 16,
    with_ids: bool = False, keep_words: bool = True,
) -> DataFrame:
    """One row per piece: document, place in it, window, place in that, window length, step group.

    A worker keeps the words it knows for its next task; without ``keep_words``
    it lets go of them, for jobs whose workers go on to other stages.
    ``with_ids`` adds the ids themselves (``ids``); ``ids_crc32`` is the crc32 of
    them as little-endian unsigned 32-bit numbers.
    """
    if any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        packer, windows, steps = Packer(tiers), 0, 0
        groups: dict[int, tuple[int, int]] = {}  # per tier the step group being filled, and the tokens in it
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id"]
        doc_type = None

        def rows(made: Iterator[tuple[int, list[Piece]]]) -> Iterator[pa.RecordBatch]:
            nonlocal windows, steps
            out: list[tuple] = []
            ids: list[np.ndarray] = []
            for tier, window in made:
                offset = 0
                number, filled = groups.get(tier, (0, step_tokens))
                if filled + tier > step_tokens:
                    number, filled, steps = steps, 0, steps + 1
                groups[tier] = (number, filled + tier)
                for p in window:
                    out.append((p.doc, p.start, p.length, zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens,
                                base + windows, offset, tier, base + number))
                    if with_ids:
                        ids.append(p.ids)
                    offset += p.length
                windows += 1
            if out:
                cells = [list(x) for x in zip(*out)]
                arrays = [pa.array(cells[0], type=doc_type), *(pa.array(x, type=pa.int64()) for x in cells[1:])]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in ids], type=pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, [*names, "ids"][: len(arrays)])

        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for part in slices(batch, "text", TEXT_RUN):
                ids, ends = token_ids(part.column("text"), tokenizer_path, end_id)
                start = 0
                for doc, end in zip(part.column("doc_id").to_pylist(), ends.tolist()):
                    # a copy, so that a short piece doesn't keep the whole run's ids
                    mine = ids[start:end].astype(np.uint32)
                    yield from rows(packer.add(Piece(end - start, 0, doc, mine, end - start)))
                    start = end
                    if packer.tokens >= run_tokens:
                        yield from rows(packer.pack())
        yield from rows(packer.pack())
        yield from rows(packer.rest())
        if not keep_words:
            _WORDS.pop(tokenizer_path, None)

    rows = docs.select(column(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(packed), (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "tier long, step_id long" + ", ids array<int>" * with_ids))
