"""Hierarchical packing of documents into sequences of several lengths.

A document's ids that fill whole windows of the longest length become sequences of their own.  The rest is routed to
the tier of the shortest length that holds it.  Each tier is packed into windows of its own length, the longest tier
first: a rest of the tier, which takes more than half of its window, opens it; the gap is filled from shorter tiers,
best fit first, and at last by the head of a shorter rest, whose tail goes back to its tier.  So every sequence is full.
What a task has left at its end fills windows of shorter lengths, which are powers of two, so that nothing is padded.
The sequences of each length are dealt to step groups in serpentine order of their cost (sum of squared piece lengths),
so that a group has one length, and groups of one length equal tokens and about equal time.

Each task packs the rows of its own input partition in bounded blocks, so nothing is shuffled and a lost task gives
the same sequences again, as long as its partition has the same rows in the same order (files, or a checkpoint).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 4096
#: Shorter tiers, longest first.
TIERS = (2048, 1024, 512, 256)
#: A block of rests is packed when it holds so many ids, and a step group takes so many ids.
BLOCK_IDS = 1 << 20
STEP_IDS = 1 << 18
#: Entries of each of a worker's two caches and the longest chunk in them.
CACHE_SIZE = 200_000
CACHE_CHARS = 100
END_ID = 2

SCHEMA = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long, ids binary"

_loaded: dict = {}


#: Chunks of these characters alone (printable ASCII and the letters of Latin-1) are split by SPLIT after lower-casing,
#: as the tokenizer's own pattern does; any other chunk goes through the whole tokenizer.
SIMPLE = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class ChunkEncoder:
    """A text's ids as little-endian 32-bit numbers, joined from its chunks between spaces and line ends.

    Right for tokenizers that drop white space and split at it before their merges, as the given one (checked); others
    encode texts whole.  The first chunks and words are kept, until most of the later ones are others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.apart = (
            [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and steps[0]["pattern"] == {"Regex": PATTERN}
            and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and normal == ["NFC", "Replace", "Lowercase"]
            and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
        )
        self.letters = byte_letters()
        self.chunks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        self.missed = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            spelt = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()
            if len(self.words) < CACHE_SIZE and len(word) <= CACHE_CHARS:
                self.words[word] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        found = b"".join(map(self.word, SPLIT(chunk.lower()))) if SIMPLE(chunk) and "<|" not in chunk else self.whole(chunk)
        if len(self.chunks) < CACHE_SIZE and len(chunk) <= CACHE_CHARS:
            self.chunks[chunk] = found
        self.missed += 1
        return found

    def encode(self, text: str) -> bytes:
        if not self.apart:
            return self.whole(text)
        if self.missed > 8 * CACHE_SIZE:  # the texts have changed
            self.chunks, self.words, self.missed = {"": b""}, {}, 0
        chunks = text.replace("\n", " ").split(" ")
        found = list(map(self.chunks.get, chunks))
        if None in found:
            found = [self.chunk(c) if x is None else x for c, x in zip(chunks, found, strict=True)]
        return b"".join(found)


def encoder(path: str) -> ChunkEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]


class Packer:
    """Packs rests ``(length, doc, start, total, ids)`` into sequences, each a list of such pieces.

    The pools are lists sorted by length, one a tier; ``total`` is the document's number of ids.
    """

    def __init__(self, window: int = WINDOW, tiers: tuple[int, ...] = TIERS):
        self.window, self.tiers = window, (window, *tiers)
        self.pools: dict[int, list] = {t: [] for t in self.tiers}
        self.held, self.serial = 0, 0

    def route(self, rest: tuple) -> None:
        self.serial += 1  # rests of one length leave in the order in which they came
        insort(self.pools[min(t for t in self.tiers if t >= rest[0])], (rest[0], -self.serial, *rest[1:]))
        self.held += rest[0]

    def take(self, room: int) -> tuple | None:
        """The longest rest that fits into ``room``."""
        for tier in self.tiers:
            pool = self.pools[tier]
            if pool and pool[0][0] <= room:
                found = pool.pop(bisect_right(pool, room, key=lambda x: x[0]) - 1)
                self.held -= found[0]
                return (found[0], *found[2:])
        return None

    def cut(self, room: int) -> tuple | None:
        """The first ``room`` ids of a rest of the shortest tier whose rests are longer; the others go back."""
        for tier in reversed(self.tiers):
            pool = self.pools[tier]
            if pool and pool[-1][0] > room:
                length, _, doc, start, total, ids = pool.pop()
                self.held -= length
                self.route((length - room, doc, start + room, total, ids[4 * room :]))
                return (room, doc, start, total, ids[: 4 * room])
        return None

    def open(self, tier: int) -> tuple:
        """The longest rest of a tier."""
        found = self.pools[tier].pop()
        self.held -= found[0]
        return (found[0], *found[2:])

    def fill(self, size: int, first: tuple | None = None) -> list[tuple]:
        """One full sequence; needs ``size`` ids, held or in ``first``."""
        out = [first] if first else []
        room = size - sum(p[0] for p in out)
        while room:
            piece = self.take(room) or self.cut(room)
            out.append(piece)
            room -= piece[0]
        return out

    def add(self, doc, ids: bytes) -> Iterator[list[tuple]]:
        total = len(ids) // 4
        whole = total // self.window * self.window
        for at in range(0, whole, self.window):
            yield [(self.window, doc, at, total, ids[4 * at : 4 * (at + self.window)])]
        if total > whole:
            self.route((total - whole, doc, whole, total, ids[4 * whole :]))

    def block(self) -> Iterator[list[tuple]]:
        """Each tier's windows, as long as there are ids to fill them."""
        for tier in self.tiers:
            while self.pools[tier] and self.held >= tier:
                yield self.fill(tier, self.open(tier))

    def end(self) -> Iterator[list[tuple]]:
        """Everything left: the tiers' windows, then windows of the powers of two that sum to the rest."""
        yield from self.block()
        size = self.window
        while self.held:
            if self.held >= size:
                yield self.fill(size)
            size //= 2


def groups_of(sequences: list[list[tuple]], n_groups: int) -> list[int]:
    """Step groups by serpentine dealing in falling order of cost."""
    cost = [sum(p[0] ** 2 for p in s) for s in sequences]
    out = [0] * len(sequences)
    for rank, k in enumerate(sorted(range(len(sequences)), key=lambda k: (-cost[k], k))):
        turn, place = divmod(rank, n_groups)
        out[k] = n_groups - 1 - place if turn % 2 else place
    return out


def pack(docs: DataFrame, tokenizer: str, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length,
    step_group, ids (little-endian 32-bit; null unless ``with_ids``).

    A null text counts as an empty one: its only id is the end.  Repeated rows are packed each; the pieces of very long
    texts lie in many sequences.  An empty table has no sequences.  Other columns are not read.  sequence_id and
    step_group count from the input partition's number times 2**40.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packer = encoder(tokenizer), Packer(window, tiers)
        base = TaskContext.get().partitionId() << 40
        end = np.array([END_ID], dtype="<u4").tobytes()
        state = {"sequence": 0, "group": 0, "ids": 0}
        waiting: list[list[tuple]] = []
        schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")], ("ids", pa.binary())])

        def flush() -> pa.RecordBatch:
            rows: list[tuple] = []
            sizes = [sum(p[0] for p in s) for s in waiting]
            for size in sorted(set(sizes), reverse=True):
                alike = [s for s, n in zip(waiting, sizes, strict=True) if n == size]
                n_groups = max(1, len(alike) * size // STEP_IDS)
                for s, group in zip(alike, groups_of(alike, n_groups), strict=True):
                    at = 0
                    for length, doc, start, total, ids in s:
                        rows.append((doc, start, length, zlib.crc32(ids), total, base + state["sequence"], at, size, base + state["group"] + group, ids if with_ids else None))
                        at += length
                    state["sequence"] += 1
                state["group"] += n_groups
            state["ids"] = packer.held
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            schema = schema.set(0, pa.field("doc_id", batch.schema.field(0).type))
            for i in range(batch.num_rows):
                ids = code.encode(batch.column(1)[i].as_py() or "") + end
                state["ids"] += len(ids) // 4
                waiting.extend(packer.add(batch.column(0)[i].as_py(), ids))
                if packer.held >= BLOCK_IDS:
                    waiting.extend(packer.block())
                if state["ids"] - packer.held >= 2 * BLOCK_IDS:
                    yield flush()
        waiting.extend(packer.end())
        if waiting:
            yield flush()

    return docs.select(doc_id, text).mapInArrow(run, SCHEMA.format(kind=kind))
