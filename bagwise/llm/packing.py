"""Packing documents into training windows by non-negative least squares.

Documents are tokenised and packed in blocks of bounded size, each by itself inside the task that reads
it, so nothing is shuffled and any number of tasks works alike. Whole windows of a document stand alone.
What is left of it is cut to a multiple of a unit, and a block's histogram of these lengths is covered by
combinations of up to four lengths that fill a window: repeat counts by non-negative least squares,
rounded down. Uncovered lengths and the ends below a unit are packed greedily, cut at window edges. A
block's last tokens become windows of powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import sys
import types
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bagwise.llm.common import table, text_batches, text_of
from bagwise.plans.scratch import stored

#: How byte-level BPE vocabularies of this family cut text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same where no white space follows white space; it needs no look-ahead and runs faster.
PLAIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
SPACE_RUN = re.compile(r"[\s\x1c-\x1f]{2}")
ROWS = 64


@dataclass(frozen=True)
class PackSettings:
    window: int = 1024
    #: Lengths are combined as multiples of this many tokens.
    unit: int = 64
    #: Parts of a combination at most.
    parts: int = 4
    #: Tokens of a block, and the id that ends a document.
    block: int = 2 << 20
    end: int = 0


class Encoder:
    """Ids of a byte-level BPE vocabulary in the ``tokenizers`` JSON format, special strings included."""

    def __init__(self, source: str):
        import tiktoken

        spec = json.loads(source)
        # The format writes bytes as printable characters: those that are not shift above 255.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.special = special
        self.make = lambda pieces: tiktoken.Encoding("bpe", pat_str=pieces, mergeable_ranks=ranks, special_tokens=special)
        self.plain = self.make(PLAIN_PIECES)

    @cached_property
    def full(self):
        return self.make(PIECES)

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            ids = self.full.encode(text, allowed_special="all")
        elif SPACE_RUN.search(text):
            ids = self.full.encode_ordinary(text)
        else:
            ids = self.plain.encode_ordinary(text)
        return np.frombuffer(array("I", ids), np.uint32)


def worker_encoder(source: str) -> Encoder:
    """One encoder per Python worker: building it costs more than many a task's texts."""
    kept = sys.modules.setdefault("_bagwise_worker", types.ModuleType("_bagwise_worker")).__dict__
    if kept.get("source") != source:
        kept.update(source=source, encoder=Encoder(source))
    return kept["encoder"]


def combinations(total: int, parts: int, most: int | None = None) -> Iterator[tuple[int, ...]]:
    """Descending whole numbers below the total, at most so many, that add up to it."""
    most = total - 1 if most is None else most
    if total == 0:
        yield ()
    elif parts:
        for first in range(min(most, total), 0, -1):
            for rest in combinations(total - first, parts - 1, first):
                yield (first, *rest)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative x with the least squares of a x - b, by an active set."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[1]):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-9 * (1 + abs(b).sum()):
            break
        free[best] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            below = free & (s <= 1e-12)
            if not below.any():
                break
            step = (x[below] / np.maximum(x[below] - s[below], 1e-300)).min()
            x += min(1.0, step) * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        x = s
    return x


def powers(n: int) -> list[int]:
    """Powers of two that add up to n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Packs documents block by block; every piece is (document, start, length, sequence, offset)."""

    def __init__(self, settings: PackSettings, first_sequence: int):
        self.s, self.sequence = settings, first_sequence
        self.units = settings.window // settings.unit
        self.patterns = [p for p in combinations(self.units, settings.parts) if len(p) > 1]
        self.matrix = np.zeros((self.units - 1, len(self.patterns)))
        for j, p in enumerate(self.patterns):
            for length in p:
                self.matrix[length - 1, j] += 1

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def pack(self, sizes: list[int]) -> list[tuple[int, int, int, int, int]]:
        w, unit = self.s.window, self.s.unit
        out, ends = [], []
        stacks: list[list[tuple[int, int]]] = [[] for _ in range(self.units)]
        for doc, size in enumerate(sizes):
            whole = size // w * w
            out += [(doc, at, w, self._next(), 0) for at in range(0, whole, w)]
            level, rest = divmod(size - whole, unit)
            if level:
                stacks[level].append((doc, whole))
            if rest:
                ends.append((doc, whole + level * unit, rest))
        counts = np.array([len(x) for x in stacks[1:]], float)
        if counts.any():
            for p, times in zip(self.patterns, np.floor(nnls(self.matrix, counts) + 1e-9).astype(int)):
                need = {n: p.count(n) for n in p}
                for _ in range(min(times, *[len(stacks[n]) // k for n, k in need.items()])):
                    sequence, offset = self._next(), 0
                    for n in p:
                        doc, start = stacks[n].pop()
                        out.append((doc, start, n * unit, sequence, offset))
                        offset += n * unit
        left = [(doc, start, n * unit) for n in range(self.units - 1, 0, -1) for doc, start in stacks[n]] + ends
        return out + self._greedy(left)

    def _greedy(self, left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Fill windows in turn, cutting at their edges; the last tokens go into powers of two."""
        total = sum(n for _, _, n in left)
        windows = [self.s.window] * (total // self.s.window) + powers(total % self.s.window)
        out, room, offset, sequence = [], 0, 0, -1
        sizes = iter(windows)
        for doc, start, n in left:
            while n:
                if not room:
                    room, offset, sequence = next(sizes), 0, self._next()
                take = min(n, room)
                out.append((doc, start, take, sequence, offset))
                start, n, room, offset = start + take, n - take, room - take, offset + take
        return out


def pack_documents(docs: DataFrame, tokenizer: str, settings: PackSettings = PackSettings()) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the path of the vocabulary; its content goes to the tasks. ``ids`` are the piece's
    ids as little-endian unsigned 32-bit numbers. Null text is empty and packs its end id alone. Repeated
    rows are packed each for itself; a null id stays null; other columns are not read. Sequence ids carry
    the task's number above 2^32, so they are unique, not consecutive.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(source)

    def flush(packer: Packer, held: list) -> Iterator[pa.RecordBatch]:
        pieces = packer.pack([len(ids) for _, ids in held])
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            columns = [np.array(c, np.int64) for c in zip(*part)]
            ids = [held[d][1][s : s + n].tobytes() for d, s, n, _, _ in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([held[d][0] for d in columns[0]], id_type),
                    pa.array(columns[1]),
                    pa.array(columns[2]),
                    pa.array(ids, pa.binary()),
                    pa.array([len(held[d][1]) for d in columns[0]], pa.int64()),
                    pa.array(columns[3]),
                    pa.array(columns[4]),
                ],
                NAMES,
            )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(sent.value)
        packer = Packer(settings, TaskContext.get().partitionId() << 32)
        end = np.array([settings.end], np.uint32)
        held, tokens = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("_text").to_pylist()):
                    ids = np.concatenate([encode(text), end])
                    held.append((doc_id, ids))
                    tokens += len(ids)
                    if tokens >= settings.block:
                        yield from flush(packer, held)
                        held, tokens = [], 0
        if held:
            yield from flush(packer, held)

    NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", text_of().alias("_text")).mapInArrow(packed, schema)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def packed_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces of all documents, each with a checksum in place of its ids; written when called."""
    with text_batches(docs.sparkSession):
        return stored(digests(pack_documents(docs, tokenizer)), "pieces")


def production_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"), production_tokenizer())
