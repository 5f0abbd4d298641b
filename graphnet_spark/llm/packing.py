"""Best-fit packing of tokenised documents into sequences.

Documents become token pieces (only those longer than a sequence are cut), and pieces go to bins that have three
capacities: tokens, documents and attention cost (the sum of squared lengths). Within a block of pieces, longest
first, the open bin with the best score among those that keep every constraint is chosen: the weighted dot product of
the piece with the bin's residual capacities, or the smallest residual norm. Blocks are hash partitions of bounded
size, packed in parallel, many to a partition where there are very many; only lengths and keys are shuffled, never tokens.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, map_texts, stored, table

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END_ID = 2048, 0
#: Pieces of one block, which leaves less than one sequence's worth of room on the whole, and partitions at most.
BLOCK, PARTITIONS = 8192, 10_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Ids:
    """Token ids as little-endian unsigned 32-bit bytes.

    The library of ranks gives the same ids as the JSON vocabulary, several times faster; texts that may hold the string of a
    special token go through the JSON vocabulary itself.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers as P
        import tiktoken

        pairs = map(bytes.split, open(P.path(f"{vocabulary}.tiktoken"), "rb"))
        self.plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.json, self.full = P.path(f"{vocabulary}.json"), None

    def __call__(self, text: str) -> bytes:
        if "<|" not in text:
            return np.asarray(self.plain.encode_ordinary(text), "<u4").tobytes()
        from tokenizers import Tokenizer

        self.full = self.full or Tokenizer.from_file(self.json)
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def token_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; the first piece of a cut document may be shorter."""
    made: list[Ids] = []

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Ids(vocabulary))
        out: list[tuple] = []
        end = np.asarray([END_ID], "<u4").tobytes()
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = made[0](text.as_py() or "") + end
            n, at, k = len(ids) // 4, 0, 0
            while at < n:
                length = (n - 1) % capacity + 1 if k == 0 else capacity
                out.append((doc, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                at, k = at + length, k + 1
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows, PIECES)


def vector_best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: int, rule: str = "dot", weights=(1.0, 1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (all at most capacity), longest first; equal lengths in the given order.

    Each bin has what is left of tokens, documents and attention cost, as shares of the capacities. Among the bins in which
    a piece fits under all three, "dot" takes the one with the least weighted dot product of piece and residual, i.e. the
    one that is fullest where the piece is large, and "norm" the one with the least weighted norm of residual minus piece.
    """
    n, limits = len(lengths), np.array([capacity, max_docs, max_cost], float)
    w, left = np.asarray(weights, float), np.empty((n, 3))
    where, offset, used = np.empty(n, np.int64), np.empty(n, np.int64), 0
    live = np.empty(0, np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1, float(lengths[i]) ** 2])
        best = -1
        if len(live):
            room = left[live]
            fits = (room >= need).all(1)
            if fits.any():
                open_bins, room = live[fits], room[fits] / limits
                score = room @ (w * need / limits) if rule == "dot" else (w * (room - need / limits) ** 2).sum(1)
                best = open_bins[np.argmin(score)]
        if best < 0:
            best, used = used, used + 1
            left[best] = limits
            live = np.append(live, best)
        where[i], offset[i] = best, capacity - left[best, 0]
        left[best] -= need
        if left[best, 0] < 1 or left[best, 1] < 1:
            live = live[live != best]
    return where, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, rule: str = "dot", weights=(1.0, 1.0, 1.0)) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32). A full piece is a sequence of its own.

    Without max_docs or max_cost those capacities are the largest that a sequence of this many tokens can need.
    """
    docs_limit, cost_limit = max_docs or capacity, max_cost or capacity * capacity
    blocks = min(PARTITIONS, max(1, -(-pieces.filter(F.col("length") < capacity).count() // BLOCK)))
    names = [*pieces.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        rest: list[pa.RecordBatch] = []

        def place(part: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal base
            where, offset = vector_best_fit(part.column("length").to_numpy(), capacity, docs_limit, cost_limit, rule, weights)
            cols = [*part.columns, pa.chunked_array([where + base]), pa.chunked_array([offset])]
            base += int(where.max()) + 1
            yield from pa.Table.from_arrays(cols, names=names).to_batches()

        for batch in batches:
            rest.append(batch)
            if sum(b.num_rows for b in rest) >= 2 * BLOCK:
                held = pa.Table.from_batches(rest)
                yield from place(held.slice(0, BLOCK))
                rest = held.slice(BLOCK).to_batches()
        if rest:
            yield from place(pa.Table.from_batches(rest))

    schema = extended(pieces.schema, "sequence_id long, offset long")
    spread = pieces.repartition(blocks, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions("doc_id", "piece", "ids_crc32")
    return spread.mapInArrow(run, schema)


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of all documents.

    A null text is empty and holds the end id alone; repeated rows are packed as often as they occur; an empty table
    gives no rows; other columns are ignored. Very long texts are encoded in whole and cut. Of equal lengths, the smaller
    doc_id and piece is placed first; of equal scores, the sequence that was opened first is taken. The document and attention capacities are the largest that can be needed:
    they only weigh in the choice of a sequence and never turn a piece away that has room in tokens.
    """
    return pack(stored(token_pieces(table(spark, sf_dir, "documents")), "pieces"))


ORACLE: dict[str, str] = {}
