"""Cross-tokenizer alignment by segment deduplication.

A text is split before its runs of white space that begin with a blank, where neither vocabulary holds a token that joins
a blank to the character before it, so that no merge crosses the split. Blocks of whole texts are coded as numbers of their
distinct segments; distinct segments of all blocks are tokenised and aligned once, in chunks, and their alignments are joined
back to the blocks, where documents are composed from codes. Pairs of ids are counted by chunk before they are shuffled, and
their corpus-wide counts come back to chunks in the same way. Texts are read once and never shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, slices, stored, table

VOCABULARIES = ("byte_bpe_50k", "piece_bpe_32k.model")
#: UTF-8 bytes of one block's texts; a longer text is a block of its own.
BLOCK = 32 << 20
BLANK = "▁"
#: White space other than the blank, in a sense at least as wide as either tokenizer's.
OTHER_SPACE = [c for c in map(chr, range(1, 0x3001)) if c.isspace() and c != " "]
#: Places of segments in one chunk.
CHUNK = 1 << 19
CHUNK_NAMES = ["chunk", "a_id", "b_id", "n", "blocks", "at", "codes", "which", "n_a", "n_b", "n_groups", "a", "b", "groups"]
CHUNK_SCHEMA = "chunk long, a_id int, b_id int, n long, blocks array<long>, " + ", ".join(f"{c} binary" for c in CHUNK_NAMES[5:])
STATS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Vocabularies:
    """Both tokenizers, with the length in bytes of every token, and the characters after which a blank may be merged."""

    def __init__(self, a: str = VOCABULARIES[0], b: str = VOCABULARIES[1]):
        import public_tokenizers as P
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(x): int(n) for x, n in map(bytes.split, open(P.path(f"{a}.tiktoken"), "rb"))}
        self.a = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=P.path(b))
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.a_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for x, n in ranks.items():
            self.a_bytes[n] = len(x)
        self.b_bytes = np.array([1 if self.b.is_byte(k) else len(p.replace(BLANK, " ").encode()) for k, p in enumerate(pieces)], np.int64)
        inside = [p for k, p in enumerate(pieces) if not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k))]
        inside += [x.decode("utf-8", "replace").replace(" ", BLANK) for x in ranks]
        self.joins = {x for p in inside for x, y in zip(p, p[1:], strict=False) if y == BLANK and x != BLANK and not x.isspace()}
        self.before = [x + " " for x in [*OTHER_SPACE, *sorted(self.joins)]]

    def faithful(self, text: str) -> bool:
        """Whether a blank and the text are what the second tokenizer's pieces spell; the first one loses nothing."""
        return bool(text) and BLANK not in text and self.b.normalize(text) == BLANK + text.replace(" ", BLANK)

    def segments(self, text: str) -> list[str]:
        """The segments of a blank and the text, each without its first blank."""
        parts = text.split(" ")
        if not (text[:1] == " " or text[-1:].isspace() or "  " in text or any(x in text for x in self.before)):
            return parts
        out, held = [], parts[:1]
        for part in parts[1:]:
            last = held[-1][-1:]
            if last and not last.isspace() and last not in self.joins:
                out.append(" ".join(held))
                held = []
            held.append(part)
        rest = " ".join(held)
        if out and not rest.strip():  # blanks that end the text belong to what is before them
            out[-1] += " " + rest
        else:
            out.append(rest)
        return out

    def aligned(self, segments: list[str]) -> list[tuple]:
        """n_a, n_b, groups as text, and the ids of the links, for each segment."""
        a = [self.a.encode_ordinary(" " + s) for s in segments]
        b = self.b.encode(segments, num_threads=1)
        ends = np.cumsum([len(s.encode()) + 1 for s in segments])
        a_ids, b_ids = (np.fromiter((i for ids in x for i in ids), np.int64) for x in (a, b))
        a_ends, b_ends = np.cumsum(self.a_bytes[a_ids]), np.cumsum(self.b_bytes[b_ids])
        cuts, common = np.union1d(a_ends, b_ends), np.intersect1d(a_ends, b_ends)
        if not np.isin(ends, common).all() or any(int(self.a_bytes[x].sum()) != n or int(self.b_bytes[y].sum()) != n for x, y, n in zip(a, b, np.diff(ends, prepend=0).tolist(), strict=True)):
            raise ValueError("a segment's tokens do not spell it")
        link_a, link_b = a_ids[np.searchsorted(a_ends, cuts)], b_ids[np.searchsorted(b_ends, cuts)]
        to_a, to_b = np.searchsorted(a_ends, common, "right").tolist(), np.searchsorted(b_ends, common, "right").tolist()
        a_text, b_text = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        groups, i, j = [], 0, 0
        for x, y in zip(to_a, to_b, strict=True):
            groups.append(f"{','.join(a_text[i:x])}|{','.join(b_text[j:y])}")
            i, j = x, y
        out, g, c = [], 0, 0
        for x, y, group_end, cut_end in zip(a, b, np.searchsorted(common, ends, "right").tolist(), np.searchsorted(cuts, ends, "right").tolist(), strict=True):
            out.append((len(x), len(y), group_end - g, ";".join(groups[g:group_end]), link_a[c:cut_end], link_b[c:cut_end]))
            g, c = group_end, cut_end
        return out


def coded(docs: DataFrame, vocabularies: tuple[str, str] = VOCABULARIES, block_bytes: int = BLOCK) -> DataFrame:
    """Two kinds of rows: a text's doc_id and codes, and a block's distinct segments by code with their numbers. Texts without tokens have no codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, block = Vocabularies(*vocabularies), TaskContext.get().partitionId() << 32
        ids, codes, index, held = [], [], {}, 0

        def closed() -> Iterator[pa.RecordBatch]:
            names, n, m = ["block", "doc_id", "codes", "code", "segment", "n"], len(ids), len(index)
            for at in range(0, n, 1000):
                part = pa.array(codes[at : at + 1000], pa.binary())
                k = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([block] * k), pa.array(ids[at : at + k], pa.int64()), part, pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())], names=names)
            times = np.bincount(np.frombuffer(b"".join(c for c in codes if c), "<u4"), minlength=m)
            segments = list(index)
            for at in range(0, m, 20_000):
                part = pa.array(segments[at : at + 20_000], pa.string())
                k = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([block] * k), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(at, at + k), pa.int64()), part, pa.array(times[at : at + k])], names=names)

        for batch in batches:
            for piece in slices(batch):
                for doc, raw in zip(piece.column(0).to_pylist(), piece.column(1), strict=True):
                    raw = raw.as_py() or b""
                    if held and held + len(raw) > block_bytes:
                        yield from closed()
                        block, ids, codes, index, held = block + 1, [], [], {}, 0
                    held += len(raw)
                    ids.append(doc)
                    try:
                        text = raw.decode()
                    except UnicodeDecodeError:
                        text = ""
                    if not v.faithful(text):
                        codes.append(None)
                        continue
                    parts = v.segments(text)
                    codes.append(np.fromiter((index.setdefault(p, len(index)) for p in parts), "<u4", len(parts)).tobytes())
        yield from closed()
        give_back()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, "block long, doc_id long, codes binary, code long, segment string, n long")


def small(values: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values, kind).tobytes(), 1)


def full(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), kind)


def lines(texts: list[str]) -> bytes:
    return zstandard.compress("\n".join(texts).encode(), 1)


def aligned_chunks(dictionary: DataFrame, vocabularies: tuple[str, str] = VOCABULARIES, chunk_rows: int = CHUNK) -> DataFrame:
    """Two kinds of rows for every chunk of distinct segments: what its links add to the counts of id pairs, and the packed chunk.

    dictionary (block, code, segment, n) is dealt and sorted by segment, so that each is tokenised and aligned once: in one
    chunk, or in as many as hold chunk_rows blocks each. A packed chunk has its segments' counts, groups and links, and the
    block and code of every place where they belong.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, chunk = Vocabularies(*vocabularies), TaskContext.get().partitionId() << 32
        segments, times, blocks, codes, which = [], [], [], [], []

        def closed() -> Iterator[pa.RecordBatch]:
            found = [r for at in range(0, len(segments), 20_000) for r in v.aligned(segments[at : at + 20_000])]
            counts = np.array([r[:3] for r in found], np.int64).T
            a, b = (np.concatenate([r[k] for r in found]) for k in (4, 5))
            keys, inverse = np.unique(a << 32 | b, return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, inverse, np.repeat(np.array(times, np.int64), counts[0] + counts[1] - counts[2]))
            own, at = np.unique(np.array(blocks, np.int64), return_inverse=True)
            packs = [small(at, "<u4"), small(codes, "<u4"), small(which, "<u4"), *(small(c, "<u4") for c in counts), small(a, "<u4"), small(b, "<u4"), lines([r[3] for r in found])]
            columns = [pa.array([chunk]), pa.array([None], pa.int32()), pa.array([None], pa.int32()), pa.array([None], pa.int64()), pa.array([own.tolist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in packs)]
            yield pa.RecordBatch.from_arrays(columns, names=CHUNK_NAMES)
            for k in range(0, len(keys), 50_000):
                x = keys[k : k + 50_000]
                nothing = [pa.nulls(len(x), pa.list_(pa.int64())), *(pa.nulls(len(x), pa.binary()) for _ in packs)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(x)), pa.array((x >> 32).astype(np.int32)), pa.array((x & 0xFFFFFFFF).astype(np.int32)), pa.array(n[k : k + 50_000]), *nothing], names=CHUNK_NAMES)

        for batch in batches:
            for block, code, segment, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not segments or segment != segments[-1] or len(codes) >= 2 * chunk_rows:
                    if len(codes) >= chunk_rows:
                        yield from closed()
                        chunk, segments, times, blocks, codes, which = chunk + 1, [], [], [], [], []
                    segments.append(segment)
                    times.append(0)
                times[-1] += n
                blocks.append(block)
                codes.append(code)
                which.append(len(segments) - 1)
        if segments:
            yield from closed()
        give_back()

    dealt = dictionary.select("block", "code", "segment", "n").repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(run, CHUNK_SCHEMA)


def returned(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """For every block that a chunk has places in, a row with these places' codes, counts and groups, packed.

    pairs: chunk, a, b, count and best of the id pairs that are linked in the chunk.
    """

    def run(key: tuple, chunk: pa.Table, known: pa.Table) -> pa.Table:
        (row,) = chunk.to_pylist()
        at, codes, which, n_a, n_b, n_groups, a, b = (full(row[c], "<u4").astype(np.int64) for c in CHUNK_NAMES[5:13])
        groups = zstandard.decompress(row["groups"]).decode().split("\n")
        order = np.argsort(keys := known.column("a").to_numpy().astype(np.int64) << 32 | known.column("b").to_numpy())
        found = order[np.searchsorted(keys, a << 32 | b, sorter=order)]
        links = n_a + n_b - n_groups
        starts = np.cumsum(links) - links
        best, total = (np.add.reduceat(known.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[found], starts) for c in ("best", "count"))
        stats = (n_a, n_b, n_groups, links, best, total)
        out, order = [], np.argsort(at, kind="stable")
        for block, mine in zip(row["blocks"], np.split(order, np.flatnonzero(np.diff(at[order])) + 1), strict=True):
            k = which[mine]
            out.append((block, small(codes[mine], "<u4"), *(small(x[k], "<i8") for x in stats), lines([groups[i] for i in k.tolist()])))
        kinds = [pa.int64(), *[pa.binary()] * (len(STATS) + 2)]
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["of", "places", *STATS, "groups"])

    schema = ", ".join(["of long", "places binary", *(f"{c} binary" for c in STATS), "groups binary"])
    return chunks.groupBy("chunk").cogroup(pairs.groupBy("within")).applyInArrow(run, schema)


def composed(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The result's rows: codes of a block's texts (block, doc_id, codes) over what chunks return to it (of, its block; places; the counts; groups)."""

    def run(texts: pa.Table, parts: pa.Table) -> pa.Table:
        places = [full(x, "<u4") for x in parts.column("places").to_pylist()]
        order = np.argsort(np.concatenate([np.zeros(0, "<u4"), *places]), kind="stable")
        stats = np.stack([np.concatenate([np.zeros(0, "<i8"), *(full(x, "<i8") for x in parts.column(c).to_pylist())])[order] for c in STATS], 1)
        held = [g for x in parts.column("groups").to_pylist() for g in zstandard.decompress(x).split(b"\n")]
        groups = [held[k] for k in order.tolist()]
        sums, hashes = [], []
        for codes in texts.column("codes"):
            codes = np.frombuffer(codes.as_py() or b"", "<u4")
            total, digest = np.zeros(len(STATS), np.int64), hashlib.sha256()
            for at in range(0, len(codes), 1 << 16):
                part = codes[at : at + (1 << 16)]
                total += stats[part].sum(0)
                digest.update(b";" * (at > 0) + b";".join([groups[c] for c in part.tolist()]))
            sums.append(total)
            hashes.append(digest.hexdigest() if len(codes) else "")
        columns = np.array(sums, np.int64).reshape(-1, len(STATS)).T
        return pa.Table.from_arrays([texts.column("doc_id"), *(pa.array(c) for c in columns), pa.array(hashes, pa.string())], names=["doc_id", *STATS, "groups_sha256"])

    return docs.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, RESULT)


def aligned(docs: DataFrame, vocabularies: tuple[str, str] = VOCABULARIES, block_bytes: int = BLOCK, chunk_rows: int = CHUNK) -> DataFrame:
    """The alignment's counts and hash for every row of docs (doc_id, text)."""
    blocks = stored(coded(docs, vocabularies, block_bytes), "coded")
    chunks = stored(aligned_chunks(blocks.filter("segment IS NOT NULL"), vocabularies, chunk_rows), "chunks")
    added = chunks.filter("a_id IS NOT NULL").select("chunk", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "n")
    counted = added.groupBy("a", "b").agg(F.sum("n").alias("count"))
    pairs = stored(counted.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("b"))), "pairs")
    within = added.select(F.col("chunk").alias("within"), "a", "b").join(pairs, ["a", "b"])
    known = returned(chunks.filter("a_id IS NULL").select("chunk", *CHUNK_NAMES[4:]), within)
    return composed(blocks.filter("segment IS NULL").select("block", "doc_id", "codes"), known)


def op12_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of all documents under both vocabularies.

    Null, empty and unfaithfully spelled texts have zeros and an empty hash, and take no part in the corpus-wide counts. Rows that
    repeat a doc_id or a text each have a row and count as often as they occur; pairs that tie for their B id's highest count
    are all best. Very long texts are blocks of their own. An empty table gives no rows; other columns are ignored.
    """
    return aligned(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
