"""The alignment against whole texts, tokenised in one piece and compared token by token."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphnet_spark.llm import alignment

from .conftest import prose

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def whole():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet, by its rule
    letters = {chr(k): k for k in keep} | {chr(256 + i): k for i, k in enumerate(k for k in range(256) if k not in keep)}

    def tokens(text):
        if not text:
            return [], []
        want = (" " + text).encode()
        left = [(t.id if hasattr(t, "id") else t, bytes(letters[c] for c in a.id_to_token(t))) for t in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return (left, right) if all(b"".join(x for _, x in side) == want for side in (left, right)) else ([], [])

    return tokens


def expected(rows, whole):
    docs, counts = [], Counter()
    for doc, text in rows:
        spans = []
        for side in whole(text):
            at, out = 0, []
            for i, raw in side:
                out.append((at, at + len(raw), i))
                at += len(raw)
            spans.append(out)
        links, k = [], 0
        for s, e, i in spans[0]:
            while k < len(spans[1]) and spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((i, spans[1][j][2]))
                j += 1
        counts.update(links)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, i, j = [], 0, 0
        for cut in cuts:
            parts = []
            for side, at in ((0, i), (1, j)):
                end = at
                while end < len(spans[side]) and spans[side][end][1] <= cut:
                    end += 1
                parts.append((",".join(str(x[2]) for x in spans[side][at:end]), end))
            groups.append(f"{parts[0][0]}|{parts[1][0]}")
            i, j = parts[0][1], parts[1][1]
        docs.append((doc, spans, links, groups))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return sorted(
        ((d, len(s[0]), len(s[1]), len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, s, x, g in docs),
        key=lambda r: (r[0] is None, r[0] or 0, r),
    )


def got(df):
    rows = [tuple(r) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r))


ODD = [
    "", " ", "  ", "   a", "a ", "a  ", "a \n", "\n", "\n a", "a\n b", "a \n b", "a\n\n  b", "a\t b", "a \t b", "a  b", "a  b", "a　 b", "x\x1c y", "x \x1c y", "x\x85 y", "don't  we'll I 'm it's",
    "<|endoftext|> a <s> b </s> <unk> <0x41>", "a▁b", "▁", "a ▁", "é é ﬁ ½ 你好 \U0001f600\U0001f468‍\U0001f469", "a\x00b \x00 c", "x" * 3000, " " * 500 + "y" + " " * 300, "- - -- ---", "1 23 456 7890", "word\r\n next\r\n", "a﻿ b", "    x",
]


def test_odd_texts(spark, whole):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(7, None), (None, "a b"), (3, "   a"), (3, "   a")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(alignment.aligned(df)) == expected(rows, whole)


def test_random_texts_in_small_blocks(spark, whole):
    r = random.Random(5)
    parts = [" ", " ", "  ", "\n", " \n", "\t", " ", "　", "a", "the", "'s", "'", "1", "12", "é", "你", "\U0001f600", "-", ".", "The", "ing", "\x1f", "\r", "_", "=", "▁"[:0] or "z"]
    rows = [(k, "".join(r.choices(parts, k=r.randint(1, 60)))) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert got(alignment.aligned(df, block_bytes=500, chunk_rows=40)) == expected(rows, whole)


def test_documents_and_a_very_long_text(spark, docs, whole):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows.append((99, " ".join([prose(9, 2000)] * 60) + "\n" + "q" * 50_000))
    extra = spark.createDataFrame(rows[-1:], SCHEMA)
    assert got(alignment.aligned(docs.select("doc_id", "text").unionByName(extra), block_bytes=100_000, chunk_rows=3000)) == expected(rows, whole)


def test_splits_are_where_no_vocabulary_joins():
    v = alignment.Vocabularies()
    assert v.joins == set()
    for text in ODD:
        assert " " + " ".join(v.segments(text)) == " " + text
    v.joins = {"b"}
    v.before.append("b ")
    assert v.segments("a b c d") == ["a", "b c", "d"]


def test_empty_table_and_columns(spark, empty, docs, sf):
    assert alignment.op12_segment_alignment(spark, sf(documents=empty)).collect() == []
    out = alignment.op12_segment_alignment(spark, sf(documents=docs))
    assert out.columns == ["doc_id", *alignment.STATS, "groups_sha256"] and out.count() == docs.count()
