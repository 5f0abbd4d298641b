"""Every operator over odd documents, against brute force, exact round trips and invariants."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphnet_spark.llm import anchors, licenses, media, mixing, near_dedup, packing, pii, quality, registry, suffix_dedup, warc, window_dedup

from graphnet_spark.llm.common import stored
from graphnet_spark.llm.graph import components, merged

from .conftest import DOCS, prose, rows

Q = registry.queries()
DOCUMENT_QUERIES = [n for n in Q if not n.startswith("op6")]
ASCII_SPACE = "[^\x20\x09-\x0d]+"


def words(text):
    return re.findall(ASCII_SPACE, text or "")


def by_id(out):
    found = collections.defaultdict(list)
    for r in out.collect():
        found[r["doc_id"]].append(r)
    return found


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_empty_table(spark, sf, empty, name):
    out = Q[name](spark, sf(documents=empty))
    assert out.count() == 0 and "doc_id" in out.columns


def test_empty_pages(spark, sf):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert Q["op6_warc_revisit"](spark, sf(pages=pages)).count() == 0


def test_quality_counts(spark, sf, docs):
    out = by_id(Q["op1_ngram_quality"](spark, sf(documents=docs)))
    for doc, text, *_ in rows():
        w = words(text)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        for r in out[doc]:
            if doc != 12 or r["n_words"]:
                assert tuple(r)[1:6] == want and r["base_failed"] == failed and (not failed or not r["kept"])
    assert sum(map(len, out.values())) == len(rows())


def brute_kneser_ney(texts):
    """P(class | three before) by definition, from dictionaries: a function of a 4-tuple."""
    table = quality.class_table()
    counts = {4: collections.Counter()}
    for t in texts:
        own = [0, 0, 0] + [int(table[ord(c)]) for c in t]
        counts[4].update(tuple(own[i : i + 4]) for i in range(len(own) - 3))
    for k in (3, 2, 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discounts, contexts = {}, {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        discounts[k] = [0] + [max(0.05, min(0.95 * i, i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i)) for i in (1, 2, 3)]
        for g, v in c.items():
            contexts.setdefault((k, g[:-1]), []).append(v)

    def p(g):
        k = len(g)
        if not k:
            return 1 / quality.ALPHABET
        seen = contexts.get((k, g[:-1]))
        if not seen:
            return p(g[1:])
        d = discounts[k]
        gamma = sum(d[min(v, 3)] for v in seen) / sum(seen)
        v = counts[k].get(g, 0)
        return max(0.0, v - d[min(v, 3)]) / sum(seen) + gamma * p(g[1:])

    return lambda text: [p(tuple(g)) for own in [[0, 0, 0] + [int(table[ord(c)]) for c in text]] for g in (own[i : i + 4] for i in range(len(own) - 3))]


def test_perplexity_by_definition(spark):
    texts = [prose(k, 60) for k in range(6)] + ["Привет, мир! 12 été\n漢字かな"]
    docs = spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "doc_id long, lang string, text string").repartition(3)
    p = brute_kneser_ney(texts)
    got = {r["doc_id"]: r["perplexity"] for r in quality.quality(docs, ["doc_id"]).collect()}
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(np.exp(-np.mean(np.log(p(t)))), rel=1e-4)


def test_kneser_ney_sums_to_one(spark):
    docs = spark.createDataFrame([("en", prose(k, 200)) for k in range(5)], "lang string, text string")
    model = quality.train(docs, ["en"])
    for context in ("the", "zzz", " an"):
        codes = [quality.grams(context + chr(c), quality.class_table())[1][-1] for c in range(97, 123)]
        base = codes[0] // quality.ALPHABET * quality.ALPHABET
        p = np.exp(model.score(0, np.arange(base, base + quality.ALPHABET)))
        assert p.sum() == pytest.approx(1, abs=1e-5) and (p > 0).all()
    assert (np.diff(model.keys.astype(object)) > 0).all()


def test_every_language_of_enough_documents_has_a_model(spark):
    rows_ = [(k, f"l{k % 11}", prose(k, 30)) for k in range(1100)] + [(2000 + k, "xx", prose(k, 30)) for k in range(99)]
    d = spark.createDataFrame(rows_, "doc_id long, lang string, text string")
    assert quality.languages(d) == sorted(f"l{k}" for k in range(11))[: quality.MODELS]


def test_each_of_many_languages_is_judged_by_its_own_texts(spark):
    texts = {k: prose(100 * k, 22).replace("aeihnotr"[k % 8], "XYZ0"[k % 4]) for k in range(10)}
    rows_ = [(1000 * k + n, f"l{k}", text + f" {n}") for k, text in texts.items() for n in range(100)]
    got = {r["doc_id"]: r["perplexity"] for r in quality.quality(spark.createDataFrame(rows_, "doc_id long, lang string, text string"), ["doc_id"]).collect()}
    for k in (0, 8, 9):
        own = [t for _, lang, t in rows_ if lang == f"l{k}"]
        p = brute_kneser_ney(own)
        assert got[1000 * k + 7] == pytest.approx(np.exp(-np.mean(np.log(p(own[7])))), rel=1e-4)


def test_languages_of_few_documents_have_bands_of_their_own(spark):
    """Codes and prose share a model, but what is usual in one language is not in the other."""
    codes = lambda k: " ".join(f"{k * 7919 + n * 104729:x}".upper() for n in range(60))
    rows_ = [(k, "pr", prose(k, 60)) for k in range(90)] + [(1000 + k, "co", codes(k)) for k in range(60)] + [(5000, "pr", codes(977)), (6000, "one", prose(400, 60))]
    d = spark.createDataFrame(rows_, "doc_id long, lang string, text string")
    got = {r["doc_id"]: r for r in quality.quality(d, ["doc_id"]).collect()}
    assert len(got) == len(rows_) and got[1000]["upper"] < got[0]["upper"] - 1 and got[1000]["lower"] < got[0]["lower"] - 0.5
    assert not got[5000]["kept"] and got[6000]["kept"] and sum(r["kept"] for r in got.values()) >= len(rows_) - 4


def test_scores_hold_few_models_at_once(monkeypatch):
    class Model:
        def __init__(self, k):
            self._value = None

        @property
        def value(self):
            self._value = self
            return self

        def score(self, model, grams):
            return grams + 1000.0 * model

    monkeypatch.setattr(quality, "HELD", 2)
    scores = quality.Scores({k: Model(k) for k in range(5)})
    for model in (0, 1, 2, 1, 4, 0, 3):
        assert scores.of(model, np.array([5, 7, 5])).tolist() == [1000 * model + x for x in (5, 7, 5)]
        assert len(scores.held) <= 2
    assert list(scores.held) == [0, 3] and sum(hasattr(m, "_value") for m in scores.models.values()) == 2


def test_every_code_point_counts_within_its_class(spark):
    """Letters of another script in place of their class's own leave the classes as they are, but not the text's probability."""
    table = quality.class_table()
    other = {}
    for c in range(0x4E00, 0x9FFF):
        other.setdefault(int(table[c]), c)
    swapped = prose(3, 100).translate({c: other[int(table[c])] for c in range(97, 123)})
    rows_ = [(k, "en", prose(k, 100)) for k in range(200)] + [(900, "en", swapped), (901, "xx", "Привет, мир " * 2 + "42 é"), (902, None, " \n"), (903, "en", None)]
    d = spark.createDataFrame(rows_, "doc_id long, lang string, text string").repartition(5)
    got = {r["doc_id"]: r for r in quality.quality(d, ["doc_id"]).collect()}
    assert got[900]["perplexity"] == pytest.approx(got[3]["perplexity"]) and not got[900]["kept"] and got[900]["point_perplexity"] > got[900]["point_upper"]
    assert all(got[k]["point_perplexity"] <= got[k]["point_upper"] for k in range(200)) and got[902]["point_perplexity"] is None and got[903]["point_perplexity"] is None
    for ids in (range(200), [901]):
        texts = {k: [c for c in t if not c.isspace()] for k, _, t in rows_ if t and (k in ids or (k == 900 and len(ids) > 1))}
        n = collections.Counter(c for t in texts.values() for c in t)
        kinds = collections.Counter({})
        for c, k in n.items():
            kinds[int(table[ord(c)])] += k
        for k in ids:
            assert got[k]["point_perplexity"] == pytest.approx(np.exp(-np.mean([np.log(n[c] / kinds[int(table[ord(c)])]) for c in texts[k]])), rel=1e-4)


def test_bands_reject_noise_and_keep_prose(spark):
    rows_ = [(k, "en", prose(k, 150)) for k in range(200)] + [(901, "en", "the " * 7 + "then that this those " * 4 + "at an on in it is be to " * 2)] + [(900, "en", " ".join("QZX#%WV" for _ in range(150)) + " " + "@".join(map(chr, range(40, 120))))]
    out = quality.quality(spark.createDataFrame(rows_, "doc_id long, lang string, text string"), ["doc_id"]).collect()
    assert sum(not r["kept"] for r in out if r["doc_id"] < 900) <= 2
    assert not next(r["kept"] for r in out if r["doc_id"] == 900)
    assert all(r["lower"] < r["upper"] and r["kept"] == (not r["base_failed"] and r["lower"] <= r["perplexity"] <= r["upper"]) for r in out)


def test_media_round_trip(spark, sf, docs):
    out = by_id(Q["op2_media_sniff"](spark, sf(documents=docs)))
    for doc, text, *_ in rows():
        raw = (text or "").encode()
        payload = raw + b" " * (192 - len(raw) if not raw else -len(raw) % 192)
        for r in out[doc]:
            assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])


def test_sniffing(spark):
    payload = bytes(range(192)) * 3
    wav, bmp, png = (media.encode(payload, k) for k in ("wav", "bmp", "png"))
    assert [media.decode(b, k) for b, k in ((wav, "wav"), (bmp, "bmp"), (png, "png"))] == [payload] * 3
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab\xff\xda" + struct.pack(">H", 2) + b"data\xff\xd9"
    blobs = [(1, "wav", b"noise BM RIFF" + png + b"--" + wav), (2, "gif", media.CARRIER + jpeg), (3, "bmp", bmp[:-1]), (4, "png", png.replace(b"IDAT", b"IDAX")), (5, None, b""), (6, "wav", None)]
    d = spark.createDataFrame(blobs, "doc_id long, kind string, blob binary").withColumn("media", F.lit(1))
    got = {r["doc_id"]: (r["found"], r["corrected"], [tuple(m) for m in r["media"]]) for r in media.sniff(d, "blob", "kind").collect()}
    assert got[1] == ("png", True, [(13, len(png), "png"), (15 + len(png), len(wav), "wav")])
    assert got[2] == ("gif", False, [(0, len(media.CARRIER), "gif"), (len(media.CARRIER), len(jpeg), "jpeg")])
    assert all(got[k] == (None, False, []) for k in (3, 4, 5, 6))


def test_mixing(spark, sf, docs):
    out = [r for rs in by_id(Q["op3_source_mix"](spark, sf(documents=docs))).values() for r in rs]
    total, size = sum(r["size"] for r in out), collections.Counter()
    sources = {(r["source_size"], r["target"]) for r in out}
    assert sum(t for _, t in sources) == pytest.approx(total) and all(t <= 3 * s + 1e-9 for s, t in sources)
    assert all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in out)
    many = spark.createDataFrame([(k, f"s{k % 7 % 5}", 10 + k * 37 % 400) for k in range(3000)], "doc_id long, source string, n long")
    for r in mixing.mix(many, F.col("n")).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.02)


def test_mixed_rows_are_repeated(spark):
    d = spark.createDataFrame([(1, "a", "x y"), (2, "b", "z"), (3, None, None)], "doc_id long, source string, text string")
    mixed = mixing.mix(d)
    copies = {r["doc_id"]: r["copies"] for r in mixed.collect()}
    assert collections.Counter(r["doc_id"] for r in mixing.emit(mixed).collect()) == {k: v for k, v in copies.items() if v}


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def test_near_duplicates(spark, sf):
    base = prose(50, 200).split()
    texts = [" ".join(base)] * 2
    for k in range(12):  # a chain of copies, each a little further away
        base = [*base[:-3], f"end{k}", f"x{k}", f"y{k}"]
        base[10 * k] = f"new{k}"
        texts.append(" ".join(base))
    texts += [prose(100 + k, 150) for k in range(30)] + ["", None, "a", "a", " "]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(d).collect()}
    shingles = [collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w := (t or "").split()) >= 5 else collections.Counter([tuple(w)] if w else []) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            s = jaccard(shingles[i], shingles[j]) if shingles[i] or shingles[j] else 0
            if s >= 0.85:
                assert got[i] == got[j], (i, j, s)
    assert len({got[k] for k in range(14, 44)}) == 30 and not {got[k] for k in range(14, 44)} & {got[k] for k in range(14)}
    assert got[44] == got[45] and got[46] == got[47] == 46


@pytest.mark.parametrize("seed", range(3))
def test_components_and_later_links(spark, seed):
    r = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(500, 560)] + [(600, k) for k in range(601, 640)]
    root = list(range(700))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    frame = lambda rows_: stored(spark.createDataFrame(rows_, "a long, b long"), "links")
    labels = merged(components(frame(links[:150])), frame(links[150:]))
    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["label"] for r in labels.collect()} == {n: top(n) for n in nodes}


def test_one_representative_of_odd_rows(spark, sf, docs):
    out = Q["op4_icws_dedup"](spark, sf(documents=docs)).collect()
    assert len(out) == len(rows())
    assert {r["class_id"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    assert {(r["doc_id"], r["representative"]) for r in out if r["class_id"] == 1} == {(1, True), (2, False), (3, False)}


@pytest.mark.parametrize("block", [1, 128])
def test_blocks_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    sets = {f"{k:02}".encode(): {(k // 6) * 100 + i for i in range(k % 6, k % 6 + 20)} for k in range(18)}
    items = [(n, np.array(sorted(s), "<u4").tobytes() + np.ones(len(s), "<f4").tobytes()) for n, s in sets.items()]
    frame = lambda data, ddl: spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in data], ddl)
    d = frame(items, "node binary, items binary")
    buckets = frame([(n, 1) for n in sets], "node binary, band long")
    labels = frame([(n, n) for n in list(sets)[:2]], "node binary, label binary")
    links = near_dedup.block_links(near_dedup.labelled(buckets, labels), d, 0.8).collect()
    root = {n: n for n in sets}

    def top(x):
        return x if root[x] == x else top(root[x])

    for r in links:
        root[max(top(bytes(r["a"])), top(bytes(r["b"])))] = min(top(bytes(r["a"])), top(bytes(r["b"])))
    assert {top(n) for n in sets} == {b"00", b"06", b"12"}


def brute_bytes(first_only, given):
    raw = [(d, (t or "").encode()) for d, t, *_ in given]
    raw.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    count = collections.Counter(b[i : i + 400] for _, b in raw for i in range(len(b) - 399))
    out, seen, short, done = collections.defaultdict(list), set(), set(), {}
    for d, b in raw:
        if (d, b) in done and first_only:
            out[d].append(done[d, b])
            continue
        gone, later = bytearray(len(b)), bytearray(len(b))
        for i in range(len(b) - 399):
            if (b[i : i + 400] in seen) if first_only else count[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
            seen.add(b[i : i + 400])
        for i in range(len(b) - 255):
            if b[i : i + 256] in short:
                later[i : i + 256] = b"\1" * 256
            short.add(b[i : i + 256])
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        done.setdefault((d, b), (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sum(later), hashlib.sha256(left).hexdigest()))
        out[d].append(done[d, b])
    return out


def same_bytes(docs, given, first_only):
    out = suffix_dedup.deduplicated(docs, first_only).select("doc_id", "n_bytes", "n_removed", "n_spans", "n_later", F.sha2("kept", 256).alias("h"))
    want = brute_bytes(first_only, given)
    for doc, found in by_id(out).items():
        assert sorted(tuple(r)[1:] for r in found) == sorted(want[doc]), doc


@pytest.mark.parametrize(("first_only", "chunk"), [(False, 1 << 20), (True, 1 << 20), (False, 900), (True, 900)])
def test_suffix_dedup(spark, docs, monkeypatch, first_only, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    same_bytes(docs, rows(), first_only)


@pytest.mark.parametrize("first_only", [False, True])
def test_suffix_dedup_of_shared_and_periodic_texts(spark, first_only):
    part, line = prose(40, 300), "a separator line of forty bytes -------\n"
    given = [(1, prose(41, 40) + part[:300]), (2, part[20:300] + prose(42, 50)), (3, prose(43, 20) + part[200:900]), (4, part[180:720] + "end"), (5, part[100:699]), (6, "x" * 30_000), (7, "y" + "x" * 700)]
    given += [(8, line * 300), (9, prose(44, 30) + line[7:] + line * 12), (10, prose(44, 30)), (11, part[500:]), (12, "z" * 256), (13, "z" * 255)]
    same_bytes(spark.createDataFrame(given, "doc_id long, text string").repartition(4), given, first_only)


def test_suffix_dedup_of_very_long_periodic_texts(spark):
    line = "a separator line of forty bytes -------\n"
    given = [(1, "=" * 8_000_000), (2, line * 200_000), (3, "x" + "=" * 399), (4, line[1:] + line * 10)]
    out = {r["doc_id"]: r for r in suffix_dedup.deduplicated(spark.createDataFrame(given, "doc_id long, text string"), False).drop("kept").collect()}
    assert [out[k]["n_removed"] for k in (1, 2, 3, 4)] == [8_000_000, 8_000_000, 0, 439] and out[1]["n_later"] == 7_999_999 and out[3]["n_later"] == 399


def test_longest_previous_factor():
    r = np.random.default_rng(1)
    text = bytes(r.integers(97, 99, 300).astype(np.uint8)) * 2 + bytes(20)
    places, raw = np.arange(len(text) - 12), np.frombuffer(text, np.uint8)
    levels = suffix_dedup.prefix_ranks(text, 12)
    order = places[np.argsort(levels[-1][1][places], kind="stable")]
    classes, factor, source = (x[np.argsort(order)] for x in suffix_dedup.longest_previous(levels, raw, order, 12))
    for i in places:
        best = max((next((n for n in range(12) if text[i + n] != text[j + n]), 12) for j in range(i)), default=0)
        assert (factor[i] == 12) == (best == 12)
        again = any(text[i : i + 12] == text[j : j + 12] for j in places if j != i)
        assert (factor[i] == 12 or source[i]) == again
    assert all((classes[i] == classes[j]) == (text[i : i + 12] == text[j : j + 12]) for i in places[:60] for j in places[300:360])


def test_warc(spark, sf, tmp_path):
    big, other = "<p>" + "a" * 2000, "\r\n\r\nWARC/1.1\r\n" + "b" * 1500
    pages = [(1, "u", big), (5, None, big), (3, "a\r\nb", big), (2, "u", other), (4, "u", other), (6, "u", "short"), (7, "u", "short"), (8, "u", None), (None, "u", big), (9, "u", "é" * 600), (9, "u", "é" * 600)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload_digest", F.lit("x"))
    got = [tuple(r) for r in Q["op6_warc_revisit"](spark, sf(pages=d)).collect()]
    want = []
    for page, _, html in pages:
        body = (html or "").encode()
        top = max((p for p, _, h in pages if h == html and p is not None), default=None)
        again = len(body) >= 1000 and page != top
        want.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top if again else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_parse_rejects_wrong_lengths():
    with pytest.raises(ValueError, match="does not end"):
        list(warc.parse([b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcdef\r\n\r\n"]))


def test_licenses(spark, sf, docs):
    out = by_id(Q["op7_license_join"](spark, sf(documents=docs)))
    for doc, text, *_ in rows():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        want = (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        for r in out[doc]:
            assert tuple(r)[1:6] == want and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert out[20][0]["labels"] == "cc-by,cc-by-nc-4.0" and out[20][0]["score"] == 1


def test_license_join_is_exact(spark):
    pool = "released under the mit license this work is of gnu version".split()
    texts = [" ".join(pool[(k * j) % len(pool)] for j in range(1, 2 + k % 9)) + "\n" + prose(k, 5) for k in range(60)]
    d = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, tag long, text string")
    got = {(r["doc_id"], r["start"], r["template"]) for r in licenses.template_blocks(d).collect()}
    known = {w for body, _ in licenses.TEMPLATES for w in body.split()}
    want = set()
    for k, t in enumerate(texts):
        words = t.split()
        for n in range(len(words)):
            for i, ((body, _), width) in enumerate(zip(licenses.TEMPLATES, licenses.widths())):
                held = len(set(words[n : n + width]) & set(body.split()))
                if words[n] in known and held >= 0.8 * len(set(body.split())) - 1e-9:
                    want.add((k, n, i))
    assert got == want and want


def test_notices_count_however_they_are_wrapped_but_not_scattered(spark, monkeypatch):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    unlicense = "this is free and unencumbered software released into the public domain".split()
    far = prose(31, 300).split()
    for k, w in enumerate(unlicense):
        far[25 * k + 3] = w
    texts = [prose(1, 50) + "\n" + gpl.replace(" ", "\n") + "\n" + prose(2, 50), gpl.replace(" ", "\n\n# "), " ".join(far), " ".join(unlicense), "license " * 60_000, (" ".join(unlicense) + " and ") * 3000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = ["gpl", "gpl", "", "unlicense", "", "unlicense"]
    for chunk in (licenses.CHUNK, 7):
        monkeypatch.setattr(licenses, "CHUNK", chunk)
        got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(d).collect()}
        assert [got[k][0] for k in range(6)] == want and [got[k][1] for k in (2, 3, 4)] == [0.0, 1.0, 0.0]
        assert licenses.template_blocks(d.filter("doc_id = 5").withColumn("tag", d["doc_id"])).filter("label = 'unlicense' AND containment = 1").count() >= 3000


def test_wrapped_notices_are_found(spark):
    notices = {
        "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that",
        "mpl-2.0": "/* This Source Code Form is subject to the terms of the Mozilla\n * Public License, v. 2.0. If a copy */",
        "isc": "Permission to use, copy, modify, and/or distribute this software\nfor any purpose with or without fee\nis hereby granted, provided",
        "gpl,gpl-3.0": "this work is licensed\nunder the GNU General\nPublic License version 3",
        "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 2",
    }
    texts = [prose(k, 30) + "\n\n" + t + "\n" + prose(k + 9, 30) for k, t in enumerate(notices.values())] + [prose(77, 400).replace(" is ", "\nis\n")]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(d).collect()}
    assert [got[k] for k in range(len(texts))] == [*notices, ""]


def test_window_dedup(spark, sf, docs):
    out = by_id(Q["op8_window_dedup"](spark, sf(documents=docs)))
    seen, done = set(), set()
    for doc, text, *_ in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0)):
        if (doc, text) in done:
            continue
        done.add((doc, text))
        w = words(text)
        gone = set()
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone |= set(range(i, i + 20))
            seen.add(tuple(w[i : i + 20]))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        for r in out[doc]:
            assert tuple(r)[1:] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), doc


def test_sketch_never_understates(spark):
    d = spark.createDataFrame([(" ".join(f"w{(k * 7 + i) % 50}" for i in range(60)),) for k in range(20)], "text string").repartition(5)
    sketch = anchors.sketch_items(d, window_dedup.anchor_items, window_dedup.BYTES_PER_ANCHOR)
    items = [x for r in d.toArrow().to_batches() for x in window_dedup.anchor_items(r)]
    value, n = np.unique(np.concatenate(items), return_counts=True)
    assert sketch.repeated(value[n > 1]).all() and not sketch.repeated(np.arange(1000, dtype=np.uint64) * np.uint64(977)).any()


def test_packing(spark, sf, docs):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = Q["op9_best_fit"](spark, sf(documents=docs)).collect()
    pieces = collections.defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
    for doc, text, *_ in rows():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [(0, first)] + [(s, 2048) for s in range(first, len(ids), 2048)]
        want = {(k, s, n, zlib.crc32(struct.pack(f"<{n}I", *ids[s : s + n]))) for k, (s, n) in enumerate(cuts)}
        assert {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[doc]} == want, doc
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(r["length"] for r in out) // 2048)


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_every_capacity_holds(rule):
    lengths = np.random.default_rng(2).integers(1, 200, 400)
    where, offset = packing.vector_best_fit(lengths, 256, 3, 40_000, rule)
    for b in range(where.max() + 1):
        own = lengths[where == b]
        assert own.sum() <= 256 and len(own) <= 3 and (own.astype(float) ** 2).sum() <= 40_000
    free, _ = packing.vector_best_fit(lengths, 256, 256, 256 * 256, rule)
    assert free.max() + 1 <= -(-lengths.sum() // 256) * 1.02 + 1


def brute_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


HARD = ["a@b.com.x+y@c.org a@b.com_x@c.org", "@a.b x@y z@z.z.", "256.1.1.1 0255.00.1.1 1.2.3.4.5.6.7.8", "4111111111111111 4111-1111-1111-1111 4111 1111  1111 1111 41111111111111111111", "+1 2 +12345678 +1(2)3.4-5 6 7 8 9 +123456789012345678", "\U0001f600 é a@b.cd", "12 4111 1111 1111 1111", "0" * 16 + " " + "0" * 40, "a" * 5000 + "@", "1." * 300]


def test_pii(spark, sf, docs):
    extra = spark.createDataFrame([(100 + k, t) for k, t in enumerate(HARD)], "doc_id long, text string")
    out = by_id(Q["op10_pii_boost"](spark, sf(documents=docs.unionByName(extra, allowMissingColumns=True))))
    for doc, text in [(r[0], r[1]) for r in rows()] + [(100 + k, t) for k, t in enumerate(HARD)]:
        spans = brute_pii(text or "")
        text_ = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for r in out[doc]:
            assert r["base_sha256"] == hashlib.sha256(text_.encode()).hexdigest(), (doc, text_)
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
            assert set(text_.split(",")) - {""} <= set(r["spans"].split(","))


def test_trees_add_spans_and_leave_prose(spark):
    strict = [(k, f"{prose(k, 12)} please call +1 (2{k % 90:02}) 555-{1000 + k} now {prose(k + 1, 9)} 12.5 and 2024-01-{k % 28 + 1:02}") for k in range(300)]
    d = spark.createDataFrame(strict + [(1000, prose(3, 50)), (1001, "in 1999 there were 25 of 100")], "doc_id long, text string")
    got = {r["doc_id"]: (len(r["base"]), len(r["spans"])) for r in pii.with_spans(d).collect()}
    assert all(got[k][0] == 1 and got[k][1] >= 1 for k in range(300)) and got[1000] == got[1001] == (0, 0)


def test_redaction(spark):
    d = spark.createDataFrame([(1, "é a@b.cd, +1 234 567 89 end"), (2, None), (3, "none")], "doc_id long, text string")
    out = pii.with_spans(d).select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t"))
    assert {r["doc_id"]: r["t"] for r in out.collect()} == {1: "é <EMAIL>, <PHONE> end", 2: "", 3: "none"}


def test_unused_columns_and_ddl():
    assert "tag" in DOCS and "spans" in DOCS
