"""Quality rules: simple text counts and n-gram perplexity with language-specific bands.

The model is a modified Kneser-Ney 4-gram model over 38 character classes, one per language, counted by Spark over
every text. A class alphabet keeps it within a proven bound whatever the corpus: at most ALPHABET**4 grams a language and
16 bytes a gram, which is what allows one task to work out a language's probabilities and every task to hold the models.
Letters of other scripts than Latin are dealt to the letters' classes by their code points, so that their order counts too. Each
code point counts by itself as well: its probability within its class, in the language, is a second measure with a band of its own,
and class and code point together make up the text's whole probability. A language has 1.1 million code points at most.
It is stored as arrays sorted by the 64-bit hash of (language, order, gram), broadcast language by language; tasks hold a few
at once, whatever their number. Perplexity bands come from a histogram over all documents of a language: median and quartiles of
the log perplexity, widened for short texts by the standard error of a mean.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import extended, give_back, slices, stored, table

#: Languages with a model of their own: all (no limit to their number) of at least so many documents. Rarer ones and null share one.
MODELS, LEAST_DOCUMENTS = None, 100
#: A rarer language's band has its own centre, drawn towards the shared one as if by so many documents, and the width of all rarer ones.
DRAWN = 10
#: Models that a task holds at once, and grams that it counts before it hands them on.
HELD, COUNTED = 8, 1 << 20
#: Symbols of the class alphabet, a little above the classes in use, and the order of the model.
ALPHABET, ORDER = 40, 4
BOS, SPACE, NEWLINE, LETTER, UPPER, ACCENT, DIGIT, STOP, COMMA, PUNCT, SYMBOL, REST = 0, 1, 2, 3, 29, 30, 32, 33, 34, 35, 36, 37
#: Half width of a band in robust standard deviations, below and above.
BAND_LOW, BAND_HIGH = 3.5, 4.0
#: The same for code points given their classes, above only.
BAND_POINTS = 6.0
CLASS_VARIANCE = 1.0
#: Bins of the log-perplexity histogram per unit; log perplexities lie between 0 and log(ALPHABET) but for rare texts.
BINS = 200
#: Base rules.
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point, worked out once a process."""
    code = np.arange(0x110000, dtype=np.uint64)
    out = (LETTER + (code * np.uint64(0x9E3779B1) >> np.uint64(11)) % np.uint64(26)).astype(np.uint8)
    kinds = {"L": None, "M": None, "N": DIGIT, "P": PUNCT}
    for c in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(c))[0], REST)
        if kind is not None:
            out[c] = kind
    out[0xC0:0x250] = ACCENT
    for group, to in ((" \t\r\x0b\x0c", SPACE), ("\n", NEWLINE), (".", STOP), (",", COMMA), ("!?;:'\"()-", PUNCT), ("#*$%&|<>", SYMBOL)):
        for c in group:
            out[ord(c)] = to
    out[ord("A") : ord("Z") + 1] = UPPER
    out[ord("a") : ord("z") + 1] = LETTER + np.arange(26)
    return out


def languages(docs: DataFrame) -> list[str]:
    """The languages with a model of their own, those of most documents first."""
    counts = docs.groupBy(F.col("lang").cast("string").alias("lang")).count().filter(F.col("lang").isNotNull() & (F.col("count") >= LEAST_DOCUMENTS))
    return [r["lang"] for r in counts.orderBy(F.desc("count"), "lang").collect()][:MODELS]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def printed(text: str, classes: np.ndarray) -> np.ndarray:
    """The code points of a text but for blanks and line ends, whose choice says nothing about the language."""
    own = points(text)
    kinds = classes[own]
    return own[(kinds != SPACE) & (kinds != NEWLINE)]


def grams(text: str, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a text's code points, and the code of the 4-gram that ends at each.

    A run of blanks, or of line ends, is one class: how far apart words are set says nothing about the language.
    """
    own = classes[points(text)]
    again = np.diff(own, prepend=np.uint8(REST)) == 0
    own = own[~(again & ((own == SPACE) | (own == NEWLINE)))]
    led = np.concatenate([np.zeros(ORDER - 1, np.int32), own.astype(np.int32)])
    n = len(own)
    code = led[:n]
    for k in range(1, ORDER):
        code = code * ALPHABET + led[k : k + n]
    return own, code


def summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their counts from several such pairs; few of all possible codes occur."""
    codes, n = (np.concatenate(x) for x in zip(*counts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def counts(docs: DataFrame, known: list[str]) -> DataFrame:
    """model, gram and count over every text; tasks add up before anything is shuffled. The model after the last is shared.

    A gram below 0 is a code point, -1 less it.
    """
    own = {lang: k for k, lang in enumerate(known)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = class_table()
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part in slices(batch, 1 << 21):
                by: dict[int, list[str]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    by.setdefault(own.get(lang, len(own)), []).append(text.as_py() or "")
                for model, texts in by.items():
                    held.setdefault(model, []).append(np.unique(np.concatenate([grams(x, classes)[1] for x in texts]), return_counts=True))
                    n = np.bincount(np.concatenate([printed(x, classes) for x in texts]))
                    held[model].append((-1 - np.flatnonzero(n), n[n > 0]))
                    if sum(len(seen) for seen, _ in held[model]) > 1 << 18:
                        held[model] = [summed(held[model])]
                if sum(len(seen) for pairs in held.values() for seen, _ in pairs) > COUNTED:
                    yield from rows(held)
        yield from rows(held)

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        while held:
            model, pairs = held.popitem()
            seen, n = summed(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), model, np.int32)), pa.array(seen, pa.int64()), pa.array(n, pa.int64())], names=["model", "gram", "n"])

    per_task = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "model int, gram long, n long")
    return per_task.groupBy("model", "gram").agg(F.sum("n").alias("n"))


def gram_counts(docs: DataFrame, known: list[str]) -> DataFrame:
    return counts(docs, known).filter("gram >= 0")


def kneser_ney(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """level, gram, log probability and log back-off of an interpolated modified Kneser-Ney model. gram: distinct 4-grams.

    Levels below the highest use continuation counts: in how many different contexts one class further left a gram
    occurs. The back-off is the weight that a gram leaves to the level below when it is the context.
    """
    order = np.argsort(gram)
    levels = {ORDER: (gram[order], n[order])}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = np.unique(levels[k + 1][0] % ALPHABET**k, return_counts=True)
    found = [(np.zeros(1, np.int64), np.full(1, -math.log(ALPHABET)), np.zeros(1))]
    below = np.full(1, 1 / ALPHABET)
    for k in range(1, ORDER + 1):
        own, count = levels[k]
        n1, n2, n3, n4 = ((count == i).sum() for i in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        rough = [i - (i + 1) * y * more / now if now else 0.5 * i for i, now, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discount = np.array([0.0, *(min(0.95 * i, max(0.05, d)) for i, d in enumerate(rough, 1))])[np.minimum(count, 3)]
        context, at = np.unique(own // ALPHABET, return_inverse=True)
        total = np.bincount(at, count)
        gamma = np.bincount(at, discount) / total
        tail = np.searchsorted(found[-1][0], own % ALPHABET ** (k - 1))
        p = np.maximum(0.0, count - discount) / total[at] + gamma[at] * below[tail]
        found[-1][2][np.searchsorted(found[-1][0], context)] = np.log(gamma)
        found.append((own, np.log(p), np.zeros(len(own))))
        below = p
    level = np.repeat(np.arange(ORDER + 1), [len(x[0]) for x in found])
    return level, *(np.concatenate(c) for c in zip(*found, strict=True))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of the SplitMix64 generator, a bijection on 64-bit words."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key(model, level: int, gram: np.ndarray) -> np.ndarray:
    return mix64((np.asarray(model).astype(np.uint64) << np.uint64(40)) + (np.uint64(level) << np.uint64(32)) + np.asarray(gram).astype(np.uint64))


def code_point_odds(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log probability of each code point, given its class."""
    kinds = class_table()[code]
    return np.log(n / np.bincount(kinds, n)[kinds])


MODEL_ARRAYS = {"keys": "<u8", "logp": "<f4", "backoff": "<f4", "points": "<u4", "odds": "<f4"}


@dataclass
class HashModel:
    """Arrays sorted by hash: keys, log probabilities and log back-off weights; and of one model, code points with their log odds within classes."""

    keys: np.ndarray
    logp: np.ndarray
    backoff: np.ndarray
    points: np.ndarray
    odds: np.ndarray

    @staticmethod
    def of(rows: Iterable[Row]) -> HashModel:
        """Puts models, a row each, together."""
        parts = [[np.frombuffer(r[c], kind) for c, kind in MODEL_ARRAYS.items()] for r in rows]
        keys, logp, backoff, code, odds = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, kind) for kind in MODEL_ARRAYS.values())
        order = np.argsort(keys)
        return HashModel(keys[order], logp[order], backoff[order], code, odds)

    def find(self, model: int, level: int, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = key(model, level, gram)
        at = np.minimum(np.searchsorted(self.keys, want), max(0, len(self.keys) - 1))
        return at, self.keys[at] == want if len(self.keys) else np.zeros(len(want), bool)

    def score(self, model: int, gram: np.ndarray) -> np.ndarray:
        """Log probability of the last class of each 4-gram given the three before it, with back-off where it was not seen."""
        out, weight = np.full(len(gram), np.nan), np.zeros(len(gram))
        for level in range(ORDER, 0, -1):
            at, hit = self.find(model, level, gram % ALPHABET**level)
            new = hit & np.isnan(out)
            out[new] = weight[new] + self.logp[at[new]]
            at, hit = self.find(model, level - 1, gram % ALPHABET**level // ALPHABET)
            weight += np.where(hit, self.backoff[at], 0.0)
        return np.where(np.isnan(out), weight - math.log(ALPHABET), out)


def models(docs: DataFrame, known: list[str]) -> DataFrame:
    """A row for each model of docs (lang, text). A language's counts are bounded, so one task turns them into its arrays."""

    def build(t: pa.Table) -> pa.Table:
        model = t.column("model")[0].as_py()
        codes, n = t.column("gram").to_numpy(), t.column("n").to_numpy()
        level, gram, logp, backoff = kneser_ney(codes[codes >= 0], n[codes >= 0])
        keys = key(model, 0, gram + (level << 32))
        order = np.argsort(keys)
        code = -1 - codes[codes < 0]
        arrays = (keys[order], logp[order], backoff[order], code, code_point_odds(code, n[codes < 0]))
        blobs = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(arrays, MODEL_ARRAYS.values(), strict=True)]
        give_back()
        return pa.Table.from_arrays([pa.array([model], pa.int32()), *blobs], names=["model", *MODEL_ARRAYS])

    return counts(docs, known).groupBy("model").applyInArrow(build, "model int, " + ", ".join(f"{c} binary" for c in MODEL_ARRAYS))


def train(docs: DataFrame, known: list[str]) -> HashModel:
    """The models of a few languages, together."""
    return HashModel.of(models(docs, known).toLocalIterator())


def trained(docs: DataFrame, known: list[str]) -> dict[int, Broadcast]:
    """Every model, broadcast by itself as it comes, so that neither the driver nor a task holds all of them."""
    sc = docs.sparkSession.sparkContext
    return {r["model"]: sc.broadcast(HashModel.of([r])) for r in models(docs, known).toLocalIterator()}


class Scores:
    """Log probabilities of grams, and of code points given their classes, by model. The models used last are held; others are dropped and can be read again."""

    def __init__(self, models: dict[int, Broadcast]):
        self.models, self.held = models, {}

    def of(self, model: int, codes: np.ndarray) -> np.ndarray:
        memo = self.tables(model)[0]
        score = memo[codes]
        if (new := np.isnan(score)).any():
            missing = np.unique(codes[new])
            memo[missing] = self.models[model].value.score(model, missing.astype(np.int64))
            score = memo[codes]
        return score

    def of_points(self, model: int, code: np.ndarray) -> np.ndarray:
        tables = self.tables(model)
        if tables[1] is None:
            found = self.models[model].value
            tables[1] = np.zeros(int(found.points.max(initial=0)) + 1, np.float32)
            tables[1][found.points] = found.odds
        return tables[1][code]

    def tables(self, model: int) -> list:
        found = self.held.pop(model, None) or [np.full(ALPHABET**ORDER, np.nan, np.float32), None]
        while len(self.held) >= HELD:
            self.drop(next(iter(self.held)))
        self.held[model] = found
        return found

    def drop(self, model: int) -> None:
        del self.held[model]
        vars(self.models[model]).pop("_value", None)  # what a worker keeps of a broadcast that it has read


def repeats(ids: np.ndarray, doc: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Whether each word lies in a window of `width` words that occurs again in its document. ids: words as numbers."""
    n = len(ids) - width + 1
    covered = np.zeros(len(ids), bool)
    if n < 2:
        return covered
    hashed, own = mix64(ids.astype(np.uint64) + np.uint64(1)), mix64(doc[:n].astype(np.uint64) << np.uint64(32))
    total = own.copy()
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n]
    inside = np.flatnonzero(doc[:n] == doc[width - 1 :])
    inside = inside[np.argsort(total[inside], kind="stable")]
    a, b = inside[:-1], inside[1:]
    same = total[a] == total[b]
    a, b = a[same], b[same]
    equal = doc[a] == doc[b]
    for k in range(width):
        equal &= ids[a + k] == ids[b + k]
    step = np.zeros(len(ids) + 1, np.int32)
    starts = np.unique(np.concatenate([a[equal], b[equal]]))
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0


def measure(docs: DataFrame, models: dict[int, Broadcast], known: list[str], keep: list[str]) -> DataFrame:
    """The columns keep, the base counts, model, rare (a language without a model of its own), n_classes, logppl and logodds of each document.

    logppl is the mean over classes (null for an empty text), logodds that over code points given their classes (null without words).
    The two add up to the whole text's, as a class and the choice within it make up a code point.
    """
    given = docs.select(*keep, F.col("lang").cast("string").alias("_lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    schema = extended(given.drop("_lang", "_text").schema, f"{COUNTS}, model int, rare string, n_classes long, logppl double, logodds double")
    own_model = {lang: k for k, lang in enumerate(known)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = class_table()
        scores = Scores(models)
        for batch in batches:
            for part in slices(batch, 1 << 21):
                yield rows(part, classes, scores)
        for model in list(scores.held):
            scores.drop(model)
        give_back()

    def rows(part: pa.RecordBatch, classes: np.ndarray, scores: Scores) -> pa.RecordBatch:
        texts, langs = part.column(part.num_columns - 1).to_pylist(), part.column(part.num_columns - 2).to_pylist()
        using = [own_model.get(lang, len(own_model)) for lang in langs]
        cols: dict[str, list] = {c: [] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_classes")}
        words: list[bytes] = []
        coded: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            raw = text.encode()
            own = raw.split()
            words += own
            kinds, codes = grams(text, classes)
            coded.append((codes, printed(text, classes)))
            tally = np.bincount(kinds, minlength=ALPHABET)
            lines = [x for x in raw.split(b"\n") if x.strip()]
            for col, value in zip(cols.values(), (len(own), len(kinds) - int(tally[SPACE] + tally[NEWLINE]), int(tally[SYMBOL]), len(lines) - len(set(lines)), len(kinds)), strict=True):
                col.append(value)
        logppl: list[float | None] = [None] * len(texts)
        logodds: list[float | None] = [None] * len(texts)
        for k in sorted(range(len(texts)), key=using.__getitem__):  # a model's texts together
            codes, own = coded[k]
            if len(codes):
                logppl[k] = -float(scores.of(using[k], codes).mean(dtype=np.float64))
            if len(own):
                logodds[k] = -float(scores.of_points(using[k], own).mean(dtype=np.float64))
        ids = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False) if words else np.empty(0, np.int32)
        doc = np.repeat(np.arange(len(texts)), cols["n_words"])
        again = np.bincount(doc[repeats(ids, doc)], minlength=len(texts))
        made = [pa.array(cols[c], pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")]
        rare = [lang if model == len(own_model) else None for lang, model in zip(langs, using, strict=True)]
        made += [pa.array(again, pa.int64()), pa.array(using, pa.int32()), pa.array(rare, pa.string()), pa.array(cols["n_classes"], pa.int64()), pa.array(logppl, pa.float64()), pa.array(logodds, pa.float64())]
        return pa.RecordBatch.from_arrays([*part.columns[:-2], *made], names=schema.names)

    return given.mapInArrow(run, schema)


def quartiles(rows: DataFrame, by: str, values: dict[str, Column]) -> DataFrame:
    """_by and, for each name, a struct of documents, mid (median) and dev (robust deviation), from histograms over all documents (bounded size)."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), v.alias("v")) for name, v in values.items())))
    bins = rows.filter(F.col("n_words") >= MIN_WORDS).select(by, each.alias("x")).filter("x.v IS NOT NULL")
    hist = bins.groupBy(by, "x.name", F.least(F.lit(20 * BINS), F.floor(F.col("x.v") * BINS)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by, "name")
    upto = hist.select(by, "name", "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("all"))
    at = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) + 0.5) / BINS
    spread = F.greatest((at(0.75) - at(0.25)) / 1.349, F.lit(1 / BINS))
    found = upto.groupBy(by, "name").agg(F.struct(F.first("all").alias("documents"), at(0.5).alias("mid"), spread.alias("dev")).alias("q"))
    return found.groupBy(F.col(by).alias(f"_{by}")).agg(*(F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in values))


def with_bands(measured: DataFrame, shared: int) -> DataFrame:
    """Adds ppl and odds, structs of mid and dev: median and robust deviation of logppl and logodds per language; null where no document gives them.

    Languages that share a model have their own medians, drawn to the model's by how few their documents are, and the deviation from
    these medians.
    """
    values = {"ppl": F.col("logppl"), "odds": F.col("logodds")}
    per_model = quartiles(measured, "model", values)
    own = quartiles(measured.filter("rare IS NOT NULL"), "rare", {f"own_{name}": v for name, v in values.items()})

    def drawn(name: str) -> Column:
        mid, q = F.col(f"{name}.mid"), F.col(f"own_{name}")
        return F.coalesce(mid + (q["mid"] - mid) * q["documents"] / (q["documents"] + DRAWN), mid)

    def centred(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(per_model), F.col("model") == F.col("_model"), "left").drop("_model")
        rare = rows.filter("rare IS NOT NULL").join(own, F.col("rare") == F.col("_rare"), "left")
        rare = rare.withColumns({name: F.struct(F.col(f"{name}.documents"), drawn(name).alias("mid"), F.col(f"{name}.dev")) for name in values})
        return rows.filter("rare IS NULL").unionByName(rare.select(*rows.columns))

    off = quartiles(centred(measured.filter(F.col("model") == shared)), "model", {f"off_{name}": v - F.col(f"{name}.mid") for name, v in values.items()})
    out = centred(measured).join(F.broadcast(off), F.col("model") == F.col("_model"), "left")
    whole = {name: F.struct(F.col(f"{name}.mid"), F.coalesce(F.col(f"off_{name}.dev"), F.col(f"{name}.dev")).alias("dev")) for name in values}
    return out.withColumns(whole).drop("_model", *(f"off_{name}" for name in values))


def judge(measured: DataFrame, shared: int) -> DataFrame:
    """Adds base_failed, perplexity, lower, upper, point_perplexity, point_upper and kept. Without a band, or without a perplexity, only base rules count.

    Code points that are rarer in their classes than is usual in the language count against a text; more usual ones do not.
    """
    # the deviation of a mean over few classes or code points is larger, by about the variance of one's log probability
    wide = lambda q, n: F.sqrt(F.col(f"{q}.dev") * F.col(f"{q}.dev") + F.lit(CLASS_VARIANCE) / F.greatest(F.col(n), F.lit(1)))
    low, high = (F.col("ppl.mid") + side * wide("ppl", "n_classes") for side in (-BAND_LOW, BAND_HIGH))
    end = F.col("odds.mid") + BAND_POINTS * wide("odds", "word_chars")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    limits = {"lower": F.exp(low), "upper": F.exp(high), "point_upper": F.exp(end)}
    out = with_bands(measured, shared).withColumns({"base_failed": failed, "perplexity": F.exp("logppl"), "point_perplexity": F.exp("logodds"), **limits})
    inside = F.coalesce((F.col("logppl") >= low) & (F.col("logppl") <= high), F.lit(True)) & F.coalesce(F.col("logodds") <= end, F.lit(True))
    return out.withColumn("kept", ~failed & inside).drop("ppl", "odds", "rare")


def quality(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Trains on docs (lang, text), measures every document and judges it; keep names the columns that are carried.

    The carried columns and the measures are written once, so that no text is scored twice.
    """
    known = languages(docs)
    models = trained(docs, known)
    measured = stored(measure(docs, models, known, keep), "quality")
    for model in models.values():
        model.destroy()
    return judge(measured, len(known))


def op1_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict for every document.

    A null text has no words, so it fails; null and rare languages share one model, in which each has a band of its own; repeated rows are judged alike and
    count as often as they occur; an empty table gives no rows; other columns are ignored. Very long texts are measured in
    whole. A perplexity on a band's edge is kept.
    """
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["doc_id"])
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*base, "perplexity", "lower", "upper", "point_perplexity", "point_upper")


ORACLE: dict[str, str] = {}
