"""Personal data: strict base rules, and boosted trees over high-recall candidates.

Everything is DataFrame functions and Spark ML. Matches of a pattern are placed in a text by the gaps that splitting by
the same pattern leaves, in sums over blocks, so that many matches cost little more than one each. Repeated groups in
patterns are possessive or bounded, which keeps the matcher's stack flat on texts of any length. Candidate generators propose spans, overlapping ones too. A candidate's label is whether its
normal form (separators written out, a card's issuer and check digit, a phone's grouping or the word before it) is of its
kind; format and context are its features. Base spans rewritten in loose forms are further positives to train on. All
candidates of all documents are counted by their features, which are few, so that the table to train on is bounded.
Half of the documents train the trees; the other half gives, for each kind, the lowest score at which PRECISION of the
candidates found beside the base spans are of their kind. Where it has none of a kind, rewritten spans of that half take
their place: the lowest of their scores above that of every candidate that is not of the kind. Candidates at or above the
threshold are redacted along with the base spans. The trees are applied as one expression of the features, so that no text is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

KINDS = ("email", "ip", "card", "phone")
#: Precision that a kind's threshold must reach on held-out documents, and the trees' number and depth.
PRECISION, TREES, DEPTH = 0.9, 10, 3
LOCAL, OCTET = "A-Za-z0-9._%+-", "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Pattern:
    """kind: index in KINDS; near: a cheap test that a text may match; find: the pattern; strict: whether base rules use it."""

    kind: int
    near: str
    find: str
    strict: bool


#: A match of a rule starts where a run of its characters starts, or where the last match ended (\G), so each run is tried once.
PATTERNS = (
    Pattern(0, "@", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True),
    Pattern(1, r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]+){3}", True),
    # a chain of digits with single separators is matched as a whole; only those of 16 to 19 digits can pass
    Pattern(2, r"[0-9](?:[\x20-]?[0-9]){15}", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])", True),
    Pattern(3, r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", True),
    Pattern(0, r"(?i)[\[({]\s?at\s?[\])}]|\sat\s\S++\sdot\s", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\s?(?:[\[({]\s?at\s?[\])}]|\sat\s)\s?[a-z0-9-]++(?:(?:\.|\s\.\s|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)[a-z0-9-]++)++", False),
    Pattern(2, r"[0-9](?:[\x20.-]?[0-9]){12}", r"(?<![0-9A-Za-z])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9A-Za-z])", False),
    Pattern(3, r"[0-9][\x20.)-]{1,2}[0-9]{3}", r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9A-Za-z-])", False),
)
#: Words before a span that tell of its kind.
CUES = r"(?i)mail|contact|write|tel|phone|call|fax|mobile|card|visa|pay|account|\bip\b|host|server|address"
#: Last labels of domains spelled without brackets, which must be told from prose; words right before a phone.
TOP = "com|org|net|edu|gov|info|biz|io|co|dev|app|eu|uk|de|fr|es|nl|ch|ca|au|jp|pl|se|dk|br|ru|cn"
CALL = r"(?i)(?:tel|phone|call|fax|mobile|cell)[^0-9]*$"
#: issuers' first digits and lengths of cards.
ISSUED = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11}|(?:5[1-5]|2[2-7])[0-9]{14}|6[0-9]{15,18})$"
#: Matches in a block of offsets.
BLOCK = 256
SPANS = "array<struct<kind: int, start: int, end: int, s: string, lead: string, next: string, valid: boolean>>"
FEATURES = ("kind", "n_digits", "spaced", "dashed", "dotted", "bracketed", "spelled", "groups", "before", "after", "cue", "plus")


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(d: Column, i: Column) -> Column:
        v = d.cast("int")
        return F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    each = F.transform(F.regexp_extract_all(F.reverse(number), F.lit("[0-9]"), F.lit(0)), value)
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def passes(kind: int, s: Column) -> Column:
    if kind == 1:
        return s.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == 2:
        return F.length(digits(s)).between(16, 19) & luhn(digits(s))
    return F.length(digits(s)).between(8, 15) if kind == 3 else F.lit(True)


def normal_email(s: Column) -> Column:
    """An e-mail address with its separators written out."""
    at = F.regexp_replace(s, r"(?i)\s?[\[({]\s?at\s?[\])}]\s?|\sat\s", "@")
    return F.regexp_replace(at, r"(?i)\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s|\s\.\s", ".")


def loose_passes(kind: int, s: Column, lead: Column) -> Column:
    """Whether a loose candidate after the text lead is of its kind, by its normal form."""
    if kind == 0:
        mail = normal_email(s)
        form = mail.rlike(rf"^[{LOCAL}]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,24}}$")
        return form & (s.rlike(r"[\[({]") | (s.rlike(r"(?i)\sdot\s") & mail.rlike(rf"(?i)\.(?:{TOP})$")))
    if kind == 2:
        return digits(s).rlike(ISSUED) & luhn(digits(s))
    grouped = s.rlike(r"^\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$")
    return F.length(digits(s)).between(8, 15) & (grouped | lead.rlike(CALL))


def loosened(c: Column) -> Column:
    """A base span (kind, s) in the form of a loose one, or null."""
    style = F.pmod(F.xxhash64(c["s"]), F.lit(3))
    sep = lambda word: F.when(style == 0, f" [{word}] ").when(style == 1, f"({word})").otherwise(f" {word} ")
    mail = F.replace(F.concat(F.substring_index(c["s"], "@", 1), sep("at"), F.replace(F.substring_index(c["s"], "@", -1), F.lit("."), sep("dot"))), F.lit("@"), F.lit(""))
    card = F.regexp_replace(digits(c["s"]), "([0-9]{4})(?=[0-9])", "$1.")
    phone = F.regexp_replace(c["s"], r"^\+[0-9]{1,3}(?![0-9])[\x20.-]*", "")
    made = {p.kind: p.find for p in PATTERNS if not p.strict}
    new = {0: mail, 2: card, 3: phone}
    out = F.lit(None).cast("string")
    for kind, find in made.items():
        out = F.when((c["kind"] == kind) & new[kind].rlike(f"^(?:{find})$"), new[kind]).otherwise(out)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, and stands once in the plan however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda acc, x: acc + x)


def blocks(a: Column) -> Column:
    """An array in slices of BLOCK; an empty one has one empty slice."""
    return let(a, lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, BLOCK)))


def before(at: Column, slices: Column, sums: Column) -> tuple[Column, Column]:
    """What blocks() gave of the entries before place `at`: the blocks' sums before its own, and the entries before it in its own."""
    b = F.floor(at / BLOCK).cast("int")
    return F.slice(sums, F.lit(1), b), F.slice(F.get(slices, b), F.lit(1), at % BLOCK)


def features(kind: Column, s: Column, lead: Column, next_: Column) -> dict[str, Column]:
    """Format and context of a candidate s after the text lead and before the character next_, as FEATURES."""
    side = lambda ch: F.when(ch == "", 0).when(ch.rlike(r"\s"), 1).when(ch.rlike("[A-Za-z0-9]"), 2).otherwise(3)
    flag = lambda text: s.contains(text).cast("int")
    return {
        "kind": kind, "n_digits": F.least(F.length(digits(s)), F.lit(20)), "spaced": flag(" "), "dashed": flag("-"), "dotted": flag("."), "bracketed": s.rlike(r"[\[({]").cast("int"),
        "spelled": s.rlike(r"(?i)\sdot\s").cast("int"), "groups": F.least(F.size(F.split(s, "[^0-9A-Za-z]+")), F.lit(8)), "before": side(F.right(lead, F.lit(1))), "after": side(next_),
        "cue": lead.rlike(CUES).cast("int"), "plus": s.startswith("+").cast("int"),
    }


def matches(p: Pattern) -> Column:
    """All matches of a pattern in text, as (kind, start, end, s, lead, next, valid) in order."""

    def of(m: Column, g: Column) -> Column:
        def one(slices: Column, sums: Column):
            def span(x: Column, i: Column) -> Column:
                gap = F.get(g, i)
                lead, next_ = F.right(gap, F.lit(32)), F.left(F.get(g, i + 1), F.lit(1))
                valid = passes(p.kind, x) if p.strict else loose_passes(p.kind, x, F.right(lead, F.lit(24)))
                start = sum(map(total, before(i, slices, sums)), F.length(gap))
                made = lambda at: F.struct(F.lit(p.kind).alias("kind"), at.alias("start"), (at + F.length(x)).alias("end"), x.alias("s"), lead.alias("lead"), next_.alias("next"), valid.alias("valid"))
                return let(start, made)

            return F.transform(m, span)

        lengths = F.zip_with(m, g, lambda x, gap: F.coalesce(F.length(x), F.lit(0)) + F.length(gap))
        return let(blocks(lengths), lambda slices: let(F.transform(slices, total), lambda sums: one(slices, sums)))

    near = F.col("text").contains(p.near) if p.near == "@" else F.col("text").rlike(p.near)
    found = let(F.regexp_extract_all("text", F.lit(p.find), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split("text", p.find, -1), lambda g: of(m, g))))
    return F.coalesce(F.when(near, found), F.array().cast(SPANS))


def placed(docs: DataFrame) -> DataFrame:
    """Adds every and loose, matches of strict and of loose patterns by kind and start, base (those of every that are valid)
    and free (those of loose that no base span overlaps). text has no nulls."""
    docs = docs.withColumns({"every": F.concat(*(matches(p) for p in PATTERNS if p.strict)), "loose": F.concat(*(matches(p) for p in PATTERNS if not p.strict))})
    docs = docs.withColumn("base", F.filter("every", lambda x: x["valid"]))
    meets = lambda b, x: (b["start"] < x["end"]) & (b["end"] > x["start"])

    def free(near: Column) -> Column:
        return F.filter("loose", lambda x: ~F.exists(near, lambda b: meets(b, x) & F.exists(b["of"], lambda y: meets(y, x))))

    # base spans in blocks of neighbours, each with the first start and the last end
    ordered = F.array_sort(F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    near = F.transform(blocks(ordered), lambda b: F.struct(F.array_min(b["start"]).alias("start"), F.array_max(b["end"]).alias("end"), b.alias("of")))
    return docs.withColumn("free", F.when((F.size("base") > 0) & (F.size("loose") > 0), let(near, free)).otherwise(F.col("loose")))


def counted(found: DataFrame) -> DataFrame:
    """fold, made, extra, FEATURES, label and weight: how many candidates have these features.

    made tells rewritten base spans, which are there to train on; extra tells candidates beside the base spans.
    """
    fold = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).cast("int")
    rows = found.select(fold.alias("fold"), "every", "free")
    tagged = lambda c, extra: F.transform(c, lambda x: F.struct(x.alias("x"), F.lit(extra).alias("extra")))
    rows = rows.select("fold", F.explode(F.concat(tagged("every", False), tagged("free", True))).alias("c")).select("fold", "c.extra", "c.x.*")
    # a base span is trained on in a loose form, all others as they are
    made = F.col("valid") & ~F.col("extra")
    rows = rows.withColumn("made", made).withColumn("s", F.when(made, loosened(F.struct("kind", "s"))).otherwise(F.col("s"))).filter("s IS NOT NULL")
    own = features(F.col("kind"), F.col("s"), F.col("lead"), F.col("next"))
    rows = rows.select("fold", "made", "extra", *(c.alias(name) for name, c in own.items()), F.col("valid").cast("double").alias("label"))
    return rows.groupBy("fold", "made", "extra", *FEATURES, "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def margin(model: GBTClassificationModel):
    """The trees as a function from a struct of features to its score."""

    def value(node, x: dict[str, Column]) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(x[FEATURES[split.featureIndex()]] <= F.lit(float(split.threshold())), value(node.leftChild(), x)).otherwise(value(node.rightChild(), x))

    roots = [(w, t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees, strict=True)]

    def score(x: Column) -> Column:
        own = {name: x[name] for name in FEATURES}
        return F.round(sum((value(root, own) * F.lit(float(w)) for w, root in roots), F.lit(0.0)), 6)

    return score


def thresholds(counts: DataFrame, score: Callable[[Column], Column]) -> dict[int, float]:
    """The lowest score of each kind that selects; a kind without one selects nothing."""
    judged = counts.filter("extra OR (made AND fold = 1)").select("kind", "fold", "made", score(F.struct(*FEATURES)).alias("score"), "weight", "label")
    rows = judged.groupBy("kind", "fold", "made", "score").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("good")).collect()  # as many as scores of distinct features
    limits: dict[int, float] = {}
    for kind in {r["kind"] for r in rows}:
        own = [r for r in rows if r["kind"] == kind]
        n = good = 0.0
        for r in sorted((r for r in own if r["fold"] == 1 and not r["made"]), key=lambda r: -r["score"]):
            n, good = n + r["n"], good + r["good"]
            if good >= PRECISION * n:
                limits[kind] = r["score"]
        if not good:
            wrong = max((r["score"] for r in own if not r["made"] and r["good"] < r["n"]), default=float("-inf"))
            above = [r["score"] for r in own if r["made"] and r["score"] > wrong]
            if above:
                limits[kind] = min(above)
    return limits


def selector(counts: DataFrame):
    """A function from kind and features to whether the trees select the candidate, or None where there is nothing to learn."""
    labels = {r["label"]: r["n"] for r in counts.filter("fold = 0").groupBy("label").agg(F.sum("weight").alias("n")).collect()}  # two rows at most
    if set(labels) != {0.0, 1.0}:
        return None
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(counts.filter("fold = 0"))
    score = margin(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, weightCol="weight", seed=1).fit(train.select("features", "label", "weight").coalesce(1)))
    limits = thresholds(counts, score)

    def chosen(x: Column) -> Column:
        def reached(f: Column) -> Column:
            return let(score(f), lambda v: F.coalesce(*(F.when(f["kind"] == k, v >= limit) for k, limit in sorted(limits.items())), F.lit(False)))

        return let(F.struct(*(c.alias(name) for name, c in features(x["kind"], x["s"], x["lead"], x["next"]).items())), reached)

    return chosen if limits else None


def with_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) with base and spans: arrays of (kind, start, end) by kind and start."""
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": own})
    select = selector(stored(counted(placed(keyed.select("doc_id", "text"))), "pii-counts"))
    found = placed(keyed)
    extra = F.filter("free", select) if select else F.slice("free", 1, 0)
    plain = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    found = found.withColumns({"base": plain("base"), "extra": plain(extra)})
    return found.withColumn("spans", F.array_sort(F.concat("base", "extra"))).drop("every", "loose", "free", "extra")


def written(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or what of it no earlier span took, replaced by its kind in angle brackets.

    Pieces are cut from 4 bytes a code point, where a place is found without reading what is before it.
    """
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def of(ordered: Column, wide: Column, cut: Column, ends: Column) -> Column:
        piece = lambda a, b: F.decode(F.substring(wide, 4 * a + 1, 4 * F.greatest(F.lit(0), b - a)), "UTF-32")

        def one(x: Column, i: Column) -> Column:
            blocks_, own = before(i, cut, ends)
            end = F.greatest(F.array_max(blocks_), F.array_max(own["end"]), F.lit(0))
            return let(end, lambda at: F.when(x["end"] <= at, "").otherwise(F.concat(piece(at, x["start"]), F.element_at(names, x["kind"] + 1))))

        return F.concat(F.array_join(F.transform(ordered, one), ""), piece(F.coalesce(F.array_max(ends), F.lit(0)), F.length(text)))

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    last = lambda cut: F.transform(cut, lambda b: F.array_max(b["end"]))
    return let(ordered, lambda o: let(F.encode(text, "UTF-32"), lambda w: let(blocks(o), lambda cut: let(last(cut), lambda ends: of(o, w, cut, ends)))))


def op10_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document.

    A null text is empty, a null doc_id is a value of its own, repeated rows get equal results, an empty table gives no
    rows and other columns are ignored. Very long texts, labels and numbers of matches are worked on in whole. Of equal
    scores, all or none reach a threshold. Where candidates are all of one label, no tree is trained and only base spans
    stay. n_spans counts all spans.
    """
    out = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda x: x["kind"])
    n = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *n, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


ORACLE: dict[str, str] = {}
