"""Computation graphs: documents, binding names to indices, and evaluation levels.

A graph has at most MAX_NODES nodes, which bounds the tables and arrays that its plans broadcast.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.activations import ACTIVATIONS, ALIASES

MAX_NODES = 65536
#: Edge roles of conditional nodes.
STANDARD, CONDITION, NEGATIVE, POSITIVE = 0, 1, 2, 3
ROLES = {"condition": CONDITION, "negative": NEGATIVE, "positive": POSITIVE}
DOCUMENT = (
    "input INT, output INT, neurons ARRAY<STRUCT<type: STRING, uuid: STRING, bias: DOUBLE, squash: STRING>>, "
    "synapses ARRAY<STRUCT<fromUUID: STRING, toUUID: STRING, weight: DOUBLE, type: STRING>>, semanticVersion STRING, forwardOnly BOOLEAN"
)
NEURONS = "idx INT, kind STRING, bias DOUBLE, squash STRING, constant BOOLEAN"
SYNAPSES = "ord INT, from_idx INT, to_idx INT, weight DOUBLE, role INT"


class NetworkError(ValueError):
    """A graph document that cannot be bound."""


@dataclass(frozen=True)
class Neuron:
    bias: float = 0.0
    squash: str = "IDENTITY"
    constant: bool = False


@dataclass
class Network:
    """Nodes 0 to inputs - 1 are inputs; neurons follow in evaluation order; the last `outputs` are the outputs.

    edges: (from, to, weight, role), in the order that decides ties. An edge from a node that is not evaluated before its target
    reads 0, as records are independent of each other.
    """

    inputs: int
    outputs: int
    neurons: list[Neuron]
    edges: list[tuple[int, int, float, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.size > MAX_NODES:
            raise NetworkError(f"{self.size} nodes; at most {MAX_NODES} are allowed")

    @property
    def size(self) -> int:
        return self.inputs + len(self.neurons)

    def kind(self, idx: int) -> str:
        if idx < self.inputs:
            return "input"
        if self.neurons[idx - self.inputs].constant:
            return "constant"
        return "output" if idx >= self.size - self.outputs else "hidden"

    def inbound(self) -> dict[int, list[tuple[int, float, int]]]:
        """Edges into each neuron: (from, weight, role), those that read evaluated nodes."""
        out: dict[int, list[tuple[int, float, int]]] = {}
        for a, b, w, role in self.edges:
            out.setdefault(b, []).append((a, w, role))
        return out

    def levels(self) -> list[list[int]]:
        """Neurons by the longest way from an input; each level needs only those before it."""
        level, inbound = dict.fromkeys(range(self.inputs), 0), self.inbound()
        for idx in range(self.inputs, self.size):
            level[idx] = 1 + max((level[a] for a, _, _ in inbound.get(idx, ()) if a < idx), default=0)
        out: list[list[int]] = [[] for _ in range(max(level.values(), default=0))]
        for idx in range(self.inputs, self.size):
            out[level[idx] - 1].append(idx)
        return out

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        neurons = [(self.inputs + k, self.kind(self.inputs + k), float(n.bias), n.squash, n.constant) for k, n in enumerate(self.neurons)]
        edges = [(k, a, b, float(w), role) for k, (a, b, w, role) in enumerate(self.edges)]
        return spark.createDataFrame(neurons, NEURONS), spark.createDataFrame(edges, SYNAPSES)


def parse_document(text: str) -> dict:
    """A graph document; unknown keys are ignored, missing mandatory ones are an error."""
    doc = json.loads(text)
    for key in ("input", "output", "neurons", "synapses"):
        if key not in doc:
            raise NetworkError(f"missing {key}")
    return doc


def bind(doc: dict) -> Network:
    """Resolves names. Later neurons replace earlier ones of the same name; edges to names that no neuron has are dropped."""
    ni = doc["input"]
    declared = sum(n["type"] == "output" for n in doc["neurons"])
    if declared != doc["output"]:
        raise NetworkError(f"{declared} output neurons; {doc['output']} are declared")
    index = {f"input-{k}": k for k in range(ni)} | {n["uuid"]: ni + k for k, n in enumerate(doc["neurons"])}
    neurons = []
    for n in doc["neurons"]:
        name = n.get("squash") or "IDENTITY"
        if name not in ALIASES:
            raise NetworkError(f"unknown activation {name}")
        neurons.append(Neuron(n["bias"], ACTIVATIONS[ALIASES[name]].name, n["type"] == "constant"))
    edges = []
    for s in doc["synapses"]:
        to = index.get(s["toUUID"], -1)
        if to < ni:
            continue
        if s["fromUUID"] not in index:
            raise NetworkError(f"unknown source {s['fromUUID']}")
        edges.append((index[s["fromUUID"]], to, s["weight"], ROLES.get(s.get("type") or "", STANDARD)))
    return Network(ni, doc["output"], neurons, edges)


def bind_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Many documents at once: docs has net_id and doc (DOCUMENT). Gives neurons and synapses with their indices, by joins.

    Edges with an unknown source keep a null from_idx; edges to unknown names or inputs are dropped.
    """
    n = docs.select("net_id", F.col("doc.input").alias("ni"), F.posexplode("doc.neurons").alias("pos", "n"))
    neurons = n.select("net_id", (F.col("ni") + F.col("pos")).alias("idx"), F.col("n.type").alias("kind"), F.col("n.uuid").alias("uuid"), F.col("n.bias").alias("bias"), F.coalesce("n.squash", F.lit("IDENTITY")).alias("squash"))
    inputs = docs.select("net_id", F.explode(F.sequence(F.lit(0), F.col("doc.input") - 1)).alias("idx")).select("net_id", "idx", F.concat(F.lit("input-"), F.col("idx")).alias("uuid"))
    names = neurons.groupBy("net_id", "uuid").agg(F.max("idx").alias("idx")).unionByName(inputs)
    s = docs.select("net_id", F.col("doc.input").alias("ni"), F.posexplode("doc.synapses").alias("ord", "s")).select("net_id", "ni", "ord", "s.*")
    source = names.select("net_id", F.col("uuid").alias("fromUUID"), F.col("idx").alias("from_idx"))
    target = names.select("net_id", F.col("uuid").alias("toUUID"), F.col("idx").alias("to_idx"))
    role = F.coalesce(*(F.when(F.col("type") == k, F.lit(v)) for k, v in ROLES.items()), F.lit(STANDARD))
    bound = s.join(target, ["net_id", "toUUID"]).filter("to_idx >= ni").join(source, ["net_id", "fromUUID"], "left")
    return neurons, bound.select("net_id", "ord", "from_idx", "to_idx", "weight", role.alias("role"))


#: What can be wrong with a document, in the order in which it is looked for.
FAULTS = ("malformed", "output_count", "too_many_nodes", "unknown_activation", "unknown_source")


def document_faults(docs: DataFrame) -> DataFrame:
    """net_id, fault, place and name of everything that keeps documents (net_id, doc) from being bound.

    place is the neuron's or the edge's in its list, name what is not known; for counts, name is the number found. A neuron
    without an activation is IDENTITY; edges to names that no neuron has are no fault, as they are dropped.
    """
    fault = lambda d, kind, place, name: d.select("net_id", F.lit(FAULTS.index(kind)).alias("_at"), F.lit(kind).alias("fault"), place.cast("int").alias("place"), name.cast("string").alias("name"))
    none = F.lit(None)
    whole = F.col("doc").isNotNull() & F.col("doc.input").isNotNull() & F.col("doc.output").isNotNull() & F.col("doc.neurons").isNotNull() & F.col("doc.synapses").isNotNull()
    whole = whole & (F.col("doc.input") >= 0) & F.forall("doc.neurons", lambda n: n["uuid"].isNotNull() & n["type"].isNotNull() & n["bias"].isNotNull()) & F.forall("doc.synapses", lambda e: e["fromUUID"].isNotNull() & e["toUUID"].isNotNull() & e["weight"].isNotNull())
    checked = docs.select("net_id", "doc", F.coalesce(whole, F.lit(False)).alias("whole"))
    good = checked.filter("whole")
    outputs = F.size(F.filter("doc.neurons", lambda n: n["type"] == "output"))
    nodes = F.col("doc.input") + F.size("doc.neurons")
    neurons = good.select("net_id", F.posexplode("doc.neurons").alias("pos", "n")).filter(F.col("n.squash").isNotNull() & ~F.col("n.squash").isin(*ALIASES))
    edges = good.select("net_id", F.col("doc.input").alias("ni"), F.posexplode("doc.synapses").alias("pos", "e")).select("net_id", "ni", "pos", "e.fromUUID", "e.toUUID")
    known = good.select("net_id", F.explode(F.transform("doc.neurons", lambda n: n["uuid"])).alias("uuid")).distinct()
    number = F.regexp_extract("fromUUID", r"^input-(0|[1-9][0-9]{0,8})$", 1)
    from_neuron = ~((number != "") & F.coalesce(number.try_cast("int") < F.col("ni"), F.lit(False)))
    used = edges.filter(from_neuron).join(known.withColumnRenamed("uuid", "toUUID"), ["net_id", "toUUID"], "left_semi")
    lost = used.join(known.withColumnRenamed("uuid", "fromUUID"), ["net_id", "fromUUID"], "left_anti")
    found = [
        fault(checked.filter("NOT whole"), "malformed", none, none),
        fault(good.filter(outputs != F.col("doc.output")), "output_count", none, outputs),
        fault(good.filter(nodes > MAX_NODES), "too_many_nodes", none, nodes),
        fault(neurons, "unknown_activation", F.col("pos"), F.col("n.squash")),
        fault(lost, "unknown_source", F.col("pos"), F.col("fromUUID")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def bind_checked(docs: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Neurons and synapses of the documents that can be bound, and a row for each fault of the others.

    With strict, the first faulty document that is met ends the job with an error instead.
    """
    faults = document_faults(docs)
    if strict:
        first = faults.groupBy("net_id").agg(F.min(F.struct("_at", "place", "fault", "name")).alias("f"))
        told = F.concat(F.lit("net "), F.col("_f.net_id").cast("string"), F.lit(": "), F.col("_f.f.fault"), F.lit(" "), F.coalesce("_f.f.name", F.lit("")))
        joined = docs.join(first.select(F.struct("net_id", "f").alias("_f")), F.col("net_id").eqNullSafe(F.col("_f.net_id")), "left")
        good = joined.select("net_id", F.when(F.col("_f").isNull(), F.col("doc")).otherwise(F.raise_error(told)).alias("doc"))
    else:
        good = docs.join(faults.select(F.col("net_id").alias("_id")).distinct(), F.col("net_id").eqNullSafe(F.col("_id")), "left_anti")
    return *bind_tables(good), faults.drop("_at")


def document_json(docs: DataFrame, pretty: bool = False) -> DataFrame:
    """net_id and the document as JSON text in fixed field order, without absent optional fields."""
    options = {"pretty": "true"} if pretty else {}
    return docs.select("net_id", F.to_json("doc", options).alias("json"))
