"""Evidence, notes and ids found anywhere inside nested JSON documents."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from signalloom.functions.ids import stable_id
from signalloom.functions.text import as_col, infer_type, nonblank, slug

COLLECTIONS = ("evidence", "evidences", "sources", "findings")
STATEMENT_KEYS = ("statement", "summary", "description", "finding", "title")
COMPANY_KEYS = ("company", "company_id", "company_name", "canonical_name")
UUID_PATTERN = r"(?i)^(urn:)?(uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+', re.S)
_KINDS = {"{": "OBJECT", "[": "ARRAY", '"': "STRING"}


@dataclass(frozen=True)
class Find:
    """Which nodes of a document are wanted; an empty condition holds for all.

    ``key``: the node's own member name; ``inside``: the innermost member name at or above it; both compared
    folded if ``folded``. ``any_member`` and ``all_members`` ask for members of an object. Below a node that is
    found nothing is looked for if ``closed``. ``listed`` asks for elements of lists.
    """

    kinds: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    inside: tuple[str, ...] = ()
    any_member: tuple[str, ...] = ()
    all_members: tuple[str, ...] = ()
    folded: bool = False
    closed: bool = False
    listed: bool = False

    def _named(self, name: str | None, wanted: tuple[str, ...]) -> bool:
        return not wanted or (name is not None and (name.casefold() if self.folded else name) in wanted)

    def holds(self, node: "Node") -> bool:
        return (
            (not self.kinds or node.kind in self.kinds) and self._named(node.key, self.key) and self._named(node.inside, self.inside)
            and not (self.listed and node.key is not None) and (not self.any_member or any(m in node.members for m in self.any_member)) and all(m in node.members for m in self.all_members)
        )


class Node:
    """A value of a JSON text by its place in it."""

    __slots__ = ("parent", "path", "key", "inside", "kind", "start", "end", "members", "found", "taken")

    def __init__(self, parent: "Node | None", path: str, key: str | None, kind: str, start: int, end: int):
        self.parent, self.path, self.key, self.kind, self.start, self.end = parent, path, key, kind, start, end
        self.inside = key if key is not None or parent is None else parent.inside
        self.members: list[str] = []
        self.found = 0  # values seen inside so far
        self.taken = False


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a member is named twice")
    return out


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON number")


def nodes_of(text: str, find: Find) -> list[Node]:
    """The wanted nodes below the root, in the order of the text: one pass over its tokens with a stack.

    A text that is no JSON, or names a member of an object twice, has no nodes.
    """
    try:
        json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return []
    made: list[Node] = []
    stack: list[Node] = []
    name: str | None = None  # of the member whose value comes next
    for token in _TOKEN.finditer(text):
        word = token.group()
        first = word[0]
        if first in ",:":
            continue
        top = stack[-1] if stack else None
        if first in "]}":
            stack.pop().end = token.end()
            continue
        if top is not None and top.kind == "OBJECT" and name is None:
            name = json.loads(word) if "\\" in word else word[1:-1]
            top.members.append(name)
            continue
        path = "" if top is None else f"{top.path}/{top.found:08d}"
        node = Node(top, path, name, _KINDS.get(first, "SCALAR"), token.start(), token.end())
        name = None
        if top is not None:
            top.found += 1
            made.append(node)
        if node.kind in ("OBJECT", "ARRAY"):
            stack.append(node)
    out = []
    for node in made:  # parents come before their children
        if node.parent.taken:
            node.taken = find.closed
        elif find.holds(node):
            out.append(node)
            node.taken = find.closed
    return out


def walk(docs: DataFrame, id_cols: Sequence[str], json_col: str, find: Find = Find()) -> DataFrame:
    """The wanted nodes below each document's root: ``(ids…, path, key, inside, node)``.

    One scan whatever the depth: tasks read each text once from left to right and send the texts of the wanted
    nodes alone. ``inside`` is the innermost member name at or above the node, ``path`` sorts nodes as the text has
    them. The node is a variant, so that it may itself be nested up to the depth variants allow.
    """
    rows = docs.select(*id_cols, F.col(json_col).cast("string").alias("_json"))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(n, T.StringType()) for n in ("path", "key", "inside", "_json"))])

    def work(batches):
        names = schema.names
        for batch in batches:
            ids = batch.select(list(range(batch.num_columns - 1)))
            for begin in range(0, batch.num_rows, 1000):
                place, rest = [], []
                for i, text in enumerate(batch.column(batch.num_columns - 1).slice(begin, 1000).to_pylist(), begin):
                    found = nodes_of(text, find) if text is not None else []
                    place += [i] * len(found)
                    rest += [(n.path, n.key, n.inside, text[n.start : n.end]) for n in found]
                columns = [pa.array([r[k] for r in rest], pa.string()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*ids.take(pa.array(place, pa.int64())).columns, *columns], names)

    found = rows.mapInArrow(work, schema)
    return found.select(*id_cols, "path", "key", "inside", F.try_parse_json("_json").alias("node"))


def kind(node) -> Column:
    """OBJECT, ARRAY, STRING, … of a variant node."""
    return F.regexp_extract(F.schema_of_variant(as_col(node)), "^([A-Z]+)", 1)


def member(node, key: str) -> Column:
    return F.try_variant_get(as_col(node), f"$.{key}", "variant")


def text_at(node, keys: Sequence[str]) -> Column:
    """First non-blank text among the members of an object node."""
    return F.coalesce(*[nonblank(F.when(kind(member(node, k)) == "STRING", F.try_variant_get(as_col(node), f"$.{k}", "string"))) for k in keys])


def extract_evidence(docs: DataFrame, id_cols: Sequence[str], json_col: str, agent_col: str = "agent") -> DataFrame:
    """Evidence records below any ``evidence``, ``sources`` or ``findings`` member of a document.

    Aliased members are coalesced, the confidence is clamped and defaults to one half; a record
    without an id gets one from its sorted JSON.
    """
    keep = [*id_cols, *([agent_col] if agent_col not in id_cols else [])]
    records = walk(docs, keep, json_col, Find(kinds=("OBJECT",), inside=COLLECTIONS, any_member=STATEMENT_KEYS, folded=True, closed=True))
    raw = F.coalesce(member("node", "confidence"), member("node", "relevance_score"))
    number = F.when(raw.isNull(), F.lit(0.5)).otherwise(F.coalesce(F.try_variant_get(raw, "$", "double"), F.lit(0.5)))
    named = lambda *keys: text_at("node", keys)
    free = lambda key: F.coalesce(F.try_variant_get("node", f"$.{key}", "string"), F.lit(""))
    return records.select(
        *keep, "path",
        F.coalesce(named("evidence_id", "id", "source_job_id"), stable_id(agent_col, F.to_json("node"))).alias("evidence_id"),
        named("company_id", "company", "company_name").alias("company_id"),
        named("business_unit", "division", "department").alias("business_unit"),
        named("topic", "theme", "capability", "job_title").alias("topic"),
        infer_type(agent_col, [free("evidence_type"), free("topic"), free("source_name")]).alias("evidence_type"),
        named("direction", "trend").alias("direction"),
        named(*STATEMENT_KEYS).alias("statement"),
        named("source_name", "source", "publisher").alias("source_name"),
        named("source_url", "url", "job_url").alias("source_url"),
        named("source_date", "evidence_date", "posting_date", "date").alias("source_date"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)).alias("confidence"),
    ).filter("statement IS NOT NULL")


def collect_nested(docs: DataFrame, id_cols: Sequence[str], json_col: str, key: str = "limitations") -> DataFrame:
    """Trimmed distinct texts of every list stored under ``key``, one row each with the first path."""
    texts = walk(docs, id_cols, json_col, Find(kinds=("STRING",), inside=(key,), listed=True))
    return texts.withColumn("value", nonblank(F.try_variant_get("node", "$", "string"))).filter("value IS NOT NULL").groupBy(*id_cols, "value").agg(F.min("path").alias("path"))


def observation_periods(docs: DataFrame, id_cols: Sequence[str], json_col: str) -> DataFrame:
    """Start and end dates of every object that states both."""
    rows = walk(docs, id_cols, json_col, Find(kinds=("OBJECT",), all_members=("observation_start", "observation_end")))
    day = lambda k: F.try_to_date(F.when(text_at("node", [k]).rlike(r"^\d{4}-\d{2}-\d{2}$"), text_at("node", [k])), "yyyy-MM-dd")
    return rows.select(*id_cols, "path", day("observation_start").alias("observation_start"), day("observation_end").alias("observation_end")).filter(
        "observation_start IS NOT NULL AND observation_end IS NOT NULL"
    )


def collect_ids(docs: DataFrame, id_cols: Sequence[str], json_col: str, keys: Sequence[str]) -> DataFrame:
    """Distinct UUIDs stored under the keys, alone or in lists, in canonical spelling."""
    rows = walk(docs, id_cols, json_col, Find(kinds=("STRING", "SCALAR"), inside=tuple(keys)))
    text = F.try_variant_get("node", "$", "string")
    digits = F.lower(F.regexp_replace(F.regexp_replace(text, r"(?i)^(urn:)?(uuid:)?", ""), r"[-{}]", ""))
    spelled = F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return rows.filter(text.rlike(UUID_PATTERN)).select(*id_cols, F.col("inside").alias("key"), spelled.alias("id")).distinct()


def contamination(docs: DataFrame, id_cols: Sequence[str], json_col: str, names: DataFrame) -> DataFrame:
    """Company-named texts anywhere in a document that are not among the document's accepted names.

    ``names`` holds the id columns it is scoped by plus ``company_key`` (blank-separated slug).
    """
    rows = walk(docs, id_cols, json_col, Find(kinds=("STRING",), key=COMPANY_KEYS, folded=True))
    named = rows.withColumn("value", F.try_variant_get("node", "$", "string")).filter(nonblank("value").isNotNull())
    keyed = named.withColumn("company_key", slug("value", " ", fold_accents=False))
    on = [c for c in names.columns]
    return keyed.join(names, on, "left_anti").select(*id_cols, "path", "key", "value")
