"""Nested semi-structured records as an adjacency table, and entity tables pivoted from it.

``shred`` walks each JSON text once and stores every node of the wanted members as
(node, parent, label, ordinal, kind, scalar): records, entities, the objects inside them
and their scalars. ``typed_nodes`` gives the same nodes for columns that have a schema,
with built-in functions only. ``entities`` joins the object nodes with their scalar
children and pivots those into one flat row for each entity, which still names its parent.
Shapes are met where they are: a member may be a list, a single object, an object keyed by
id, JSON text that holds any of these, or flattened under a dotted name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "node bigint, parent bigint, label string, ordinal int, kind string, scalar string"


@dataclass(frozen=True)
class Entity:
    """Where an entity's objects lie below a record and which scalars it keeps.

    ``path``: member names from the record down; ``fields``: kept scalars as dotted paths
    below the entity's object, the first being its own id where ``keyed`` is set: objects
    filed under their id take the id from there. ``own``: member names by which an object
    is told from a map of objects.
    """

    name: str
    path: tuple[str, ...]
    fields: tuple[str, ...]
    keyed: bool = False
    own: frozenset[str] = field(default_factory=frozenset)
    tag: str | None = None


def _loads(text: str):
    """Complete JSON or a ValueError; byte order mark and outer blanks don't count."""
    return json.loads(text.lstrip("﻿").strip())


def _opened(value):
    """JSON text inside JSON is opened, however often it was encoded; text that is no JSON stays as it is."""
    while isinstance(value, str):
        head = value.lstrip("﻿ \t\r\n")[:1]
        if head not in ('{', '[', '"'):
            return value
        try:
            value = _loads(value)
        except ValueError:
            return None
    return value


def _unflattened(record: dict) -> dict:
    """Members filed under dotted names lie below one another; a member that is there by itself stays."""
    if not any("." in k for k in record):
        return record
    out = {k: v for k, v in record.items() if "." not in k}
    for k, v in record.items():
        *path, last = k.split(".")
        at = out
        for step in path:
            at = at.setdefault(step, {})
            if not isinstance(at, dict):
                break
        else:
            if path:
                at.setdefault(last, v)
    return out


def _text(value) -> str | None:
    if value is None or isinstance(value, (dict, list)):
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else json.dumps(value)


class _Walker:
    def __init__(self, entities: tuple[Entity, ...], record_fields: tuple[str, ...], envelope: tuple[str, ...], below: int | None = None):
        self.entities, self.record_fields, self.envelope, self.below = entities, record_fields, envelope, below
        self.members = frozenset(e.path[0] for e in entities) | frozenset(record_fields)

    def nodes(self, body: str | None) -> list[tuple]:
        self.out: list[tuple] = []
        if body is None or not body.strip():
            return self.out
        try:
            root = _loads(body)
        except (ValueError, RecursionError):
            return self.out
        try:
            if self.below is None:
                self._records(root)
            else:
                # a member of a record whose other nodes come from elsewhere
                root = _opened(root)
                for part in root if isinstance(root, list) else [root]:
                    self._entities(0, part if isinstance(part, dict) else {})
        except RecursionError:
            self.out.clear()
        return self.out

    def _add(self, parent: int | None, label: str, ordinal: int, kind: str, scalar: str | None = None) -> int:
        self.out.append((len(self.out) + (self.below or 0), parent, label, ordinal, kind, scalar))
        return self.out[-1][0]

    def _records(self, root) -> None:
        """Every record of a body, in lists and envelopes of any depth."""
        todo = [(root, 0)]
        while todo:
            value, ordinal = todo.pop()
            value = _opened(value)
            if isinstance(value, list):
                todo += [(x, i) for i, x in enumerate(value)][::-1]
            elif isinstance(value, dict):
                value = _unflattened(value)
                inner = next((k for k in self.envelope if k in value and not (self.members & value.keys())), None)
                if inner is not None:
                    todo.append((value[inner], ordinal))
                    continue
                at = self._add(None, "record", ordinal, "object")
                for name in self.record_fields:
                    if name in value:
                        self._add(at, name, 0, "scalar", _text(value[name]))
                self._entities(at, value)

    def _entities(self, at: int, record: dict) -> None:
        for e in self.entities:
            for i, (own, obj) in enumerate(self._objects(e, record)):
                self._entity(e, at, i, own, _unflattened(obj))

    def _objects(self, e: Entity, record: dict) -> list[tuple[str | None, dict]]:
        """(id it is filed under, object) of each object of an entity, whatever the member's shape."""
        found: list[tuple[str | None, object]] = [(None, record)]
        for step in e.path:
            below = []
            for _, x in found:
                x = _opened(x)
                for y in x if isinstance(x, list) else [x]:
                    y = _opened(y)
                    if not isinstance(y, dict):
                        continue
                    if step in y:
                        below.append((None, y[step]))
                    elif e.tag and y.get(e.tag) == step:  # a list of members that name themselves
                        below.append((None, y))
            found = below
        out: list[tuple[str | None, dict]] = []
        for _, x in found:
            x = _opened(x)
            if isinstance(x, dict) and e.keyed and x and not (e.own & x.keys()):
                out += [(k, o) for k, v in x.items() for o in self._flat(v)]
            else:
                out += [(None, o) for o in self._flat(x)]
        return out

    def _flat(self, value) -> list[dict]:
        value = _opened(value)
        if isinstance(value, list):
            return [o for x in value for o in self._flat(x)]
        return [value] if isinstance(value, dict) else []

    def _entity(self, e: Entity, record: int, ordinal: int, own: str | None, obj: dict) -> None:
        at = self._add(record, e.name, ordinal, "object")
        made: dict[str, tuple[int, dict] | None] = {"": (at, obj)}
        for i, path in enumerate(e.fields):
            holder, _, last = path.rpartition(".")
            found = self._inner(holder, made)
            text = _text(found[1].get(last)) if found else None
            if i == 0 and e.keyed and (text is None or not text.strip()):
                text, found = own, found or made[""]
            if text is not None:
                self._add(found[0], last, i, "scalar", text)

    def _inner(self, path: str, made: dict) -> tuple[int, dict] | None:
        """(node, object) of an object inside an entity, added once."""
        if path not in made:
            above, _, last = path.rpartition(".")
            up = self._inner(above, made)
            value = _opened(up[1].get(last)) if up else None
            made[path] = (self._add(up[0], last, 0, "inner"), value) if isinstance(value, dict) else None
        return made[path]


def shred(
    df: DataFrame,
    keys: tuple[str, ...],
    body: str,
    entities: tuple[Entity, ...],
    record_fields: tuple[str, ...],
    envelope: tuple[str, ...] = ("records",),
    below: int | None = None,
) -> DataFrame:
    """Adjacency table of the JSON texts in ``body``: ``keys`` plus node, parent, label, ordinal, kind, scalar.

    Null, blank, cut or otherwise incomplete texts give no node; a text encoded more than
    once is opened; null elements are skipped; repeated rows give repeated nodes. Extra
    columns are ignored. With ``below`` the text is a member of a record that is node 0 and
    has its other nodes from elsewhere: nodes are numbered from there on.
    """
    types = dict(df.dtypes)
    names = [f"k{i}" for i in range(len(keys))]
    schema = ", ".join([f"{n} {types[k]}" for n, k in zip(names, keys)]) + ", " + NODE_SCHEMA

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walker = _Walker(entities, record_fields, envelope, below)
        for pdf in batches:
            rows = []
            for *key, text in zip(*[pdf[n] for n in names], pdf["body"]):
                rows += [(*key, *n) for n in walker.nodes(text)]
            out = pd.DataFrame(rows, columns=[*names, "node", "parent", "label", "ordinal", "kind", "scalar"])
            out["parent"] = out["parent"].astype("Int64")
            yield out

    work = df.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], F.col(body).cast("string").alias("body"))
    got = work.where(F.col("body").isNotNull()).mapInPandas(walk, schema)
    return got.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "node", "parent", "label", "ordinal", "kind", "scalar")


STRIDE = 1 << 40  # node numbers of one entity of a typed record


def typed_nodes(df: DataFrame, keys: tuple[str, ...], record_fields: tuple[str, ...], specs: tuple[tuple[Entity, str], ...]) -> DataFrame:
    """The same adjacency table for columns with a schema: each of ``specs`` names an entity and its column, a struct or an array of structs.

    The record is node 0, the k-th entity's nodes begin at (k + 1) * STRIDE. Null elements
    and null structs give no node. Only built-in functions are used.
    """
    key_cols = [F.col(k) for k in keys]
    node = "struct<node:bigint,parent:bigint,label:string,ordinal:int,kind:string,scalar:string>"

    def made(number, parent, label: str, ordinal, kind: str, scalar=None):
        text = scalar.cast("string") if scalar is not None else F.lit(None).cast("string")
        return F.struct(number.cast("bigint").alias("node"), parent.cast("bigint").alias("parent"), F.lit(label).alias("label"), ordinal.cast("int").alias("ordinal"), F.lit(kind).alias("kind"), text.alias("scalar"))

    zero = F.lit(0)
    parts = [F.array(made(zero, F.lit(None), "record", zero, "object"), *[made(F.lit(i + 1), zero, f, zero, "scalar", F.col(f)) for i, f in enumerate(record_fields)])]
    for k, (e, column) in enumerate(specs):
        is_array = dict(df.dtypes)[column].startswith("array")
        items = F.col(column) if is_array else F.array(F.col(column))
        inner = list(dict.fromkeys(f.rpartition(".")[0] for f in e.fields if "." in f))
        if any("." in x for x in inner):
            raise ValueError("typed entities hold objects of one level")
        width = 1 + len(inner) + len(e.fields)

        def nodes_of(x, i):  # used before the loop goes on
            first = F.lit((k + 1) * STRIDE).cast("bigint") + i.cast("bigint") * width
            out = [made(first, zero, e.name, i, "object")]
            out += [made(first + (1 + j), first, name, zero, "inner") for j, name in enumerate(inner)]
            for j, path in enumerate(e.fields):
                holder, _, last = path.rpartition(".")
                up = first + (1 + inner.index(holder)) if holder else first
                out.append(made(first + (1 + len(inner) + j), up, last, F.lit(j), "scalar", x[holder][last] if holder else x[last]))
            return F.when(x.isNotNull(), F.array(*out)).otherwise(F.array().cast(f"array<{node}>"))

        parts.append(F.coalesce(F.flatten(F.transform(items, nodes_of)), F.array().cast(f"array<{node}>")))
    got = df.select(*key_cols, F.explode(F.concat(*parts)).alias("x")).select(*key_cols, "x.*")
    return got.where((F.col("kind") != "scalar") | F.col("scalar").isNotNull())


def entities(nodes: DataFrame, keys: tuple[str, ...], parent_field: str, specs: tuple[Entity, ...]) -> dict[str, DataFrame]:
    """One flat table for each entity: ``keys``, the parent's ``parent_field``, ordinal and the entity's fields.

    Object nodes meet their scalar children by (keys, node): all scalars are pivoted in
    one aggregation keyed by the owning node, so a row with very many children is spread
    over tasks; scalars of inner objects climb to the entity first. Parents without
    ``parent_field`` keep their children with a null parent; rows whose own ``keys`` are
    null can't be told apart and give no entity. Rows repeated under the same keys repeat their entities.
    """
    children = _pivoted(nodes, keys, parent_field, specs)
    key_cols = [F.col(k) for k in keys]
    return {
        e.name: children.where(F.col("label") == e.name).select(*key_cols, F.col("__parent").alias(parent_field), "ordinal", *[F.col(f"v{_number(specs, f)}").alias(f.replace(".", "_")) for f in e.fields])
        for e in specs
    }


def _number(specs: tuple[Entity, ...], path: str) -> int:
    return sorted({f for e in specs for f in e.fields}).index(path)


def _pivoted(nodes: DataFrame, keys: tuple[str, ...], parent_field: str, specs: tuple[Entity, ...]) -> DataFrame:
    """Entity objects with their parent's key and one column for each field of any entity."""
    key_cols = [F.col(k) for k in keys]
    wanted = sorted({f for e in specs for f in e.fields})
    scalars = nodes.where("kind = 'scalar'").select(*key_cols, F.col("parent").alias("node"), F.col("label").alias("path"), "scalar")
    held = scalars
    # scalars of inner objects climb, a level at a time, to the entity they belong to
    ends = sorted({".".join(f.split(".")[k:]) for f in wanted for k in range(1, f.count(".") + 1)})
    inner = nodes.where("kind = 'inner'").select(*key_cols, "node", F.col("parent").alias("up"), F.col("label").alias("name"))
    for _ in range(max(f.count(".") for f in wanted)):
        scalars = scalars.where(F.col("path").isin(ends)).join(inner, [*keys, "node"])
        scalars = scalars.select(*key_cols, F.col("up").alias("node"), F.concat_ws(".", "name", "path").alias("path"), "scalar")
        held = held.unionByName(scalars)
    values = held.where(F.col("path").isin(*wanted, parent_field)).groupBy(*key_cols, "node")
    values = values.agg(*[F.max(F.when(F.col("path") == w, F.col("scalar"))).alias(f"v{i}") for i, w in enumerate(wanted)], F.max(F.when(F.col("path") == parent_field, F.col("scalar"))).alias("__key"))
    flat = nodes.where("kind = 'object'").select(*key_cols, "node", "parent", "label", "ordinal").join(values, [*keys, "node"], "left")
    parents = flat.where("parent is null").select(*key_cols, F.col("node").alias("parent"), F.col("__key").alias("__parent"))
    return flat.where("parent is not null").join(parents, [*keys, "parent"])


def entity_keys(nodes: DataFrame, keys: tuple[str, ...], parent_field: str, specs: tuple[Entity, ...]) -> DataFrame:
    """``keys``, parent key, entity name and first field of all entities that have it: the pivoted tables, one below the other."""
    first = F.coalesce(*[F.when(F.col("label") == e.name, F.col(f"v{_number(specs, e.fields[0])}")) for e in specs])
    got = _pivoted(nodes, keys, parent_field, specs).select(*[F.col(k) for k in keys], F.col("__parent").alias("parent_key"), F.col("label").alias("child"), first.alias("child_key"))
    return got.where("child_key is not null")
