"""Checking responses against a JSON schema with references, unions and recursion, and reading one as a Spark type.

``check_schema`` compiles a schema into expressions over variants: references are followed, the branches of a union are tried one
by one.  That needs no shuffle.  Where a schema refers to itself, the expressions stop, and what is below is a work item
of the next level.  Levels are worked down inside the row, in a fold over as many steps as the text can be deep, and nothing is stored or
shuffled.  Only a row in which several branches of a union stay open above work items is taken out: those rows are worked down by
jobs, one for each level, and the problems are gathered upwards, a union by its branches.  So depth has no limit but that of the
JSON parser.

Read: $ref (within the document), anyOf, oneOf, allOf, type (also a list), properties, required, additionalProperties,
items, minItems, maxItems, enum, const, minLength, maxLength, pattern (Java's dialect), minimum, maximum and their exclusive
forms.  Annotations are passed over; any other keyword is a SchemaError rather than left unchecked.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkproof.sources.shared import shared_folder

KINDS = ("missing_keys", "extra_keys", "wrong_types", "wrong_values", "no_branch")
#: Instead of a problem: a work item below; a branch of a union that can't be told yet, of anyOf and of oneOf.
_BELOW, _ANY, _ONE = "below", "any", "one"
_FOUND = "array<struct<kind:string,path:string,node:int,value:variant>>"
_PROBLEMS = "array<struct<kind:string,path:string>>"
_STATE = f"struct<open:{_FOUND},problems:{_PROBLEMS},waits:boolean>"
_NOTES = {
    "title", "description", "default", "examples", "example", "format", "$schema", "$id", "$defs", "definitions", "$comment",
    "deprecated", "readOnly", "writeOnly", "discriminator",
}
#: Schemas whose expressions would pass so many nodes are cut at their references, as recursive ones are.
_MOST_NODES = 400


class SchemaError(ValueError):
    """A schema that can't be read."""


@dataclass
class Node:
    """One place of a schema."""

    kind: str  # object, array, string, integer, number, boolean, null, nullable, any, ref, anything, nothing, all
    properties: dict[str, "Node"] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    others: "Node | None" = None  # what undeclared keys, or the items of an array, must be
    branches: list["Node"] = field(default_factory=list)  # of any and all
    only_one: bool = False  # oneOf
    target: str = ""  # of a ref
    allowed: tuple | None = None  # enum and const
    bounds: dict = field(default_factory=dict)
    number: int = -1

    def below(self) -> list["Node"]:
        return [*self.properties.values(), *([self.others] if self.others else []), *self.branches]


_SCALARS = ("string", "integer", "number", "boolean", "null")
_BOUNDS = {
    "string": ("minLength", "maxLength", "pattern"),
    "integer": ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"),
    "number": ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"),
    "array": ("minItems", "maxItems"),
}


class Schema:
    """A parsed schema: ``root`` and the nodes that references name."""

    def __init__(self, schema: str | Mapping):
        whole = json.loads(schema) if isinstance(schema, str) else schema
        if not isinstance(whole, (Mapping, bool)):
            raise SchemaError("a schema is an object")
        self.whole = whole
        self.named: dict[str, Node] = {}
        self.root = self._read(whole, "#")
        for node in list(self.named.values()):
            self._no_loop(node)
        self._number()

    def resolve(self, node: Node) -> Node:
        while node.kind == "ref":
            node = self.named[node.target]
        return node

    def _no_loop(self, start: Node) -> None:
        """References and unions may come back to themselves only by way of a key or an item."""
        todo, seen = [start], set()
        while todo:
            node = todo.pop()
            onward = [self.named[node.target]] if node.kind == "ref" else node.branches
            if any(n is start for n in onward):
                raise SchemaError("a reference leads to itself without a key or an item between")
            todo += [n for n in onward if id(n) not in seen]
            seen.update(map(id, onward))

    def _number(self) -> None:
        """Numbers for all nodes; those that come upon themselves again, and unions above them, are places to stop."""
        self.nodes: list[Node] = []
        todo, seen = [self.root, *self.named.values()], set()
        while todo:
            node = todo.pop(0)
            if id(node) not in seen:
                seen.add(id(node))
                node.number = len(self.nodes)
                self.nodes.append(node)
                todo += node.below()
        after = [{(self.resolve(n)).number for n in node.below()} | ({self.resolve(node).number} if node.kind == "ref" else set()) for node in self.nodes]
        reach = [set(a) for a in after]
        changed = True
        while changed:
            changed = False
            for mine in reach:
                more = set().union(mine, *(reach[n] for n in mine))
                if len(more) > len(mine):
                    changed = True
                    mine |= more
        loops = {n for n, mine in enumerate(reach) if n in mine}
        above = {n for n, mine in enumerate(reach) if mine & loops} | loops
        targets = {self.resolve(n).number for n in self.named.values()}
        self.stops = (loops & targets) | {n for n in above if self.nodes[n].kind == "any"}
        if not self.stops and self._size(self.root, {}) > _MOST_NODES:
            self.stops = targets

    def may_wait(self) -> bool:
        """Whether some value may leave several branches of a union open, with work items below."""
        unions = [[self._fitting(b) for b in self.nodes[n].branches] for n in self.stops if self.nodes[n].kind == "any"]
        return any(one & other for kinds in unions for i, one in enumerate(kinds) for other in kinds[:i])

    def _fitting(self, node: Node) -> set[str]:
        """Types of values that the expressions don't call a misfit of a node; all, where they stop before they look."""
        node = self.resolve(node)
        every = {"object", "array", "string", "number", "boolean", "null"}
        if node.kind in every:
            return {node.kind}
        if node.kind == "integer":
            return {"number"}
        if node.kind == "any" and node.number in self.stops:
            return set().union(*(self._fitting(b) for b in node.branches))
        return every

    def _size(self, node: Node, known: dict) -> int:
        """Nodes that the expressions pass, references written out."""
        node = self.resolve(node)
        if node.number not in known:
            known[node.number] = 1 + sum(self._size(n, known) for n in node.below())
        return known[node.number]

    def _read(self, schema, where: str) -> Node:
        if schema is True:
            return Node("anything")
        if schema is False:
            return Node("nothing")
        if not isinstance(schema, Mapping):
            raise SchemaError(f"{where} is not a schema")
        keys = {k for k in schema if k not in _NOTES}

        def none_but(*known: str) -> None:
            if keys - set(known):
                raise SchemaError(f"{where}: {', '.join(sorted(keys - set(known)))} can't be checked here")

        if "$ref" in keys:
            none_but("$ref")
            return self._reference(schema["$ref"], where)
        for word in ("anyOf", "oneOf", "allOf"):
            if word in keys:
                none_but(word)
                branches = [self._read(s, f"{where}/{word}/{n}") for n, s in enumerate(schema[word])]
                if not branches:
                    raise SchemaError(f"{where}/{word} is empty")
                if len(branches) == 1:
                    return branches[0]
                some = [b for b in branches if b.kind != "null"]
                if word != "allOf" and len(some) == 1 and len(branches) == 2:
                    return Node("nullable", branches=some)
                return Node("all" if word == "allOf" else "any", branches=branches, only_one=word == "oneOf")
        kind = schema.get("type")
        if isinstance(kind, list):
            return self._read({"anyOf": [{**{k: v for k, v in schema.items() if k in keys and self._concerns(k, one)}, "type": one} for one in kind]}, where)
        if kind is None and keys & {"properties", "required", "additionalProperties"}:
            kind = "object"
        if kind is None and "items" in keys:
            kind = "array"
        allowed = tuple(schema["enum"]) if "enum" in keys else (schema["const"],) if "const" in keys else None
        if allowed is not None and any(isinstance(a, (dict, list)) for a in allowed):
            raise SchemaError(f"{where}: only plain values can be listed")
        if kind is None:
            none_but("enum", "const")
            return Node("anything", allowed=allowed)
        if kind == "object":
            none_but("type", "properties", "required", "additionalProperties")
            parts = {k: self._read(s, f"{where}/properties/{k}") for k, s in schema.get("properties", {}).items()}
            others = self._read(schema.get("additionalProperties", True), f"{where}/additionalProperties")
            return Node("object", properties=parts, required=tuple(schema.get("required", ())), others=others)
        if kind == "array":
            none_but("type", "items", *_BOUNDS["array"])
            return Node("array", others=self._read(schema.get("items", True), f"{where}/items"), bounds=self._bounds(schema, kind))
        if kind not in _SCALARS:
            raise SchemaError(f"{where}: no type {kind}")
        none_but("type", "enum", "const", *_BOUNDS.get(kind, ()))
        return Node(kind, allowed=allowed, bounds=self._bounds(schema, kind))

    @staticmethod
    def _bounds(schema: Mapping, kind: str) -> dict:
        return {k: schema[k] for k in _BOUNDS.get(kind, ()) if k in schema}

    @staticmethod
    def _concerns(key: str, kind: str) -> bool:
        """Whether a keyword says something about a type of a list."""
        of = {
            "object": {"properties", "required", "additionalProperties"},
            "array": {"items", *_BOUNDS["array"]},
            **{k: {"enum", "const", *_BOUNDS.get(k, ())} for k in _SCALARS},
        }
        return key in of.get(kind, ()) or not any(key in keys for keys in of.values())

    def _reference(self, target: str, where: str) -> Node:
        if not isinstance(target, str) or not (target == "#" or target.startswith("#/")):
            raise SchemaError(f"{where}: {target} is not within the schema")
        if target not in self.named:
            at = self.whole
            for part in target.split("/")[1:]:
                name = part.replace("~1", "/").replace("~0", "~")
                if not isinstance(at, Mapping) or name not in at:
                    raise SchemaError(f"{where}: there is no {target}")
                at = at[name]
            self.named[target] = Node("ref", target=target)  # holds the place while it is read
            self.named[target] = self._read(at, target)
        return Node("ref", target=target)


# -- expressions ----------------------------------------------------------------


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _none() -> Column:
    return F.array().cast(_FOUND)


def _one(kind: str, path: Column) -> Column:
    return F.array(_entry(kind, path))


def _entry(kind: str, path: Column, node: int | Column = -1, value: Column | None = None) -> Column:
    value = F.lit(None).cast("variant") if value is None else value
    node = F.lit(node) if isinstance(node, int) else node
    return F.struct(F.lit(kind).alias("kind"), path.alias("path"), node.alias("node"), value.alias("value"))


def _each(kind: str, names: Column, prefix: Column) -> Column:
    return F.transform(names, lambda n: _entry(kind, F.concat(prefix, n)))


def _when(wrong: Column, kind: str, path: Column) -> Column:
    return F.when(F.coalesce(wrong, F.lit(False)), _one(kind, path)).otherwise(_none())


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def _has_type(value: Column, kind: str) -> Column:
    name = F.schema_of_variant(value)
    if kind == "null":
        return F.is_variant_null(value)
    if kind == "integer":
        return (name == "BIGINT") | name.rlike(r"^DECIMAL\([0-9]+,0\)$")
    if kind == "number":
        return name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL")
    return name == {"string": "STRING", "boolean": "BOOLEAN"}[kind]


def _is_listed(value: Column, allowed: Sequence) -> Column:
    """Whether a value is one of some plain ones; numbers are compared as numbers."""
    tests = [F.lit(False)]
    words = [a for a in allowed if isinstance(a, str)]
    numbers = [float(a) for a in allowed if isinstance(a, (int, float)) and not isinstance(a, bool)]
    if words:
        tests.append(_has_type(value, "string") & F.try_variant_get(value, "$", "string").isin(words))
    if numbers:
        tests.append(_has_type(value, "number") & F.try_variant_get(value, "$", "double").isin(numbers))
    for flag in (a for a in allowed if isinstance(a, bool)):
        tests.append(_has_type(value, "boolean") & (F.try_variant_get(value, "$", "boolean") == flag))
    if None in allowed:
        tests.append(F.is_variant_null(value))
    out = tests[0]
    for test in tests[1:]:
        out = out | F.coalesce(test, F.lit(False))
    return out


def _out_of_bounds(value: Column, kind: str, bounds: Mapping) -> Column:
    tests = []
    if kind == "string":
        text = F.try_variant_get(value, "$", "string")
        if "minLength" in bounds:
            tests.append(F.char_length(text) < bounds["minLength"])
        if "maxLength" in bounds:
            tests.append(F.char_length(text) > bounds["maxLength"])
        if "pattern" in bounds:
            tests.append(~text.rlike(bounds["pattern"]))
    else:
        number = F.try_variant_get(value, "$", "double")
        for name, wrong in (
            ("minimum", lambda b: number < b),
            ("maximum", lambda b: number > b),
            ("exclusiveMinimum", lambda b: number <= b),
            ("exclusiveMaximum", lambda b: number >= b),
        ):
            if name in bounds:
                tests.append(wrong(float(bounds[name])))
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


class _Compiler:
    def __init__(self, schema: Schema):
        self.schema = schema

    def found(self, value: Column, node: Node, path: Column, top: bool = False) -> Column:
        """Problems of a present value and of everything below it, and work items where the schema stops."""
        node = self.schema.resolve(node)
        if not top and node.number in self.schema.stops:
            return F.array(_entry(_BELOW, path, node.number, value))
        return getattr(self, f"_{node.kind}", self._scalar)(value, node, path)

    def _anything(self, value: Column, node: Node, path: Column) -> Column:
        return _none() if node.allowed is None else _when(~_is_listed(value, node.allowed), "wrong_values", path)

    def _nothing(self, value: Column, node: Node, path: Column) -> Column:
        return _one("wrong_types", path)

    def _scalar(self, value: Column, node: Node, path: Column) -> Column:
        wrong = F.lit(False)
        if node.allowed is not None:
            wrong = wrong | ~_is_listed(value, node.allowed)
        if node.bounds:
            wrong = wrong | F.coalesce(_out_of_bounds(value, node.kind, node.bounds), F.lit(False))
        judged = _when(wrong, "wrong_values", path) if node.allowed is not None or node.bounds else _none()
        return F.when(_has_type(value, node.kind), judged).otherwise(_one("wrong_types", path))

    def _object(self, value: Column, node: Node, path: Column) -> Column:
        prefix = F.when(path == "", path).otherwise(F.concat(path, F.lit(".")))

        def members(held: Column) -> Column:
            names = F.map_keys(held)
            parts = []
            if node.required:
                parts.append(_each("missing_keys", F.array_except(F.array(*map(F.lit, node.required)), names), prefix))
            declared = F.array(*map(F.lit, node.properties)) if node.properties else F.array().cast("array<string>")
            if node.others.kind == "nothing":
                parts.append(_each("extra_keys", F.array_except(names, declared), prefix))
            elif node.others.kind != "anything" or node.others.allowed is not None:
                more = F.filter(F.map_entries(held), lambda e: ~F.array_contains(declared, e["key"]))
                parts.append(F.flatten(F.transform(more, lambda e: self.found(e["value"], node.others, F.concat(prefix, e["key"])))))

            def member(name: str, kind: Node) -> Column:
                judged = lambda v: F.when(v.isNotNull(), self.found(v, kind, F.concat(prefix, F.lit(name)))).otherwise(_none())
                return _bound(F.try_element_at(held, F.lit(name)), judged)

            parts += [member(name, kind) for name, kind in node.properties.items()]
            return F.when(held.isNull(), _one("wrong_types", path)).otherwise(_joined(parts))

        return _bound(F.try_variant_get(value, "$", "map<string,variant>"), members)

    def _array(self, value: Column, node: Node, path: Column) -> Column:
        def judged(items: Column) -> Column:
            each = F.transform(items, lambda i: self.found(i, node.others, F.concat(path, F.lit("[]"))))
            parts = [F.flatten(each)]
            if node.bounds:
                few = F.size(items) < node.bounds.get("minItems", 0)
                wrong = few | (F.size(items) > node.bounds["maxItems"]) if "maxItems" in node.bounds else few
                parts.append(_when(wrong, "wrong_values", path))
            return F.when(items.isNull(), _one("wrong_types", path)).otherwise(_joined(parts))

        return _bound(F.try_variant_get(value, "$", "array<variant>"), judged)

    def _nullable(self, value: Column, node: Node, path: Column) -> Column:
        return F.when(F.is_variant_null(value), _none()).otherwise(self.found(value, node.branches[0], path))

    def _all(self, value: Column, node: Node, path: Column) -> Column:
        return _joined([self.found(value, n, path) for n in node.branches])

    def _any(self, value: Column, node: Node, path: Column) -> Column:
        if node.number in self.schema.stops:
            return self._open_union(value, node, path)
        tried = F.array(*[self.found(value, n, path) for n in node.branches])
        return _bound(tried, lambda alternatives: told(alternatives, node.only_one, path, _none(), _one("no_branch", path)))

    def _open_union(self, value: Column, node: Node, path: Column) -> Column:
        """A union with work items below it.

        Branches that the value's type doesn't fit are out.  One that is left is what the union says, items below and all;
        of several, each becomes an item, unless one is clean already.
        """
        branches = [self.schema.resolve(n) for n in node.branches]
        tried = F.array(*[F.struct(F.lit(n.number).alias("node"), self.found(value, n, path, top=True).alias("found")) for n in branches])
        kind = _ONE if node.only_one else _ANY

        def decided(near: Column) -> Column:
            waiting = F.transform(near, lambda b: _entry(kind, path, value=value, node=b["node"]))
            clean = F.exists(near, lambda b: F.size(b["found"]) == 0) if not node.only_one else F.lit(False)
            return (
                F.when(F.size(near) == 0, _one("no_branch", path))
                .when(F.size(near) == 1, F.get(near, F.lit(0))["found"])
                .when(clean, _none())
                .otherwise(waiting)
            )

        return _bound(F.filter(tried, lambda b: ~_misfit(b["found"], path)), decided)


def _misfit(problems: Column, path: Column) -> Column:
    """Whether the value itself, at ``path``, is of no fitting type."""
    return F.exists(problems, lambda p: p["kind"].isin("wrong_types", "no_branch") & (p["path"] == path))


def told(alternatives: Column, only_one: bool, path: Column, none: Column, no_branch: Column) -> Column:
    """What a union says, given the problems of each branch.

    Nothing, if a branch (with ``only_one``, exactly one) has none; else, if the value's type fits only one branch, the problems
    of that; else that no branch fits.
    """
    clean = F.size(F.filter(alternatives, lambda a: F.size(a) == 0))
    fits = clean == 1 if only_one else clean > 0
    near = F.filter(alternatives, lambda a: ~_misfit(a, path))
    return F.when(fits, none).when((clean == 0) & (F.size(near) == 1), F.get(near, F.lit(0))).otherwise(no_branch)


# -- checking -------------------------------------------------------------------


def check_schema(
    responses: DataFrame, schema: Schema | str | Mapping, *, body: str = "body", keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Every body against the schema: ``keys``, ``well_formed``, sorted distinct paths of each of ``KINDS``, ``conforms``.

    A body that is not JSON is not well formed and has no paths.  Items of arrays have the path of the array and ``[]``.
    Rows are independent: equal keys are checked once each.
    """
    schema = schema if isinstance(schema, Schema) else Schema(schema)
    value = F.try_parse_json(F.col(body)).alias("_value")
    if schema.stops:
        # a level that doesn't go deeper in the text is one of a reference, and those can't lead back to themselves
        brackets = F.length(body) - F.length(F.translate(body, "{[", ""))
        steps = (brackets + 1) * (len(schema.stops) + 1)
        worked = responses.select(*keys, value, steps.alias("_steps")).select(
            *keys, "_value", F.when(F.col("_value").isNotNull(), _in_row(F.col("_value"), F.col("_steps"), schema)).alias("_state")
        )
        if schema.may_wait():
            problems = _with_levels(worked, schema, keys)
        else:
            problems = worked.select(*keys, F.col("_value").isNotNull().alias("well_formed"), _told_in_row().alias("_problems"))
    else:
        found = _Compiler(schema).found(F.col("_value"), schema.root, F.lit(""), top=True)
        parsed = responses.select(*keys, value)
        judged = F.when(F.col("_value").isNotNull(), _plain(found)).otherwise(F.array().cast(_PROBLEMS))
        problems = parsed.select(*keys, F.col("_value").isNotNull().alias("well_formed"), judged.alias("_problems"))

    def paths(kind: str) -> Column:
        mine = F.filter("_problems", lambda p: p["kind"] == kind)
        return F.array_sort(F.array_distinct(F.transform(mine, lambda p: p["path"]))).alias(kind)

    clean = F.col("well_formed") & (F.size("_problems") == 0)
    return problems.select(*keys, "well_formed", *map(paths, KINDS), clean.alias("conforms"))


def _plain(found: Column) -> Column:
    return F.transform(found, lambda p: F.struct(p["kind"].alias("kind"), p["path"].alias("path")))


def _judged(compiler: _Compiler, numbers: Sequence[int], node: Column, value: Column, path: Column) -> Column:
    """What is found at a work item, by the number of its node."""
    judged = F.lit(None).cast(_FOUND)
    for number in numbers:
        found = compiler.found(value, compiler.schema.nodes[number], path, top=True)
        judged = F.when(node == number, found).otherwise(judged)
    return judged


def _in_row(value: Column, steps: Column, schema: Schema) -> Column:
    """The state after all levels: no open work item, the problems, and whether a union waits for its branches (it stops there)."""
    compiler = _Compiler(schema)
    root = schema.resolve(schema.root).number
    numbers = sorted({root, *schema.stops})

    def level(state: Column, _: Column) -> Column:
        each = F.transform(state["open"], lambda i: _judged(compiler, numbers, i["node"], i["value"], i["path"]))

        def after(found: Column) -> Column:
            waits = F.exists(found, lambda p: p["kind"].isin(_ANY, _ONE))
            more = F.when(waits, _none()).otherwise(F.filter(found, lambda p: p["node"] >= 0))
            known = F.concat(state["problems"], _plain(F.filter(found, lambda p: p["node"] < 0)))
            return F.struct(more.alias("open"), known.alias("problems"), waits.alias("waits")).cast(_STATE)

        return F.when(F.size(state["open"]) == 0, state).otherwise(_bound(F.flatten(each), after))

    first = F.array(_entry(_BELOW, F.lit(""), root, value))
    start = F.struct(first.alias("open"), F.array().cast(_PROBLEMS).alias("problems"), F.lit(False).alias("waits")).cast(_STATE)
    return F.aggregate(F.sequence(F.lit(1), steps), start, level)


def _told_in_row() -> Column:
    return F.coalesce("_state.problems", F.array().cast(_PROBLEMS))


def _with_levels(worked: DataFrame, schema: Schema, keys: Sequence[str]) -> DataFrame:
    """``keys``, ``well_formed`` and ``_problems``; rows whose unions wait are worked down by jobs, a level after the other."""
    spark = worked.sparkSession
    folder = shared_folder(spark, "levels")

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    compiler = _Compiler(schema)
    root = schema.resolve(schema.root).number
    waits = F.coalesce("_state.waits", F.lit(False))
    documents = stored(
        worked.select(
            F.monotonically_increasing_id().alias("_row"),
            *keys,
            F.col("_value").isNotNull().alias("well_formed"),
            F.when(~waits, _told_in_row()).alias("_problems"),
            F.when(waits, F.col("_value")).alias("_value"),
        ),
        "documents",
    )
    if documents.where(F.col("_value").isNotNull()).isEmpty():
        return documents.select(*keys, "well_formed", "_problems")
    level = documents.where(F.col("_value").isNotNull()).select(
        F.col("_row").cast("string").alias("item"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(root).alias("node"),
        F.lit("").alias("path"),
        F.col("_value").alias("value"),
    )
    reached, levels = {root}, []
    while reached:
        judged = _judged(compiler, sorted(reached), F.col("node"), F.col("value"), F.col("path"))
        done = level.select("item", "parent", "node", "path", judged.alias("found"))
        done = done.select(
            "item",
            "parent",
            "node",
            "path",
            F.exists("found", lambda p: p["kind"] == _ANY).alias("any"),
            F.exists("found", lambda p: p["kind"] == _ONE).alias("one"),
            _plain(F.filter("found", lambda p: p["node"] < 0)).alias("problems"),
            F.filter("found", lambda p: p["node"] >= 0).alias("below"),
        )
        levels.append(stored(done, f"level-{len(levels)}"))
        below = levels[-1].select("item", F.posexplode("below").alias("place", "each"))
        level = below.select(
            F.sha2(F.concat_ws("/", "item", "place"), 256).alias("item"),
            F.col("item").alias("parent"),
            "each.node",
            "each.path",
            "each.value",
        )
        # as many numbers as the schema has places
        reached = {r.node for r in level.select("node").distinct().collect()}
    answers = None
    for depth in range(len(levels) - 1, -1, -1):
        answers = stored(_gathered(levels[depth], answers), f"answer-{depth}")
    told_of = answers.select(F.col("item").cast("long").alias("_row"), "problems")
    return documents.join(told_of, "_row", "left").select(*keys, "well_formed", F.coalesce("problems", "_problems").alias("_problems"))


def _gathered(level: DataFrame, answers: DataFrame | None) -> DataFrame:
    """(item, parent, problems, near) of a level, with what its items below told; ``near``: the value's type fits the item."""
    own = level.select("item", "parent", "path", "any", "one", "problems")
    none = F.array().cast(_PROBLEMS)
    told_here = F.col("problems")
    if answers is not None:
        # sets of whole answers: most are empty, so little is left of them before the shuffle, however many items a value has
        clean, close = F.size("problems") == 0, F.col("near")
        below = answers.groupBy(F.col("parent").alias("of")).agg(
            F.collect_set("problems").alias("sets"),
            F.collect_set(F.when(close, F.col("problems"))).alias("close"),
            F.count_if(clean).alias("clean"),
            F.count_if(close).alias("many_close"),
        )
        own = own.join(below, F.col("item") == F.col("of"), "left")
        fits = F.when(F.col("one"), F.col("clean") == 1).otherwise(F.col("clean") > 0)
        no_branch = F.array(F.struct(F.lit("no_branch").alias("kind"), F.col("path").alias("path"))).cast(_PROBLEMS)
        union = F.when(fits, none).when((F.col("clean") == 0) & (F.col("many_close") == 1), F.get("close", F.lit(0))).otherwise(no_branch)
        every = F.array_distinct(F.concat("problems", F.flatten(F.coalesce("sets", F.array().cast(f"array<{_PROBLEMS}>")))))
        told_here = F.when(F.col("any") | F.col("one"), union).otherwise(every)
    done = own.select("item", "parent", "path", told_here.alias("problems"))
    return done.select("item", "parent", "problems", (~_misfit(F.col("problems"), F.col("path"))).alias("near"))


# -- types ----------------------------------------------------------------------


def record_type(schema: Schema | str | Mapping) -> T.StructType:
    """The Spark type of records that a schema of an object describes; the inverse of ``strict_schema``.

    A union with null, and a property that isn't required, may be null.  An object without declared keys is a map.  What no
    Spark type says (other unions, anything, recursion) is a variant.
    """
    schema = schema if isinstance(schema, Schema) else Schema(schema)
    kind, _ = _type_of(schema, schema.root, frozenset())
    if not isinstance(kind, T.StructType):
        raise SchemaError("a record is an object with declared keys")
    return kind


_TYPES = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def _type_of(schema: Schema, node: Node, inside: frozenset) -> tuple[T.DataType, bool]:
    """Type of a node, and whether it may be null."""
    node = schema.resolve(node)
    if node.number in inside:
        return T.VariantType(), True
    inside = inside | {node.number}
    if node.kind in _TYPES:
        return _TYPES[node.kind], bool(node.allowed and None in node.allowed)
    if node.kind == "array":
        kind, null = _type_of(schema, node.others, inside)
        return T.ArrayType(kind, null), False
    if node.kind == "object" and node.properties:
        fields = []
        for name, part in node.properties.items():
            kind, null = _type_of(schema, part, inside)
            fields.append(T.StructField(name, kind, null or name not in node.required))
        return T.StructType(fields), False
    if node.kind == "object":
        kind, null = _type_of(schema, node.others, inside)
        return T.MapType(T.StringType(), kind, null), False
    if node.kind == "nullable":
        return _type_of(schema, node.branches[0], inside)[0], True
    if node.kind == "any":
        some = [n for n in node.branches if schema.resolve(n).kind != "null"]
        null = len(some) < len(node.branches)
        kinds = [_type_of(schema, n, inside) for n in some]
        if kinds and all(k[0] == kinds[0][0] for k in kinds):
            return kinds[0][0], null or any(k[1] for k in kinds)
        return T.VariantType(), True
    if node.allowed:
        kinds = {T.StringType() if isinstance(a, str) else T.BooleanType() if isinstance(a, bool) else T.DoubleType() for a in node.allowed if a is not None}
        if len(kinds) == 1:
            return kinds.pop(), None in node.allowed
    return T.VariantType(), True


def strict_form(schema: str | Mapping) -> dict:
    """The schema with every declared key required and no other allowed, wherever it declares keys."""

    def strict(part, names: bool = False):
        if isinstance(part, list):
            return [strict(p) for p in part]
        if not isinstance(part, Mapping):
            return part
        # below these, keys are names and not keywords
        done = {k: strict(v, not names and k in ("properties", "$defs", "definitions")) if names or k not in ("const", "enum", "default", "examples") else v for k, v in part.items()}
        if not names and isinstance(part.get("properties"), Mapping):
            done |= {"required": list(part["properties"]), "additionalProperties": False}
        return done

    return strict(json.loads(schema) if isinstance(schema, str) else schema)
