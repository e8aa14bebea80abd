"""Raw rows to the canonical schema, and small row queries."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("input", "expected.route", "expected.routes")


def coerce_numeric(x: Column) -> Column:
    """A number from a string: with a point a double, else a whole number; null if it is neither ("1e5" isn't)."""
    t = F.trim(x)
    whole = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")).cast("double")
    return F.when(t.contains("."), t.try_cast("double")).otherwise(whole)


def check_mapping(mapping: dict[str, str], columns: list[str]) -> list[str]:
    """Source columns that nothing maps; an error if a required target is missing. The mapping is small and on the driver."""
    targets = list(mapping.values())
    missing = [r for r in REQUIRED if not any(t == r or t.startswith(f"{r}.") for t in targets)]
    if missing:
        raise ValueError(f"no source for {', '.join(missing)}")
    used = {s.split(".")[0] for s in mapping}
    return [c for c in columns if c not in used]


_OBJECT = "map<string, variant>"
#: A string that reads as a number: whole, or with a point.
_NUMBER = r"^[+-]?(\d+|[\x00-\x20]*(\d+\.\d*|\.\d+)([eE][+-]?\d+)?[\x00-\x20]*)$"


def _segments(path: str) -> tuple[str, ...]:
    parts = tuple(path.split("."))
    if "" in parts:
        raise ValueError(f"an empty name in {path!r}")
    return parts


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _apart(value: Column, name: str) -> Column:
    """value as a column that filters aren't pushed through: a filter on what is made of it would work out a copy of the whole mapping for each mention."""
    return F.explode(F.array(value)).alias(name)


def _text(value: Column) -> Column:
    """A variant's string, trimmed; null if it is none. Of all that JSON knows only strings can be read as binary, so this doesn't look into objects."""
    return F.trim(F.try_variant_get(value, "$", "binary").cast("string"))


def _numeric(value: Column, text: Column) -> Column:
    """The number that a string (whose text is given) reads as, whole or with a point; anything else as it is."""
    number = F.when(text.contains("."), text.try_cast("double").cast("variant")).otherwise(text.try_cast("bigint").cast("variant"))
    return F.coalesce(F.when(text.rlike(_NUMBER) & (F.schema_of_variant(value) == "STRING"), number), value)


class _Source(NamedTuple):
    """Where a source path has come to: the value there, the stars and names still to go, and what that place is called."""

    value: Column
    rest: tuple[str, ...]
    at: tuple = ()
    number: bool = False
    nulls: bool = True  # whether a JSON null counts

    def below(self) -> _Source:
        """After the names up to the next star or the end."""
        x, rest, at = self.value, self.rest, self.at
        while rest and rest[0] != "*":
            x, rest, at = x[rest[0]], rest[1:], (*at, rest[0])
        return self._replace(value=x, rest=rest, at=at)

    def inside(self, value: Column) -> _Source:
        """At a value of the object whose keys the next star stands for."""
        return self._replace(value=value, rest=self.rest[1:], at=(*self.at, "*")).below()

    def leaf(self, value: Column) -> Column:
        """The value as read, if it counts."""
        return value if self.nulls else F.when(~F.is_variant_null(self.value), value)

    def last(self) -> Column:
        """The value at the end, the last one in the order of the keys where stars are left; null if there is none."""
        if not self.rest:
            return self.leaf(_once(_text(self.value), lambda t: _numeric(self.value, t)) if self.number else self.value)

        def values(s: _Source) -> Column:
            return F.filter(F.transform(F.map_values(s.value), lambda x: end(s.inside(x))), lambda x: x.isNotNull())

        def end(s: _Source) -> Column:
            return F.try_element_at(values(s), F.lit(-1)) if s.rest else s.value

        return _once(end(self), lambda x: self._replace(value=x, rest=()).last())


def _fits(tree: dict, path: tuple[str, ...]) -> bool:
    """Whether a path can be read together with those in the tree: a place is a value, an object of any keys or one of given names, which differ by more than case."""
    name, rest = path[0], path[1:]
    if name in tree:
        return bool(rest and tree[name]) and _fits(tree[name], rest)
    return not tree or "*" not in (name, *tree) and name.lower() not in map(str.lower, tree)


def _type(tree: dict) -> str:
    if not tree:
        return "variant"
    if "*" in tree:
        return f"map<string, {_type(tree['*'])}>"
    return "struct<" + ", ".join(f"`{name.replace('`', '``')}`: {_type(below)}" for name, below in tree.items()) + ">"


def _read_together(paths: list[tuple[str, ...]]) -> tuple[list[str], list[int]]:
    """The types by which all paths are read, a few as most fit together, and the number of each path's type."""
    trees: list[dict] = []
    numbers = []
    for path in paths:
        n = next((n for n, tree in enumerate(trees) if _fits(tree, path)), len(trees))
        if n == len(trees):
            trees.append({})
        at = trees[n]
        for name in path:
            at = at.setdefault(name, {})
        numbers.append(n)
    return [_type(tree) for tree in trees], numbers


class _Node(NamedTuple):
    """What is built at a place of the targets: a variant (null if nothing is there), or variants under so many levels of maps (null or empty)."""

    value: Column
    levels: int

    def there(self) -> Column:
        return F.size(self.value) > 0 if self.levels else self.value.isNotNull()

    def variant(self) -> Column:
        return _once(self.value, lambda x: F.when(F.size(x) > 0, F.call_function("to_variant_object", x))) if self.levels else self.value


def _known(objects: Column, levels: int) -> _Node:
    return _Node(F.map_filter(objects, lambda _, x: _Node(x, levels).there()), levels + 1)


def _built(parts: list[tuple[tuple[str, ...], _Source]]) -> _Node:
    """The value under one node of the targets, of what is left of each target and its source.

    A node that any target passes by a star has a key for every captured one and every fixed name.
    """
    ends, parts = [source for rest, source in parts if not rest], [p for p in parts if p[0]]
    if ends:
        last = F.coalesce(*[source.last() for source in reversed(ends)]) if len(ends) > 1 else ends[0].last()
        if not parts:
            return _Node(last, 0)

        def merged(x: Column) -> Column:
            own = _Source(F.try_variant_get(x, "$", _OBJECT), ("*",), ("own", len(parts)))
            return F.coalesce(_built([(("*",), own), *parts]).variant(), x)

        return _Node(_once(last, merged), 0)
    if any(rest[0] == "*" for rest, _ in parts):
        return _by_key(parts)
    names = dict.fromkeys(rest[0] for rest, _ in parts)
    below = {name: _built([(rest[1:], source) for rest, source in parts if rest[0] == name]) for name in names}
    levels = {node.levels for node in below.values()}
    even = levels.pop() if len(levels) == 1 else 0
    pairs = [x for name, node in below.items() for x in (F.lit(name), node.value if node.levels == even else node.variant())]
    return _known(F.create_map(*pairs), even)


def _by_key(parts: list[tuple[tuple[str, ...], _Source]]) -> _Node:
    """A node with a star: its objects meet by their keys, a fixed name as an object of one key; sources that come from the same object pass together."""
    groups: dict[tuple, list[int]] = {}
    for i, (rest, source) in enumerate(parts):
        groups.setdefault(("*", source.at) if rest[0] == "*" else (rest[0],), []).append(i)

    def objects(group: tuple, members: list[int]) -> Column:
        if len(group) == 2:
            return parts[members[0]][1].value
        return F.create_map(F.lit(group[0]), F.struct(*[parts[i][1].value.alias(f"f{i}") for i in members]))

    levels = []

    def at(values: list[Column]) -> Column:
        inner = {}
        for (group, members), x in zip(groups.items(), values):
            for i in members:
                rest, source = parts[i]
                inner[i] = (rest[1:], source.inside(x) if len(group) == 2 else source._replace(value=x[f"f{i}"]))
        node = _built([inner[i] for i in range(len(parts))])
        levels.append(node.levels)
        return node.value

    first, *others = [objects(*g) for g in groups.items()]
    if not others:
        return _known(F.map_from_arrays(F.map_keys(first), F.transform(F.map_values(first), lambda x: at([x]))), levels[-1])
    first, *others = [F.coalesce(x, F.create_map()) for x in (first, *others)]
    for n, other in enumerate(others, 1):
        unpacked = lambda x, n=n: [x] if n == 1 else [x[f"g{j}"] for j in range(n)]
        if n == len(others):
            met = F.map_zip_with(first, other, lambda _, x, y: at([*unpacked(x), y]))
        else:
            first = F.map_zip_with(first, other, lambda _, x, y: F.struct(*[z.alias(f"g{j}") for j, z in enumerate([*unpacked(x), y])]))
    return _known(met, levels[-1])


class _Columns:
    """The nodes that no star and no value stands above, as columns of a few projections one after the other.

    These are generated code, where functions over arrays and maps are interpreted. A column that is used twice keeps its projection apart.
    """

    def __init__(self):
        self.stages: list[dict[str, Column]] = []

    def put(self, stage: int, value: Column) -> Column:
        while len(self.stages) <= stage:
            self.stages.append({})
        name = f"c{sum(map(len, self.stages))}"
        self.stages[stage][name] = value
        return F.col(name)

    def built(self, parts: list[tuple[tuple[str, ...], _Source]]) -> tuple[_Node, int]:
        """The node and the first stage that can use it."""
        (rest, source), *others = parts
        if not rest and not others and not source.rest:  # a value by names alone
            if not source.number:
                return _Node(self.put(0, source.leaf(source.value)), 0), 1
            text = self.put(0, _text(source.value))
            return _Node(self.put(1, source.leaf(_numeric(source.value, text))), 0), 2
        if any(not rest or rest[0] == "*" for rest, _ in parts):
            node = _built(parts)
            return node._replace(value=self.put(0, node.value)), 1
        below = [(name, *self.built([(rest[1:], source) for rest, source in parts if rest[0] == name])) for name in dict.fromkeys(rest[0] for rest, _ in parts)]
        stage = max(after for _, _, after in below)
        if len(below) == 1:
            (name, node, _), *_ = below
            return _Node(self.put(stage, F.when(node.there(), F.create_map(F.lit(name), node.value))), node.levels + 1), stage + 1
        held = [(name, self.variant(node, stage)) for name, node, _ in below]
        none = F.create_map().cast(_OBJECT)
        entries = [F.when(x.isNotNull(), F.create_map(F.lit(name), x)).otherwise(none) for name, x in held]
        return _Node(self.put(stage + 1, F.map_concat(*entries)), 1), stage + 2

    def variant(self, node: _Node, stage: int) -> Column:
        return self.put(stage, F.when(node.there(), F.call_function("to_variant_object", node.value))) if node.levels else node.value


def mapped_documents(rows: DataFrame, mapping: dict[str, str], v: str = "v") -> DataFrame:
    """row_idx, doc: the target document (a variant) of each raw row, by source path -> target path, compiled to a few projections.

    Paths are names with points between; a star stands for every key of an object. The stars of a target take the keys
    of its source's stars in their order, and sources meet by these keys, so costs and scores may come from two objects;
    fixed names stand beside starred ones. Later entries of the mapping go over earlier ones, and where a target has
    fewer stars than its source the last key in order counts. Targets inside an object that is mapped whole go over its
    own keys, and over a value that isn't an object. Missing paths, and nulls of paths without a star, leave nothing. Strings that read as numbers become numbers,
    except in id and input. Rows without an id get row-<row_idx>.
    """
    pairs = [(_segments(s), _segments(t)) for s, t in mapping.items()]
    for source, target in pairs:
        if target.count("*") > source.count("*"):
            raise ValueError(f"{'.'.join(target)} has more stars than {'.'.join(source)}")
    types, numbers = _read_together([source for source, _ in pairs])
    docs = rows.select("row_idx", *[F.try_variant_get(v, "$", t).alias(f"r{n}") for n, t in enumerate(types)])
    parts = [(target, _Source(F.col(f"r{n}"), source, (n,), target[0] not in ("id", "input"), "*" in source).below()) for (source, target), n in zip(pairs, numbers)]
    if not any(target[0] == "id" and len(target) > 1 for _, target in pairs):
        parts.insert(0, (("id",), _Source(F.concat(F.lit("row-"), "row_idx").cast("variant"), ())))
    columns = _Columns()
    doc = columns.variant(*columns.built(parts))
    for stage in filter(None, columns.stages):
        docs = docs.withColumns(stage)
    return docs.select("row_idx", _apart(doc, "doc"))


def apply_mapping(rows: DataFrame, mapping: dict[str, str], v: str = "v") -> DataFrame:
    """row_idx, id, input, route, routes: the canonical fields of mapped_documents. A cost or score that isn't a number is null."""
    docs = mapped_documents(rows, mapping, v)
    read = lambda x, field: coerce_numeric(F.try_variant_get(x, f"$.{field}", "string")).alias(field)
    routes = F.transform_values(F.try_variant_get("doc", "$.expected.routes", _OBJECT), lambda _, x: F.struct(read(x, "cost"), read(x, "quality_score")))
    text = lambda path: F.try_variant_get("doc", path, "string")
    return docs.select("row_idx", text("$.id").alias("id"), text("$.input").alias("input"), text("$.expected.route").alias("route"), _apart(routes, "routes"))


def route_not_in_routes(examples: DataFrame) -> DataFrame:
    """Rows whose route isn't a key of their routes: a job that needs them sound stops if there are any."""
    return examples.where("routes IS NOT NULL").where(~F.coalesce(F.map_contains_key("routes", F.col("route")), F.lit(False)))


def assert_route_in_routes(examples: DataFrame) -> None:
    bad = route_not_in_routes(examples)
    n = bad.count()
    if n:
        sample = [r["id"] for r in bad.orderBy("row_idx").limit(3).collect()]
        raise ValueError(f"{n} rows have a route that isn't among their routes, such as {', '.join(sample)}")


def excerpt(text: Column, most: int = 300) -> Column:
    """White space collapsed; cut with three dots beyond `most` characters."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def query_examples(examples: DataFrame, ids: list[str] | None = None, route: str | None = None, offset: int = 0, limit: int = 10) -> DataFrame:
    """A page of at most 50 examples in file order; ids count before a route."""
    if ids is not None:
        examples = examples.where(F.col("id").isin(ids))
    elif route is not None:
        examples = examples.where(F.col("route") == route)
    return examples.orderBy("row_idx", "id").offset(offset).limit(max(1, min(50, limit)))


def query_eval_results(results: DataFrame, examples: DataFrame, ids: list[str] | None = None, pair: tuple[str, str] | None = None, misroutes_only: bool = False, limit: int = 50) -> DataFrame:
    """Results with output and their examples, filtered by ids, else a (true, predicted) pair, else wrong ones; with an excerpt of the input, what the call cost and the quality of the route predicted."""
    j = results.where("output IS NOT NULL").join(examples.select(F.col("id").alias("example_id"), "input", "route", "routes").where("route IS NOT NULL"), "example_id").withColumn("pred", F.col("output.route"))
    if ids is not None:
        j = j.where(F.col("example_id").isin(ids))
    elif pair is not None:
        j = j.where((F.col("route") == pair[0]) & (F.col("pred") == pair[1]))
    elif misroutes_only:
        j = j.where("pred <> route")
    quality = F.try_element_at("routes", F.col("pred"))["quality_score"]
    return j.where("pred IS NOT NULL").select("version", "example_id", excerpt(F.coalesce("input", F.lit(""))).alias("input"), "route", "pred", "cost", quality.alias("pred_quality")).orderBy("version", "example_id").limit(max(1, min(50, limit)))
