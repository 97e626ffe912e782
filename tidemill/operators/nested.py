"""Deeply nested records as flat node tables, linked by interval containment.

Every node of a record gets the interval (pre, post) of a depth-first traversal: pre counts arrivals, post departures. Node a
is an ancestor of node b just when a.pre < b.pre and a.post > b.post, so a child's parent is the innermost interval around
its own, and whole subtrees join by containment without recursion. A record is labelled where it lies: there is no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("message", "tool_call", "argument", "tool", "property")
#: What the nodes of each kind say of themselves, beside their value: text of a message, JSON of an argument or of a property's schema.
ATTRIBUTES = {"message": ("role", "name", "value"), "tool_call": ("type", "name"), "argument": ("name", "value"), "tool": ("type", "name", "description"), "property": ("name", "type", "description", "required", "value")}
SAID = ("role", "type", "name", "description", "required", "value")
NODES = "row_id bigint, record bigint, kind string, node_path string, pre bigint, post bigint, depth int, parent_pre bigint, parent_path string, role string, type string, name string, description string, required boolean, value string"

Child = tuple[str, str, object, bool]  # path, name, value, whether it is required


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class _Walk:
    """Appends the nodes of records, one after the other, with numbers that run on through the batch. Depth is no limit: frames are a list."""

    def __init__(self, with_values: bool) -> None:
        self.kind: list[str] = []
        self.path: list[str] = []
        self.depth: list[int] = []
        self.post: list[int] = []
        self.row: list[int | None] = []
        self.record_of: list[int] = []
        self.said: dict[str, list] = {name: [] for name in SAID}
        self.done = 0
        self.row_id: int | None = None
        self.record = 0
        self.with_values = with_values

    def enter(self, kind: str, path: str, depth: int, **said: object) -> int:
        self.kind.append(kind)
        self.path.append(path)
        self.depth.append(depth)
        self.post.append(-1)
        self.row.append(self.row_id)
        self.record_of.append(self.record)
        if self.with_values:
            for name, values in self.said.items():
                values.append(said.get(name))
        return len(self.path) - 1

    def leave(self, at: int) -> None:
        self.post[at] = self.done
        self.done += 1

    def below(self, kind: str, children: Iterator[Child], depth: int, inside: Callable[[object, str], Iterator[Child] | None]) -> None:
        """Enters children, and what is inside each of them, depth first."""
        frames: list[tuple[int, Iterator[Child]]] = [(-1, children)]
        while frames:
            child = next(frames[-1][1], None)
            if child is None:
                at, _ = frames.pop()
                if at >= 0:
                    self.leave(at)
                continue
            path, name, value, required = child
            said = _said(kind, name, value, required) if self.with_values else {}
            at = self.enter(kind, path, depth + len(frames) - 1, **said)
            within = inside(value, path)
            if within is None:
                self.leave(at)
            else:
                frames.append((at, within))


def _said(kind: str, name: str, value: object, required: bool) -> dict[str, object]:
    if kind == "argument":
        return {"name": name, "value": None if type(value) is dict else _text(value)}
    schema = value if type(value) is dict else {}
    return {"name": name, "type": _text(schema.get("type")), "description": _text(schema.get("description")), "required": required, "value": _text(value)}


def _argument_fields(value: object, path: str) -> Iterator[Child] | None:
    """An object's fields; of an array the objects, and the arrays that have objects somewhere."""
    if type(value) is dict:
        return ((f"{path}.{key}", key, v, False) for key, v in value.items())
    if type(value) is list:
        return ((f"{path}[{n}]", str(n), v, False) for n, v in enumerate(value) if type(v) is dict or type(v) is list and _has_object(v))
    return None


def _declared(schema: object, path: str) -> Iterator[Child]:
    """The properties declared by a schema, and those of its arrays' items."""
    while type(schema) is dict:
        declared, required = schema.get("properties"), schema.get("required")
        if type(declared) is dict:
            named = required if type(required) is list else ()
            yield from ((f"{path}.{key}", key, v, key in named) for key, v in declared.items())
        schema, path = schema.get("items"), f"{path}[]"


def _has_object(array: list) -> bool:
    todo = [array]
    while todo:
        for x in todo.pop():
            if type(x) is dict:
                return True
            if type(x) is list:
                todo.append(x)
    return False


def parsed(text: str | None) -> object:
    """The value of JSON text, unwrapped where it is a JSON string that holds JSON again; None if it isn't JSON."""
    value: object = text
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def containing(post: list[int]) -> list[int]:
    """For intervals in order of pre: the position of the innermost interval around each one, -1 if there is none."""
    open_: list[int] = []
    parent = []
    for at, end in enumerate(post):
        while open_ and post[open_[-1]] < end:
            open_.pop()
        parent.append(open_[-1] if open_ else -1)
        open_.append(at)
    return parent


def _lists(array: pa.Array) -> tuple[list[int], list[bool], pa.Array]:
    """Offsets, nulls and elements of a list column."""
    return array.offsets.to_pylist(), array.is_null().to_pylist(), array.values


def _label(batches: Iterator[pa.RecordBatch], with_values: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            walk = _Walk(with_values)
            keys, records = part.column(0).to_pylist(), part.column(3).to_pylist()
            m_off, m_null, m = _lists(part.column(1))
            c_off, c_null, c = _lists(m.field("tool_calls"))
            t_off, t_null, t = _lists(part.column(2))
            texts = c.field("function").field("arguments").to_pylist()
            schemas = t.field("function").field("parameters").to_pylist()
            said = lambda fields, n: [dict(zip(fields, v, strict=True)) for v in zip(*(f.to_pylist() for f in fields.values()), strict=True)] if with_values else [{}] * n
            of_message = said({"role": m.field("role"), "name": m.field("name"), "value": m.field("content")}, len(m))
            of_call = said({"type": c.field("type"), "name": c.field("function").field("name")}, len(c))
            of_tool = said({"type": t.field("type"), "name": t.field("function").field("name"), "description": t.field("function").field("description")}, len(t))
            for k, (walk.row_id, walk.record) in enumerate(zip(keys, records, strict=True)):
                root = walk.enter("row", "$", 0)
                if not m_null[k]:
                    for i, at_m in enumerate(range(m_off[k], m_off[k + 1])):
                        message = walk.enter("message", f"messages[{i}]", 1, **of_message[at_m])
                        if not c_null[at_m]:
                            for j, at_c in enumerate(range(c_off[at_m], c_off[at_m + 1])):
                                call = walk.enter("tool_call", path := f"messages[{i}].tool_calls[{j}]", 2, **of_call[at_c])
                                inner = _argument_fields(parsed(texts[at_c]), path) if texts[at_c] is not None else None
                                if inner is not None:
                                    walk.below("argument", inner, 3, _argument_fields)
                                walk.leave(call)
                        walk.leave(message)
                if not t_null[k]:
                    for i, at_t in enumerate(range(t_off[k], t_off[k + 1])):
                        tool = walk.enter("tool", f"tools[{i}]", 1, **of_tool[at_t])
                        if schemas[at_t] is not None:
                            walk.below("property", _declared(parsed(schemas[at_t]), f"tools[{i}]"), 2, _declared)
                        walk.leave(tool)
                walk.leave(root)
            parent = pa.array(containing(walk.post), pa.int64())
            size = len(walk.path)
            paths = pa.array(walk.path, pa.string())
            at = pc.if_else(pc.less(parent, 0), None, parent)
            types = [pa.bool_() if name == "required" else pa.string() for name in SAID]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(walk.row, pa.int64()), pa.array(walk.record_of, pa.int64()), pa.array(walk.kind, pa.string()), paths, pa.array(range(size), pa.int64()), pa.array(walk.post, pa.int64()), pa.array(walk.depth, pa.int32()), at, paths.take(at),
                    *(pa.array(walk.said[name], kind) if with_values else pa.nulls(size, kind) for name, kind in zip(SAID, types, strict=True)),
                ],
                names=["row_id", "record", "kind", "node_path", "pre", "post", "depth", "parent_pre", "parent_path", *SAID],
            )


def nested_nodes(rows: DataFrame, with_values: bool = True) -> DataFrame:
    """All nodes of rows' messages and tools, with interval labels and the link to the parent.

    rows needs row_id, messages and tools; other columns are left out, whatever their names. The row itself is node `$` of
    kind row, without parent. pre and post are comparable within a record only. Null and empty arrays have no nodes; a null
    message, call or tool in an array is a node with nothing below; null, broken or scalar JSON has no nodes below. record is
    a number of each row's own, so rows with a null or repeated row_id are told apart by it. JSON may be nested as deep as the
    parser goes; deeper JSON counts as broken. An empty table gives none.
    """
    narrow = rows.select(F.col("row_id").cast("bigint").alias("row_id"), "messages", "tools", F.monotonically_increasing_id().alias("record"))
    return narrow.mapInArrow(lambda batches: _label(batches, with_values), NODES)


def node_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """One table per type of node, with what such nodes say. A child's (record, parent_pre) is its parent's (record, pre); subtrees
    join by intervals. nodes should be a written table, as each of these reads it."""
    links = ("row_id", "record", "pre", "post", "depth", "node_path", "parent_pre", "parent_path")
    return {kind: nodes.where(F.col("kind") == kind).select(*links, *ATTRIBUTES[kind]) for kind in KINDS}


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """Number of nodes below every message and tool, by interval containment within each record."""
    tops = nodes.where(F.col("kind").isin("message", "tool")).select("row_id", "record", F.col("kind").alias("top_kind"), F.col("node_path").alias("top_path"), F.col("pre").alias("top_pre"), F.col("post").alias("top_post"))
    below = nodes.where(~F.col("kind").isin("row", "message", "tool")).select(F.col("record").alias("_record"), "pre", "post")
    inside = (F.col("pre") > F.col("top_pre")) & (F.col("post") < F.col("top_post"))
    return tops.join(below, (F.col("record") == F.col("_record")) & inside, "left").groupBy("row_id", "record", "top_kind", "top_path").agg(F.count("pre").alias("n_below"))
