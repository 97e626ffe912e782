"""Node tables: paths, intervals, parents; records rebuilt from their nodes; odd rows."""

import json
import random

from tidemill.operators.nested import KINDS, containing, nested_nodes, node_tables, parsed, subtree_sizes

ROWS = (
    "row_id bigint, messages array<struct<role string, content string, name string, tool_calls array<struct<type string, function struct<name string, arguments string>>>>>,"
    " tools array<struct<type string, function struct<name string, description string, parameters string>>>, node_path string, pre string"
)


def _row(key, arguments=None, parameters=None, messages=True, tools=True):
    call = [("function", ("f", arguments))]
    m = [("user", "hi", None, None), ("assistant", None, None, call)] if messages else None
    t = [("function", ("f", "", parameters))] if tools else None
    return (key, m, t, "x", "y")


def _found(spark, rows):
    nodes = nested_nodes(spark.createDataFrame(rows, ROWS))
    return {(r["node_path"], r["parent_path"]) for r in nodes.where("kind <> 'row'").collect()}


def test_paths(spark):
    arguments = {"a": 1, "b": {"c": None, "d": [1, 2]}, "e": [{"f": 1}, {"g": [{"h": 2}]}], "i": []}
    parameters = {"type": "object", "properties": {"p": {"type": "string"}, "q": {"type": "object", "properties": {"r": {}}}, "s": {"type": "array", "items": {"type": "object", "properties": {"t": {"type": "array", "items": {"properties": {"u": {}}}}}}}}}
    call, tool = "messages[1].tool_calls[0]", "tools[0]"
    want = {
        ("messages[0]", "$"), ("messages[1]", "$"), (call, "messages[1]"), (f"{call}.a", call), (f"{call}.b", call), (f"{call}.b.c", f"{call}.b"), (f"{call}.b.d", f"{call}.b"), (f"{call}.e", call), (f"{call}.e[0]", f"{call}.e"), (f"{call}.e[0].f", f"{call}.e[0]"),
        (f"{call}.e[1]", f"{call}.e"), (f"{call}.e[1].g", f"{call}.e[1]"), (f"{call}.e[1].g[0]", f"{call}.e[1].g"), (f"{call}.e[1].g[0].h", f"{call}.e[1].g[0]"), (f"{call}.i", call),
        (tool, "$"), (f"{tool}.p", tool), (f"{tool}.q", tool), (f"{tool}.q.r", f"{tool}.q"), (f"{tool}.s", tool), (f"{tool}.s[].t", f"{tool}.s"), (f"{tool}.s[].t[].u", f"{tool}.s[].t"),
    }
    assert _found(spark, [_row(1, json.dumps(arguments), json.dumps(parameters))]) == want
    assert _found(spark, [_row(1, json.dumps(json.dumps(arguments)), json.dumps(json.dumps(parameters)))]) == want


def test_odd_rows(spark):
    rows = [_row(1, None, None), _row(2, "{broken", "[1]"), _row(3, '"text"', "null"), (4, None, None, "", ""), (5, [], [], "", ""), (6, [None], [None], "", ""), (None, [], None, "", ""), _row(7, "{}", "{}"), _row(7, "{}", "{}")]
    nodes = nested_nodes(spark.createDataFrame(rows, ROWS)).collect()
    by = {}
    for n in nodes:
        by.setdefault(n["row_id"], []).append(n["node_path"])
    basic = ["$", "messages[0]", "messages[1]", "messages[1].tool_calls[0]", "tools[0]"]
    assert sorted(by[1]) == sorted(by[2]) == sorted(by[3]) == sorted(basic)
    assert by[4] == by[5] == by[None] == ["$"]
    assert sorted(by[6]) == ["$", "messages[0]", "tools[0]"]
    assert len(by[7]) == 10
    assert nested_nodes(spark.createDataFrame([], ROWS)).count() == 0


def test_deep_and_long(spark):
    deep: dict = {"x": "y" * 100_000}
    for _ in range(60):
        deep = {"d": deep}
    found = _found(spark, [_row(1, json.dumps(deep))])
    assert max(p.count(".d") for p, _ in found) == 60
    assert parsed("[" * 200_000) is None


def test_intervals_link_what_the_tree_links(spark, sf):
    nodes = nested_nodes(spark.read.parquet(f"{sf}/sft_row.parquet")).collect()
    by = {}
    for n in nodes:
        by.setdefault(n["row_id"], []).append(n)
    for own in by.values():
        at = {n["pre"]: n for n in own}
        for n in own:
            if n["kind"] == "row":
                assert n["parent_pre"] is None
                continue
            around = [o for o in own if o["pre"] < n["pre"] and o["post"] > n["post"]]
            parent = max(around, key=lambda o: o["pre"])
            assert parent["pre"] == n["parent_pre"] and parent["node_path"] == n["parent_path"] == at[n["parent_pre"]]["node_path"]
            assert len(around) == n["depth"]


def test_containing_on_random_trees():
    rng = random.Random(1)
    parents, post, count = [], {}, [0]

    def grow(parent, depth):
        at = len(parents)
        parents.append(parent)
        for _ in range(rng.randrange(4) if depth < 5 else 0):
            grow(at, depth + 1)
        post[at] = count[0]
        count[0] += 1

    for _ in range(50):
        grow(-1, 0)
    assert containing([post[i] for i in range(len(parents))]) == parents


def test_tables_and_subtrees(spark, sf):
    nodes = nested_nodes(spark.read.parquet(f"{sf}/sft_row.parquet")).cache()
    tables = node_tables(nodes)
    assert set(tables) == set(KINDS)
    assert sum(t.count() for t in tables.values()) == nodes.where("kind <> 'row'").count()
    sizes = subtree_sizes(nodes)
    assert sizes.agg({"n_below": "sum"}).first()[0] == nodes.where("kind in ('argument', 'property', 'tool_call')").count()
