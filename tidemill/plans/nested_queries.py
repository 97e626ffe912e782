"""p4: deeply nested records as flat node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.nested import KINDS, nested_nodes, node_tables, subtree_sizes
from tidemill.runtime import written


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the node tables with its parent."""
    tables = nested_nodes(spark.read.parquet(f"{sf}/sft_row.parquet"), with_values=False)
    return tables.where(F.col("kind").isin(*KINDS)).select("row_id", "node_path", "parent_path")


def p4_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Size and depth of each node table."""
    nodes = nested_nodes(spark.read.parquet(f"{sf}/sft_row.parquet")).where(F.col("kind").isin(*KINDS))
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"), F.count("value").alias("with_value"), F.max("depth").alias("deepest"))


def p4_top_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Messages, calls and tools per row."""
    nodes = nested_nodes(spark.read.parquet(f"{sf}/sft_row.parquet"), with_values=False)
    n = lambda kind: F.sum((F.col("kind") == kind).cast("bigint"))
    return nodes.groupBy("row_id").agg(n("message").alias("messages"), n("tool_call").alias("calls"), n("tool").alias("tools")).where("messages + tools > 0")


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return node_tables(written(nested_nodes(spark.read.parquet(f"{sf}/sft_row.parquet")), "nodes"))


def p4_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The table of messages, with the number of calls that are linked to each."""
    tables = _tables(spark, sf)
    calls = tables["tool_call"].groupBy("record", F.col("parent_pre").alias("pre")).agg(F.count(F.lit(1)).alias("calls"))
    return tables["message"].join(calls, ["record", "pre"], "left").select("row_id", "node_path", "role", "name", F.length("value").alias("chars"), F.coalesce("calls", F.lit(0)).alias("calls"))


def p4_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """The table of calls, with the role of the message each is linked to."""
    tables = _tables(spark, sf)
    parent = tables["message"].select("record", F.col("pre").alias("parent_pre"), "role")
    return tables["tool_call"].join(parent, ["record", "parent_pre"]).select("row_id", "node_path", "parent_path", "type", "name", "role")


def p4_tools(spark: SparkSession, sf: str) -> DataFrame:
    """The table of tools, with the properties that are linked to each and how many of them are required."""
    tables = _tables(spark, sf)
    own = tables["property"].groupBy("record", F.col("parent_pre").alias("pre")).agg(F.count(F.lit(1)).alias("properties"), F.count_if("required").alias("required"))
    return tables["tool"].join(own, ["record", "pre"], "left").select("row_id", "node_path", "type", "name", "description", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("properties", "required")))


def p4_subtrees(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes below each message and tool, by interval containment."""
    nodes = written(nested_nodes(spark.read.parquet(f"{sf}/sft_row.parquet"), with_values=False), "nodes")
    return subtree_sizes(nodes).select("row_id", "top_path", "n_below")


P4_TOP_NODES = """
SELECT row_id, coalesce(len(messages), 0)::BIGINT AS messages,
       coalesce(list_sum([coalesce(len(m.tool_calls), 0) FOR m IN messages]), 0)::BIGINT AS calls,
       coalesce(len(tools), 0)::BIGINT AS tools
FROM sft_row WHERE coalesce(len(messages), 0) + coalesce(len(tools), 0) > 0
"""

#: JSON text, unwrapped where it is a JSON string that holds JSON; null where it isn't JSON.
_UNWRAP = "CASE WHEN json_valid({x}) THEN CASE WHEN json_type({x}) = 'VARCHAR' THEN CASE WHEN json_valid({x}->>'$') THEN ({x}->>'$') END ELSE {x} END END"
_CALLS = f"""m AS (SELECT row_id, unnest(range(len(messages))) AS i, unnest(messages) AS m FROM sft_row),
  c AS (SELECT row_id, i, m.role AS role, unnest(range(len(m.tool_calls))) AS j, unnest(m.tool_calls) AS c FROM m),
  t AS (SELECT row_id, unnest(range(len(tools))) AS i, unnest(tools) AS t FROM sft_row),
  tj AS (SELECT row_id, i, t, {_UNWRAP.format(x='t."function".parameters')} AS j FROM t)"""
#: Nodes below calls and tools, level by level: v is a node's own JSON.
_NODES = f"""{_CALLS},
  start AS (SELECT row_id, 'messages[' || i || '].tool_calls[' || j || ']' AS p, {_UNWRAP.format(x='c."function".arguments')}::JSON AS v FROM c),
  a AS (
    SELECT row_id, p, NULL::VARCHAR AS up, v, 2 AS d FROM start
    UNION ALL
    SELECT row_id, a.p || CASE json_type(a.v) WHEN 'OBJECT' THEN '.' || k.key ELSE '[' || k.key || ']' END AS p, a.p AS up, coalesce(k.value, 'null'::JSON) AS v, d + 1 AS d FROM a, json_each(a.v) k
    WHERE json_type(a.v) = 'OBJECT' OR json_type(a.v) = 'ARRAY' AND json_type(k.value) = 'OBJECT'
  ),
  q AS (
    SELECT row_id, 'tools[' || i || ']' AS p, NULL::VARCHAR AS up, 'tools[' || i || ']' AS own, j::JSON AS v, 'schema' AS what, false AS node, 1 AS d FROM tj WHERE j IS NOT NULL
    UNION ALL
    SELECT row_id, CASE WHEN what = 'properties' THEN q.p || '.' || k.key WHEN k.key = 'items' THEN q.p || '[]' ELSE q.p END AS p, CASE WHEN what = 'properties' THEN own ELSE up END AS up,
      CASE WHEN what = 'properties' THEN q.p || '.' || k.key ELSE own END AS own, k.value AS v, CASE WHEN what = 'schema' AND k.key = 'properties' THEN 'properties' ELSE 'schema' END AS what, what = 'properties' AS node, d + (what = 'properties')::INT AS d
    FROM q, json_each(q.v) k WHERE json_type(q.v) = 'OBJECT' AND (what = 'properties' OR k.key IN ('properties', 'items') AND json_type(k.value) = 'OBJECT')
  )"""
P4_FOUND = f"""
WITH RECURSIVE {_NODES}
SELECT row_id, 'messages[' || i || ']' AS node_path, '$' AS parent_path FROM m
UNION ALL SELECT row_id, 'messages[' || i || '].tool_calls[' || j || ']', 'messages[' || i || ']' FROM c
UNION ALL SELECT row_id, 'tools[' || i || ']', '$' FROM t
UNION ALL SELECT row_id, p, up FROM a WHERE up IS NOT NULL
UNION ALL SELECT row_id, p, up FROM q WHERE node
"""
P4_KINDS = f"""WITH RECURSIVE {_NODES}
SELECT 'message' AS kind, count(*) AS nodes, count(m.content) AS with_value, 1 AS deepest FROM m
UNION ALL SELECT 'tool_call', count(*), 0, 2 FROM c
UNION ALL SELECT 'tool', count(*), 0, 1 FROM t
UNION ALL SELECT 'argument', count(*), count(*) FILTER (json_type(v) NOT IN ('OBJECT', 'NULL')), max(d) FROM a WHERE up IS NOT NULL
UNION ALL SELECT 'property', count(*), count(*) FILTER (json_type(v) <> 'NULL'), max(d) FROM q WHERE node
"""
P4_MESSAGES = f"WITH {_CALLS} SELECT row_id, 'messages[' || i || ']' AS node_path, m.role AS role, m.name AS name, length(m.content) AS chars, coalesce(len(m.tool_calls), 0)::BIGINT AS calls FROM m"
P4_TOOL_CALLS = f"WITH {_CALLS} SELECT row_id, 'messages[' || i || '].tool_calls[' || j || ']' AS node_path, 'messages[' || i || ']' AS parent_path, c.type AS type, c.\"function\".name AS name, role FROM c"
P4_TOOLS = f"""WITH {_CALLS}, n AS (SELECT *, CASE WHEN json_type(j->'properties') = 'OBJECT' THEN json_keys(j->'properties') ELSE [] END AS k, CASE WHEN json_type(j->'required') = 'ARRAY' THEN (j->'required')::VARCHAR[] ELSE [] END AS r FROM tj)
SELECT row_id, 'tools[' || i || ']' AS node_path, t.type AS type, t."function".name AS name, t."function".description AS description, coalesce(len(k), 0)::BIGINT AS properties, coalesce(len(list_filter(k, lambda x: list_contains(r, x))), 0)::BIGINT AS required FROM n"""

P4_SUBTREES = f"""WITH RECURSIVE n AS ({P4_FOUND.strip()}),
  tops AS (SELECT * FROM n WHERE parent_path = '$'), below AS (SELECT * FROM n WHERE parent_path <> '$')
SELECT t.row_id, t.node_path AS top_path, count(b.node_path) AS n_below FROM tops t LEFT JOIN below b ON b.row_id = t.row_id AND (starts_with(b.node_path, t.node_path || '.') OR starts_with(b.node_path, t.node_path || '['))
GROUP BY ALL"""

QUERIES = {f.__name__: f for f in (p4_found, p4_kinds, p4_top_nodes, p4_messages, p4_tool_calls, p4_tools, p4_subtrees)}
ORACLES = {"p4_found": P4_FOUND, "p4_kinds": P4_KINDS, "p4_top_nodes": P4_TOP_NODES, "p4_messages": P4_MESSAGES, "p4_tool_calls": P4_TOOL_CALLS, "p4_tools": P4_TOOLS, "p4_subtrees": P4_SUBTREES}
