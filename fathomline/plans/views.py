"""The program view: functions, globals, calls, accesses and constraint edges read off the test tables.

Each view is one SELECT in the dialect that Spark and DuckDB share, with tables and
other views in braces, so the queries and their oracles start from the same rows.
Node numbers: values from 0, objects from 1,000,000,000 on.  An object is the function of
its number if that is a multiple of 5, else the global; an indirect call may reach every
function whose address is taken, of any number.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

OBJECT = 1_000_000_000

VIEWS: dict[str, str] = {
    "pv_func": """
SELECT c_custkey AS fid, concat('f', CAST(c_custkey AS STRING)) AS key, c_nationkey % 5 = 0 AS external, c_acctbal < 0 AS exported,
  c_mktsegment IN ('MACHINERY', 'BUILDING') AND c_custkey % 3 = 0 AS address_taken, CASE WHEN c_nationkey % 7 = 0 THEN 'fastcc' ELSE 'ccc' END AS cc,
  substr('IVS', CAST(1 + c_custkey % 3 AS INT), 1) AS ret, substr('ISIISSI', CAST(1 + c_nationkey % 2 AS INT), CAST(c_custkey % 5 AS INT)) AS params, c_custkey % 11 = 0 AS vararg
FROM {customer}""",
    "pv_global": """
SELECT p_partkey AS gid, concat('g', CAST(p_partkey AS STRING)) AS key, p_size % 10 = 0 AS is_const, p_brand LIKE '%1' AS exported, p_size % 7 <> 0 AS is_definition,
  CAST(8 * (1 + p_size % 4) AS BIGINT) AS size_bits
FROM {part}""",
    "pv_call": """
SELECT DISTINCT o_custkey AS src, 1 + (o_orderkey * 7919) % (SELECT max(c_custkey) FROM {customer}) AS dst FROM {orders} WHERE o_orderkey % 11 = 0""",
    "pv_icall": """
SELECT o_orderkey AS site, o_custkey AS caller, (o_orderkey * 31) % (2 * (SELECT count(*) FROM {customer})) AS operand,
  CASE WHEN o_orderkey % 7 = 0 THEN 'fastcc' ELSE 'ccc' END AS cc, substr('IVS', CAST(1 + o_orderkey % 3 AS INT), 1) AS ret,
  substr('ISIISSI', CAST(1 + o_orderkey % 2 AS INT), CAST(1 + o_orderkey % 4 AS INT)) AS params
FROM {orders} WHERE o_orderkey % 39 = 0""",
    "pv_modref": """
SELECT o_custkey AS func, l_partkey AS gvar, CASE WHEN l_returnflag = 'R' THEN 'mod' ELSE 'ref' END AS access,
  min(concat('f', CAST(o_custkey AS STRING), '@o', CAST(l_orderkey AS STRING), '.c:', CAST(l_linenumber AS STRING), ':1#0')) AS witness
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
    "pv_edge": """
SELECT DISTINCT kind, CASE WHEN kind = 'addr_of' THEN 1000000000 + (s + CASE WHEN w % 3 = 0 THEN 0 ELSE 1 END) % (n / 3) ELSE s END AS src, d AS dst, CASE WHEN kind = 'gep' THEN off END AS off, w AS width
FROM (
  SELECT CASE l_linenumber WHEN 1 THEN 'addr_of' WHEN 4 THEN 'load' WHEN 5 THEN 'store' WHEN 6 THEN 'gep' WHEN 7 THEN 'memcpy' ELSE 'assign' END AS kind,
    (l_partkey * 7907 + l_orderkey * 7919) % n AS s, (l_suppkey * 1301 + l_orderkey * 3571 + l_partkey * 17) % n AS d, CAST(l_quantity AS BIGINT) % 4 * 8 AS off, CAST(l_quantity AS BIGINT) % 8 + 1 AS w, n
  FROM {lineitem} CROSS JOIN (SELECT 138 * CAST(count(*) / 3 AS BIGINT) AS n FROM {customer}) c
) e""",
    "pv_cfg": """
SELECT DISTINCT l_orderkey AS func, CAST(l_linenumber AS BIGINT) AS src, CAST(1 + (l_linenumber + l_partkey) % 7 AS BIGINT) AS dst FROM {lineitem}
UNION SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT), CAST(l_linenumber AS BIGINT) FROM {lineitem} WHERE l_linenumber <= 2""",
    "pv_write": """
SELECT DISTINCT l_orderkey AS func, CAST(l_linenumber AS BIGINT) AS boundary, l_partkey % 8 AS gvar FROM {lineitem} WHERE l_returnflag = 'R'""",
    "pv_range": """
SELECT l_partkey AS root, l_orderkey AS region, CASE WHEN l_linenumber < 5 THEN CAST(l_quantity AS BIGINT) END AS off, CAST(CASE WHEN l_linenumber = 5 THEN 8 WHEN l_linenumber = 6 THEN 12 END AS BIGINT) AS modulus,
  CASE WHEN l_linenumber IN (5, 6) THEN CAST(l_quantity AS BIGINT) % 8 END AS residue, min(1 + CAST(l_tax * 100 AS BIGINT) % 8) AS width
FROM {lineitem} GROUP BY 1, 2, 3, 4, 5""",
    "pv_sfunc": """
SELECT fid, key, external, exported, CAST(length(params) AS BIGINT) AS nparams, vararg, CASE WHEN NOT external THEN key WHEN fid % 4 = 0 THEN 'strlen' WHEN fid % 4 = 1 THEN 'memcmp' WHEN fid % 4 = 2 THEN 'calloc' ELSE concat('ext_', key) END AS name
FROM {pv_func}""",
    "pv_stmt": """
SELECT func, CAST(idx AS BIGINT) AS idx, kind, concat('v', CAST(idx AS STRING)) AS dest,
  CASE WHEN p % 11 = 0 THEN 'null' WHEN p % 7 = 0 THEN concat('@f', CAST(s AS STRING)) WHEN p % 3 = 0 THEN concat('@g', CAST(p AS STRING)) ELSE concat('v', CAST(p % 6 AS STRING)) END AS op1,
  CASE WHEN s % 2 = 0 THEN concat('v', CAST(s % 5 AS STRING)) END AS op2, CASE WHEN kind = 'gep' THEN q * 8 END AS off,
  CASE WHEN kind = 'call_direct' THEN concat('f', CAST(1 + (o * 7919) % m AS STRING)) END AS callee, concat(func, '.c:', CAST(CAST(idx AS BIGINT) - CAST(idx AS BIGINT) % 2 AS STRING), ':1') AS loc
FROM (
  SELECT concat('f', CAST(o_custkey AS STRING)) AS func, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber) - 1 AS idx,
    CASE l_linenumber WHEN 1 THEN 'alloca' WHEN 2 THEN 'assign' WHEN 3 THEN 'load' WHEN 4 THEN 'store' WHEN 5 THEN 'gep' WHEN 6 THEN 'call_direct'
      ELSE CASE p % 6 WHEN 0 THEN 'call_indirect' WHEN 1 THEN 'memcpy' WHEN 2 THEN 'ptr_to_int' WHEN 3 THEN 'int_to_ptr' WHEN 4 THEN 'return' ELSE 'unknown' END END AS kind, p, s, q, l_orderkey AS o, m
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(CAST(l_quantity AS BIGINT)) AS q FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l
  JOIN {orders} ON l_orderkey = o_orderkey CROSS JOIN (SELECT max(c_custkey) AS m FROM {customer}) c
) t""",
    "pv_flow": """
SELECT func, idx, CAST(floor(idx / 4.0) AS BIGINT) AS block, kind, op1, callee, CASE WHEN idx % 17 <> 16 THEN func END AS file,
  CASE WHEN idx % 17 <> 16 THEN idx - idx % 2 - CASE WHEN idx % 13 = 0 THEN 6 ELSE 0 END END AS line
FROM {pv_stmt}""",
    "pv_branch": """
SELECT DISTINCT func, src, dst FROM (
  SELECT func, block AS src, CASE k WHEN 0 THEN block + 1 WHEN 1 THEN CASE WHEN block % 2 = 0 THEN block + 2 END WHEN 2 THEN CASE WHEN block % 6 = 5 THEN block - 1 END WHEN 3 THEN CASE WHEN block % 4 = 1 THEN last END END AS dst, last
  FROM (SELECT DISTINCT func, block, max(block) OVER (PARTITION BY func) AS last FROM {pv_flow}) f CROSS JOIN (SELECT 0 AS k UNION SELECT 1 UNION SELECT 2 UNION SELECT 3) k
) b WHERE src < last AND dst <= last""",
    "pv_touch": """
SELECT func, idx, CAST(substr(op1, 3) AS BIGINT) % 8 AS gvar, CASE WHEN kind IN ('store', 'memcpy') THEN 'mod' WHEN kind = 'ptr_to_int' THEN 'pin' ELSE 'ref' END AS access
FROM {pv_stmt} WHERE op1 LIKE '@g%'""",
    "pv_vastart": """
SELECT f.key AS func, s.dest AS value FROM {pv_sfunc} f LEFT JOIN (SELECT func, min(dest) AS dest FROM {pv_stmt} WHERE kind = 'alloca' AND dest <= 'v4' GROUP BY func) s ON s.func = f.key WHERE f.fid % 4 = 3 AND NOT f.external""",
    "pv_arg": """
SELECT s.func, s.callee, CAST(k AS BIGINT) AS pos, CASE k WHEN 0 THEN s.op1 ELSE s.op2 END AS value FROM {pv_stmt} s CROSS JOIN (SELECT 0 AS k UNION SELECT 1) p WHERE s.kind = 'call_direct'""",
    "pv_int": """
SELECT 8 * l_orderkey + l_linenumber AS dest, CASE WHEN l_linenumber <= 2 AND l_suppkey % 3 > 0 THEN 'cast' ELSE CASE l_suppkey % 8 WHEN 0 THEN 'mask' WHEN 1 THEN 'sub' WHEN 2 THEN 'either' WHEN 3 THEN 'sum' WHEN 4 THEN 'other' ELSE 'add' END END AS op,
  CASE WHEN l_linenumber <= 2 AND l_suppkey % 3 > 0 THEN l_partkey ELSE 8 * l_orderkey + 1 + l_partkey % 4 END AS lhs,
  8 * l_orderkey + 1 + (l_partkey + l_suppkey) % 6 AS rhs, CASE WHEN l_suppkey % 5 > 0 THEN 8 * (CAST(l_quantity AS BIGINT) % 7) END AS k, l_returnflag <> 'N' AS back
FROM {lineitem}""",
    "pv_trace": """
SELECT user_id AS caller, event_id AS target, CAST(event_id % 3 AS BIGINT) AS idx FROM {events}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _refs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a test table as a dataframe."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("n / 3", "n div 3")
    return spark.sql(sql, **{x: view(spark, sf_dir, x) for x in _refs(sql)})


def oracle(body: str, recursive: bool = False) -> str:
    """SQL for DuckDB: ``body`` with the views that it names in braces put before it.

    ``body`` is a SELECT, or further common table expressions and a SELECT, which
    then begin with a comma.
    """
    used = []

    def need(sql: str) -> None:
        for x in _refs(sql):
            if x in VIEWS and x not in used:
                need(VIEWS[x])
                used.append(x)

    need(body)
    plain = lambda sql: re.sub(r"\{(\w+)\}", r"\1", sql.replace("n / 3", "n // 3"))
    head = ", ".join(f"{x} AS ({plain(VIEWS[x])})" for x in used)
    body = plain(body).strip()
    rest = body if body.startswith(",") else f"\n{body}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{rest}"
