"""Building blocks of the check SQL: the canonical views as CTEs."""

from __future__ import annotations


def r6(value: str) -> str:
    return f"floor(({value}) * CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000000 AS DOUBLE)"


IX_EVENTS = """ix_events AS (
  SELECT user_id AS USER_ID, CAST(json_extract(props, '$.k') AS BIGINT) AS ITEM_ID, ts AS TS,
         CAST(floor(epoch(ts)) AS BIGINT) AS "TIMESTAMP", event_type AS EVENT_TYPE, value AS EVENT_VALUE
  FROM events)"""

IX_ORDERS = """ix_orders AS (
  SELECT o_custkey AS USER_ID, l_partkey AS ITEM_ID, o_orderdate AS TS, l_returnflag AS EVENT_TYPE,
         l_quantity AS EVENT_VALUE
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

USERS = """users AS (
  SELECT c_custkey AS USER_ID, c_mktsegment AS SEGMENT, CAST(c_nationkey AS BIGINT) AS NATION FROM customer)"""

ITEMS = "items AS (SELECT p_partkey AS ITEM_ID, p_type AS TYPE, p_brand AS BRAND FROM part)"

RUNS = """runs AS (
  SELECT o_custkey AS parent, o_orderkey AS run_id,
         CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'CREATE IN_PROGRESS' ELSE 'CREATE FAILED' END AS status,
         o_orderdate AS created, greatest(o_orderdate, coalesce(shipped, o_orderdate)) AS last_updated,
         o_orderpriority AS priority
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1)
       ON l_orderkey = o_orderkey)"""

EDGES = """edges AS (
  SELECT 'region/' || n_regionkey AS parent, 'nation/' || n_nationkey AS child FROM nation
  UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey FROM customer
  UNION ALL SELECT 'customer/' || o_custkey, 'order/' || o_orderkey FROM orders)"""

OWNERS = """owners AS (
  SELECT p.parent AS owner, p.child, 1 AS level FROM edges p WHERE p.parent LIKE 'region/%'
  UNION ALL
  SELECT a.parent, b.child, 2 FROM edges a JOIN edges b ON b.parent = a.child WHERE a.parent LIKE 'region/%'
  UNION ALL
  SELECT a.parent, c.child, 3 FROM edges a JOIN edges b ON b.parent = a.child JOIN edges c ON c.parent = b.child
  WHERE a.parent LIKE 'region/%')"""


def similar(source: str, name: str = "nearby", k: int = 25) -> str:
    """Neighbours of every item of ``source`` as CTE ``name``."""
    score = r6("c / sqrt(CAST(na.n AS DOUBLE) * CAST(nb.n AS DOUBLE))")
    return f"""{name}_seen AS (SELECT DISTINCT USER_ID, ITEM_ID FROM {source}),
{name}_n AS (SELECT ITEM_ID, count(*) AS n FROM {name}_seen GROUP BY ITEM_ID),
{name}_pairs AS (
  SELECT a.ITEM_ID AS a, b.ITEM_ID AS b, count(*) AS c
  FROM {name}_seen a JOIN {name}_seen b ON a.USER_ID = b.USER_ID AND a.ITEM_ID <> b.ITEM_ID GROUP BY 1, 2),
{name}_scored AS (
  SELECT a AS ITEM_ID, b AS SIMILAR_ID, {score} AS score
  FROM {name}_pairs JOIN {name}_n na ON na.ITEM_ID = a JOIN {name}_n nb ON nb.ITEM_ID = b),
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY ITEM_ID ORDER BY score DESC, SIMILAR_ID) AS rank FROM {name}_scored)
  WHERE rank <= {k})"""


def affinity(source: str, near: str = "nearby", name: str = "affinity") -> str:
    """Raw user-item scores as CTE ``name``."""
    return f"""{name} AS (
  SELECT s.USER_ID, near.SIMILAR_ID AS ITEM_ID, {r6('sum(near.score)')} AS score
  FROM (SELECT DISTINCT USER_ID, ITEM_ID FROM {source}) s JOIN {near} near ON near.ITEM_ID = s.ITEM_ID
  GROUP BY 1, 2)"""


def ranked(source: str, by: str, id: str, name: str, k: int = 25, where: str = "TRUE") -> str:
    """Best ``k`` rows per ``by`` as CTE ``name``."""
    return f"""{name} AS (
  SELECT * FROM (
    SELECT {by}, {id}, score, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {id}) AS rank
    FROM {source} WHERE {where})
  WHERE rank <= {k})"""


def personal(source: str, users: str | None, name: str = "lists", k: int = 25) -> str:
    """Personal lists, with popular items for users without interactions."""
    fresh = f"NOT EXISTS (SELECT 1 FROM {source} x WHERE x.USER_ID = affinity.USER_ID AND x.ITEM_ID = affinity.ITEM_ID)"
    warm = ranked("affinity", "USER_ID", "ITEM_ID", f"{name}_warm", k, fresh)
    if users is None:
        return f"{warm},\n{name} AS (SELECT * FROM {name}_warm)"
    return f"""{warm},
{name}_top AS (
  SELECT * FROM (
    SELECT ITEM_ID, count(*) AS score, row_number() OVER (ORDER BY count(*) DESC, ITEM_ID) AS rank
    FROM {source} GROUP BY ITEM_ID)
  WHERE rank <= {k}),
{name} AS (
  SELECT * FROM {name}_warm
  UNION ALL
  SELECT u.USER_ID, t.ITEM_ID, CAST(t.score AS DOUBLE), t.rank
  FROM (SELECT DISTINCT USER_ID FROM {users}) u CROSS JOIN {name}_top t
  WHERE NOT EXISTS (SELECT 1 FROM {source} x WHERE x.USER_ID = u.USER_ID))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
