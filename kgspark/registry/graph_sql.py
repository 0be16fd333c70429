"""The graph of the order tables in SQL, for the twins of graph queries."""

B = "https://example.org/kg/"


def i(kind: str, column: str) -> str:
    return f"'{B}{kind}/' || {column}"


EDGES = f"""
nodes AS (SELECT {i("Region", "r_regionkey")} AS iri, 'Region' AS kind, r_name AS label FROM region
  UNION ALL SELECT {i("Nation", "n_nationkey")}, 'Nation', n_name FROM nation
  UNION ALL SELECT {i("Customer", "c_custkey")}, 'Customer', c_name FROM customer
  UNION ALL SELECT {i("Supplier", "s_suppkey")}, 'Supplier', s_name FROM supplier
  UNION ALL SELECT {i("Part", "p_partkey")}, 'Part', p_name FROM part
  UNION ALL SELECT {i("Order", "o_orderkey")}, 'Order', 'Order#' || o_orderkey FROM orders),
within AS (SELECT {i("Nation", "n_nationkey")} AS s, {i("Region", "n_regionkey")} AS o FROM nation),
based_in AS (SELECT {i("Customer", "c_custkey")} AS s, {i("Nation", "c_nationkey")} AS o FROM customer
  UNION ALL SELECT {i("Supplier", "s_suppkey")}, {i("Nation", "s_nationkey")} FROM supplier),
places AS (SELECT {i("Customer", "o_custkey")} AS s, {i("Order", "o_orderkey")} AS o FROM orders),
places_urgent AS (SELECT {i("Customer", "o_custkey")} AS s, {i("Order", "o_orderkey")} AS o FROM orders WHERE o_orderpriority = '1-URGENT'),
contains AS (SELECT DISTINCT {i("Order", "l_orderkey")} AS s, {i("Part", "l_partkey")} AS o FROM lineitem),
supplied_by AS (SELECT DISTINCT {i("Part", "l_partkey")} AS s, {i("Supplier", "l_suppkey")} AS o FROM lineitem),
involves AS (SELECT * FROM contains UNION ALL SELECT DISTINCT {i("Order", "l_orderkey")}, {i("Supplier", "l_suppkey")} FROM lineitem),
segment AS (SELECT {i("Customer", "c_custkey")} AS s, c_mktsegment AS o FROM customer),
brand AS (SELECT {i("Part", "p_partkey")} AS s, p_brand AS o FROM part),
size AS (SELECT {i("Part", "p_partkey")} AS s, CAST(p_size AS VARCHAR) AS o FROM part),
status AS (SELECT {i("Order", "o_orderkey")} AS s, o_orderstatus AS o FROM orders),
priority AS (SELECT {i("Order", "o_orderkey")} AS s, o_orderpriority AS o FROM orders),
notes AS (SELECT DISTINCT {i("Order", "l_orderkey")} AS s, {i("Part", "l_partkey")} AS o, key, value FROM
  (SELECT l_orderkey, l_partkey, unnest(['quantity', 'linenumber', 'returnflag']) AS key,
   unnest([CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), CAST(l_linenumber AS VARCHAR), l_returnflag]) AS value FROM lineitem))
"""
_NAMES = ["within", "based_in", "places", "places_urgent", "contains", "supplied_by", "involves"]
_LITERALS = ["segment", "brand", "size", "status", "priority"]
TRIPLES = "triples AS (" + " UNION ALL ".join(
    [f"SELECT iri AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, '{B}class/' || kind AS o, 'iri' AS o_kind FROM nodes", "SELECT iri, 'http://www.w3.org/2000/01/rdf-schema#label', label, 'literal' FROM nodes"]
    + [f"SELECT s, '{B}p/{n}', o, 'iri' FROM {n}" for n in _NAMES]
    + [f"SELECT s, '{B}p/{n}', o, 'literal' FROM {n}" for n in _LITERALS]
) + ")"


def sql(body: str, triples: bool = False, more: str = "", recursive: bool = False) -> str:
    """A query over the graph's relations; more: further common tables."""
    return f"WITH {'RECURSIVE ' * recursive}{EDGES}{', ' + TRIPLES if triples else ''}{', ' + more if more else ''}\n{body}"
