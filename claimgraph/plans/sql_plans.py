"""Plans over the driver tables that read alike in Spark SQL and in the oracle's dialect.

They show joins, counts and rankings of a graph at the size of the driver's tables: documents are artifacts, parts and
customers symbols, order lines reference edges. One text gives plan and oracle, so agreement says that two engines read it
alike; what the operators mean is tested by `sample_queries` and `table_queries`. Each entry is (tables, statement).
"""

from __future__ import annotations

ARTIFACTS = """SELECT doc_id, source, text, sha256(coalesce(text, '')) AS sha,
 substr(sha256(concat_ws(chr(31), 'source', coalesce(source, ''))), 1, 32) AS source_id FROM documents"""
EDGES = """SELECT concat('order:', CAST(o_orderkey AS {text})) AS subject, 'CONTAINS' AS predicate, concat('line:', CAST(l_orderkey AS {text}), '.', CAST(l_linenumber AS {text})) AS object FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT concat('customer:', CAST(o_custkey AS {text})), 'DEFINES', concat('order:', CAST(o_orderkey AS {text})) FROM orders
UNION ALL SELECT concat('line:', CAST(l_orderkey AS {text}), '.', CAST(l_linenumber AS {text})), 'CALLS', concat('part:', CAST(l_partkey AS {text})) FROM lineitem
UNION ALL SELECT concat('nation:', CAST(c_nationkey AS {text})), 'CONTAINS', concat('customer:', CAST(c_custkey AS {text})) FROM customer"""

PLANS: dict[str, tuple[tuple[str, ...], str]] = {
    "artifact_register": (("documents",), f"""WITH a AS ({ARTIFACTS})
SELECT doc_id, source_id, sha, substr(sha256(concat_ws(chr(31), 'artifact', source_id, CAST(doc_id AS {{text}}), sha)), 1, 32) AS artifact_id, octet_length({{bytes}}) AS size_bytes FROM a"""),
    "content_dedup_groups": (("documents",), f"WITH a AS ({ARTIFACTS}) SELECT sha, count(*) AS copies, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM a GROUP BY sha HAVING count(*) > 1"),
    "symbol_containment_tree": (("region", "nation", "customer"), """SELECT 'region' AS kind, r_name AS name, r_name AS qualified_name, 0 AS depth FROM region
UNION ALL SELECT 'nation', n_name, concat(r_name, '.', n_name), 1 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'customer', c_name, concat(r_name, '.', n_name, '.', c_name), 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "name_to_sole_definition": (("part",), "SELECT p_name AS name, count(*) AS definitions, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS sole_id FROM part GROUP BY p_name"),
    "reference_resolution": (("lineitem", "part"), """WITH d AS (SELECT p_name, count(*) AS n, min(p_partkey) AS id FROM part GROUP BY p_name)
SELECT l_orderkey, l_linenumber, p_name AS to_name, CASE WHEN d.n = 1 THEN 'DETERMINISTIC' ELSE 'UNRESOLVED' END AS resolution, CASE WHEN d.n = 1 THEN d.id END AS target, CASE WHEN d.n > 1 THEN 'ambiguous name' END AS reason
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN d USING (p_name)"""),
    "claims_build": (("orders", "lineitem", "customer"), f"""WITH e AS ({EDGES})
SELECT subject, predicate, object, substr(sha256(concat_ws(chr(31), 'claim', predicate, subject, object)), 1, 32) AS claim_id FROM e"""),
    "graph_statistics": (("orders", "lineitem", "customer"), f"WITH e AS ({EDGES}) SELECT predicate, count(*) AS claims, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects FROM e GROUP BY predicate"),
    "node_degree": (("orders", "lineitem", "customer"), f"""WITH e AS ({EDGES}), b AS (SELECT subject AS node, predicate FROM e UNION ALL SELECT object, predicate FROM e WHERE object <> subject)
SELECT node, predicate, count(*) AS degree FROM b GROUP BY node, predicate"""),
    "in_degree_hubs": (("orders", "lineitem", "customer"), f"WITH e AS ({EDGES}) SELECT object AS node, count(*) AS in_degree FROM e GROUP BY object ORDER BY in_degree DESC, node LIMIT 25"),
    "neighbourhood_two_hop": (("orders", "lineitem", "customer"), f"""WITH e AS ({EDGES}), u AS (SELECT subject AS a, object AS b FROM e UNION ALL SELECT object, subject FROM e),
h1 AS (SELECT DISTINCT b AS node FROM u WHERE a = 'customer:1'), h2 AS (SELECT DISTINCT u.b AS node FROM u JOIN h1 ON u.a = h1.node)
SELECT node, min(depth) AS depth FROM (SELECT node, 1 AS depth FROM h1 UNION ALL SELECT node, 2 FROM h2) x WHERE node <> 'customer:1' GROUP BY node"""),
    "foreign_key_audit": (("orders", "lineitem", "customer", "part"), """SELECT 'line without order' AS rule, count(*) AS violations FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'order without customer', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'line without part', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
UNION ALL SELECT 'order without lines', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'customer without orders', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)"""),
    "lines_kept_by_customer": (("orders", "lineitem"), """WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey AS owner, count(*) AS kept_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.o_orderkey = l_orderkey) GROUP BY o_custkey"""),
    "contents_outside_a_source": (("documents",), f"""WITH a AS ({ARTIFACTS}), old AS (SELECT DISTINCT sha FROM a WHERE source = 'src1'),
fresh AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.sha = a.sha)) SELECT sha, min(doc_id) AS doc_id FROM fresh GROUP BY sha"""),
    "events_by_user": (("events",), "SELECT user_id, max(event_id) AS last_event, count(*) AS attempts FROM events GROUP BY user_id"),
    "event_run_ledger": (("events",), "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY event_type"),
    "problem_artifacts_topk": (("documents",), "SELECT doc_id, n_chars FROM documents WHERE n_chars > 0 ORDER BY n_chars DESC, doc_id LIMIT 100"),
    "symbol_search": (("part",), "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'blue') OR contains(lower(p_name), 'green') ORDER BY length(p_name), p_name, p_partkey LIMIT 40"),
    "value_conflicts": (("part",), """WITH v AS (SELECT DISTINCT p_name AS subject, p_size AS value FROM part), k AS (SELECT subject, count(*) AS n_values, min(value) AS low, max(value) AS high FROM v GROUP BY subject)
SELECT subject, n_values, low, high, CASE WHEN n_values > 1 THEN 'DIFFERENT' ELSE 'SAME' END AS verdict FROM k"""),
    "multi_valued_no_conflict": (("lineitem",), "SELECT l_partkey AS subject, count(DISTINCT l_suppkey) AS n_values, CASE WHEN count(DISTINCT l_suppkey) > 1 THEN 'MULTI' ELSE 'SINGLE' END AS kind, 0 AS conflicts FROM lineitem GROUP BY l_partkey"),
    "part_name_ladder": (("part", "lineitem"), """WITH d AS (SELECT p_name, count(*) AS n, min(p_partkey) AS id FROM part GROUP BY p_name), c AS (SELECT l_partkey, count(*) AS claims, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY l_partkey)
SELECT p_name AS subject, CASE WHEN d.n > 1 THEN 'ABSTAIN_AMBIGUOUS' WHEN c.claims IS NULL THEN 'ABSTAIN' WHEN c.flags > 1 THEN 'EXPOSE_CONFLICTED' ELSE 'EXPOSE' END AS outcome,
CASE WHEN d.n > 1 THEN 'subject_unique' WHEN c.claims IS NULL THEN 'claims_exist' WHEN c.flags > 1 THEN 'conflict' END AS invariant FROM d LEFT JOIN c ON d.n = 1 AND c.l_partkey = d.id"""),
    "label_classes": (("labels",), """SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'GOOD' WHEN quality = 0 AND toxic = 1 THEN 'WORST' WHEN toxic = 1 THEN 'TOXIC' ELSE 'POOR' END AS consensus, CASE WHEN (quality = 1) = (toxic = 0) THEN 1 ELSE 0 END AS unanimous FROM labels"""),
    "halves_by_hash": (("labels",), """SELECT doc_id, CASE WHEN (row_number() OVER (PARTITION BY quality, toxic ORDER BY sha256(concat_ws(chr(31), 'split', CAST(doc_id AS {text}))), doc_id)) % 2 = 0 THEN 'TEST' ELSE 'DEV' END AS split FROM labels"""),
    "source_ranks": (("labels", "documents"), """WITH r AS (SELECT d.source, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rank FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
f AS (SELECT source, min(CASE WHEN quality = 0 THEN rank END) AS first_hit, sum(CASE WHEN quality = 0 AND rank <= 10 THEN 1 ELSE 0 END) AS hits10, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS relevant FROM r GROUP BY source)
SELECT source, coalesce(round(CAST(1 AS DOUBLE) / first_hit, 6), 0) AS reciprocal_rank, CASE WHEN relevant > 0 THEN round(CAST(hits10 AS DOUBLE) / relevant, 6) END AS recall_10 FROM f"""),
}


#: What differs between the dialects.
SPARK = {"text": "STRING", "bytes": "coalesce(text, '')"}
ORACLE = {"text": "VARCHAR", "bytes": "encode(coalesce(text, ''))"}


def _fill(sql: str, words: dict[str, str]) -> str:
    for key, value in words.items():
        sql = sql.replace("{" + key + "}", value)
    return sql


def spark_sql(name: str) -> str:
    return _fill(PLANS[name][1], SPARK)


def oracle_sql(name: str) -> str:
    return _fill(PLANS[name][1], ORACLE)
