"""Registered queries and the DuckDB SQL that checks them.

The tables hold no source code, so each operator runs on data of the same shape: an order is a commit, its
customer the author and its parts the files; consecutive lines of an order are calls between parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import annotations, text
from gneiss.operators import checksums, graph, history, resolve, snapshot, store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- history -------------------------------------------------------------------------------------------------


def listings(spark: SparkSession, d: str) -> DataFrame:
    """commit, file: each part of an order once."""
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")).distinct()


def dated(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("committed_at"))
    return listings(spark, d).join(orders, "commit")


LISTED = "listed AS (SELECT DISTINCT l_orderkey AS commit, l_partkey AS file FROM lineitem)"


@query(f"WITH {LISTED} SELECT file, count(*) AS churn FROM listed GROUP BY file")
def churn_by_file(spark, d):
    return history.churn(listings(spark, d))


@query(f"""WITH {LISTED}, newest AS (SELECT max(o_orderdate) AS at_ FROM orders JOIN listed ON commit = o_orderkey)
SELECT file, count(*) AS churn FROM listed JOIN orders ON commit = o_orderkey, newest WHERE o_orderdate >= at_ - INTERVAL 365 DAYS GROUP BY file""")
def churn_since_days(spark, d):
    return history.churn(history.since_days(dated(spark, d), 365))


PAIRS = f"""{LISTED}, pairs AS (SELECT a.file, b.file AS partner, count(*) AS frequency FROM listed a JOIN listed b ON a.commit = b.commit AND a.file <> b.file
GROUP BY ALL HAVING count(*) >= 2)"""


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def cochange_pairs(spark, d):
    return history.cochange_pairs(listings(spark, d), 2)


@query(f"WITH {PAIRS} SELECT file, CAST(sum(frequency) AS BIGINT) AS frequency_sum, string_agg(partner || ':' || frequency, ',' ORDER BY frequency DESC, partner) AS partners FROM pairs GROUP BY file")
def cochange_partner_sum(spark, d):
    found = history.cochange_partners(history.cochange_pairs(listings(spark, d), 2))
    shown = F.transform("partners", lambda p: F.concat(p["file"].cast("string"), F.lit(":"), p["frequency"].cast("string")))
    return found.select("file", "frequency_sum", F.array_join(shown, ",").alias("partners"))


OWNED = f"""{LISTED}, n AS (SELECT file, o_custkey AS author, count(*) AS n FROM listed JOIN orders ON commit = o_orderkey GROUP BY ALL)"""


@query(f"WITH {OWNED} SELECT file, CAST(author AS VARCHAR) AS author, n FROM n WHERE author % 3 <> 0")
def author_counts(spark, d):
    author = F.when(F.col("author") % 3 == 0, "  ").otherwise(F.col("author").cast("string"))
    return history.author_counts(dated(spark, d).withColumn("author", author))


@query(f"WITH {OWNED} SELECT file, author AS owner, n AS commits FROM n QUALIFY row_number() OVER (PARTITION BY file ORDER BY n DESC, author) = 1")
def ownership(spark, d):
    return history.ownership(dated(spark, d))


CALLS = "calls AS (SELECT DISTINCT a.l_partkey AS from_id, b.l_partkey AS to_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"


def calls(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem")
    here = lines.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("from_id"))
    below = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("to_id"))
    return graph.edge_set(here.join(below, ["l_orderkey", "n"]))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"))


COUPLED = f"""{CALLS}, coupled AS (SELECT t.p_brand AS file, count(DISTINCT c.p_brand) AS coupling FROM calls JOIN part t ON t.p_partkey = to_id JOIN part c ON c.p_partkey = from_id
WHERE t.p_brand <> c.p_brand GROUP BY 1)"""


@query(f"WITH {COUPLED} SELECT file, coupling FROM coupled")
def coupling_by_file(spark, d):
    return history.coupling(calls(spark, d), parts(spark, d))


def part_churn(spark: SparkSession, d: str) -> DataFrame:
    touched = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("commit"), F.col("p_brand").alias("file"))
    return history.churn(touched.distinct())


SCORED = f"""{COUPLED}, churned AS (SELECT p_brand AS file, count(DISTINCT l_orderkey) AS churn FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
scored AS (SELECT file, coalesce(churn, 0) AS churn, coalesce(coupling, 0) AS coupling, coalesce(churn, 0) * coalesce(coupling, 0) AS score FROM churned FULL JOIN coupled USING (file))"""


@query(f"WITH {SCORED} SELECT * FROM scored WHERE churn > 0 OR coupling > 0 ORDER BY score DESC, file LIMIT 20")
def hotspots_cli(spark, d):
    return history.hotspots(part_churn(spark, d), history.coupling(calls(spark, d), parts(spark, d)))


@query(f"WITH {SCORED} SELECT * FROM scored WHERE score <> 0 ORDER BY score DESC, file LIMIT 20")
def hotspots_mcp(spark, d):
    return history.hotspots(part_churn(spark, d), history.coupling(calls(spark, d), parts(spark, d)), zero_scores=False)


@query("""WITH m AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM conversations)
SELECT conv_id, CAST(block AS BIGINT) AS block, max(CASE WHEN role = 'user' THEN text END) AS header, count(*) FILTER (role <> 'user' AND trim(text) <> '') AS n FROM m WHERE block > 0
GROUP BY conv_id, block HAVING n > 0""")
def commit_block_grouping(spark, d):
    rows = read(spark, d, "conversations").withColumnRenamed("text", "line")
    found = history.commit_blocks(rows, F.col("role") == "user", "turn", "conv_id")
    return found.select("conv_id", "block", "header", F.size("files").cast("long").alias("n"))


# --- graph ---------------------------------------------------------------------------------------------------


@query(f"WITH {CALLS} SELECT CAST(from_id AS VARCHAR) AS from_id, CAST(to_id AS VARCHAR) AS to_id FROM calls WHERE from_id % 5 <> 0 AND to_id % 7 <> 0")
def edge_set(spark, d):
    def end(name: str, blank: int, text: str | None) -> Column:
        return F.when(F.col(name) % blank == 0, F.lit(text).cast("string")).otherwise(F.col(name).cast("string")).alias(name)

    both = calls(spark, d)
    return graph.edge_set(both.unionByName(both).select(end("from_id", 5, " "), end("to_id", 7, None)))


@query(f"WITH {CALLS} SELECT from_id AS id FROM calls WHERE to_id = 17")
def direct_callers(spark, d):
    return graph.in_neighbours(calls(spark, d), 17)


@query(f"WITH {CALLS} SELECT to_id AS id FROM calls WHERE from_id = 17")
def direct_callees(spark, d):
    return graph.out_neighbours(calls(spark, d), 17)


LAYERS = """layers AS (SELECT DISTINCT 'c:' || o_custkey AS from_id, 's:' || l_suppkey AS to_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey
UNION SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier UNION SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation)"""


def layers(spark: SparkSession, d: str) -> DataFrame:
    def named(a: str, x: str, b: str, y: str) -> list[Column]:
        return [F.concat(F.lit(f"{a}:"), F.col(x).cast("string")).alias("from_id"), F.concat(F.lit(f"{b}:"), F.col(y).cast("string")).alias("to_id")]

    bought = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = bought.select(*named("c", "o_custkey", "s", "l_suppkey")).unionByName(read(spark, d, "supplier").select(*named("s", "s_suppkey", "n", "s_nationkey"))).unionByName(read(spark, d, "nation").select(*named("n", "n_nationkey", "r", "n_regionkey")))
    return graph.edge_set(found)


@query(f"""WITH RECURSIVE {LAYERS}, walk(id, depth) AS (SELECT 'r:2', 0 UNION SELECT from_id, depth + 1 FROM walk JOIN layers ON to_id = id WHERE depth < 3)
SELECT id, min(depth) AS depth FROM walk WHERE id <> 'r:2' GROUP BY id""")
def blast_radius_callers(spark, d):
    return graph.reachable(graph.scratch(layers(spark, d)), "r:2", 3)


@query(f"""WITH RECURSIVE {CALLS}, walk(id, depth) AS (SELECT CAST(17 AS BIGINT), 0 UNION SELECT to_id, depth + 1 FROM walk JOIN calls ON from_id = id WHERE depth < 2)
SELECT id, min(depth) AS depth FROM walk WHERE id <> 17 GROUP BY id""")
def blast_radius_callees(spark, d):
    return graph.reachable(graph.scratch(calls(spark, d)), 17, 2, callers=False)


@query("SELECT p_name AS id, min(p_partkey) AS node_seq FROM part WHERE p_name LIKE '%o%' GROUP BY p_name ORDER BY node_seq LIMIT 1")
def symbol_lookup(spark, d):
    symbols = read(spark, d, "part").groupBy(F.col("p_name").alias("id")).agg(F.min("p_partkey").alias("node_seq"))
    return graph.lookup(symbols, "o")


@query(f"""WITH {CALLS} SELECT p_partkey AS id, (SELECT count(*) FROM calls WHERE to_id = p_partkey) AS n_callers, (SELECT count(*) FROM calls WHERE from_id = p_partkey) AS n_callees,
coalesce((SELECT string_agg(CAST(from_id AS VARCHAR), ',' ORDER BY CAST(from_id AS VARCHAR)) FROM calls WHERE to_id = p_partkey), '') AS callers FROM part""")
def callers_and_callees(spark, d):
    edges = calls(spark, d).select(F.col("from_id").cast("string").alias("from_id"), F.col("to_id").cast("string").alias("to_id"))
    found = graph.callers_and_callees(read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id")), edges)
    return found.select(F.col("id").cast("long").alias("id"), F.size("callers").cast("long").alias("n_callers"), F.size("callees").cast("long").alias("n_callees"), F.array_join("callers", ",").alias("callers"))


DEPENDS = "depends AS (SELECT DISTINCT 'module:' || s_nationkey AS from_id, 'module:' || c_nationkey AS to_id FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity >= 50)"


@query(f"WITH {DEPENDS}, m AS (SELECT 'module:' || n_nationkey AS module FROM nation) SELECT module, to_id AS depends_on FROM m LEFT JOIN depends ON from_id = module WHERE module LIKE '%1%'")
def module_deps(spark, d):
    bought = read(spark, d, "lineitem").filter("l_quantity >= 50").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    needs = bought.select(F.col("s_nationkey").cast("string").alias("module"), F.col("c_nationkey").cast("string").alias("depends_on")).distinct()
    nodes, edges = graph.module_edges(read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("name")), needs)
    return graph.module_dependencies(nodes, edges, "1")


@query(f"WITH {CALLS}, gone AS (SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#11') SELECT from_id, to_id FROM calls WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)")
def remove_nodes(spark, d):
    gone = parts(spark, d).filter("file = 'Brand#11'")
    return graph.remove_nodes(parts(spark, d), calls(spark, d), gone)[1]


@query("""SELECT l_partkey AS id, first AS node_seq, l_orderkey AS value FROM (SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber, min(l_orderkey) OVER (PARTITION BY l_partkey) AS first,
row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC) AS r FROM lineitem) WHERE r = 1""")
def node_last_wins(spark, d):
    nodes = read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("node_seq"), F.col("l_orderkey").alias("value"))
    return graph.node_set(nodes)


# --- resolution ----------------------------------------------------------------------------------------------

KEYED = "keyed AS (SELECT p_name AS name, p_size AS arity, count(*) AS n, min(p_partkey) AS match FROM part GROUP BY ALL)"


def callables(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("arity"), F.col("p_type").alias("receiver_type"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part")
    return rows.select(F.col("p_partkey").alias("site"), F.col("p_name").alias("name"), F.col("p_size").alias("arity"), F.substring_index("p_type", " ", -1).alias("receiver_text"))


@query(f"WITH {KEYED} SELECT p_partkey AS site, match FROM part JOIN keyed ON p_name = name AND p_size = arity WHERE n = 1")
def resolve_unique(spark, d):
    return resolve.match(sites(spark, d), callables(spark, d)).filter("match is not null").select("site", "match")


@query(f"WITH {KEYED} SELECT p_partkey AS site, n FROM part JOIN keyed ON p_name = name AND p_size = arity WHERE n > 1")
def resolve_ambiguous(spark, d):
    return resolve.match(sites(spark, d), callables(spark, d)).filter("n > 1").select("site", "n")


@query(f"""WITH {KEYED}, s AS (SELECT p_partkey AS site, p_name, p_size, split_part(p_type, ' ', -1) AS text FROM part JOIN keyed ON p_name = name AND p_size = arity WHERE n > 1)
SELECT site, min(p.p_partkey) AS match FROM s JOIN part p ON p.p_name = s.p_name AND p.p_size = s.p_size AND ends_with(p.p_type, text) WHERE text <> '' GROUP BY site HAVING count(*) = 1""")
def resolve_receiver_suffix(spark, d):
    return resolve.narrow_by_receiver(resolve.match(sites(spark, d), callables(spark, d)), callables(spark, d))


@query("""WITH r AS (SELECT p_partkey AS caller_id, p_name AS callee_name, p_size + 1 AS arity FROM part WHERE p_partkey % 3 = 0),
c AS (SELECT p_name, p_size, min(p_partkey) AS match FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL HAVING count(*) = 1)
SELECT caller_id, coalesce(a.match, b.match) AS match FROM r LEFT JOIN c a ON a.p_name = callee_name AND a.p_size = arity LEFT JOIN c b ON b.p_name = callee_name AND b.p_size = arity - 1""")
def resolve_extension(spark, d):
    # Callables are the even parts; the operator itself reads all of what it is given.
    records = read(spark, d, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("caller_id"), F.col("p_name").alias("callee_name"), (F.col("p_size") + 1).alias("arity"))
    return resolve.cross_language(records, callables(spark, d).filter("id % 2 = 0"), True).select("caller_id", "match")


INJECTED = """c AS (SELECT p_type || p_size AS type, count(*) AS n, min(p_partkey) AS match FROM part WHERE p_partkey % 11 <> 0 GROUP BY 1),
points AS (SELECT p_partkey AS owner_id, coalesce(n, 0) AS n, match FROM part LEFT JOIN c ON c.type = p_type || CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size % 50 + 1 END WHERE p_partkey % 13 <> 0)"""


def injected(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part")

    def path(tests: int) -> Column:
        return F.when(F.col("p_partkey") % tests == 0, "m/src/test/java/A.java").otherwise("m/src/main/java/A.java").alias("file_path")

    wanted = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).otherwise(F.col("p_size") % 50 + 1).cast("string")
    classes = rows.select(F.col("p_partkey").alias("id"), F.array(F.concat("p_type", F.col("p_size").cast("string"))).alias("interfaces"), path(11))
    return resolve.injection(rows.select(F.col("p_partkey").alias("owner_id"), F.concat("p_type", wanted).alias("type"), path(13)), classes)


@query(f"WITH {INJECTED} SELECT DISTINCT owner_id AS from_id, match AS to_id FROM points WHERE n = 1")
def di_edges(spark, d):
    return resolve.injection_edges(injected(spark, d))


@query(f"WITH {INJECTED} SELECT count(*) FILTER (n = 1) AS added, count(*) FILTER (n > 1) AS ambiguous, count(*) FILTER (n = 0) AS no_match FROM points")
def di_counters(spark, d):
    return resolve.injection_counters(injected(spark, d))


@query("""WITH w AS (SELECT event_id, ['Component', 'Service', 'Bean', 'Table', 'Async'][CAST(event_id % 5 + 1 AS INT)] AS a, ['Repository', 'Deprecated', 'Controller'][CAST(event_id % 3 + 1 AS INT)] AS b FROM events)
SELECT event_id, CASE b WHEN 'Repository' THEN 'REPOSITORY' WHEN 'Controller' THEN 'CONTROLLER' ELSE CASE a WHEN 'Component' THEN 'COMPONENT' WHEN 'Service' THEN 'SERVICE' WHEN 'Bean' THEN 'CONFIGURATION' WHEN 'Table' THEN 'JPA_ENTITY' ELSE 'NONE' END END AS stereotype FROM w""")
def stereotype_last_wins(spark, d):
    first = F.element_at(F.array(*map(F.lit, ("Component", "Service", "Bean", "Table", "Async"))), (F.col("event_id") % 5 + 1).cast("int"))
    second = F.element_at(F.array(*map(F.lit, ("Repository", "Deprecated", "Controller"))), (F.col("event_id") % 3 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", annotations.spring_stereotype(F.array(first, second)).alias("stereotype"))


# --- chunks and the vector store -----------------------------------------------------------------------------


@query("""SELECT page_id, CASE WHEN split_part(url, '/', 3) = '' THEN 'unknown' WHEN length(url) - length(replace(url, '/', '')) >= 4 THEN 'deep' ELSE 'host' END AS module FROM pages""")
def module_tag(spark, d):
    from gneiss.operators import chunks

    rows = read(spark, d, "pages").select("page_id", "url", F.substring_index("url", "/", 3).alias("host"), F.substring_index("url", "/", 4).alias("folder"))
    shallow = rows.select(F.col("host").alias("root"), F.lit("host").alias("name"))
    deep = rows.filter(F.length("url") - F.length(F.replace("url", F.lit("/"), F.lit(""))) >= 4).select(F.col("folder").alias("root"), F.lit("deep").alias("name"))
    roots = shallow.unionByName(deep).distinct()
    return chunks.module_tags(rows.select("page_id", F.col("url").alias("file_path")), roots, "page_id").select("page_id", "module")


@query("SELECT p_partkey AS id, '[FIELD] ' || p_partkey || chr(10) || 'Class: ' || p_brand || chr(10) || 'Name: ' || p_name || chr(10) || 'Type: ' || p_type || chr(10) || 'Annotations: ' || chr(10) || 'Guice Injection: NONE' || chr(10) || 'File: ' || p_brand || ':' || p_size AS text FROM part")
def chunk_text(spark, d):
    from gneiss.operators import chunks

    rows = read(spark, d, "part")
    symbols = chunks.complete(rows.select(F.col("p_partkey").cast("string").alias("id"), F.lit("FIELD").alias("kind"), F.col("p_brand").alias("declaring_class_id"), F.col("p_name").alias("name"), F.col("p_type").alias("field_type"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("line"), F.col("p_partkey").alias("node_seq")))
    return symbols.select(F.col("id").cast("long").alias("id"), chunks.text().alias("text"))


@query("""SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS fqn, 'FIELD' AS kind, p_brand AS file, CAST(p_size AS VARCHAR) AS line FROM part""")
def chunk_metadata(spark, d):
    from gneiss.operators import chunks

    rows = read(spark, d, "part")
    symbols = chunks.complete(rows.select(F.col("p_partkey").cast("string").alias("id"), F.lit("FIELD").alias("kind"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("line"), F.col("p_partkey").alias("node_seq")))
    found = symbols.withColumn("m", chunks.metadata())
    return found.select(F.col("id").cast("long").alias("id"), *[store.metadata_value(F.col("m"), k).alias(k) for k in ("fqn", "kind", "file", "line")])


def embedded(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct(F.col("label").cast("string").alias("module"))).alias("metadata"))


def nearest(spark: SparkSession, d: str, **kwargs) -> DataFrame:
    """The stored vectors nearest to that of id 7."""
    rows = embedded(spark, d)
    # One vector by its key; like a question's embedding it is a literal of the search.
    probe = rows.filter("id = 7").select("vector").first()
    return store.search(rows, probe["vector"], **kwargs).select("id", F.round("score", 6).alias("score"))


SCORE = "SELECT vec_id AS id, round((list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) + 1) / 2, 6) AS score, label FROM embeddings"


@query(f"SELECT id, score FROM ({SCORE}) ORDER BY score DESC, id LIMIT 10")
def vector_topk(spark, d):
    return nearest(spark, d)


@query(f"SELECT id, score FROM ({SCORE}) WHERE label = 3 ORDER BY score DESC, id LIMIT 10")
def vector_topk_filtered(spark, d):
    return nearest(spark, d, module="3")


@query(f"SELECT id, score FROM ({SCORE}) WHERE score >= 0.6 ORDER BY score DESC, id LIMIT 25")
def vector_min_score(spark, d):
    return nearest(spark, d, top=25, min_score=0.6)


@query("SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k') = '3'")
def metadata_equality(spark, d):
    return store.matching(read(spark, d, "events").withColumnRenamed("props", "metadata"), "k", "3").select("event_id", F.col("metadata").alias("props"))


STORED = "stored AS (SELECT user_id AS id, max(event_id) AS seq FROM events WHERE event_type = 'click' GROUP BY 1), added AS (SELECT user_id AS id, event_id AS seq FROM events WHERE event_type <> 'click')"


@query(f"WITH {STORED} SELECT id, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY new DESC, seq DESC) AS r FROM (SELECT *, 0 AS new FROM stored UNION ALL SELECT *, 1 FROM added)) WHERE r = 1")
def upsert_last_wins(spark, d):
    events = read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type")
    stored = events.filter("event_type = 'click'").groupBy("id").agg(F.max("seq").alias("seq"))
    return store.upsert(stored, events.filter("event_type <> 'click'").drop("event_type"))


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_by_ids(spark, d):
    gone = read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return store.delete_ids(read(spark, d, "events").select("event_id", "user_id"), gone, "user_id").select("event_id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IS DISTINCT FROM '3'")
def delete_by_metadata(spark, d):
    return store.delete_matching(read(spark, d, "events").withColumnRenamed("props", "metadata"), "k", "3").select("event_id")


@query("SELECT p_partkey AS id, 'embeddings_' || CASE WHEN n = '' THEN 'collection' WHEN n[1] BETWEEN 'a' AND 'z' THEN n ELSE 'c_' || n END AS table_name FROM (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(p_size || ' ' || p_brand || '__' || p_type)), '[^a-z0-9]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS n FROM part)")
def collection_name_normalised(spark, d):
    name = F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_brand", F.lit("__"), "p_type")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.table_name(name).alias("table_name"))


@query("""SELECT event_id, CASE WHEN x = floor(x) AND abs(x) <= 2147483647 THEN 'INTEGER:' || CAST(x AS BIGINT) WHEN x = floor(x) THEN 'LONG:' || CAST(x AS BIGINT) ELSE 'FLOAT' END AS number
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN event_id * 3000000.0 ELSE event_id + 0.5 END::DOUBLE AS x FROM events)""")
def metadata_number_coercion(spark, d):
    n = F.col("event_id").cast("double")
    value = F.when(F.col("event_id") % 3 == 0, n).when(F.col("event_id") % 3 == 1, n * 3000000.0).otherwise(n + 0.5)
    return read(spark, d, "events").select("event_id", store.coerced_number(value.cast("string")).alias("number"))


@query("SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 500 AS batch FROM part")
def batch_assignment(spark, d):
    return store.batches(read(spark, d, "part").select("p_partkey"), "p_partkey")


# --- checksums, snapshots, drift -----------------------------------------------------------------------------

STATES = """now AS (SELECT doc_id AS path, sha256(text) AS sha FROM documents WHERE doc_id % 10 <> 1),
old AS (SELECT doc_id AS path, CASE WHEN doc_id % 10 = 3 THEN 'x' ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 10 <> 2),
changed AS (SELECT path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN n.sha <> o.sha THEN 'modified' END AS change FROM now n FULL JOIN old o USING (path))"""


def states(spark: SparkSession, d: str) -> DataFrame:
    """The documents against an earlier state made up by id: some lack in either, some differ."""
    files = read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    now = checksums.checksums(files.filter("path % 10 <> 1"))
    old = checksums.checksums(files.filter("path % 10 <> 2")).withColumn("sha256", F.when(F.col("path") % 10 == 3, "x").otherwise(F.col("sha256")))
    return checksums.changes(now, old)


@query(f"WITH {STATES} SELECT path, change FROM changed WHERE change IS NOT NULL")
def checksum_diff(spark, d):
    return states(spark, d)


@query(f"WITH {STATES} SELECT path FROM changed WHERE change IN ('added', 'modified')")
def files_to_reindex(spark, d):
    return checksums.to_reindex(states(spark, d))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_brand").alias("file_path"))


@query("SELECT p_type AS kind, count(*) AS n FROM part GROUP BY 1")
def snapshot_kind_counts(spark, d):
    return snapshot.kind_counts(graph_nodes(spark, d))


@query(f"WITH {CALLS} SELECT (SELECT count(*) FROM part) AS total_nodes, (SELECT count(*) FROM calls) AS total_edges, (SELECT count(DISTINCT p_brand) FROM part) AS total_files, CAST(0 AS BIGINT) AS module_count")
def snapshot_totals(spark, d):
    return snapshot.totals(graph_nodes(spark, d), calls(spark, d))


@query(f"WITH {CALLS} SELECT to_id AS id, count(*) AS incoming FROM calls GROUP BY 1 ORDER BY incoming DESC, id LIMIT 10")
def snapshot_top_coupled(spark, d):
    return snapshot.top_coupled(calls(spark, d))


CUT = "TIMESTAMP '1996-01-01'"
HALF = {a: f"SELECT count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers FROM orders WHERE o_orderdate {op} {CUT}" for a, op in (("a", "<"), ("b", ">="))}


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, d, "orders")
    return orders.filter(f"o_orderdate < {CUT}"), orders.filter(f"o_orderdate >= {CUT}")


@query(f"""WITH a AS ({HALF['a']}), b AS ({HALF['b']})
SELECT 'n_orders' AS counter, a.n_orders AS before, b.n_orders AS after, b.n_orders - a.n_orders AS delta FROM a, b UNION ALL SELECT 'n_customers', a.n_customers, b.n_customers, b.n_customers - a.n_customers FROM a, b""")
def drift_counters(spark, d):
    a, b = (h.agg(F.count("*").alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers")) for h in halves(spark, d))
    return snapshot.counters(a, b, ["n_orders", "n_customers"])


@query(f"""SELECT o_orderpriority AS kind, count(*) FILTER (o_orderdate < {CUT}) AS before, count(*) FILTER (o_orderdate >= {CUT}) AS after, count(*) FILTER (o_orderdate >= {CUT}) - count(*) FILTER (o_orderdate < {CUT}) AS delta FROM orders GROUP BY 1""")
def drift_kinds(spark, d):
    a, b = (snapshot.kind_counts(h.select(F.col("o_orderpriority").alias("kind"))) for h in halves(spark, d))
    return snapshot.kind_drift(a, b)


@query(f"""WITH a AS (SELECT DISTINCT o_custkey AS module FROM orders WHERE o_orderdate < {CUT}), b AS (SELECT DISTINCT o_custkey AS module FROM orders WHERE o_orderdate >= {CUT})
(SELECT module, 'added' AS change FROM b EXCEPT SELECT module, 'added' FROM a) UNION ALL (SELECT module, 'removed' FROM a EXCEPT SELECT module, 'removed' FROM b)""")
def drift_modules(spark, d):
    return snapshot.module_drift(*(h.select(F.col("o_custkey").alias("module")) for h in halves(spark, d)))


TOPS = {a: f"SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderdate {op} {CUT} GROUP BY 1 ORDER BY n DESC, id LIMIT 10" for a, op in (("a", "<"), ("b", ">="))}


@query(f"""WITH a AS ({TOPS['a']}), b AS ({TOPS['b']}) SELECT id, CASE WHEN a.n IS NULL THEN 'entered' WHEN b.n IS NULL THEN 'disappeared' ELSE 'changed' END AS change, a.n AS before, b.n AS after
FROM a FULL JOIN b USING (id) WHERE a.n IS DISTINCT FROM b.n""")
def drift_top_nodes(spark, d):
    a, b = (snapshot.top_coupled(h.select(F.col("o_custkey").alias("to_id"))) for h in halves(spark, d))
    return snapshot.top_drift(a, b)


# --- scalar functions ----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN 2 ELSE o_orderkey % 5 END::INT AS arity FROM orders""")
def signature_arity(spark, d):
    deep = "f(" + "Map<K, " * 12 + "V" + ">" * 12 + ", " + "(A, " * 12 + "B" + ")" * 12 + ")"
    samples = ["f()", "f(Map<String, List<Int>>)", "f(A, (B, C) -> D)", "f(A, Map<K, V>, C)", deep]
    return read(spark, d, "orders").select("o_orderkey", text.arity(F.element_at(F.array(*map(F.lit, samples)), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("arity"))


@query("""SELECT c_custkey, c_nationkey || ' → ' || (c_custkey % 25) || '  (' || CASE WHEN c_custkey % 25 = c_nationkey THEN 'no change' WHEN c_custkey % 25 > c_nationkey THEN '+' || (c_custkey % 25 - c_nationkey) ELSE '' || (c_custkey % 25 - c_nationkey) END || ')' AS shown FROM customer""")
def delta_format(spark, d):
    return read(spark, d, "customer").select("c_custkey", text.signed_delta(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 25).alias("shown"))


@query("SELECT p_partkey, coalesce(try_cast(split_part(p_name, ' ', -1) AS INT), 0) AS n FROM part")
def lenient_int(spark, d):
    return read(spark, d, "part").select("p_partkey", text.lenient_int(F.substring_index("p_name", " ", -1)).alias("n"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https:/') THEN substr(url, 8) ELSE url END AS path FROM pages")
def path_relativise(spark, d):
    return read(spark, d, "pages").select("page_id", text.relative_to(F.col("url"), F.lit("https:/")).alias("path"))


@query("""SELECT o_orderkey, CASE WHEN s // 3600 > 0 THEN (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' END AS shown
FROM (SELECT o_orderkey, greatest(o_orderkey * 7 - 500, 0) AS s FROM orders)""")
def duration_format(spark, d):
    return read(spark, d, "orders").select("o_orderkey", text.duration(F.col("o_orderkey") * 7 - 500).alias("shown"))


@query("SELECT p_partkey, CAST(floor(least(greatest(p_partkey - 10, 0), 1000) * 100 / 1000) AS INT) AS percent FROM part")
def progress_percent(spark, d):
    return read(spark, d, "part").select("p_partkey", text.progress_percent(F.col("p_partkey") - 10, F.lit(1000)).alias("percent"))


@query("SELECT p_partkey, replace(ltrim(replace(trim(':' || p_type || '.' || p_brand), '.', '/'), ':'), ':', '/') AS folder FROM part")
def gradle_path(spark, d):
    return read(spark, d, "part").select("p_partkey", text.gradle_path(F.concat(F.lit(":"), "p_type", F.lit("."), "p_brand")).alias("folder"))


@query("SELECT p_partkey, regexp_replace(p_type || '/' || p_name, '[^a-zA-Z0-9_-]', '-', 'g') AS label FROM part")
def snapshot_label_safe(spark, d):
    return read(spark, d, "part").select("p_partkey", text.safe_label(F.concat("p_type", F.lit("/"), "p_name")).alias("label"))


@query("SELECT event_id, coalesce(nullif(trim(CASE WHEN event_id % 2 = 0 THEN ' ' ELSE event_type END), ''), nullif(trim(props), ''), 'none') AS setting FROM events")
def setting_first_given(spark, d):
    first = F.when(F.col("event_id") % 2 == 0, " ").otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", text.first_given(first, F.col("props"), F.lit("none")).alias("setting"))


@query("SELECT p_partkey, '\"' || replace(p_name || '\"' || p_brand, '\"', '\"\"') || '\"' AS name FROM part")
def identifier_quoting(spark, d):
    return read(spark, d, "part").select("p_partkey", text.quoted(F.concat("p_name", F.lit('"'), "p_brand")).alias("name"))
