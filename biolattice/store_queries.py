"""Registered queries of the search index, the hash store, fitness matrices and committed loads over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators.graph import Graph
from .operators.hashstore import HashStore
from .operators.search import Index, Term
from .operators.versions import VersionedStore
from .plans.tables import shared_dir
from .queries import _t, _trade, query
from .sources import fitness
from .streaming import latest


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stores-{uuid.uuid4().hex[:12]}"


_PARTS = """
WITH w AS (SELECT p_partkey, string_split_regex(lower(p_name), '[^a-z0-9]+') AS name, lower(p_brand) AS brand, string_split_regex(lower(p_type), '[^a-z0-9]+') AS kind FROM part),
t AS (SELECT p_partkey, list_contains(name, 'ring') AS a, list_contains(kind, 'economy') OR list_contains(name, 'economy') AS b, brand = 'brand#2' AS c FROM w)
"""


def _search(spark, sf):
    index = Index.of(_t(spark, sf, "part"), "p_partkey", "p_name", "p_brand", "p_type").write(f"{_folder(spark)}/index")
    return index, (Term("Ring", "p_name") | Term("economy")) & ~Term("brand 2", "p_brand")


@query(_PARTS + "SELECT p_partkey AS id FROM t WHERE (a OR b) AND NOT c")
def search_hits(spark, sf):
    """A condition over two fields and over all of them, by a stored index."""
    index, condition = _search(spark, sf)
    return index.hits(condition)


@query(_PARTS + """
SELECT '"ring"[p_name]' AS text, count(*) FILTER (a) AS n FROM t UNION ALL SELECT '"economy"[All Fields]', count(*) FILTER (b) FROM t UNION ALL SELECT '"brand 2"[p_brand]', count(*) FILTER (c) FROM t
UNION ALL SELECT '(("ring"[p_name] OR "economy"[All Fields]) AND (NOT "brand 2"[p_brand]))', count(*) FILTER ((a OR b) AND NOT c) FROM t
""")
def search_counts(spark, sf):
    index, condition = _search(spark, sf)
    return index.told(condition)


@query(_PARTS + "SELECT p_partkey AS id FROM t WHERE (a OR b) AND NOT c ORDER BY p_partkey LIMIT 25 OFFSET 50")
def search_index_page(spark, sf):
    index, condition = _search(spark, sf)
    return index.page(condition, 25, 50)


@query("""
SELECT c_custkey, sha256(upper(c_name)) AS hash, CASE WHEN EXISTS (SELECT 1 FROM customer d WHERE d.c_custkey % 2 = 0 AND upper(d.c_name) = upper(c.c_name)) THEN upper(c_name) END AS seq FROM customer c
""")
def hash_store_lookup(spark, sf):
    """Every second customer's name is stored, in two inserts of which the second repeats the first; then all are looked up."""
    c = _t(spark, sf, "customer")
    store = HashStore(spark, f"{_folder(spark)}/sequences")
    named = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("seq"), "c_custkey")
    store.insert(named.where("c_custkey % 4 = 0").drop("c_custkey"))
    store.insert(named.drop("c_custkey"))
    return store.lookup(c.select("c_custkey", F.sha2(F.upper("c_name"), 256).alias("hash"))).select("c_custkey", "hash", "seq")


@query("""
SELECT 'org' || p_size % 3 AS organism, 'e' || k AS experiment, count(*) FILTER ((p_partkey + k) % 50 <> 0) AS n,
       coalesce(sum(((p_partkey * (k + 1) + p_size) % 97) / 8.0) FILTER ((p_partkey + k) % 50 <> 0), 0)::DOUBLE AS total, min(p_partkey)::VARCHAR AS first_gene
FROM part, (SELECT unnest(range(300)) AS k) GROUP BY ALL
""")
def fitness_matrix(spark, sf):
    """Parts as genes of three organisms, each with a table of 300 experiments; cells that say NA have no value."""
    p = _t(spark, sf, "part").withColumn("organism", F.concat(F.lit("org"), F.col("p_size") % 3))
    cell = lambda k: F.when((F.col("p_partkey") + k) % 50 == 0, "NA").otherwise((((F.col("p_partkey") * (k + 1) + F.col("p_size")) % 97) / 8.0).cast("string"))
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(299)), cell), "\t"))
    heads = p.select("organism").distinct().select("organism", F.lit(None).cast("long").alias("at"), F.lit("\t".join(["gene", *(f"e{k}" for k in range(300))])).alias("value"))
    path = f"{_folder(spark)}/fitness_values"
    rows = heads.unionByName(p.select("organism", F.col("p_partkey").alias("at"), line.alias("value")))
    rows.repartition("organism").sortWithinPartitions("organism", F.col("at").asc_nulls_first()).select("organism", "value").write.partitionBy("organism").text(path)
    cells = fitness.matrices(spark, path, ("gene",), F.regexp_extract("file", "/organism=([^/]+)/", 1))
    first = F.min(F.col("gene").cast("long")).cast("string")
    return cells.groupBy("organism", "experiment").agg(F.count("value").alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), first.alias("first_gene"))


@query("""
SELECT 1 AS version, 'node' AS kind, label, count(*) AS n FROM (SELECT 'Region' AS label FROM region UNION ALL SELECT 'Nation' FROM nation) GROUP BY label
UNION ALL SELECT 1, 'edge', 'has_nation', count(*) FROM nation
UNION ALL SELECT 2, 'node', label, count(*) FROM (SELECT 'Region' AS label FROM region UNION ALL SELECT 'Nation' FROM nation UNION ALL SELECT 'Customer' FROM customer) GROUP BY label
UNION ALL SELECT 2, 'edge', label, count(*) FROM (SELECT 'has_nation' AS label FROM nation UNION ALL SELECT 'has_customer' FROM customer) GROUP BY label
""")
def committed_loads(spark, sf):
    """Regions and nations, then customers too, whose first load dies after its nodes: what each version holds."""
    store = VersionedStore(spark, f"{_folder(spark)}/graph")
    whole = _trade(spark, sf, orders=False)
    few = Graph(whole.nodes.where("label <> 'Customer'"), whole.edges.where("label = 'has_nation'"))

    def die():
        raise InterruptedError

    for g in (few, whole):
        try:
            store.load(g, between=die)
        except InterruptedError:
            store.load(g)
    of = lambda v: store.graph(v).summary().select(F.lit(v).alias("version"), "kind", "label", "n")
    return of(1).unionByName(of(2))


@query("""
SELECT event_type AS doc_id, 'u' || user_id % 50 AS target, arg_max(props, struct_pack(t := epoch(date_trunc('second', ts))::BIGINT, p := -event_id)) AS action,
       max(epoch(date_trunc('second', ts))::BIGINT) AS timestamp, count(*) AS n
FROM events GROUP BY ALL
""")
def stream_latest_actions(spark, sf):
    """Events in five micro-batches, dealt out by their ids: the last row that keyed state gives of each target, beside the events' count by the batch aggregate."""
    rows = _t(spark, sf, "events").select(
        F.col("event_type").alias("doc_id"), F.concat(F.lit("u"), F.col("user_id") % 50).alias("target"), F.col("props").alias("action"), F.unix_timestamp(F.date_trunc("second", "ts")).alias("timestamp"),
        F.lit("-").alias("user_id"), F.col("event_id").alias("pos"),
    )
    path, old = _folder(spark), spark.conf.get(latest.STATE_STORE[0], None)
    rows.repartition(5, F.xxhash64("pos")).write.parquet(f"{path}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    spark.conf.set(*latest.STATE_STORE)
    try:
        out = latest.latest_with_expiry(source, "100000 days", 10**9).writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        q = out.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{path}/out")).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(latest.STATE_STORE[0]) if old is None else spark.conf.set(latest.STATE_STORE[0], old)
    last = F.max_by(F.struct("action", "timestamp"), "batch")
    found = spark.read.parquet(f"{path}/out").groupBy("doc_id", "target").agg(last.alias("e")).select("doc_id", "target", "e.*")
    return found.join(rows.groupBy("doc_id", "target").agg(F.count("*").alias("n")), ["doc_id", "target"])
