"""Registered queries of the engine's operators over the driver's tables, each with SQL that gives the same rows.

Documents stand for leaves (source: root file, lang: branch), the benchmark for queries, pages for texts with links,
orders, customers, nations and regions for a graph, conversations and events for logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import audit, cluster, diff, index, references, replay, scan
from .operators import search as S
from .operators import similarity
from .registry import QUERIES, SQL, query, table
from .sources.shared import cut, removed, shared_dir
from .streaming import replay as streams



def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores if it has fewer, as a table of one small file does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("leaf_id"), F.col("source").alias("file"), F.col("lang").alias("branch"), F.col("lang").alias("branch_ord"), F.col("doc_id").alias("line"), F.col("doc_id").alias("index"), "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_FOLD = "lower(translate(translate({}, '’`', ''''''), 'Iİ', 'ıi'))"
_LOW_TEXT, _LOW_QUERY = _FOLD.format("d.text"), _FOLD.format("trim(b.text)")
_DISPLAY = r"substring(regexp_replace(d.text, '\s*\n\s*', ' ', 'g'), 1, 300)"


# --- search ---------------------------------------------------------------------------------------------------------


@query(
    "search_literal_topk",
    f"""SELECT query_id, rank::INTEGER AS rank, leaf_id, file FROM (
      SELECT b.item_id AS query_id, d.doc_id AS leaf_id, d.source AS file, row_number() OVER (PARTITION BY b.item_id ORDER BY d.source, d.doc_id) AS rank
      FROM benchmark b JOIN documents d ON contains({_LOW_TEXT}, {_LOW_QUERY}) WHERE length(trim(b.text)) > 0) WHERE rank <= 25""",
)
def search_literal_topk(spark, sf_dir):
    return S.search(leaves(spark, sf_dir), asked(spark, sf_dir), mode="literal", threshold=2.0).select("query_id", "rank", "leaf_id", "file")


@query("search_regex", r"SELECT 1 AS query_id, doc_id AS leaf_id FROM documents WHERE regexp_matches(text, '(?i)password\s*[:=]\s*[^ ]+')")
def search_regex(spark, sf_dir):
    one = spark.createDataFrame([(1, r"password\s*[:=]\s*[^ ]+")], "query_id int, query string")
    return S.matches(leaves(spark, sf_dir), one, mode="regex", threshold=2.0).select("query_id", "leaf_id")


_MASK = f"""WITH hit AS (SELECT b.item_id AS query_id, d.doc_id AS leaf_id, d.source AS file, d.source IN ('src0', 'src1', 'src2') AS pref
      FROM benchmark b JOIN documents d ON contains({_LOW_TEXT}, {_LOW_QUERY})), masked AS (SELECT *, bool_or(pref) OVER (PARTITION BY query_id) AS any_pref FROM hit)"""


@query("search_hierarchy_mask", _MASK + " SELECT query_id, leaf_id, CASE WHEN pref THEN 'hierarchy' ELSE 'fallback' END AS route FROM masked WHERE pref OR NOT any_pref")
def search_hierarchy_mask(spark, sf_dir):
    own = asked(spark, sf_dir).withColumn("files", F.array(F.lit("src0"), F.lit("src1"), F.lit("src2")))
    return S.matches(leaves(spark, sf_dir), own, mode="literal", threshold=2.0).select("query_id", "leaf_id", "route")


_TOK = r"list_filter(list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+(?:''\p{{L}}+)?'), lambda t: {}), lambda t: length(t) > 1)"
_BASE = "CASE WHEN instr(t, '''') > 1 THEN split_part(t, '''', 1) ELSE t END"
_STEM = f"(list_transform([{_BASE}], lambda b: CASE " + " ".join(f"WHEN suffix(b, '{e}') AND length(b) - {len(e)} >= 4 THEN left(b, length(b) - {len(e)})" for e in T.ENDINGS) + " ELSE b END))[1]"
_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substring('  ' || {0} || ' ', i::BIGINT, 3)))"


def _fuzzy_sql(queries: str, texts: str, threshold: float, places: int = 6) -> str:
    """queries gives (query_id, query), texts gives (leaf_id, text)."""
    return f"""WITH qs AS ({queries}), ts AS ({texts}),
      qt AS (SELECT query_id, q, count(*) AS times FROM (SELECT query_id, unnest({_TOK.format(_FOLD.format("query"), _STEM)}) AS q FROM qs) GROUP BY ALL),
      lt AS (SELECT DISTINCT leaf_id, unnest({_TOK.format(_FOLD.format("text"), _STEM)}) AS token FROM ts),
      qg AS (SELECT q, len({_GRAMS.format("q")}) AS nq, unnest({_GRAMS.format("q")}) AS gram FROM (SELECT DISTINCT q FROM qt)),
      tg AS (SELECT token, len({_GRAMS.format("token")}) AS nt, unnest({_GRAMS.format("token")}) AS gram FROM (SELECT DISTINCT token FROM lt)),
      sim AS (SELECT q, token, CASE WHEN q = token THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * count(*) / (any_value(nq) + any_value(nt)) END AS s FROM qg JOIN tg USING (gram) GROUP BY q, token HAVING s >= 0.4),
      best AS (SELECT leaf_id, q, max(s) AS b FROM lt JOIN sim USING (token) GROUP BY ALL),
      met AS (SELECT query_id, leaf_id, sum(b * times) AS total, count(*) AS kinds FROM best JOIN qt USING (q) GROUP BY ALL),
      size AS (SELECT query_id, sum(times) AS n, count(*) AS kinds FROM qt GROUP BY ALL)
      SELECT query_id, leaf_id, round(total / n, {places}) AS score FROM met JOIN size USING (query_id, kinds) WHERE round(total / n, 12) >= {threshold}"""


@query("search_fuzzy_documents", _fuzzy_sql("SELECT item_id AS query_id, trim(text) AS query FROM benchmark", "SELECT doc_id AS leaf_id, text FROM documents", 0.42))
def search_fuzzy_documents(spark, sf_dir):
    return S.fuzzy(leaves(spark, sf_dir), asked(spark, sf_dir).withColumn("query", F.trim("query"))).withColumn("score", F.round("score", 6))


@query("search_hybrid_topk", f"""WITH b AS (SELECT item_id, trim(text) AS q FROM benchmark WHERE length(trim(text)) > 0),
      exact AS (SELECT item_id AS query_id, doc_id AS leaf_id FROM b JOIN documents d ON CASE WHEN regexp_matches(q, '[.*+?^${{}}()|\\[\\]\\\\]') THEN regexp_matches(d.text, '(?i)' || q) ELSE contains({_LOW_TEXT}, {_FOLD.format("q")}) END),
      fuzzy AS ({_fuzzy_sql("SELECT item_id AS query_id, trim(text) AS query FROM benchmark", "SELECT doc_id AS leaf_id, text FROM documents", 0.42, 12)}),
      found AS (SELECT query_id, leaf_id, max(e) AS e, max(CASE WHEN e = 1 THEN 1.0 ELSE score END) AS score FROM (SELECT query_id, leaf_id, 1 AS e, 1.0::DOUBLE AS score FROM exact UNION ALL SELECT query_id, leaf_id, 0, score FROM fuzzy) GROUP BY ALL),
      ranked AS (SELECT f.*, d.source AS file, d.lang AS branch, {_DISPLAY} AS text, row_number() OVER (PARTITION BY query_id ORDER BY e DESC, score DESC, d.source, d.doc_id) AS rank FROM found f JOIN documents d ON d.doc_id = f.leaf_id)
      SELECT query_id, rank::INTEGER AS rank, leaf_id, file, branch, leaf_id AS line, text, CASE WHEN e = 1 THEN 'exact' ELSE 'fuzzy' END AS match, round(score, 6) AS score, 'fallback' AS route FROM ranked WHERE rank <= 10""")  # fmt: skip
def search_hybrid_topk(spark, sf_dir):
    return S.search(leaves(spark, sf_dir), asked(spark, sf_dir), max_results=10).withColumn("score", F.round("score", 6))


_TYPO = "CASE WHEN length(p_type || ' ' || p_name) >= 4 THEN substring(p_type || ' ' || p_name, 1, 2) || substring(p_type || ' ' || p_name, 4, 1) || substring(p_type || ' ' || p_name, 3, 1) || substring(p_type || ' ' || p_name, 5) ELSE p_type || ' ' || p_name END"


@query("search_fuzzy_parts", _fuzzy_sql(f"SELECT {_TYPO} AS query_id, {_TYPO} AS query FROM (SELECT DISTINCT p_type, p_name FROM part)", "SELECT p_partkey AS leaf_id, p_name || ' ' || p_type AS text FROM part", 0.42))
def search_fuzzy_parts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    typed = T.typo(F.concat_ws(" ", "p_type", "p_name"))
    own = part.select(F.col("p_partkey").alias("leaf_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return S.fuzzy(own, part.select("p_type", "p_name").distinct().select(typed.alias("query_id"), typed.alias("query"))).withColumn("score", F.round("score", 6))


@query("trigram_dice_pairs", f"""WITH w AS (SELECT DISTINCT p_brand AS w FROM part UNION SELECT DISTINCT p_type FROM part), g AS (SELECT w, {_GRAMS.format("w")} AS g FROM w)
      SELECT a.w AS a, b.w AS b, round(2.0::DOUBLE * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 6) AS similarity FROM g a JOIN g b ON a.w < b.w WHERE 2.0::DOUBLE * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) >= 0.4""")  # fmt: skip
def trigram_dice_pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    words = part.select(F.col("p_brand").alias("token")).union(part.select("p_type")).distinct()
    found = S.similar_tokens(words, words.withColumnRenamed("token", "q")).where("q < token")
    return found.select(F.col("q").alias("a"), F.col("token").alias("b"), F.round("similarity", 6).alias("similarity"))


_OUTCOME = f"""WITH hit AS (SELECT b.item_id AS query_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.source, d.doc_id) AS rank
      FROM benchmark b JOIN documents d ON contains({_LOW_TEXT}, {_LOW_QUERY}))"""


@query("telemetry_counts", _OUTCOME + " SELECT CASE WHEN h.query_id IS NULL THEN 'miss' ELSE 'fallback' END AS outcome, count(*) AS n FROM benchmark b LEFT JOIN (SELECT * FROM hit WHERE rank = 1) h ON b.item_id = h.query_id GROUP BY 1")
def telemetry_counts(spark, sf_dir):
    found = S.search(leaves(spark, sf_dir), asked(spark, sf_dir), mode="literal", max_results=1, threshold=2.0)
    return S.outcomes(found, asked(spark, sf_dir))


@query("recall_at_1", _OUTCOME + f""", truth AS (SELECT b.item_id AS query_id, max(d.doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains({_LOW_TEXT}, {_LOW_QUERY}) GROUP BY 1)
      SELECT count(*) AS queries, count_if(h.doc_id = t.doc_id)::BIGINT AS hits, round(avg(CASE WHEN h.doc_id = t.doc_id THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS recall FROM truth t LEFT JOIN hit h ON h.query_id = t.query_id AND h.rank = 1""")  # fmt: skip
def recall_at_1(spark, sf_dir):
    found = S.search(leaves(spark, sf_dir), asked(spark, sf_dir), mode="literal", max_results=1, threshold=2.0)
    truth = S.matches(leaves(spark, sf_dir), asked(spark, sf_dir), mode="literal", threshold=2.0).groupBy("query_id").agg(F.max("leaf_id").alias("leaf_id"))
    return S.recall_at_1(found, truth).withColumn("recall", F.round("recall", 6))


# --- tokens, similarity, audits -------------------------------------------------------------------------------------

_AUDIT_STOP, _CLUSTER_STOP = (", ".join(f"'{w}'" for w in x) for x in (T.AUDIT_STOP, T.CLUSTER_STOP))
_AUDIT = rf"list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({{}}), '\*\*|__|`|\|', ' ', 'g'), '\b\d{{{{2}}}}\.\d{{{{2}}}}\.\d{{{{4}}}}\b', ' ', 'g'), '[^\p{{{{L}}}}\p{{{{N}}}}-]+'), lambda w: length(w) > 2 AND NOT (w IN ({_AUDIT_STOP}))))"
_KEY = rf"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({{}}), '\b\d{{{{2}}}}\.\d{{{{2}}}}\.\d{{{{4}}}}\b', ' ', 'g'), '[^\p{{{{L}}}}\p{{{{N}}}}-]+'), lambda w: length(w) > 2 AND NOT (w IN ({_CLUSTER_STOP}))))"


@query("token_frequency", f"SELECT token, count(*) AS leaves FROM (SELECT unnest({_AUDIT.format('text')}) AS token FROM documents) GROUP BY 1")
def token_frequency(spark, sf_dir):
    return leaves(spark, sf_dir).select(F.explode(T.audit_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("leaves"))


@query("inverted_index_size", f"SELECT count(*) AS postings, count(DISTINCT token) AS tokens, max(n) AS longest FROM (SELECT token, count(*) OVER (PARTITION BY token) AS n FROM (SELECT unnest({_AUDIT.format('text')}) AS token FROM documents))")
def inverted_index_size(spark, sf_dir):
    return token_frequency(spark, sf_dir).agg(F.sum("leaves").alias("postings"), F.count("*").alias("tokens"), F.max("leaves").alias("longest"))


_CLASSES = f"""WITH s AS (SELECT doc_id, list_sort({_AUDIT.format('text')}) AS s FROM documents WHERE NOT coalesce(regexp_matches(text, '(?i)\\bbkz:'), false)), c AS (SELECT s, min(doc_id) AS class, count(*) AS copies FROM s WHERE len(s) > 0 GROUP BY 1),
      t AS (SELECT class, copies, len(s) AS n, unnest(s) AS w FROM c), p AS (SELECT a.class AS a, b.class AS b, any_value(b.copies) AS there, count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity FROM t a JOIN t b ON a.w = b.w AND a.class <> b.class GROUP BY 1, 2 HAVING similarity >= 0.85)"""


@query("inverted_index_search", f"""WITH d AS (SELECT doc_id, {_AUDIT.format('text')} AS w FROM documents), b AS (SELECT item_id, {_AUDIT.format('text')} AS w FROM benchmark)
      SELECT item_id AS query_id, doc_id AS leaf_id FROM b JOIN d ON list_has_all(d.w, b.w) WHERE len(b.w) > 0""")  # fmt: skip
def inverted_index_search(spark, sf_dir):
    """Documents with all words of a benchmark text, from an index of all documents."""
    own = leaves(spark, sf_dir).select("leaf_id", T.audit_tokens(F.col("text")).alias("tokens"))
    asked_for = asked(spark, sf_dir).select("query_id", T.audit_tokens(F.col("query")).alias("tokens"))
    return index.search(index.build(own), asked_for)


_NEWER = "SELECT CASE WHEN lang = 'de' THEN text || ' renewed leaf' ELSE text END AS text FROM documents WHERE n_chars < 9000"


@query("inverted_index_updated", f"SELECT token, count(*) AS leaves FROM (SELECT unnest({_AUDIT.format('text')}) AS token FROM ({_NEWER})) GROUP BY 1")
def inverted_index_updated(spark, sf_dir):
    """Lengths of the posting lists after long documents are gone and the German ones are changed: the index of all documents with those leaves merged in."""
    docs = spread(table(spark, sf_dir, "documents"))
    tokens = T.audit_tokens(F.col("text")).alias("tokens")
    state = docs.select(F.col("doc_id").alias("id"), "text", F.sha2("text", 256).alias("contentHash"))
    now = docs.where("n_chars < 9000").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "de", F.concat("text", F.lit(" renewed leaf"))).otherwise(F.col("text")).alias("text")).withColumn("contentHash", F.sha2("text", 256))
    # what has changed is found by ids and hashes, and texts are fetched for that only
    mark = ("id", "contentHash")
    ids = cut(diff.upserts(now.select(*mark), state.select(*mark), fields=("contentHash",)).select("id", F.lit(True).alias("put")).unionByName(diff.deletes(now, state).select("id", F.lit(False).alias("put"))))
    put = now.join(ids.where("put"), "id", "left_semi").select(F.col("id").alias("leaf_id"), tokens)
    out = state.join(ids, "id", "left_semi").select(F.col("id").alias("leaf_id"), tokens)
    kept = index.build(state.select(F.col("id").alias("leaf_id"), tokens))
    return index.update(kept, out, put).groupBy("token").agg(F.sum("n").alias("leaves"))


@query("near_duplicate_leaves", _CLASSES + " SELECT s.doc_id AS leaf_id, c.class AS class, (c.copies - 1 + coalesce(o.there, 0))::BIGINT AS links FROM s JOIN c USING (s) LEFT JOIN (SELECT a, sum(there) AS there FROM p GROUP BY 1) o ON o.a = c.class")
def near_duplicate_leaves(spark, sf_dir):
    return similarity.links(audit.compared(leaves(spark, sf_dir)), "leaf_id", "tokens", audit.DUPLICATE)


@query("near_duplicate_classes", _CLASSES + " SELECT a, b, round(similarity, 6) AS similarity FROM p WHERE a < b")
def near_duplicate_classes(spark, sf_dir):
    return similarity.similar_classes(audit.compared(leaves(spark, sf_dir)), "leaf_id", "tokens", audit.DUPLICATE)[1].withColumn("similarity", F.round("similarity", 6))


@query("exact_duplicates", "SELECT sha256(text) AS hash, count(*) AS leaves, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return leaves(spark, sf_dir).groupBy(T.content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("leaves"), F.min("leaf_id").alias("first")).where("leaves > 1")


_BRANCHES = "SELECT DISTINCT lang AS file, source AS branch_ord FROM documents"


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("file"), F.col("source").alias("branch_ord")).distinct()


@query("growth_root_branches", f"SELECT file, count(*) AS branches FROM ({_BRANCHES}) GROUP BY 1 HAVING count(*) >= 9")
def growth_root_branches(spark, sf_dir):
    return audit.root_branches(branches(spark, sf_dir))


_GROWN = "SELECT source AS file, lang AS branch, count(*) AS leaves, CASE WHEN count(*) >= 50 THEN 'error' ELSE 'warn' END AS level FROM documents GROUP BY 1, 2 HAVING count(*) >= 30"


@query("growth_branch_leaves", _GROWN)
def growth_branch_leaves(spark, sf_dir):
    return audit.branch_leaves(leaves(spark, sf_dir)).select("file", "branch", "leaves", "level")


_INDEX = "SELECT 'root-' || substring(source, 4) || '-notes.md' AS file, count(*) AS leaves FROM documents GROUP BY 1 HAVING regexp_matches(file, '(?i)-0-|^0[-_]|index|indeks') AND count(*) >= 15"


@query("index_bloat", _INDEX)
def index_bloat(spark, sf_dir):
    return audit.index_bloat(leaves(spark, sf_dir).withColumn("file", F.concat(F.lit("root-"), F.substring("file", 4, 99), F.lit("-notes.md"))))


@query("finding_counts", f"SELECT count_if(level = 'error')::BIGINT AS errors, count_if(level = 'warn')::BIGINT AS warnings FROM (SELECT level FROM ({_GROWN}) UNION ALL SELECT 'warn' FROM (SELECT file FROM ({_BRANCHES}) GROUP BY 1 HAVING count(*) >= 9))")
def finding_counts(spark, sf_dir):
    found = audit.branch_leaves(leaves(spark, sf_dir)).select("level").union(audit.root_branches(branches(spark, sf_dir)).select(F.lit("warn")))
    return audit.by_level(found)


_PLACE = "(SELECT doc_id, source || ' › ## ' || lang || ' L' || doc_id AS place FROM documents)"


# no document refers to a root, and none of these roots is an index, so the other audits give nothing
@query("audit_findings", f"""{_CLASSES}, g AS ({_GROWN}), r AS (SELECT file, count(*) AS branches FROM ({_BRANCHES}) GROUP BY 1 HAVING count(*) >= 9),
      j AS (SELECT a AS i, b AS j, similarity FROM p WHERE a < b UNION ALL SELECT class, doc_id, 1.0 FROM s JOIN c USING (s) WHERE class <> doc_id)
      SELECT 'warn' AS level, 'root-branches' AS code, file || ': ' || branches || ' branches' AS msg FROM r UNION ALL SELECT level, 'branch-leaves', file || ' › ## ' || branch || ': ' || leaves || ' leaves' FROM g
      UNION ALL SELECT 'warn', 'duplication', 'near-duplicate (' || round(similarity * 100)::INTEGER || '%): ' || x.place || ' ≈ ' || y.place FROM j JOIN {_PLACE} x ON x.doc_id = i JOIN {_PLACE} y ON y.doc_id = j.j""")  # fmt: skip
def audit_findings(spark, sf_dir):
    return audit.findings(leaves(spark, sf_dir), branches(spark, sf_dir))


@query("seed_keyword_scores", f"""WITH t AS (SELECT source AS file, lang AS branch, unnest({_KEY.format('text')}) AS token FROM documents), n AS (SELECT source AS file, lang AS branch, count(*) AS total FROM documents GROUP BY 1, 2),
      c AS (SELECT file, branch, token, count(*) AS leaves FROM t GROUP BY ALL) SELECT file, branch, token, leaves, round(leaves * (1 - leaves::DOUBLE / total), 6) AS score FROM c JOIN n USING (file, branch) WHERE leaves >= 2 AND leaves < total""")  # fmt: skip
def seed_keyword_scores(spark, sf_dir):
    return cluster.seed_scores(leaves(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("cluster_evidence_top3", f"""WITH c AS (SELECT source AS cluster, token, count(*) AS leaves FROM (SELECT source, unnest({_KEY.format('text')}) AS token FROM documents) GROUP BY ALL)
      SELECT cluster, rank::INTEGER AS rank, token, leaves FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY leaves DESC, token) AS rank FROM c) WHERE rank <= 3""")  # fmt: skip
def cluster_evidence_top3(spark, sf_dir):
    return cluster.evidence(leaves(spark, sf_dir).select(F.col("file").alias("cluster"), "text"))


@query("branch_split_clusters")
def branch_split_clusters(spark, sf_dir):
    """Conversations as branches, which their length bounds, and turns as leaves."""
    c = table(spark, sf_dir, "conversations")
    turns = c.select(F.concat_ws(":", "conv_id", "turn").alias("leaf_id"), F.lit("conversations").alias("file"), F.col("conv_id").cast("string").alias("branch"), F.col("turn").alias("index"), "text")
    return cluster.split_branches(turns, 4).select("file", "branch", "cluster", "keyword", "confidence", "overall", F.size("leaf_ids").alias("leaves"))


# --- references -----------------------------------------------------------------------------------------------------


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges order → customer → nation → region, and live nodes; customers with debts and their orders' targets are gone."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = o.select(name("o", "o_orderkey").alias("source"), name("c", "o_custkey").alias("target")).union(c.select(name("c", "c_custkey"), name("n", "c_nationkey"))).union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    live = o.select(name("o", "o_orderkey").alias("id")).union(c.where("c_acctbal >= 0").select(name("c", "c_custkey"))).union(n.select(name("n", "n_nationkey"))).union(r.select(name("r", "r_regionkey")))
    return edges.withColumn("status", F.lit("resolved")), live


_GRAPH = """WITH e AS (SELECT 'o' || o_orderkey AS source, 'c' || o_custkey AS target FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
      live AS (SELECT 'o' || o_orderkey AS id FROM orders UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region),
      good AS (SELECT DISTINCT source, target FROM e WHERE source IN (SELECT id FROM live) AND target IN (SELECT id FROM live))"""


@query("edge_chain_two_hop", _GRAPH + " SELECT DISTINCT a.source AS source, a.target AS middle, b.target AS target FROM good a JOIN good b ON a.target = b.source")
def edge_chain_two_hop(spark, sf_dir):
    return references.chains(*graph(spark, sf_dir))


@query("edges_broken", _GRAPH + " SELECT source, target, source IN (SELECT id FROM live) AS has_source, target IN (SELECT id FROM live) AS has_target FROM e WHERE NOT (source IN (SELECT id FROM live) AND target IN (SELECT id FROM live))")
def edges_broken(spark, sf_dir):
    return references.broken(*graph(spark, sf_dir)).select("source", "target", "has_source", "has_target")


@query("edge_status", _GRAPH + " SELECT CASE WHEN target IN (SELECT id FROM live) THEN 'resolved' ELSE 'unresolved' END AS status, count(*) AS edges FROM e GROUP BY 1")
def edge_status(spark, sf_dir):
    edges, live = graph(spark, sf_dir)
    met = edges.drop("status").join(live.select(F.col("id").alias("target"), F.lit("resolved").alias("status")), "target", "left")
    return met.groupBy(F.coalesce("status", F.lit("unresolved")).alias("status")).agg(F.count("*").alias("edges"))


@query("reference_resolution", """WITH l AS (SELECT 'n' || n_nationkey AS leaf_id, n_regionkey AS number, lower(trim(n_name)) AS name FROM nation),
      home AS (SELECT number, regexp_replace(name, '[\\s_-]+', '-', 'g') AS key, count(*) AS n, min(leaf_id) AS sole FROM l GROUP BY 1, 2),
      c AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
      SELECT 'c' || c_custkey AS source, sole AS target, 'resolved' AS status, 'bkz: root-' || n_regionkey || ' / nation_' || c_nationkey AS human FROM c JOIN home ON home.number = n_regionkey AND home.key = 'nation-' || c_nationkey""")  # fmt: skip
def reference_resolution(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    homes = nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("leaf_id"), F.format_string("root-%d-nations.md", "n_regionkey").alias("file"), F.col("n_name").alias("branch"), F.lit("").alias("text"))
    met = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    own = met.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("leaf_id"), F.lit("root-9-customers.md").alias("file"), F.col("c_mktsegment").alias("branch"), F.format_string("%s, bkz: root-%d / nation_%d", "c_name", "n_regionkey", "c_nationkey").alias("text"))
    return references.resolve(homes.unionByName(own)).select("source", "target", "status", "human")


_LINKS = """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)"""


@query("edges_extracted", _LINKS + " SELECT target, count(*) AS links, count(DISTINCT page_id) AS pages FROM l GROUP BY 1")
def edges_extracted(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return found.groupBy("target").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


@query("links_unresolved", _LINKS + " SELECT l.page_id, count(*) AS broken FROM l LEFT JOIN pages p ON p.url = l.target WHERE p.url IS NULL GROUP BY 1")
def links_unresolved(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return found.join(pages.select(F.col("url").alias("target")), "target", "left_anti").groupBy("page_id").agg(F.count("*").alias("broken"))


@query("chain_middles", _GRAPH + """ SELECT i.middle AS middle, sources, targets, sources * targets AS chains FROM (SELECT target AS middle, count(*) AS sources FROM good GROUP BY 1) i JOIN (SELECT source AS middle, count(*) AS targets FROM good GROUP BY 1) o ON i.middle = o.middle""")
def chain_middles(spark, sf_dir):
    """Chains by their middle, uncounted ones of hubs included: nations stand between all their customers and a region."""
    return references.middles(*graph(spark, sf_dir))


_ROOTS = "SELECT DISTINCT 'Root-' || s_nationkey || '-' || CASE WHEN s_acctbal > 4000 THEN 'Building' ELSE 'Furniture' END || '-suppliers.md' AS file FROM supplier"


@query("roots_missing", f"""WITH r AS ({_ROOTS}), a AS (SELECT c_custkey, 'root-' || c_nationkey || '-' || c_mktsegment || '.md' AS reference FROM customer)
      SELECT c_custkey AS line, reference FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE starts_with(lower(r.file), lower(replace(reference, '.md', ''))))""")  # fmt: skip
def roots_missing(spark, sf_dir):
    """Customers refer to roots of their nation and segment, of which suppliers' files are a part."""
    file = F.format_string("Root-%d-%s-suppliers.md", "s_nationkey", F.when(F.col("s_acctbal") > 4000, "Building").otherwise("Furniture"))
    text = F.format_string("see it (bkz: root-%d-%s.md)", "c_nationkey", "c_mktsegment")
    own = table(spark, sf_dir, "customer").select(F.lit("root-9-customers.md").alias("file"), F.col("c_mktsegment").alias("branch"), F.col("c_custkey").alias("line"), text.alias("text"))
    return references.missing_roots(own, table(spark, sf_dir, "supplier").select(file.alias("file")).distinct()).select("line", "reference")


@query("edges_to_moved", """SELECT l_orderkey || ':' || l_linenumber AS edge, 'o' || l_orderkey AS source, 'p' || l_partkey AS target, p_type AS branch FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 2 AND p_type <> p_brand""")
def edges_to_moved(spark, sf_dir):
    """Line items as references to parts, of which the smallest have moved from their brand's branch to their type's."""
    part, item = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    leaf = F.concat(F.lit("p"), F.col("p_partkey")).alias("leaf_id")
    before = part.select(leaf, F.lit("root-1-parts.md").alias("file"), F.col("p_brand").alias("branch"))
    after = part.select(leaf, F.lit("root-1-parts.md").alias("file"), F.when(F.col("p_size") <= 2, F.col("p_type")).otherwise(F.col("p_brand")).alias("branch"))
    edges = item.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("o"), F.col("l_orderkey")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey")).alias("target"), F.lit("bkz").alias("human"))
    return references.moved(before, after, edges).select("edge", "source", "target", "branch")


_EXPLICIT = "CASE WHEN c_acctbal < 0 THEN 'n' || (c_nationkey + 1) % 25 WHEN c_acctbal > 9000 THEN 'gone' WHEN c_acctbal > 8000 THEN 'n' || c_nationkey END"


@query("references_explicit", f"""WITH c AS (SELECT c_custkey, c_nationkey, n_regionkey, {_EXPLICIT} AS named, c_mktsegment = 'HOUSEHOLD' AS nowhere FROM customer JOIN nation ON c_nationkey = n_nationkey),
      t AS (SELECT *, CASE WHEN named IS NOT NULL THEN named WHEN NOT nowhere THEN 'n' || c_nationkey END AS target, 'bkz: root-' || n_regionkey || ' / ' || CASE WHEN nowhere THEN 'nowhere' ELSE 'nation_' || c_nationkey END AS human FROM c)
      SELECT 'c' || c_custkey AS source, target, CASE WHEN target IS NULL THEN 'legacy-unresolved' WHEN target = 'gone' THEN 'unresolved' WHEN target = 'n' || c_nationkey AND NOT nowhere THEN 'resolved' ELSE 'resolved-path-mismatch' END AS status, human FROM t""")  # fmt: skip
def references_explicit(spark, sf_dir):
    """All four states of an edge: customers refer to their nation's branch or to none, and some name a target outright."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    homes = nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("leaf_id"), F.format_string("root-%d-nations.md", "n_regionkey").alias("file"), F.col("n_name").alias("branch"), F.lit("").alias("text"))
    met = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    branch = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "nowhere").otherwise(F.format_string("nation_%d", "c_nationkey"))
    own = met.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("leaf_id"), F.lit("root-9-customers.md").alias("file"), F.col("c_mktsegment").alias("branch"), F.format_string("%s, bkz: root-%d / %s", F.col("c_name"), F.col("n_regionkey"), branch).alias("text"))
    named = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("n"), (F.col("c_nationkey") + 1) % 25)).when(F.col("c_acctbal") > 9000, "gone").when(F.col("c_acctbal") > 8000, F.concat(F.lit("n"), F.col("c_nationkey")))
    explicit = customer.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("leaf_id"), F.lit(0).alias("ord"), F.lit(0).alias("place"), named.alias("target")).where("target is not null")
    return references.resolve(homes.unionByName(own), explicit).select("source", "target", "status", "human")


@query("audit_references", _GRAPH + """ SELECT 'broken-ref' AS code, source AS first, count(*) AS n FROM e WHERE NOT (source IN (SELECT id FROM live) AND target IN (SELECT id FROM live)) GROUP BY 2
      UNION ALL SELECT 'reference-chain', a.source, count(*) FROM good a JOIN good b ON a.target = b.source GROUP BY 2""")  # fmt: skip
def audit_references(spark, sf_dir):
    """Findings of an audit with a graph: broken references and chains of more than one hop, by their first leaf."""
    edges, live = graph(spark, sf_dir)
    own = live.select(F.col("id").alias("leaf_id"), F.lit("root-1.md").alias("file"), F.lit(0).alias("branch_ord"), F.lit("b").alias("branch"), F.lit(1).alias("line"), F.lit("").alias("text"))
    found = audit.findings(own, own.select("file", "branch_ord").limit(0), edges).where("code in ('broken-ref', 'reference-chain')")
    first = F.regexp_extract("msg", "^([^ :]+)", 1)
    return found.groupBy("code", first.alias("first")).agg(F.count("*").alias("n"))


@query("search_invalid_pattern", "SELECT q.query_id AS query_id, doc_id AS leaf_id FROM documents, (VALUES (1, '+'), (2, '('), (3, '*')) q(query_id, query) WHERE contains(text, query)")
def search_invalid_pattern(spark, sf_dir):
    """Patterns that don't compile are searched for literally."""
    own = spark.createDataFrame([(1, "+"), (2, "("), (3, "*")], "query_id int, query string")
    return S.matches(leaves(spark, sf_dir), own, mode="regex", threshold=2.0).select("query_id", "leaf_id")


# --- logs and replay ------------------------------------------------------------------------------------------------

# an empty user turn is where a conversation's log breaks off; turns number lines from 0
_CONV = "SELECT conv_id, turn, CASE WHEN role = 'user' AND length(text) > 400 THEN turn + 1 ELSE turn END AS seq, role FROM conversations"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as logs whose sequence numbers are wrong at long user turns."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when((F.col("role") == "user") & (F.length("text") > 400), F.col("turn") + 1).otherwise(F.col("turn")).alias("seq"), "role")


@query("eventlog_valid_prefix", f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM ({_CONV})), b AS (SELECT conv_id, min(turn) FILTER (WHERE seq IS DISTINCT FROM place) AS bad FROM l GROUP BY 1)
      SELECT l.conv_id AS conv_id, l.turn AS turn, l.seq AS seq, l.role AS role FROM l JOIN b USING (conv_id) WHERE bad IS NULL OR turn < bad""")  # fmt: skip
def eventlog_valid_prefix(spark, sf_dir):
    return replay.valid_prefix(log(spark, sf_dir), "conv_id", "turn", "seq", 0)


@query("eventlog_sequence_gaps", f"SELECT conv_id, min(turn) FILTER (WHERE seq IS DISTINCT FROM place) AS bad FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM ({_CONV})) GROUP BY 1")
def eventlog_sequence_gaps(spark, sf_dir):
    return replay.first_bad(log(spark, sf_dir), "conv_id", "turn", "seq", 0)


@query("eventlog_chain_check", """WITH h AS (SELECT conv_id, turn, sha256(conv_id || ':' || turn || ':' || text) AS hash, lead(length(text) > 400 AND role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS skipped FROM conversations),
      l AS (SELECT conv_id, turn, lag(hash) OVER (PARTITION BY conv_id ORDER BY turn) AS wanted, lag(skipped) OVER (PARTITION BY conv_id ORDER BY turn) AS broken FROM h)
      SELECT conv_id, turn, 'skipped' AS found, wanted FROM l WHERE coalesce(broken, false)""")  # fmt: skip
def eventlog_chain_check(spark, sf_dir):
    # a log as it would be written, but for long user turns, which name no record that is there
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws(":", "conv_id", "turn", "text"), 256).alias("hash"), ((F.col("role") == "user") & (F.length("text") > 400)).alias("long"))
    written = scan.numbered(own, ["conv_id"], ["turn"], "place", {"last": "hash"}).withColumn("before", F.when(F.col("last").isNotNull() & F.col("long"), "skipped").otherwise(F.col("last")))
    return replay.unchained(written, "conv_id", "turn", "hash", "before")


_TX = """WITH o AS (SELECT conv_id AS tx, turn AS seq, sha256(text) AS hash, role FROM conversations), c AS (SELECT tx, list(hash ORDER BY seq) AS own, max(seq) + 1 AS cs FROM o GROUP BY 1),
      k AS (SELECT tx, cs, (SELECT list(hash ORDER BY seq) FROM o WHERE o.tx = c.tx AND o.role <> 'system') AS hashes FROM c)"""


@query("committed_operations", _TX + " SELECT o.tx AS tx, o.seq AS seq, o.hash AS hash, k.cs AS commit_seq FROM o JOIN c USING (tx) JOIN k USING (tx) WHERE c.own = k.hashes")
def committed_operations(spark, sf_dir):
    ops = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tx"), F.col("turn").alias("seq"), T.content_hash(F.col("text")).alias("hash"), "role")
    # commits that leave out system turns don't cover the transactions that have them
    commits = ops.groupBy("tx").agg((F.max("seq") + 1).alias("seq"), F.transform(F.array_sort(F.collect_list(F.when(F.col("role") != "system", F.struct("seq", "hash")))), lambda x: x["hash"]).alias("hashes"))
    return replay.committed(ops.drop("role"), commits).select("tx", "seq", "hash", "commit_seq")


_OPS = """SELECT user_id || ':' || json_extract_string(props, '$.k') AS id, event_id AS seq, value,
      CASE event_type WHEN 'signup' THEN 'upsert' WHEN 'view' THEN 'upsert' WHEN 'click' THEN 'provenance' WHEN 'error' THEN CASE WHEN value >= 150 THEN 'forget' ELSE 'delete' END ELSE 'edge' END AS type FROM events"""


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations on leaves: sign-ups and views write, clicks set provenance, errors delete or, if costly, forget."""
    return operations_of(table(spark, sf_dir, "events"))


def operations_of(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind.isin("signup", "view"), "upsert").when(kind == "click", "provenance").when(kind == "error", F.when(F.col("value") >= 150, "forget").otherwise("delete")).otherwise("edge")
    id_ = F.concat_ws(":", "user_id", F.get_json_object("props", "$.k"))
    return e.select(id_.alias("id"), F.col("event_id").alias("seq"), "value", op.alias("type"), F.when(kind == "click", F.create_map(F.lit("confidence"), F.col("value").cast("string"))).alias("provenance")).where("type <> 'edge'")


_STATE = f"""WITH o AS (SELECT * FROM ({_OPS}) WHERE type <> 'edge'), f AS (SELECT id, min(seq) AS fs FROM o WHERE type = 'forget' GROUP BY 1), k AS (SELECT o.* FROM o LEFT JOIN f USING (id) WHERE NOT (type = 'upsert' AND fs IS NOT NULL AND seq > fs)),
      last AS (SELECT id, arg_max(type, seq) AS t, max(seq) AS s FROM k WHERE type IN ('upsert', 'delete', 'forget') GROUP BY 1), live AS (SELECT id, s FROM last WHERE t = 'upsert')"""


@query("state_leaves_lww", _STATE + " SELECT live.id AS id, k.value AS value, (SELECT max(p.seq) FROM k p WHERE p.id = live.id AND p.seq >= live.s) AS seq FROM live JOIN k ON k.id = live.id AND k.seq = live.s")
def state_leaves_lww(spark, sf_dir):
    return replay.leaf_state(operations(spark, sf_dir)).select("id", "value", "seq")


@query("state_provenance_fold", _STATE + " SELECT live.id AS id, (SELECT arg_max(p.value, p.seq) FROM k p WHERE p.id = live.id AND p.seq > live.s AND p.type = 'provenance') AS confidence FROM live")
def state_provenance_fold(spark, sf_dir):
    return replay.leaf_state(operations(spark, sf_dir), fields=("confidence",)).select("id", F.col("confidence").cast("double").alias("confidence"))


@query("stream_leaf_states", _STATE + " SELECT live.id AS id, k.value AS value, (SELECT max(p.seq) FROM k p WHERE p.id = live.id AND p.seq >= live.s) AS seq, (SELECT arg_max(p.value, p.seq) FROM k p WHERE p.id = live.id AND p.seq > live.s AND p.type = 'provenance') AS confidence FROM live JOIN k ON k.id = live.id AND k.seq = live.s")
def stream_leaf_states(spark, sf_dir):
    """The events as a stream until there are no more: the last state that it gave out of each leaf."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    states = streams.leaf_states(operations_of(events).drop("provenance"))
    states.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    given = spark.read.schema(f"{streams.LEAF}, batch long").parquet(f"{at}/out")
    last = given.groupBy("id").agg(F.max_by(F.struct("live", "value", "seq", "confidence"), "batch").alias("x")).where("x.live")
    out = cut(last.select("id", "x.value", "x.seq", "x.confidence"))
    removed(spark, at)
    return out


@query("state_tombstones", f"SELECT id, min(seq) AS seq FROM ({_OPS}) WHERE type = 'forget' GROUP BY 1")
def state_tombstones(spark, sf_dir):
    return replay.tombstones(operations(spark, sf_dir))


@query("leaf_last_change", _STATE + """, w AS (SELECT *, last_value(CASE WHEN type <> 'provenance' THEN type END IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS now FROM k)
      SELECT id, max(seq) AS seq FROM w WHERE type <> 'provenance' OR now = 'upsert' GROUP BY 1""")  # fmt: skip
def leaf_last_change(spark, sf_dir):
    return replay.last_changes(operations(spark, sf_dir))


@query("state_edges", """WITH o AS (SELECT user_id AS id, event_id AS seq, value, event_type FROM events WHERE event_type IN ('purchase', 'error')), l AS (SELECT id, max(seq) AS seq FROM o GROUP BY 1)
      SELECT o.id AS id, o.value AS value, o.seq AS seq FROM o JOIN l USING (id, seq) WHERE event_type = 'purchase'""")  # fmt: skip
def state_edges(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'error')")
    return replay.last_writer(e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "value", F.when(F.col("event_type") == "purchase", "upsert").otherwise("delete").alias("type")))


# --- differences ----------------------------------------------------------------------------------------------------

# parts as leaves: the largest are deleted by an edit, the smallest change branch, and suppliers are new
_BASE_SQL = "SELECT 'p' || p_partkey AS id, p_brand AS branch, p_name AS kind FROM part"
_CURRENT = "SELECT 'p' || p_partkey AS id, CASE WHEN p_size <= 2 THEN p_type ELSE p_brand END AS branch, p_name AS kind FROM part WHERE p_size < 49 UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier' FROM supplier"
_FIELDS = ("branch", "kind")


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("p"), F.col("p_partkey")).alias("id")
    base = part.select(name, F.col("p_brand").alias("branch"), F.col("p_name").alias("kind"))
    now = part.where("p_size < 49").select(name, F.when(F.col("p_size") <= 2, F.col("p_type")).otherwise(F.col("p_brand")).alias("branch"), F.col("p_name").alias("kind"))
    return base, now.union(supplier.select(F.concat(F.lit("s"), F.col("s_suppkey")), "s_name", F.lit("supplier")))


@query("diff_upserts", f"SELECT c.id AS id, c.branch AS branch, c.kind AS kind FROM ({_CURRENT}) c LEFT JOIN ({_BASE_SQL}) b USING (id) WHERE b.id IS NULL OR b.branch IS DISTINCT FROM c.branch OR b.kind IS DISTINCT FROM c.kind")
def diff_upserts(spark, sf_dir):
    base, now = versions(spark, sf_dir)
    return diff.upserts(now, base, fields=_FIELDS)


@query("diff_deletes", f"SELECT id FROM ({_BASE_SQL}) EXCEPT ALL SELECT id FROM ({_CURRENT})")
def diff_deletes(spark, sf_dir):
    base, now = versions(spark, sf_dir)
    return diff.deletes(now, base)


@query("reconcile_three_way", f"""WITH b AS ({_BASE_SQL}), c AS ({_CURRENT}), g AS (SELECT 'p' || l_partkey AS id, max(l_linenumber) AS changed FROM lineitem GROUP BY 1),
      e AS (SELECT coalesce(b.id, c.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'deleted' WHEN b.branch IS DISTINCT FROM c.branch OR b.kind IS DISTINCT FROM c.kind THEN 'changed' END AS change, CASE WHEN b.id IS NULL THEN NULL ELSE 6 END AS checkpoint FROM b FULL JOIN c ON b.id = c.id)
      SELECT e.id AS id, change, coalesce(changed > checkpoint, false) AS conflict FROM e LEFT JOIN g USING (id) WHERE change IS NOT NULL""")  # fmt: skip
def reconcile_three_way(spark, sf_dir):
    base, now = versions(spark, sf_dir)
    changes = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("p"), F.col("l_partkey")).alias("id")).agg(F.max("l_linenumber").alias("changed"))
    return diff.reconcile(base.withColumn("checkpoint", F.lit(6)), now, changes, fields=_FIELDS)


@query("diff_edges", """WITH new AS (SELECT sha256('o' || o_orderkey || '>' || o_custkey) AS id, o_orderkey AS source FROM orders WHERE o_orderstatus <> 'F'), old AS (SELECT sha256('o' || o_orderkey || '>' || o_custkey) AS id, o_orderkey AS source FROM orders WHERE o_orderstatus <> 'O')
      SELECT id, 'upsert' AS op FROM new WHERE id NOT IN (SELECT id FROM old) UNION ALL SELECT id, 'delete' FROM old WHERE id NOT IN (SELECT id FROM new)""")  # fmt: skip
def diff_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("id", F.sha2(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(">"), F.col("o_custkey").cast("string")), 256))
    o = o.select("id", F.col("o_orderkey").alias("source"), "o_orderstatus")
    return diff.edges(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus <> 'O'"), o.select("source"))


_FILES = "SELECT file, sha256(string_agg(hash, '' ORDER BY r)) AS hash FROM (SELECT source AS file, doc_id // 1024 AS r, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY doc_id)) AS hash FROM documents {} GROUP BY 1, 2) GROUP BY 1"


@query("hash_manifest", _FILES.format(""))
def hash_manifest(spark, sf_dir):
    return diff.manifest(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("dirty_views", f"SELECT a.file AS file FROM ({_FILES.format('')}) a LEFT JOIN ({_FILES.format('WHERE n_chars < 15000')}) b USING (file) WHERE a.hash IS DISTINCT FROM b.hash")
def dirty_views(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return diff.dirty(diff.manifest(docs.where("n_chars < 15000"), "source", "doc_id", "text"), diff.manifest(docs, "source", "doc_id", "text"))


@query("move_selector_ambiguity", """WITH s AS (SELECT DISTINCT p_brand AS selector FROM part UNION SELECT DISTINCT p_name FROM part), l AS (SELECT 'p' || p_partkey AS leaf_id, p_name || ' ' || p_type || ' ' || p_brand AS text FROM part),
      m AS (SELECT selector, leaf_id FROM s LEFT JOIN l ON selector = leaf_id OR contains(l.text, selector)) SELECT selector, count(leaf_id) AS hits, CASE WHEN count(leaf_id) = 1 THEN min(leaf_id) END AS leaf_id FROM m GROUP BY 1""")  # fmt: skip
def move_selector_ambiguity(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    own = part.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("leaf_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return diff.selectors(own, part.select(F.col("p_brand").alias("selector")).union(part.select("p_name")).distinct())


@query("retention_keep_latest_n", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def retention_keep_latest_n(spark, sf_dir):
    return diff.newest(table(spark, sf_dir, "events"), "user_id", "ts", 3, "event_id").select("user_id", "event_id")


@query("asof_metadata_to_leaf", """WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click')
      SELECT c.user_id AS user_id, c.event_id AS mark, (SELECT arg_min(p.event_id, (p.ts, p.event_id)) FROM p WHERE p.user_id = c.user_id AND p.ts >= c.ts) AS next_value FROM c""")  # fmt: skip
def asof_metadata_to_leaf(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return diff.forward(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), "user_id", "ts", "event_id").select("user_id", "mark", "next_value")


# --- functions ------------------------------------------------------------------------------------------------------


@query("text_functions", r"""SELECT c_custkey AS id, regexp_replace(lower(trim(c_name)), '[\s_-]+', '-', 'g') AS key, upper(substring(lower(c_mktsegment), 1, 1)) || substring(lower(c_mktsegment), 2) AS title, round(length(c_name) / 4.0)::BIGINT AS tokens,
      sha256(c_name) AS hash, 'bkz: Root-' || c_nationkey || ' / ' || c_mktsegment AS human, substring(c_name, 1, 2) || substring(c_name, 4, 1) || substring(c_name, 3, 1) || substring(c_name, 5) AS typo FROM customer""")  # fmt: skip
def text_functions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), T.branch_key(F.col("c_name")).alias("key"), T.title(F.lower("c_mktsegment")).alias("title"), T.token_estimate(F.col("c_name")).alias("tokens"), T.content_hash(F.col("c_name")).alias("hash"), T.human_reference(F.col("c_nationkey"), F.col("c_mktsegment")).alias("human"), T.typo(F.col("c_name")).alias("typo"))


@query("leaf_display", f"SELECT doc_id, {_DISPLAY} AS shown FROM documents d")
def leaf_display(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.display(F.col("text")).alias("shown"))


@query("edge_ids", """SELECT o_orderkey AS id, 'e_' || substring(sha256('{"human":"bkz","sourceId":"o' || o_orderkey || '","status":"resolved","targetId":"c' || o_custkey || '"}'), 1, 24) AS edge FROM orders""")
def edge_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), T.edge_id(F.concat(F.lit("o"), F.col("o_orderkey")), F.concat(F.lit("c"), F.col("o_custkey")), F.lit("resolved"), F.lit("bkz")).alias("edge"))


@query("provenance_join", "SELECT d.doc_id AS doc_id, d.source AS source, l.quality AS confidence, l.toxic AS flagged FROM documents d LEFT JOIN labels l USING (doc_id)")
def provenance_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", F.col("quality").alias("confidence"), F.col("toxic").alias("flagged"))


@query("set_operations", """SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
      UNION ALL SELECT 'all', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)""")  # fmt: skip
def set_operations(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey")
    n = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n("both", c.intersect(o)).union(n("only", c.subtract(o))).union(n("all", c.union(o).distinct()))


from . import queries_trees  # noqa: E402, F401 - registers its own

__all__ = ["QUERIES", "SQL"]
