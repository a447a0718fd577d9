"""Registered queries of the parser and of operations on trees of root files.

Orders are dealt as Markdown documents, one for each customer, with a block for each order whose kind the order's number
says; regions and nations, which are few at any scale, as a tree with a log."""

from __future__ import annotations

import re
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import restructure
from .plans.store import Tree
from .registry import query, table
from .sources import eventlog, markdown, trees
from .sources.shared import shared_dir

# --- documents ------------------------------------------------------------------------------------------------------

#: By the order's number modulo their count: the kind of node that a block makes, and its lines, with @ for the number.
BLOCKS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("branch", ("## B@",)), ("heading", ("### H@ ##",)), ("heading", ("Title @", "===")), ("code-fence", ("```", "## not a branch @", "```")), ("entry", ("**01.02.2024 — entry @**", "  more")), ("list-item", ("- item @", "  - nested")),
    ("blockquote", ("> quote @", "> more")), ("table", ("| a | b |", "|---|---|", "| @ | x |")), ("indented-code", ("    code @",)), ("placeholder", ("_no entries yet._",)), ("", ()), ("paragraph", ("<!-- note:id:l@ -->", "<!-- note:edge:0:t@ -->", "paragraph @", "more")),
)
#: Before each block, so that none runs into the next.
BREAK = "***"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): a document for each customer."""
    k = F.col("o_orderkey").cast("string")
    body: Column = F.lit("")
    for m, (_, lines) in enumerate(BLOCKS):
        if lines:
            body = F.when(F.col("o_orderkey") % len(BLOCKS) == m, F.concat(F.lit("\n\n"), F.replace(F.lit("\n".join(lines)), F.lit("@"), k))).otherwise(body)
    blocks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.struct("o_orderkey", F.concat(F.lit(BREAK), body).alias("b")).alias("x"))
    whole = blocks.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n\n").alias("body"))
    return whole.select(F.concat("c", F.lit(".md")).alias("file"), F.concat(F.lit("# Customer "), "c", F.lit("\n\n"), "body").alias("content"))


def nodes(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    found = markdown.parsed(documents(spark, sf_dir)).where(F.col("kind").isin(*kinds))
    edges = F.array_join(F.transform("targets", lambda t: F.concat_ws(":", t["place"], t["target"])), ",")
    return found.select("file", "kind", "branch", "branch_ord", "index", "line", "end_line", "depth", "id", "text", edges.alias("edges"))


def _sql(*kinds: str) -> str:
    """The nodes as the blocks' lines say: a block begins where those before it end, two lines below the break."""
    height = " ".join(f"WHEN {m} THEN {len(lines) + 3 if lines else 2}" for m, (_, lines) in enumerate(BLOCKS))
    said = lambda text: "'" + text.replace("\n", "' || chr(10) || '").replace("@", "' || k || '") + "'"
    made = []
    for m, (kind, lines) in enumerate(BLOCKS):
        if kind == "paragraph":
            made += [(m, "metadata", 0, 0, said("id:l@"), 0), (m, "metadata", 1, 1, said("edge:0:t@"), 0), (m, kind, 2, 3, said("paragraph @\nmore"), 0)]
        elif kind in ("branch", "heading"):
            made.append((m, kind, 0, len(lines) - 1, said({0: "B@", 1: "H@", 2: "Title @"}[m]), {0: 2, 1: 3, 2: 1}[m]))
        elif kind:
            made.append((m, kind, 0, len(lines) - 1, said("\n".join(lines).strip()), 0))
    of = " UNION ALL ".join(f"SELECT c, k, '{kind}' AS kind, s + {a} AS line, s + {b} AS last, {text} AS text, {depth} AS depth, {'true' if kind in markdown.LEAVES else 'false'} AS leaf, {m} AS m FROM p WHERE m = {m}" for m, kind, a, b, text, depth in made)
    return f"""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % {len(BLOCKS)} AS m FROM orders), h AS (SELECT *, CASE m {height} END AS height FROM o),
      p AS (SELECT *, 5 + coalesce(sum(height) OVER (PARTITION BY c ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM h), total AS (SELECT c, sum(height) + 1 AS lines FROM h GROUP BY c),
      n AS ({of} UNION ALL SELECT c, 0, 'heading', 1, 1, 'Customer ' || c, 1, false, -1 FROM total),
      b AS (SELECT *, sum(CASE WHEN kind = 'branch' THEN 1 ELSE 0 END) OVER w AS ord, last_value(CASE WHEN kind = 'branch' THEN text END IGNORE NULLS) OVER w AS own, sum(CASE WHEN leaf THEN 1 ELSE 0 END) OVER w AS place,
        lead(CASE WHEN kind = 'branch' THEN line END) OVER (PARTITION BY c, kind ORDER BY line) AS next FROM n JOIN total USING (c) WINDOW w AS (PARTITION BY c ORDER BY line ROWS UNBOUNDED PRECEDING))
      SELECT c || '.md' AS file, kind, CASE WHEN kind <> 'metadata' THEN own END AS branch, (CASE WHEN kind = 'metadata' THEN -1 ELSE ord - 1 END)::INTEGER AS branch_ord, CASE WHEN leaf THEN place - 1 END::INTEGER AS "index", line::BIGINT AS line,
        (CASE WHEN kind = 'branch' THEN coalesce(next - 1, lines) ELSE last END)::BIGINT AS end_line, depth::INTEGER AS depth, CASE WHEN kind = 'paragraph' THEN 'l' || k END AS id, text, CASE WHEN kind = 'paragraph' THEN '0:t' || k ELSE '' END AS edges
      FROM b WHERE kind IN ({", ".join(f"'{k}'" for k in kinds)})"""


_RANGES = ("code-fence", "entry", "list-item", "blockquote", "table", "indented-code")


@query("markdown_headings", _sql("heading", "branch"))
def markdown_headings(spark, sf_dir):
    return nodes(spark, sf_dir, "heading", "branch")


@query("markdown_ranges", _sql(*_RANGES))
def markdown_ranges(spark, sf_dir):
    return nodes(spark, sf_dir, *_RANGES)


@query("markdown_metadata", _sql("metadata", "paragraph"))
def markdown_metadata(spark, sf_dir):
    return nodes(spark, sf_dir, "metadata", "paragraph")


@query("markdown_placeholders", _sql("placeholder"))
def markdown_placeholders(spark, sf_dir):
    return nodes(spark, sf_dir, "placeholder")


@query("markdown_leaves", f"SELECT coalesce(id, file || ':' || line) AS leaf_id, file, coalesce(branch, '(root)') AS branch, \"index\", kind, text FROM ({_sql('paragraph', *_RANGES)})")
def markdown_leaves(spark, sf_dir):
    return markdown.leaves(documents(spark, sf_dir)).select("leaf_id", "file", "branch", "index", "kind", "text")


# --- trees ----------------------------------------------------------------------------------------------------------

_STATE = "file string, branch string, index int, kind string, text string"
#: Leaves as they are imported: a root for each region, a paragraph for each nation.
_LEAVES = """SELECT 'root-' || r_regionkey || '-' || replace(lower(r_name), ' ', '-') || '.md' AS file, 'Nations' AS branch, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS "index", 'paragraph' AS kind, 'nation ' || n_nationkey || ' ' || n_name AS text,
      n_nationkey AS k, r_regionkey AS r FROM nation JOIN region ON n_regionkey = r_regionkey"""
_FIELDS = 'file, branch, "index", kind, text'


def tree(spark: SparkSession, sf_dir: str) -> Tree:
    """A new tree of the regions and their nations, imported; it lies in the shared folder, and the driver alone works on it."""
    shared = re.sub(r"^file:/+", "/", shared_dir(spark))
    if not shared.startswith("/"):
        raise ValueError("a tree needs a shared folder that is mounted")
    folder = Path(shared) / f"tree-{uuid.uuid4().hex}"
    folder.mkdir(parents=True)
    nations = sorted((r.n_nationkey, r.n_name, r.n_regionkey) for r in table(spark, sf_dir, "nation").collect())
    for r in table(spark, sf_dir, "region").collect():
        own = "\n\n".join(f"nation {k} {name}" for k, name, region in nations if region == r.r_regionkey)
        (folder / f"root-{r.r_regionkey}-{r.r_name.lower().replace(' ', '-')}.md").write_text(f"# {r.r_name}\n\n## Nations\n\n{own}\n\n## Later\n\n_No entries yet._\n")
    made = Tree(folder)
    made.import_()
    return made


def state(spark: SparkSession, of: Tree) -> DataFrame:
    return spark.createDataFrame([(x["file"], x["branch"], x["index"], x["kind"], x["text"]) for x in of.state().leaves.values()], _STATE)


def by_text(of: Tree) -> dict[str, str]:
    return {x["text"]: i for i, x in of.state().leaves.items()}


@query("tree_import", f"SELECT {_FIELDS} FROM ({_LEAVES})")
def tree_import(spark, sf_dir):
    return state(spark, tree(spark, sf_dir))


_APPENDED = f"SELECT {_FIELDS} FROM ({_LEAVES}) UNION ALL SELECT file, 'Later', (max(\"index\") + 1)::INTEGER, 'paragraph', 'added to ' || r FROM ({_LEAVES}) GROUP BY file, r"


@query("tree_append", _APPENDED)
def tree_append(spark, sf_dir):
    own = tree(spark, sf_dir)
    for file in own.roots():
        own.append(file, "Later", f"added to {file.split('-')[1]}")
    return state(spark, own)


@query("tree_reconcile", f"SELECT file, branch, \"index\", kind, CASE WHEN \"index\" = 0 THEN text || ', edited' ELSE text END AS text FROM ({_LEAVES})")
def tree_reconcile(spark, sf_dir):
    own = tree(spark, sf_dir)
    for file, content in own.roots().items():
        (own.folder / file).write_text(re.sub(r"(?m)^(nation .*)$", r"\1, edited", content, count=1))
    if own.reconcile()["status"] != "reconciled":
        raise RuntimeError("edits of live files were not taken over")
    return state(spark, own)


@query("tree_forget", f"SELECT file, branch, (\"index\" - 1)::INTEGER AS \"index\", kind, text FROM ({_LEAVES}) WHERE \"index\" > 0")
def tree_forget(spark, sf_dir):
    own = tree(spark, sf_dir)
    first = {}
    for i, x in own.state().leaves.items():
        if x["index"] == 0:
            first[x["file"]] = i
    for i in first.values():
        restructure.forget(own, i, "no longer wanted")
    return state(spark, own)


@query("tree_move", f"""WITH l AS ({_LEAVES}), f AS (SELECT min(file) AS target FROM l), s AS (SELECT min(file) AS source FROM l WHERE file <> (SELECT target FROM f)),
      m AS (SELECT *, file = (SELECT source FROM s) AND "index" = 0 AS moves FROM l)
      SELECT CASE WHEN moves THEN (SELECT target FROM f) ELSE file END AS file, CASE WHEN moves THEN 'Later' ELSE branch END AS branch, (CASE WHEN moves THEN (SELECT count(*) FROM l WHERE file = (SELECT target FROM f)) WHEN file = (SELECT source FROM s) THEN "index" - 1 ELSE "index" END)::INTEGER AS "index", kind, text FROM m""")  # fmt: skip
def tree_move(spark, sf_dir):
    own = tree(spark, sf_dir)
    target, source = sorted(own.roots())[:2]
    first = next(i for i, x in own.state().leaves.items() if x["file"] == source and x["index"] == 0)
    restructure.move(own, source, target, "Later", [first])
    return state(spark, own)


@query("tree_published", f"SELECT file, sha256(string_agg(text, chr(10) ORDER BY \"index\")) AS hash, count(*) AS leaves FROM ({_APPENDED}) GROUP BY file")
def tree_published(spark, sf_dir):
    """What an export of the newest generation holds, read back as a table and parsed by the executors' parser."""
    own = tree(spark, sf_dir)
    for file in own.roots():
        own.append(file, "Later", f"added to {file.split('-')[1]}")
    folder = own.folder.with_name(f"{own.folder.name}-export")
    own.export(folder)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"])
    return trees.leaves(spark, str(folder)).groupBy("file").agg(F.sha2(F.array_join(texts, "\n"), 256).alias("hash"), F.count("*").alias("leaves"))


@query("tree_log", f"""WITH l AS ({_LEAVES}), r AS (SELECT count(*) AS n FROM region WHERE r_regionkey IN (SELECT r FROM l))
      SELECT 'leaf.upsert' AS type, (SELECT count(*) FROM l) + n AS records, n + 1 AS transactions FROM r UNION ALL SELECT 'view.checkpoint', 2 * n, n + 1 FROM r""")  # fmt: skip
def tree_log(spark, sf_dir):
    """The log's committed operations by type, its chain checked and its commits matched by the executors."""
    own = tree(spark, sf_dir)
    for file in own.roots():
        own.append(file, "Later", f"added to {file.split('-')[1]}")
    done = eventlog.committed_operations(eventlog.read_logs(spark, str(own.log.file)))
    return done.groupBy("type").agg(F.count("*").alias("records"), F.countDistinct("commit_seq").alias("transactions"))


@query("tree_replayed", f"SELECT {_FIELDS} FROM ({_LEAVES})")
def tree_replayed(spark, sf_dir):
    """Live leaves folded from the log by the executors."""
    own = tree(spark, sf_dir)
    live = eventlog.leaves_of(eventlog.committed_operations(eventlog.read_logs(spark, str(own.log.file))))
    leaf = F.from_json("leaf", _STATE)
    return live.select(leaf.alias("x")).select("x.*")


_ROOTS = "SELECT r_regionkey AS r, 'root-' || r_regionkey || '-' || replace(lower(r_name), ' ', '-') || '.md' AS file FROM region"


@query("tree_split", f"""SELECT file, b.branch AS branch, b.ord AS branch_ord FROM ({_ROOTS}), (VALUES ('Nations', 0), ('Nations / North', 1), ('Nations / South', 2), ('Later', 3)) b(branch, ord)""")
def tree_split(spark, sf_dir):
    own = tree(spark, sf_dir)
    for file in own.roots():
        restructure.split_branch(own, file, "nations", ["North", "## South", "North"])
    published = spark.createDataFrame(list(own.published().items()), "file string, content string")
    return markdown.parsed(published).where("kind = 'branch'").select("file", "branch", "branch_ord")


@query("tree_new_root", f"""WITH l AS ({_LEAVES}), n AS (SELECT max(r_regionkey) + 1 AS r FROM region), one AS (SELECT file FROM ({_ROOTS}) WHERE r = 1)
      SELECT CASE WHEN r = 1 THEN 'root-' || (SELECT n.r FROM n) || '-moved-away.md' ELSE file END AS file, branch, ("index" + CASE WHEN r = 1 THEN 1 ELSE 0 END)::INTEGER AS "index", kind, text FROM l
      UNION ALL SELECT 'root-' || n.r || '-moved-away.md', NULL, 0, 'blockquote', '> **Created:** from ' || one.file FROM n, one
      UNION ALL SELECT f.file, 'Later', (SELECT count(*) FROM l WHERE l.r = 0)::INTEGER, 'list-item', '- **Root-' || n.r || '** — `root-' || n.r || '-moved-away.md`' FROM n, ({_ROOTS}) f WHERE f.r = 0""")  # fmt: skip
def tree_new_root(spark, sf_dir):
    own = tree(spark, sf_dir)
    source = next(f for f in own.roots() if f.startswith("root-1-"))
    restructure.new_root(own, " Moved away ", source, ["Nations"])
    return state(spark, own)


def referring(spark: SparkSession, sf_dir: str) -> Tree:
    """Each root has one leaf in its last branch, to which a leaf of the root before it refers."""
    own = tree(spark, sf_dir)
    files = list(own.roots())
    own.append_all((f, "Later", f"added to {f.split('-')[1]}") for f in files)
    own.append_all((f, "Nations", f"see {f.split('-')[1]}, bkz: root-{(int(f.split('-')[1]) + 1) % len(files)} / later") for f in files)
    return own


_EDGES = f"WITH r AS ({_ROOTS}), e AS (SELECT r, (r + 1) % (SELECT count(*) FROM r) AS next FROM r)"


@query("tree_edges", _EDGES + " SELECT 'see ' || r || ', bkz: root-' || next || ' / later' AS source, 'added to ' || next AS target, 'resolved' AS status, 'bkz: root-' || next || ' / later' AS human FROM e")
def tree_edges(spark, sf_dir):
    now = referring(spark, sf_dir).state()
    said = lambda i: now.leaves[i]["text"]
    return spark.createDataFrame([(said(e["sourceId"]), said(e["targetId"]), e["status"], e["human"]) for e in now.edges.values()], "source string, target string, status string, human string")


@query("tree_retargeted", _EDGES + """, f AS (SELECT r FROM r WHERE r = (SELECT max(r) FROM r)) SELECT 'see ' || e.r || ', bkz: root-' || CASE WHEN next = 0 THEN f.r ELSE next END || CASE WHEN next = 0 THEN ' / Nations' ELSE ' / later' END AS text FROM e, f""")
def tree_retargeted(spark, sf_dir):
    """The leaf that the last root refers to moves there; the reference names its new place."""
    own = referring(spark, sf_dir)
    files = sorted(own.roots())
    restructure.move(own, files[0], files[-1], "Nations", ["added to 0"])
    return spark.createDataFrame([(x["text"],) for x in own.state().leaves.values() if x["text"].startswith("see ")], "text string")


@query("tree_provenance", f"SELECT text, CASE WHEN \"index\" = 0 THEN '0.5' END AS confidence FROM ({_LEAVES})")
def tree_provenance(spark, sf_dir):
    """Facts of the first leaf of each root, the second of which takes the place of the first, folded by the executors."""
    own = tree(spark, sf_dir)
    for i, x in own.state().leaves.items():
        if x["index"] == 0:
            own.provenance(i, confidence=0.9, source="a person")
            own.provenance(i, confidence=0.5)
    live = eventlog.leaves_of(eventlog.committed_operations(eventlog.read_logs(spark, str(own.log.file))))
    return live.select(F.get_json_object("leaf", "$.text").alias("text"), F.col("confidence").cast("string").alias("confidence"))


@query("tree_tombstones", f"""WITH l AS ({_LEAVES}) SELECT 'leaf.delete' AS type, 0 AS records WHERE false UNION ALL SELECT 'leaf.forget', count(*) FROM l WHERE "index" = 0 UNION ALL SELECT 'leaf.upsert', 2 * count(*) - count(*) FILTER (WHERE "index" = 0) FROM l
      UNION ALL SELECT 'view.checkpoint', 2 * count(DISTINCT r) FROM l""")  # fmt: skip
def tree_tombstones(spark, sf_dir):
    """The log's operations once the first leaf of each root is forgotten: the others of the root move up."""
    own = tree(spark, sf_dir)
    for i in [i for i, x in own.state().leaves.items() if x["index"] == 0]:
        restructure.forget(own, i)
    done = eventlog.committed_operations(eventlog.read_logs(spark, str(own.log.file)))
    return done.groupBy("type").agg(F.count("*").alias("records"))


@query("tree_log_damaged", "SELECT CASE WHEN line < 10 THEN true ELSE false END AS valid, count(*) AS records FROM (SELECT unnest(range(1, (SELECT count(*) FROM nation) + (SELECT count(DISTINCT n_regionkey) FROM nation) + 2)) AS line) GROUP BY 1")
def tree_log_damaged(spark, sf_dir):
    """One record of the log is changed: those before it hold, it and what follows don't."""
    own = tree(spark, sf_dir)
    lines = own.log.file.read_text().split("\n")
    lines[9] = lines[9].replace("nation ", "notion ", 1)
    own.log.file.write_text("\n".join(lines))
    return eventlog.read_logs(spark, str(own.log.file)).groupBy("valid").agg(F.count("*").alias("records"))


@query("document_links", """SELECT '/orders-by-customer/c' || o_custkey || '/' || o_orderkey || '.md' AS path, '../../orders-by-customer/./c' || o_custkey || '/' || (o_orderkey + 1) || '.md' AS link FROM orders o
      WHERE NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_custkey = o.o_custkey AND n.o_orderkey = o.o_orderkey + 1) UNION ALL SELECT '/orders-by-customer/c' || o_custkey || '/' || o_orderkey || '.md', 'scripts/' || o_orderkey || '.sh' FROM orders""")  # fmt: skip
def document_links(spark, sf_dir):
    """Each order's document refers to the next order of the customer, to itself from the root, to a folder, a site, and a tool that isn't there."""
    o = table(spark, sf_dir, "orders")
    c, k, next_ = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), (F.col("o_orderkey") + 1).cast("string")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    path = said("/orders-by-customer/c", c, "/", k, ".md")
    text = said("[next](../../orders-by-customer/./c", c, "/", next_, '.md "title"), [self](/c', c, "/", k, ".md#top), [all](../c", c, "), [site](https://x/y.md), `scripts/", k, ".sh`")
    docs = o.select(path.alias("path"), text.alias("content"))
    return trees.broken_links(docs, docs.select("path"), "/orders-by-customer")
