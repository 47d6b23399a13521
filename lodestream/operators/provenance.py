"""The provenance model as tables: runs, steps, artifacts, edges, cache; lookups and graph queries.

Tables grow by appending: a state change is a new row, the present state is the
latest row of a key, and of cache entries the first one written counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import types
from ..sources import tables as src
from ..sources.store import settled

DEPTH = 32

# --- states ---


def current(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key; combined before the shuffle, no sort per key."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l")).select(*keys, "_l.*")


def first_written(entries: DataFrame, key: str = "cache_key", value: str = "task_run", at: str = "created_at") -> DataFrame:
    """One value per key: the first one written wins."""
    return entries.groupBy(key).agg(F.min_by(value, F.struct(at, value)).alias(value))


def newest(df: DataFrame, at: str, ident: str, n: int, where: Column | None = None) -> DataFrame:
    """The n latest rows; equal times are ordered by id. The limit is the feature."""
    return (df.where(where) if where is not None else df).orderBy(F.desc(at), F.desc(ident)).limit(n)


def run_status(steps: DataFrame, key: str = "run", status: str = "status") -> DataFrame:
    """(run, status): cancelled if any step was, failed if any failed or is unfinished, else completed."""
    done = F.col(status).isin("COMPLETED", "CACHED", "SKIPPED")
    return steps.groupBy(key).agg(
        F.when(F.bool_or(F.col(status) == "CANCELLED"), "CANCELLED").when(F.bool_or(~done), "FAILED").otherwise("COMPLETED").alias("status"),
        F.count(F.lit(1)).alias("n_steps"),
    )


def first_failure(steps: DataFrame, key: str = "run", *fields: str) -> DataFrame:
    """The earliest failed step of each run; ties by node."""
    f = steps.where("status = 'FAILED'")
    return f.groupBy(key).agg(F.min_by(F.struct("node", *fields), F.struct("created_at", "node")).alias("f")).select(key, "f.*")


def graph_status(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Every planned node with its state; PENDING where there is none."""
    return nodes.join(steps.select("run", "node", "status"), ["run", "node"], "left").withColumn("status", F.coalesce("status", F.lit("PENDING")))


def resume_set(steps: DataFrame, reset: DataFrame | None = None) -> DataFrame:
    """Steps whose results a resumed run keeps: finished ones that aren't reset."""
    kept = steps.where(F.col("status").isin("COMPLETED", "CACHED", "SKIPPED"))
    return kept.join(reset, ["run", "node"], "left_anti") if reset is not None else kept


# --- lookups ---


def hits(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (cache_key, ...) with task_run and whether it was found; the cache side holds one row per key."""
    return wanted.join(first_written(cache), "cache_key", "left").withColumn("hit", F.col("task_run").isNotNull())


def new_content(files: DataFrame, store: DataFrame, content: str = "text") -> DataFrame:
    """(sha256, size, relpath) of contents that the store lacks, each once."""
    h = files.select(F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size")).distinct()
    return h.join(store.select("sha256"), "sha256", "left_anti").withColumn("relpath", F.concat(F.lit("sha256/"), F.left("sha256", F.lit(2)), F.lit("/"), F.col("sha256")))


def producers(artifacts: DataFrame, outputs: DataFrame) -> DataFrame:
    """artifacts with the step that made them; NULL for those brought in from outside."""
    return artifacts.join(outputs, "artifact", "left")


def bind_inputs(ports: DataFrame, outputs: DataFrame) -> DataFrame:
    """(step, port, source, artifact, required): what each port reads; a required one without a source is reported as missing."""
    return ports.join(outputs.withColumnRenamed("step", "source"), "source", "left").withColumn("missing", F.col("required") & F.col("artifact").isNull())


def collect_members(outputs: DataFrame, key: str = "base") -> DataFrame:
    """(base, members): outputs of expanded steps by index, up to the first gap; the order is part of the result."""
    w = W.partitionBy(key).orderBy("i")
    run = outputs.withColumn("_r", F.row_number().over(w) - 1).where("_r = i")
    return run.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "artifact"))), lambda x: x["artifact"]).alias("members"))


def files_map(files: DataFrame, key: str = "artifact_id") -> DataFrame:
    return files.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "relpath")))).alias("files"))


def absent(declared: DataFrame, reported: DataFrame, on: list[str]) -> DataFrame:
    """Declared rows nothing was reported for (missing validators); the other way round, unknown names."""
    return declared.join(reported, on, "left_anti")


def failed_list(verdicts: DataFrame, key: str = "step") -> DataFrame:
    """(step, failed): names of verdicts that didn't pass, in order."""
    return verdicts.where(~F.col("passed")).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("failed"))


def select_provider(steps: DataFrame, defaults: DataFrame, providers: DataFrame) -> DataFrame:
    """The step's own choice, else the project's, else the task's default, else its first."""
    p = providers.groupBy("task").agg(F.min_by("provider", F.struct(F.when(F.col("is_default"), 0).otherwise(1), "rank")).alias("_p"))
    return steps.join(defaults, "task", "left").join(p, "task", "left").withColumn("selected", F.coalesce("provider", "project_provider", "_p")).drop("_p")


def conforming(rows: DataFrame, have: str, want: str) -> DataFrame:
    """rows with ok: the type they have is a subtype of the type wanted. The closure is a small fixed table; unknown types fit only themselves."""
    c = F.broadcast(types.closure(rows.sparkSession).select(F.col("have").alias("_h"), F.col("want").alias("_w"), F.lit(True).alias("_in")))
    met = rows.join(c, (F.col(have) == F.col("_h")) & (F.col(want) == F.col("_w")), "left")
    return met.withColumn("ok", (F.col(have) == F.col(want)) | F.coalesce("_in", F.lit(False))).drop("_h", "_w", "_in")


def overlay(layers: DataFrame) -> DataFrame:
    """(name, version, ...) of layered registries: the layer of the highest precedence wins."""
    rest = [c for c in layers.columns if c not in ("name", "version", "precedence")]
    return layers.groupBy("name", "version").agg(F.max_by(F.struct(*rest), "precedence").alias("_s")).select("name", "version", "_s.*")


def latest_version(specs: DataFrame) -> DataFrame:
    """The highest version of each name, by numbers."""
    return specs.groupBy("name").agg(F.max_by("version", F.transform(F.split("version", "\\."), lambda x: x.cast("int"))).alias("version"))


def prefix_unique(steps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(prefix, node, outcome): found, not_found or ambiguous. wanted is a handful of prefixes of one length each."""
    n = F.length("prefix")
    lengths = [r[0] for r in wanted.select(n).distinct().collect()]
    keyed = steps.select("node").distinct().withColumn("prefix", F.explode(F.array_distinct(F.array(*[F.left("node", F.lit(k)) for k in lengths]))))
    found = keyed.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    out = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return wanted.join(found, "prefix", "left").withColumn("outcome", out).withColumn("node", F.when(F.col("outcome") == "found", F.col("node"))).drop("n")


def text_search(catalog: DataFrame, query: str, *columns: str, tags: str | None = None) -> DataFrame:
    """Rows with the query, in any case, in any of the columns or tags."""
    q = F.lit(query.lower())
    tests = [F.contains(F.lower(F.col(c)), q) for c in columns]
    if tags:
        tests.append(F.exists(tags, lambda t: F.contains(F.lower(t), q)))
    return catalog.where(reduce(lambda a, b: a | b, tests))


# --- graphs: edges (child, parent) ---


def lineage(edges: DataFrame, start: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node, ancestor, depth) upstream of start (node), the start itself at depth 0; cut below `depth`.

    Level by level, each level distinct and settled, so a node that is reached
    by several ways is followed once; ends with the first empty level.
    """
    return _walk(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")), start, depth)


def downstream(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, reached) of everything that depends on start, itself included, however far."""
    walked = _walk(edges.select(F.col("parent").alias("a"), F.col("child").alias("b")), start, None)
    return walked.select("node", F.col("ancestor").alias("reached"))


def _walk(steps: DataFrame, start: DataFrame, depth: int | None) -> DataFrame:
    """(node, ancestor, least depth); a cycle ends where it has been."""
    steps = steps.distinct()
    level = settled(start.select("node", F.col("node").alias("ancestor")).distinct().withColumn("depth", F.lit(0)))
    seen, k = level, 0
    while depth is None or k < depth:
        k += 1
        new = level.join(steps, level.ancestor == steps.a).select("node", F.col("b").alias("ancestor")).distinct()
        level = settled(new.join(seen.select("node", "ancestor"), ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(k)))
        if level.isEmpty():
            break
        seen = seen.union(level) if k % 16 else settled(seen.union(level))
    return seen


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node) of start and everything below any of it: a set, not pairs."""
    level = settled(start.select("node").distinct())
    seen, k = level, 0
    while not level.isEmpty():
        k += 1
        new = edges.join(level, edges.parent == level.node).select(F.col("child").alias("node")).distinct()
        level = settled(new.join(seen, "node", "left_anti"))
        seen = seen.union(level) if k % 16 else settled(seen.union(level))
    return seen


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): longest path from a node without parents; the order in which steps can run. A cycle is an error.

    Nodes without parents are taken away, level by level, with their edges.
    """
    left = settled(edges.select("child", "parent").distinct())
    out = left.select(F.col("parent").alias("node")).distinct().join(left.select(F.col("child").alias("node")), "node", "left_anti").withColumn("level", F.lit(0))
    taken, k = None, 0
    while not left.isEmpty():
        free = left.select("parent").distinct().join(left.select(F.col("child").alias("parent")), "parent", "left_anti")
        gone = settled(left.join(free, "parent", "left_semi").select(F.col("child").alias("node")).distinct().withColumn("level", F.lit(k + 1)))
        if gone.isEmpty():
            raise ValueError("the edges hold a cycle")
        left = settled(left.join(free, "parent", "left_anti"))
        taken, k = gone if taken is None else taken.union(gone) if k % 16 else settled(taken.union(gone)), k + 1
    return settled(out if taken is None else out.union(taken.groupBy("node").agg(F.max("level").alias("level"))))


def propagate(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, status): a step below a skipped one is skipped, else below a failed one failed; skipped beats failed."""
    below = [reached(edges, steps.where(F.col("status") == c).select("node")).withColumn("cause", F.lit(c)) for c in ("SKIPPED", "FAILED")]
    worst = below[0].union(below[1]).groupBy("node").agg(F.max("cause").alias("cause"))  # SKIPPED > FAILED
    return steps.join(worst, "node", "left").select("node", F.coalesce("cause", "status").alias("status"))


# --- the engine's tables out of the plain ones ---


def runs(s, d):
    o = src.read(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED").alias("status"), F.col("o_orderdate").alias("created_at"))


def steps(s, d):
    status = F.when(F.col("l_returnflag") == "R", "FAILED").when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "CACHED").when(F.col("l_linestatus") == "O", "COMPLETED").otherwise("SKIPPED")
    l = src.read(s, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("node"), status.alias("status"), F.col("l_shipdate").alias("created_at"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    return current(l, ["run", "node"], ["created_at", "part", "supp"])


STEPS_SQL = """steps AS (SELECT run, node, status, created_at, part, supp FROM (SELECT l_orderkey AS run, 's' || l_linenumber AS node, CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'CACHED' WHEN l_linestatus = 'O' THEN 'COMPLETED' ELSE 'SKIPPED' END AS status, l_shipdate AS created_at, l_partkey AS part, l_suppkey AS supp,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1)"""


def edges(s, d):
    r = lambda t: src.read(s, d, t)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        r("nation").select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent"))
        .union(r("customer").select(key("c", "c_custkey"), key("n", "c_nationkey")))
        .union(r("orders").select(key("o", "o_orderkey"), key("c", "o_custkey")))
    )


EDGES_SQL = "edges AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"


def tasks(s, d):
    return src.read(s, d, "part").select(F.col("p_brand").alias("name"), F.concat((F.col("p_size") % 3).cast("string"), F.lit("."), F.col("p_size").cast("string"), F.lit(".0")).alias("version"), F.col("p_partkey").alias("precedence"), "p_name", "p_type")


def typed(s, d):
    names = types.all_types()
    arr = F.array(*[F.lit(n) for n in names])
    p = src.read(s, d, "part")
    return p.select("p_partkey", F.element_at(arr, F.col("p_size") % len(names) + 1).alias("have"), F.element_at(arr, F.expr("cast(p_partkey % 29 as int)") + 1).alias("want"))


_TYPES = "[" + ", ".join(f"'{n}'" for n in types.all_types()) + "]"
_TYPED_SQL = f"typed AS (SELECT p_partkey, {_TYPES}[p_size % 29 + 1] AS have, {_TYPES}[p_partkey % 29 + 1] AS want FROM part)"


def cache(s, d):
    return src.read(s, d, "lineitem").select(F.sha2(F.col("l_partkey").cast("string"), 256).alias("cache_key"), F.col("l_orderkey").alias("task_run"), F.col("l_shipdate").alias("created_at"))


QUERIES = {
    "latest_runs": lambda s, d: newest(runs(s, d), "created_at", "run", 20).select("run", "status"),
    "latest_by_type": lambda s, d: newest(src.read(s, d, "documents"), "n_chars", "doc_id", 15, F.col("lang") == "fr").select("doc_id", "lang", "n_chars"),
    "steps_in_order": lambda s, d: steps(s, d).select("run", "node", F.row_number().over(W.partitionBy("run").orderBy("created_at", "node")).alias("place")),
    "run_status": lambda s, d: run_status(steps(s, d)),
    "first_failure": lambda s, d: first_failure(steps(s, d), "run", "part").select("run", "node", "part"),
    "graph_status": lambda s, d: graph_status(runs(s, d).select("run", F.explode(F.array(*[F.lit(f"s{k}") for k in range(1, 6)])).alias("node")), steps(s, d)).groupBy("node", "status").agg(F.count(F.lit(1)).alias("n")),
    "resume_set": lambda s, d: resume_set(steps(s, d), steps(s, d).where("node = 's1'").select("run", "node")).groupBy("node", "status").agg(F.count(F.lit(1)).alias("n")),
    "cache_hit_miss": lambda s, d: hits(src.read(s, d, "part").select("p_partkey", F.sha2((F.col("p_partkey") * 2).cast("string"), 256).alias("cache_key")), cache(s, d)).select("p_partkey", "task_run", "hit"),
    "cas_dedup": lambda s, d: new_content(src.read(s, d, "documents"), src.read(s, d, "documents").where("lang = 'de'").select(F.sha2("text", 256).alias("sha256"))),
    "store_stats": lambda s, d: first_written(cache(s, d)).agg(F.count(F.lit(1)).alias("entries")).crossJoin(src.read(s, d, "documents").agg(F.count(F.lit(1)).alias("artifacts"))),
    "producer_of": lambda s, d: producers(src.read(s, d, "customer").select(F.col("c_custkey").alias("artifact")), src.read(s, d, "orders").groupBy(F.col("o_custkey").alias("artifact")).agg(F.min("o_orderkey").alias("producer"))),
    "edges_of": lambda s, d: edges(s, d).groupBy("parent").agg(F.count(F.lit(1)).alias("n_inputs")),
    "consumers": lambda s, d: edges(s, d).join(src.read(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("parent")), "parent", "left_semi").groupBy("parent").agg(F.min("child").alias("first"), F.count(F.lit(1)).alias("n")),
    "graph_edges": lambda s, d: src.read(s, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("deps")).select(F.col("o_custkey").alias("to"), F.explode("deps").alias("from")),
    "bind_inputs": lambda s, d: bind_inputs(src.read(s, d, "nation").select(F.col("n_nationkey").alias("step"), F.lit("in").alias("port"), (F.col("n_nationkey") * 7).cast("bigint").alias("source"), (F.col("n_nationkey") % 2 == 0).alias("required")), src.read(s, d, "supplier").select(F.col("s_suppkey").alias("step"), F.col("s_name").alias("artifact"))).select("step", "port", "artifact", "missing"),
    "collect_ordered": lambda s, d: collect_members(src.read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("base"), (F.col("l_linenumber") - 1).alias("i")).agg(F.max("l_partkey").alias("artifact"))).select("base", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members")),
    "files_map": lambda s, d: files_map(src.read(s, d, "supplier").select(F.col("s_nationkey").alias("artifact_id"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("relpath"))).select("artifact_id", F.to_json("files").alias("files")),
    "missing_validators": lambda s, d: absent(src.read(s, d, "customer").select("c_nationkey", "c_mktsegment").distinct(), src.read(s, d, "customer").where("c_acctbal > 9000").select("c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"]),
    "unknown_names": lambda s, d: absent(src.read(s, d, "orders").select(F.col("o_custkey").alias("name")).distinct(), src.read(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("name")), ["name"]),
    "failed_validators": lambda s, d: failed_list(src.read(s, d, "customer").select(F.col("c_nationkey").alias("step"), F.col("c_mktsegment").alias("name"), (F.col("c_acctbal") > 0).alias("passed"))),
    "typecheck_outputs": lambda s, d: conforming(typed(s, d), "have", "want"),
    "compatible_ports": lambda s, d: conforming(typed(s, d), "have", "want").where("ok").groupBy("have").agg(F.countDistinct("want").alias("n_ports")),
    "select_provider": lambda s, d: select_provider(src.read(s, d, "part").select("p_partkey", F.col("p_brand").alias("task"), F.when(F.col("p_size") % 4 == 0, F.col("p_type")).alias("provider")), src.read(s, d, "part").where("p_size % 2 = 0").groupBy(F.col("p_brand").alias("task")).agg(F.when(F.min("p_partkey") % 2 == 0, F.min("p_type")).alias("project_provider")), src.read(s, d, "part").select(F.col("p_brand").alias("task"), F.col("p_name").alias("provider"), F.col("p_partkey").alias("rank"), (F.col("p_size") == 7).alias("is_default"))).select("p_partkey", "selected"),
    "provider_names": lambda s, d: src.read(s, d, "part").select(F.col("p_brand").alias("name")).union(src.read(s, d, "supplier").select("s_name")).distinct(),
    "registry_overlay": lambda s, d: overlay(tasks(s, d)).select("name", "version", "p_name"),
    "latest_version": lambda s, d: latest_version(tasks(s, d)),
    "filter_category": lambda s, d: tasks(s, d).where(F.col("p_type") == "ECONOMY").select("name", "version", "precedence"),
    "text_search": lambda s, d: text_search(tasks(s, d).withColumn("tags", F.split("p_name", " ")), "RED", "name", "p_type", tags="tags").select("precedence"),
    "prefix_unique": lambda s, d: prefix_unique(src.read(s, d, "nation").select(F.col("n_name").alias("node")), src.read(s, d, "nation").select(F.left("n_name", F.lit(8)).alias("prefix")).union(src.read(s, d, "region").select(F.left("r_name", F.lit(2)))).distinct()),
    "sum_product": lambda s, d: src.read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("component")).agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 4).alias("total"), F.max("l_linenumber").alias("longest")),
    "lineage_up": lambda s, d: lineage(edges(s, d), src.read(s, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))).select("node", "ancestor", F.col("depth").cast("int").alias("depth")),
    "downstream": lambda s, d: downstream(edges(s, d), src.read(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))),
    "topo_levels": lambda s, d: levels(edges(s, d)).select("node", F.col("level").cast("int").alias("level")),
    "status_propagate": lambda s, d: propagate(edges(s, d).select(F.col("child").alias("node")).union(src.read(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")))).withColumn("status", F.when(F.col("node") == "r1", "SKIPPED").when(F.col("node").isin("n3", "c7", "r2", "n1"), "FAILED").otherwise("COMPLETED")), edges(s, d)),
    "foreach_members": lambda s, d: src.read(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("items")).select(F.col("n_regionkey").alias("step"), F.posexplode("items").alias("i", "item")).select("step", F.concat(F.lit("run__"), F.col("i").cast("string")).alias("node"), "item"),
}
ORACLES = {
    "latest_runs": "SELECT o_orderkey AS run, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20",
    "latest_by_type": "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'fr' ORDER BY n_chars DESC, doc_id DESC LIMIT 15",
    "steps_in_order": f"WITH {STEPS_SQL} SELECT run, node, cast(row_number() OVER (PARTITION BY run ORDER BY created_at, node) AS INTEGER) AS place FROM steps",
    "run_status": f"WITH {STEPS_SQL} SELECT run, CASE WHEN bool_or(status = 'CANCELLED') THEN 'CANCELLED' WHEN bool_or(status NOT IN ('COMPLETED', 'CACHED', 'SKIPPED')) THEN 'FAILED' ELSE 'COMPLETED' END AS status, count(*) AS n_steps FROM steps GROUP BY run",
    "first_failure": f"WITH {STEPS_SQL} SELECT run, node, part FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY created_at, node) AS k FROM steps WHERE status = 'FAILED') WHERE k = 1",
    "graph_status": f"WITH {STEPS_SQL}, n AS (SELECT o_orderkey AS run, 's' || k AS node FROM orders, (SELECT unnest(range(1, 6)) AS k)) SELECT node, coalesce(status, 'PENDING') AS status, count(*) AS n FROM n LEFT JOIN steps USING (run, node) GROUP BY 1, 2",
    "resume_set": f"WITH {STEPS_SQL} SELECT node, status, count(*) AS n FROM steps WHERE status IN ('COMPLETED', 'CACHED', 'SKIPPED') AND node <> 's1' GROUP BY ALL",
    "cache_hit_miss": "WITH c AS (SELECT l_partkey, arg_min(l_orderkey, (l_shipdate, l_orderkey)) AS task_run FROM lineitem GROUP BY 1) SELECT p_partkey, task_run, task_run IS NOT NULL AS hit FROM part LEFT JOIN c ON l_partkey = p_partkey * 2",
    "cas_dedup": "SELECT DISTINCT sha256(text) AS sha256, strlen(text) AS size, 'sha256/' || left(sha256(text), 2) || '/' || sha256(text) AS relpath FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'de')",
    "store_stats": "SELECT (SELECT count(DISTINCT l_partkey) FROM lineitem) AS entries, (SELECT count(*) FROM documents) AS artifacts",
    "producer_of": "SELECT c_custkey AS artifact, min(o_orderkey) AS producer FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "edges_of": f"WITH {EDGES_SQL} SELECT parent, count(*) AS n_inputs FROM edges GROUP BY parent",
    "consumers": f"WITH {EDGES_SQL} SELECT parent, min(child) AS first, count(*) AS n FROM edges WHERE parent LIKE 'n%' GROUP BY parent",
    "graph_edges": "SELECT DISTINCT o_custkey AS \"to\", o_orderpriority AS \"from\" FROM orders",
    "bind_inputs": "SELECT n_nationkey AS step, 'in' AS port, s_name AS artifact, n_nationkey % 2 = 0 AND s_name IS NULL AS missing FROM nation LEFT JOIN supplier ON s_suppkey = n_nationkey * 7",
    "collect_ordered": "WITH m AS (SELECT l_orderkey AS base, l_linenumber - 1 AS i, max(l_partkey) AS artifact FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY i) - 1 AS r FROM m) SELECT base, string_agg(artifact::VARCHAR, ',' ORDER BY i) AS members FROM k WHERE r = i GROUP BY base",
    "files_map": """SELECT s_nationkey AS artifact_id, '{' || string_agg('"' || s_name || '":"' || s_suppkey || '"', ',' ORDER BY s_name) || '}' AS files FROM supplier GROUP BY 1""",
    "missing_validators": "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000",
    "unknown_names": "SELECT DISTINCT o_custkey AS name FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)",
    "failed_validators": "SELECT c_nationkey AS step, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS failed FROM customer WHERE NOT c_acctbal > 0 GROUP BY 1",
    "typecheck_outputs": f"WITH RECURSIVE {types.CLOSURE_SQL.removeprefix('WITH RECURSIVE ').split('SELECT have, want, depth FROM up')[0]}, {_TYPED_SQL} SELECT p_partkey, have, want, have = want OR EXISTS (SELECT 1 FROM up WHERE up.have = typed.have AND up.want = typed.want) AS ok FROM typed",
    "compatible_ports": f"WITH RECURSIVE {types.CLOSURE_SQL.removeprefix('WITH RECURSIVE ').split('SELECT have, want, depth FROM up')[0]}, {_TYPED_SQL} SELECT have, count(DISTINCT want) AS n_ports FROM typed WHERE have = want OR EXISTS (SELECT 1 FROM up WHERE up.have = typed.have AND up.want = typed.want) GROUP BY have",
    "select_provider": "WITH a AS (SELECT p_brand AS task, CASE WHEN min(p_partkey) % 2 = 0 THEN min(p_type) END AS pp FROM part WHERE p_size % 2 = 0 GROUP BY 1), b AS (SELECT p_brand AS task, arg_min(p_name, (CASE WHEN p_size = 7 THEN 0 ELSE 1 END, p_partkey)) AS dp FROM part GROUP BY 1) SELECT p_partkey, coalesce(CASE WHEN p_size % 4 = 0 THEN p_type END, pp, dp) AS selected FROM part LEFT JOIN a ON a.task = p_brand LEFT JOIN b ON b.task = p_brand",
    "provider_names": "SELECT p_brand AS name FROM part UNION SELECT s_name FROM supplier",
    "registry_overlay": "SELECT p_brand AS name, (p_size % 3) || '.' || p_size || '.0' AS version, arg_max(p_name, p_partkey) AS p_name FROM part GROUP BY 1, 2",
    "latest_version": "SELECT p_brand AS name, arg_max((p_size % 3) || '.' || p_size || '.0', (p_size % 3, p_size)) AS version FROM part GROUP BY 1",
    "filter_category": "SELECT p_brand AS name, (p_size % 3) || '.' || p_size || '.0' AS version, p_partkey AS precedence FROM part WHERE p_type = 'ECONOMY'",
    "text_search": "SELECT p_partkey AS precedence FROM part WHERE contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red') OR contains(lower(p_name), 'red')",
    "prefix_unique": "WITH w AS (SELECT left(n_name, 8) AS prefix FROM nation UNION SELECT left(r_name, 2) FROM region), f AS (SELECT prefix, count(n_name) AS n, min(n_name) AS node FROM w LEFT JOIN (SELECT DISTINCT n_name FROM nation) ON left(n_name, length(prefix)) = prefix GROUP BY prefix) SELECT prefix, CASE WHEN n = 1 THEN node END AS node, CASE WHEN n = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS outcome FROM f",
    "sum_product": "SELECT l_suppkey AS component, round(sum(l_quantity * l_discount), 4) AS total, max(l_linenumber) AS longest FROM lineitem GROUP BY 1",
    "lineage_up": f"WITH RECURSIVE {EDGES_SQL}, w(node, ancestor, depth) AS (SELECT 'o' || o_orderkey, 'o' || o_orderkey, 0 FROM orders UNION ALL SELECT w.node, e.parent, depth + 1 FROM w JOIN edges e ON e.child = ancestor WHERE depth < 32) SELECT node, ancestor, min(depth) AS depth FROM w GROUP BY ALL",
    "downstream": f"WITH RECURSIVE {EDGES_SQL}, w(node, reached) AS (SELECT 'n' || n_nationkey, 'n' || n_nationkey FROM nation UNION SELECT w.node, e.child FROM w JOIN edges e ON e.parent = reached) SELECT * FROM w",
    "topo_levels": f"WITH RECURSIVE {EDGES_SQL}, r(node, level) AS (SELECT DISTINCT parent, 0 FROM edges WHERE parent NOT IN (SELECT child FROM edges) UNION ALL SELECT e.child, level + 1 FROM r JOIN edges e ON e.parent = r.node) SELECT node, max(level) AS level FROM r GROUP BY node",
    "status_propagate": f"""WITH RECURSIVE {EDGES_SQL}, s AS (SELECT node, CASE WHEN node = 'r1' THEN 'SKIPPED' WHEN node IN ('n3', 'c7', 'r2', 'n1') THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM (SELECT child AS node FROM edges UNION ALL SELECT 'r' || r_regionkey FROM region)),
        w(node, cause) AS (SELECT node, status FROM s WHERE status <> 'COMPLETED' UNION SELECT e.child, cause FROM w JOIN edges e ON e.parent = w.node) SELECT s.node, coalesce((SELECT max(cause) FROM w WHERE w.node = s.node), status) AS status FROM s""",
    "foreach_members": "SELECT n_regionkey AS step, 'run__' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1) AS node, n_name AS item FROM nation",
}
