"""Scalar functions of the engine, as Column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import tables as src
from . import types, units

# --- canonical JSON and content addresses ---


def canonical(value) -> str:
    """JSON text with sorted keys, no spaces, and whole floats under 9e15 written as integers."""

    def norm(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 9e15:
            return int(v)
        if isinstance(v, dict):
            return {k: norm(x) for k, x in v.items()}
        return [norm(x) for x in v] if isinstance(v, list | tuple) else v

    return json.dumps(norm(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(text: Column) -> Column:
    """Canonical form of JSON text whose numbers are plain decimals."""
    return F.to_json(F.parse_json(text))


def content_hash(kind: Column, version: Column, files: Column) -> Column:
    """sha256 of the canonical document of an artifact's type, schema version and {name: sha256} files; data and metadata don't count."""
    ordered = F.array_sort(F.map_entries(files))
    body = F.array_join(F.transform(ordered, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":"'), e["value"], F.lit('"'))), ",")
    return F.sha2(F.concat(F.lit('{"files":{'), body, F.lit('},"schema_version":"'), version, F.lit('","type":"'), kind, F.lit('"}')), 256)


def cache_key(task: Column, provider: Column, inputs: Column, parameters: Column, config: Column) -> Column:
    """Identity of a step's work: task, provider, ordered input hashes, canonical parameters and engine configuration."""
    return F.sha2(F.to_json(F.struct(config.alias("config"), inputs.alias("inputs"), parameters.alias("parameters"), provider.alias("provider"), task.alias("task"))), 256)


def short_hash(h: Column, n: int = 8) -> Column:
    return F.left(h, F.lit(n))


# --- names and ids ---

LABEL = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"
IDS = {"art": "artifact", "tr": "task_run", "wr": "workflow_run"}


def label_valid(c: Column) -> Column:
    return c.rlike(LABEL)


def id_kind(c: Column) -> Column:
    """What an id names; NULL if it is none."""
    out = F.lit(None).cast("string")
    for prefix, kind in IDS.items():
        out = F.when(c.rlike(f"^{prefix}_[0-9a-f]{{8}}$"), kind).otherwise(out)
    return out


def sanitize(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def split_ref(c: Column) -> list[Column]:
    """name and version of name@version; version NULL if there is none."""
    return [F.regexp_extract(c, r"^([^@]*)", 1).alias("name"), F.when(c.contains("@"), F.regexp_extract(c, r"^[^@]*@(.*)$", 1)).alias("version")]


def run_dir(label: Column, name: Column, ident: Column, created: Column) -> Column:
    stamp = F.date_format(created, "yyyy-MM-dd_HH-mm")
    return F.concat(sanitize(F.coalesce(label, name)), F.lit("/"), stamp, F.lit("_"), sanitize(name), F.lit("_"), ident)


def timestamp_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


#: What a file's text begins with, or holds anywhere, and its extension; the first that fits counts.
BEGINS = (("LAMMPS Description", "data"), ("{", "json"), ("[", "json"), ("set type", "inc"), ("units", "lmp"))
HOLDS = (("pair_coeff", "lmp"),)


def content_extension(head: Column) -> Column:
    """Extension by content; NULL where nothing is certain."""
    text = F.ltrim(head)
    return F.coalesce(*[F.when(text.startswith(x), F.lit(ext)) for x, ext in BEGINS], *[F.when(text.contains(x), F.lit(ext)) for x, ext in HOLDS])


#: Extensions of known file roles.
ROLE_EXT = {"charges": "inc", "init": "lmp", "settings": "lmp", "log": "lammps", "dcd": "dcd", "csv": "csv", "restart": "restart", "spec": "yaml"}


def friendly_names(files: DataFrame, key: str = "artifact_id") -> DataFrame:
    """(key, role, head) -> the same with name: a leaf with an extension is kept, else role and content name it; later roles that collide carry their role."""
    leaf = F.element_at(F.split("role", "/"), -1)
    real = leaf.contains(".") & ~leaf.startswith(".")
    ext = F.coalesce(*[F.when(leaf == k, F.lit(v)) for k, v in ROLE_EXT.items()], content_extension(F.col("head")), F.when(leaf.isin("data", "topology"), F.lit("data")), F.lit("dat"))
    name = F.when(real, sanitize(leaf)).otherwise(F.concat(sanitize(F.when(leaf == "data", F.lit("system")).otherwise(leaf)), F.lit("."), ext))
    w = W.partitionBy(key, "name").orderBy("role")
    turn = F.row_number().over(w)
    stem, suffix = F.regexp_extract("name", r"^(.*)\.([^.]*)$", 1), F.regexp_extract("name", r"^(.*)\.([^.]*)$", 2)
    alt = F.concat(stem, F.lit("__"), sanitize(F.col("role")), F.lit("."), suffix)
    return files.withColumn("name", name).withColumn("_turn", turn).withColumn("name", F.when(F.col("_turn") == 1, F.col("name")).otherwise(alt)).drop("_turn")


# --- resources and failures ---


def memory_spec(c: Column) -> Column:
    """8GB -> 8G, bare numbers are mebibytes, empty is 1G."""
    t = F.trim(c)
    suffix = F.upper(F.trim(F.regexp_extract(t, r"^\d*(.*)$", 1)))
    unit = F.when(suffix == "", F.lit("M")).otherwise(F.regexp_replace(suffix, "B+$", ""))
    return F.when(t == "", F.lit("1G")).otherwise(F.concat(F.regexp_extract(t, r"^(\d*)", 1), unit))


#: Minutes per unit of a duration.
MINUTES = {1 / 60: ("s", "sec", "secs", "second", "seconds"), 1.0: ("m", "min", "mins", "minute", "minutes"), 60.0: ("h", "hr", "hrs", "hour", "hours"), 1440.0: ("d", "day", "days"), 10080.0: ("w", "week", "weeks")}


def walltime(c: Column) -> Column:
    """Scheduler forms pass through; durations become whole minutes, rounded up, at least 1; NULL for anything else."""
    t = F.trim(c)
    number = F.regexp_extract(t, r"^([0-9.]+)\s*([A-Za-z]*)$", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(t, r"^([0-9.]+)\s*([A-Za-z]*)$", 2))
    factor = F.coalesce(*[F.when(unit.isin(*names), F.lit(f)) for f, names in MINUTES.items()])
    whole = F.ceil(F.round(number * factor, 9))
    minutes = F.when(whole.isNotNull(), F.greatest(F.lit(1), whole)).cast("string")
    return F.when(F.lower(t).isin("unlimited", "infinite"), F.lit("INFINITE")).when(t.rlike(r"^\d+([:-]\d+)*$"), t).otherwise(minutes)


def state_parse(c: Column) -> Column:
    """The first state word of accounting output, in capitals."""
    line = F.regexp_extract(c, r"(?m)^[ \t]*(\S[^\n]*)$", 1)
    word = F.regexp_extract(F.trim(F.split(line, r"\|")[0]), r"^([^.\s]+)", 1)
    return F.when(word != "", F.upper(word))


#: Terminal accounting states, as (type, category, recoverable).
STATES = {
    "TIMEOUT": ("slurm_timeout", "resource_error", True),
    "OUT_OF_MEMORY": ("slurm_out_of_memory", "resource_error", True),
    "NODE_FAIL": ("slurm_node_failure", "environment_error", True),
    "BOOT_FAIL": ("slurm_node_failure", "environment_error", True),
    "PREEMPTED": ("slurm_preempted", "environment_error", True),
    "REVOKED": ("slurm_preempted", "environment_error", True),
    "CANCELLED": ("slurm_cancelled", "environment_error", False),
}
OTHER_STATE = ("slurm_job_failed", "execution_error", False)
NO_STATE = ("slurm_job_lost", "resource_error", True)


def state_taxonomy(state: Column) -> Column:
    """struct(type, category, recoverable) of a terminal state; NULL means accounting has no record."""
    s = lambda x: F.struct(F.lit(x[0]).alias("type"), F.lit(x[1]).alias("category"), F.lit(x[2]).alias("recoverable"))
    out = F.when(state.isNull(), s(NO_STATE))
    for k, v in STATES.items():
        out = out.when(state == k, s(v))
    return out.otherwise(s(OTHER_STATE))


#: Words of a refused submission that make it permanent.
PERMANENT = ("invalid partition", "invalid qos", "invalid account", "invalid gres", "invalid feature", "unrecognized")


def submit_class(c: Column) -> Column:
    return F.when(F.lower(c).rlike("|".join(PERMANENT)), "environment_error").otherwise("resource_error")


#: Category of each error kind; those after `recoverable` may succeed when run again.
CATEGORIES = {
    "schema": "input_error",
    "type": "input_error",
    "workflow": "protocol_error",
    "task": "task_error",
    "provider": "provider_error",
    "execution": "execution_error",
    "scientific_validation": "scientific_validation",
    "artifact_compatibility": "compatibility_error",
    "not_found": "not_found",
    "io": "environment_error",
    "internal": "internal",
}
RECOVERABLE = ("provider", "execution", "io")


def error_category(kind: Column) -> list[Column]:
    pairs = [x for k, v in CATEGORIES.items() for x in (F.lit(k), F.lit(v))]
    return [F.try_element_at(F.create_map(*pairs), kind).alias("category"), kind.isin(*RECOVERABLE).alias("recoverable")]


def should_retry(max_attempts: Column, attempts: Column, on: Column, category: Column, recoverable: Column) -> Column:
    """A listed category is retried whatever its recoverable flag says; without a list, what is recoverable."""
    return (max_attempts > attempts) & (((F.size(on) == 0) & recoverable) | F.array_contains(on, category))


def next_action(status: Column, step: Column, recoverable: Column) -> Column:
    return (
        F.when((status == "FAILED") & step.isNotNull() & recoverable, F.concat(F.lit("retry "), step))
        .when((status == "FAILED") & step.isNotNull(), F.concat(F.lit("logs "), step))
        .when(status == "CANCELLED", F.lit("resume"))
    )


# --- small ones ---


def steps(duration: Column, dt: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(duration / dt)).cast("bigint")


def expand_sequence(first: Column, middle: Column, last: Column, n: Column) -> Column:
    """first, n - 2 times middle, last (first again where there is none)."""
    return F.concat(F.array(first), F.array_repeat(middle, F.greatest(F.lit(0), n - 2)), F.array(F.coalesce(last, first)))


def node_label(task: Column, *values: Column) -> Column:
    return F.concat_ws(" ", task, *values)


def exactly_one(a: Column, b: Column) -> Column:
    return a.isNull() != b.isNull()


REF = r"\$\{([^}]*)\}"


def references(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(REF), F.lit(1))


def json_walk(data: Column, metadata: Column, path: str) -> Column:
    """A field looked up in data first, then in metadata."""
    get = lambda c: F.try_variant_get(F.try_parse_json(c), f"$.{path}", "string")
    return F.coalesce(get(data), get(metadata))


def tbl(s, d, n):
    return src.read(s, d, n)


def hexid(c):
    return F.left(F.md5(c.cast("string")), F.lit(8))


QUERIES = {
    "canon_json": lambda s, d: tbl(s, d, "events").select("event_id", canonical_json(F.concat(F.lit('{"b": '), F.col("user_id").cast("string"), F.lit('.0, "a": {"z": 1, "y": '), F.col("props"), F.lit("}}"))).alias("canon"), short_hash(F.sha2("props", 256)).alias("short")),
    "content_hash": lambda s, d: tbl(s, d, "documents").select("doc_id", content_hash(F.lit("SimulationLog"), F.lit("1"), F.create_map(F.lit("text"), F.sha2("text", 256), F.lit("lang"), F.sha2("lang", 256))).alias("hash")),
    "cache_key": lambda s, d: tbl(s, d, "orders").select("o_orderkey", cache_key(F.lit("density@1"), F.col("o_orderpriority"), F.array(F.sha2(F.col("o_custkey").cast("string"), 256)), F.col("o_orderstatus"), F.lit("local")).alias("key")),
    "label_valid": lambda s, d: tbl(s, d, "part").select("p_partkey", label_valid(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_name"))).alias("ok")),
    "id_kind": lambda s, d: tbl(s, d, "orders").select("o_orderkey", id_kind(F.concat(F.when(F.col("o_orderkey") % 4 == 0, "art_").when(F.col("o_orderkey") % 4 == 1, "tr_").when(F.col("o_orderkey") % 4 == 2, "wr_").otherwise("xx_"), hexid(F.col("o_orderkey")))).alias("kind")),
    "sanitize": lambda s, d: tbl(s, d, "pages").select("page_id", sanitize(F.col("url")).alias("name")),
    "split_ref": lambda s, d: tbl(s, d, "part").select("p_partkey", *split_ref(F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit("@"), "p_type")).otherwise(F.col("p_brand")))),
    "run_dir": lambda s, d: tbl(s, d, "orders").select("o_orderkey", run_dir(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")), F.col("o_orderstatus"), F.concat(F.lit("wr_"), hexid(F.col("o_orderkey"))), F.col("o_orderdate")).alias("dir"), timestamp_text(F.col("o_orderdate")).alias("at")),
    "sniff_ext": lambda s, d: tbl(s, d, "part").select("p_partkey", content_extension(F.concat(F.when(F.col("p_size") % 6 == 0, "  LAMMPS Description").when(F.col("p_size") % 6 == 1, '{"a"').when(F.col("p_size") % 6 == 2, "set type 1").when(F.col("p_size") % 6 == 3, "units real").when(F.col("p_size") % 6 == 4, "x pair_coeff").otherwise("zz"), F.col("p_name"))).alias("ext")),
    "friendly_name": lambda s, d: friendly_names(tbl(s, d, "lineitem").select(F.col("l_orderkey").alias("artifact_id"), F.when(F.col("l_linenumber") == 1, "data").when(F.col("l_linenumber") == 2, "sub/system.data").otherwise("charges").alias("role"), F.lit("zz").alias("head")).distinct()),
    "mem_norm": lambda s, d: tbl(s, d, "part").select("p_partkey", memory_spec(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 4 == 0, "GB").when(F.col("p_size") % 4 == 1, " mb").when(F.col("p_size") % 4 == 2, "").otherwise("T"))).alias("mem")),
    "walltime": lambda s, d: tbl(s, d, "part").select("p_partkey", walltime(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 5 == 0, ".5 h").when(F.col("p_size") % 5 == 1, " s").when(F.col("p_size") % 5 == 2, ":30").when(F.col("p_size") % 5 == 3, "d").otherwise(" furlong"))).alias("time")),
    "state_parse": lambda s, d: tbl(s, d, "orders").select("o_orderkey", state_parse(F.concat(F.lit("\n \n"), F.when(F.col("o_orderkey") % 3 == 0, "cancelled by 3|x").when(F.col("o_orderkey") % 3 == 1, "Timeout.batch|").otherwise("FAILED"), F.lit("\nmore"))).alias("state")),
    "state_taxonomy": lambda s, d: tbl(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "TIMEOUT").when(F.col("o_orderkey") % 5 == 1, "NODE_FAIL").when(F.col("o_orderkey") % 5 == 2, "CANCELLED").when(F.col("o_orderkey") % 5 == 3, "FAILED").alias("state")).select("o_orderkey", state_taxonomy(F.col("state")).alias("t")).select("o_orderkey", "t.type", "t.category", "t.recoverable"),
    "submit_class": lambda s, d: tbl(s, d, "part").select("p_partkey", submit_class(F.concat(F.when(F.col("p_size") % 2 == 0, "Error: Invalid QOS ").otherwise("limit "), F.col("p_name"))).alias("category")),
    "error_category": lambda s, d: tbl(s, d, "part").select("p_partkey", F.element_at(F.array(*[F.lit(k) for k in CATEGORIES], F.lit("other")), F.col("p_size") % 12 + 1).alias("kind")).select("p_partkey", *error_category(F.col("kind"))),
    "retry_decision": lambda s, d: tbl(s, d, "part").select("p_partkey", should_retry(F.lit(2), F.col("p_size") % 4, F.when(F.col("p_size") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("resource_error"))), F.when(F.col("p_size") % 3 == 0, "resource_error").otherwise("execution_error"), F.col("p_size") % 5 == 0).alias("retry")),
    "next_action": lambda s, d: tbl(s, d, "orders").select("o_orderkey", next_action(F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "CANCELLED").otherwise("COMPLETED"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")), F.col("o_custkey") % 2 == 0).alias("action")),
    "steps": lambda s, d: tbl(s, d, "part").select("p_partkey", steps(F.col("p_retailprice"), F.lit(200.0)).alias("steps")),
    "array_expand": lambda s, d: tbl(s, d, "part").select("p_partkey", F.array_join(expand_sequence(F.lit("A"), F.lit("B"), F.when(F.col("p_size") % 2 == 0, F.lit("C")), F.col("p_size")), "").alias("sequence")),
    "node_label": lambda s, d: tbl(s, d, "part").select("p_partkey", node_label(F.lit("run_npt"), F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" K"))), F.lit("1 bar")).alias("label")),
    "exactly_one": lambda s, d: tbl(s, d, "part").select("p_partkey", exactly_one(F.when(F.col("p_size") % 2 == 0, F.lit(1)), F.when(F.col("p_size") % 3 == 0, F.lit(1))).alias("ok")),
    "ref_extract": lambda s, d: tbl(s, d, "part").select("p_partkey", F.array_join(references(F.concat(F.lit("${params."), F.col("p_brand"), F.lit("} and ${step.out.data."), F.col("p_size").cast("string"), F.lit("}"))), ",").alias("refs")),
    "json_walk": lambda s, d: tbl(s, d, "events").select("event_id", json_walk(F.when(F.col("user_id") % 2 == 0, F.col("props")), F.concat(F.lit('{"k": "m'), F.col("user_id").cast("string"), F.lit('"}')), "k").alias("k")),
    "unit_convert": lambda s, d: units.convert(tbl(s, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 5 == 0, " atm").when(F.col("p_size") % 5 == 1, "GPa").when(F.col("p_size") % 5 == 2, "e3 bar").when(F.col("p_size") % 5 == 3, "").otherwise(".5 psi")).alias("q")), F.lit("pressure"), F.col("q")).select("p_partkey", F.round("value", 6).alias("value"), "unit"),
    "quantity_display": lambda s, d: tbl(s, d, "part").select("p_partkey", units.display(F.col("p_size"), F.lit("K")).alias("text")),
    "subtype_closure": lambda s, d: types.closure(s).select("have", "want", F.col("depth").cast("int").alias("depth")),
}
_P = "p_size % {n} = {k}"
ORACLES = {
    "canon_json": """SELECT event_id, '{"a":{"y":' || replace(props, ' ', '') || ',"z":1},"b":' || user_id || '}' AS canon, left(sha256(props), 8) AS short FROM events""",
    "content_hash": """SELECT doc_id, sha256('{"files":{"lang":"' || sha256(lang) || '","text":"' || sha256(text) || '"},"schema_version":"1","type":"SimulationLog"}') AS hash FROM documents""",
    "cache_key": """SELECT o_orderkey, sha256('{"config":"local","inputs":["' || sha256(o_custkey::VARCHAR) || '"],"parameters":"' || o_orderstatus || '","provider":"' || o_orderpriority || '","task":"density@1"}') AS key FROM orders""",
    "label_valid": "SELECT p_partkey, regexp_full_match(CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END, '[A-Za-z0-9][A-Za-z0-9._-]{0,63}') AS ok FROM part",
    "id_kind": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'artifact' WHEN 1 THEN 'task_run' WHEN 2 THEN 'workflow_run' END AS kind FROM orders",
    "sanitize": "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM pages",
    "split_ref": "SELECT p_partkey, p_brand AS name, CASE WHEN p_size % 2 = 0 THEN p_type END AS version FROM part",
    "run_dir": "SELECT o_orderkey, regexp_replace(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END, '[^A-Za-z0-9._-]', '_', 'g') || '/' || strftime(o_orderdate, '%Y-%m-%d_%H-%M') || '_' || o_orderstatus || '_wr_' || left(md5(o_orderkey::VARCHAR), 8) AS dir, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM orders",
    "sniff_ext": "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'data' WHEN 1 THEN 'json' WHEN 2 THEN 'inc' WHEN 3 THEN 'lmp' WHEN 4 THEN 'lmp' END AS ext FROM part",
    "friendly_name": "SELECT DISTINCT l_orderkey AS artifact_id, CASE l_linenumber WHEN 1 THEN 'data' WHEN 2 THEN 'sub/system.data' ELSE 'charges' END AS role, 'zz' AS head, CASE l_linenumber WHEN 1 THEN 'system.data' WHEN 2 THEN CASE WHEN EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_linenumber = 1) THEN 'system__sub_system.data.data' ELSE 'system.data' END ELSE 'charges.inc' END AS name FROM lineitem l",
    "mem_norm": "SELECT p_partkey, p_size || CASE p_size % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'M' WHEN 2 THEN 'M' ELSE 'T' END AS mem FROM part",
    "walltime": "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN cast((p_size + 0.5) * 60 AS BIGINT)::VARCHAR WHEN 1 THEN '1' WHEN 2 THEN p_size || ':30' WHEN 3 THEN cast(p_size * 1440 AS BIGINT)::VARCHAR END AS time FROM part",
    "state_parse": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'CANCELLED' WHEN 1 THEN 'TIMEOUT' ELSE 'FAILED' END AS state FROM orders",
    "state_taxonomy": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'slurm_timeout' WHEN 1 THEN 'slurm_node_failure' WHEN 2 THEN 'slurm_cancelled' WHEN 3 THEN 'slurm_job_failed' ELSE 'slurm_job_lost' END AS type, CASE o_orderkey % 5 WHEN 1 THEN 'environment_error' WHEN 2 THEN 'environment_error' WHEN 3 THEN 'execution_error' ELSE 'resource_error' END AS category, o_orderkey % 5 NOT IN (2, 3) AS recoverable FROM orders",
    "submit_class": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'environment_error' ELSE 'resource_error' END AS category FROM part",
    "error_category": "SELECT p_partkey, ['input_error','input_error','protocol_error','task_error','provider_error','execution_error','scientific_validation','compatibility_error','not_found','environment_error','internal',NULL][p_size % 12 + 1] AS category, p_size % 12 IN (4, 5, 9) AS recoverable FROM part",
    "retry_decision": "SELECT p_partkey, 2 > p_size % 4 AND ((p_size % 2 = 0 AND p_size % 5 = 0) OR (p_size % 2 = 1 AND p_size % 3 = 0)) AS retry FROM part",
    "next_action": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 <> 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'retry ' ELSE 'logs ' END || o_orderpriority WHEN o_orderstatus = 'P' THEN 'resume' END AS action FROM orders",
    "steps": "SELECT p_partkey, cast(greatest(1, round_even(p_retailprice / 200.0::DOUBLE, 0)) AS BIGINT) AS steps FROM part",
    "array_expand": "SELECT p_partkey, 'A' || repeat('B', greatest(0, p_size - 2)) || CASE WHEN p_size % 2 = 0 THEN 'C' ELSE 'A' END AS sequence FROM part",
    "node_label": "SELECT p_partkey, 'run_npt ' || CASE WHEN p_size % 2 = 0 THEN p_size || ' K ' ELSE '' END || '1 bar' AS label FROM part",
    "exactly_one": "SELECT p_partkey, (p_size % 2 = 0) <> (p_size % 3 = 0) AS ok FROM part",
    "ref_extract": "SELECT p_partkey, 'params.' || p_brand || ',step.out.data.' || p_size AS refs FROM part",
    "json_walk": "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN props->>'k' ELSE 'm' || user_id END AS k FROM events",
    "unit_convert": "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN round(p_size * 1.01325::DOUBLE, 6) WHEN 1 THEN round(p_size * 1e4::DOUBLE, 6) WHEN 4 THEN round((p_size + 0.5::DOUBLE) * 0.0689476::DOUBLE, 6) END AS value, CASE WHEN p_size % 5 IN (0, 1, 4) THEN 'bar' END AS unit FROM part",
    "quantity_display": "SELECT p_partkey, p_size || ' K' AS text FROM part",
    "subtype_closure": types.CLOSURE_SQL,
}
