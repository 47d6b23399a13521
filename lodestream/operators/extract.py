"""Extraction from text: log blocks, pairs, sections, failure classes.

Texts are rows (file, text); lines keep their number from the split, so order
never depends on how rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import tables as src

#: Fixed values of the engine's log format.
BLOCK_END = r"^(Loop time|ERROR|Minimization|Total wall)"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
ATM_TO_GPA = 1.01325e-4
AVOGADRO = 6.02214076e23


def lines(df: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))


def fields(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def last_block(df: DataFrame, key: str = "file", header: str = r"^\s*Step ") -> DataFrame:
    """(file, n, columns, values) of the rows of each file's last block.

    A block opens at a header and ends at a terminator or the next header. Rows
    of another width are skipped; the first non-numeric row of the header's
    width ends the block.
    """
    w = W.partitionBy(key).orderBy("n")
    l = lines(df, key).withColumn("is_header", F.col("line").rlike(header).cast("int")).withColumn("block", F.sum("is_header").over(w))
    l = l.where("block > 0").withColumn("last", F.max("block").over(W.partitionBy(key))).where("block = last")
    f = fields(F.col("line"))
    l = l.withColumn("f", f).withColumn("columns", F.first(F.when(F.col("is_header") == 1, F.col("f")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    wide = F.size("f") == F.size("columns")
    numeric = F.forall("f", lambda x: x.rlike(NUMBER))
    stops = F.col("line").rlike(BLOCK_END) | (wide & ~numeric & (F.col("is_header") == 0))
    l = l.withColumn("ended", F.max(stops.cast("int")).over(w))
    return l.where((F.col("is_header") == 0) & (F.col("ended") == 0) & wide & numeric).select(key, "n", "columns", F.transform("f", lambda x: x.cast("double")).alias("values"))


def pairs(df: DataFrame, key: str = "file") -> DataFrame:
    """(file, n, strain, stress_GPa) from white-space pairs; comments and unreadable lines are skipped.

    Stress is read in atmospheres and kept in GPa.
    """
    l = lines(df, key).withColumn("f", fields(F.col("line")))
    x, y = F.get("f", F.lit(0)).try_cast("double"), F.get("f", F.lit(1)).try_cast("double")
    return l.where(~F.col("line").rlike(r"^\s*#")).select(key, "n", x.alias("strain"), (y * ATM_TO_GPA).alias("stress_GPa")).where("strain is not null and stress_GPa is not null")


def log_tail(df: DataFrame, keep: int = 40, key: str = "file") -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc("n"))
    return lines(df, key).withColumn("back", F.row_number().over(w)).where(F.col("back") <= keep).drop("back")


def classify(text: Column) -> Column:
    """The first that applies: lost atoms, NaN without completion, blow-up, incomplete; NULL for a clean log."""
    done = text.contains("Total wall time")
    return (
        F.when(text.contains("Lost atoms"), "lost_atoms")
        .when(text.rlike(r"\b(nan|NaN)\b") & ~done, "nan_detected")
        .when(text.contains("Energy too large") | text.contains("Bond atoms %"), "energy_blowup")
        .when(~done, "simulation_incomplete")
    )


def verdicts(text: Column) -> list[Column]:
    """completed, no_nan (as a word, not inside one) and no_lost_atoms."""
    low = F.lower(text)
    return [text.contains("Total wall time").alias("completed"), (~low.rlike(r"\bnan\b")).alias("no_nan"), (~low.contains("lost atoms")).alias("no_lost_atoms")]


SECTIONS = r"^(Masses|Atoms|Bonds|Angles|Dihedrals|Impropers|Velocities)\b"


def section_density(df: DataFrame, key: str = "file") -> DataFrame:
    """(file, volume, mass, density_g_cm3, n_atoms) of data files: box extents, masses by type, atoms.

    Atoms of a type without a mass weigh 0.
    """
    w = W.partitionBy(key).orderBy("n")
    l = lines(df, key).withColumn("section", F.last(F.when(F.col("line").rlike(SECTIONS), F.regexp_extract("line", SECTIONS, 1)), ignorenulls=True).over(w)).withColumn("f", fields(F.col("line")))
    num = lambda k: F.get("f", F.lit(k)).try_cast("double")
    box = l.where(F.col("section").isNull() & F.col("line").rlike(r"[xyz]lo [xyz]hi")).groupBy(key).agg(F.product(num(1) - num(0)).alias("volume"))
    masses = l.where((F.col("section") == "Masses") & (F.size("f") >= 2)).select(key, num(0).cast("int").alias("type"), num(1).alias("m")).where("type is not null")
    atoms = l.where((F.col("section") == "Atoms") & (F.size("f") >= 3)).select(key, num(2).cast("int").alias("type")).where("type is not null")
    total = atoms.join(masses, [key, "type"], "left").groupBy(key).agg(F.sum(F.coalesce("m", F.lit(0.0))).alias("mass"), F.count(F.lit(1)).alias("n_atoms"))
    return box.join(total, key).withColumn("density_g_cm3", F.try_divide(F.col("mass") / AVOGADRO, F.col("volume") * 1e-24))


def box_bounds(df: DataFrame, key: str = "file") -> DataFrame:
    """(file, axis, lo, hi) of lines before the masses."""
    l = lines(df, key).withColumn("f", fields(F.col("line"))).where(F.col("line").rlike(r"[xyz]lo [xyz]hi"))
    return l.select(key, F.regexp_extract("line", r"([xyz])lo", 1).alias("axis"), F.get("f", F.lit(0)).try_cast("double").alias("lo"), F.get("f", F.lit(1)).try_cast("double").alias("hi"))


def atom_count(df: DataFrame, key: str = "file") -> DataFrame:
    """(file, atoms): the first line that speaks of atoms."""
    l = lines(df, key).where(F.col("line").rlike(r"^\s*\d+\s+atoms"))
    return l.groupBy(key).agg(F.min_by(F.regexp_extract("line", r"(\d+)\s+atoms", 1).cast("bigint"), "n").alias("atoms"))


def density_check(ratio: Column) -> Column:
    """Whether a packed density is acceptable against its target; without a target it is."""
    return F.coalesce((ratio <= 1.15) & (ratio >= 0.005), F.lit(True))


def dcd_frames(content: Column) -> Column:
    """Frame count of a DCD header: little-endian bytes 8..11 behind the magic 54 00 00 00; NULL for anything else."""
    byte = lambda k: F.conv(F.hex(F.substring(content, k, 1)), 16, 10).cast("bigint")
    n = byte(9) + byte(10) * 256 + byte(11) * 65536 + byte(12) * 16777216
    return F.when(F.hex(F.substring(content, 1, 4)) == "54000000", n)


def logs(s, d):
    """orders as log files: one per customer, each order a block of two rows, with a note line between."""
    o = src.read(s, d, "orders")
    block = F.concat(F.lit("Step Temp Press\n"), F.col("o_orderkey").cast("string"), F.lit(" 300.5 "), F.length("o_orderpriority").cast("string"), F.lit("\n1 2\n"), (F.col("o_orderkey") + 1).cast("string"), F.lit(" 301 "), F.length("o_orderstatus").cast("string"), F.lit("\nLoop time of 1\n7 8 9"))
    return o.groupBy(F.col("o_custkey").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))


def docs(s, d):
    return src.read(s, d, "documents").select(F.col("doc_id").alias("file"), "text")


def data_files(s, d):
    """nation's customers as data files: the box from the nation, atoms from customers."""
    c = src.read(s, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey"))), lambda x: F.concat(x["c_custkey"].cast("string"), F.lit(" 1 "), (x["c_custkey"] % 4 + 1).cast("string"), F.lit(" 0 0 0"))), "\n").alias("atoms"), F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit("data\n\n"), F.col("n").cast("string"), F.lit(" atoms\n0 "), (F.col("c_nationkey") + 10).cast("string"), F.lit(" xlo xhi\n-5 5 ylo yhi\n0 20.5 zlo zhi\n\nMasses\n\n1 12.011\n2 1.008\n3 15.999\n\nAtoms\n\n"), F.col("atoms"), F.lit("\n\nBonds\n\n1 1 2 3"))
    return c.select(F.col("c_nationkey").alias("file"), text.alias("text"))


QUERIES = {
    "log_last_block": lambda s, d: last_block(logs(s, d)).select("file", F.col("n").cast("bigint").alias("n"), F.array_join("columns", ",").alias("columns"), F.get("values", F.lit(0)).alias("step"), F.get("values", F.lit(2)).alias("press")),
    "log_pairs": lambda s, d: pairs(src.read(s, d, "customer").select(F.col("c_custkey").alias("file"), F.concat(F.lit("# strain stress\n0.0"), F.col("c_nationkey").cast("string"), F.lit(" "), F.col("c_custkey").cast("string"), F.lit("\nbad line\n")).alias("text"))).select("file", F.col("n").cast("bigint").alias("n"), "strain", F.round("stress_GPa", 9).alias("stress_GPa")),
    "log_tail": lambda s, d: log_tail(docs(s, d)).select("file", F.col("n").cast("bigint").alias("n"), "line"),
    "log_classify": lambda s, d: docs(s, d).select("file", classify(F.concat("text", F.when(F.col("file") % 3 == 0, "\nTotal wall time: 1").when(F.col("file") % 7 == 0, "\nERROR: Lost atoms").when(F.col("file") % 5 == 0, "\n1 nan 2").when(F.col("file") % 11 == 0, "\nEnergy too large").otherwise(""))).alias("failure")),
    "log_verdicts": lambda s, d: docs(s, d).select("file", *verdicts(F.concat("text", F.when(F.col("file") % 3 == 0, "\nTotal wall time: 1 nan").otherwise("")))),
    "section_density": lambda s, d: section_density(data_files(s, d)).select("file", F.round("volume", 6).alias("volume"), F.round("mass", 6).alias("mass"), F.round("density_g_cm3", 9).alias("density_g_cm3"), "n_atoms"),
    "box_bounds": lambda s, d: box_bounds(data_files(s, d)),
    "atom_count": lambda s, d: atom_count(data_files(s, d)),
    "density_check": lambda s, d: src.read(s, d, "part").select("p_partkey", density_check(F.when(F.col("p_size") > 5, F.col("p_retailprice") / (F.col("p_size") * 100))).alias("ok")),
}
ORACLES = {
    "log_last_block": """WITH b AS (SELECT o_custkey AS file, o_orderkey k, length(o_orderpriority) p, length(o_orderstatus) q, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) i, count(*) OVER (PARTITION BY o_custkey) m FROM orders),
        l AS (SELECT * FROM b WHERE i = m)
        SELECT file, (m - 1) * 6 + 1 AS n, 'Step,Temp,Press' AS columns, cast(k AS DOUBLE) AS step, cast(p AS DOUBLE) AS press FROM l UNION ALL SELECT file, (m - 1) * 6 + 3, 'Step,Temp,Press', cast(k + 1 AS DOUBLE), cast(q AS DOUBLE) FROM l""",
    "log_pairs": "SELECT c_custkey AS file, cast(1 AS BIGINT) AS n, cast('0.0' || c_nationkey AS DOUBLE) AS strain, round(c_custkey * 1.01325e-4, 9) AS stress_GPa FROM customer",
    "log_tail": "WITH l AS (SELECT doc_id AS file, string_split(text, chr(10)) AS f FROM documents), g AS (SELECT file, unnest(range(greatest(0, len(f) - 40), len(f))) AS n, f FROM l) SELECT file, n, f[n + 1] AS line FROM g",
    "log_classify": r"""WITH t AS (SELECT doc_id AS file, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Total wall time: 1' WHEN doc_id % 7 = 0 THEN chr(10) || 'ERROR: Lost atoms' WHEN doc_id % 5 = 0 THEN chr(10) || '1 nan 2' WHEN doc_id % 11 = 0 THEN chr(10) || 'Energy too large' ELSE '' END AS t FROM documents)
        SELECT file, CASE WHEN contains(t, 'Lost atoms') THEN 'lost_atoms' WHEN regexp_matches(t, '\b(nan|NaN)\b') AND NOT contains(t, 'Total wall time') THEN 'nan_detected' WHEN contains(t, 'Energy too large') THEN 'energy_blowup' WHEN NOT contains(t, 'Total wall time') THEN 'simulation_incomplete' END AS failure FROM t""",
    "log_verdicts": r"""WITH t AS (SELECT doc_id AS file, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Total wall time: 1 nan' ELSE '' END AS t FROM documents) SELECT file, contains(t, 'Total wall time') AS completed, NOT regexp_matches(lower(t), '\bnan\b') AS no_nan, NOT contains(lower(t), 'lost atoms') AS no_lost_atoms FROM t""",
    "section_density": """WITH a AS (SELECT c_nationkey AS file, sum(CASE c_custkey % 4 + 1 WHEN 1 THEN 12.011 WHEN 2 THEN 1.008 WHEN 3 THEN 15.999 ELSE 0 END)::DOUBLE AS mass, count(*) AS n_atoms, (c_nationkey + 10) * 10.0::DOUBLE * 20.5 AS volume FROM customer GROUP BY c_nationkey)
        SELECT file, round(volume, 6) AS volume, round(mass, 6) AS mass, round(mass / 6.02214076e23 / (volume * 1e-24), 9) AS density_g_cm3, n_atoms FROM a""",
    "box_bounds": "WITH f AS (SELECT DISTINCT c_nationkey AS file FROM customer) SELECT file, 'x' AS axis, 0.0::DOUBLE AS lo, cast(file + 10 AS DOUBLE) AS hi FROM f UNION ALL SELECT file, 'y', -5.0, 5.0 FROM f UNION ALL SELECT file, 'z', 0.0, 20.5 FROM f",
    "atom_count": "SELECT c_nationkey AS file, count(*) AS atoms FROM customer GROUP BY c_nationkey",
    "density_check": "SELECT p_partkey, CASE WHEN p_size > 5 THEN p_retailprice / (p_size * 100) <= 1.15 AND p_retailprice / (p_size * 100) >= 0.005 ELSE true END AS ok FROM part",
}
