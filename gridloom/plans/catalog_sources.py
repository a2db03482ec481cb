"""Queries of sources and sinks (S1-S23), lookups by name (J7, J11) and times: what is written is read back.

Files go to a folder of their own in the shared store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import folds, metric
from gridloom.plans.catalog import ART, CONE, PX, SETS, Ctx, _block_sql, _row, add, query, r6
from gridloom.plans.catalog_fields import BANDS, stack
from gridloom.session import shared_dir
from gridloom.sources import grid as G


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sources-{uuid.uuid4().hex}"


def _stored(c: Ctx) -> str:
    path = _folder(c.spark)
    c.px.select("y", "x", "v", "d").write.parquet(path)
    return path


add("read_band", lambda c: G.read_band(c.spark, _stored(c), "v"), f"WITH {PX} SELECT y, x, v FROM px")


def _meta(c: Ctx) -> DataFrame:
    found = G.read_meta(c.spark, _stored(c))
    return c.spark.createDataFrame([(n, m["type"]) for n, m in found.items()], "name string, type string")


add("read_meta", _meta, "SELECT * FROM (VALUES ('y', 'int'), ('x', 'int'), ('v', 'double'), ('d', 'int')) u(name, type)")


def _columns(c: Ctx) -> DataFrame:
    return c.spark.createDataFrame([(p, b) for p, names in G.band_columns(stack(c)).items() for b in names], "prefix string, band string")


add(
    "band_columns", _columns,
    "SELECT CASE WHEN left(b, 4) IN ('rad_', 'ext_', 'lid_') THEN left(b, 4) ELSE '' END AS prefix, b AS band FROM (SELECT unnest(["
    + ", ".join(f"'{b}'" for b in BANDS) + "]) AS b)",
)


def _written(c: Ctx) -> DataFrame:
    path = _folder(c.spark)
    cells = c.px.select("y", "x", F.when(F.col("q") % 7 == 0, F.lit(float("nan"))).otherwise((F.col("d") - 2) / 4.0).alias("p"))
    G.write_output(cells, c.grid, path)
    return c.spark.read.parquet(path).select("y", "x", F.col("p").cast("double").alias("p"))


add("written_output", _written, f"WITH {PX} SELECT y, x, CASE WHEN q % 7 <> 0 THEN least(greatest((d - 2) / 4.0e0, 0.0e0), 1.0e0) END AS p FROM px")

# ---------------------------------------------------------------- files, registries, archives

_PARTS = {"a.tif.part-0": b"alpha", "a.tif.part-1": b"beta\n", "a.tif.part-2": b"!", "b.bin.part-0": b"gamma"}


def _parts(spark: SparkSession) -> str:
    path = _folder(spark)
    for name, content in _PARTS.items():
        G.write_file(spark, f"{path}/{name}", content)
    return path


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.file_hashes(spark, _parts(spark)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", "sha256")


query(
    "file_hashes",
    """SELECT name, CAST(length(body) AS BIGINT) AS length, sha256(body) AS sha256 FROM (VALUES ('a.tif.part-0', 'alpha'), ('a.tif.part-1',
  'beta' || chr(10)), ('a.tif.part-2', '!'), ('b.bin.part-0', 'gamma')) u(name, body)""",
)(_hashes)


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    parts = G.assemble_parts(spark, _parts(spark))
    digests = {"a.tif": hashlib.sha256(b"alphabeta\n!").hexdigest(), "b.bin": "0" * 64}
    return G.verify_parts(parts, digests, {"a.tif": "features.tif"})


query(
    "assembled_parts",
    """SELECT name, CAST(n AS BIGINT) AS n_parts, CAST(length(body) AS BIGINT) AS length, sha256(body) AS sha256, ok AS verified
  FROM (VALUES ('features.tif', 3, 'alphabeta' || chr(10) || '!', true), ('b.bin', 1, 'gamma', false)) u(name, n, body, ok)""",
)(_assembled)


def _artifacts(c: Ctx) -> DataFrame:
    return G.derived_supports(c.spark, c.sf_dir)


def _registry(c: Ctx) -> DataFrame:
    path = _folder(c.spark)
    entries = _artifacts(c).groupBy(F.concat(F.lit("art-"), "a").alias("name")).agg(F.count("*").alias("n_positive"), F.round(F.max("p"), 6).alias("max"))
    G.write_registry(entries, path)
    return G.read_registry(c.spark, path, "name string, n_positive long, max double")


add("registry_round_trip", _registry, f"WITH {ART} SELECT 'art-' || a AS name, CAST(count(*) AS BIGINT) AS n_positive, round(max(p), 6) AS max FROM art GROUP BY 1")


def _document(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/registry.json"
    G.write_document({"n_entries": 2, "entries": [{"name": "a", "score": 0.5}, {"name": "b", "score": None}]}, spark, path)
    return G.read_registry(spark, path, "n_entries long, entries array<struct<name:string,score:double>>")


query("document_round_trip", "SELECT * FROM (VALUES ('a', 0.5e0), ('b', NULL)) u(name, score)")(_document)


def _archive(c: Ctx) -> DataFrame:
    path = _folder(c.spark)
    G.write_archive(c.px.select("y", "x", "d"), path)
    back = c.spark.read.parquet(path)
    small = back.select(F.input_file_name().alias("f")).agg(F.bool_and(F.col("f").contains(".gz")).alias("compressed"))
    return back.agg(F.count("*").alias("n"), F.sum("d").alias("d")).crossJoin(small)  # single rows


add("archive_round_trip", _archive, f"WITH {PX} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS d, true AS compressed FROM px")


def _scanned(c: Ctx) -> DataFrame:
    path = _folder(c.spark)
    _artifacts(c).withColumn("of", F.col("a")).write.partitionBy("of").parquet(path)
    return G.scan_corpus(c.spark, path).groupBy("artifact").agg(F.count("*").alias("n"), F.round(F.sum("p"), 6).alias("mass"))


add("scan_corpus", _scanned, f"WITH {ART} SELECT 'of=' || a AS artifact, CAST(count(*) AS BIGINT) AS n, round(sum(p), 6) AS mass FROM art GROUP BY 1")

# ---------------------------------------------------------------- reports, names, times, lookups


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").select("r_regionkey", F.concat(F.lit("<"), "r_name", F.lit("&>")).alias("r_name"))
    return spark.createDataFrame([(G.report_table(rows, ["r_regionkey", "r_name"], 3),)], "html string")


query(
    "report_table",
    """SELECT '<table><tr><th>r_regionkey</th><th>r_name</th></tr>' || string_agg('<tr><td>' || r_regionkey || '</td><td>&lt;' || r_name || '&amp;&gt;</td></tr>',
  '' ORDER BY r_regionkey) || '</table>' AS html"""
    " FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 3)",
)(_report)


def _output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    return t.select("o_orderkey", G.output_name(F.lower("o_orderstatus"), digest, F.col("o_orderdate")).alias("name"), F.current_timestamp().isNotNull().alias("now"))


query("output_names", """SELECT o_orderkey, lower(o_orderstatus) || '-' || strftime(o_orderdate,
  '%Y%m%dT%H%M%SZ') || '-' || left(sha256(CAST(o_orderkey AS VARCHAR)), 8) AS name, true AS now FROM orders""")(_output_names)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    for name in ("old/x.tif", "new/x.tif", "new/y.tif", "other/z.tif"):
        G.write_file(spark, f"{path}/{name}", name.encode())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    entries = spark.createDataFrame([("x.tif", 0.5), ("y.tif", None), ("z.tif", 0.1)], "name string, score double")
    return G.find_files(entries, files, ["new", "old"]).select("name", "score", F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path"))


query("find_files", "SELECT * FROM (VALUES ('x.tif', 0.5e0, 'new/x.tif'), ('y.tif', NULL, 'new/y.tif'), ('z.tif', 0.1e0, NULL)) u(name, score, path)")(_found)


def _lifts(c: Ctx) -> DataFrame:
    table = c.spark.createDataFrame([("v", 0.25, 0.6), ("d", -0.1, 0.4), ("d", -0.05, 0.5)], "band string, lift double, target double")
    bands = c.px.select("y", "x", F.explode(F.array(F.lit("v"), F.lit("q"), F.lit("d"))).alias("band"))
    return G.look_up(bands, table, "band", ["lift", "target"]).groupBy("band").agg(F.count("*").alias("n"), F.max("lift").alias("lift"), F.max("target").alias("target"))


add(
    "lookup_join", _lifts,
    f"""WITH {PX} SELECT b AS band, CAST(count(*) AS BIGINT) AS n, any_value(lift) AS lift, any_value(target) AS target FROM px, (VALUES ('v', 0.25e0,
  0.6e0), ('d', -0.1e0, 0.4e0), ('q', NULL, NULL)) u(b, lift, target) GROUP BY 1""",
)

# ---------------------------------------------------------------- M14: folds without truth


def _empty_folds(c: Ctx) -> DataFrame:
    truth = c.truth.withColumn("fold", folds.block_column(3, c.grid)).where("fold not in (0, 4)")
    every = c.spark.range(9).select(F.col("id").cast("int").alias("fold"))
    return metric.score(c.pred, truth, c.free, ("fold",), every)


add(
    "dti_empty_folds", lambda c: _row(_empty_folds(c), "fold"),
    f"""WITH {SETS}, {CONE}, every AS (SELECT CAST(unnest(range(9)) AS INT) AS fold),
ft AS (SELECT * FROM (SELECT y, x, {_block_sql(3)} AS fold FROM truth, gs) WHERE fold NOT IN (0, 4)),
n AS (SELECT e.fold, CAST(count(ft.y) AS BIGINT) AS n_truth FROM every e LEFT JOIN ft USING (fold) GROUP BY 1),
cr AS (SELECT t.fold, t.y, t.x, max(p.p * k.k) AS c FROM ft t CROSS JOIN k JOIN pred p ON p.y = t.y + k.dy AND p.x = t.x + k.dx GROUP BY 1, 2, 3),
tp AS (SELECT fold, sum(c) AS tp FROM cr GROUP BY 1),
charged AS (SELECT e.fold, p.* FROM pred p, every e WHERE NOT EXISTS (SELECT 1 FROM free f WHERE f.y = p.y AND f.x = p.x)),
rc AS (SELECT c.fold, c.y, c.x, c.p, coalesce(max(CASE WHEN t.y IS NOT NULL THEN k.k END), 0.0e0) AS k
  FROM charged c CROSS JOIN k LEFT JOIN ft t ON t.fold = c.fold AND t.y = c.y + k.dy AND t.x = c.x + k.dx GROUP BY 1, 2, 3, 4),
fp AS (SELECT fold, sum(p * (1.0e0 - k)) AS fp FROM rc GROUP BY 1),
s AS (SELECT n.fold, n_truth, coalesce(tp, 0.0e0) AS tp, CASE WHEN n_truth = 0 THEN (SELECT sum(p) FROM pred) ELSE fp END AS fp,
  CASE WHEN n_truth = 0 THEN 0.0e0 ELSE n_truth - coalesce(tp, 0.0e0) END AS fn
  FROM n LEFT JOIN tp USING (fold) LEFT JOIN fp USING (fold))
SELECT fold, n_truth, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, round(CASE WHEN n_truth = 0 THEN 0.0e0 ELSE tp / (tp + 0.2e0 * fp + 0.8e0 * fn + 1.0e-12) END, 6) AS dti FROM s""",
)
