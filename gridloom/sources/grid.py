"""Grid tables: shapes, sources, sinks, receipts and hashes.

A grid is a long table of cells (y, x, bands...); masks and dot sets are sparse tables (y, x[, p]). Null is nodata.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.quantiles import column_quantiles
from gridloom.functions.scalars import clip_unit, in_support, is_finite, nodata_to_null


@dataclass(frozen=True)
class Grid:
    """Height and width in cells, with the georeference that writers repeat."""

    h: int
    w: int
    origin_x: float = 243350.0
    origin_y: float = 4508550.0
    cell: float = 100.0
    crs: str = "EPSG:32611"


#: Columns and rules of the grid derived from the driver's lineitem table.
PX_SQL = """SELECT CAST(floor(l_orderkey / 50) AS INT) AS y, CAST(l_partkey % 260 AS INT) AS x, max(CAST(round(l_discount * 100) AS INT)) AS d,
  min(CAST(l_quantity AS INT)) AS q, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2"""


def derived_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of the driver tables: y, x, d (0..10), q, v."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return (
        t.groupBy(F.floor(F.col("l_orderkey") / 50).cast("int").alias("y"), (F.col("l_partkey") % 260).cast("int").alias("x"))
        .agg(F.max(F.round(F.col("l_discount") * 100).cast("int")).alias("d"), F.min(F.col("l_quantity").cast("int")).alias("q"), F.max("l_extendedprice").alias("v"))
    )


def derived_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sparse artifact (a, y, x, p) for each line number."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return (
        t.where("l_discount >= 0.045").groupBy(F.col("l_linenumber").cast("int").alias("a"), F.floor(F.col("l_orderkey") / 50).cast("int").alias("y"), (F.col("l_partkey") % 260).cast("int").alias("x"))
        .agg(F.max(F.round(F.col("l_discount") * 100).cast("int") / F.lit(10.0)).alias("p"))
    )


def shape_of(cells: DataFrame) -> Grid:
    """The smallest grid that holds all cells; one row reaches the driver."""
    r = cells.agg(F.max("y"), F.max("x")).first()
    return Grid((r[0] if r[0] is not None else -1) + 1, (r[1] if r[1] is not None else -1) + 1)


def read_band(spark: SparkSession, path: str, band: str) -> DataFrame:
    """One band of a stored grid; only its columns are read."""
    return spark.read.parquet(path).select("y", "x", band)


def read_meta(spark: SparkSession, path: str) -> dict:
    """The column names, types and metadata that were stored with a grid."""
    return {f.name: {"type": f.dataType.simpleString(), **f.metadata} for f in spark.read.parquet(path).schema.fields}


def load_stack(bands: dict[str, DataFrame], labels: DataFrame, label: str = "lab", optional: dict[str, DataFrame] | None = None) -> DataFrame:
    """S3: one wide table of all bands, with inside (a label is known) and known (it is positive)."""
    out = labels.select("y", "x", F.col(label).isNotNull().alias("inside"), F.coalesce(F.col(label) > 0, F.lit(False)).alias("known"))
    for name, df in {**bands, **(optional or {})}.items():
        out = out.join(df.select("y", "x", nodata_to_null(F.col(df.columns[-1])).alias(name)), ["y", "x"], "left")
    return out


def median_fill(cells: DataFrame, cols: list[str], inside: Column) -> DataFrame:
    """Nodata becomes the band's median inside the footprint."""
    medians = column_quantiles(cells, {f"m{k}": F.when(inside, nodata_to_null(F.col(c))) for k, c in enumerate(cols)}, [0.5])
    out = cells.crossJoin(F.broadcast(medians))  # a single row
    return out.select(*[F.coalesce(nodata_to_null(F.col(c)), F.col(f"m{cols.index(c)}_q0")).alias(c) if c in cols else F.col(c) for c in cells.columns])


def union_masks(*masks: DataFrame) -> DataFrame:
    """Cells in any mask."""
    out = masks[0].select("y", "x")
    for m in masks[1:]:
        out = out.union(m.select("y", "x"))
    return out.distinct()


def footprint(cells: DataFrame, v: str = "v") -> DataFrame:
    """Cells with a finite value."""
    return cells.where(is_finite(F.col(v))).select("y", "x")


def prepare_output(cells: DataFrame, grid: Grid, v: str = "p", outside: str = "nan") -> DataFrame:
    """The rows that `write_output` stores: legal values in [0, 1]; nodata is null (outside='nan') or 0 (outside='zero')."""
    if outside not in ("nan", "zero"):
        raise ValueError("outside is 'nan' or 'zero'")
    bad = cells.where(~(F.col("y").between(0, grid.h - 1) & F.col("x").between(0, grid.w - 1)))
    if not bad.isEmpty():
        raise ValueError(f"cells outside the {grid.h} x {grid.w} grid")
    value = F.when(is_finite(F.col(v)), clip_unit(F.col(v).cast("double")))
    return cells.select("y", "x", (value if outside == "nan" else F.coalesce(value, F.lit(0.0))).cast("float").alias("p"))


def write_output(cells: DataFrame, grid: Grid, path: str, v: str = "p", outside: str = "nan") -> dict:
    """Check, clip and store a grid ordered by (y, x); returns the receipt of what was stored."""
    spark = cells.sparkSession
    prepare_output(cells, grid, v, outside).repartitionByRange("y", "x").sortWithinPartitions("y", "x").write.mode("overwrite").parquet(path)
    return receipt(spark.read.parquet(path), grid).first().asDict()


def receipt(cells: DataFrame, grid: Grid, v: str = "p") -> DataFrame:
    """One row: counts, range, convention and whether the format is legal. Absent cells count as nodata."""
    finite = is_finite(F.col(v))
    n = cells.agg(
        F.count("*").alias("n_rows"), F.count_if(finite).alias("n_finite"), F.min(F.when(finite, F.col(v).cast("double"))).alias("min"),
        F.max(F.when(finite, F.col(v).cast("double"))).alias("max"), F.count_if(finite & (F.col(v) > 0)).alias("n_positive"),
        F.coalesce(F.bool_and(F.when(finite, F.col(v).between(0, 1))), F.lit(True)).alias("in_unit"),
        F.coalesce(F.bool_and(F.col("y").between(0, grid.h - 1) & F.col("x").between(0, grid.w - 1)), F.lit(True)).alias("in_grid"),
    )
    total = F.lit(grid.h * grid.w).cast("long")
    return n.select(
        total.alias("n_cells"), (total - F.col("n_finite")).alias("n_not_finite"), "n_finite", "min", "max", "n_positive",
        F.when(F.col("n_finite") == total, F.lit("zero-outside")).otherwise(F.lit("nan-outside")).alias("convention"),
        (F.col("in_unit") & F.col("in_grid") & (F.col("n_positive") > 0)).alias("format_ok"),
    )


def value_hash(cells: DataFrame, v: str = "p", by: list[str] | None = None, fan: int = 1024) -> DataFrame:
    """A hash of the stored values that depends on no order.

    A grid row's cells are hashed in order, then the hashes of `fan` grid rows, then those hashes: no task gathers more than a grid
    row or `fan` hashes, until the last step, which has a hash for each `fan` grid rows.
    """
    by = by or []
    one = F.concat_ws(",", F.col("x"), F.col(v).cast("float").cast("double").cast("string"))
    joined = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda s: F.concat_ws(":", s[key], s["h"])), ";"), 256).alias("h")
    rows = cells.groupBy(*by, "y").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", one.alias("c")))), lambda s: s["c"]), ";"), 256).alias("h"))
    bands = rows.groupBy(*by, F.floor(F.col("y") / fan).alias("band")).agg(joined("y"))
    return bands.groupBy(*by).agg(joined("band")).withColumnRenamed("h", "sha256_values")


def support_hash(cells: DataFrame, v: str = "p", by: list[str] | None = None) -> DataFrame:
    """The hash of where the values are positive."""
    return value_hash(cells.where(in_support(F.col(v))).withColumn("one", F.lit(1.0)), "one", by).withColumnRenamed("sha256_values", "sha256_support")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of each file that is not empty (Spark lists no others)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file of just this name in the store that Spark writes to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_document(doc: dict, spark: SparkSession, path: str) -> None:
    """A result document as one JSON file."""
    write_file(spark, path, (json.dumps(doc, sort_keys=True, indent=2) + "\n").encode())


def write_registry(entries: DataFrame, path: str) -> None:
    """Registry entries as JSON lines."""
    entries.write.mode("overwrite").json(path)


def read_registry(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Registry entries, from JSON lines or from a document with an array `entries`."""
    document = path.endswith(".json")
    df = (spark.read.schema(schema) if schema else spark.read).option("multiLine", document).json(path)
    return df.select(F.explode("entries").alias("e")).select("e.*") if "entries" in df.columns else df


def write_archive(cells: DataFrame, path: str) -> None:
    """A compressed copy of an output, as one gzip-compressed Parquet folder."""
    cells.write.mode("overwrite").option("compression", "gzip").parquet(path)


def assemble_parts(spark: SparkSession, path: str) -> DataFrame:
    """The parts of split files in name order: stem (the name without its last suffix), part, offset, length, content.

    A stem's bytes are its parts' contents by offset; they stay rows, so that a file of any size can be read and written.
    """
    files = spark.read.format("binaryFile").load(path)
    parts = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.regexp_extract("path", r"([^/]+)$", 1).alias("part"), "length", "content")
    before = Window.partitionBy("stem").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("stem", "part", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return parts.join(offsets, ["stem", "part"]).select("stem", "part", "offset", "length", "content")


def verify_parts(parts: DataFrame, digests: dict[str, str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Name (an alias of the stem, if there is one), n_parts, length, sha256 and whether it is the expected one.

    A stem's parts pass one task in order, and its digest is brought up to date part by part: none is ever put together.
    """
    import hashlib

    import pyarrow as pa

    def run(batches):
        stem, sha, n, size = None, None, 0, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([stem]), pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([sha.hexdigest()])], names=["stem", "n_parts", "length", "sha256"])

        for batch in batches:
            for s, c in zip(batch.column("stem").to_pylist(), batch.column("content"), strict=True):
                if s != stem:
                    if stem is not None:
                        yield row()
                    stem, sha, n, size = s, hashlib.sha256(), 0, 0
                body = c.as_buffer()
                sha.update(body)
                n, size = n + 1, size + body.size
        if stem is not None:
            yield row()

    order = parts.select("stem", "offset", "part", "content").repartition("stem").sortWithinPartitions("stem", "offset", "part").select("stem", "content")
    whole = order.mapInArrow(run, "stem string, n_parts long, length long, sha256 string")
    pick = lambda table, default: F.coalesce(F.create_map(*[F.lit(y) for x in (table or {"": ""}).items() for y in x])[F.col("stem")], default)
    return whole.select(pick(aliases, F.col("stem")).alias("name"), "n_parts", "length", "sha256", (pick(digests, F.lit("")) == F.col("sha256")).alias("verified"))


def listing(files: DataFrame, suffix: str = ".tif", least: int = 1, most: int = 1 << 40, folders: list[str] | None = None) -> DataFrame:
    """The files to fetch: by suffix, size and folder; files: path, length."""
    keep = F.lower("path").endswith(suffix) & F.col("length").between(least, most)
    if folders:
        keep = keep & F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).isin(*folders)
    return files.where(keep)


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """All stored outputs below a folder, each row with the name of its artifact."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path).withColumn("artifact", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def band_columns(df: DataFrame, prefixes: tuple[str, ...] = ("rad_", "ext_", "lid_")) -> dict[str, list[str]]:
    """The band names of a stack, by prefix; '' has the rest."""
    bands = [c for c in df.columns if c not in ("y", "x", "inside", "known")]
    return {p: [b for b in bands if b.startswith(p)] for p in prefixes} | {"": [b for b in bands if not b.startswith(prefixes)]}


def report_table(rows: DataFrame, columns: list[str], limit: int) -> str:
    """The first rows as an HTML table."""
    esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    body = "".join("<tr>" + "".join(f"<td>{esc(r[c])}</td>" for c in columns) + "</tr>" for r in rows.select(*columns).limit(limit).collect())
    return f"<table><tr>{''.join(f'<th>{esc(c)}</th>' for c in columns)}</tr>{body}</table>"


def stamp(when: Column) -> Column:
    """A time of day in UTC as it stands in names."""
    return F.date_format(when, "yyyyMMdd'T'HHmmss'Z'")


def output_name(stem: Column, digest: Column, when: Column) -> Column:
    """A name that tells the time and the code that made the output; for now, when is current_timestamp()."""
    return F.concat_ws("-", stem, stamp(when), F.substring(digest, 1, 8))


def find_files(entries: DataFrame, files: DataFrame, folders: list[str], name: str = "name") -> DataFrame:
    """Each registry entry with the path of its file: the first of the folders that holds one of that name, else null.

    files: path, as `spark.read.format("binaryFile")` lists them; folders: a fixed list, in the order they are tried.
    """
    at = F.array_position(F.array(*[F.lit(f) for f in folders]), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    found = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("_name"), F.struct(at.alias("at"), F.col("path").alias("path")).alias("_f")).where(F.col("_f.at") > 0)
    first = found.groupBy("_name").agg(F.min("_f").alias("_f"))
    return entries.join(first, entries[name] == first["_name"], "left").select(*[entries[c] for c in entries.columns], F.col("_f.path").alias("path"))


def look_up(rows: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the table's columns for their key; the first row of a key counts, and a key that is missing gives nulls."""
    first = table.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*columns)).alias("_first"))
    return rows.join(first, rows[key] == first["_key"], "left").select(*[rows[c] for c in rows.columns], *[F.col(f"_first.{c}").alias(c) for c in columns])


def row_major(grid_w: int) -> Column:
    """The universal tie-breaker y * w + x."""
    return F.col("y").cast("long") * grid_w + F.col("x")


def ranked(df: DataFrame, *order: Column, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """A global row number from 1, without moving all rows to one partition.

    Rows are range-partitioned by the order, numbered within each partition as they are written, and shifted by the sizes of the
    partitions before (a row per partition): one shuffle.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    from gridloom.session import cut

    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    nth = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1  # the low bits of the id count within the partition
    return placed.join(F.broadcast(base), F.col("_part") == F.col("_of")).withColumn(name, F.col("_base") + nth).drop("_part", "_at", "_of", "_base")
