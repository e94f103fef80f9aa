"""Sources, sinks and validation of points and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granula.functions.state import durable


def read_matrix(spark: SparkSession, path: str, sep: str = r"\s+") -> DataFrame:
    """A text matrix without header, one point per line: (line, features)."""
    rows = spark.read.text(path).where("trim(value) != ''")
    return parse_matrix(rows, sep)


def parse_matrix(rows: DataFrame, sep: str = r"\s+") -> DataFrame:
    return rows.withColumn("features", F.transform(F.split(F.trim("value"), sep), lambda v: v.try_cast("double"))).drop("value")


def read_header_counts(spark: SparkSession, path: str) -> DataFrame:
    """First line: numbers of rows of class 1 and class 0; then the rows in that order."""
    rows = number_rows(spark.read.text(path))
    head = rows.where("point_id = 0").select(F.split(F.trim("value"), r"\s+")[0].cast("long").alias("ones"))
    body = parse_matrix(rows.where("point_id > 0").withColumn("point_id", F.col("point_id") - 1))
    return body.crossJoin(F.broadcast(head)).select("point_id", "features", (F.col("point_id") < F.col("ones")).cast("int").alias("label"))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", label: int | None = None, skip: tuple[int, ...] = ()) -> DataFrame:
    """A delimited matrix (gzip too): (features[, label]); label and skip are column positions."""
    raw = spark.read.csv(path, sep=sep, header=False, inferSchema=False)
    keep = [c for i, c in enumerate(raw.columns) if i != label and i not in skip]
    out = [F.array(*(F.col(c).try_cast("double") for c in keep)).alias("features")]
    if label is not None:
        out.append(F.col(raw.columns[label]).try_cast("double").cast("int").alias("label"))
    return raw.select(*out)


def labels(rows: DataFrame, column: str = "value") -> DataFrame:
    """Labels parsed as numbers, then cut to integers."""
    return rows.withColumn("label", F.trim(column).try_cast("double").cast("int"))


def number_rows(df: DataFrame) -> DataFrame:
    """Contiguous point_id from 0 in file order, by partition counts and offsets."""
    tagged = df.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    sizes = tagged.groupBy("_p").agg(F.count("*").alias("_n"))
    offset = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_o"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy("_m")) - 1
    return tagged.withColumn("_r", within).join(F.broadcast(offset), "_p").select((F.col("_o") + F.col("_r")).cast("long").alias("point_id"), *df.columns)


def number_by(df: DataFrame, *keys: str) -> DataFrame:
    """point_id from 0 in the order of unique keys: ranges of keys are numbered each on its own, from
    the number of rows in the ranges before."""
    ranged = durable(df.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()))
    offset = ranged.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_o"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*keys)) - 1
    return ranged.withColumn("_r", within).join(F.broadcast(offset), "_p").select(*df.columns, (F.col("_o") + F.col("_r")).cast("long").alias("point_id"))


def matrix_lines(points: DataFrame, decimals: int = 10) -> DataFrame:
    """Lines of a text matrix with fixed decimals; write with .write.text."""
    return points.select(F.concat_ws(" ", F.transform("features", lambda v: F.format_string(f"%.{decimals}f", v))).alias("value"))


def validate(points: DataFrame, dims: int | None = None) -> DataFrame:
    """Counts of rows by fault: wrong width, values that are no finite numbers."""
    bad = F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    width = F.lit(False) if dims is None else F.size("features") != dims
    return points.agg(F.count("*").alias("rows"), F.count_if(width).alias("wrong_width"), F.count_if(bad).alias("not_finite"))


def align(points: DataFrame, labels_: DataFrame) -> DataFrame:
    """points with their labels; raises if either lacks a row of the other."""
    out = points.join(labels_, "point_id")
    n, m, k = points.count(), labels_.count(), out.count()
    if not n == m == k:
        raise ValueError(f"{n} points and {m} labels share {k} ids")
    return out


#: Names and tables of the registered point sets.
CATALOG = {"embeddings": ("vec_id", "embedding", "label")}


def load(spark: SparkSession, sf_dir: str, name: str = "embeddings") -> DataFrame:
    """A registered table as (point_id, features, label)."""
    if name not in CATALOG:
        raise KeyError(f"unknown data set {name}; known: {', '.join(CATALOG)}")
    key, vector, label = CATALOG[name]
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(key).cast("long").alias("point_id"), F.col(vector).cast("array<double>").alias("features"), F.col(label).cast("int").alias("label"))


def plane(points: DataFrame, granules_per_label: int = 4) -> DataFrame:
    """The first two features as (id, x, y, label, g): g is a given partition into granules."""
    g = (F.col("label") * granules_per_label + F.pmod("point_id", F.lit(granules_per_label))).cast("long")
    return points.select(F.col("point_id").alias("id"), F.col("features")[0].alias("x"), F.col("features")[1].alias("y"), "label", g.alias("g"))


#: The benchmark sets in their order, with number of clusters and scaler.
DATASETS = {
    "iris": (3, "none"),
    "seed": (3, "none"),
    "segment_3": (8, "robust"),
    "landsat_2": (5, "none"),
    "msplice_2": (3, "standard"),
    "rice": (2, "standard"),
    "banknote": (2, "standard"),
    "htru2": (2, "none"),
    "breast_cancer": (2, "none"),
    "hcv_data": (2, "robust"),
    "dry_bean": (7, "standard"),
    "rice_cammeo": (2, "standard"),
}


def open_dataset(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A benchmark set as (point_id, features, label) of root/<name>.txt and root/<name>_label.txt, line
    by line; raises for an unknown name, a missing file and tables of different length."""
    if name not in DATASETS:
        raise KeyError(f"unknown data set {name}; known: {', '.join(DATASETS)}")
    points = parse_matrix(number_rows(spark.read.text(f"{root}/{name}.txt").where("trim(value) != ''")))
    return align(points, labels(number_rows(spark.read.text(f"{root}/{name}_label.txt").where("trim(value) != ''"))).select("point_id", "label"))


def read_covertype(spark: SparkSession, path: str) -> DataFrame:
    """Gzip CSV of 55 columns: (features, label), labels from 0."""
    rows = read_delimited(spark, path, label=54)
    return rows.withColumn("label", F.col("label") - 1)


def read_protein(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated file of 77 columns: two ids, the label, 74 features."""
    return read_delimited(spark, path, sep="\t", label=2, skip=(0, 1))


def write_label_map(coded: DataFrame, column: str, code: str, path: str) -> None:
    """The distinct pairs of a recoded column as lines `value -> code`, in the order of the codes."""
    pairs = coded.select(column, code).distinct().orderBy(code)
    pairs.select(F.concat_ws(" -> ", F.col(column).cast("string"), F.col(code).cast("string")).alias("value")).coalesce(1).write.text(path)


def results(spark: SparkSession, rows: list[dict], decimals: int = 4) -> DataFrame:
    """Metrics rows as a table of strings: numbers with fixed decimals, what a row lacks empty."""
    names = list(dict.fromkeys(k for row in rows for k in row))
    text = lambda v: "" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else str(v)
    return spark.createDataFrame([tuple(text(row.get(n)) for n in names) for row in rows], ", ".join(f"`{n}` string" for n in names))


def write_results(table: DataFrame, path: str) -> None:
    """One CSV file with a header."""
    table.coalesce(1).write.csv(path, header=True)


def text_table(rows: list[dict], columns: list[str], decimals: int = 3) -> str:
    """Metrics rows as lines of aligned columns under a header."""
    cells = [columns] + [[f"{row.get(c, ''):.{decimals}f}" if isinstance(row.get(c), float) else str(row.get(c, "")) for c in columns] for row in rows]
    wide = [max(len(row[i]) for row in cells) for i in range(len(columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(row, wide, strict=True)).rstrip() for row in cells)


def latex_table(rows: list[dict], columns: list[str], group: str | None = None, decimals: int = 3) -> str:
    """A LaTeX tabular; rows that follow each other with the same `group` share one cell of it."""
    escape = lambda v: str(v).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    cell = lambda v: f"{v:.{decimals}f}" if isinstance(v, float) else escape(v)
    out = [r"\begin{tabular}{" + "l" * len(columns) + "}", r"\hline", " & ".join(map(escape, columns)) + r" \\", r"\hline"]
    for n, row in enumerate(rows):
        line = [cell(row.get(c, "")) for c in columns]
        if group:
            same = lambda k: 0 <= k < len(rows) and rows[k].get(group) == row.get(group)
            at, size = columns.index(group), 1
            while same(n + size):
                size += 1
            line[at] = "" if same(n - 1) else rf"\multirow{{{size}}}{{*}}{{{line[at]}}}" if size > 1 else line[at]
        out.append(" & ".join(line) + r" \\")
    return "\n".join([*out, r"\hline", r"\end{tabular}"])
