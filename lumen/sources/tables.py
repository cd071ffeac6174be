"""Sources: parquet tables, label CSVs, image listings, metadata JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.session import table_path

# pandas' default missing-value tokens that occur in the reference's CSVs; Spark
# treats only the empty field as null, so these are mapped explicitly.
CSV_NULL_TOKENS = ["", "NA", "N/A", "NaN", "nan", "None", "null", "NULL", "<NA>", "n/a", "-NaN", "-nan"]


#: A row's place in its file.
POSITION = ("_file", "_block", "_row")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver tables: ``{sf_dir}/{name}.parquet`` (pushdown + pruning by Catalyst)."""
    return spark.read.parquet(table_path(sf_dir, name))


def require_columns(df: DataFrame, cols, what: str = "input") -> None:
    """F8: fail before any job starts when required columns are absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")


def pick_schema(df: DataFrame, options: dict[str, list[str]]) -> str:
    """F8: first named alternative whose columns are all present."""
    for name, cols in options.items():
        if all(c in df.columns for c in cols):
            return name
    raise ValueError(f"no accepted schema matches columns {df.columns}; options: {options}")


def read_label_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   null_tokens=tuple(CSV_NULL_TOKENS), position: bool = False) -> DataFrame:
    """CSV with quoted newlines and doubled quotes, pandas-like null tokens.

    Every field is read as text (no inference pass over the data), the null
    tokens pandas recognises become null, and only then are columns cast to
    the requested ``schema`` types -- so ``NA`` in a numeric column is a null,
    not a parse failure, while a genuinely bad value still fails the cast.
    ``position`` adds the columns POSITION: file, start of the block, and a
    number that grows with the rows of the block.
    """
    reader = (spark.read.option("header", True).option("multiLine", True)
              .option("quote", '"').option("escape", '"').option("mode", "FAILFAST"))
    target = None
    if schema is not None:
        target = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    df = reader.csv(path)  # the header names the columns, whatever their order
    if target is not None:
        require_columns(df, target.names)
        df = df.select(*[F.col(f"`{c}`") for c in target.names])
    tokens = [t for t in null_tokens if t != ""]
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if tokens:
            c = F.when(c.isin(tokens), F.lit(None).cast("string")).otherwise(c)
        if target is not None and not isinstance(target[f.name].dataType, T.StringType):
            c = c.cast(target[f.name].dataType)
        cols.append(c.alias(f.name))
    if position:
        cols += [F.col("_metadata.file_path").alias(POSITION[0]), F.col("_metadata.file_block_start").alias(POSITION[1]),
                 F.monotonically_increasing_id().alias(POSITION[2])]
    return df.select(*cols)


def normalise_label_columns(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Lower-case, snake-case column names (``Pleural Effusion`` -> ``pleural_effusion``)."""
    rename = rename or {}
    return df.select(*[F.col(f"`{c}`").alias(rename.get(c, c.strip().lower().replace(" ", "_")))
                       for c in df.columns])


def list_images(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """Recursive ``binaryFile`` listing of an image folder -> ``(path, length[, content])``.

    Always list the folder and join on the normalised path: naming a missing
    file in ``load`` fails the whole read.
    """
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))
    cols = [F.regexp_replace("path", r"^file:", "").alias("path"), "length"]
    if with_content:
        cols.append("content")
    return df.select(*cols)


def read_model_meta(spark: SparkSession, path: str) -> DataFrame:
    """Per-model metadata JSON objects; a missing folder yields an empty table.

    Files that do not name their model are known by their own name (``<model>.json``).
    """
    schema = T.StructType([
        T.StructField("model_name", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("sample_size", T.IntegerType()),
        T.StructField("best_hyperparameter_C", T.DoubleType()),
    ])
    try:
        meta = spark.read.schema(schema).option("multiLine", True).json(path)
        stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
        return meta.withColumn("model_name", F.coalesce("model_name", stem))
    except Exception as exc:  # AnalysisException: path does not exist
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], schema)
        raise


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """The models table (one row per probe), ordered by name; error when empty."""
    models = spark.read.parquet(path)
    if models.isEmpty():
        raise ValueError(f"no models found in {path}")
    return models.orderBy("model_name")


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """One run row by id; error when it does not exist."""
    runs = spark.read.parquet(path).where(F.col("run_id") == run_id)
    if runs.isEmpty():
        raise FileNotFoundError(f"run {run_id!r} not found under {path}")
    return runs
