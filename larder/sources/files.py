"""Text feeds: CSV with byte-order mark, headerless CSV, wrapped and nested JSON."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

BOM = "﻿"
OVERFLOW = "_overflow"
# Unlikely as data, so that an empty field is told apart from an absent one.
ABSENT = "\u0001"

# Column names of the headerless recipe export.
RECIPE_EXPORT_COLUMNS = [
    "Sno.", "SN _id", "Recipe_Id", "Recipe_Code", "Item_Name", "Packaged", "Veg", "Menu Item", "Ingredient",
    "Code", "Base_Unit", "Batch_Size", "Ingredient Quantity", "Outlets Mapped", "Unit_Value", "Unit",
    "Base_Unit_Value", "isCritical", "Type",
]
# Keys under which a payload may hold its records.
WRAPPERS = ["data", "results", "items", "records", "response", "list"]


def find_column(columns: list[str], *keywords: str) -> str | None:
    """The first column whose name contains any keyword (column order decides, not keyword order)."""
    return next((c for c in columns if any(k.lower() in c.lower() for k in keywords)), None)


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _csv(spark: SparkSession, path, names: list[str], header: bool) -> DataFrame:
    """Fixed layout as text. A line with too many fields is skipped, one with too few is padded with NULL."""
    df = (
        spark.read.schema(_strings([*names, OVERFLOW]))
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("nullValue", ABSENT)
        .option("emptyValue", "")
        .option("multiLine", False)
        # Every field is parsed, or a surplus field would go unnoticed.
        .option("columnPruning", False)
        .csv(path)
    )
    return df.where(F.col(f"`{OVERFLOW}`").isNull()).drop(OVERFLOW)


def layouts(spark: SparkSession, path, threads: int = 8) -> dict[tuple[str, ...], list[str]]:
    """Files under a path or glob by their header, byte-order marks and outer spaces removed; files without one are left out.

    One small job per file reads its first line, a few at a time.
    """
    paths = sorted(spark.read.text(path).inputFiles())

    def header(file: str) -> tuple[str, ...]:
        return tuple(c.replace(BOM, "").strip() for c in spark.read.option("header", True).csv(file).columns)

    with ThreadPoolExecutor(threads) as pool:
        headers = list(pool.map(inheritable_thread_target(spark)(header), paths))
    out: dict[tuple[str, ...], list[str]] = {}
    for file, names in zip(paths, headers):
        if names:
            out.setdefault(names, []).append(file)
    return out


def read_csv_bom(spark: SparkSession, path) -> DataFrame:
    """CSV files under a path or glob, all columns as text, matched by name.

    Files are grouped by their header and each group is one scan, so files of
    another column order, or with columns of their own, are read by their own
    header. A column that a file doesn't have is NULL there.
    """
    parts = [_csv(spark, files, list(names), header=True) for names, files in layouts(spark, path).items()]
    if not parts:
        raise ValueError(f"no file with a header under {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_consumption(spark: SparkSession, path, default_outlet: str = "Unknown") -> DataFrame:
    """Consumption CSVs of unknown column names: (date, sku, outlet, qty_sold), invalid rows dropped.

    The columns are found for each layout among the files. A layout without a
    date, an item or a quantity is an error that names its files.
    """
    parts = [
        _consumption(_csv(spark, files, list(names), header=True), files, default_outlet)
        for names, files in layouts(spark, path).items()
    ]
    if not parts:
        raise ValueError(f"no file with a header under {path}")
    return reduce(DataFrame.unionByName, parts)


def _consumption(raw: DataFrame, files: list[str], default_outlet: str) -> DataFrame:
    day = find_column(raw.columns, "date")
    item = find_column(raw.columns, "name", "ingredient", "item")
    outlet = find_column(raw.columns, "kitchen", "outlet", "store")
    qty = find_column(raw.columns, "qty", "quantity", "demand")
    if not (day and item and qty):
        raise ValueError(f"no date, item or quantity column among {raw.columns} of {files}")
    text_day = F.col(f"`{day}`")
    parsed = raw.select(
        F.coalesce(
            F.try_to_timestamp(text_day, F.lit("dd-MM-yyyy")), F.try_to_timestamp(text_day, F.lit("yyyy-MM-dd"))
        ).cast("date").alias("date"),
        F.nullif(F.col(f"`{item}`"), F.lit("")).alias("sku"),
        (F.col(f"`{outlet}`") if outlet else F.lit(default_outlet)).alias("outlet"),
        F.col(f"`{qty}`").try_cast("double").alias("qty_sold"),
    )
    return parsed.dropna(subset=["date", "sku", "qty_sold"])


def read_csv_positional(spark: SparkSession, path, names: list[str] = RECIPE_EXPORT_COLUMNS) -> DataFrame:
    """CSV whose own header is shifted: skip it, impose ``names``, ignore the empty trailing field."""
    schema = _strings([*names, "_trailing", OVERFLOW])
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("columnPruning", False)
        .option("nullValue", ABSENT)
        .csv(path)
    )
    return df.where(F.col(OVERFLOW).isNull()).drop("_trailing", OVERFLOW)


def recipe_rows(export: DataFrame) -> DataFrame:
    """(dish_name, ingredient, qty_per_unit, unit) from the positional export."""
    out = export.select(
        F.nullif(F.col("Item_Name"), F.lit("")).alias("dish_name"),
        F.nullif(F.col("Code"), F.lit("")).alias("ingredient"),
        F.coalesce(F.col("`Ingredient Quantity`").try_cast("double"), F.lit(0.0)).alias("qty_per_unit"),
        F.col("Unit").alias("unit"),
    )
    return out.dropna(subset=["dish_name", "ingredient"])


def unwrap_records(payloads: DataFrame) -> DataFrame:
    """Rows of the record array, whichever known wrapper key holds it; otherwise the first array field."""
    arrays = [f.name for f in payloads.schema.fields if isinstance(f.dataType, T.ArrayType)]
    known = [w for w in WRAPPERS if w in arrays] or arrays[:1]
    if not known:
        return payloads
    records = payloads.select(F.explode(F.coalesce(*[F.col(w) for w in known])).alias("r"))
    return records.select("r.*")


def read_json_records(spark: SparkSession, path, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """JSON payloads to record rows. Passing the schema avoids a full inference scan."""
    reader = spark.read.option("multiLine", multi_line)
    return unwrap_records((reader.schema(schema) if schema else reader).json(path))


def stock_records(rows: DataFrame) -> DataFrame:
    """Stock fields found by keyword in records of unknown naming."""
    cols = rows.columns
    kitchen = find_column(cols, "kitchen", "outlet", "store", "branch", "location")
    item = find_column(cols, "ingredient", "item", "material", "product", "name")
    qty = find_column(cols, "quantity", "qty", "stock", "available", "balance")
    unit = find_column(cols, "unit", "uom", "measure")
    return rows.select(
        (F.col(kitchen) if kitchen else F.lit("Unknown")).alias("kitchen"),
        (F.col(item) if item else F.lit("Unknown")).alias("ingredient"),
        (F.coalesce(F.col(qty).cast("string").try_cast("double"), F.lit(0.0)) if qty else F.lit(0.0)).alias("qty_available"),
        (F.col(unit) if unit else F.lit("g")).alias("unit"),
    )


RECIPE_SCHEMA = (
    "_id string, name array<string>, recipeId array<string>, batchSize double, rUnit string, "
    "ingredients array<struct<product:struct<productTitle:string,baseUnit:string,yieldPercentage:double>,"
    "quantity:double,ingredientUnit:struct<unit:string>>>"
)


def flatten_recipes(recipes: DataFrame) -> DataFrame:
    """One row per recipe ingredient, quantity per portion."""
    batch = F.col("batchSize")
    batch = F.when(batch.isNull() | (batch == 0), F.lit(1.0)).otherwise(batch)
    rows = recipes.select(
        F.coalesce(F.try_element_at("name", F.lit(1)), F.col("_id"), F.lit("Unknown")).alias("dish_name"),
        F.nullif(F.try_element_at("recipeId", F.lit(1)), F.lit("")).alias("code"),
        batch.alias("batch"),
        F.explode("ingredients").alias("i"),
    )
    qty = F.coalesce(F.col("i.quantity"), F.lit(0.0))
    return rows.select(
        "dish_name",
        F.coalesce("code", "i.product.productTitle", F.lit("Unknown")).alias("ingredient"),
        F.round(F.when(F.col("batch") > 0, qty / F.col("batch")).otherwise(qty), 6).alias("qty_per_unit"),
        F.coalesce("i.ingredientUnit.unit", "i.product.baseUnit", F.lit("g")).alias("unit"),
    )


def read_recipes(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    """Recipe ingredients of JSON files: a recipe a line, or with ``multi_line`` an array of them a file."""
    return flatten_recipes(spark.read.schema(RECIPE_SCHEMA).option("multiLine", multi_line).json(path))


STOCK_SCHEMA = (
    "_id string, name string, outletName string, items array<struct<product:struct<skuProductCode:string,"
    "_id:string,baseUnit:string>,currentStock:double,stock:double,physicalStock:double>>"
)


def flatten_stock(outlets: DataFrame, snapshot: Column) -> DataFrame:
    """One row per outlet and product; items without a product are skipped."""
    rows = outlets.select(
        F.coalesce("name", "outletName", "_id").alias("kitchen"), F.explode("items").alias("i")
    ).where(F.col("i.product").isNotNull())
    return rows.select(
        snapshot.alias("snapshot_date"),
        "kitchen",
        F.coalesce("i.product.skuProductCode", "i.product._id").alias("ingredient"),
        F.coalesce("i.currentStock", "i.stock", "i.physicalStock", F.lit(0.0)).alias("qty_available"),
        F.coalesce("i.product.baseUnit", F.lit("piece")).alias("unit"),
    )


def read_stock(spark: SparkSession, path, snapshot: Column, multi_line: bool = False) -> DataFrame:
    """Stock per outlet and product of JSON files: an outlet a line, or with ``multi_line`` an array of them a file."""
    return flatten_stock(spark.read.schema(STOCK_SCHEMA).option("multiLine", multi_line).json(path), snapshot)
