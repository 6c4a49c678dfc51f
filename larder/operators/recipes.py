"""Recipes, aliases and the use of ingredients they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.text import contains_ignore_case, join_key
from larder.operators.cleaning import keep_first
from larder.operators.joins import first_rows
from larder.operators.skew import salted_join


def alias_join(items: DataFrame, alias: DataFrame) -> DataFrame:
    """Items with their recipe. An alias without option fits every option; exact and general both match.

    The name stays the hash key; the option test is a residual condition.
    """
    option_fits = F.col("pos_option").isNull() | (F.col("pos_option") == F.col("option_names"))
    return items.join(alias, (F.col("pos_name") == F.col("item_name")) & option_fits, "inner")


def recipe_join(aliased: DataFrame, recipes: DataFrame) -> DataFrame:
    return aliased.join(recipes, F.col("recipe_name") == F.col("dish_name"), "inner")


def one_per_code(catalog: DataFrame, code: str, name: str) -> DataFrame:
    """One name per code spelled in any case, so that a lookup cannot fan out."""
    keyed = catalog.select(F.lower(code).alias("code"), F.col(name).alias("name"))
    return keep_first(keyed.where(F.col("code").isNotNull()), ["code"], ["name"])


def resolve_names(
    df: DataFrame, code: str, skus: DataFrame, ingredients: DataFrame, out: str = "ingredient_name"
) -> DataFrame:
    """Display name of a code: first catalog, second catalog, else the code itself."""
    first = one_per_code(skus, "sku_code", "sku_name").select("code", F.col("name").alias("_n1"))
    second = one_per_code(ingredients, "sku", "name").select("code", F.col("name").alias("_n2"))
    names = first.join(second, "code", "full").select(F.col("code").alias("_code"), F.coalesce("_n1", "_n2").alias("_name"))
    keyed = df.withColumn("_code", F.lower(code))
    return salted_join(keyed, names, ["_code"], "left").withColumn(out, F.coalesce("_name", F.col(code))).drop("_code", "_name")


def expected_usage(
    items: DataFrame,
    orders: DataFrame,
    alias: DataFrame,
    recipes: DataFrame,
    skus: DataFrame,
    ingredients: DataFrame,
) -> DataFrame:
    """Ingredient use implied by sold dishes, per day and outlet.

    The sum is linear in the quantity, so order lines are added up per day,
    outlet, dish and option before they meet aliases, and again per recipe
    before they meet its ingredients: the fan-out multiplies daily recipe totals,
    never order lines, however popular a dish is.
    """
    sold = (
        items.join(orders, F.col("order_id") == F.col("id"))
        .groupBy(F.col("order_date").alias("date"), join_key(F.col("store_name")).alias("outlet"), "item_name", "option_names")
        .agg(F.sum("quantity").alias("quantity"), F.count("*").alias("lines"))
    )
    offset = F.coalesce(F.col("additive_offset"), F.lit(0.0))
    cooked = alias_join(sold, alias).groupBy("date", "outlet", "recipe_name").agg(
        F.sum(F.col("quantity") * F.col("multiplier")).alias("portions"), F.sum(F.col("lines") * offset).alias("extra")
    )
    names = resolve_names(recipes, "ingredient", skus, ingredients)
    used = recipe_join(cooked, names)
    per_dish = F.col("portions") * F.col("qty_per_unit") + F.col("extra")
    # Eight decimals hold six of a recipe quantity and two of a multiplier, and no summation noise.
    return used.groupBy("date", "outlet", join_key(F.col("ingredient_name")).alias("ingredient")).agg(
        F.max("unit").alias("unit"), F.round(F.sum(per_dish), 8).alias("expected_qty")
    )


def actual_usage(sales: DataFrame) -> DataFrame:
    return sales.groupBy(
        "date", join_key(F.col("outlet")).alias("outlet"), join_key(F.col("sku")).alias("ingredient")
    ).agg(F.sum("qty_sold").alias("actual_qty"))


def demand_per_ingredient(recipes: DataFrame) -> DataFrame:
    return recipes.groupBy("ingredient", "unit").agg(F.round(F.sum("qty_per_unit"), 4).alias("total_qty_needed"))


def explode_recipes(units: DataFrame, recipes: DataFrame, yield_factor: Column | None = None) -> DataFrame:
    """Ingredient demand of dish forecasts: units x recipe quantity x yield, per day."""
    daily = units.groupBy("forecast_date", "dish_name").agg(F.sum("units").alias("units"))
    factor = F.lit(1.0) if yield_factor is None else yield_factor
    return (
        daily.join(recipes, "dish_name")
        .groupBy("forecast_date", "ingredient", "unit")
        .agg(F.round(F.sum(F.col("units") * F.col("qty_per_unit") * factor), 2).alias("total_qty_needed"))
    )


def tracked_share(recipes: DataFrame, tracked: DataFrame, limit: int | None = None) -> DataFrame:
    """Dishes by the share of their quantity that tracked ingredients cover."""
    codes = tracked.select(join_key(F.col("code")).alias("_code")).distinct().withColumn("_hit", F.lit(True))
    flagged = salted_join(recipes.withColumn("_code", join_key(F.col("ingredient"))), codes, ["_code"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    per_dish = flagged.groupBy("dish_name").agg(
        F.round(F.sum(F.when(hit, F.col("qty_per_unit")).otherwise(0.0)), 4).alias("tracked_qty"),
        F.round(F.sum("qty_per_unit"), 4).alias("total_qty"),
    )
    pct = F.coalesce(F.round(F.try_divide("tracked_qty", "total_qty") * 100, 4), F.lit(0.0))
    ranked = (
        per_dish.where(F.col("tracked_qty") > 0)
        .withColumn("tracked_pct", pct)
        .orderBy(F.col("tracked_pct").desc(), F.col("tracked_qty").desc(), "dish_name")
    )
    return first_rows(ranked, limit)


def without_alias(recipes: DataFrame, alias: DataFrame) -> DataFrame:
    """Recipe rows no alias points to."""
    known = alias.select(F.col("recipe_name").alias("dish_name")).distinct()
    return salted_join(recipes, known, ["dish_name"], "left_anti")


def mapped_ingredients(recipes: DataFrame, skus: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Recipe codes and every catalog name of such a code, lower-cased."""
    codes = recipes.select(F.lower("ingredient").alias("ingredient")).distinct()

    def names(catalog: DataFrame, code: str, name: str) -> DataFrame:
        keyed = catalog.select(F.lower(code).alias("ingredient"), F.lower(name).alias("name"))
        return keyed.join(codes, "ingredient", "left_semi").select(F.col("name").alias("ingredient"))

    return codes.union(names(skus, "sku_code", "sku_name")).union(names(ingredients, "sku", "name")).distinct()


def listing(recipes: DataFrame, skus: DataFrame, dish: str | None = None, limit: int | None = None) -> DataFrame:
    if dish:
        recipes = recipes.where(contains_ignore_case(F.col("dish_name"), dish))
    joined = recipes.join(skus, F.lower("ingredient") == F.lower("sku_name"), "left")
    listed = (
        joined.select(
            "dish_name", "ingredient", F.col("qty_per_unit").alias("qty_per_portion"), "unit",
            F.lit(1.0).alias("yield_factor"), "sku_code", "sku_name", F.col("sku_code").isNotNull().alias("is_tracked"),
        )
        .orderBy("dish_name", "ingredient", "sku_code")
    )
    return first_rows(listed, limit)


def exact_alias_match(items: DataFrame, recipes: DataFrame) -> DataFrame:
    """Order item names that are recipe names, as high-confidence aliases."""
    names = items.select("item_name").where(F.col("item_name").isNotNull()).distinct()
    dishes = recipes.select(F.col("dish_name").alias("item_name")).distinct()
    return names.join(dishes, "item_name", "left_semi").select(
        F.col("item_name").alias("pos_name"),
        F.lit(None).cast("string").alias("pos_option"),
        F.col("item_name").alias("recipe_name"),
        F.lit(1.0).alias("multiplier"),
        F.lit("high").alias("confidence"),
    )
