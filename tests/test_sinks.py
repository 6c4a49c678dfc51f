import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.session import scratch_path
from larder.sources import files, sinks


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def day(n):
    return dt.date(2024, 1, n)


def test_replace_window_on_disk_removes_empty_days(spark):
    path = scratch_path(spark, "t")
    spark.createDataFrame([(day(1), 1), (day(2), 2), (day(3), 3), (day(4), 4)], "date date, v int").write.partitionBy("date").parquet(path)
    new = spark.createDataFrame([(day(2), 20), (day(9), 90)], "date date, v int")
    sinks.replace_window_path(new, path, "date", "2024-01-02", "2024-01-03")
    assert rows(spark.read.parquet(path), "date", "v") == [(day(1), 1), (day(2), 20), (day(4), 4)]


def test_upsert_on_disk(spark):
    path = scratch_path(spark, "t")
    key = ["date", "k"]
    first = spark.createDataFrame([(day(1), "a", 1), (day(2), "a", 2)], "date date, k string, v int")
    sinks.upsert_path(first, path, key, "date")
    sinks.upsert_path(spark.createDataFrame([(day(2), "a", 9), (day(3), "b", 3)], "date date, k string, v int"), path, key, "date")
    assert rows(spark.read.parquet(path), "date", "k", "v") == [(day(1), "a", 1), (day(2), "a", 9), (day(3), "b", 3)]
    with pytest.raises(ValueError):
        sinks.upsert_path(first, path, ["k"], "date")


def test_replace_table_twice(spark):
    path = scratch_path(spark, "t")
    for n in (1, 2):
        sinks.replace_path(spark.createDataFrame([(n,)], "v int"), path)
    assert rows(spark.read.parquet(path), "v") == [(2,)]
    assert not sinks.path_exists(spark, path + "_old") and not sinks.path_exists(spark, path + "_new")


def test_conditional_upsert(spark):
    old = spark.createDataFrame([("a", "A", True), ("b", "B", False), ("c", "C", None)], "k string, n string, t boolean")
    new = spark.createDataFrame([("a", "x", False), ("b", "y", False), ("c", "z", False), ("d", "w", False)], "k string, n string, t boolean")
    assert rows(sinks.upsert_unless(old, new, ["k"], "t"), "k", "n") == [("a", "A"), ("b", "y"), ("c", "z"), ("d", "w")]


def test_csv_with_bom_short_and_long_lines(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_bytes("﻿planDate,ingredientName,qty\n01-02-2024,salt,3\n02-02-2024,oil\n03-02-2024,x,1,surplus\nbad,y,2\n".encode())
    raw = files.read_csv_bom(spark, str(file))
    assert raw.columns == ["planDate", "ingredientName", "qty"]
    assert rows(raw, "ingredientName", F.coalesce("qty", F.lit("?"))) == [("oil", "?"), ("salt", "3"), ("y", "2")]
    assert rows(files.read_consumption(spark, str(file)), "date", "sku", "qty_sold") == [(dt.date(2024, 2, 1), "salt", 3.0)]


def test_first_column_with_any_keyword_wins():
    assert files.find_column(["itemCode", "name"], "name", "item") == "itemCode"
    assert files.find_column(["a"], "b") is None


def test_json_without_known_wrapper(spark, tmp_path):
    file = tmp_path / "a.json"
    file.write_text('{"count": 2, "rows": [{"outlet": "k", "item": "i", "qty": 3}, {"outlet": "k", "item": "j", "qty": null}]}')
    out = files.stock_records(files.read_json_records(spark, str(file), multi_line=True))
    assert rows(out, "kitchen", "ingredient", "qty_available", "unit") == [("k", "i", 3.0, "g"), ("k", "j", 0.0, "g")]


def test_publishing_never_leaves_a_gap(spark, monkeypatch):
    path = scratch_path(spark, "t")
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, path)
    sinks.publish(spark.createDataFrame([(1,)], "v int"), path)
    held = sinks.read_published(spark, path)
    failing = spark.createDataFrame([(2,)], "v int").select(F.raise_error(F.lit("broken")).cast("int").alias("v"))
    with pytest.raises(Exception, match="broken"):
        sinks.publish(failing, path)
    assert rows(sinks.read_published(spark, path), "v") == [(1,)]
    seen, put = [], sinks._put_text

    def watched(s, file, text):
        seen.append(rows(sinks.read_published(s, path), "v"))  # the new version is complete, the pointer still the old one
        put(s, file, text)
        seen.append(rows(sinks.read_published(s, path), "v"))

    monkeypatch.setattr(sinks, "_put_text", watched)
    sinks.publish(spark.createDataFrame([(3,)], "v int"), path)
    assert seen == [[(1,)], [(3,)]] and rows(held, "v") == [(1,)]
    sinks.publish(spark.createDataFrame([(4,)], "v int"), path, keep_seconds=0)
    jvm, fs = sinks._fs(spark, path)
    assert len(fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{sinks.VERSIONS}"))) == 1
    assert rows(sinks.read_published(spark, path), "v") == [(4,)]


def test_stored_columns_grow_and_keep_their_type(spark):
    path = scratch_path(spark, "t")
    sinks.append_evolving(spark.createDataFrame([(1, "a")], "k int, s string"), path)
    sinks.append_evolving(spark.createDataFrame([("2", 5), ("x", 6)], "k string, more int"), path)
    sinks.append_evolving(spark.createDataFrame([(7,)], "more long"), path)
    out = sinks.read_evolving(spark, path)
    assert out.dtypes == [("k", "int"), ("s", "string"), ("more", "string")]
    assert sorted(map(str, rows(out.fillna(-1).fillna("-"), *out.columns))) == sorted(
        map(str, [(1, "a", "-"), (2, "-", "5"), (-1, "-", "6"), (-1, "-", "7")])
    )


def test_csv_files_of_several_layouts(spark):
    path = scratch_path(spark, "t")
    for lines in (["a,b", "1,2"], ["b,a", "3,4"], ["﻿a , c", "5,6", "7"], []):
        spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("append").text(path)
    out = files.read_csv_bom(spark, path)
    assert sorted(out.columns) == ["a", "b", "c"] and len(files.layouts(spark, path)) == 3
    assert sorted(map(str, rows(out, "a", "b", "c"))) == sorted(
        map(str, [("1", "2", None), ("4", "3", None), ("5", None, "6"), ("7", None, None)])
    )
    with pytest.raises(ValueError, match="no date"):
        files.read_consumption(spark, path)


def test_arrays_of_recipes_and_outlets_in_one_file(spark, tmp_path):
    recipes, outlets = tmp_path / "recipes.json", tmp_path / "outlets.json"
    recipes.write_text(
        '[{"_id": "1", "name": ["Dal"], "batchSize": 2, "ingredients": [{"product": {"productTitle": "lentil", "baseUnit": "kg"}, "quantity": 3},'
        ' {"quantity": null}]},\n {"_id": "2", "name": [], "recipeId": ["c"], "batchSize": 0, "ingredients": [{"quantity": 5, "ingredientUnit": {"unit": "ml"}}]}, {"_id": "3"}]'
    )
    assert rows(files.read_recipes(spark, str(recipes), multi_line=True), "dish_name", "ingredient", "qty_per_unit", "unit") == [
        ("2", "c", 5.0, "ml"), ("Dal", "Unknown", 0.0, "g"), ("Dal", "lentil", 1.5, "kg")
    ]
    outlets.write_text('[{"outletName": "K", "items": [{"product": {"_id": "p"}, "stock": 4}, {"stock": 9}]}, {"name": "L", "items": []}]')
    found = files.read_stock(spark, str(outlets), F.lit(day(1)), multi_line=True)
    assert rows(found, "kitchen", "ingredient", "qty_available", "unit") == [("K", "p", 4.0, "piece")]
