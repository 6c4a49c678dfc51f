"""The learned model learns: a known pattern, a shuffled target, and no mean that holds the row beside it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import learned

FIRST = dt.date(2025, 1, 6)
SCHEMA = "sku string, outlet string, date date, qty_sold double"
LAST = dt.date(2025, 7, 6)


def weekly(shuffled: bool):
    rnd = random.Random(4)
    rows = []
    for s in range(8):
        level = 10 * (s + 1)
        values = [level * (3 if k % 7 in (4, 5) else 1) * (0.95 + 0.1 * rnd.random()) for k in range(182)]
        if shuffled:
            rnd.shuffle(values)
        rows += [(f"s{s % 4}", f"o{s // 4}", FIRST + dt.timedelta(days=k), v) for k, v in enumerate(values)]
    return rows


def score(spark, rows):
    return learned.against_means(spark.createDataFrame(rows, SCHEMA), F.lit(FIRST), F.lit(LAST), most_trees=32).first()


def test_weekly_pattern_is_learned_and_noise_is_not(spark):
    found = score(spark, weekly(shuffled=False))
    assert found.n_rows == 56 and found.n_trees >= 1
    assert found.learned_accuracy > 85 > 60 > found.series_mean_accuracy
    noise = score(spark, weekly(shuffled=True))
    # The median of the target is all that is left to find.
    assert noise.learned_accuracy < 75


def test_best_prefix_lies_behind_its_patience(spark):
    rows = spark.createDataFrame(weekly(shuffled=True), SCHEMA)
    chosen = learned.choose(rows, F.lit(FIRST), F.lit(LAST), most_trees=24, patience=4)
    assert 1 <= chosen.trees <= 24 and chosen.error > 0


def test_means_leave_the_own_row_and_the_validation_days_out(spark):
    rows = [("a", "o", FIRST + dt.timedelta(days=k), float(k)) for k in range(140)]
    cutoff = F.lit(FIRST + dt.timedelta(days=139))
    upto = FIRST + dt.timedelta(days=111)
    frame = learned.training_frame(spark.createDataFrame(rows, SCHEMA), F.lit(FIRST), cutoff, F.lit(upto))
    epoch = dt.date(1970, 1, 1)

    def fold(day):
        return (day - epoch).days // 7 % learned.MEAN_FOLDS

    held = [r for r in rows if r[2] >= FIRST + dt.timedelta(days=28) and r[2] <= upto]
    for r in frame.collect():
        others = [q for _, _, d, q in held if r.date > upto or fold(d) != fold(r.date)]
        assert r.combo_mean == r.sku_mean == r.outlet_mean == pytest.approx(sum(others) / len(others))
