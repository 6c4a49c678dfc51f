"""Ids that are repeated with different texts, or null, and vectors of unequal length."""

from collections import Counter

import numpy as np
import pytest

from llm.decontaminate import without_leaks
from llm.licenses import license_scan
from llm.multi_index import search
from llm.reputation import DEFAULT_WEIGHT, MOST_WEIGHT, Shrinkage, host_reputation, prior_weight
from llm.substring import maximal_repeats, remove_repeats

DOCS = "doc_id long, text string"


def test_repeats_of_one_id_with_several_texts(spark):
    shared = [f"s{i}" for i in range(120)]
    rows = [
        (1, " ".join(shared)),
        (2, "short text"),
        (2, " ".join(["x"] * 300 + shared)),
        (2, " ".join(shared[:70] + ["tail"])),
        (2, " ".join(shared[:70] + ["tail"])),
        (3, " ".join(["x"] * 300)),
    ]
    found = remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in found) == Counter(
        {(1, 120, 0): 1, (2, 2, 0): 1, (2, 420, 120): 1, (2, 71, 70): 2, (3, 300, 300): 1}
    )
    spans = maximal_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, spans)) == [(2, 0, 70), (2, 300, 420), (3, 0, 300)]


def test_license_lines_of_repeated_and_null_ids(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, mit + "\nx"), (1, f"{mit}\n{gpl}\n{mit}"), (1, f"{mit}\n{gpl}\n{mit}"), (None, "y\n" + mit), (None, "z"), (None, None)]
    found = license_scan(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.n_lines, r.line_licenses) for r in found) == Counter(
        {(1, 1, "MIT"): 1, (1, 3, "GPL-3.0,MIT"): 2, (None, 1, "MIT"): 1, (None, 0, ""): 2}
    )


def test_leaks_in_rows_of_null_and_repeated_ids(spark):
    item = "what is the capital of the northern province and how many people live there in spring"
    rows = [(1, "a b c " + item), (1, "clean"), (None, item + " d"), (None, "clean too"), (2, None), (2, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", _leaky string")
    left = without_leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(1, "clean"), (None, "clean too"), (2, None), (2, "")])


def test_vectors_of_unequal_length_and_repeated_queries(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(60)] + [(100 + i, [1.0] * 7) for i in range(5)] + [(200, [2.0])]
    queries = [rows[0], (0, rows[1][1]), rows[5], (100, [1.0] * 7)]
    schema = "vec_id long, embedding array<double>"
    found = search(spark.createDataFrame(rows, schema), spark.createDataFrame(queries, schema)).collect()
    assert Counter(r.query_id for r in found) == {0: 5, 5: 5}
    x = np.array([v for _, v in rows[:60]])
    for q in (0, 5):
        v = np.array(min(v for i, v in queries if i == q))
        score = x @ v / np.linalg.norm(x, axis=1) / np.linalg.norm(v)
        score[q] = -2
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [i for _, i, _ in mine] == np.argsort(-score, kind="stable")[:5].tolist()
        assert [s for *_, s in mine] == pytest.approx(sorted(score, reverse=True)[:5])


def test_prior_weight_is_found_again(spark):
    """Shares drawn around one mean with a weight of 30 pages, with none, and with nothing to tell by."""
    rnd = np.random.default_rng(4)
    n = rnd.integers(5, 80, size=4000)
    schema = "n long, bad long, prior double"

    def weight(shares):
        rows = [(int(k), int(rnd.binomial(k, p)), 0.3) for k, p in zip(n, shares)]
        return prior_weight(spark.createDataFrame(rows, schema))

    assert 25 < weight(rnd.beta(9, 21, size=len(n))) < 36
    assert weight(np.full(len(n), 0.3)) > 400
    assert prior_weight(spark.createDataFrame([(1, 1, 0.3)], schema)) == DEFAULT_WEIGHT
    assert prior_weight(spark.createDataFrame([(10, 3, 0.3)], schema)) == MOST_WEIGHT


def test_own_pages_are_in_no_prior(spark):
    rows = [("a.x.com", 1)] * 8 + [("b.x.com", 0)] * 2 + [("c.y.org", 0)] * 10 + [("new.x.com", None)]
    found = {r.host: r for r in host_reputation(spark.createDataFrame(rows, "host string, bad int"), Shrinkage(weight=4.0)).collect()}
    com, x = 0.0, (0 + 4 * 0.0) / (0 + 4)  # all other suffixes are good; x.com is all of com
    assert found["a.x.com"].mean == pytest.approx((8 + 4 * ((8 - 8 + 4 * x) / (2 + 4))) / 12)
    assert found["b.x.com"].mean == pytest.approx((0 + 4 * ((8 + 4 * x) / (8 + 4))) / 6)
    assert found["new.x.com"].mean == pytest.approx((8 + 4 * x) / (10 + 4)) and com == 0.0
    assert found["c.y.org"].mean == pytest.approx(4 * (0 + 4 * 0.8) / 4 / 14)
