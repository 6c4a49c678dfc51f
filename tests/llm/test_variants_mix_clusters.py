"""Spelling variants, source mixing and centroid clustering against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.sources.tables import read_table
from llm import spelling, suite
from llm.mixing import mix_sources, ranked, word_count
from llm.spelling import LETTERS, Shards, WordHashes, near_pairs, spelling_variants
from llm.va_clusters import Assigner, VaFile, cluster_vectors, exact
from tests.llm.test_operators import AWKWARD, WORD

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def brute_variants(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    form, out = {}, {}
    for w, n in words.items():
        others = [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if near(w, x)]
        top = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = top if top is not None and words[top] >= 2 * n else None
        out[w] = (n, len(others), form[w], words[form[w]] if form[w] else None)
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (out[w][2], root, out[w][0], out[w][1], out[w][3])
    return out


def variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def misspelt(seed, docs=40):
    rnd = random.Random(seed)
    letters = "abcdeéößÿ÷"
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(5, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "a" * 40, "a" * 41]
    rows = []
    for d in range(docs):
        words = []
        for _ in range(120):
            w = rnd.choice(base)
            if rnd.random() < 0.4:
                i = rnd.randrange(len(w))
                w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i:]])
            words.append(w.upper() if rnd.random() < 0.2 and w.isascii() else w)
        rows.append((d, " ".join(words)))
    return [*rows, (docs, "chainaa " * 40 + "chainab " * 15 + "chainbb " * 5)]  # a form that has a form itself


def test_variants_brute_force(spark):
    rows = misspelt(1)
    expected = brute_variants(rows)
    assert variants(spelling_variants(spark.createDataFrame(rows, DOCS))) == expected
    assert any(f for f, *_ in expected.values()) and any(r != w and f != r for w, (f, r, *_) in expected.items())


def test_variants_in_small_pieces_and_pages(spark, monkeypatch):
    """The result depends on no piece, slice or page size, nor on how full the filters are."""
    rows = misspelt(2)
    vocabulary = spark.createDataFrame([(w, v[2]) for w, v in brute_variants(rows).items()], "word string, n long")
    expected = {tuple(r) for r in near_pairs(vocabulary).collect()}
    for name, value in (("PAGE_BLOCKS", 3), ("BITS", 2), ("WORDS_CHARS", 20), ("EDIT_CHARS", 7)):
        monkeypatch.setattr(spelling, name, value)
    assert {tuple(r) for r in near_pairs(vocabulary).collect()} == expected


def test_edit_hashes():
    words = ["hello", "aab", "ÿ÷zz", "hallo", "hell"]
    own = WordHashes(words)
    known = dict(zip(words, own.own().tolist()))
    i, hashes = own.deletions()
    made = [words[own.owner[k]][: own.at[k]] + words[own.owner[k]][own.at[k] + 1 :] for k in i]
    assert made.count("helo") == 1 and made.count("ab") == 1
    assert hashes.tolist() == WordHashes(made).own().tolist()
    for i, letters, hashes in own.replacements():
        made = [words[own.owner[k]][: own.at[k]] + chr(c) + words[own.owner[k]][own.at[k] + 1 :] for k, c in zip(i, letters)]
        made_from = set(zip(own.owner[i].tolist(), made))
        assert len(made_from) == len(made) == sum(int((LETTERS > ord(c)).sum()) for w in words for c in w)
        assert hashes.tolist() == WordHashes(made).own().tolist()
        assert known["hello"] in hashes.tolist()  # from "hallo"
    shards = Shards({5: 1000, 7: 3})
    block, held = shards.place(own.own(), own.lengths)
    assert held.tolist() == [True, False, False, True, False] and 0 <= block[0] < shards.total


def test_variants_awkward(spark):
    long = "x" * 30_000
    rows = [*AWKWARD, (7, " ".join([long] * 3)), (8, " ".join([long + "y"] * 9)), (None, "Wörter " * 4), (9, "Worter " * 9)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("word", F.lit(1)).withColumn("n", F.lit("x")).withColumn("form", F.lit(None).cast("int"))
    assert variants(spelling_variants(docs)) == brute_variants(rows)
    assert spelling_variants(docs.limit(0)).count() == 0
    assert spelling_variants(docs.where("doc_id < 4")).count() == 0


def targets(sizes, weights=(5, 2, 1)):
    """The published rule: share out, stop at twice the size, reshare the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    given, left, open_ = dict.fromkeys(sizes, Fraction(0)), Fraction(3, 2) * sum(sizes.values()), set(sizes)
    while left and open_:
        total = sum(weight[s] for s in open_)
        given = {s: g + (left * weight[s] / total if s in open_ else 0) for s, g in given.items()}
        left = sum(max(0, g - 2 * sizes[s]) for s, g in given.items())
        open_ = {s for s in open_ if given[s] < 2 * sizes[s]}
        given = {s: min(g, 2 * sizes[s]) for s, g in given.items()}
    return given


def check_mix(rows, found, slack):
    sizes = defaultdict(int)
    for d, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = targets(sizes)
    by_id = {r.doc_id: r for r in found}
    assert Counter(r.doc_id for r in found) == Counter(d for d, *_ in rows)
    taken, asked = defaultdict(int), defaultdict(float)
    for d, text, source in rows:
        r = by_id[d]
        assert r.size == len(WORD.findall(text or "")) and r.source_size == sizes[source]
        assert r.target == pytest.approx(float(want[source]), rel=1e-12, abs=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[source] += r.taken
        asked[source] += r.rate * r.size
    for source, target in want.items():
        assert asked[source] == pytest.approx(float(target), rel=1e-6, abs=1e-6)
        assert abs(taken[source] - target) <= slack
    # Exponential tilt: one multiplier a source wherever the rate is below its limit.
    tilt = defaultdict(list)
    for d, _, source in rows:
        r = by_id[d]
        if r.size and r.rate < 2 - 1e-9:
            tilt[source].append(math.log(r.rate / 1.5) / r.size)
    for slopes in tilt.values():
        assert max(slopes) - min(slopes) < 1e-9


def text_of(n):
    return " ".join(["w"] * n)


def test_mix_against_the_rule_and_its_optimum(spark):
    rnd = random.Random(3)
    rows = []
    for d in range(3000):
        source = "hot" if d % 3 == 0 else rnd.choice(["a", "é", "Z", "b10", "b9", None, "tiny"])
        if source == "tiny" and d > 60:
            source = "a"
        rows.append((d, text_of(int(rnd.lognormvariate(3, 1)) + 1), source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mix_sources(docs).collect()
    check_mix(rows, found, slack=12)
    again = mix_sources(docs.repartition(7, "text")).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def test_mix_has_the_least_entropy(spark):
    """No shift of rates that keeps the words of a source lowers the relative entropy."""
    rows = [(d, text_of(1 + (d * 7) % 23), "abc"[d % 3]) for d in range(90)]
    found = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    rnd = random.Random(0)
    free = [r for r in found if r.rate < 2 - 1e-6 and r.doc_id % 3 == 2]

    def cost(r):
        return r * math.log(r / 1.5) - r

    for _ in range(200):
        x, y = rnd.sample(free, 2)
        for step in (1e-3, -1e-3):
            a, b = x.rate + step / x.size, y.rate - step / y.size
            assert cost(a) + cost(b) >= cost(x.rate) + cost(y.rate) - 1e-12


def test_mix_awkward(spark):
    rows = [(d, t, s) for (d, t), s in zip(AWKWARD, ["a", "a", None, "b", "b", None, "", "c"])]
    schema = "doc_id long, text string, source string"
    docs = spark.createDataFrame(rows, schema).withColumn("size", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("m", F.lit(None).cast("int"))
    found = mix_sources(docs).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((d, len(WORD.findall(t or ""))) for d, t, _ in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    assert mix_sources(docs.limit(0)).count() == 0
    nothing = mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0), (0, 0.0, 0)]
    equal = mix_sources(spark.createDataFrame([(7, "one two", "a")] * 25_000 + [(8, "z", "b")], schema))
    seven = equal.where("doc_id = 7")
    assert seven.count() == 25_000 and seven.agg(F.max("taken") - F.min("taken")).first()[0] <= 2


def test_word_count_and_rank(spark):
    texts = [None, "", " ", "\t\n", "a", " a", "a ", " a\tb c \r\n d ", "\x0b\x0c", "é 漢 👍", "a\x1cb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [len(WORD.findall(t or "")) for t in texts]
    names = [None, "", "A", "a", "b10", "b9", "é", "\U0001f44d", "￿", *(f"s{i:03}" for i in range(300))]
    found = ranked(spark.createDataFrame([(n,) for n in names], "source string").repartition(8)).collect()
    order = sorted((n for n in names if n is not None), key=lambda n: n.encode()) + [None]
    assert {r.source: r["rank"] for r in found} == {n: i for i, n in enumerate(order)}


def brute_clusters(rows, k=8, rounds=10):
    kept = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres, x = np.array([v for _, v in start]), np.array([v for _, v in kept])
    for _ in range(rounds):
        own = exact(x, centres).argmin(axis=1)
        centres = np.array([x[own == c].sum(axis=0) // (own == c).sum() if (own == c).any() else centres[c] for c in range(len(centres))])
    d = exact(x, centres)
    own, least = d.argmin(axis=1), d.min(axis=1)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    return sorted((i, int(c), int(e), int(least[own == c].sum()), int(least.sum()), names[c]) for (i, _), c, e in zip(kept, own, least))


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_clusters_brute_force(spark, bits):
    """Spread and clustered vectors, a third of them equal, whatever the width of the cells."""
    rnd = np.random.default_rng(bits)
    centre = rnd.normal(size=(5, 64))
    rows = [(i, (centre[i % 5] + rnd.normal(size=64) * (0.05 if i % 2 else 1)).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.25, -0.5] * 32) for i in range(200)]
    found = cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), bits=bits, sample=100)
    assert sorted(map(tuple, found.collect())) == brute_clusters(rows)


def test_cells_never_contradict_distances():
    rnd = np.random.default_rng(2)
    rows = rnd.integers(-600, 600, size=(2000, 6))
    for bits in (1, 4, 8):
        file = VaFile.fit(rows[:50], rows.min(axis=0), rows.max(axis=0), bits)
        cells = file.cells(rows)
        dims = np.arange(6)
        assert ((file.low[dims, cells] <= rows) & (rows <= file.high[dims, cells])).all()
        for centres in (rows[:7], np.vstack([rows[:3], rows[:3]]), rows[:1]):
            known = Assigner(file, centres).known(cells)
            nearest = exact(rows, centres).argmin(axis=1)
            assert ((known < 0) | (known == nearest)).all()
            assert bits < 8 or (known >= 0).mean() > 0.5


def test_clusters_awkward(spark):
    rnd = np.random.default_rng(5)
    good = [(i, rnd.normal(size=64).tolist()) for i in range(6)]
    bad = [(10, None), (11, []), (12, [1.0] * 63), (13, [None] + [0.0] * 63), (14, [math.nan] * 64), (15, [math.inf] * 64), (16, [2e5] * 64)]
    rows = [*good, (3, good[3][1]), (3, [0.0] * 64), (20, [0.0] * 64)]
    docs = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("page", F.lit("x"))
    assert sorted(map(tuple, cluster_vectors(docs).collect())) == brute_clusters(rows)
    assert cluster_vectors(docs.limit(0)).count() == 0 and cluster_vectors(docs.where("vec_id > 9 and vec_id < 20")).count() == 0
    one = cluster_vectors(docs.where("vec_id = 20")).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in one] == [(20, 0, 0, 0)]
    unnamed = spark.createDataFrame([(None, [1.0] * 64), (1, [2.0] * 64)], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.cluster for r in cluster_vectors(unnamed).collect()} == {1: 0, None: 1}


def test_registered_mix_on_the_table(spark):
    rows = [tuple(r) for r in read_table(spark, FOLDER, "documents", ["doc_id", "text", "source"]).collect()]
    check_mix(rows, suite.op12_entropy_mix(spark, FOLDER).collect(), slack=60)
