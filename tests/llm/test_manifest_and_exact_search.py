from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import lexical, merkle, pivots

# -- Merkle manifest ----------------------------------------------------------------------


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    """The manifest by lists: (doc_id, leaf, subroot, root, proof, folded, verified) as text keys."""

    def leaf(row, text):
        values = [row[0], row[3], row[2], row[4], text]
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def levels(hashes):
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    items = []
    for row in rows:
        text = row[1]
        if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        items.append((row[0], row[2], leaf(row, row[1]), leaf(row, text)))
    trees = {}
    for lang in sorted({x[1] for x in items}, key=lambda v: (v is not None, (v or "").encode())):
        own = sorted((x for x in items if x[1] == lang), key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
        trees[lang] = own, levels([x[2] for x in own])
    top = levels([held[-1][0] for _, held in trees.values()])
    out = []
    for number, (own, held) in enumerate(trees.values()):
        for place, item in enumerate(own):
            proof, fold = "", item[3]
            for tree, at in ((held, place), (top, number)):
                for hashes in tree[:-1]:
                    first = at // 8 * 8
                    left, right = "".join(hashes[first:at]), "".join(hashes[at + 1 : first + 8])
                    proof, fold, at = proof + left + right, digest(left + fold + right), at // 8
            out.append((str(item[0]), item[2], held[-1][0], top[-1][0], digest(proof), fold, fold == top[-1][0]))
    return sorted(out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "A", None, "s", 1), (None, None, None, None, None), (1, "A", None, "s", 1), (1, "b", "é", "s", 1), (7, "LONE", "zz", "s", None)]
MANY = ODD + [(3, "Same", "fr", "x", 2)] * 20 + [(i, "Xy" * i, "en", "q", i) for i in range(70)] + [(99, "Long " * 200_000, "en", "q", 5)]


@pytest.mark.parametrize("rows", [MANY, ODD[4:], ODD[:3], MANY[5:9], [(i, "T", f"l{i:02}", "s", 1) for i in range(20)]], ids=["many", "lone", "null", "copies", "languages"])
@pytest.mark.parametrize("limit", [10**6, 3])
def test_manifest_equals_lists(spark, rows, limit):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1)).withColumn("root", F.lit("mine")).withColumn("place", F.lit(2))
    found = sorted((str(r[0]), *r[1:]) for r in merkle.prove(docs, limit).collect())
    assert found == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    empty = merkle.prove(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    assert empty.columns == merkle.prove(spark.createDataFrame(ODD, SCHEMA)).columns


def test_places_are_numbers_of_the_sorted_table(spark):
    rows = spark.range(2000).selectExpr("id * 7919 % 97 as k", "id").repartition(7)
    placed = merkle.numbered(rows, "k").select("place", "k").collect()
    assert sorted(r["place"] for r in placed) == list(range(2000))
    assert [r["k"] for r in sorted(placed)] == sorted(i * 7919 % 97 for i in range(2000))


# -- exact top-k --------------------------------------------------------------------------


def plain_top(rows, asks, k):
    good = [
        (i, [math.floor(1024 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and len(v) == len(rows[0][1]) and all(x is not None and math.isfinite(x) and abs(x) < 1e9 for x in v)
    ]
    out = []
    for i, v in good:
        if asks(i):
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:k]
            out += [(i, rank, j, -score) for rank, (score, j) in enumerate(best, 1)]
    return sorted(out)


def clustered(count=400, width=12):
    noise = np.random.default_rng(1)
    centres = noise.standard_normal((8, width)) * 3
    return [(i, (centres[i % 8] + 0.2 * noise.standard_normal(width)).astype(float).tolist()) for i in range(count)]


@pytest.mark.parametrize("options", [{}, {"block_rows": 30, "queries": 3, "pivots": 5}, {"pivots": 1}])
def test_top_k_equals_all_pairs(spark, options):
    rows = clustered()
    rows += [(500 + i, rows[3][1]) for i in range(40)] + [rows[0], rows[20]]  # copies, and rows that are there twice
    rows += [(600, None), (601, [None] * 12), (602, [float("nan")] * 12), (603, [float("inf")] + [0.0] * 11), (620, [0.0] * 12), (None, rows[1][1]), (640, [1.0])]
    rows += [(660, [1e300] * 12), (661, [-5e5] * 12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({name: F.lit(1) for name in ("row", "d", "home", "score")})
    found = sorted(tuple(r) for r in pivots.exact_top_k(frame, F.col("vec_id") % 20 == 0, k=7, **options).collect())
    assert found == plain_top(rows, lambda i: i % 20 == 0, 7)


def test_few_candidates_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in pivots.exact_top_k(frame, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 1024 * 512), (0, 2, 2, 0)]
    assert pivots.exact_top_k(frame.filter("false"), F.col("vec_id") == 0).count() == 0
    assert pivots.exact_top_k(frame, F.col("vec_id") == 9).count() == 0
    bare = spark.createDataFrame([(i, []) for i in range(4)], "vec_id long, embedding array<float>")
    assert sorted(r["vec_id"] for r in pivots.exact_top_k(bare, F.col("vec_id") == 0).collect()) == [1, 2, 3]


def test_bounds_hold_and_elimination_saves_work():
    rows = np.floor(1024 * np.array([v for _, v in clustered(2000)]))
    chosen = pivots.choose(rows, 16)
    d = pivots._distances(rows, chosen).astype(np.float32).astype(np.float64)
    squares, ids = pivots._squares(rows), np.arange(len(rows))
    evaluated = 0
    for q in range(0, 2000, 250):
        lower = np.abs(d[q] - d).max(axis=1)
        bound = pivots._bound(lower, d[q].max() + d.max(), squares[q] + squares)
        scores = rows @ rows[q]
        assert (bound >= scores).all()
        order = np.argsort(-bound, kind="stable")
        best, found, seen = pivots.eliminate(rows[q], order, bound, rows, ids, -(2**63), 10, True)
        expected = pivots.top(scores, ids, 10)
        assert best.tolist() == expected.tolist() and found.tolist() == scores[expected].astype(int).tolist()
        evaluated += min(seen, len(rows))
    assert evaluated < 8 * len(rows) / 2


def test_products_beyond_doubles_are_exact():
    big = np.array([[2.0**30 + 1, 3.0], [2.0**30 - 1, 5.0]])
    query = np.array([2.0**30 + 3, 7.0])
    assert pivots._products(big, query, False).tolist() == [(2**30 + 1) * (2**30 + 3) + 21, (2**30 - 1) * (2**30 + 3) + 35]


# -- ranked search --------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def plain_ranks(docs, items, k=10):
    held = [(i, Counter(words(text))) for i, text in docs]
    number, length = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for doc, counts in held:
            if doc is not None and counts:
                m = 100 - 75 + (75 * sum(counts.values()) * number) // length
                score = sum(
                    n * math.floor(1000 * math.log((2 * number + 2) / (2 * df[w] + 1))) * ((10**9 * counts[w]) // (1000 * counts[w] + 8 * m))
                    for w, n in Counter(words(text)).items() if counts[w]
                )
                if score > 0:
                    scored.append((-score, doc))
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    noise = random.Random(2)
    word = lambda: noise.choice(["a", "B", "é", "ÑX", "c3", "Ünï", "don't", "x_y", "q"]) + str(noise.randrange(6))
    docs = [(i, " ".join(word() for _ in range(noise.randint(0, 30)))) for i in range(80)]
    docs += [(90, None), (91, ""), (92, " \x00 !"), (93, " ".join(word() for _ in range(30_000))), (None, "a1 b2 c3"), (5, "a1 a1"), (5, "a1 a1")]
    docs += [(100 + i, "tie a2") for i in range(20)]
    items = [(i, " ".join(word() for _ in range(8))) for i in range(20)]
    items += [(20, None), (21, ""), (22, "zzz"), (23, "a1 a1 a1 b2"), (None, "a3 b1"), (24, "tie"), (24, "tie"), (25, " ".join(word() for _ in range(400)))]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_words": 20}, {"reach": 1}, {"k": 3}])
def test_ranks_equal_brute_force(spark, texts, options):
    docs, items = texts
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({name: F.lit("x") for name in ("n", "terms", "item_id", "score")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    found = sorted((tuple(r) for r in lexical.ranked(table, asked, **options).collect()), key=str)
    assert found == plain_ranks(docs, items, options.get("k", 10))


def test_ranks_of_nothing(spark, texts):
    docs, items = texts
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.ranked(table.filter("false"), asked).count() == 0
    assert lexical.ranked(table, asked.filter("false")).count() == 0
    assert lexical.ranked(table.filter("text = ''"), asked).count() == 0


def test_long_texts_are_counted_in_pieces(spark, texts):
    docs = spark.createDataFrame([*texts[0], (94, "x" * 5000 + " a1"), (95, " " * 3000 + "a1")], "doc_id long, text string")
    known = [w.encode() for w in sorted({w for _, t in texts[1] for w in words(t)})]
    whole, pieces = (sorted(map(tuple, lexical.term_counts(docs, known, step=size).collect()), key=str) for size in (1 << 22, 64))
    assert whole == pieces and {r[0]: r[1] for r in whole}[94] == 2


def test_shared_sums_are_made_once():
    noise = random.Random(7)
    common = [f"w{i}" for i in range(12)]
    items = [" ".join(noise.sample(common, 8) + [f"own{i}"] + ["w1"] * (i % 3)) for i in range(40)]
    graph = lexical.share(list(range(40)), items)
    terms = sum(len(words(t)) for t in items)
    assert len(graph.pairs) + sum(map(len, graph.items)) < 0.7 * terms
    rows = np.zeros((graph.rows, 5), dtype=np.int64)
    rows[: len(graph.terms)] = np.random.default_rng(1).integers(0, 1000, (len(graph.terms), 5))
    value = {t.decode(): rows[i].copy() for i, t in enumerate(graph.terms)}
    scores = lexical.accumulate(graph, rows)
    for item, text in enumerate(items):
        assert scores[item].tolist() == sum(value[w] for w in words(text)).tolist()
    assert all(a < len(graph.terms) + number and b < len(graph.terms) + number for number, (a, b) in enumerate(graph.pairs))
    assert lexical.mine([[1, 2, 3], [4, 5]], 9) == ([], [[1, 2, 3], [4, 5]])
