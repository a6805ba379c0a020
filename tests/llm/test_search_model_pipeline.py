from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidegauge.llm import hilbert, katz

# -- nearest neighbours ---------------------------------------------------------------


def plain_nearest(rows, asks, k):
    """{query id: [(score, id)...]}; equal rows count once."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[(i, tuple(v))] = None
    out = {}
    for i, v in good:
        if asks(i):
            scores = [(-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def test_hilbert_visits_every_cell_once_and_steps_to_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert.hilbert_keys(cells, 3).astype(int)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_small_tables_are_searched_whole(spark):
    noise = random.Random(9)
    rows = [(i, [noise.uniform(-2, 2) for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # copies of a query
    rows += [rows[5], (200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [float("inf")] + [1.0] * 5), (None, rows[3][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    found = defaultdict(list)
    for r in hilbert.nearest(frame, F.col("vec_id") % 20 == 0, k=5, curves=4).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    expected = plain_nearest(rows, lambda i: i % 20 == 0, 5)
    assert {q: [i for i, _ in a] for q, a in found.items()} == {q: [i for i, _ in a] for q, a in expected.items()}
    assert all(abs(x[1] - y[1]) < 1e-12 for q in expected for x, y in zip(found[q], expected[q]))


def test_few_candidates_and_empty_tables(spark):
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    rows = hilbert.nearest(three, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows] == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert hilbert.nearest(three.filter("false"), F.col("vec_id") == 0).count() == 0
    assert hilbert.nearest(three, F.col("vec_id") == 9).count() == 0


def test_recall_of_short_windows(spark):
    noise = np.random.default_rng(3)
    centres = noise.standard_normal((40, 16))
    vectors = centres[noise.integers(0, 40, 2000)] + 0.3 * noise.standard_normal((2000, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in hilbert.nearest(frame, F.col("vec_id") % 20 == 0, k=10, curves=8).collect():
        found[r["query_id"]].add(r["vec_id"])
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -9)
    hits = [len(found[q] & set(np.argsort(-scores[q])[:10].tolist())) for q in range(0, 2000, 20)]
    assert sum(hits) / (10 * len(hits)) >= 0.9


# -- language model ---------------------------------------------------------------------


def plain_scores(rows, order):
    """Katz by recursion over dictionaries. `rows`: (id, train, text)."""
    grams = [None] + [Counter() for _ in range(order)]
    for _, train, text in rows:
        if train:
            tokens = ["<s>"] * (order - 1) + (text or "").encode().lower().split() + [None]
            for j in range(order - 1, len(tokens)):
                for n in range(1, order + 1):
                    grams[n][tuple(tokens[j - n + 1 : j + 1])] += 1
    total, kinds = sum(grams[1].values()), len(grams[1])
    discount, followers = [None], [None]
    for n in range(1, order + 1):
        of = Counter(grams[n].values())
        discount.append(katz.discounts(np.array([of[r] for r in range(1, katz.DISCOUNTED + 2)])))
        after = defaultdict(list)
        for gram, count in grams[n].items():
            after[gram[:-1]].append((gram[-1], count))
        followers.append(after)
    d = lambda n, c: discount[n][min(c, katz.DISCOUNTED + 1)]
    lost_words = sum((1 - d(1, c)) * c for c in grams[1].values())

    def p(gram):
        n, count = len(gram), grams[len(gram)][gram]
        if n == 1:
            if not total:
                return 1.0
            if not lost_words:
                return max(count, 1) / (total + 1)
            return d(1, count) * count / total if count else lost_words / total
        after = followers[n].get(gram[:-1])
        if not after:
            return p(gram[1:])
        lost = sum((1 - d(n, c)) * c for _, c in after)
        below = sum(c for _, c in after) + (lost <= 1e-12)
        if count:
            return d(n, count) * count / below
        left = (lost if lost > 1e-12 else 1) / below
        return left / (1 - sum(p(gram[1:-1] + (w,)) for w, _ in after)) * p(gram[1:])

    out = []
    for doc, _, text in rows:
        words = (text or "").encode().lower().split() + [None]
        tokens = ["<s>"] * (order - 1) + words
        score = sum(math.log10(p(tuple(tokens[j : j + order]))) for j in range(len(words)))
        base = sum(math.log10((grams[1][(w,)] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        out.append((str(doc), len(words), sum(grams[1][(w,)] > 0 for w in words), total, round(base, 6), round(score, 6)))
    every = [(w,) for (w,) in grams[1]] + [("never seen",)]
    for context in list(followers[order])[:5]:
        assert abs(sum(p(context + w) for w in every) - 1) < 1e-9
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    noise = random.Random(8)
    words = [f"W{int(noise.paretovariate(0.9))}" for _ in range(4000)]
    rows = [(i, i % 5 != 1, " ".join(words[noise.randrange(3900) :][: noise.randint(1, 60)])) for i in range(80)]
    return rows + [(90, True, None), (91, True, ""), (92, False, "only here x y"), (93, None, "w1 w2"), (5, True, "same id"), (5, True, "same id"), (None, False, "no id")]


@pytest.mark.parametrize("order,bytes_,part", [(2, 1 << 20, 1 << 20), (2, 700, 20), (3, 900, 15), (1, 500, 10)])
def test_scores_equal_recursion(spark, corpus, order, bytes_, part):
    docs = spark.createDataFrame([(*r, False, 1.5) for r in corpus], "doc_id long, train boolean, text string, held_out boolean, score double")
    found = katz.score_texts(docs, order=order, batch_bytes=bytes_, part_tokens=part).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in found)
    for a, b in zip(got, plain_scores(corpus, order), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=2e-6)


def test_scores_without_training_rows(spark):
    docs = spark.createDataFrame([(1, False, "a b", True)], "doc_id long, train boolean, text string, held_out boolean")
    row = katz.score_texts(docs).collect()[0]
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)
    assert katz.score_texts(docs.filter("false")).count() == 0


def test_discounts_are_proportional_and_safe():
    d = katz.discounts(np.array([1000, 400, 220, 140, 100, 75]))
    assert all(0 < x <= 1 for x in d[1:6]) and d[6] == 1 and d[1] < d[3]
    for stats in ([0] * 6, [5, 0, 0, 0, 0, 0], [0, 3, 0, 0, 0, 0], [1, 10, 100, 1000, 1, 1]):
        d = katz.discounts(np.array(stats))
        assert ((d[1:] > 0) & (d[1:] <= 1)).all() and d[1] < 1


# -- pipeline ---------------------------------------------------------------------------


def test_stages_keep_columns_and_survive_odd_rows(spark, tmp_path):
    noise = random.Random(1)
    item = "the very secret answer to question number nine is written on this page only"
    passage = " ".join(f"shared{i}" for i in range(30))
    prose = lambda: " ".join(noise.choice("abcdefgh") + str(noise.randrange(500)) for _ in range(40))
    rows = [(i, prose(), "en", f"s{i}", 1) for i in range(40)]
    rows[3] = (3, rows[2][1], "en", "copy", 1)
    rows[6], rows[9] = (6, f"{prose()} {passage}", "en", "first", 1), (9, f"{passage} {prose()}", "en", "second", 1)
    rows[12] = (12, f"{prose()} {item}", "en", "leak", 1)
    rows += [rows[20], (50, None, None, None, None), (51, "", "en", "x", 0), (None, prose(), "en", "null", 1)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("score", F.lit("mine")).withColumn("later", F.lit(7)).withColumn("n_removed", F.lit(None).cast("int"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    table = docs
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, table, str(tmp_path))
        result.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = table.collect()
        if name != "pieces":
            assert table.columns == [*names, "score", "later", "n_removed"]
            assert all(r["score"] == "mine" and r["later"] == 7 and r["n_removed"] is None for r in kept[name])
    ids = {name: sorted(str(r["doc_id"]) for r in found) for name, found in kept.items()}
    assert len(ids["toxicity"]) == len(rows)
    everyone = [str(r[0]) for r in rows]
    near = sorted(everyone)
    near.remove("3")
    near.remove("20")
    assert ids["near_duplicates"] == near
    assert ids["repeats"] == near
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept["repeats"]}
    assert passage in texts[6][0] and "shared" not in texts[9][0] and texts[9][1] == len(texts[9][0])
    assert texts[0] == (rows[0][1], 1)
    assert ids["decontamination"] == [i for i in near if i != "12"] == ids["pieces"]
    assert all(r["round_trip"] for r in kept["pieces"])
    empty = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def plain_near_copies(rows):
    """Ids and texts that stay: one row of each component of a Jaccard similarity of 0.8 or more."""

    def shingled(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [shingled(text) for _, text in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for row, r in zip(rows, root):
        least[r] = min(least.get(r, row), row)
    return sorted(least.values())


def test_near_copies_of_four_fifths_leave_one_row(spark, tmp_path):
    noise = random.Random(3)
    words = lambda n: [f"Word{noise.randrange(10**6)}" for _ in range(n)]

    def edited(line, edits):
        line = list(line)
        for at in noise.sample(range(len(line)), edits):
            line[at] = f"edit{noise.randrange(10**6)}"
        return " ".join(line)

    rows = []
    for number in range(40):
        line = words(noise.randint(60, 200))
        rows += [(10 * number + 1, " ".join(line)), (10 * number + 2, edited(line, noise.randint(1, len(line) // 30)))]
    base = words(150)
    rows += [(1000 + i, edited(base, noise.randint(0, 4))) for i in range(60)]
    chain = words(100)
    for i in range(6):
        rows.append((2000 - i, " ".join(chain[4 * i :] + words(4 * i))))
    # Rows of one id: one is a copy of a smaller id, another is on its own.
    rows += [(5000, rows[0][1].upper()), (5000, " ".join(words(70))), (5001, "one two"), (5002, "ONE  two"), (5003, "one three")]
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect())
    assert kept == plain_near_copies(rows)
    assert len(kept) < len(rows) - 60 and sum(i == 5000 for i, _ in kept) == 1
    assert corpus_pipeline.drop_near_duplicates(spark, docs.filter("doc_id = 5003"), folder).count() == 1


def test_registered_queries():
    names = entry.queries()
    for number, name in enumerate(
        ("hilbert_search", "piece_codec", "token_counts", "katz", "suffix_dedup", "simhash", "decontamination", "substring_dedup", "toxicity", "quality"), 1
    ):
        assert f"op{number}_{name}" in names
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()


def test_fold_is_crc32_of_the_text(spark):
    from tidegauge.llm.labelled import fold

    rows = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)
