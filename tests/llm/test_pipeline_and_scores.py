from __future__ import annotations

import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_search_model_pipeline import plain_near_copies
from tests.llm.test_text_operators import brute_runs, fold_of, plain_tiles
from tidegauge.llm import quality, toxicity
from tidegauge.llm.labelled import fold

MASK = 2**64 - 1
M1, M2, M3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def plain_mix(h):
    h = (h ^ (h >> 30)) * M2 & MASK
    h = (h ^ (h >> 27)) * M3 & MASK
    return h ^ (h >> 31)


def plain_hash(word, most=None):
    word = word if most is None else word[:most]
    out = (len(word) * M1 + 0x5851F42D4C957F2D) & MASK
    for lane in range(0, len(word), 8):
        out = plain_mix(out ^ (int.from_bytes(word[lane : lane + 8], "little") * M1 + lane // 8) & MASK)
    return out


EDGES = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def plain_sentences(text):
    """Sentences of a text as lists of trimmed words in lower case, with the number of their first word."""
    found, number = [], 0
    for line in (text or "").encode().lower().split(b"\n"):
        current = []
        for word in line.split():
            end = word[-1:] in (b".", b"!", b"?")
            for _ in range(3):
                word = word[1:] if len(word) > 1 and word[:1] in [bytes([x]) for x in EDGES] else word
                word = word[:-1] if len(word) > 1 and word[-1:] in [bytes([x]) for x in EDGES] else word
            current.append(word)
            if end:
                found.append((number, current))
                number, current = number + len(current), []
        if current:
            found.append((number, current))
            number += len(current)
    return found


def plain_toxicity(text, model):
    bits = int(math.log2(len(model.weights)))
    safe = 1.0
    for _, words in plain_sentences(text):
        linear = model.bias
        for word in words:
            for salt, most in ((1, None), (2, 4), (3, 6)):
                linear += float(model.weights[plain_mix(plain_hash(word, most) ^ salt) >> (64 - bits)])
        safe *= 1 - 1 / (1 + math.exp(-linear))
    return 1 - safe


def test_noisy_or_equals_plain_python(spark):
    noise = random.Random(4)
    words = ["Table,", "river", "(green)", "walks!", "ünder", "stone?", "a-b", "scum", "Idiot!!", "x" * 300, "...", "line\nbreak", "it's"]
    rows = [(i, " ".join(noise.choice(words) for _ in range(noise.randint(0, 40)))) for i in range(150)] + [(200, None), (201, ""), (202, " \n "), (203, "Idiot " * 20_000)]
    marks = [(i, int("scum" in t or "Idiot" in t)) for i, t in rows[:150]]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    clash = docs.withColumns({name: F.lit("mine") for name in ("label", "worst_from", "owner")})
    scored = model.documents(clash).collect()
    assert len(scored) == len(rows) and all(r["owner"] == r["label"] == "mine" for r in scored)
    for row in scored:
        assert row["score"] == pytest.approx(plain_toxicity(row["text"], model), abs=1e-6), row["doc_id"]
    assert {r["doc_id"]: r["score"] for r in scored}[203] > 0.99
    assert len({round(r["score"], 3) for r in scored}) > 10


KINDS = {4: b"',-.:;?", 5: b"!"}


def plain_kind(c):
    if 97 <= c < 123:
        return 1
    if 65 <= c < 91:
        return 2
    if 48 <= c < 58:
        return 3
    if c >= 128:
        return 7
    return next((kind for kind, held in KINDS.items() if c in held), 6 if 33 <= c < 127 else 0)


def plain_features(text):
    data = (text or "").encode()
    words = data.split()
    size, count, some = max(len(data), 1), len(words), max(len(words), 1)
    lengths = [len(w) for w in words]
    kinds = [plain_kind(c) for c in data]
    mean = sum(lengths) / some
    distinct = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:])) / some
    loud = sum(any(plain_kind(c) == 2 for c in w) and not any(plain_kind(c) == 1 for c in w) for w in words) / some
    values = [sum(k == kind for k in kinds) / size for kind in range(1, 8)]
    values += [
        math.log1p(count) / 8, mean / 8, math.sqrt(max(sum(n * n for n in lengths) / some - mean * mean, 0)) / 8, distinct / some,
        math.log(max(distinct, 1) / some), again, math.sqrt(again), min(again * 20, 1), loud, math.sqrt(loud),
        sum(plain_kind(w[-1]) == 4 for w in words) / some, sum(plain_kind(w[-1]) >= 5 for w in words) / some,
        sum(len(w) == 1 and plain_kind(w[0]) == 6 for w in words) / some, data.count(b"\n") / some, min(some, 50) / 50, float(count == 0),
    ]
    table = [0.0] * quality.SHAPES
    for word in words:
        codes = [{1: 1, 2: 2, 3: 3, 7: 1}.get(plain_kind(c), c + 16) for c in word]
        runs = [c for i, c in enumerate(codes) if i == 0 or c != codes[i - 1]]
        total = sum(plain_mix(c * 67 + min(place, 6)) for place, c in enumerate(runs)) & MASK
        table[plain_mix(total) % quality.SHAPES] += 1
    return values + [math.sqrt(n / some) for n in table]


def test_quality_scores_equal_plain_python(spark):
    noise = random.Random(5)
    words = ["Plain", "words,", "BUY", "now!!!", "a", "#", "x1y2", "déjà", "end.", "same", "same", "\n", "it's", "$$$"]
    rows = [(i, " ".join(noise.choice(words) for _ in range(noise.randint(0, 60)))) for i in range(120)] + [(200, None), (201, ""), (202, "!!!!"), (203, "BUY NOW " * 20_000)]
    texts = pa.array([t for _, t in rows], type=pa.string())
    assert np.allclose(quality.features(texts), np.array([plain_features(t) for _, t in rows]), atol=1e-9)
    marks = [(i, int("BUY" not in t)) for i, t in rows[:120]]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    for row in model.documents(docs.withColumns({name: F.lit("mine") for name in ("side", "label", "score")})).collect():
        held = np.clip((np.array(plain_features(row["text"])) - model.middle) / model.scale, -8, 8)
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-(held @ model.theta[:-1] + model.theta[-1]))), abs=1e-9) and row["side"] == "mine"


# -- pipeline -----------------------------------------------------------------------------


def plain_leaks(text, item):
    """Half of the item's words are covered by tiles of four words or more."""
    trim = lambda w: re.sub(rb"^[!-/:-@\[-`{-~]{0,3}(?=.)|(?<=.)[!-/:-@\[-`{-~]{0,3}$", b"", w)
    a, b = ([trim(w) for w in t.encode().lower().split()] for t in (item, text))
    return len(a) >= 4 and 2 * plain_tiles(a, b, 4) >= len(a)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Toxic documents with and without labels, copies, near copies, shared passages, moved benchmark sentences, a very long text."""
    noise = random.Random(17)
    prose = lambda n: " ".join(f"{noise.choice('bcdfglmnrst')}{noise.choice('aeiou')}{noise.randrange(900)}" + "." * (noise.random() < 0.1) for _ in range(n))
    rows = [[i, prose(noise.randint(40, 120)), "en", f"s{i}", 1] for i in range(260)]
    toxic = [i for i in range(260) if i % 5 == 0]
    for i in toxic:
        rows[i][1] = f"{rows[i][1]} you {noise.choice(['vermin', 'filth'])} get out. {prose(20)}"
    passage, item = prose(40).replace(".", ""), "the first fact is this one here. a second fact follows it closely. and then a third one ends the page"
    for i in (11, 21, 31, 43):
        rows[i][1] = f"{prose(15)} {passage} {prose(15)}"
    a, b, c = item.split(". ")
    rows[51][1] = f"{prose(20)} {c} {prose(5)} {a} {prose(9)} {b} {prose(3)}"
    rows[52][1] = f"{prose(20)} {a} {prose(30)}"
    for copy, (of, edits) in {61: (62, 0), 63: (64, 1), 66: (67, 2), 68: (69, 3)}.items():
        words = prose(150).split()
        rows[of][1] = " ".join(words)
        for _ in range(edits):
            words[noise.randrange(150)] = "edited"
        rows[copy][1] = " ".join(words).upper() if not edits else " ".join(words)
    rows.append([300, prose(60_000) + f" {passage} you filth get out. {prose(10)}", "en", "long", 1])
    # Words that no label speaks of: a text this long would hold every word of the others.
    rows.append([301, " ".join(f"calm{noise.randrange(90)}" for _ in range(60_000)) + f" {passage}", "en", "long", 1])
    rows += [[None, prose(30), None, None, None], [302, None, "en", "x", 0], [303, "", "en", "x", 0], rows[71][:], [71, prose(50), "en", "other", 9]]
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"_id": F.lit(1), "_code": F.lit("c"), "_root": F.create_map(F.lit("k"), F.lit(1)), "places": F.array(F.lit(2))})
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(260) if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, item, toxic


def test_every_stage_equals_plain_python(spark, corpus):
    folder, docs, item, toxic = corpus
    kept, table = {}, spark.read.parquet(f"{folder}/documents.parquet")
    start = [(r["doc_id"], r["text"]) for r in table.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, folder).write.parquet(f"{folder}/{name}")
        table = spark.read.parquet(f"{folder}/{name}")
        if name != "pieces":
            assert table.columns == docs.columns
            kept[name] = [(r["doc_id"], r["text"]) for r in table.collect()]
            assert all((r["_id"], r["_code"], r["_root"], r["places"]) == (1, "c", {"k": 1}, [2]) for r in table.collect())
    order = lambda rows: sorted(rows, key=repr)

    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(fold(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), labels)
    assert order(kept["toxicity"]) == order((i, t) for i, t in start if plain_toxicity(t, model) < 0.5)
    ids = {i for i, _ in kept["toxicity"]}
    held_out = [i for i in toxic if i % 3 == 0 or fold_of(i, 5) == 0]
    assert len(held_out) > 15 and ids == {i for i, _ in start} - {*toxic, 300}

    worded = [(i, t) for i, t in kept["toxicity"] if i is not None and (t or "").split()]
    rest = [(i, t) for i, t in kept["toxicity"] if i is None or not (t or "").split()]
    assert order(kept["near_duplicates"]) == order(plain_near_copies(worded) + rest)
    ids = {i for i, _ in kept["near_duplicates"]}
    assert {61, 63, 66, 68} <= ids and not {62, 64, 67, 69} & ids

    expected = []
    for (doc, text), (words, _, later) in zip(kept["near_duplicates"], brute_runs(kept["near_duplicates"], 13)):
        left = [w for w, gone in zip(words, later) if not gone]
        if not any(later):
            expected.append((doc, text))
        elif left:
            expected.append((doc, b" ".join(left).decode()))
    assert order(kept["repeats"]) == order(expected) and kept["repeats"] != kept["near_duplicates"]
    assert len(dict(kept["repeats"])[301]) < len(dict(kept["near_duplicates"])[301])

    assert order(kept["decontamination"]) == order((i, t) for i, t in kept["repeats"] if not plain_leaks(t or "", item))
    assert 51 not in dict(kept["decontamination"]) and 52 in dict(kept["decontamination"])

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.MODEL))
    coded = [(r["doc_id"], tuple(r["ids"]), r["n_tokens"]) for r in table.collect()]
    assert order(coded) == order((i, tuple(x := library.encode(t or "")), len(x)) for i, t in kept["decontamination"])


def test_rows_of_one_id_are_judged_by_their_texts(spark, tmp_path):
    item = "this is the answer that nobody should have seen before the test"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"before {item} after"), (1, "a clean text of the same id"), (None, f"{item}"), (None, "clean too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["text"] for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()}
    assert kept == {"a clean text of the same id", "clean too"}


def test_recall_of_near_copies_at_the_edge(spark):
    """Pairs with a similarity of 0.8 to 0.86 and no other link between them."""
    from tidegauge.llm import near_copies

    noise, rows = random.Random(23), []
    for pair in range(500):
        words = [f"w{noise.randrange(10**7)}" for _ in range(200)]
        other = list(words)
        edits = 3 + pair % 2
        for at in noise.sample(range(4, 196, 8), edits):  # each edit breaks five shingles of its own
            other[at] = f"e{noise.randrange(10**7)}"
        similarity = (196 - 5 * edits) / (196 + 5 * edits)
        assert 0.8 <= similarity <= 0.87
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    found = {r["doc_id"]: r["root"] for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[2 * pair] == found[2 * pair + 1] for pair in range(500)) >= 495
    assert len(set(found.values())) >= 500


def test_near_copies_are_linked_by_simhash_first(spark, monkeypatch):
    """Without any MinHash round the near copies of a few bits are one component already, and no others."""
    from tidegauge.llm import near_copies, simhash

    noise, rows = random.Random(29), []
    words = [f"w{noise.randrange(10**7)}" for _ in range(400)]
    for doc in range(8):
        other = list(words)
        other[50 * doc] = f"e{doc}"
        rows.append((doc, " ".join(other)))
    rows += [(100 + i, " ".join(f"x{noise.randrange(10**7)}" for _ in range(60))) for i in range(4)]
    prints = {i: simhash.fingerprint(text.encode(), near_copies.SHINGLE) for i, text in rows}
    near = {(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3}
    assert near and all(b < 8 for _, b in near)
    seen = []
    alike = near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda pairs, sets: seen.append(pairs.count()) or alike(pairs, sets))
    found = {r["doc_id"]: r["root"] for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert seen[0] == len(near)
    assert len({found[i] for i in range(8)}) == 1 and len(set(found.values())) == 5
