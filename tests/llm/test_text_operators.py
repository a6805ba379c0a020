from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tidegauge.llm import contamination, copies, piece_codec, quality, repeats, simhash, suffixes, token_counts, toxicity
from tidegauge.llm.components import components
from tidegauge.llm.labelled import fold
from tidegauge.llm.words import Words, chain, selected

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def passage():
    return " ".join(f"w{i}x" for i in range(60))


@pytest.fixture(scope="module")
def odd(spark, passage):
    """Nulls, empty and long texts, repeated rows, copies, ties, one id with two texts, a clashing column."""
    noise = random.Random(3)
    long = " ".join(noise.choice(["a", "bb", "ccc", "Ünï", " "]) + str(noise.randrange(40)) for _ in range(30000))
    rows = [
        (1, f"start one {passage} end one"), (2, f"other {passage} tail two"), (2, f"other {passage} tail two"), (3, None), (4, ""),
        (5, " \n\t "), (6, long), (7, f"start one {passage} end one"), (8, "short text"), (8, f"x {passage}"), (None, f"start one {passage}"),
        (None, None), (9, "tie " * 40), (10, "tie " * 30), (11, " non breaking space"), (12, long[:50000]),
    ]
    return spark.createDataFrame([(*row, "mine") for row in rows], SCHEMA + ", score string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return [] if text is None else text.encode().split()


def test_words_match_bytes_split():
    texts = ["a  b\n", None, "", " éx\x0b\x0cy ", "z" * 1000, "one two"]
    found = Words(pa.array(texts))
    expected = [w for t in texts for w in words_of(t)]
    assert [found.data[a:b].tobytes() for a, b in zip(found.starts, found.ends)] == expected
    hashes = found.hashes()
    assert len(set(hashes.tolist())) == len(set(expected))
    assert found.counts().tolist() == [len(words_of(t)) for t in texts]


def test_selected_positions_depend_on_content():
    noise = np.random.default_rng(1)
    shared = noise.integers(0, 2**63, 40).astype(np.uint64)
    a = np.concatenate([noise.integers(0, 2**63, 17).astype(np.uint64), shared])
    b = np.concatenate([shared, noise.integers(0, 2**63, 23).astype(np.uint64)])
    for start in range(len(shared) - 9):
        window = set(shared[start : start + 9].tolist())
        assert window & set(a[selected(a, 9)].tolist()) & set(b[selected(b, 9)].tolist())
    assert len(chain(shared, 5)) == 36 and len(chain(shared[:3], 5)) == 0


# -- token counts and codec ------------------------------------------------------


def test_token_counts_equal_the_library(odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = token_counts.count_tokens(odd, MODEL).collect()
    assert len(rows) == odd.count()
    for row in rows:
        text = row["text"] or ""
        assert (row["n_bytes"], row["n_tokens"]) == (len(text.encode()), len(library.encode(text)))
        assert row["over_limit"] == (row["n_tokens"] > 4096)
        assert row["score"] == "mine"
    assert token_counts.count_tokens(none, MODEL).count() == 0


def test_parts_of_long_texts_add_up(folder, spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    found = token_counts.lengths(MODEL, [t.encode() for t in texts], 3000, 150)
    assert found.tolist() == [len(x) for x in library.encode(texts)]


def test_codec_equals_the_library(odd, none, spark, folder):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = odd.unionByName(spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "text", "'mine' as score"))
    coded = piece_codec.encode_texts(docs, MODEL)
    for row in piece_codec.decode_ids(coded, MODEL).collect():
        text = row["text"] or ""
        assert row["ids"] == library.encode(text)
        assert row["n_tokens"] == len(row["ids"]) and row["decoded"] == library.decode(row["ids"])
        assert row["round_trip"] == (row["decoded"] == text)
    assert piece_codec.encode_texts(none, MODEL).count() == 0


def test_codec_on_random_text():
    noise, pieces = random.Random(5), piece_codec.load(MODEL)
    letters = "ab ▁\n\té日\U0001f600.<>0x1 the ing er"
    texts = ["".join(noise.choice(letters) for _ in range(noise.randint(0, 80))) for _ in range(800)] + ["aaaa" * 300, "<s> </s> <unk> <0x0A>"]
    ids, borders = piece_codec.encode(texts, pieces)
    expected = pieces.processor.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:])] == expected
    assert piece_codec.decode(ids, borders, pieces) == pieces.processor.decode(expected)


def test_unigram_paths_equal_the_library(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    for name, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        model.pieces.add(piece=name, type=kind)
    for byte in range(256):
        model.pieces.add(piece=f"<0x{byte:02X}>", type=6)
    for name, score in (("▁", -3), ("a", -4.5), ("b", -4), ("c", -5), ("ab", -6.1), ("bc", -6.3), ("abc", -9.7), ("▁a", -5), ("▁ab", -7.7), ("ca", -8)):
        model.pieces.add(piece=name, score=score, type=1)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, True
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix = "identity", True
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = False, True
    path = tmp_path / "tiny.model"
    path.write_bytes(model.SerializeToString())
    pieces, noise = piece_codec.load(str(path)), random.Random(2)
    texts = ["".join(noise.choice("abc é") for _ in range(noise.randint(0, 30))) for _ in range(300)]
    ids, borders = piece_codec.encode(texts, pieces)
    assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:])] == pieces.processor.encode(texts)


# -- repeats ------------------------------------------------------------------------


def brute_runs(rows, length):
    """For each row: words, words of shared runs, words of runs with a smaller id."""
    where = {}
    for doc, text in rows:
        if doc is not None:
            words = words_of(text)
            for i in range(len(words) - length + 1):
                where.setdefault(tuple(words[i : i + length]), set()).add(doc)
    out = []
    for doc, text in rows:
        words = words_of(text)
        shared, later = [False] * len(words), [False] * len(words)
        for i in range(len(words) - length + 1) if doc is not None else ():
            owners = where[tuple(words[i : i + length])]
            if len(owners) > 1:
                shared[i : i + length] = [True] * length
            if min(owners) < doc:
                later[i : i + length] = [True] * length
        out.append((words, shared, later))
    return out


@pytest.mark.parametrize("length", [13, 5])
def test_substring_dedup_equals_brute_force(odd, none, length):
    cut = repeats.remove_repeats(odd, length=length, seed=min(5, length - 1)).collect()
    expected = {}
    for (doc, text), (words, _, later) in zip([(r["doc_id"], r["text"]) for r in odd.collect()], brute_runs([(r["doc_id"], r["text"]) for r in odd.collect()], length)):
        expected[(doc, text)] = (len(words), sum(later), b" ".join(w for w, gone in zip(words, later) if not gone).decode())
    assert len(cut) == odd.count()
    for row in cut:
        assert (row["n_words"], row["n_removed"], row["kept_text"]) == expected[(row["doc_id"], row["text"])]
        assert sum(r["end"] - r["start"] for r in row["removed"]) == row["n_removed"] and row["score"] == "mine"
    assert repeats.remove_repeats(none).count() == 0


def test_shared_passages_equal_brute_force(odd, none):
    found = suffixes.shared_passages(odd).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    expected = {row: (len(w), sum(s), sum(e)) for row, (w, s, e) in zip(rows, brute_runs(rows, 50))}
    assert len(found) == len(rows)
    for row in found:
        assert (row["n_words"], row["n_shared"], row["n_later"]) == expected[(row["doc_id"], row["text"])]
        assert sum(p["end"] - p["start"] for p in row["passages"]) == row["n_shared"]
        assert all(p["end"] - p["start"] >= 50 for p in row["passages"])
    assert suffixes.shared_passages(none).count() == 0
    with pytest.raises(ValueError):
        suffixes.shared_passages(none, length=20)


@pytest.fixture(scope="module")
def looping(spark):
    """Texts that repeat passages within themselves, alone and with others, and rows without an id."""
    noise = random.Random(12)
    loops = [" ".join(f"p{k}w{i}" for i in range(size)) for k, size in enumerate((3, 9, 20, 60))]
    rows = []
    for number in range(40):
        parts = [noise.choice(loops) for _ in range(noise.randint(0, 6))] + [" ".join(f"own{number}x{i}" for i in range(noise.randint(0, 30)))]
        parts += [f"only{number} words here again and again {number}"] * noise.choice([0, 12])
        noise.shuffle(parts)
        rows.append((number if number % 9 else 3, " ".join(parts)))
    rows += [(None, loops[3] * 2)] * 30
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("length", [13, 5])
def test_passages_that_repeat_within_texts(looping, length):
    rows = [(r["doc_id"], r["text"]) for r in looping.collect()]
    marks = [(str(i), t, [n for n, gone in enumerate(later) if gone]) for (i, t), (_, _, later) in zip(rows, brute_runs(rows, length))]
    found = repeats.remove_repeats(looping, length=length, seed=min(5, length - 1)).collect()
    got = []
    for r in found:
        gone = [x for run in r["removed"] for x in range(run["start"], run["end"])]
        got.append((str(r["doc_id"]), r["text"], gone))
    assert sorted(got, key=repr) == sorted(marks, key=repr)


def test_shared_passages_that_repeat_within_texts(looping):
    rows = [(r["doc_id"], r["text"]) for r in looping.collect()]
    expected = sorted((str(i), sum(later), sum(shared)) for (i, _), (_, shared, later) in zip(rows, brute_runs(rows, 50)))
    found = sorted((str(r["doc_id"]), r["n_later"], r["n_shared"]) for r in suffixes.shared_passages(looping).collect())
    assert found == expected


def test_exact_copies(odd):
    found = {r["doc_id"]: (len(r["copied"]), len(r["later"])) for r in copies.exact_copies(odd).collect()}
    assert found == {1: (1, 0), 7: (1, 1)}


# -- simhash -----------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_and_components_equal_brute_force(odd, none):
    rows = odd.collect()
    marks = [plain_fingerprint(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if row["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), row["doc_id"]), row["doc_id"])
    expected = sorted((str(r["doc_id"]), f"{m:016x}", str(least.get(find(i)))) for i, (r, m) in enumerate(zip(rows, marks)))
    found = simhash.near_duplicates(odd).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in found) == expected
    assert simhash.near_duplicates(none).count() == 0


def test_covering_finds_every_link(spark):
    noise, values = random.Random(7), [0, 2**64 - 1]
    for _ in range(60):
        base = noise.getrandbits(64)
        values += [base] + [base ^ sum(1 << b for b in noise.sample(range(64), noise.randint(1, 5))) for _ in range(4)]
        # All flips in one half, and on the 32nd and 64th bit.
        values += [base ^ (1 << 31), base ^ (1 << 63) ^ 6, base ^ 7, base ^ (7 << 40)]
    values = sorted(set(values))
    frame = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "bits long")
    found = {frozenset((r["a"] % 2**64, r["b"] % 2**64)) for r in simhash.links(frame).collect()}
    expected = {frozenset((a, b)) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3}
    assert found == expected and len(expected) > 200


def test_components_of_chains_and_stars(spark):
    chain_links = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(10, 40)]
    links = spark.createDataFrame([*chain_links, *star, (7, 8), (8, 7), (3, 3)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert all(found[i] == 100 for i in range(100, 161)) and all(found[i] == 5 for i in range(10, 40))
    assert found[8] == 7 and 3 not in found
    assert components(links.filter("false")).count() == 0


# -- decontamination ------------------------------------------------------------------


def plain_tiles(item, text, least):
    """Longest common run of unmarked words, again and again, by trying everything."""
    used_a, used_b, covered = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < least:
            return covered
        size, i, j = best[0], -best[1], -best[2]
        used_a[i : i + size], used_b[j : j + size] = [True] * size, [True] * size
        covered += size


def test_tiling_equals_brute_force():
    noise = random.Random(4)
    for _ in range(200):
        item = np.array([noise.randrange(6) for _ in range(noise.randint(0, 25))], dtype=np.uint64)
        text = np.array([noise.randrange(6) for _ in range(noise.randint(0, 40))], dtype=np.uint64)
        found = contamination.tiles(item, text, 3)
        for a, b, size in found:
            assert (item[a : a + size] == text[b : b + size]).all() and size >= 3
        assert sum(size for _, _, size in found) == plain_tiles(item.tolist(), text.tolist(), 3)


def test_contamination_catches_moved_sentences(spark, odd, none):
    item = "The red fox runs over hills. Blue birds sing in the morning! Nine cats sleep on mats."
    moved = "intro words Nine cats sleep on mats, and BLUE birds sing in the morning. Also: the red fox runs over hills; outro"
    docs = spark.createDataFrame([(1, item), (2, moved), (2, moved), (3, "the red fox runs away from blue birds"), (4, None), (5, "")], SCHEMA)
    bench = spark.createDataFrame([(7, item), (8, None), (9, "red fox"), (10, ""), (11, item)], "item_id long, text string")
    for block in (2_000_000, 20):
        found = contamination.contaminated(docs, bench, block_words=block).collect()
        assert sorted((r["doc_id"], r["item_id"], r["tiles"]) for r in found) == [(1, 7, 1), (1, 11, 1), (2, 7, 3), (2, 7, 3), (2, 11, 3), (2, 11, 3)]
    assert contamination.contaminated(none, bench).count() == 0
    assert contamination.contaminated(odd, bench.filter("false")).count() == 0


# -- classifiers ------------------------------------------------------------------------


def test_toxicity_held_out(spark, folder, odd, none):
    noise = random.Random(6)
    plain = ["table", "river", "green", "walks", "under", "stone", "light", "seven"]
    rows, marks = [], []
    for doc in range(600):
        sentences = [" ".join(noise.choice(plain) for _ in range(8)) + "." for _ in range(6)]
        toxic = doc % 4 == 0
        if toxic:
            sentences.insert(3, f"you are {noise.choice(['scum', 'idiot', 'moron'])} today.")
        rows.append((doc, " ".join(sentences)))
        marks.append((doc, int(toxic)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    scored = {r["doc_id"]: r for r in model.documents(docs).collect()}
    held = [doc for doc, _ in rows if fold_of(doc, 5) == 0]
    assert np.mean([(scored[d]["score"] >= 0.5) == (d % 4 == 0) for d in held]) > 0.97
    assert all(scored[d]["worst_from"] == 24 for d in held if d % 4 == 0)
    places = model.sentences(docs).filter("doc_id = 0").collect()
    assert [(r["from_word"], r["to_word"]) for r in places] == [(24, 28)]
    out = model.documents(odd).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert [r["score"] for r in out if not (r["text"] or "").strip()] == [0.0] * 4
    assert model.documents(none).count() == 0
    assert toxicity.fit_toxicity(none, labels).documents(odd).select("score").distinct().collect()[0][0] == 0.5


def fold_of(doc, parts):
    import zlib

    return zlib.crc32(str(doc).encode()) % parts


def test_quality_held_out(spark, folder, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit_quality(docs, labels.filter(fold(F.col("doc_id"), 3) != 1))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    scored = {r["doc_id"]: r["score"] for r in model.documents(docs.select("doc_id", "text")).collect()}
    held = [doc for doc in truth if fold_of(doc, 3) == 1]
    assert np.mean([(scored[d] >= 0.5) == truth[d] for d in held]) > 0.95
    out = model.documents(odd).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert model.documents(none).count() == 0
    empty = quality.fit_quality(none, labels).documents(odd).collect()
    assert len({round(r["score"], 9) for r in empty}) == 1


def test_negative_risk_is_kept_at_zero():
    noise = np.random.default_rng(0)
    good, bad = noise.normal(2, 1, (300, 2)), noise.normal(-2, 1, (300, 2))
    theta = quality.fit(good[:150], np.concatenate([good[150:], bad]), 150 / 450)
    assert (good @ theta[:2] + theta[2] > 0).mean() > 0.95 and (bad @ theta[:2] + theta[2] < 0).mean() > 0.95


def test_digest_of_kept_words(spark, folder):
    from tidegauge.llm.queries import QUERIES

    rows = QUERIES["op8_substring_dedup"](spark, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    clean = [r for r in rows if not r["n_removed"]]
    assert len(rows) == len(texts) and clean
    assert all(r["kept_sha256"] == hashlib.sha256(b" ".join(words_of(texts[r["doc_id"]]))).hexdigest() for r in clean)
