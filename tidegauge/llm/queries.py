"""Registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import contamination, hilbert, katz, labelled, lexical, merkle, piece_codec, pivots, quality, repeats, simhash, suffixes, token_counts, toxicity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_hilbert_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return hilbert.nearest(vectors, F.pmod("vec_id", F.lit(20)) == 0)


def op2_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return piece_codec.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op4_katz(spark: SparkSession, folder: str) -> DataFrame:
    fold = labelled.fold(F.col("doc_id"), 5)
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", (fold != 1).alias("train"), F.coalesce(fold == 1, F.lit(False)).alias("held_out")
    )
    return katz.score_texts(docs)


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.shared_passages(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return contamination.contaminated(docs, table(spark, folder, "benchmark"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic").filter(labelled.fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.fit_toxicity(docs, labels).documents(docs)
    return scored.select(
        "doc_id",
        F.coalesce(labelled.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "worst_score",
        "worst_from",
        "worst_to",
    )


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "quality").filter(labelled.fold(F.col("doc_id"), 3) != 1)
    scored = quality.fit_quality(docs, labels).documents(docs)
    return scored.select(
        "doc_id",
        F.coalesce(labelled.fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.prove(table(spark, folder, "documents"))


def op12_pivot_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.exact_top_k(table(spark, folder, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_search": op1_hilbert_search,
    "op2_piece_codec": op2_piece_codec,
    "op3_token_counts": op3_token_counts,
    "op4_katz": op4_katz,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_merkle": op11_merkle,
    "op12_pivot_top_k": op12_pivot_top_k,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op8_substring_dedup": r"""
        with trimmed as (
            select doc_id, regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as line from documents
        ),
        split as (
            select doc_id, case when line = '' then [] else regexp_split_to_array(line, '[\x20\x09-\x0D]+') end as words from trimmed
        ),
        starts as (select doc_id, words, unnest(generate_series(1, len(words) - 12)) as pos from split where len(words) >= 13),
        windows as (select doc_id, pos, array_to_string(words[pos:pos + 12], ' ') as run from starts),
        earliest as (select run, min(doc_id) as doc_id from windows group by run),
        later as (select w.doc_id, w.pos from windows w join earliest e on w.run = e.run and e.doc_id < w.doc_id),
        gone as (select distinct doc_id, pos + step as pos from later, (select unnest(generate_series(0, 12)) as step)),
        numbered as (
            select doc_id, unnest(words) as word, unnest(generate_series(1, len(words))) as pos from split
        ),
        kept as (
            select n.doc_id, string_agg(n.word, ' ' order by n.pos) as text, count(*) as n
            from numbered n left join gone g on n.doc_id = g.doc_id and n.pos = g.pos
            where g.pos is null group by n.doc_id
        )
        select s.doc_id, len(words)::bigint as n_words, (len(words) - coalesce(k.n, 0))::bigint as n_removed,
            sha256(coalesce(k.text, '')) as kept_sha256
        from split s left join kept k on s.doc_id = k.doc_id
    """,
    "op11_merkle": r"""
        with recursive
        marked as (
            select row_number() over () as row, doc_id, lang, source, n_chars, text,
                xor(list_reduce(
                    list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(doc_id::varchar, '.'), lambda c: ascii(c)::ubigint)),
                    lambda acc, c: list_reduce([xor(acc, c), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda x, i: xor(x >> 1, (x & 1) * 3988292384::ubigint))
                ), 4294967295::ubigint) % 3 = 0 as chosen
            from documents
        ),
        versions as (
            select row, doc_id, lang, source, n_chars, text as body, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, chosen from marked
        ),
        heads as (
            select row, doc_id, lang, body, case when chosen then low else body end as changed,
                coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head
            from versions
        ),
        hashed as (
            select row, doc_id, lang, sha256(head || coalesce(strlen(body) || ':' || body, '-')) as leaf,
                sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) as tampered
            from heads
        ),
        placed as (
            select *, dense_rank() over (order by lang nulls first) - 1 as tree,
                row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as n
            from hashed
        ),
        levels as (
            select 0 as level, tree, place, n, leaf as digest from placed
            union all
            select level + 1, tree, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by place))
            from levels where n > 1 group by level, tree, place // 8, n
        ),
        subroots as (select tree, level as height, digest from levels where n = 1),
        upper as (
            select 0 as level, tree as place, count(*) over () as n, digest from subroots
            union all
            select level + 1, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by place)) from upper where n > 1 group by level, place // 8, n
        ),
        nodes as (
            select tree, level, place, digest from levels where n > 1
            union all
            select s.tree, s.height + u.level, u.place, u.digest from upper u, subroots s where u.n > 1
        ),
        stations as (
            select p.row, s.height, p.place, s.tree, unnest(generate_series(0, s.height + (select max(level) from upper) - 1)) as step
            from placed p join subroots s on p.tree = s.tree
        ),
        path as (
            select row, tree, step, case when step < height then place >> (3 * step) else tree >> (3 * (step - height)) end as at from stations
        ),
        runs as (
            select tree, level, place // 8 as run, list(digest order by place) as kids from nodes group by all
        ),
        sides as (
            select p.row, p.step, array_to_string(r.kids[:p.at % 8], '') as before, array_to_string(r.kids[p.at % 8 + 2:], '') as after
            from path p join runs r on r.tree = p.tree and r.level = p.step and r.run = p.at // 8
        ),
        climb as (
            select row, 0 as step, tampered as fold from placed
            union all
            select c.row, c.step + 1, sha256(s.before || c.fold || s.after) from climb c join sides s on c.row = s.row and c.step = s.step
        ),
        proofs as (select row, sha256(string_agg(before || after, '' order by step)) as proof from sides group by row),
        ends as (select row, arg_max(fold, step) as fold from climb group by row)
        select p.doc_id, p.leaf, s.digest as subroot, u.digest as root, coalesce(f.proof, sha256('')) as proof_sha256, e.fold as folded_root, e.fold = u.digest as verified
        from placed p join subroots s on p.tree = s.tree join ends e on p.row = e.row left join proofs f on p.row = f.row, (select digest from upper where n = 1) u
    """,
    "op12_pivot_top_k": r"""
        with ints as (
            select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: coalesce(not isfinite(x), true))) = 0
        ),
        scored as (
            select q.vec_id as query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::bigint as score
            from ints q join ints c on q.vec_id % 100 = 0 and q.vec_id != c.vec_id
        ),
        placed as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
        select query_id, rank, vec_id, score from placed where rank <= 10
    """,
    "op13_lexical_search": r"""
        with words as (
            select doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
            from documents
        ),
        held as (select doc_id, term, count(*) as tf from words group by all),
        sizes as (select doc_id, sum(tf)::bigint as n from held group by doc_id),
        whole as (select count(*)::bigint as documents, sum(n)::bigint as length from sizes),
        weights as (
            select term, floor(1000 * ln((2 * documents + 2)::double / (2 * count(*) + 1)::double))::bigint as w from held, whole group by term, documents
        ),
        marks as (select doc_id, 100 - 75 + ((75 * n * documents) // length) as m from sizes, whole),
        asked as (
            select item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
            from benchmark
        ),
        scored as (
            select a.item_id, h.doc_id, sum(w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * k.m)))::bigint as score
            from asked a join held h on a.term = h.term join weights w on w.term = a.term join marks k on k.doc_id = h.doc_id
            group by a.item_id, h.doc_id
        ),
        placed as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored where score > 0)
        select item_id, rank, doc_id, score from placed where rank <= 10
    """,
}
