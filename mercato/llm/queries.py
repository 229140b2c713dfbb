"""Queries over the given tables, one per operator, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import (
    alignment,
    bpe,
    decontaminate,
    embedding_dedup,
    exact_dedup,
    language,
    merkle,
    minhash,
    mixing,
    pii,
    token_counts,
    token_files,
    toxicity,
)

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2
LIMIT = 512
#: The key of the surrogates; a real corpus has its own, kept secret.
KEY = "mercato"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A given table.  Python workers on this machine find the package, wherever they start; a cluster gets it by --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1(spark: SparkSession, directory: str) -> DataFrame:
    mixed = mixing.mix(table(spark, directory, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    model = toxicity.train(docs, table(spark, directory, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op3(spark: SparkSession, directory: str) -> DataFrame:
    replaced = pii.replace_private(table(spark, directory, "documents"), KEY)
    return replaced.select("doc_id", F.size("kinds").alias("n_found"), "kinds", "text")


def op4(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    return token_files.ids_crc32(token_files.token_files(docs, tokenizer_path(), END_ID, packed=True))


def op5(spark: SparkSession, directory: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, directory, "documents"))


def op6(spark: SparkSession, directory: str) -> DataFrame:
    return minhash.near_groups(table(spark, directory, "documents"))


def round_trip(docs: DataFrame) -> DataFrame:
    """``doc_id``, number and digest of the ids, digest of the decoded text."""
    coded = bpe.encode_and_decode(docs, tokenizer_path())
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8(spark: SparkSession, directory: str) -> DataFrame:
    return round_trip(table(spark, directory, "documents"))


def op7(spark: SparkSession, directory: str) -> DataFrame:
    return embedding_dedup.linked_vectors(table(spark, directory, "embeddings"))


def op9(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    held_out = toxicity.held_out("doc_id", 4, 2)
    crf = language.train(docs, ~held_out)
    return language.predict(docs, crf).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10(spark: SparkSession, directory: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, directory, "documents"), tokenizer_path())
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


def op11(spark: SparkSession, directory: str) -> DataFrame:
    return merkle.tamper_check(table(spark, directory, "documents"))


def op12(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    aligned = alignment.align_tokenizers(docs, tokenizer_path(), tokenizer_path(PIECES))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.withColumn("groups_sha256", digest).drop("groups")


def op13(spark: SparkSession, directory: str) -> DataFrame:
    return decontaminate.decontamination(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1,
    "op2_toxicity": op2,
    "op3_pii": op3,
    "op4_token_files": op4,
    "op5_exact_dedup": op5,
    "op6_minhash": op6,
    "op7_embedding_dedup": op7,
    "op8_bpe": op8,
    "op9_language": op9,
    "op10_token_counts": op10,
    "op11_merkle": op11,
    "op12_alignment": op12,
    "op13_decontamination": op13,
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
        with t as (
            select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as content from documents
        ), g as (
            select content, min(doc_id) as keep_id, count(*) as group_size from t group by content
        )
        select doc_id, keep_id, group_size, coalesce(doc_id = keep_id, doc_id is null and keep_id is null) as kept, sha256(content) as text_sha256
        from t join g using (content)
    """,
    "op1_mixing": r"""
        with d as (
            select doc_id, source,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                   ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint as hash
            from documents
        ), s as (
            select source, sum(size)::bigint as source_size from d group by source
        ), w as (
            select source, source_size, source_size * 2.0::double as lim,
                   [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight
            from s
        ), l as (
            select *, (sum(source_size) over () * 1.5::double - coalesce(sum(lim) over (o rows between unbounded preceding and 1 preceding), 0))
                      / sum(weight) over (o rows between current row and unbounded following) as level
            from w window o as (order by lim / weight, source nulls last)
        ), f as (
            select arg_min(level, lim / weight) as final from l where lim >= weight * level
        ), t as (
            select source, source_size, least(lim, coalesce(weight * final, lim)) as target from l left join f on true
        ), p as (
            select *, coalesce(floor(target / nullif(source_size, 0) * 268435456), 0)::bigint as step,
                   floor(('0x' || substr(md5('7/' || coalesce(source, '')), 1, 8))::bigint * 268435456 / 4294967296)::bigint as start
            from t
        ), r as (
            select d.*, source_size, target, step,
                   start + step * (row_number() over (partition by d.source order by size, hash, doc_id)) as upto
            from d join p on d.source is not distinct from p.source
        )
        select doc_id, size, source_size, target, source,
               ((upto >> 28) - ((upto - step) >> 28))::integer as copies,
               ((upto >> 28) - ((upto - step) >> 28)) * size as taken
        from r
    """,
    "op11_merkle": r"""
        with recursive d as (
            select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lowered,
                   coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as head,
                   xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)),
                                   lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
                                                                 lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 3 = 0 as tampered
            from documents
        ), l as (
            select doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
                   sha256(head || coalesce(strlen(text) || ':' || (case when tampered then lowered else text end), '-')) as own
            from d
        ), placed as (
            select *, dense_rank() over (order by lang nulls first) - 1 as tree,
                   row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n
            from l
        ), nodes as (
            select tree, 0 as level, pos, n, leaf as h from placed
            union all
            select tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from nodes where n > 1 group by tree, level, pos // 8, n
        ), upper as (
            select 0 as level, tree as pos, (select count(distinct tree) from placed) as n, h from nodes where n = 1
            union all
            select level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from upper where n > 1 group by level, pos // 8, n
        ), walk as (
            select row_number() over () as id, tree, 0 as level, pos, n, own as h, '' as proof, doc_id, leaf from placed
            union all
            select w.id, w.tree, w.level + 1, w.pos // 8, (w.n + 7) // 8,
                   sha256(string_agg(case when s.pos = w.pos then w.h else s.h end, '' order by s.pos)),
                   w.proof || coalesce(string_agg(case when s.pos <> w.pos then s.h end, '' order by s.pos), ''), w.doc_id, w.leaf
            from walk w join nodes s on s.tree = w.tree and s.level = w.level and s.pos // 8 = w.pos // 8
            where w.n > 1
            group by w.id, w.tree, w.level, w.pos, w.n, w.h, w.proof, w.doc_id, w.leaf
        ), climb as (
            select id, tree, 0 as level, tree as pos, (select count(distinct tree) from placed) as n, h, proof, doc_id, leaf from walk where n = 1
            union all
            select w.id, w.tree, w.level + 1, w.pos // 8, (w.n + 7) // 8,
                   sha256(string_agg(case when s.pos = w.pos then w.h else s.h end, '' order by s.pos)),
                   w.proof || coalesce(string_agg(case when s.pos <> w.pos then s.h end, '' order by s.pos), ''), w.doc_id, w.leaf
            from climb w join upper s on s.level = w.level and s.pos // 8 = w.pos // 8
            where w.n > 1
            group by w.id, w.tree, w.level, w.pos, w.n, w.h, w.proof, w.doc_id, w.leaf
        )
        select c.doc_id, c.leaf, s.h as subroot, r.h as root, sha256(c.proof) as proof_sha256, c.h as folded_root, c.h = r.h as verified
        from climb c join nodes s on s.tree = c.tree and s.n = 1 join upper r on r.n = 1
        where c.n = 1
    """,
    "op13_decontamination": r"""
        with d as (
            select row_number() over () as id, doc_id,
                   coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as words
            from documents
        ), i as (
            select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
            from benchmark
        ), w as (
            select distinct item_id, least(len(words), 10) as size, array_to_string(words[place + 1:place + 10], ' ') as content
            from (select *, unnest(range(greatest(len(words) - 10, 0) + 1)) as place from i where len(words) > 0)
        ), p as (
            select id, size, place, array_to_string(words[place + 1:place + size], ' ') as content
            from (select id, words, size, unnest(range(greatest(len(words) - size + 1, 0))) as place from d, (select distinct size from w))
        ), f as (
            select id, place, p.size, item_id from p join w on p.size = w.size and p.content = w.content
        ), h as (
            select id, count(distinct word) as n_hit from (select id, unnest(range(place, place + size)) as word from f) group by id
        ), t as (
            select id, count(*) as n_items, string_agg(item, ',' order by item) as listed
            from (select distinct id, item_id::varchar as item from f where item_id is not null) group by id
        )
        select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join h using (id) left join t using (id)
    """,
}
