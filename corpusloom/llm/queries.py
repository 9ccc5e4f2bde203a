"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, fim, jaccard, licenses, neardup, negatives, packing, pieces, quality, sharding, tokencounts, toxicity
from corpusloom.llm.common import read_table, small_batches

#: Names of the tokenizer files that the queries use; public_tokenizers says where they are.
WORD_FILE, BYTE_FILE, PIECE_FILE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.digests(read_table(spark, sf_dir, "documents"), tokenizer_path(WORD_FILE))


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.links(read_table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_FILE))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("select -1L conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' text from (values (0L, 'user'), (1L, 'assistant')) t(turn, role)")
    talk = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(talk.union(extra))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.layout(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.history(read_table(spark, sf_dir, "documents"), f"rollup-{uuid.uuid4().hex}")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pieces.digests(read_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_FILE))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 7 take the next label, so that likely rows of other labels exist."""
    rows = read_table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", "embedding", shifted.alias("label")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return fim.digests(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_embedding_neardup, op3_license_scan, op4_toxicity, op5_ngram_jaccard, op6_best_fit_packing, op7_chat_format, op8_sharding, op9_quality_rules, op10_token_counts, op11_sentencepiece, op12_hard_negatives, op13_fill_in_middle, pipeline)}

ORACLE_SQL = {
    "op5_ngram_jaccard": r"""
        with recursive words as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w
            from documents),
        shingles as (
            select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end s
            from words),
        each_one as (select doc_id, len(s) n, unnest(s) g from shingles),
        links as (
            select a.doc_id a, b.doc_id b from each_one a join each_one b on a.g = b.g and a.doc_id <> b.doc_id
                and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach as (
            select doc_id, doc_id r from documents
            union
            select l.b, x.r from reach x join links l on l.a = x.doc_id and x.r < l.b)
        select s.doc_id, len(s.s)::bigint n_shingles, (select min(r) from reach where reach.doc_id = s.doc_id) component_id
        from shingles s""",
    "op12_hard_negatives": r"""
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l,
                list_transform(embedding, lambda x: floor(256 * x::double)) q
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select a.vec_id a, b.vec_id b, a.l = b.l same, list_inner_product(a.q, b.q)::bigint score
            from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
        p as (select * from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
        n as (
            select p.a, p.b pos, p.score ps, s.b neg, s.score ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) r
            from p join s on s.a = p.a and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
        select a anchor_id, pos positive_id, r::int as rank, neg negative_id, ps positive_score, ns negative_score
        from n where r <= 5""",
    "op13_fill_in_middle": r"""
        with d as (
            select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(doc_id::varchar, '')) h,
                regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') u
            from documents),
        c as (
            select *, len(u)::bigint n, ('0x' || h[1:8])::bigint % (len(u) + 1) a, ('0x' || h[9:16])::bigint % (len(u) + 1) b,
                case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 100 then 'plain'
                    when ('0x' || h[25:32])::bigint % 100 < 50 then 'spm' else 'psm' end form
            from d),
        p as (
            select doc_id, t, n, form, case when form <> 'plain' then array_to_string(u[1:least(a, b)], '') end p,
                case when form <> 'plain' then array_to_string(u[least(a, b) + 1:greatest(a, b)], '') end m,
                case when form <> 'plain' then array_to_string(u[greatest(a, b) + 1:], '') end s
            from c)
        select doc_id, n, form, length(p)::bigint prefix_chars, length(m)::bigint middle_chars,
            sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
            sha256(t) restored_sha256
        from p""",
    "op10_token_counts": r"""
        with d as (
            select source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) w,
                len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]|[^\x20\x09-\x0DA-Za-z0-9]')) p
            from documents)
        select source, lang, 'words-1' as version, count(*)::bigint n_docs, sum(w)::bigint n_tokens from d where lang <> 'de' group by all
        union all
        select source, lang, 'pieces-1', count(*)::bigint, sum(p)::bigint from d group by all""",
}
