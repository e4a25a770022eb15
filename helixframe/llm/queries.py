"""Registered queries of the training-data operators: the digest columns of each, derived from its real output."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table

TOKENIZER = "piece_bpe_32k.model"
BYTE_LEVEL = "byte_bpe_50k.json"


def op1_word_windows(spark, sf):
    from .word_windows import remove_repeated

    return remove_repeated(table(spark, sf, "documents"))


def op2_token_counts(spark, sf):
    import public_tokenizers

    from .token_counts import count_tokens, over_limit

    return over_limit(count_tokens(table(spark, sf, "documents"), str(public_tokenizers.path(TOKENIZER))), 4096)


def op3_topk(spark, sf):
    from .topk import search

    return search(table(spark, sf, "embeddings"))


def op4_quality(spark, sf):
    from .quality import classify

    return classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op5_minhash(spark, sf):
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf, "documents"))


def op6_decontaminate(spark, sf):
    from .decontaminate import find_items

    return find_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op7_bwt_windows(spark, sf):
    from .byte_windows import remove_repeated

    return remove_repeated(table(spark, sf, "documents"))


def op8_pii(spark, sf):
    from .pii import digest, find_spans

    return digest(find_spans(table(spark, sf, "documents")))


def op9_warc(spark, sf):
    from .warc import read_archive, write_archive

    folder, _ = write_archive(table(spark, sf, "pages"))
    return read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mix(spark, sf):
    from .mixing import mix

    return mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_align(spark, sf):
    import public_tokenizers

    from .align import align

    docs, _ = align(table(spark, sf, "documents"), str(public_tokenizers.path(BYTE_LEVEL)), str(public_tokenizers.path(TOKENIZER)))
    return docs


def op12_vector_codes(spark, sf):
    from .vector_codes import books_hash, encode, with_label_error

    codes, books = encode(table(spark, sf, "embeddings"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"))


def op13_secrets(spark, sf):
    from .secrets import digest, find_secrets

    return digest(find_secrets(table(spark, sf, "documents")))


def queries():
    return {f.__name__: f for f in (op1_word_windows, op2_token_counts, op3_topk, op4_quality, op5_minhash, op6_decontaminate, op7_bwt_windows, op8_pii, op9_warc, op10_mix,
                                    op11_align, op12_vector_codes, op13_secrets)}


def oracles():
    from .decontaminate import find_sql
    from .mixing import mix_sql
    from .topk import SEARCH_SQL
    from .vector_codes import codes_sql
    from .warc import RECORDS_SQL

    return {"op3_topk": SEARCH_SQL, "op6_decontaminate": find_sql(), "op9_warc": RECORDS_SQL, "op10_mix": mix_sql(), "op12_vector_codes": codes_sql()}
