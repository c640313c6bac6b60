"""The queries op1 to op10: each applies its operator, with production parameters, to a whole table.

``QUERIES`` maps names to functions of (spark, sf_dir); ``ORACLE_SQL`` has DuckDB SQL
where SQL can express a result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def piece_model() -> bytes:
    """The public 32k model; the folder of vocabulary files is a parameter of the operators."""
    import public_tokenizers

    from .piece_codec import read_model

    return read_model(public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import round_trip

    decoded = round_trip(documents(spark, sf_dir), piece_model())
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query
def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_rules import clean_by_lines

    return clean_by_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", F.sha2("clean_text", 256).alias("clean_sha256")
    )


ORACLE_SQL["op4_line_rules"] = line_rules.oracle()


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out
    from .language_id import identify_languages, train_languages

    docs = documents(spark, sf_dir)
    model = train_languages(docs.where(~held_out("doc_id", 4)))
    return identify_languages(docs, model).select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score", F.size("span_langs").alias("n_spans"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out
    from .toxicity import score_toxicity, train_toxicity

    docs = documents(spark, sf_dir)
    model = train_toxicity(docs, labels(spark, sf_dir))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", "predicted", F.size("passage_starts").alias("n_passages"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out
    from .quality import score_quality, train_quality

    docs = documents(spark, sf_dir)
    model = train_quality(docs, labels(spark, sf_dir))
    return score_quality(docs, model).select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", "predicted")


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_items

    found = find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "edits", "short_ids")


@query
def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import new_folder
    from .packing import encode_bytes, read_packed, write_packed
    from .piece_codec import read_model

    files = new_folder(spark, "packed")
    encoded = encode_bytes(documents(spark, sf_dir), read_model(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    rows = read_packed(write_packed(encoded, files, end=50256), files)
    return rows.select("shard", "row", F.sha2("ids", 256).alias("ids_sha256"), "doc_ids", "offsets", "cu_seqlens", "resets")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import new_folder
    from .warc import merge_index, ranked, read_archives, write_archives

    files = new_folder(spark, "warc")
    runs = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), files)
    place = ranked(merge_index(runs, files)).select("archive", "offset", "index_rank")
    # The planner takes what comes of a few file names for small, and would broadcast it.
    return read_archives(runs, files).hint("merge").join(place, ["archive", "offset"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "index_rank")


ORACLE_SQL["op9_warc"] = warc.oracle()


@query
def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out
    from .ppm import score_texts, train

    docs = documents(spark, sf_dir)
    words, trie = train(docs.where(~held_out("doc_id", 7)))
    return score_texts(docs, words, trie).select("doc_id", held_out("doc_id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
