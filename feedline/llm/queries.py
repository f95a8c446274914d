"""One thin query per operator: the operator over its whole table, then the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def put(f):
        QUERIES[name] = f
        return f
    return put


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


@register("op10_simhash_near_dedup")
def op10(spark: SparkSession, base: str) -> DataFrame:
    from .simhash import near_groups

    groups = near_groups(table(spark, base, "documents"), shingle=3, max_bits=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def vocabulary() -> str:
    """The vocabulary file of the BPE queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op2_bpe")
def op2(spark: SparkSession, base: str) -> DataFrame:
    from .bpe import decode, encode

    ids = encode(table(spark, base, "documents"), vocabulary())
    ids = ids.withColumn("ids_sha256", F.sha2("ids", 256))
    text = decode(ids, vocabulary(), keep=("doc_id", "n_tokens", "ids_sha256"))
    return text.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


@register("op6_chat_formatting")
def op6(spark: SparkSession, base: str) -> DataFrame:
    from .chat import digests, format_conversations

    turns = table(spark, base, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return digests(format_conversations(turns.unionByName(own)))


def held_out() -> F.Column:
    """Rows that the quality classifier never learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@register("op5_quality_classifier")
def op5(spark: SparkSession, base: str) -> DataFrame:
    from .quality import fit, score

    docs = table(spark, base, "documents")
    model = fit(docs, table(spark, base, "labels").filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register("op7_weighted_mixing")
def op7(spark: SparkSession, base: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, base, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op8_winnowing")
def op8(spark: SparkSession, base: str) -> DataFrame:
    from .winnowing import compare_edited, digest

    d = compare_edited(table(spark, base, "documents"))
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("chosen")).alias("fingerprint"),
                    digest(F.col("edited_chosen")).alias("edited_fingerprint"), "near_edited", "near_next")


@register("op3_embedding_near_dedup")
def op3(spark: SparkSession, base: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    d = near_duplicates(table(spark, base, "embeddings"), threshold=0.98)
    return d.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


@register("op1_substring_dedup")
def op1(spark: SparkSession, base: str) -> DataFrame:
    from .passages import find_passages

    return find_passages(table(spark, base, "documents"))


@register("op4_token_counts")
def op4(spark: SparkSession, base: str) -> DataFrame:
    """Totals after four commits: all documents; exact copies deleted; an end-of-text token more; the deletes once more."""
    import public_tokenizers

    from .mixing import words
    from .scratch import Scratch
    from .token_counts import TokenTotals, count_tokens

    docs = table(spark, base, "documents")
    scratch = Scratch(spark, "token-counts")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", "lang", "text", words(F.col("text")).alias("words"), F.sha2(text, 256).alias("sha"))
    counted = scratch.write(count_tokens(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "byte_bpe_50k",
                                         keep=("doc_id", "source", "lang", "words", "sha")), "counted")
    bpe = counted.select("doc_id", "version", "source", "lang", "tokens")
    both = bpe.unionByName(counted.select("doc_id", F.lit("words").alias("version"), "source", "lang", F.col("words").alias("tokens")))
    change = lambda df, op: df.withColumns({"op": F.lit(op), "seq": F.lit(0)})
    first = counted.groupBy("sha").agg(F.min("doc_id").alias("first"))
    copies = counted.join(first, "sha").filter("doc_id > first").select("doc_id", "source", "lang", F.explode(F.array(F.lit("byte_bpe_50k"), F.lit("words"))).alias("version"))
    copies = change(copies.withColumn("tokens", F.lit(None).cast("long")), "delete")
    totals = TokenTotals(spark, f"{scratch.root}/totals")
    totals.commit(1, change(both, "insert"))
    totals.commit(2, copies)
    totals.compact()
    totals.commit(3, change(bpe.withColumn("tokens", F.col("tokens") + 1), "revise"))
    totals.commit(2, copies)
    return totals.totals()


@register("op9_suffix_array_dedup")
def op9(spark: SparkSession, base: str) -> DataFrame:
    from .suffixes import repeated

    d = repeated(table(spark, base, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return d.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op12_cross_tokenizer_alignment")
def op12(spark: SparkSession, base: str) -> DataFrame:
    import public_tokenizers

    from .alignment import pair_counts, score_links, token_groups
    from .scratch import Scratch

    paths = vocabulary(), public_tokenizers.path("piece_bpe_32k.model")
    groups = token_groups(table(spark, base, "documents"), *paths)
    digest = F.when(F.length("groups") > 0, F.sha2("groups", 256)).otherwise("")
    groups = Scratch(spark, "alignment").write(groups.withColumn("groups_sha256", digest).drop("groups"), "groups")
    scored = score_links(groups, pair_counts(groups, *paths), *paths)
    return scored.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@register("op11_embedding_whitening")
def op11(spark: SparkSession, base: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, base, "embeddings")).select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@register("op13_lm_scoring")
def op13(spark: SparkSession, base: str) -> DataFrame:
    from .katz import score

    away = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs = table(spark, base, "documents").select("doc_id", "text", away.alias("held_out"))
    scored = score(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))
    return scored.select("row.doc_id", "row.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
