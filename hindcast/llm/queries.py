"""Thin Spark steps: given tables in, operator, digest columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hindcast.llm.oracles import ORACLES as ORACLES
from hindcast.llm.stored import bounded_arrow
from hindcast.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(bounded_arrow(configure(spark)), sf_dir)

    run.__name__ = build.__name__
    QUERIES[build.__name__] = run
    return run


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def events_of(documents: DataFrame) -> DataFrame:
    """Documents as activity events: source as the application, language as the window."""
    return documents.select(F.col("doc_id").alias("event_id"), F.col("source").alias("app"),
                            F.col("lang").alias("window"), "text")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


@query
def op2_token_counts(spark, d):
    from hindcast.llm.tokens import count_tokens

    return (count_tokens(events_of(documents(spark, d)), tokenizer("piece_bpe_32k.model"))
            .withColumnRenamed("event_id", "doc_id"))


@query
def op6_best_fit_packing(spark, d):
    from hindcast.llm.packing import pack_best_fit

    return (pack_best_fit(events_of(documents(spark, d)), tokenizer("word_bpe_49k.json"))
            .withColumnRenamed("event_id", "doc_id"))


@query
def op10_repeated_passages(spark, d):
    from hindcast.llm.repeats import remove_repeats

    return remove_repeats(events_of(documents(spark, d))).withColumnRenamed("event_id", "doc_id")


@query
def op4_ngram_jaccard(spark, d):
    from hindcast.llm.ngram_join import ngram_components

    return ngram_components(events_of(documents(spark, d))).withColumnRenamed("event_id", "doc_id")


@query
def op3_top_k_search(spark, d):
    from hindcast.llm.topk import top_envelopes

    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("event_id"),
                                                                F.col("embedding").alias("rms"))
    return top_envelopes(rows, rows.filter("event_id % 50 = 0")).withColumnRenamed("event_id", "vec_id")


@query
def op9_secret_links(spark, d):
    from hindcast.llm.secret_links import BASE, find_secrets, span_text

    found = find_secrets(events_of(documents(spark, d)))
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return found.select(F.col("event_id").alias("doc_id"), "n_assign", "n_access", "n_hex",
                        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


@query
def op1_line_dedup(spark, d):
    from hindcast.llm.lines import line_components

    return (line_components(events_of(documents(spark, d))).withColumnRenamed("event_id", "doc_id")
            .withColumnRenamed("first_event_id", "first_doc_id"))


def rejections(labels: DataFrame) -> DataFrame:
    """Labels as (event_id, rejected): low quality and toxic documents are to go."""
    return labels.select(F.col("doc_id").alias("event_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1))
                         .alias("rejected"))


@query
def op5_quality_bayes(spark, d):
    from hindcast.llm.quality import score_quality

    labels = rejections(spark.read.parquet(f"{d}/labels.parquet"))
    return score_quality(events_of(documents(spark, d)), labels).withColumnRenamed("event_id", "doc_id")


@query
def op8_benchmark_tiling(spark, d):
    from hindcast.llm.tiling import item_coverage

    return (item_coverage(events_of(documents(spark, d)), spark.read.parquet(f"{d}/benchmark.parquet"))
            .withColumnRenamed("event_id", "doc_id"))


@query
def op7_reply_trees(spark, d):
    from pyspark.sql import Window

    from hindcast.llm.replies import format_reply_trees, read_loss, read_turns

    said = r"\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(
        spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                              "conv_id long, turn long, role string, text string"))
    # Every row answers the one before it.
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    turns = rows.select(F.col("conv_id").alias("thread"), number.alias("turn_no"), (number - 1).alias("reply_to"),
                        F.col("role").alias("origin"), "text", F.lit(1.0).alias("confidence"))
    back = (format_reply_trees(turns, learned="assistant")
            .select("thread", "formatted", read_turns(F.col("formatted")).alias("turns"),
                    read_loss(F.col("formatted"), F.col("loss")).alias("learned")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["origin"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("thread").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(spoken, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op11_bpe_trees(spark, d):
    from hindcast.llm.bpe_trees import encode_texts

    ids = F.col("ids")
    return (encode_texts(events_of(documents(spark, d)), tokenizer("word_bpe_49k.json"), decode=True)
            .select(F.col("event_id").alias("doc_id"), F.size(ids).cast("long").alias("n_tokens"),
                    F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256")))


@query
def op12_merkle_manifest(spark, d):
    from hindcast.llm.merkle import FIELDS, fold, leaf_digest, manifest, siblings

    # The copy to be audited: of every fifth event by checksum, the text is in lower case.
    altered = F.crc32(F.col("event_id").cast("string")) % 5 == 0
    copy = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.when(altered, copy).otherwise(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    activity = documents(spark, d).select(
        F.col("doc_id").alias("event_id"), F.col("source").alias("app"), F.col("lang").alias("window"),
        F.col("n_chars").alias("text_len"), "text").withColumn("audited", leaf_digest(*fields))
    proven = manifest(activity, keep=["audited"])
    return (proven.withColumn("folded_root", fold(F.col("audited"), F.col("proof")))
            .select(F.col("event_id").alias("doc_id"), "leaf", "subroot", "root",
                    F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


@query
def op13_periodic_runs(spark, d):
    from hindcast.llm.periodic import periodic_runs

    # One text in ten, by checksum, repeats its words from a place on.
    h = F.crc32(F.col("doc_id").cast("string"))
    texts = (documents(spark, d).select("doc_id", "text", h.alias("h"))
             .withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(
                 "text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
             .select("doc_id", "text", "w", F.expr("h div 10").alias("g"), F.size("w").alias("n"))
             .select("*", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")).alias("a"))
             .select("*", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)").alias("p")))
    repeated = F.array_join(F.concat(F.slice("w", 1, F.col("a")), F.slice(F.flatten(F.array_repeat(
        F.slice("w", F.col("a") + 1, F.col("p")), F.expr("cast((n - a) div p + 1 as int)"))), 1, F.expr("n - a"))), " ")
    found = periodic_runs(texts.select(F.col("doc_id").alias("event_id"),
                                       F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text")))
    best = F.try_element_at(F.array_sort("runs", lambda x, y: (
        y["length"] * x["period"] - x["length"] * y["period"]).cast("int")), F.lit(1))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (found.withColumn("best", best).select(
        F.col("event_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
