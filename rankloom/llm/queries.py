"""The operators bound to the given tables: name -> (session, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.llm import (cascade, chat_tree, lexical, merge_tree, mixing, near_text, near_vectors, packing, periodic_runs,
                          quality_model, token_edits, url_rules, warc)
from rankloom.llm import words
from rankloom.staging import stage

# Vocabulary files come with the machine; their place is a setting.
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_tokenizer() -> tuple[str, str]:
    """(vocabulary file, pre-token pattern)"""
    import public_tokenizers

    return tokenizer_path(BYTE_BPE), public_tokenizers.PATTERN


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


# The rules that urls are judged by.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


def op1_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    stats = stage(quality_model.with_stats(docs), "stats")
    model = quality_model.learn(stats, table(spark, folder, "labels", "doc_id", "quality"))
    return (quality_model.score_stats(stats, model, ("doc_id",))
            .select("doc_id", (quality_model.fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted")))


def sample_edits(key, text):
    """Three edits for every text, at places that its id gives: words replaced, inserted and deleted."""
    n = F.length(F.coalesce(text, F.lit("")))
    place = lambda salt: F.pmod(F.xxhash64(key, F.lit(salt)), n + 1).cast("int")
    edit = lambda start, size, new: F.struct(start.alias("start"), (start + size).alias("stop"), F.lit(new).alias("replacement"))
    return F.array(edit(place("replace"), 12, "naïve re-write's 2024"), edit(place("insert"), 0, " (see\n\n  below) "),
                   edit(place("delete"), 40, ""))


def op2_token_counts(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    trees = token_edits.build_trees(docs.withColumn("edits", sample_edits(F.col("doc_id"), F.col("text"))), *byte_tokenizer())
    edited = token_edits.apply_edits(trees.withColumnRenamed("n_tokens", "n_tokens_before")
                                     .withColumn("n_tokens", F.col("n_tokens_before")), *byte_tokenizer())
    return edited.select("doc_id", "n_tokens_before", F.col("n_tokens").alias("n_tokens_after"),
                         F.col("n_encoded").alias("pieces_encoded"))


def op3_url_filter(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return (url_rules.judge_urls(table(spark, folder, "pages", "page_id", "url"), "url", rules)
            .select("page_id", "host", "path", "rule", "verdict"))


def op4_quality_rules(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    rules = cascade.plan_cascade(docs, cascade.default_rules(lambda m: cascade.METRICS[m](F.col("text"))))
    by_name = {rule.name: rule for rule in cascade.default_rules(F.col)}
    kept = ~cascade.rejected([by_name[rule.name] for rule in rules])
    failed = cascade.base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return cascade.base_metrics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                             "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))


def op5_near_documents(spark, folder):
    classes = near_text.near_classes(table(spark, folder, "documents", "doc_id", "text"))
    return classes.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def op6_chat_format(spark, folder):
    hard = "</s>[INST] ok [/INST]"
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], rows.schema)
    file = byte_tokenizer()
    trees = stage(chat_tree.chat_trees(chat_tree.conversations(rows.unionByName(extra)), *file), "chat-trees")
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("trained", "")
    return chat_tree.read_conversations(trees, *file).select(
        F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"), F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op7_source_mix(spark, folder):
    return mixing.mix(table(spark, folder, "documents", "doc_id", "text", "source")).drop("runs")


def op8_packing(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents", "doc_id", "text"), tokenizer_path(WORD_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "window", "step_group")


def op9_warc(spark, folder):
    read = warc.archived(table(spark, folder, "pages", "page_id", "url", "html"))
    number = lambda name: F.expr(f"try_cast(regexp_extract({name}, '^<urn:page:(.*)>$', 1) AS bigint)")
    return (read.where("problem IS NULL")
            .select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to")))


def op10_near_vectors(spark, folder):
    found = near_vectors.near_links(table(spark, folder, "embeddings", "vec_id", "embedding", "label"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op11_lexical_search(spark, folder):
    return lexical.rank_documents(table(spark, folder, "documents", "doc_id", "text"),
                                  table(spark, folder, "benchmark", "item_id", "text"))


def planted_periods(key, text):
    """The text, or for a tenth of the ids its words with a tail that repeats with a period that the id gives."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        at = F.pmod(g, n)
        period = 1 + F.floor((n - at) / (3 + g % 8))
        place = lambda i: F.when(i >= at, at + F.pmod(i - at, period)).otherwise(i).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.get(w, place(i))), " ")

    return F.when((h % 10 == 0) & F.coalesce(F.rlike(text, F.lit(words.WORD)), F.lit(False)),
                  words.let(words.words(text), repeated)).otherwise(text)


def op12_periodic_runs(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = periodic_runs.periodic_runs(docs.withColumn("text", planted_periods(F.col("doc_id"), F.col("text"))))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    longest = found.withColumn("longest", periodic_runs.longest_run(F.col("runs")))
    hashed = lambda text: F.sha2(text.cast("binary"), 256)
    return longest.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period",
        F.floor(1000 * F.col("longest.length") / F.col("longest.period")).alias("exponent_milli"),
        hashed(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), hashed(F.col("collapsed")).alias("collapsed_sha256"))


def op13_byte_bpe(spark, folder):
    path = tokenizer_path(BYTE_BPE)
    encoded = merge_tree.encode_texts(table(spark, folder, "documents", "doc_id", "text"), path)
    return merge_tree.decode_ids(encoded, path).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_token_counts, op3_url_filter, op4_quality_rules, op5_near_documents, op6_chat_format, op7_source_mix, op8_packing, op9_warc,
    op10_near_vectors, op11_lexical_search, op12_periodic_runs, op13_byte_bpe)}
