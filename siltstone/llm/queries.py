"""The operators' queries over the test tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.llm import decontaminate, fim, hmm, html, language, licenses, mixing, neardup, neighbours, simhash, substrings, urls, whitening
from siltstone.llm.common import fold, table


def op1_suffix_dedup(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs.select("doc_id", "text"), language.train(docs)).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_nearest_vectors(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op5_mix_sources(spark, sf_dir):
    out = mixing.weigh(table(spark, sf_dir, "documents"))
    return out.withColumn("weight", F.round("weight", 8)).withColumn("p", F.round("p", 8))


def op6_near_dedup(spark, sf_dir):
    return neardup.classes(table(spark, sf_dir, "documents"))


def op7_hmm_score(spark, sf_dir):
    return hmm.score(table(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark, sf_dir):
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_extract_html(spark, sf_dir):
    out = html.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_simhash(spark, sf_dir):
    out = simhash.classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op12_fill_in_middle(spark, sf_dir):
    out = fim.transform(table(spark, sf_dir, "documents"))
    restored = fim.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from siltstone.llm.oracles import SQL

    return {k: v for k, v in SQL.items() if k in queries()}
