"""A job for spark-submit: corpus in; dictionary, co-occurrences, model, Theta, predictions and scores out."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.options import key_values, topic_groups
from .operators import cooc as C
from .operators import dictionary as D
from .operators.matrix import top_tokens
from .plans.config import SCORES, dictionary_bounds, regularizer
from .plans.model import TopicModel
from .schema import DEFAULT_CLASS
from .sources import uci, vw, writers
from .sources.vectorizer import only_classes


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="thema", description=__doc__)
    p.add_argument("-c", "--read-vw-corpus")
    p.add_argument("-d", "--read-uci-docword")
    p.add_argument("-v", "--read-uci-vocab")
    p.add_argument("--read-parquet", help="item_id, class_id, token, weight")
    p.add_argument("--use-batches", help="a folder of --save-batches")
    p.add_argument("--read-cooc", help="lines of co-occurring tokens, for ImproveCoherence and Biterms")
    p.add_argument("--symmetric-cooc", action="store_true", help="each pair read counts both ways")
    p.add_argument("--transactions", action="store_true", help="the lines hold transactions")
    p.add_argument("--use-modality", default="", help='"@a:1;@b:0.5"')
    p.add_argument("--dictionary-min-df")
    p.add_argument("--dictionary-max-df")
    p.add_argument("--dictionary-size", type=int)
    p.add_argument("--use-dictionary")
    p.add_argument("--cooc-window", type=int, default=5)
    p.add_argument("--cooc-min-tf", type=int, default=0)
    p.add_argument("--cooc-min-df", type=int, default=0)
    p.add_argument("--store-symmetric-cooc", action="store_true")
    p.add_argument("-t", "--topics", default="16")
    p.add_argument("--load-model")
    p.add_argument("--dense-init-rate", type=float, default=1.0)
    p.add_argument("--guaranteed-zeros-rate", type=float, default=0.0)
    p.add_argument("--rand-seed", type=int, default=-1)
    p.add_argument("-p", "--passes", type=int, default=0)
    p.add_argument("--num-document-passes", type=int, default=10)
    p.add_argument("--update-every", type=int, default=0, help="documents of an online update; 0 is offline")
    p.add_argument("--tau0", type=float, default=1024)
    p.add_argument("--kappa", type=float, default=0.7)
    p.add_argument("--asynchronous", action="store_true")
    p.add_argument("--reuse-theta", action="store_true")
    p.add_argument("--regularizer", action="append", default=[], help='"tau Type #topics @classes ?dictionary"; ?cooc is what --read-cooc reads')
    p.add_argument("--score", action="append", default=[], help="a score of each pass, by its type, as Perplexity or TopTokens")
    p.add_argument("--final-score", action="append", default=[], help="a score after the last pass")
    p.add_argument("--time-limit", type=float, default=0, help="seconds after which no other pass begins")
    p.add_argument("--predict-class")
    p.add_argument("--csv-separator", default=";")
    p.add_argument("--score-level", type=int, default=2)
    for name in ("dictionary", "dictionary-readable", "cooc-tf", "cooc-df", "ppmi-tf", "ppmi-df", "model", "model-readable", "predictions", "class-predictions", "scores", "vw-corpus", "batches"):
        p.add_argument(f"--write-{name}" if name in ("predictions", "class-predictions", "scores", "vw-corpus", "cooc-tf", "cooc-df", "ppmi-tf", "ppmi-df") else f"--save-{name}")
    return p


def corpus(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.read_vw_corpus:
        return vw.read_vw(spark, a.read_vw_corpus, a.transactions)
    if a.read_uci_docword:
        return uci.read_docword(spark, a.read_uci_docword, uci.read_vocab(spark, a.read_uci_vocab) if a.read_uci_vocab else None)
    if a.read_parquet:
        return spark.read.parquet(a.read_parquet)
    if a.use_batches:
        return writers.read_batches(spark, a.use_batches).drop("batch_id")
    raise SystemExit("no corpus: give one of --read-vw-corpus, --read-uci-docword, --read-parquet, --use-batches")


def cooc_sequences(ndw: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(item_id, class_id, tokens): an item's tokens of a modality by position. A window spans that many places of the item, so tokens of other
    modalities and outside the dictionary take up their places, as null."""
    if "pos" not in ndw.columns:
        raise SystemExit("co-occurrences need the order of tokens, which bags of words don't have")
    known = ndw.join(dictionary.select("class_id", "token", F.lit(True).alias("known")), ["class_id", "token"], "left")
    items = known.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "class_id", F.when(F.col("known"), F.col("token")).alias("token")))).alias("x"), F.collect_set("class_id").alias("classes"))
    one = items.select("item_id", "x", F.explode("classes").alias("class_id"))
    return one.select("item_id", "class_id", F.transform("x", lambda t: F.when(t["class_id"] == F.col("class_id"), t["token"])).alias("tokens"))


def write_cooc(ndw: DataFrame, dictionary: DataFrame, a: argparse.Namespace) -> None:
    """Co-occurrences within modalities, of tokens of the dictionary; tokens of modalities but the default are written behind "|class "."""
    if not any((a.write_cooc_tf, a.write_cooc_df, a.write_ppmi_tf, a.write_ppmi_df)):
        return
    docs = cooc_sequences(ndw, dictionary).withColumn("tokens", F.transform("tokens", lambda t: F.struct(F.col("class_id").alias("c"), t.alias("t"))))
    pairs = C.window_pairs(docs, a.cooc_window).where("u.t IS NOT NULL AND v.t IS NOT NULL")
    cooc = C.selected(C.cooccurrence(pairs, a.store_symmetric_cooc), a.cooc_min_tf, a.cooc_min_df)
    for path, value in ((a.write_cooc_tf, "tf"), (a.write_cooc_df, "df")):
        if path:
            writers.cooc_lines(_named(cooc, value), value).write.text(path)
    totals = {"tf": pairs.agg((2 * F.count(F.lit(1))).alias("n")), "df": docs.agg(F.count_distinct("item_id").alias("n"))}
    margins = C.marginals(pairs, docs.withColumn("tokens", F.filter("tokens", lambda x: x["t"].isNotNull())))
    for path, measure in ((a.write_ppmi_tf, "tf"), (a.write_ppmi_df, "df")):
        if path:
            writers.cooc_lines(_named(C.ppmi(cooc, margins, measure, totals[measure]), "value"), "value").write.text(path)


def _named(cooc: DataFrame, value: str) -> DataFrame:
    """Pairs of (class, token) as their text."""
    text = lambda x: F.when(F.col(f"{x}.c") == DEFAULT_CLASS, F.col(f"{x}.t")).otherwise(F.concat(F.lit("|"), F.col(f"{x}.c"), F.lit(" "), F.col(f"{x}.t")))
    return cooc.select(text("u").alias("u"), text("v").alias("v"), value)


def read_cooc(spark: SparkSession, a: argparse.Namespace) -> dict[tuple[str, str, str], float]:
    """(class, u, v) -> value of pairs within a class, for regularizers of the driver's model."""
    if not a.read_cooc:
        return {}
    own = writers.parse_cooc(spark.read.text(a.read_cooc), a.symmetric_cooc).where("class_u = class_v")
    return {(r["class_u"], r["u"], r["v"]): r["value"] for r in own.toLocalIterator()}


def with_tables(spark: SparkSession, named: dict, texts: list[str], cooc: dict, dictionary: DataFrame) -> dict:
    """Regularizers with the tables that their "?name" gives: cooc, dictionary (the job's own) or a dictionary's path. Without one, those that
    work on co-occurrences get what --read-cooc reads; it is an error if there is none."""
    for text in texts:
        r = named[text]
        table = next((x[1:] for x in text.split() if x.startswith("?")), None)
        if hasattr(r, "cooc"):
            if not cooc:
                raise SystemExit(f"{text!r} needs --read-cooc")
            r.cooc = cooc
        elif table is not None and hasattr(r, "dictionary"):
            own = dictionary if table == "dictionary" else spark.read.parquet(table)
            r.dictionary = {(x["class_id"], x["token"]): x["value"] for x in own.select("class_id", "token", "value").toLocalIterator()}
    return named


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> TopicModel | None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("thema").getOrCreate()
    began = time.monotonic()
    weights = dict(key_values(a.use_modality)) if a.use_modality else {}
    ndw = only_classes(corpus(spark, a), list(weights))
    if a.use_dictionary:
        dictionary = spark.read.parquet(a.use_dictionary)
    else:
        bounds = dictionary_bounds(a.dictionary_min_df, a.dictionary_max_df)
        items = ndw.select("item_id").distinct().count() if any(k.endswith("rate") for k in bounds) else None
        dictionary = D.filtered(D.gather(ndw), num_items=items, max_size=a.dictionary_size, **bounds)
    write_cooc(ndw, dictionary, a)
    if a.save_dictionary:
        writers.write_dictionary(dictionary, a.save_dictionary)
    if a.save_dictionary_readable:
        writers.write_csv(dictionary.select("token", "class_id", "tf", "df"), a.save_dictionary_readable, a.csv_separator)
    if a.write_vw_corpus:
        own = ndw if "title" in ndw.columns else ndw.withColumn("title", F.col("item_id").cast("string"))
        vw.vw_lines(own).select("value").write.text(a.write_vw_corpus)
    if a.save_batches:
        writers.write_batches(ndw, a.save_batches)
    if not a.passes and not a.load_model:
        return None
    groups = topic_groups(a.topics)
    topics = [t for g in groups.values() for t in g]
    if a.load_model:
        model = TopicModel.load(spark, a.load_model)
    else:
        model = TopicModel(topics, dictionary, weights or None, None, a.num_document_passes, a.rand_seed, reuse_theta=a.reuse_theta, dense_rate=a.dense_init_rate, zero_rate=a.guaranteed_zeros_rate)
    model.regularizers |= with_tables(spark, dict(regularizer(x, groups, model.topics) for x in a.regularizer), a.regularizer, read_cooc(spark, a), dictionary)
    model.scores |= {x: SCORES[x]() for x in a.score}
    docs = model.encode(ndw)
    for _ in range(a.passes):
        if a.time_limit and time.monotonic() - began > a.time_limit:
            break
        if a.update_every:
            n = max(1, -(-docs.count() // a.update_every))
            model.fit_online([docs.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)], a.tau0, a.kappa, asynchronous=a.asynchronous)
        else:
            model.fit_offline(docs)
    if model.history:
        model.history[-1] |= {x: SCORES[x]()(model.m) for x in a.final_score}
    if a.save_model:
        model.save(spark, a.save_model)
    if a.save_model_readable:
        writers.write_csv(writers.wide(model.matrix(spark), ["token", "class_id"], model.topics), a.save_model_readable, a.csv_separator)
    if a.write_predictions:
        writers.write_csv(writers.theta_table(model.transform(docs), model.topics), a.write_predictions, a.csv_separator)
    if a.predict_class and a.write_class_predictions:
        writers.write_csv(writers.class_table(model.predict(docs, a.predict_class)), a.write_class_predictions, a.csv_separator)
    if a.write_scores:
        rows = [(json.dumps(h, default=str),) for h in model.history]
        if a.score_level > 1:
            rows += [(json.dumps(r.asDict()),) for r in top_tokens(model.matrix(spark)).collect()]
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(a.write_scores)
    return model


if __name__ == "__main__":
    main()
