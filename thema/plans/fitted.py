"""Queries that fit models. Their start values are a generator's, which SQL can't state; those from closed-form values have SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import words
from ..operators import dictionary as D
from ..operators import matrix as M
from ..operators import windows as W
from ..operators.phi_regularizers import DecorrelatorPhi, SmoothSparsePhi
from ..operators.theta_regularizers import SmoothSparseTheta, TopicSegmentationPtdw
from ..schema import DEFAULT_CLASS
from ..storage import spread, written
from .corpus import TOPICS, bow, document_words, start_rows, table, text_bags
from .hierarchy import Hierarchy
from .lda import partitioned_lda
from .model import TopicModel
from .partitioned import PartitionedModel, bags


def _corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as bags of words, and their whole dictionary."""
    own = written(bow(table(spark, d, "documents")))
    return own, D.gather(own)


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """As _corpus(), a row for each document."""
    return text_bags(table(spark, d, "documents")), written(W.token_dictionary(document_words(spark, d)))


def _top(model, spark: SparkSession, k: int = 10) -> DataFrame:
    return M.top_tokens(model.matrix(spark), k).withColumn("value", F.round("value", 6))


def fit_offline(spark: SparkSession, d: str) -> DataFrame:
    """Top tokens after five passes with sparse, decorrelated topics."""
    ndw, dictionary = _documents(spark, d)
    model = PartitionedModel(8, dictionary, regularizers={"sparse": SmoothSparsePhi(-0.1), "decorrelator": DecorrelatorPhi(1e3), "theta": SmoothSparseTheta(-0.1)})
    return _top(model.fit_offline(ndw, 5), spark)


def fit_history(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity and sparsity by pass."""
    ndw, dictionary = _documents(spark, d)
    model = PartitionedModel(8, dictionary, collection_unigram=True).fit_offline(ndw, 4)
    rows = [(h["pass"], round(h["perplexity"], 3), round(h["sparsity_phi"][DEFAULT_CLASS], 6), round(h["sparsity_theta"], 6)) for h in model.history]
    return spark.createDataFrame(rows, "pass int, perplexity double, sparsity_phi double, sparsity_theta double")


def fit_online(spark: SparkSession, d: str) -> DataFrame:
    """Top tokens after one online pass in four chunks."""
    ndw, dictionary = _documents(spark, d)
    model = PartitionedModel(8, dictionary)
    chunks = [ndw.where(F.pmod("item_id", F.lit(4)) == i) for i in range(4)]
    return _top(model.fit_online(chunks, tau0=1.0, kappa=0.5), spark)


def transform_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Theta of benchmark items under a model of the documents."""
    ndw, dictionary = _documents(spark, d)
    model = PartitionedModel(8, dictionary).fit_offline(ndw, 3)
    theta = model.transform(text_bags(table(spark, d, "benchmark"), "item_id"))
    return theta.select("item_id", F.posexplode("theta").alias("topic", "value")).withColumn("value", F.round("value", 6))


def lda(spark: SparkSession, d: str) -> DataFrame:
    ndw, dictionary = _documents(spark, d)
    return _top(partitioned_lda(6, dictionary, alpha=0.1, beta=0.01).fit_offline(ndw, 3), spark)


def multimodal(spark: SparkSession, d: str) -> DataFrame:
    """Language and source as modalities of their own, next to the words."""
    docs = table(spark, d, "documents")
    tags = {c: docs.groupBy(F.col(name).alias("token")).agg(F.count(F.lit(1)).cast("double").alias("tf"), F.count_distinct("doc_id").cast("double").alias("df")).where("token IS NOT NULL").select(F.lit(c).alias("class_id"), "token", "tf", "df") for c, name in (("@lang", "lang"), ("@source", "source"))}
    words_of = W.token_dictionary(document_words(spark, d))
    dictionary = words_of.select("class_id", "token", "tf", "df").unionAll(tags["@lang"]).unionAll(tags["@source"])
    one = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    ndw = bags(spread(docs.select("doc_id", "text", "lang", "source")).select(F.col("doc_id").alias("item_id"), F.array(*[F.lit(c) for c in (DEFAULT_CLASS, "@lang", "@source")]).alias("classes"), F.array(words("text"), one("lang"), one("source")).alias("lists")))
    model = PartitionedModel(6, D.with_share(dictionary), class_weights={DEFAULT_CLASS: 1.0, "@lang": 10.0, "@source": 1.0}).fit_offline(ndw, 4)
    return model.matrix(spark).where(F.col("class_id") == "@lang").withColumn("value", F.round("value", 6))


def hierarchy_psi(spark: SparkSession, d: str) -> DataFrame:
    """Subtopics given topics."""
    ndw, dictionary = _documents(spark, d)
    h = Hierarchy()
    h.add_level(PartitionedModel(3, dictionary))
    h.add_level(PartitionedModel(6, dictionary, seed=1))
    psi = h.fit_offline(ndw, 2).get_psi(1)
    return spark.createDataFrame([(t, p, round(float(psi.loc[t, p]), 6)) for t in psi.index for p in psi.columns], "topic string, parent string, value double")


def ptdw_segmentation(spark: SparkSession, d: str) -> DataFrame:
    """The main topic of every word of conversations, in segments."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("item_id"), F.posexplode(words("text")).alias("pos", "token"))
    ndw = turns.select("item_id", "pos", F.lit(DEFAULT_CLASS).alias("class_id"), "token", F.lit(1.0).alias("weight"))
    model = TopicModel(5, D.gather(ndw)).fit_offline(ndw, 2)
    model.regularizers["segments"] = TopicSegmentationPtdw(10, 0.2)
    p = model.transform(ndw, "ptdw")
    return p.select("item_id", "pos", (F.array_position("p", F.lit(1.0)) - 1).alias("topic"))


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as transactions of part, flag and status: p(x|d) of every line after three passes. Line numbers repeat within
    orders, so lines are numbered anew (line, from 0); which of two equal lines is which doesn't matter."""
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")) - 1
    lines = written(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), line.alias("line"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").cast("string").alias("part"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")))
    x = F.array(*[F.struct(F.lit(f"@{c}").alias("c"), F.col(c).alias("t")) for c in ("part", "flag", "status")])
    orders = lines.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("line", x.alias("x")))).alias("lines"))
    one = lambda y, c: F.struct((y["line"] * 3 + c).cast("int").alias("pos"), y["x"][c]["c"].alias("class_id"), y["x"][c]["t"].alias("token"), F.lit(1.0).alias("w"), y["line"].cast("int").alias("tx"), F.lit(1.0).alias("tx_weight"))
    own = orders.select("item_id", F.flatten(F.transform("lines", lambda y: F.array(*[one(y, c) for c in range(3)]))).alias("x"))
    docs = written(own.select("item_id", F.col("item_id").cast("string").alias("title"), F.lit(1.0).alias("scale"), "x", F.lit(True).alias("typed")))
    names = F.transform("x", lambda y: F.struct(y["class_id"].alias("class_id"), y["token"].alias("token")))
    count = lambda a, n: docs.select(F.explode(a).alias("y")).groupBy("y.class_id", "y.token").agg(F.count(F.lit(1)).cast("double").alias(n))
    dictionary = D.with_share(count(names, "tf").join(count(F.array_distinct(names), "df"), ["class_id", "token"]))
    model = PartitionedModel(4, dictionary, document_passes=5).fit_offline(docs, 3)
    p = model.transform(docs, "ptx").select("item_id", F.col("pos").alias("line"), F.round("p", 6).alias("p"))
    return lines.select("item_id", "line", "line_number").join(p, ["item_id", "line"])


def stream_online(spark: SparkSession, d: str) -> DataFrame:
    """Top tokens of events learnt from a stream of files: users as items, event types and hours as modalities."""
    from ..storage import shared_dir
    from ..streaming.online import learn

    events = table(spark, d, "events")

    def to_ndw(df: DataFrame) -> DataFrame:
        x = F.array(F.struct(F.lit("@type").alias("c"), F.col("event_type").alias("t")), F.struct(F.lit("@hour").alias("c"), F.hour("ts").cast("string").alias("t")))
        one = df.select(F.col("user_id").alias("item_id"), F.explode(x).alias("x"))
        return one.groupBy("item_id", F.col("x.c").alias("class_id"), F.col("x.t").alias("token")).agg(F.count(F.lit(1)).cast("double").alias("weight"))

    model = TopicModel(3, D.gather(to_ndw(events)))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parque[t]")
    learn(stream, model, to_ndw, shared_dir(spark), tau0=1.0).trigger(availableNow=True).start().awaitTermination()
    return _top(model, spark, 5)


# -- fits from closed-form start values, which SQL can state: TOPICS topics, one pass over each document ---------------------


def _em(i: int, bow: str = "bow", phi: str | None = None, alpha: float = 0.0, scale: str = "1.0") -> str:
    """SQL of the counters n{i+1} that a pass over `bow` gives under `phi`, with Theta from equal shares."""
    phi = phi or f"phi{i}"
    return f"""a{i} AS (SELECT b.item_id, b.token, b.weight, {scale} AS scale, p.topic, p.value AS phi FROM {bow} b JOIN {phi} p USING (token)),
za{i} AS (SELECT *, sum(phi) OVER (PARTITION BY item_id, token, scale) AS z FROM a{i}),
na{i} AS (SELECT item_id, scale, topic, sum(CASE WHEN z / {TOPICS} >= 1e-16 THEN weight * phi / z ELSE 0 END) + {alpha} AS n FROM za{i} GROUP BY ALL),
ta{i} AS (SELECT item_id, scale, topic, n / sum(n) OVER (PARTITION BY item_id, scale) AS v FROM na{i}),
t{i} AS (SELECT item_id, scale, topic, CASE WHEN v < 1e-16 THEN 0.0 ELSE v END AS value FROM ta{i}),
q{i} AS (SELECT a.item_id, a.scale, a.token, a.weight, a.topic, a.phi * t.value AS q FROM a{i} a JOIN t{i} t ON t.item_id = a.item_id AND t.topic = a.topic AND t.scale = a.scale),
zq{i} AS (SELECT *, sum(q) OVER (PARTITION BY item_id, token, scale) AS z FROM q{i}),
n{i + 1} AS (SELECT token, topic, sum(CASE WHEN z >= 1e-16 THEN scale * weight * q / z ELSE 0 END) AS value FROM zq{i} GROUP BY ALL)"""


def _norm(i: int, of: str, beta: float = 0.0) -> str:
    return f"phi{i} AS (SELECT token, topic, (value + {beta}) / sum(value + {beta}) OVER (PARTITION BY topic) AS value FROM {of})"


def _started(spark: SparkSession, d: str, kind=PartitionedModel, **options):
    """Bags of words and a model with the start values of corpus.start_weights in both matrices."""
    ndw, dictionary = _documents(spark, d)
    return ndw, kind([str(t) for t in range(TOPICS)], dictionary, document_passes=1, start=start_rows(dictionary), **options)


def _phi_of(model: PartitionedModel, spark: SparkSession) -> DataFrame:
    return model.matrix(spark).select("token", F.col("topic").cast("int").alias("topic"), F.round("value", 9).alias("value"))


def fit_started(spark: SparkSession, d: str) -> DataFrame:
    """Phi after two offline passes."""
    ndw, model = _started(spark, d)
    return _phi_of(model.fit_offline(ndw, 2), spark)


def online_weights(spark: SparkSession, d: str) -> DataFrame:
    """Phi after two online updates, by odd and even documents, with tau0 = 1 and kappa = 0.5."""
    ndw, model = _started(spark, d)
    return _phi_of(model.fit_online([ndw.where(F.pmod("item_id", F.lit(2)) == i) for i in (0, 1)], 1.0, 0.5), spark)


def batch_weighted_nwt(spark: SparkSession, d: str) -> DataFrame:
    """n_wt of a pass over documents and, at half weight, benchmark items."""
    ndw, model = _started(spark, d)
    model.process(ndw.unionAll(text_bags(table(spark, d, "benchmark"), "item_id", 0.5)))
    return model.matrix(spark, "nwt").where("value <> 0").select("token", F.col("topic").cast("int").alias("topic"), F.round("value", 6).alias("value"))


def transform_started(spark: SparkSession, d: str) -> DataFrame:
    """Theta of benchmark items under the start values."""
    _, model = _started(spark, d)
    theta = model.transform(text_bags(table(spark, d, "benchmark"), "item_id"))
    return theta.select("item_id", F.posexplode("theta").alias("topic", "value")).withColumn("value", F.round("value", 6))


def lda_started(spark: SparkSession, d: str) -> DataFrame:
    """Phi after a pass of LDA with alpha = 0.1 and beta = 0.01."""
    ndw, model = _started(spark, d, partitioned_lda, alpha=0.1, beta=0.01)
    return _phi_of(model.fit_offline(ndw, 1), spark)


def perplexity_started(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity of the first two passes, as the model's history has it."""
    ndw, model = _started(spark, d, collection_unigram=True)
    model.fit_offline(ndw, 2)
    return spark.createDataFrame([(h["pass"], round(h["perplexity"], 4)) for h in model.history], "pass int, perplexity double")


def cooc_by_modality(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with a speaker's role as the modality of their words: pairs of the same modality within five places, of words of documents."""
    from ..cli import cooc_sequences

    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("item_id"), "turn", "role", F.posexplode(words("text")).alias("p", "token"))
    ndw = turns.select("item_id", F.row_number().over(Window.partitionBy("item_id").orderBy("turn", "p")).alias("pos"), F.col("role").alias("class_id"), "token")
    vocabulary = W.token_sums(W.items(document_words(spark, d))).select("token").crossJoin(ndw.select("class_id").distinct())
    docs = cooc_sequences(ndw, vocabulary)
    sign = "\u0000"  # which no word has
    tagged = docs.select("item_id", F.transform("tokens", lambda t: F.concat("class_id", F.lit(sign), t)).alias("tokens"))
    part = lambda c, i: F.substring_index(c, sign, i)
    return W.cooccurrence(tagged, 5).select(part("u", 1).alias("class_id"), part("u", -1).alias("u"), part("v", -1).alias("v"), "tf", "df")


def _sql() -> dict[str, str]:
    from .queries import PHI, WORD

    phi = f"{PHI}, phi0 AS (SELECT * FROM phi)"
    bench = "bench AS (SELECT item_id, token, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '<word>')) AS token FROM benchmark) GROUP BY ALL)"
    likelihood = """x{i} AS (SELECT q.item_id, q.token, q.weight, sum(q.q) AS p FROM q{i} q GROUP BY ALL),
l{i} AS (SELECT exp(-sum(weight * ln(CASE WHEN p < 1e-16 THEN u ELSE p END)) / sum(weight)) AS perplexity FROM (SELECT x{i}.*, dict.value AS u FROM x{i} JOIN dict USING (token)))"""
    rho = [2**-0.5, 3**-0.5]
    merged = "m{j} AS (SELECT p.token, p.topic, {d!r} * p.value + {a!r} * coalesce(n.value, 0) AS value FROM {before} p LEFT JOIN n{j} n ON n.token = p.token AND n.topic = p.topic)"
    out = {
        "fit_started": f"WITH {phi}, {_em(0)}, {_norm(1, 'n1')}, {_em(1)}, {_norm(2, 'n2')} SELECT token, topic, round(value, 9) AS value FROM phi2",
        "online_weights": f"""WITH {phi}, even AS (SELECT * FROM bow WHERE item_id % 2 = 0), odd AS (SELECT * FROM bow WHERE item_id % 2 = 1), {_em(0, "even")}, {merged.format(j=1, d=1 - rho[0], a=rho[0], before="phi0")}, {_norm(1, "m1")},
{_em(1, "odd")}, {merged.format(j=2, d=1 - rho[1], a=rho[1], before="m1")}, {_norm(2, "m2")} SELECT token, topic, round(value, 9) AS value FROM phi2""",
        "batch_weighted_nwt": f"""WITH {phi}, {bench}, every AS (SELECT *, 1.0 AS s FROM bow UNION ALL SELECT *, 0.5 FROM bench), {_em(0, "every", scale="b.s")} SELECT token, topic, round(value, 6) AS value FROM n1 WHERE value <> 0""",
        "transform_started": f"WITH {phi}, {bench}, {_em(0, 'bench')} SELECT item_id, topic, round(value, 6) AS value FROM t0",
        "lda_started": f"WITH {phi}, {_em(0, alpha=0.1)}, {_norm(1, 'n1', 0.01)} SELECT token, topic, round(value, 9) AS value FROM phi1",
        "perplexity_started": f"WITH {phi}, {_em(0)}, {_norm(1, 'n1')}, {_em(1)}, {likelihood.format(i=0)}, {likelihood.format(i=1)} SELECT 1 AS pass, round(perplexity, 4) AS perplexity FROM l0 UNION ALL SELECT 2, round(perplexity, 4) FROM l1",
        "cooc_by_modality": """WITH t AS (SELECT conv_id AS item_id, turn, role AS class_id, regexp_extract_all(lower(text), '<word>') AS toks FROM conversations), w AS (SELECT item_id, turn, class_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS p FROM t),
pos AS (SELECT item_id, class_id, token, row_number() OVER (PARTITION BY item_id ORDER BY turn, p) AS pos FROM w), v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '<word>')) AS token FROM documents), known AS (SELECT * FROM pos WHERE token IN (SELECT token FROM v)),
pairs AS (SELECT a.item_id, a.class_id, a.token AS u, b.token AS v FROM known a JOIN known b ON a.item_id = b.item_id AND a.class_id = b.class_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 5),
both_ways AS (SELECT item_id, class_id, u, v FROM pairs UNION ALL SELECT item_id, class_id, v, u FROM pairs) SELECT class_id, u, v, count(*) AS tf, count(DISTINCT item_id) AS df FROM both_ways GROUP BY class_id, u, v""",
    }
    return {k: v.replace("<word>", WORD) for k, v in out.items()}


QUERIES = {f.__name__: f for f in (fit_started, online_weights, batch_weighted_nwt, transform_started, lda_started, perplexity_started, cooc_by_modality, fit_offline, fit_history, fit_online, transform_benchmark, lda, multimodal, hierarchy_psi, ptdw_segmentation, transactions, stream_online)}
