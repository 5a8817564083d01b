"""Online learning driven by Structured Streaming: each micro-batch is one update of the model.

The state (n_wt, Phi, the numbers of updates) is written beside the stream's checkpoint after every update, under the micro-batch's
number, so a restarted query goes on with what it had learnt.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans.model import TopicModel
from ..storage import drop_path, exists, folders


def save_state(spark: SparkSession, model: TopicModel, path: str, number: int) -> None:
    """The model after micro-batch `number`; the state before the last one goes."""
    rows = pa.list_(pa.float64())
    table = pa.table({
        "class_id": pa.array(model.m.classes, pa.string()), "token": pa.array(model.m.tokens, pa.string()), "pwt": pa.array(list(model.m.pwt), rows), "nwt": pa.array(list(model.m.nwt), rows),
    })
    own = spark.createDataFrame(table).withColumns({"updates": F.lit(model.updates), "online_updates": F.lit(model.online_updates)})
    own.write.mode("overwrite").parquet(f"{path}/{number:012d}")
    for old in folders(spark, path)[:-2]:
        drop_path(spark, f"{path}/{old}")


def load_state(spark: SparkSession, model: TopicModel, path: str) -> int:
    """Sets the model to the last complete state and gives its micro-batch's number, -1 without one."""
    for name in reversed(folders(spark, path)):
        if exists(spark, f"{path}/{name}/_SUCCESS"):
            got = spark.read.parquet(f"{path}/{name}").toPandas().set_index(["class_id", "token"]).reindex(model.phi().index)
            if got["pwt"].isna().any():
                raise ValueError("the state is of a model with another vocabulary")
            model.m.pwt, model.m.nwt = np.stack(got["pwt"].tolist()), np.stack(got["nwt"].tolist())
            model.updates, model.online_updates = int(got["updates"].iloc[0]), int(got["online_updates"].iloc[0])
            return int(name)
    return -1


def learn(stream: DataFrame, model: TopicModel, to_ndw: Callable[[DataFrame], DataFrame], checkpoint: str, tau0: float = 1024.0, kappa: float = 0.7) -> DataStreamWriter:
    """A writer that updates the model with every micro-batch of the stream; start it as any other.

    to_ndw makes (item_id, class_id, token, weight) of a micro-batch. A micro-batch that is delivered
    again after a failure is recognized by its number and skipped; an empty one changes nothing. Where the checkpoint holds a state
    the model is set to it, also in a new process.
    """
    spark, path = stream.sparkSession, f"{checkpoint}/model"
    done = {"last": load_state(spark, model, path)}

    def update(batch: DataFrame, number: int) -> None:
        if number <= done["last"]:
            return
        ndw = to_ndw(batch)
        if not ndw.isEmpty():
            model.fit_online([ndw], tau0, kappa)
            save_state(spark, model, path, number)
        done["last"] = number

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", f"{checkpoint}/stream")
