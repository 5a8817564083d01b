"""Topic hierarchies: each level is a model whose corpus has the level above as documents, one for each topic."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import folders
from .model import TopicModel


class Hierarchy:
    """Levels from the top down."""

    def __init__(self) -> None:
        self.levels: list[TopicModel] = []

    def add_level(self, model: TopicModel, parent_weight: float = 1.0) -> TopicModel:
        if self.levels:
            if model.seed <= 0:
                raise ValueError("a lower level needs a seed of its own")
            model.set_parent(self.levels[-1], parent_weight)
        self.levels.append(model)
        return model

    def del_level(self, level: int) -> None:
        """Drops a level and all below it."""
        del self.levels[level:]

    def get_level(self, level: int) -> TopicModel:
        return self.levels[level]

    def fit_offline(self, ndw: DataFrame, passes: int = 1) -> Hierarchy:
        """All levels in turn; a level reads its parent as it is then."""
        for i, level in enumerate(self.levels):
            if i:
                level.set_parent(self.levels[i - 1], level._parents[0][2])
            level.fit_offline(ndw, passes)
        return self

    def get_phi(self) -> pd.DataFrame:
        """All levels' Phi side by side; columns level_i_topic."""
        return pd.concat([m.phi().rename(columns=lambda t, i=i: f"level_{i}_{t}") for i, m in enumerate(self.levels)], axis=1).fillna(0.0)

    def transform(self, ndw: DataFrame) -> DataFrame:
        """(item_id, topic, value) of all levels, topics named as in get_phi()."""
        parts = []
        for i, m in enumerate(self.levels):
            names = F.array(*[F.lit(f"level_{i}_{t}") for t in m.topics])
            x = m.transform(ndw).select("item_id", F.explode(F.arrays_zip(names.alias("topic"), F.col("theta").alias("value"))).alias("x"))
            parts.append(x.select("item_id", F.col("x.topic").alias("topic"), F.col("x.value").alias("value")))
        return reduce(DataFrame.unionByName, parts)

    def get_psi(self, level: int) -> pd.DataFrame:
        """p(topic of the level | topic of the one above)."""
        return self.levels[level].psi()

    def save(self, spark: SparkSession, path: str) -> None:
        """Each level as a model of its own."""
        for i, m in enumerate(self.levels):
            m.save(spark, f"{path}/level={i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Hierarchy:
        out = cls()
        out.levels = [TopicModel.load(spark, f"{path}/level={i}") for i in range(len(folders(spark, path)))]
        return out

    def clone(self) -> Hierarchy:
        out = Hierarchy()
        out.levels = [m.clone() for m in self.levels]
        return out
