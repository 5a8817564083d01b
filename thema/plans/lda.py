"""LDA: a topic model with symmetric smoothing of Theta (alpha) and Phi (beta)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..operators.phi_regularizers import SmoothSparsePhi
from ..operators.theta_regularizers import SmoothSparseTheta
from .model import TopicModel
from .partitioned import PartitionedModel


class Lda(TopicModel):
    """beta: a number, or one for each topic."""

    def __init__(self, topics: int | list[str], dictionary: DataFrame, alpha: float = 0.01, beta: float | list[float] = 0.01, **options):
        super().__init__(topics, dictionary, **options)
        self.alpha, self.beta = alpha, beta
        self.regularizers["smooth_theta"] = SmoothSparseTheta(alpha)
        if isinstance(beta, (int, float)):
            self.regularizers["smooth_phi"] = SmoothSparsePhi(float(beta))
        else:
            if len(beta) != len(self.topics):
                raise ValueError("a beta for each topic, please")
            for t, b in zip(self.topics, beta):
                self.regularizers[f"smooth_phi_{t}"] = SmoothSparsePhi(float(b), topics=[t])

    @property
    def perplexity_values(self) -> list[float]:
        return [h["perplexity"] for h in self.history]

    @property
    def sparsity_phi_last_value(self) -> float:
        return float((np.abs(self.m.pwt) < 1e-37).mean())

    @property
    def sparsity_theta_last_value(self) -> float:
        return self.history[-1]["sparsity_theta"]

    def get_top_tokens(self, k: int = 10, with_weights: bool = False) -> list[list]:
        out = []
        for t in range(len(self.topics)):
            order = np.lexsort((self.m.tokens.astype(str), self.m.pwt[:, t]))[::-1][:k]
            out.append([(self.m.tokens[i], float(self.m.pwt[i, t])) if with_weights else self.m.tokens[i] for i in order])
        return out


def partitioned_lda(topics: int | list[str], dictionary: DataFrame, alpha: float = 0.01, beta: float = 0.01, **options) -> PartitionedModel:
    """An LDA whose matrices are tables."""
    return PartitionedModel(topics, dictionary, regularizers={"smooth_theta": SmoothSparseTheta(alpha), "smooth_phi": SmoothSparsePhi(float(beta))}, **options)
