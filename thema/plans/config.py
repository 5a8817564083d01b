"""Settings of a model as JSON, and regularizers and scores by name."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..functions.options import number_or_rate
from ..operators import cumulative, model_scores, phi_regularizers, theta_regularizers
from .model import TopicModel

REGULARIZERS = {
    name: getattr(module, name)
    for module, names in (
        (phi_regularizers, ("SmoothSparsePhi", "DecorrelatorPhi", "MultiLanguagePhi", "LabelRegularizationPhi", "SpecifiedSparsePhi", "ImproveCoherencePhi", "BitermsPhi", "SmoothTimeInTopicsPhi", "NetPlsaPhi")),
        (theta_regularizers, ("SmoothSparseTheta", "TopicSelectionTheta", "HierarchySparsingTheta", "SmoothPtdw", "TopicSegmentationPtdw")),
    )
    for name in names
}
SCORES = {name: getattr(model_scores, name) for name in ("TopTokens", "SparsityPhi", "TopicKernel", "TopicMassPhi", "BackgroundTokensRatio")}
SCORES |= {name: getattr(cumulative, name) for name in ("Perplexity", "SparsityTheta", "ClassPrecision", "ThetaSnippet", "ItemsProcessed")}
#: Short names: class, and the sign of tau.
SHORT = {
    "SmoothPhi": ("SmoothSparsePhi", 1), "SparsePhi": ("SmoothSparsePhi", -1), "SmoothTheta": ("SmoothSparseTheta", 1), "SparseTheta": ("SmoothSparseTheta", -1), "Decorrelation": ("DecorrelatorPhi", 1),
    "TopicSelection": ("TopicSelectionTheta", 1), "LabelRegularization": ("LabelRegularizationPhi", 1), "ImproveCoherence": ("ImproveCoherencePhi", 1), "Biterms": ("BitermsPhi", 1),
}


def regularizer(text: str, groups: dict[str, list[str]] | None = None, topics: list[str] | None = None):
    """(name, regularizer) of "tau Type #topics @classes": names of topics or of groups behind #, of modalities behind @, separated by commas."""
    tau, short, *rest = text.split()
    cls, sign = SHORT[short] if short in SHORT else (short, 1)
    chosen = [t for x in rest if x.startswith("#") for g in x[1:].split(",") for t in (groups or {}).get(g, [g])]
    classes = [c if c.startswith("@") else "@" + c for x in rest if x.startswith("@") for c in x[1:].split(",")]
    options: dict = {"tau": sign * float(tau)}
    if "Theta" in cls:
        if chosen and topics:
            options["topics"] = [topics.index(t) for t in chosen]
    else:
        options |= {"topics": chosen or None, "classes": classes or None}
    return text, REGULARIZERS[cls](**options)


@dataclass
class ModelConfig:
    """What a model is made from; regularizers as {name: {"type": ..., options}}, scores likewise."""

    topics: list[str]
    class_weights: dict[str, float] | None = None
    type_weights: dict[str, float] | None = None
    document_passes: int = 10
    seed: int = -1
    reuse_theta: bool = False
    regularizers: dict[str, dict] = field(default_factory=dict)
    scores: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.document_passes < 0:
            raise ValueError("document_passes must not be negative")
        for name, r in self.regularizers.items():
            gamma = r.get("gamma")
            if gamma is not None and not 0 <= gamma <= 1:
                raise ValueError(f"gamma of {name} must be from 0 to 1")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> ModelConfig:
        return cls(**json.loads(text))

    def build(self, dictionary: DataFrame) -> TopicModel:
        made = lambda table, x: table[x["type"]](**{k: v for k, v in x.items() if k != "type"})
        return TopicModel(
            self.topics, dictionary, self.class_weights, self.type_weights, self.document_passes, self.seed, {k: made(REGULARIZERS, v) for k, v in self.regularizers.items()},
            {k: made(SCORES, v) for k, v in self.scores.items()}, self.reuse_theta,
        )


def dictionary_bounds(min_df: str | None, max_df: str | None) -> dict[str, float]:
    """Options of operators.dictionary.filtered() from numbers or percents."""
    out = {}
    for name, text in (("min_df", min_df), ("max_df", max_df)):
        if text:
            absolute, rate = number_or_rate(text)
            out |= {name: absolute} if rate is None else {f"{name}_rate": rate}
    return out


def encoded(named: dict[str, object]) -> dict[str, dict]:
    """Regularizers or scores as JSON: type and fields, arrays as lists, dicts as lists of pairs. What isn't one of REGULARIZERS or SCORES is left out."""

    def plain(x):
        if isinstance(x, dict):
            return {"pairs": [[plain(k), plain(v)] for k, v in x.items()]}
        if isinstance(x, np.ndarray):
            return {"array": x.tolist()}
        if isinstance(x, tuple):
            return {"tuple": [plain(v) for v in x]}
        return [plain(v) for v in x] if isinstance(x, list) else x.item() if isinstance(x, np.generic) else x

    known = REGULARIZERS | SCORES
    return {k: {"type": type(r).__name__} | {f.name: plain(getattr(r, f.name)) for f in fields(r) if f.init} for k, r in named.items() if is_dataclass(r) and known.get(type(r).__name__) is type(r)}


def decoded(named: dict[str, dict]) -> dict[str, object]:
    """The inverse of encoded()."""

    def made(x):
        if isinstance(x, dict):
            kind, v = next(iter(x.items()))
            return {made(k): made(w) for k, w in v} if kind == "pairs" else np.array(v) if kind == "array" else tuple(map(made, v))
        return [made(v) for v in x] if isinstance(x, list) else x

    known = REGULARIZERS | SCORES
    return {k: known[r["type"]](**{n: made(v) for n, v in r.items() if n != "type" and not n.startswith("_")}) for k, r in named.items()}
