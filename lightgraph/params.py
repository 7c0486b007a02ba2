"""Parameter sets; each becomes literals of a plan."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

BINS = 16
MODES = ("ordered", "maxbin", "levelmax")


@dataclass(frozen=True)
class LightParams:
    """How intensity spreads: sharpness k of the refraction penalty, threshold, hops, circular direction bins."""

    k: float = 5.0
    min_intensity: float = 1e-3
    max_depth: int = 4
    bins: int = BINS


@dataclass(frozen=True)
class RagConfig:
    """How retrieval mixes graph (alpha), vectors (beta) and personalization (gamma)."""

    top_k: int = 10
    max_hops: int = 4
    alpha: float = 0.5
    beta: float = 0.4
    gamma: float = 0.1
    min_relevance: float = 1e-3
    sharpness: float = 5.0
    num_sources: int = 5
    include_paths: bool = False
    use_related_bins: bool = True


@dataclass
class UserContext:
    """A user's state as plain values; operators.users derives it from interaction tables."""

    user_id: str
    topic_affinities: list[float] = field(default_factory=lambda: [1.0] * BINS)
    interactions: dict[int, int] = field(default_factory=dict)
    session: list[int] = field(default_factory=list)
    rooms: set[int] = field(default_factory=set)
    decay: float = 0.9


@dataclass(frozen=True)
class DataConfig:
    chunk_size: int = 512
    chunk_overlap: int = 50
    min_chunk_size: int = 50
    test_ratio: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class TrainConfig:
    dim: int = 64
    epochs: int = 10
    batch_size: int = 512
    learning_rate: float = 0.05
    gamma: float = 12.0
    negatives: int = 8
    seed: int = 42
    #: `plain` steps against each entity's clipped gradient; `adamw` with moments, decay and one norm that clips all.
    optimizer: str = "plain"
    weight_decay: float = 0.01
    max_grad_norm: float = 1.0
    #: Distributed steps an epoch, each with the triples that a hash deals it.
    steps_per_epoch: int = 1


@dataclass(frozen=True)
class EvalConfig:
    compute_mrr: bool = True
    compute_hits: bool = True
    hits_k: tuple[int, ...] = (1, 3, 10)
    batch_size: int = 256
    filter_known: bool = True


@dataclass(frozen=True)
class ExportConfig:
    output_path: str = "embeddings.emb"
    normalize: bool = True
    include_vocab: bool = False
    vocab_path: str | None = None


@dataclass(frozen=True)
class Config:
    """All groups; from_dict() makes each from its own dictionary."""

    data: DataConfig = DataConfig()
    training: TrainConfig = TrainConfig()
    evaluation: EvalConfig = EvalConfig()
    export: ExportConfig = ExportConfig()


def from_dict(kind: type, values: dict):
    """A config of the kind from the values whose names it knows; groups from dictionaries of theirs."""
    made = {f.name: values[f.name] for f in fields(kind) if f.name in values}
    if kind is Config:
        made = {name: from_dict(type(getattr(Config(), name)), group) for name, group in made.items()}
    return kind(**made)


class GraphError(ValueError):
    """A graph table breaks a rule, or an id is out of range."""


class VisibilityError(ValueError):
    """A room or bin of a visibility table is out of range."""


class PropagationError(ValueError):
    """Parameters that no propagation can run with."""
