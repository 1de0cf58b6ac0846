"""Parameters of the attention scorers: a few small arrays that live on the driver."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import numpy as np


@dataclass(frozen=True)
class AttentionModel:
    """Embedding, attention logit and classifier; ``h`` hidden units over ``D`` features."""

    embed_w: np.ndarray  # (h, D)
    embed_b: np.ndarray  # (h,)
    att_v: np.ndarray  # (h, h)
    att_c: np.ndarray  # (h,)
    att_w: np.ndarray  # (h,)
    att_b: np.ndarray  # (1,)
    cls_w: np.ndarray  # (h,)
    cls_b: np.ndarray  # (1,)

    @classmethod
    def of(cls, **arrays):
        return cls(**{k: np.asarray(v, dtype=np.float64) for k, v in arrays.items()})

    @classmethod
    def shapes(cls, dim: int, hidden: int) -> dict[str, tuple[int, ...]]:
        return {
            "embed_w": (hidden, dim),
            "embed_b": (hidden,),
            "att_v": (hidden, hidden),
            "att_c": (hidden,),
            "att_w": (hidden,),
            "att_b": (1,),
            "cls_w": (hidden,),
            "cls_b": (1,),
        }

    @classmethod
    def random(cls, dim: int, hidden: int = 128, seed: int = 42):
        """Uniform in ±1/sqrt(fan in), weights and biases alike."""
        rng = np.random.default_rng(seed)
        fan_in = {"embed": dim, "att": hidden, "cls": hidden}
        arrays = {}
        for name, shape in cls.shapes(dim, hidden).items():
            bound = 1.0 / np.sqrt(fan_in[name.split("_")[0]])
            arrays[name] = rng.uniform(-bound, bound, shape)
        return cls(**arrays)

    @property
    def dim(self) -> int:
        return self.embed_w.shape[1]

    @property
    def hidden(self) -> int:
        return self.embed_w.shape[0]

    def arrays(self) -> dict[str, np.ndarray]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays().values()])

    def as_type(self, kind):
        return replace(self, **{name: a.astype(kind) for name, a in self.arrays().items()})

    def with_flat(self, values: np.ndarray):
        out, at = {}, 0
        for name, a in self.arrays().items():
            out[name] = values[at : at + a.size].reshape(a.shape)
            at += a.size
        return replace(self, **out)


@dataclass(frozen=True)
class GatedAttentionModel(AttentionModel):
    """Gated scorer: a second, sigmoid branch; one attention weight per hidden unit."""

    gate_u: np.ndarray = None  # (h, h)
    gate_c: np.ndarray = None  # (h,)

    @classmethod
    def shapes(cls, dim: int, hidden: int) -> dict[str, tuple[int, ...]]:
        shapes = super().shapes(dim, hidden)
        return {**shapes, "att_w": (hidden, hidden), "att_b": (hidden,), "gate_u": (hidden, hidden), "gate_c": (hidden,)}

    @classmethod
    def random(cls, dim: int, hidden: int = 128, seed: int = 42):
        rng = np.random.default_rng(seed)
        arrays = {}
        for name, shape in cls.shapes(dim, hidden).items():
            bound = 1.0 / np.sqrt(dim if name.startswith("embed") else hidden)
            arrays[name] = rng.uniform(-bound, bound, shape)
        return cls(**arrays)
