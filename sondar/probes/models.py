"""Probe models: parameters and logits over batches of features [n, d] or of padded sequences [n, s, d]."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from sondar.probes import tape as t
from sondar.probes.tape import Node

Params = dict[str, np.ndarray]


def _normal(rng: np.random.Generator, n_in: int, n_out: int, gain: float = 0.5) -> np.ndarray:
    return rng.normal(0, gain * np.sqrt(2 / (n_in + n_out)), (n_in, n_out))


def _uniform(rng: np.random.Generator, n_in: int, n_out: int) -> np.ndarray:
    a = np.sqrt(6 / (n_in + n_out))
    return rng.uniform(-a, a, (n_in, n_out))


class Dropout:
    """Random zeros while training; nothing without a generator."""

    def __init__(self, rate: float, rng: np.random.Generator | None):
        self.rate, self.rng = rate, rng

    def __call__(self, x: Node) -> Node:
        if self.rng is None or not self.rate:
            return x
        return x * ((self.rng.random(x.shape) >= self.rate) / (1 - self.rate))


@dataclass(frozen=True)
class Model:
    """What all models share: options of training, and a loss that is cross-entropy plus their penalty."""

    learning_rate: float = 1e-3
    weight_decay: float = 0.01
    n_epochs: int = 100
    batch_size: int = 32
    patience: int = 10
    dropout: float = 0.0
    sequence: bool = field(default=False, init=False)

    def start(self, rng: np.random.Generator, x: np.ndarray) -> Params:
        raise NotImplementedError

    def logits(self, p: dict[str, Node], x: np.ndarray, mask: np.ndarray | None, drop: Dropout) -> Node:
        raise NotImplementedError

    def penalty(self, p: dict[str, Node]) -> Node:
        return t.node(0.0)

    def loss(self, p: dict[str, Node], x: np.ndarray, mask: np.ndarray | None, y: np.ndarray, drop: Dropout) -> Node:
        return t.bce(self.logits(p, x, mask, drop), y) + self.penalty(p)

    def stages(self) -> list[list[str] | None]:
        """Names of the parameters that train in each stage; None is all."""
        return [None]


def _scale(x: np.ndarray) -> Params:
    """Standardisation constants; they don't train."""
    return {"_mean": x.mean(0), "_std": np.maximum(x.std(0), 1e-8)}


def _scaled(p: dict[str, Node], x: np.ndarray) -> Node:
    return t.node((x - p["_mean"].value) / p["_std"].value)


@dataclass(frozen=True)
class MLP(Model):
    hidden: int = 128
    activation: str = "relu"

    def start(self, rng, x):  # noqa: ANN001, ANN201
        d = x.shape[-1]
        return {"w1": _normal(rng, d, self.hidden), "b1": np.zeros(self.hidden), "w2": _normal(rng, self.hidden, 1), "b2": np.zeros(1)}

    def logits(self, p, x, mask, drop):  # noqa: ANN001, ANN201
        act = t.gelu if self.activation == "gelu" else t.relu
        return (drop(act(t.node(x) @ p["w1"] + p["b1"])) @ p["w2"] + p["b2"])[:, 0]


@dataclass(frozen=True)
class Bilinear(Model):
    """Weighted squares of rank projections; no linear term."""

    rank: int = 32

    def start(self, rng, x):  # noqa: ANN001, ANN201
        return {"u": _normal(rng, x.shape[-1], self.rank), "lam": rng.normal(0, 0.01, self.rank), "b": np.zeros(1)} | _scale(x)

    def logits(self, p, x, mask, drop):  # noqa: ANN001, ANN201
        return ((_scaled(p, x) @ p["u"]) ** 2 * p["lam"]).sum(-1) + p["b"]


@dataclass(frozen=True)
class EEMLP(Model):
    """An exit before, between and after the layers; the loss is the mean over exits, the last exit predicts."""

    n_layers: int = 3
    hidden: int = 128
    dropout: float = 0.1

    def start(self, rng, x):  # noqa: ANN001, ANN201
        sizes = [x.shape[-1], *[self.hidden] * self.n_layers]
        out = {f"w{i}": _uniform(rng, sizes[i], sizes[i + 1]) for i in range(self.n_layers)}
        out |= {f"b{i}": np.zeros(sizes[i + 1]) for i in range(self.n_layers)}
        out |= {f"hw{i}": _uniform(rng, n, 1) for i, n in enumerate(sizes)} | {f"hb{i}": np.zeros(1) for i in range(len(sizes))}
        return out | _scale(x)

    def exits(self, p: dict[str, Node], x: np.ndarray, drop: Dropout) -> list[Node]:
        h = _scaled(p, x)
        out = [(h @ p["hw0"] + p["hb0"])[:, 0]]
        for i in range(self.n_layers):
            h = drop(t.relu(h @ p[f"w{i}"] + p[f"b{i}"]))
            out.append((h @ p[f"hw{i + 1}"] + p[f"hb{i + 1}"])[:, 0])
        return out

    def exit(self, p: dict[str, Node], x: np.ndarray, at: int) -> Node:
        exits = self.exits(p, x, Dropout(0, None))
        return exits[min(at, len(exits) - 1)]

    def logits(self, p, x, mask, drop):  # noqa: ANN001, ANN201
        return self.exits(p, x, drop)[-1]

    def loss(self, p, x, mask, y, drop):  # noqa: ANN001, ANN201
        exits = self.exits(p, x, drop)
        total = t.node(0.0)
        for e in exits:
            total = total + t.bce(e, y)
        return total * (1 / len(exits))


@dataclass(frozen=True)
class TPC(Model):
    """A polynomial of growing degree; each degree trains while those below it stand still."""

    max_degree: int = 3
    rank: int = 64

    def start(self, rng, x):  # noqa: ANN001, ANN201
        d = x.shape[-1]
        out = {"w": _uniform(rng, d, 1), "b": np.zeros(1)}
        for k in range(2, self.max_degree + 1):
            out |= {f"f{k}": rng.normal(0, 0.01, (d, self.rank)), f"c{k}": rng.normal(0, 0.01, self.rank)}
        return out | _scale(x)

    def degree(self, p: dict[str, Node], x: np.ndarray, degree: int) -> Node:
        z = _scaled(p, x)
        out = (z @ p["w"] + p["b"])[:, 0]
        for k in range(2, min(degree, self.max_degree) + 1):
            out = out + ((z @ p[f"f{k}"]) ** k * p[f"c{k}"]).sum(-1)
        return out

    def logits(self, p, x, mask, drop):  # noqa: ANN001, ANN201
        return self.degree(p, x, self.max_degree)

    def stages(self):  # noqa: ANN201
        return [["w", "b"], *[[f"f{k}", f"c{k}"] for k in range(2, self.max_degree + 1)]]

    def cascade(self, p: dict[str, Node], x: np.ndarray, threshold: float = 0.8) -> np.ndarray:
        """Probabilities; a row leaves at the first degree that is confident about it."""
        out, left = np.full(len(x), 0.5), np.arange(len(x))
        for degree in range(1, self.max_degree + 1):
            if not len(left):
                break
            q = 1 / (1 + np.exp(-self.degree(p, x[left], degree).value))
            out[left] = q
            left = left[(q <= threshold) & (q >= 1 - threshold)]
        return out


def _norm(d: int) -> Params:
    return {"ns": np.ones(d), "nb": np.zeros(d)}


def _two_layers(rng: np.random.Generator, d: int, h: int) -> Params:
    return {"w1": _normal(rng, d, h), "b1": np.zeros(h), "w2": _normal(rng, h, h), "b2": np.zeros(h)}


def _mlp(p: dict[str, Node], x: np.ndarray, drop: Dropout) -> Node:
    h = drop(t.relu(t.layer_norm(t.node(x), p["ns"], p["nb"]) @ p["w1"] + p["b1"]))
    return h @ p["w2"] + p["b2"]


@dataclass(frozen=True)
class Attention(Model):
    """Scores weigh the raw tokens; their sum is classified."""

    hidden: int = 128
    dropout: float = 0.2
    temperature: float = 2.0
    n_epochs: int = 1000
    sequence: bool = field(default=True, init=False)

    def start(self, rng, x):  # noqa: ANN001, ANN201
        d, h = x.shape[-1], self.hidden
        out = _norm(d) | {"w1": _normal(rng, d, h), "b1": np.zeros(h), "w2": _normal(rng, h, 1), "b2": np.zeros(1)}
        out |= {"cs": np.ones(d), "cb": np.zeros(d)}
        for i, (a, b) in enumerate(((d, 2 * h), (2 * h, h), (h, 1))):
            out |= {f"c{i}": _normal(rng, a, b), f"d{i}": np.zeros(b)}
        return out

    def weights(self, p: dict[str, Node], x: np.ndarray, mask: np.ndarray, drop: Dropout) -> Node:
        h = drop(t.relu(t.layer_norm(t.node(x), p["ns"], p["nb"]) @ p["w1"] + p["b1"]))
        scores = (h @ p["w2"] + p["b2"])[:, :, 0] * (1 / self.temperature)
        return t.masked_softmax(scores, mask, 1)

    def logits(self, p, x, mask, drop):  # noqa: ANN001, ANN201
        w = self.weights(p, x, mask, drop)
        pooled = (w.reshape(*w.shape, 1) * x).sum(1)
        h = t.layer_norm(pooled, p["cs"], p["cb"])
        for i in range(2):
            h = drop(t.relu(h @ p[f"c{i}"] + p[f"d{i}"]))
        return (h @ p["c2"] + p["d2"])[:, 0]


@dataclass(frozen=True)
class MultiMax(Model):
    """Each head's maximum over the tokens."""

    hidden: int = 128
    n_heads: int = 10
    sequence: bool = field(default=True, init=False)

    def start(self, rng, x):  # noqa: ANN001, ANN201
        d = x.shape[-1]
        heads = {"hw": _normal(rng, self.hidden, self.n_heads), "hb": np.zeros(self.n_heads), "ow": _normal(rng, self.n_heads, 1), "ob": np.zeros(1)}
        return _norm(d) | _two_layers(rng, d, self.hidden) | heads

    def logits(self, p, x, mask, drop):  # noqa: ANN001, ANN201
        scores = _mlp(p, x, drop) @ p["hw"] + p["hb"]
        return (t.masked_max(scores, mask[:, :, None], 1) @ p["ow"] + p["ob"])[:, 0]


@dataclass(frozen=True)
class GatedBipolar(Model):
    """Largest and smallest gated projections over the tokens, with sparse and orthogonal projections."""

    hidden: int = 128
    gate_dim: int = 64
    lambda_l1: float = 1e-5
    lambda_orth: float = 1e-4
    sequence: bool = field(default=True, init=False)

    def start(self, rng, x):  # noqa: ANN001, ANN201
        d, g = x.shape[-1], self.gate_dim
        own = {"pw": _normal(rng, self.hidden, g), "pb": np.zeros(g), "gw": _normal(rng, self.hidden, g), "gb": np.zeros(g)}
        return _norm(d) | _two_layers(rng, d, self.hidden) | own | {"ow": _normal(rng, 2 * g, 1), "ob": np.zeros(1)}

    def logits(self, p, x, mask, drop):  # noqa: ANN001, ANN201
        h = _mlp(p, x, drop)
        v = (h @ p["pw"] + p["pb"]) * t.softplus(h @ p["gw"] + p["gb"])
        both = t.concat([t.masked_max(v, mask[:, :, None], 1), t.masked_max(-v, mask[:, :, None], 1)], 1)
        return (both @ p["ow"] + p["ob"])[:, 0]

    def penalty(self, p):  # noqa: ANN001, ANN201
        w = p["pw"]
        off = w.swap(0, 1) @ w - np.eye(self.gate_dim)
        return t.absolute(w).sum() * self.lambda_l1 + (off * off).sum() * self.lambda_orth


@dataclass(frozen=True)
class SoftAttention(Model):
    """Per head, values weighed by the softmax of query scores."""

    hidden: int = 128
    n_heads: int = 10
    sequence: bool = field(default=True, init=False)

    def start(self, rng, x):  # noqa: ANN001, ANN201
        d, h = x.shape[-1], self.hidden
        own = {"q": _normal(rng, h, self.n_heads), "v": _normal(rng, h, self.n_heads), "ow": _uniform(rng, self.n_heads, 1), "ob": np.zeros(1)}
        return _norm(d) | _two_layers(rng, d, h) | own

    def logits(self, p, x, mask, drop):  # noqa: ANN001, ANN201
        y = _mlp(p, x, drop)
        heads = (t.masked_softmax(y @ p["q"], mask[:, :, None], 1) * (y @ p["v"])).sum(1)
        return (heads @ p["ow"] + p["ob"])[:, 0]


@dataclass(frozen=True)
class PositionalAttention(Model):
    """Softmax of a projection plus a weight per position; values are summed over tokens and heads."""

    n_heads: int = 8
    sequence: bool = field(default=True, init=False)

    def start(self, rng, x):  # noqa: ANN001, ANN201
        d = x.shape[-1]
        return {"q": np.zeros((d, self.n_heads)), "v": _normal(rng, d, self.n_heads), "pos": np.zeros(self.n_heads), "b": np.zeros(1)}

    def logits(self, p, x, mask, drop):  # noqa: ANN001, ANN201
        place = np.arange(x.shape[1])[None, :, None]
        w = t.masked_softmax(t.node(x) @ p["q"] + p["pos"] * place, mask[:, :, None], 1)
        return (w * (t.node(x) @ p["v"])).sum(2).sum(1) + p["b"]


@dataclass(frozen=True)
class RollingAttention(Model):
    """Soft attention inside each full window of positions, then the largest window; short inputs are one window."""

    hidden: int = 128
    n_heads: int = 10
    window: int = 10
    sequence: bool = field(default=True, init=False)

    start = SoftAttention.start

    def logits(self, p, x, mask, drop):  # noqa: ANN001, ANN201
        y = _mlp(p, x, drop)
        scores, values = y @ p["q"], y @ p["v"]
        if x.shape[1] <= self.window:
            heads = (t.masked_softmax(scores, mask[:, :, None], 1) * values).sum(1)
        else:
            at = np.arange(x.shape[1] - self.window + 1)[:, None] + np.arange(self.window)
            inside = mask[:, at]
            means = (t.masked_softmax(scores[:, at], inside[..., None], 2) * values[:, at]).sum(2)
            heads = t.masked_max(means, inside.any(2)[:, :, None], 1)
        return (heads @ p["ow"] + p["ob"])[:, 0]


@dataclass(frozen=True)
class MHA(Model):
    """Projection, a class token, pre-norm transformer layers, and a linear head on the class token."""

    proj: int = 128
    n_heads: int = 4
    n_layers: int = 1
    sequence: bool = field(default=True, init=False)

    def start(self, rng, x):  # noqa: ANN001, ANN201
        d, h = x.shape[-1], self.proj
        out = {"dw": _uniform(rng, d, h), "db": np.zeros(h), "cls": rng.normal(0, 0.02, (1, 1, h)), "ow": _uniform(rng, h, 1), "ob": np.zeros(1)}
        for i in range(self.n_layers):
            out |= {f"{n}{i}": _uniform(rng, h, h) for n in ("q", "k", "v", "o")} | {f"{n}b{i}": np.zeros(h) for n in ("q", "k", "v", "o")}
            out |= {f"s1{i}": np.ones(h), f"t1{i}": np.zeros(h), f"s2{i}": np.ones(h), f"t2{i}": np.zeros(h)}
            out |= {f"f1{i}": _uniform(rng, h, 4 * h), f"g1{i}": np.zeros(4 * h), f"f2{i}": _uniform(rng, 4 * h, h), f"g2{i}": np.zeros(h)}
        return out

    def logits(self, p, x, mask, drop):  # noqa: ANN001, ANN201
        n, k, h = len(x), self.n_heads, self.proj
        x = t.concat([p["cls"] + np.zeros((n, 1, h)), t.node(x) @ p["dw"] + p["db"]], 1)
        mask = np.concatenate([np.ones((n, 1), bool), mask], 1)
        split = lambda z: z.reshape(n, -1, k, h // k).swap(1, 2)
        for i in range(self.n_layers):
            z = t.layer_norm(x, p[f"s1{i}"], p[f"t1{i}"])
            q, key, v = (split(z @ p[f"{c}{i}"] + p[f"{c}b{i}"]) for c in ("q", "k", "v"))
            w = t.masked_softmax((q @ key.swap(-1, -2)) * (1 / np.sqrt(h // k)), mask[:, None, None, :], -1)
            x = x + drop((w @ v).swap(1, 2).reshape(n, -1, h) @ p[f"o{i}"] + p[f"ob{i}"])
            z = t.layer_norm(x, p[f"s2{i}"], p[f"t2{i}"])
            x = x + drop(drop(t.relu(z @ p[f"f1{i}"] + p[f"g1{i}"])) @ p[f"f2{i}"] + p[f"g2{i}"])
        return (x[:, 0] @ p["ow"] + p["ob"])[:, 0]


MODELS = {m.__name__: m for m in (MLP, Bilinear, EEMLP, TPC, Attention, MultiMax, GatedBipolar, SoftAttention, PositionalAttention, RollingAttention, MHA)}
