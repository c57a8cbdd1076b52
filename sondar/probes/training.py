"""Training of a model on arrays: AdamW or another optimizer, schedules of the rate, early stopping on validation loss, the
best parameters kept."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from sondar.probes import tape as t
from sondar.probes.models import Dropout, Model, Params


logger = logging.getLogger("sondar")

Moments = dict[str, np.ndarray]


class AdamW:
    """Moving moments of the gradients, and decay of the weights apart from them."""

    def __init__(self, rate: float, decay: float, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8):
        self.rate, self.decay, self.betas, self.eps = rate, decay, betas, eps
        self.first: Moments = {}
        self.second: Moments = {}
        self.steps = 0

    def step(self, params: Params, grads: Moments, factor: float) -> Params:
        """New parameters after one step at `factor` times the rate."""
        self.steps += 1
        out, rate, (a, b) = dict(params), self.rate * factor, self.betas
        for k, g in grads.items():
            self.first[k] = a * self.first.get(k, 0) + (1 - a) * g
            self.second[k] = b * self.second.get(k, 0) + (1 - b) * g * g
            move = (self.first[k] / (1 - a**self.steps)) / (np.sqrt(self.second[k] / (1 - b**self.steps)) + self.eps)
            out[k] = params[k] * (1 - rate * self.decay) - rate * move
        return out


class Momentum:
    """Gradient descent with momentum; decay counts as part of the gradient."""

    def __init__(self, rate: float, decay: float, momentum: float = 0.9):
        self.rate, self.decay, self.momentum = rate, decay, momentum
        self.speed: Moments = {}

    def step(self, params: Params, grads: Moments, factor: float) -> Params:
        out = dict(params)
        for k, g in grads.items():
            self.speed[k] = self.momentum * self.speed.get(k, 0) + g + self.decay * params[k]
            out[k] = params[k] - self.rate * factor * self.speed[k]
        return out


@dataclass
class Plateau:
    """Cuts the rate when the validation loss hasn't fallen for more than `patience` checks."""

    factor: float = 0.1
    patience: int = 10
    least: float = 0.0

    def __post_init__(self) -> None:
        self.best, self.bad, self.scale = np.inf, 0, 1.0

    def __call__(self, epoch: int) -> float:
        return self.scale

    def seen(self, loss: float) -> None:
        if loss < self.best:
            self.best, self.bad = loss, 0
            return
        self.bad += 1
        if self.bad > self.patience:
            self.scale, self.bad = max(self.least, self.scale * self.factor), 0


def cosine(n_epochs: int, least: float = 0.0) -> Callable[[int], float]:
    """A rate that falls to `least` along half a cosine."""
    return lambda epoch: least + (1 - least) * 0.5 * (1 + np.cos(np.pi * min(epoch, n_epochs) / n_epochs))


CASTS = ("float64", "float32", "float16", "bfloat16")


def rounded(x: np.ndarray, dtype: str | None) -> np.ndarray:
    """Values as a type holds them; the arithmetic stays in float64."""
    if dtype is None or dtype == "float64":
        return np.asarray(x, float)
    if dtype not in CASTS:
        raise ValueError(f"unknown type {dtype!r}; there are {list(CASTS)}")
    if dtype != "bfloat16":
        return np.asarray(x, dtype).astype(float)
    a = np.asarray(x, np.float32)
    bits = a.view(np.uint32).astype(np.uint64)
    up = (bits + 0x7FFF + ((bits >> 16) & 1)) & 0xFFFF0000
    return np.where(np.isfinite(a), up.astype(np.uint32).view(np.float32), a).astype(float)


def pad(rows: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, mask) of sequences filled up to the longest."""
    size = max(1, max((len(r) for r in rows), default=1))
    x, mask = np.zeros((len(rows), size, width)), np.zeros((len(rows), size), bool)
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, True
    return x, mask


def batches(order_by: np.ndarray, batch_size: int, max_padded_tokens: int | None, rng: np.random.Generator | None, lengths: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Row numbers: largest first by order_by, greedy under the budget of padded tokens by lengths (order_by unless given);
    the batches come in random order with a generator."""
    lengths = order_by if lengths is None else lengths
    plan: list[list[int]] = []
    longest = 0
    for i in np.argsort(-order_by, kind="stable"):
        n = max(int(lengths[i]), longest if plan else 0)
        if not plan or len(plan[-1]) >= batch_size or (max_padded_tokens and n * (len(plan[-1]) + 1) > max_padded_tokens):
            plan.append([])
            n = int(lengths[i])
        plan[-1].append(int(i))
        longest = n
    order = rng.permutation(len(plan)) if rng is not None else range(len(plan))
    for k in order:
        yield np.array(plan[k])


def _pick(x, masks, i):  # noqa: ANN001, ANN202
    if masks is None:
        return x[i], None
    rows = [x[k] for k in i]
    padded, inside = pad(rows, rows[0].shape[-1] if rows else 1)
    held = [masks[k] for k in i]
    for r, m in enumerate(held):
        inside[r, : len(m)] &= m
    return padded, inside


def logits(model: Model, params: Params, x, masks=None, batch_size: int = 1024) -> np.ndarray:  # noqa: ANN001
    """Logits of all rows in their order. x is [n, d], or a list of [s, d] with a list of masks."""
    p = {k: t.node(v) for k, v in params.items()}
    out = np.zeros(len(x))
    for start in range(0, len(x), batch_size):
        i = np.arange(start, min(start + batch_size, len(x)))
        xs, ms = _pick(x, masks, i)
        out[i] = model.logits(p, xs, ms, Dropout(0, None)).value
    return out


def train(model: Model, x, y: np.ndarray, masks=None, *, seed: int = 0, val_split: float = 0.2, eval_interval: int = 1, grad_accum_steps: int = 1, max_padded_tokens: int | None = None, schedule: Callable[[], Callable[[int], float]] | Callable[[int], float] | None = None, optimizer: Callable[[float, float], AdamW] = AdamW, shuffle: bool = True, sort_by_length: bool = True, cast: str | None = None) -> Params:  # noqa: ANN001, E501
    """Parameters of a model trained on features, or on sequences with their masks. Needs both classes.

    optimizer is made of the model's rate and decay for each stage. schedule gives the factor of the rate in an epoch; a
    Plateau also sees the validation loss. cast rounds the inputs to a type. Without shuffle batches come in order; without
    sort_by_length sequences are batched as they come."""
    y = np.asarray(y, float)
    x = rounded(x, cast) if masks is None else [rounded(s, cast) for s in x]
    if len(x) == 0:
        raise ValueError("the training set is empty")
    if len(np.unique(y)) < 2:
        raise ValueError("training needs both classes")
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    n_val = max(1, int(val_split * len(x))) if model.sequence else 0
    val, fit = order[:n_val], order[n_val:]
    if not len(fit):
        fit = order
    first = x if masks is None else np.concatenate([np.asarray(s).reshape(-1, np.shape(s)[-1]) for s in x[:64]])
    params = model.start(rng, np.asarray(first, float))
    lengths = np.array([1 if masks is None else len(r) for r in x])
    best, best_loss, bad = params, np.inf, 0
    for names in model.stages():
        moving = [k for k in params if not k.startswith("_") and (names is None or k in names)]
        moves = optimizer(model.learning_rate, model.weight_decay)
        for epoch in range(model.n_epochs):
            grads: dict[str, np.ndarray] = {}
            held = 0
            factor = schedule(epoch) if schedule else 1.0
            if masks is not None:
                order = lengths[fit] if sort_by_length else np.zeros(len(fit), int)
                plan = list(batches(order, min(model.batch_size, len(fit)), max_padded_tokens, rng if shuffle else None, lengths[fit]))
            else:
                plan = np.array_split(fit[rng.permutation(len(fit))] if shuffle else fit, max(1, -(-len(fit) // model.batch_size)))
            for n, i in enumerate(plan):
                rows = fit[i] if masks is not None else i
                xs, ms = _pick(x, masks, rows)
                p = {k: t.Node(v) for k, v in params.items()}
                loss = model.loss(p, xs, ms, y[rows], Dropout(model.dropout, rng)) * (1 / grad_accum_steps)
                loss.backward()
                for k in moving:
                    if p[k].grad is not None:
                        grads[k] = grads.get(k, 0) + p[k].grad
                held += 1
                if held < grad_accum_steps and n + 1 < len(plan):
                    continue
                held = 0
                params = moves.step(params, grads, factor)
                grads = {}
            if len(val) and epoch % eval_interval == 0:
                xs = [x[k] for k in val] if masks is not None else x[val]
                ms = [masks[k] for k in val] if masks is not None else None
                loss = float(t.bce(t.node(logits(model, params, xs, ms)), y[val]).value)
                logger.debug("epoch %d: validation loss %.6f", epoch, loss)
                if isinstance(schedule, Plateau):
                    schedule.seen(loss)
                if loss < best_loss:
                    best, best_loss, bad = params, loss, 0
                else:
                    bad += 1
                    if bad >= model.patience:
                        break
    return best if len(val) else params
