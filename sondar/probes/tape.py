"""Reverse-mode differentiation over numpy arrays: what the small probes need and no more."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def _fit(grad: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """The gradient summed back over broadcast axes."""
    while grad.ndim > len(shape):
        grad = grad.sum(0)
    for axis, n in enumerate(shape):
        if n == 1 and grad.shape[axis] != 1:
            grad = grad.sum(axis, keepdims=True)
    return grad


class Node:
    """A value, the nodes it came from, and how a gradient flows to each of them."""

    __slots__ = ("value", "grad", "flows")
    __array_priority__ = 100

    def __init__(self, value, flows: Sequence[tuple[Node, Callable]] = ()):  # noqa: ANN001
        self.value = np.asarray(value, dtype=np.float64)
        self.grad: np.ndarray | None = None
        self.flows = flows

    @property
    def shape(self) -> tuple[int, ...]:
        return self.value.shape

    def __add__(self, other) -> Node:  # noqa: ANN001
        other = node(other)
        return Node(self.value + other.value, [(self, lambda g: g), (other, lambda g: g)])

    def __neg__(self) -> Node:
        return Node(-self.value, [(self, lambda g: -g)])

    def __sub__(self, other) -> Node:  # noqa: ANN001
        return self + (-node(other))

    def __mul__(self, other) -> Node:  # noqa: ANN001
        other = node(other)
        return Node(self.value * other.value, [(self, lambda g: g * other.value), (other, lambda g: g * self.value)])

    __radd__, __rmul__ = __add__, __mul__

    def __truediv__(self, other) -> Node:  # noqa: ANN001
        return self * node(other) ** -1.0

    def __pow__(self, k: float) -> Node:
        return Node(self.value**k, [(self, lambda g: g * k * self.value ** (k - 1))])

    def __matmul__(self, other) -> Node:  # noqa: ANN001
        other = node(other)
        a, b = self.value, other.value
        return Node(a @ b, [(self, lambda g: g @ np.swapaxes(b, -1, -2)), (other, lambda g: np.swapaxes(a, -1, -2) @ g)])

    def __getitem__(self, key) -> Node:  # noqa: ANN001
        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.value)
            np.add.at(out, key, g)
            return out

        return Node(self.value[key], [(self, back)])

    def sum(self, axis: int | None = None, keepdims: bool = False) -> Node:
        def back(g: np.ndarray) -> np.ndarray:
            if axis is not None and not keepdims:
                g = np.expand_dims(g, axis)
            return np.broadcast_to(g, self.value.shape)

        return Node(self.value.sum(axis, keepdims=keepdims), [(self, back)])

    def mean(self, axis: int | None = None, keepdims: bool = False) -> Node:
        n = self.value.size if axis is None else self.value.shape[axis]
        return self.sum(axis, keepdims) * (1.0 / n)

    def reshape(self, *shape: int) -> Node:
        return Node(self.value.reshape(*shape), [(self, lambda g: g.reshape(self.value.shape))])

    def swap(self, a: int, b: int) -> Node:
        return Node(np.swapaxes(self.value, a, b), [(self, lambda g: np.swapaxes(g, a, b))])

    def backward(self) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            n, done = stack.pop()
            if done:
                order.append(n)
            elif id(n) not in seen:
                seen.add(id(n))
                stack.append((n, True))
                stack.extend((p, False) for p, _ in n.flows)
        self.grad = np.ones_like(self.value)
        for n in reversed(order):
            for p, flow in n.flows:
                g = _fit(flow(n.grad), p.value.shape)
                p.grad = g if p.grad is None else p.grad + g


def node(x) -> Node:  # noqa: ANN001
    return x if isinstance(x, Node) else Node(x)


def relu(x: Node) -> Node:
    return Node(np.maximum(x.value, 0), [(x, lambda g: g * (x.value > 0))])


def gelu(x: Node) -> Node:
    c = np.sqrt(2 / np.pi)
    t = np.tanh(c * (x.value + 0.044715 * x.value**3))
    slope = 0.5 * (1 + t) + 0.5 * x.value * (1 - t**2) * c * (1 + 3 * 0.044715 * x.value**2)
    return Node(0.5 * x.value * (1 + t), [(x, lambda g: g * slope)])


def softplus(x: Node) -> Node:
    return Node(np.logaddexp(0, x.value), [(x, lambda g: g / (1 + np.exp(-np.clip(x.value, -500, 500))))])


def absolute(x: Node) -> Node:
    return Node(np.abs(x.value), [(x, lambda g: g * np.sign(x.value))])


def layer_norm(x: Node, scale: Node, shift: Node, eps: float = 1e-5) -> Node:
    centred = x - x.mean(-1, True)
    return centred * ((centred * centred).mean(-1, True) + eps) ** -0.5 * scale + shift


def masked_softmax(x: Node, mask: np.ndarray, axis: int) -> Node:
    """Softmax over the positions of the mask; all zeros where there are none."""
    mask = np.broadcast_to(mask, x.shape)
    low = np.where(mask, x.value, -np.inf).max(axis, keepdims=True)
    e = np.where(mask, np.exp(np.where(mask, x.value, 0) - np.where(np.isfinite(low), low, 0)), 0.0)
    total = e.sum(axis, keepdims=True)
    s = np.divide(e, total, out=np.zeros_like(e), where=total > 0)
    return Node(s, [(x, lambda g: s * (g - (g * s).sum(axis, keepdims=True)))])


def masked_max(x: Node, mask: np.ndarray, axis: int) -> Node:
    """Maximum over the positions of the mask; 0 where there are none."""
    mask = np.broadcast_to(mask, x.shape)
    held = np.where(mask, x.value, -np.inf)
    at = np.expand_dims(held.argmax(axis), axis)
    any_ = mask.any(axis)
    value = np.where(any_, np.take_along_axis(x.value, at, axis).squeeze(axis), 0.0)

    def back(g: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x.value)
        np.put_along_axis(out, at, np.expand_dims(g * any_, axis), axis)
        return out

    return Node(value, [(x, back)])


def concat(parts: Sequence[Node], axis: int) -> Node:
    edges = np.cumsum([0, *[p.shape[axis] for p in parts]])

    def flow(i: int) -> Callable:
        return lambda g: np.take(g, range(edges[i], edges[i + 1]), axis)

    return Node(np.concatenate([p.value for p in parts], axis), [(p, flow(i)) for i, p in enumerate(parts)])


def bce(logits: Node, y: np.ndarray) -> Node:
    """Mean binary cross-entropy of logits."""
    z = logits.value
    loss = np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))
    n = max(1, z.size)
    return Node(loss.mean() if z.size else 0.0, [(logits, lambda g: g * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n)])
