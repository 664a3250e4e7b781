"""Logistic context mixing of bit predictors, vectorised over many symbols.

Symbols are coded bit by bit, each bit under a node (the bits before it).
Every predictor looks up its own hashed context and the node in a table of bit
counts.  The predictions are mixed in the logistic domain by weights that a
gate chooses, and the mixed prediction is refined adaptively: a second gate's
map from predictions to observed frequencies, interpolated between 33 points,
is averaged in.

Training is online: a block of symbols is predicted from what was counted
before it, weights and maps move by its errors, then it is counted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_POINTS = np.linspace(-8, 8, 33)


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def context_keys(context: np.ndarray) -> np.ndarray:
    """32-bit hashes of contexts (uint64)."""
    x = context * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(16)).astype(np.uint32)


def slots(keys: np.ndarray, nodes: np.ndarray, bits: int) -> np.ndarray:
    """Places of contexts and nodes in a table of ``2 ** bits`` entries;
    ``nodes`` come multiplied (``node_keys``)."""
    x = keys + nodes
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    return (x >> np.uint32(32 - bits)).astype(np.intp)


def node_keys(nodes: np.ndarray) -> np.ndarray:
    return nodes.astype(np.uint32) * np.uint32(0x9E3779B1)


def counted(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Stretched prediction of every table entry from its bit counts."""
    limit = np.float32(stretch(4095 / 4096))
    odds = (ones + np.float32(0.4)).astype(np.float32) / (zeros + np.float32(0.4)).astype(np.float32)
    return np.clip(np.log(odds), -limit, limit)


@dataclass
class Mixer:
    """``inputs`` predictors, weights for ``gates`` gates, maps for ``maps``
    second gates."""

    inputs: int
    gates: int
    maps: int
    weights: np.ndarray = field(init=False)
    refined: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.weights = np.full((self.inputs, self.gates), 1.0 / self.inputs, dtype=np.float32)
        self.refined = np.tile(squash(_POINTS), self.maps).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.refined])

    def load(self, values: np.ndarray) -> "Mixer":
        n = self.weights.size
        self.weights = values[:n].reshape(self.weights.shape).astype(np.float32)
        self.refined = values[n:].astype(np.float32)
        return self

    def predict(self, inputs: list[np.ndarray], gate: np.ndarray, second: np.ndarray):
        """Probability of a 1 per bit, and what ``learn`` needs.  ``inputs``:
        stretched predictions of each predictor."""
        mixed = self.weights[0].take(gate) * inputs[0]
        for w, x in zip(self.weights[1:], inputs[1:]):
            mixed += w.take(gate) * x
        np.clip(mixed, np.float32(-7.99), np.float32(7.99), out=mixed)
        p = squash(mixed)
        place = (mixed + np.float32(8)) * np.float32(2)
        low = place.astype(np.intp)
        share = place - low.astype(np.float32)
        at = low + second
        below = self.refined.take(at)
        refined = below + (self.refined.take(at + 1) - below) * share
        return np.clip((p + refined) * np.float32(0.5), np.float32(1e-5), np.float32(1 - 1e-5)), (p, at, share)

    def learn(self, inputs: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, kept, rate: float) -> None:
        p, at, share = kept
        err = bit - p
        seen = np.bincount(gate, minlength=self.gates) + 1.0
        for k in range(self.inputs):
            self.weights[k] += rate * np.bincount(gate, err * inputs[k], self.gates) / np.sqrt(seen * len(bit))
        at = at + (share > 0.5)
        n = np.bincount(at, minlength=self.refined.size)
        ones = np.bincount(at, bit, self.refined.size)
        self.refined += (np.divide(ones, n, out=self.refined.astype(float), where=n > 0) - self.refined) * (n / (n + 200.0))


def second_gate(values: np.ndarray) -> np.ndarray:
    """First place of each second gate's map."""
    return values.astype(np.intp) * len(_POINTS)
