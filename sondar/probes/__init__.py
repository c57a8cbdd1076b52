"""Probes: classifiers of activations, with distributed fitting where the model allows it."""

from sondar.probes.linear import Logistic, MassMean, standardisation
from sondar.probes.neural import NeuralProbe, scattered, sweep, sweep_layers

__all__ = ["Logistic", "MassMean", "NeuralProbe", "scattered", "standardisation", "sweep", "sweep_layers"]
