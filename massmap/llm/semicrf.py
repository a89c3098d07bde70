"""A semi-Markov conditional random field over short token sequences.

A sequence is cut into segments; a segment is one outside token or a whole entity
of bounded length. An entity is scored by features of the whole span, segments by
the labels that follow one another. Training maximises the conditional likelihood
with forward-backward sums over all segmentations; prediction is the best one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

OUTSIDE = "-"


@dataclass
class Lattice:
    """Candidate entities of one sequence by the token they end before: (start, label, features)."""

    length: int
    ending: list[list[tuple[int, str, tuple[str, ...]]]]


@dataclass
class SemiCRF:
    labels: tuple[str, ...]
    weights: dict[tuple[str, str], float] = field(default_factory=dict)
    follows: dict[tuple[str, str], float] = field(default_factory=dict)

    def _score(self, label: str, features: tuple[str, ...]) -> float:
        return sum(self.weights.get((label, feature), 0.0) for feature in features)

    def _segments(self, lattice: Lattice, end: int):
        yield end - 1, OUTSIDE, 0.0, ()
        for start, label, features in lattice.ending[end]:
            yield start, label, self._score(label, features), features

    def _states(self):
        return (OUTSIDE, *self.labels)

    def best(self, lattice: Lattice) -> list[tuple[int, int, str]]:
        """Entities (start, end, label) of the best segmentation; ties go to fewer entities."""
        scores: list[dict[str, float]] = [{OUTSIDE: 0.0}]
        back: list[dict[str, tuple[int, str]]] = [{}]
        for end in range(1, lattice.length + 1):
            here: dict[str, float] = {}
            came: dict[str, tuple[int, str]] = {}
            for start, label, score, _ in self._segments(lattice, end):
                for before, value in scores[start].items():
                    total = value + score + self.follows.get((before, label), 0.0)
                    if label not in here or total > here[label]:
                        here[label], came[label] = total, (start, before)
            scores.append(here)
            back.append(came)
        end, label = lattice.length, max(scores[-1], key=lambda name: (scores[-1][name], name == OUTSIDE))
        out = []
        while end:
            start, before = back[end][label]
            if label != OUTSIDE:
                out.append((start, end, label))
            end, label = start, before
        return out[::-1]

    def _forward(self, lattice: Lattice):
        """Log sums of all segmentations up to each token, and the segments that were met."""
        sums: list[dict[str, float]] = [{OUTSIDE: 0.0}]
        met = []
        for end in range(1, lattice.length + 1):
            parts: dict[str, list[float]] = {}
            for start, label, score, features in self._segments(lattice, end):
                met.append((start, end, label, score, features))
                for before, value in sums[start].items():
                    parts.setdefault(label, []).append(value + score + self.follows.get((before, label), 0.0))
            sums.append({label: _log_sum(values) for label, values in parts.items()})
        return sums, met

    def expectations(self, lattice: Lattice):
        """Log partition, expected feature counts and expected label successions."""
        sums, met = self._forward(lattice)
        total = _log_sum(list(sums[-1].values()))
        after: list[dict[str, float]] = [{} for _ in range(lattice.length + 1)]
        after[lattice.length] = {label: 0.0 for label in sums[-1]}
        features: dict[tuple[str, str], float] = {}
        follows: dict[tuple[str, str], float] = {}
        pending: dict[int, dict[str, list[float]]] = {}
        for start, end, label, score, found in sorted(met, key=lambda segment: -segment[1]):
            if not after[end] and end in pending:
                after[end] = {name: _log_sum(values) for name, values in pending[end].items()}
            beyond = after[end].get(label)
            if beyond is None:
                continue
            for before, value in sums[start].items():
                way = score + self.follows.get((before, label), 0.0)
                pending.setdefault(start, {}).setdefault(before, []).append(way + beyond)
                mass = math.exp(value + way + beyond - total)
                follows[before, label] = follows.get((before, label), 0.0) + mass
                for feature in found:
                    features[label, feature] = features.get((label, feature), 0.0) + mass
        return total, features, follows

    def fit(
        self, examples: list[tuple[Lattice, list[tuple[int, int, str]]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-3
    ) -> "SemiCRF":
        """Stochastic gradient ascent in the given order, with step sizes by AdaGrad; reruns agree."""
        squares: dict[tuple, float] = {}
        for _ in range(epochs):
            for lattice, gold in examples:
                _, expected, succeeded = self.expectations(lattice)
                held, order = _gold_counts(lattice, gold)
                for table, want, have in ((self.weights, held, expected), (self.follows, order, succeeded)):
                    for key in {*want, *have}:
                        slope = want.get(key, 0.0) - have.get(key, 0.0) - decay * table.get(key, 0.0)
                        if abs(slope) < 1e-9:
                            continue
                        squares[id(table), key] = square = squares.get((id(table), key), 1e-6) + slope * slope
                        table[key] = table.get(key, 0.0) + rate * slope / math.sqrt(square)
        return self


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(value - top) for value in values))


def _gold_counts(lattice: Lattice, gold: list[tuple[int, int, str]]):
    features: dict[tuple[str, str], float] = {}
    follows: dict[tuple[str, str], float] = {}
    begins = {start: (end, label) for start, end, label in gold}
    at, before = 0, OUTSIDE
    while at < lattice.length:
        end, label = begins.get(at, (at + 1, OUTSIDE))
        found = next((f for s, name, f in lattice.ending[end] if (s, name) == (at, label)), None)
        if label != OUTSIDE and found is None:  # not a candidate: the model cannot say it
            end, label = at + 1, OUTSIDE
        for feature in found or () if label != OUTSIDE else ():
            features[label, feature] = features.get((label, feature), 0.0) + 1.0
        follows[before, label] = follows.get((before, label), 0.0) + 1.0
        at, before = end, label
    return features, follows
