"""Weighted finite-state transducers over words, in the max-plus semiring.

A Lexicon maps words and phrases to classes with weights. A Machine is the union
of weighted patterns over classes and words; composed with a lexicon on the fly,
it reads a clause once, token by token, and yields for every pattern that
matches somewhere the weight of its best path, a path weighing the sum of its
arcs.

A pattern is a row of elements. An element is a class (capitals), a word, or
several of both between bars, each with ":weight" if the arc is to weigh
something else than what the lexicon gives the class; "?", "*" and "+" follow as
usual. "~n" passes over n tokens at most, "^" stands for the start of a clause or
the place after a comma, "END" for its end or a comma. Commas are otherwise
passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

Labels = Mapping[str, float]
COMMA = ","
_EDGE: Labels = {"END": 0.0}


class Lexicon:
    """Classes of words and phrases: "word", "word:weight", "several-words" in one string per class."""

    def __init__(self, classes: Mapping[str, tuple[float, str]]) -> None:
        self.words: dict[str, dict[str, float]] = {}
        self.phrases: dict[str, list[tuple[tuple[str, ...], dict[str, float]]]] = {}
        phrases: dict[tuple[str, ...], dict[str, float]] = {}
        for name, (weight, text) in classes.items():
            for entry in text.split():
                word, _, own = entry.partition(":")
                parts = tuple(word.split("-"))
                place = self.words if len(parts) == 1 else phrases
                place.setdefault(parts[0] if len(parts) == 1 else parts, {})[name] = float(own) if own else weight
        for parts, labels in phrases.items():
            self.phrases.setdefault(parts[0], []).append((parts, labels))
        for found in self.phrases.values():
            found.sort(key=lambda x: -len(x[0]))

    def vocabulary(self) -> set[str]:
        return {*self.words, *(w for found in self.phrases.values() for parts, _ in found for w in parts)}

    def read(self, words: Sequence[str]) -> list[Labels]:
        """The labels of each token, the longest phrase that starts at a word being one token."""
        out: list[Labels] = []
        i = 0
        while i < len(words):
            word = words[i]
            for parts, labels in self.phrases.get(word, ()):
                if tuple(words[i : i + len(parts)]) == parts:
                    out.append(labels)
                    i += len(parts)
                    break
            else:
                out.append({**self.words.get(word, {}), word: 0.0})
                i += 1
        return out


@dataclass(frozen=True)
class Pattern:
    """What a match counts for, and the pattern."""

    counts_for: tuple[str, ...]
    text: str
    weight: float = 0.0


class Machine:
    """The union of patterns, run as one non-deterministic automaton."""

    def __init__(self, patterns: Sequence[Pattern]) -> None:
        self.patterns = list(patterns)
        self.arcs: list[list[tuple[str, float | None, int]]] = []
        self.final: list[int | None] = []
        self.starts: dict[str, list[tuple[float | None, int]]] = {}
        self.edge_starts: dict[str, list[tuple[float | None, int]]] = {}
        for number, pattern in enumerate(self.patterns):
            self._add(number, pattern.text)

    def labels(self) -> set[str]:
        """Everything the patterns name."""
        return {label for arcs in self.arcs for label, _, _ in arcs} | set(self.starts) | set(self.edge_starts)

    @staticmethod
    def _elements(text: str) -> list[tuple[list[tuple[str, float | None]], bool, bool]]:
        """(labels with weights, may be left out, may come again)."""
        out: list[tuple[list[tuple[str, float | None]], bool, bool]] = []
        for element in text.split():
            if gap := re.fullmatch(r"~(\d+)", element):
                out += [([("_", 0.0)], True, False)] * int(gap[1])
                continue
            sign = element[-1] if element[-1] in "?*+" else ""
            labels: list[tuple[str, float | None]] = []
            for option in (element[:-1] if sign else element).split("|"):
                name, _, weight = option.partition(":")
                labels.append((name, float(weight) if weight else None if name.isupper() else 0.0))
            if sign == "+":
                out.append((labels, False, False))
            out.append((labels, sign in ("?", "*", "+"), sign in ("*", "+")))
        return out

    def _add(self, number: int, text: str) -> None:
        elements = self._elements(text.removeprefix("^"))
        first = len(self.arcs)
        for i in range(len(elements) + 1):
            arcs: list[tuple[str, float | None, int]] = []
            k, ends = i, True
            while k < len(elements):
                labels, optional, again = elements[k]
                arcs += [(label, weight, first + (k if again else k + 1)) for label, weight in labels]
                if not optional:
                    ends = False
                    break
                k += 1
            self.arcs.append(arcs)
            self.final.append(number if ends and i else None)
        starts = self.edge_starts if text.startswith("^") else self.starts
        for label, weight, target in self.arcs[first]:
            starts.setdefault(label, []).append((weight, target))

    def run(self, tokens: Iterable[Labels]) -> dict[int, float]:
        """Pattern number -> weight of its best path anywhere in the clause."""
        best: dict[int, float] = {}
        active: dict[int, float] = {}
        edge = True
        for labels in (*tokens, _EDGE):
            comma = COMMA in labels
            seen = _EDGE if comma else labels
            after: dict[int, float] = dict(active) if comma else {}
            for state, weight in active.items():
                for label, own, target in self.arcs[state]:
                    if label in seen:
                        value = weight + (seen[label] if own is None else own)
                    elif label == "_" and seen is not _EDGE:
                        value = weight
                    else:
                        continue
                    if value > after.get(target, -1e9):
                        after[target] = value
            for starts in (self.starts, self.edge_starts) if edge else (self.starts,):
                for label in seen:
                    for own, target in starts.get(label, ()):
                        value = seen[label] if own is None else own
                        if value > after.get(target, -1e9):
                            after[target] = value
            for state, weight in after.items():
                number = self.final[state]
                if number is not None and weight > best.get(number, -1e9):
                    best[number] = weight
            active, edge = after, comma
        return best
