"""Probabilistic automata inferred from example strings by merging compatible prefix-tree states."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log, sqrt


@dataclass
class State:
    count: int = 0
    ends: int = 0
    seen: dict[str, int] = field(default_factory=dict)
    to: dict[str, int] = field(default_factory=dict)


@dataclass
class Automaton:
    """State 0 is the start; prob. of a symbol = its share among all that left or ended in the state."""

    states: list[State]
    alphabet: int
    smoothing: float = 0.05

    def score(self, symbols: str) -> float:
        """Log-likelihood of a string and its end, for each symbol on average; a symbol never seen in a state leaves it there."""
        at, total = 0, 0.0
        for x in symbols:
            s = self.states[at]
            total += log((s.seen.get(x, 0) + self.smoothing) / (s.count + self.smoothing * (self.alphabet + 1)))
            at = s.to.get(x, at)
        s = self.states[at]
        total += log((s.ends + self.smoothing) / (s.count + self.smoothing * (self.alphabet + 1)))
        return total / (len(symbols) + 1)


def _prefix_tree(examples: list[str]) -> list[State]:
    states = [State()]
    for example in examples:
        at = 0
        for x in example:
            s = states[at]
            s.count += 1
            s.seen[x] = s.seen.get(x, 0) + 1
            if x not in s.to:
                s.to[x] = len(states)
                states.append(State())
            at = s.to[x]
        states[at].count += 1
        states[at].ends += 1
    return states


def _differ(f: int, n: int, g: int, m: int, bound: float) -> bool:
    return n > 0 and m > 0 and abs(f / n - g / m) > bound * (1 / sqrt(n) + 1 / sqrt(m))


def _compatible(states: list[State], a: int, b: int, bound: float) -> bool:
    """Whether the shares in a and b, and in what follows both, agree within a Hoeffding bound."""
    todo = [(a, b)]
    while todo:
        i, j = todo.pop()
        s, t = states[i], states[j]
        if _differ(s.ends, s.count, t.ends, t.count, bound):
            return False
        for x in s.seen.keys() | t.seen.keys():
            if _differ(s.seen.get(x, 0), s.count, t.seen.get(x, 0), t.count, bound):
                return False
        todo += [(s.to[x], t.to[x]) for x in s.to.keys() & t.to.keys()]
    return True


def _fold(states: list[State], into: int, tree: int) -> None:
    """Add the counts of a tree to what a state and its successors have."""
    todo = [(into, tree)]
    while todo:
        i, j = todo.pop()
        s, t = states[i], states[j]
        s.count, s.ends = s.count + t.count, s.ends + t.ends
        for x, n in t.seen.items():
            s.seen[x] = s.seen.get(x, 0) + n
            if x in s.to:
                todo.append((s.to[x], t.to[x]))
            else:
                s.to[x] = t.to[x]


def infer(examples: list[str], alphabet: int, alpha: float = 0.05) -> Automaton:
    """Automaton of the examples: states of the prefix tree merge, nearest to the start first, where their shares agree."""
    states, bound = _prefix_tree(examples), sqrt(log(2 / alpha) / 2)
    kept, front = [0], [(0, x) for x in sorted(states[0].to)]
    while front:
        front.sort(key=lambda e: (-states[states[e[0]].to[e[1]]].count, e))
        source, x = front.pop(0)
        child = states[source].to[x]
        if child in kept:
            continue
        home = next((k for k in kept if _compatible(states, k, child, bound)), None)
        if home is None:
            kept.append(child)
        else:
            states[source].to[x] = home
            _fold(states, home, child)
        front = [(k, y) for k in kept for y in sorted(states[k].to) if states[k].to[y] not in kept]
    place = {k: i for i, k in enumerate(kept)}
    return Automaton([State(states[k].count, states[k].ends, states[k].seen, {y: place[t] for y, t in states[k].to.items()}) for k in kept], alphabet)
