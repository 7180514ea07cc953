"""Probabilistic automata by state merging.

A prefix tree of the samples counts how often each prefix is reached, ends and goes on with each symbol. States are
merged where the frequencies of their endings and continuations, and recursively of their successors', differ by no
more than Hoeffding bounds allow. First states of one depth are merged, which pools what single prefixes are too rare
to show: where values end, which symbols stand where. Then states of different depths are, which makes loops; for
that both need `evidence`, so that a few samples keep the shape that they have.

The merged counts, smoothed towards the classes of symbols of the state and of the whole sample, give probabilities.
"""

from __future__ import annotations

import math

#: Classes of characters.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
OTHER = len(CLASSES)
CLASS_OF = {c: k for k, chars in enumerate(CLASSES) for c in chars}
#: How many characters share a class; of the others, as many as there are printable ones besides.
WIDTHS = [*map(len, CLASSES), 30]
#: Weight of the class in a state, of the sample's classes in a state's, and of ending where nothing is known.
TO_CLASS, TO_SAMPLE, END = 10.0, 2.0, 0.02


class Automaton:
    """States by number: n (reached), end (ended), out (count by symbol), to (next state by symbol)."""

    def __init__(self, values: list[str], depth: int = 64, alpha: float = 0.05, evidence: int = 100):
        """Symbols beyond the first `depth` of a value are tallied in one last state, so the tree is bounded by samples * depth."""
        self.bound, self.evidence, self.depth = math.sqrt(0.5 * math.log(2 / alpha)), evidence, depth
        self.n, self.end, self.out, self.to, self.level, self.up = [0], [0], [{}], [{}], [0], [0]
        for value in values:
            at = 0
            for s in value:
                self.n[at] += 1
                self.out[at][s] = self.out[at].get(s, 0) + 1
                if s not in self.to[at]:
                    self.to[at][s] = at if self.level[at] == depth else self._state(self.level[at] + 1)
                at = self.to[at][s]
            self.n[at] += 1
            self.end[at] += 1
        classes = [1.0] * len(WIDTHS)
        for out in self.out:
            for s, c in out.items():
                classes[CLASS_OF.get(s, OTHER)] += c
        self.classes = [c / sum(classes) for c in classes]
        self._merge_levels()
        self._merge_loops()
        self._settle()

    def _state(self, level: int) -> int:
        for column, value in ((self.n, 0), (self.end, 0), (self.out, {}), (self.to, {}), (self.level, level), (self.up, len(self.up))):
            column.append(value)
        return len(self.n) - 1

    def _find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = map(self._find, todo.pop())
            # a value's end beyond `depth` is one state whatever stands there, which says nothing of another
            if a == b or (a, b) in seen or (self.level[a] != self.level[b] and self.depth in (self.level[a], self.level[b])):
                continue
            seen.add((a, b))
            if self._differ(self.end[a], self.n[a], self.end[b], self.n[b]):
                return False
            p, q = self.out[a], self.out[b]
            if any(self._differ(p.get(s, 0), self.n[a], q.get(s, 0), self.n[b]) for s in p.keys() | q.keys()):
                return False
            todo += [(self.to[a][s], self.to[b][s]) for s in p.keys() & q.keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Make b, and the successors that both have, one with a."""
        todo = [(a, b)]
        while todo:
            a, b = map(self._find, todo.pop())
            if a == b:
                continue
            self.up[b] = a
            self.n[a] += self.n[b]
            self.end[a] += self.end[b]
            for s, c in self.out[b].items():
                self.out[a][s] = self.out[a].get(s, 0) + c
            for s, to in self.to[b].items():
                if s in self.to[a]:
                    todo.append((self.to[a][s], to))
                else:
                    self.to[a][s] = to

    def _next(self, states: list[int]) -> list[int]:
        """The states after these, the most frequent first."""
        found = {self._find(t) for a in states for t in self.to[self._find(a)].values()}
        return sorted(found, key=lambda x: (-self.n[x], x))

    def _merge_levels(self) -> None:
        level, here = 0, [0]
        while here:
            level += 1
            kept: list[int] = []
            for b in self._next(here):
                if self._find(b) != b or self.level[b] != level:
                    continue
                for a in kept:
                    if self._compatible(a, b):
                        self._fold(a, b)
                        break
                else:
                    kept.append(b)
            here = kept

    def _merge_loops(self) -> None:
        red, blue = [0], self._next([0])
        while blue:
            b = blue[0]
            for a in red if self.n[b] >= self.evidence else ():
                if self.n[a] >= self.evidence and self._compatible(a, b):
                    self._fold(a, b)
                    break
            else:
                red.append(b)
            red = list(dict.fromkeys(map(self._find, red)))
            blue = [x for x in self._next(red) if x not in set(red)]

    def _settle(self) -> None:
        """Number the states that are left, and give each its log2 probabilities."""
        left, place = [0], {0: 0}
        for a in left:
            for t in map(self._find, self.to[a].values()):
                if t not in place:
                    place[t] = len(left)
                    left.append(t)
        self.states = [self._logs(a, place) for a in left]
        self.start = place[self._find(0)]
        del self.n, self.end, self.out, self.to, self.level, self.up

    def _logs(self, a: int, place: dict[int, int]):
        """Of a state: log2 of ending, log2 by class of an unseen symbol, by symbol (log2, next state), where unseen symbols lead (None: nowhere)."""
        n, out = self.n[a], self.out[a]
        stop = (self.end[a] + TO_SAMPLE * END) / (n + TO_SAMPLE)
        of_class = [TO_SAMPLE * c for c in self.classes]
        going = sum(out.values())
        for s, c in out.items():
            of_class[CLASS_OF.get(s, OTHER)] += c
        each = [c / (going + TO_SAMPLE) / w for c, w in zip(of_class, WIDTHS, strict=True)]
        share = lambda s: (out.get(s, 0) + TO_CLASS * each[CLASS_OF.get(s, OTHER)]) / (going + TO_CLASS) * (1 - stop)
        unseen = [math.log2(TO_CLASS * e / (going + TO_CLASS) * (1 - stop)) for e in each]
        follow = {s: (math.log2(share(s)), place[self._find(t)]) for s, t in self.to[a].items()}
        main = max(out, key=lambda s: (out[s], s), default=None)
        return math.log2(stop), unseen, follow, None if main is None else follow[main][1]

    def total(self, value: str) -> float:
        """log2 probability of the value and its end. A symbol that a state has not seen leads where its most frequent one does."""
        at, total = self.start, 0.0
        for s in value:
            if at is None:
                k = CLASS_OF.get(s, OTHER)
                total += math.log2(self.classes[k] / WIDTHS[k] * (1 - END))
                continue
            _, unseen, follow, main = self.states[at]
            if s in follow:
                more, at = follow[s]
            else:
                more, at = unseen[CLASS_OF.get(s, OTHER)], main
            total += more
        return total + (math.log2(END) if at is None else self.states[at][0])

    def per_symbol(self, value: str) -> float:
        return self.total(value) / (len(value) + 1)
