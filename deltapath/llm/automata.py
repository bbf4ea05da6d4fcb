"""Regular expressions of bytes as one deterministic automaton.

A small expression language (literals, classes, groups, alternatives, ``? * +``
and ``{n}``) becomes a nondeterministic automaton; subset construction makes
it deterministic for all rules at once, partition refinement minimises it, and
transition arrays over byte classes hold the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Nfa:
    """Thompson automaton; ``moves[s]``: (byte set, target), ``free[s]``: targets without a byte."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1


def parse(pattern: str, any_case: bool = False) -> tuple:
    """Syntax tree of an expression over ASCII: ("set", bytes), ("cat", ...), ("or", ...), ("rep", node, least, most)."""
    at = 0

    def peek() -> str:
        return pattern[at : at + 1]

    def take() -> str:
        nonlocal at
        at += 1
        return pattern[at - 1]

    def escaped() -> int:
        c = take()
        if c == "x":
            return int(take() + take(), 16)
        return ord(c)

    def both(codes: set[int]) -> frozenset[int]:
        if any_case:
            codes = codes | {ord(chr(c).swapcase()) for c in codes if chr(c).isalpha()}
        return frozenset(codes)

    def bracket() -> tuple:
        codes: set[int] = set()
        while peek() != "]":
            c = escaped() if (x := take()) == "\\" else ord(x)
            if peek() == "-" and pattern[at + 1] != "]":
                take()
                top = escaped() if (x := take()) == "\\" else ord(x)
                codes |= set(range(c, top + 1))
            else:
                codes.add(c)
        take()
        return ("set", both(codes))

    def atom() -> tuple:
        c = take()
        if c == "(":
            node = either()
            take()
            return node
        if c == "[":
            return bracket()
        return ("set", both({escaped() if c == "\\" else ord(c)}))

    def sequence() -> tuple:
        parts = []
        while peek() and peek() not in "|)":
            node = atom()
            while peek() and peek() in "?*+{":
                c = take()
                if c == "{":
                    n = ""
                    while peek() != "}":
                        n += take()
                    take()
                    node = ("rep", node, int(n), int(n))
                else:
                    node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
            parts.append(node)
        return ("cat", *parts)

    def either() -> tuple:
        options = [sequence()]
        while peek() == "|":
            take()
            options.append(sequence())
        return options[0] if len(options) == 1 else ("or", *options)

    return either()


def reverse(node: tuple) -> tuple:
    """The tree of the reversed language."""
    kind = node[0]
    if kind == "cat":
        return ("cat", *[reverse(x) for x in node[:0:-1]])
    if kind == "or":
        return ("or", *[reverse(x) for x in node[1:]])
    if kind == "rep":
        return ("rep", reverse(node[1]), *node[2:])
    return node


def _build(nfa: _Nfa, node: tuple, start: int) -> int:
    """Add ``node`` from ``start``; return its end state."""
    kind = node[0]
    if kind == "set":
        end = nfa.state()
        nfa.moves[start].append((node[1], end))
        return end
    if kind == "cat":
        for part in node[1:]:
            start = _build(nfa, part, start)
        return start
    if kind == "or":
        end = nfa.state()
        for part in node[1:]:
            head = nfa.state()
            nfa.free[start].append(head)
            nfa.free[_build(nfa, part, head)].append(end)
        return end
    _, inner, least, most = node
    for _ in range(least):
        start = _build(nfa, inner, start)
    end = nfa.state()
    nfa.free[start].append(end)
    if most is None:
        head = nfa.state()
        nfa.free[start].append(head)
        tail = _build(nfa, inner, head)
        nfa.free[tail] += [head, end]
    else:
        for _ in range(most - least):
            start = _build(nfa, inner, start)
            nfa.free[start].append(end)
    return end


@dataclass
class Dfa:
    """``table[state * width + classes[byte]]`` is the next state times ``width``; ``accepts[state]`` a bit mask of rules.

    States that accept nothing come first: ``first_accepting`` is the least
    accepting state times ``width``.
    """

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    width: int
    start: int
    first_accepting: int


def _byte_classes(sets: set[frozenset[int]]) -> tuple[np.ndarray, int]:
    """Bytes that no rule tells apart share a class."""
    signature = {b: tuple(b in s for s in sets) for b in range(256)}
    number: dict[tuple, int] = {}
    classes = np.array([number.setdefault(signature[b], len(number)) for b in range(256)], np.int32)
    return classes, len(number)


def compile_rules(trees: list[tuple], anywhere: bool) -> Dfa:
    """The minimal automaton of all rules; ``anywhere``: a match may start at any byte (else at the first)."""
    nfa = _Nfa()
    root = nfa.state()
    ends = []
    for tree in trees:
        head = nfa.state()
        nfa.free[root].append(head)
        ends.append(_build(nfa, tree, head))
    if anywhere:
        nfa.moves[root].append((frozenset(range(256)), root))
    classes, width = _byte_classes({s for m in nfa.moves for s, _ in m})
    example = [int(np.flatnonzero(classes == k)[0]) for k in range(width)]

    closures: dict[int, frozenset[int]] = {}

    def closure(s: int) -> frozenset[int]:
        if s not in closures:
            seen, todo = {s}, [s]
            while todo:
                for x in nfa.free[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            closures[s] = frozenset(x for x in seen if nfa.moves[x] or x in ends)
        return closures[s]

    steps = [[(frozenset(k for k in range(width) if example[k] in s), t) for s, t in m] for m in nfa.moves]
    begin = closure(root)
    number, todo, rows = {begin: 0}, [begin], []
    while todo:  # subset construction
        here = todo.pop(0)
        targets: list[set[int]] = [set() for _ in range(width)]
        for s in here:
            for ks, t in steps[s]:
                for k in ks:
                    targets[k] |= closure(t)
        row = []
        for t in map(frozenset, targets):
            if t not in number:
                number[t] = len(number)
                todo.append(t)
            row.append(number[t])
        rows.append(row)
    table = np.array(rows, np.int64)
    accepts = np.array([sum(1 << i for i, e in enumerate(ends) if e in s) for s in number], np.int64)

    group = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:  # refinement by where each byte class leads
        key = np.concatenate([group[:, None], group[table]], axis=1)
        finer = np.unique(key, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    first = np.unique(group, return_index=True)[1]
    order = np.argsort(accepts[first] != 0, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    chosen = first[order]
    small = place[group[table[chosen]]]
    accepting = np.flatnonzero(accepts[chosen])
    return Dfa(
        classes=classes,
        table=(small * width).astype(np.int32).reshape(-1),
        accepts=accepts[chosen],
        width=width,
        start=int(place[group[0]]) * width,
        first_accepting=int(accepting[0] if len(accepting) else len(chosen)) * width,
    )
