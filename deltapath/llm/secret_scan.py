"""Secret scans with one combined automaton.

All rules are compiled into one minimal automaton whose match may start
anywhere (``automata``).  One pass over the bytes of each text follows its
transition arrays, for many texts at once, and notes where a rule accepts;
a rule's accepting positions form runs, whose last byte ends a match, and an
automaton of the reversed rule finds where the match begins.  Rules have a
shape for which this equals leftmost-longest search: a head, then one or more
bytes of one class.  Where the found matches of a rule overlap, the text is
searched again from the end of the earlier match, as a search does.

Spans are code points, end exclusive.  Null and empty texts have no spans;
repeated rows are scanned each on its own; texts of any length are scanned
whole.  Empty tables give empty results, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automata import Dfa, compile_rules, parse, reverse
from .common import Texts, id_text, slices


@dataclass(frozen=True)
class Rule:
    """``head`` then one or more of the class ``value``; kept if the value (or with ``whole`` the match) has ``least`` characters."""

    kind: str
    head: str
    value: str
    least: int
    whole: bool = False
    any_case: bool = False
    run: int = 1  # value bytes that the automaton asks for itself; only for rules without a head


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=\-]", 12, any_case=True),
    Rule("access", "AKIA", "[A-Z0-9]", 18, whole=True),
    Rule("hex", "", "[0-9a-f]", 16, run=16),
)
MORE = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", r"[A-Za-z0-9\-]", 10),
    Rule("google", "AIza", r"[A-Za-z0-9_\-]", 35),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY", "[\\-]", 5),
)
RULES = BASE + MORE
#: Texts that are followed together; fewer that are left go one by one.
LANES = 48
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


class Scanner:
    """The compiled rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        trees = [parse(r.head + r.value + (f"{{{r.run}}}" if r.run > 1 else "+"), r.any_case) for r in rules]
        self.dfa = compile_rules(trees, anywhere=True)
        # From the first byte of a value backwards over the head.
        self.heads = [compile_rules([reverse(parse(r.head, r.any_case))], anywhere=False) if r.head else None for r in rules]
        self.alive = [alive_states(h) if h else [] for h in self.heads]
        self.steps = self.dfa.table.tolist()
        self.kinds = self.dfa.classes.tolist()
        self.table = self.dfa.table.astype(np.int64)
        self.classes = self.dfa.classes.astype(np.int64)

    def accepting(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, byte position in it, mask of rules) of all accepting positions, by text and position."""
        lens = np.diff(t.offs)
        order = np.argsort(-lens, kind="stable")
        starts, lens = t.offs[:-1][order], lens[order]
        columns = self.classes[t.buf]
        table, least = self.table, self.dfa.first_accepting
        state = np.full(len(order), self.dfa.start, np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step, live = 0, len(order)
        while True:
            live = int(np.searchsorted(-lens[:live], -step, side="left"))  # longer than step
            if live < LANES:
                break
            now = state[:live]
            now += columns[starts[:live] + step]
            np.take(table, now, out=now)
            hit = np.flatnonzero(now >= least)
            if len(hit):
                found.append((order[hit], np.full(len(hit), step), now[hit].copy()))
            step += 1
        for lane in range(live):
            i = int(order[lane])
            at, states = self._follow(t.bytes(i)[step:], int(state[lane]))
            if at:
                found.append((np.full(len(at), i), np.array(at) + step, np.array(states)))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        text, at, states = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((at, text))
        return text[order], at[order], self.dfa.accepts[states[order] // self.dfa.width]

    def _follow(self, data: bytes, state: int) -> tuple[list[int], list[int]]:
        steps, kinds, least = self.steps, self.kinds, self.dfa.first_accepting
        at, states = [], []
        for i, b in enumerate(data):
            state = steps[state + kinds[b]]
            if state >= least:
                at.append(i)
                states.append(state)
        return at, states

    def _head_start(self, k: int, data: bytes, first: int, floor: int) -> int | None:
        """Where the match whose value starts at ``first`` begins, at ``floor`` or later; the farthest such place."""
        dfa = self.heads[k]
        if dfa is None:
            return first
        state, best = dfa.start, None
        for i in range(first - 1, floor - 1, -1):
            state = int(dfa.table[state + dfa.classes[data[i]]])
            if dfa.accepts[state // dfa.width]:
                best = i
            elif not self.alive[k][state // dfa.width]:
                break
        return best

    def matches(self, data: bytes, k: int, at: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, value start) of the leftmost, non-overlapping matches of rule ``k``, from its accepting positions."""
        out: list[tuple[int, int, int]] = []
        breaks = np.flatnonzero(np.diff(at) != 1) + 1
        runs = [(int(r[0]) - self.rules[k].run + 1, int(r[-1]) + 1) for r in np.split(at, breaks)] if len(at) else []
        floor = 0
        for first, end in runs:
            if first >= floor and (start := self._head_start(k, data, first, floor)) is not None:
                out.append((start, end, first))
                floor = end
            elif self.heads[k] is not None:
                # Its head lies in the earlier match: what a search that goes on behind that match finds in this run.
                again, states = self._follow(data[floor:end], self.dfa.start)
                own = [i + floor for i, s in zip(again, states) if self.dfa.accepts[s // self.dfa.width] >> k & 1]
                if own:
                    start = self._head_start(k, data, own[0], floor)
                    out.append((start, end, own[0]))
                    floor = end
        return out

    def scan(self, t: Texts) -> list[list[tuple[int, int, int]]]:
        """Kept spans (start, end, rule) of each text in code points, by start, then rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(t.n)]
        text, at, masks = self.accepting(t)
        if not len(text):
            return out
        cuts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(text))):
            i = int(text[a])
            data = t.bytes(i)
            spans = []
            for k, rule in enumerate(self.rules):
                for start, end, first in self.matches(data, k, at[a:b][(masks[a:b] >> k & 1) == 1]):
                    if end - (start if rule.whole else first) >= rule.least:
                        spans.append((start, end, k))
            if spans:
                points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                place = lambda x: int(points[x - 1]) if x else 0
                out[i] = sorted((place(s), place(e), k) for s, e, k in spans)
        return out


def alive_states(dfa: Dfa) -> list[bool]:
    """States from which some accepting state can be reached."""
    moves = dfa.table.reshape(-1, dfa.width) // dfa.width
    known = dfa.accepts != 0
    while True:
        more = known | known[moves].any(axis=1)
        if (more == known).all():
            return known.tolist()
        known = more


@lru_cache(maxsize=2)
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once in a Python worker."""
    return Scanner(rules)


def scan_rows(batches: Iterable[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    scanner = scanner_of(rules)
    kinds = [r.kind for r in rules]
    base = {r.kind for r in BASE}
    joined = lambda spans: ",".join(f"{kinds[k]}:{s}:{e}" for s, e, k in spans)
    for batch in slices(batches):
        found = scanner.scan(Texts(batch.column("text")))
        count = lambda kind: pa.array([sum(kinds[k] == kind for *_, k in x) for x in found], pa.int64())  # noqa: E731, B023
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n_assign": count("assign"),
                "n_access": count("access"),
                "n_hex": count("hex"),
                "base_sha256": pa.array([sha256(joined([s for s in x if kinds[s[2]] in base]).encode()).hexdigest() for x in found], pa.string()),
                "spans": pa.array([joined(x) for x in found], pa.string()),
            }
        )


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per document with its counts and spans.  No shuffle; every text is scanned in one task."""
    return id_text(docs).mapInArrow(lambda batches: scan_rows(batches, rules), SCHEMA)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """(doc_id, text) with every kept span replaced by ``mark``."""
    return id_text(docs).mapInArrow(lambda batches: redact_rows(batches, rules, mark), "doc_id long, text string")


def redact_rows(batches: Iterable[pa.RecordBatch], rules: tuple[Rule, ...], mark: str) -> Iterator[pa.RecordBatch]:
    scanner = scanner_of(rules)
    for batch in slices(batches):
        t = Texts(batch.column("text"))
        texts = []
        for i, spans in enumerate(scanner.scan(t)):
            text, parts, at = t.bytes(i).decode(), [], 0
            for start, end, _ in spans:
                if end > at:
                    parts += [text[at : max(at, start)], mark] if start >= at else []
                    at = end
            texts.append("".join([*parts, text[at:]]))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})
