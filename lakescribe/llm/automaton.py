"""Regular expressions as minimal deterministic automata over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np

_parser = re._parser  # the standard library's own reading of a pattern
_NO_END = 1 << 32


class Nfa:
    """Fragments built one after the other; state -> byte moves and empty moves."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree: Iterable, start: int, any_case: bool) -> int:
        """Append a parsed pattern behind `start`; gives its end state."""
        for op, arg in tree:
            name = str(op)
            if name in ("LITERAL", "IN"):
                end = self.state()
                self.moves[start].append((_bytes([(op, arg)] if name == "LITERAL" else arg, any_case), end))
                start = end
            elif name == "SUBPATTERN":
                start = self.add(arg[3], start, any_case)
            elif name == "BRANCH":
                end = self.state()
                for branch in arg[1]:
                    head = self.state()
                    self.empty[start].append(head)
                    self.empty[self.add(branch, head, any_case)].append(end)
                start = end
            elif name == "MAX_REPEAT":
                low, high, body = arg
                for _ in range(low):
                    start = self.add(body, start, any_case)
                if int(high) >= _NO_END - 1:
                    head, end = self.state(), self.state()
                    self.empty[start] += [head, end]
                    tail = self.add(body, head, any_case)
                    self.empty[tail] += [head, end]
                    start = end
                else:
                    end = self.state()
                    for _ in range(int(high) - low):
                        self.empty[start].append(end)
                        start = self.add(body, start, any_case)
                    self.empty[start].append(end)
                    start = end
            else:
                raise ValueError(f"not supported in a rule: {name}")
        return start


def _bytes(items: Iterable, any_case: bool) -> frozenset[int]:
    found, negate = set(), False
    for op, arg in items:
        name = str(op)
        if name == "NEGATE":
            negate = True
        elif name == "LITERAL":
            found.add(arg)
        elif name == "RANGE":
            found.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"not supported in a class: {name}")
    if max(found, default=0) > 127:
        raise ValueError("rules are ASCII")
    if any_case:
        found |= {ord(c) for x in found for c in (chr(x).lower(), chr(x).upper())}
    return frozenset(range(128)) - found if negate else frozenset(found)


def compile_dfa(pattern: str, any_case: bool = False, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Transition array (state x 256) of one rule and which states accept; state 0 is the start.

    `backward` reads the rule from right to left.
    """
    nfa = Nfa()
    start = nfa.state()
    end = nfa.add(_parser.parse(pattern), start, any_case)
    moves, empty = nfa.moves, nfa.empty
    if backward:
        moves, empty = [[] for _ in nfa.moves], [[] for _ in nfa.moves]
        for a, out in enumerate(nfa.moves):
            for on, b in out:
                moves[b].append((on, a))
        for a, out in enumerate(nfa.empty):
            for b in out:
                empty[b].append(a)
        start, end = end, start
    return _subsets(moves, empty, {start}, {end: 1})


def combine_dfas(each: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One automaton that tells where, anywhere in a text, the shortest match of any rule ends.

    The accept mask has a bit for each rule. Nothing leads on from an accepting state of a rule, so the
    tails of long matches do not multiply the states.
    """
    moves: list[list[tuple[frozenset[int], int]]] = []
    starts, ends = set(), {}
    for bit, (table, accept) in enumerate(each):
        base = len(moves)
        starts.add(base)
        for state, row in enumerate(table.tolist()):
            if accept[state]:
                ends[base + state] = 1 << bit
                moves.append([])
                continue
            targets: dict[int, set[int]] = {}
            for byte, to in enumerate(row):
                if not _dead(table, accept, to):
                    targets.setdefault(to, set()).add(byte)
            moves.append([(frozenset(on), base + to) for to, on in targets.items()])
    return _subsets(moves, [[] for _ in moves], starts, ends, again=starts)


def _dead(table: np.ndarray, accept: np.ndarray, state: int) -> bool:
    return not accept[state] and bool((table[state] == state).all())


def _subsets(moves, empty, starts: set[int], ends: dict[int, int], again: set[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction, then minimisation. `again`: states that a match may begin from at each byte."""

    def closed(states: Iterable[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    # bytes that all moves treat alike share a class
    used = {on for out in moves for on, _ in out}
    kinds: dict[tuple, int] = {}
    of_byte = np.array([kinds.setdefault(tuple(b in on for on in used), len(kinds)) for b in range(256)])
    sample = [int(np.flatnonzero(of_byte == k)[0]) for k in range(len(kinds))]
    begin = closed(starts)
    number, table, todo = {begin: 0}, [], [begin]
    for states in todo:
        row = []
        for byte in sample:
            target = closed({b for a in states for on, b in moves[a] if byte in on} | again)
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        table.append(row)
    masks = [0] * len(todo)
    for i, states in enumerate(todo):
        for x in states:
            masks[i] |= ends.get(x, 0)
    small, accept = _minimal(np.array(table), np.array(masks))
    return small[:, of_byte].astype(np.int32), accept


def _minimal(table: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no input tells apart."""
    _, block = np.unique(accept, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    order: dict[int, int] = {int(block[0]): 0}
    for x in block:
        order.setdefault(int(x), len(order))
    new = np.array([order[int(x)] for x in block])
    first = np.zeros(len(order), int)
    first[new[::-1]] = np.arange(len(new))[::-1]
    return new[table[first]], accept[first]


def rows_of(table: np.ndarray, accept: np.ndarray) -> list:
    """The start state as a list: entry b is the next state's list, entry 256 the mask of accepted rules.

    Entry 257 tells whether the state can never accept again.
    """
    rows: list[list] = [[] for _ in table]
    for state, row in enumerate(rows):
        row.extend([rows[x] for x in table[state].tolist()])
        row.append(int(accept[state]))
        row.append(bool((table[state] == state).all() and not accept[state]))
    return rows[0]
