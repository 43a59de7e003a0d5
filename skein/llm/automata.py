"""Finite automata over bytes, run on many strips of text at once.

A strip's effect is a function: for each state it may be entered in, the state
it is left in and the number of units that begin inside. Such functions compose
associatively, so strips are read independently of each other and the states in
which they are entered are known afterwards, by a prefix scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from skein.llm.words import chunks

#: Bytes of a strip.
STRIP = 512
#: Stands for "no byte" at the end of a strip: changes no state, counts nothing.
NONE = 256


@dataclass(frozen=True)
class Automaton:
    """``step[s, b]``: the state after byte b in state s; ``begins[s, b]``: whether a unit begins with that byte. State 0 is the first."""

    step: np.ndarray
    begins: np.ndarray

    @property
    def states(self) -> int:
        return len(self.step)

    def padded(self) -> tuple[np.ndarray, np.ndarray]:
        """Both tables, flat, with a column for NONE."""
        own = np.arange(self.states)[:, None]
        return np.hstack([self.step, own]).astype(np.int32).ravel(), np.hstack([self.begins, own * 0]).astype(np.int64).ravel()


def code_points() -> Automaton:
    """Units are code points: the state is the number of bytes of the current one that are still due."""
    step, begins = np.zeros((4, 256), np.int32), np.ones((4, 256), bool)
    byte = np.arange(256)
    due = np.select([byte >= 0xF0, byte >= 0xE0, byte >= 0xC0], [3, 2, 1], 0)
    follows = (byte & 0xC0) == 0x80
    for s in range(4):
        step[s] = np.where(follows & (s > 0), s - 1, due)
        begins[s] = ~(follows & (s > 0))
    return Automaton(step, begins)


def literals(words: tuple[str, ...]) -> Automaton:
    """Looks for any of the words: once one was there, the last state holds for good. A unit is the end of the first one."""
    coded = [w.encode() for w in words]
    prefixes = sorted({w[:i] for w in coded for i in range(len(w))}, key=lambda p: (len(p), p))
    at = {p: i for i, p in enumerate(prefixes)}
    end = len(prefixes)
    step, begins = np.full((end + 1, 256), end, np.int32), np.zeros((end + 1, 256), bool)
    for p in prefixes:
        for b in range(256):
            seen = p + bytes([b])
            if any(seen.endswith(w) for w in coded):
                begins[at[p], b] = True
            else:
                step[at[p], b] = next(at[seen[i:]] for i in range(len(seen) + 1) if seen[i:] in at)
    return Automaton(step, begins)


def after(to: np.ndarray, units: np.ndarray, then_to: np.ndarray, then_units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The functions ``to, units`` followed by the others, row by row."""
    return np.take_along_axis(then_to, to, 1), units + np.take_along_axis(then_units, to, 1)


def running(to: np.ndarray, units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's function after all before it from row ``first`` (for each row) on: composed over distances that double."""
    place = np.arange(len(to)) - first
    far = 1
    while far <= int(place.max(initial=0)):
        late = np.flatnonzero(place >= far)
        got = after(to[late - far], units[late - far], to[late], units[late])
        to, units = to.copy(), units.copy()
        to[late], units[late] = got
        far *= 2
    return to, units


class Scan:
    """An automaton's functions over all strips of some texts (bytes and the offsets of the texts in them)."""

    def __init__(self, auto: Automaton, raw: np.ndarray, offsets: np.ndarray):
        self.auto = auto
        sizes = np.diff(offsets)
        strips = np.maximum(-(-sizes // STRIP), 1)
        self.begin = np.cumsum(strips) - strips  # of each text, its first strip
        owner = np.repeat(np.arange(len(sizes)), strips)
        place = np.arange(len(owner)) - self.begin[owner]
        at = offsets[owner][:, None] + place[:, None] * STRIP + np.arange(STRIP)
        wide = np.append(raw, np.zeros(1, np.uint8)).astype(np.int32)
        self.bytes = np.where(at < offsets[owner + 1][:, None], wide[np.minimum(at, len(raw))], NONE).T.copy()
        self.step, self.begins = auto.padded()
        state = np.tile(np.arange(auto.states, dtype=np.int32), (len(owner), 1))
        units = np.zeros((len(owner), auto.states), np.int64)
        for byte in self.bytes:
            cell = state * (NONE + 1) + byte[:, None]
            units += self.begins[cell]
            state = self.step[cell]
        self.own_units = units
        self.to, self.units = running(state, units, self.begin[owner])
        self.owner, self.place, self.last = owner, place, self.begin + strips - 1

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """(state left, units) for each text and each state it may be entered in."""
        return self.to[self.last], self.units[self.last]

    def find(self, entry: np.ndarray, target: np.ndarray) -> np.ndarray:
        """In each text, entered in its ``entry`` state: the byte at which unit number ``target`` (from 0) begins; -1 if none does."""
        out = np.full(len(entry), -1, np.int64)
        state = entry[self.owner]
        rows = np.arange(len(state))
        upto = self.units[rows, state]
        back = np.maximum(rows - 1, 0)
        inside = np.where(self.place > 0, self.to[back, state], state)  # the state at the strip's own begin
        before = np.where(self.place > 0, self.units[back, state], 0)
        wanted = target[self.owner]
        hit = np.flatnonzero((wanted >= before) & (wanted < upto))
        if not len(hit):
            return out
        state, left = inside[hit].astype(np.int32), wanted[hit] - before[hit]
        found = np.full(len(hit), -1, np.int64)
        for p, byte in enumerate(self.bytes[:, hit]):
            cell = state * (NONE + 1) + byte
            begun = self.begins[cell]
            found[(begun > 0) & (left == 0) & (found < 0)] = p
            left -= begun
            state = self.step[cell]
        out[self.owner[hit]] = self.place[hit] * STRIP + found
        return out


def scans(texts: pa.Array, *autos: Automaton):
    """(index of the first text, a Scan for each automaton) of runs of texts of bounded size; null is empty."""
    for first, raw, offsets in chunks(texts):
        yield first, len(offsets) - 1, [Scan(a, raw, offsets) for a in autos]
