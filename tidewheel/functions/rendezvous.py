"""The name of the highest FNV-1a hash after a given prefix, without hashing every name.

A step of the hash is ``(state ^ unit) * prime`` modulo 2^64. A unit below 128 changes only the lowest seven bits, so that k of
them turn a state into ``state * prime^k + shift``, where shift depends on the units and on those seven bits alone. The
shifts of all names of one length are sorted once for each value of the seven bits; the name with the highest hash is then
the one with the largest shift that does not pass 2^64, or the largest of all if each does: one binary search, whatever
the number of names. Units of 128 and more, and what stands before them, are hashed step by step, once for all names that begin so.

The tables take 128 x 12 bytes a name.
"""

from __future__ import annotations

import numpy as np

BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Values of the bits that a narrow unit changes.
NARROW = 128


def utf16_units(text: str) -> bytes:
    return text.encode("utf-16-le", "surrogatepass")


def fnv1a64(texts: list[str]) -> np.ndarray:
    """Unsigned 64-bit FNV-1a of each text over its UTF-16 units."""
    raw = [utf16_units(t) for t in texts]
    size = np.array([len(r) // 2 for r in raw], np.int64)
    units, starts = np.frombuffer(b"".join(raw), "<u2"), np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    starts, size = starts[order], -size[order]
    state = np.full(len(raw), BASIS, np.uint64)
    for i in range(-size[0] if len(size) else 0):
        n = np.searchsorted(size, -i, "left")  # so many texts are longer than i
        state[:n] = (state[:n] ^ units[starts[:n] + i]) * np.uint64(PRIME)
    out = np.empty_like(state)
    out[order] = state
    return out


def stepped(state: np.ndarray, units: np.ndarray) -> np.ndarray:
    """States after the units, all of them or, with one more axis, each row's."""
    for unit in units.T:
        state = (state ^ unit) * np.uint64(PRIME)
    return state


class Rendezvous:
    """Names that are ranked by their hash after a state; of equal hashes the name that sorts last is taken."""

    def __init__(self, names: list[str], signed: bool):
        self.names, self.flip = np.array([*sorted(set(names)), None], object), np.uint64(1 << 63 if signed else 0)
        groups: dict[tuple[bytes, int], tuple[list[np.ndarray], list[int]]] = {}
        for k, name in enumerate(self.names[:-1]):
            units = np.frombuffer(utf16_units(name), "<u2").astype(np.uint64)
            wide = int(np.max(np.flatnonzero(units >= NARROW), initial=-1)) + 1
            rests, ranks = groups.setdefault((units[:wide].tobytes(), len(units) - wide), ([], []))
            rests.append(units[wide:])
            ranks.append(k)
        self.groups = [(np.frombuffer(wide, np.uint64), n, np.array(rests).reshape(len(ranks), n), np.array(ranks, np.int32)) for (wide, n), (rests, ranks) in groups.items()]
        self.tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def shifts(self, group: int, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted shifts of a group's names for states with these lowest bits, and the ranks of their names."""
        if (group, low) not in self.tables:
            _, n, rests, ranks = self.groups[group]
            shift = stepped(np.full(len(ranks), low, np.uint64), rests) - np.uint64(low * pow(PRIME, n, 1 << 64) % (1 << 64))
            order = np.argsort(shift, kind="stable")
            self.tables[group, low] = shift[order], ranks[order]
        return self.tables[group, low]

    def best(self, states: np.ndarray) -> np.ndarray:
        """The name of the highest hash after each state; None if there are no names."""
        top, rank = np.zeros(len(states), np.uint64), np.full(len(states), -1, np.int32)
        for g, (wide, n, _, _) in enumerate(self.groups):
            state = stepped(states, wide)
            low = (state % np.uint64(NARROW)).astype(np.int64)
            base = state * np.uint64(pow(PRIME, n, 1 << 64)) + self.flip
            order = np.argsort(low, kind="stable")
            cuts = np.searchsorted(low[order], np.arange(NARROW + 1))
            for v in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[v] : cuts[v + 1]]
                shift, ranks = self.shifts(g, v)
                k = np.searchsorted(shift, ~base[at], "right") - 1  # -1, the largest shift, if all pass 2^64
                score, own = base[at] + shift[k], ranks[k]
                more = (score > top[at]) | (score == top[at]) & (own > rank[at])
                top[at], rank[at] = np.where(more, score, top[at]), np.where(more, own, rank[at])
        return self.names[rank]
