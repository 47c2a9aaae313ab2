"""A minimal acyclic transducer over byte strings, kept in flat arrays that can be memory-mapped.

Words that share suffixes share states. Every arc carries a number; their sum along a word's
path is the word's place among the sorted words, which selects its output. Sorted words are
added one by one: when the next word leaves the path of the last one, the states that are
left behind are final and are replaced by an equal state if there is one.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np


class _State:
    __slots__ = ("arcs", "final", "no", "below")

    def __init__(self) -> None:
        self.arcs: dict[int, _State] = {}
        self.final = False
        self.no = -1
        self.below = 0

    def key(self) -> tuple:
        return (self.final, tuple((b, s.no) for b, s in self.arcs.items()))


def compile_lexicon(entries: dict[bytes, bytes]) -> bytes:
    """Words to outputs (packed ids), as one block of bytes for ``Lexicon``."""
    known: dict[tuple, _State] = {}
    order: list[_State] = []

    def settle(state: _State) -> _State:
        found = known.get(key := state.key())
        if found is None:
            state.no, state.below = len(order), state.final + sum(s.below for s in state.arcs.values())
            order.append(state)
            known[key] = found = state
        return found

    root, path, last = _State(), [], b""
    path = [root]
    for word in sorted(entries):
        same = len(os.path.commonprefix([word, last]))
        for i in range(len(last), same, -1):
            path[i - 1].arcs[last[i - 1]] = settle(path[i])
        del path[same + 1 :]
        for b in word[same:]:
            path[-1].arcs[b] = new = _State()
            path.append(new)
        path[-1].final = True
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1].arcs[last[i - 1]] = settle(path[i])
    settle(root)

    keys, to, out, final = [], [], [], []
    for s in order:
        final.append(s.final)
        n = int(s.final)
        for b, t in sorted(s.arcs.items()):
            keys.append(s.no << 8 | b)
            to.append(t.no)
            out.append(n)
            n += t.below
    outputs = [entries[w] for w in sorted(entries)]
    ends = np.cumsum([0] + [len(x) for x in outputs], dtype="<i8")
    parts = [
        np.array(keys, "<i8"), np.array(to, "<i4"), np.array(out, "<i4"), np.array(final, "u1"), ends, np.frombuffer(b"".join(outputs), "u1"),
    ]
    head = np.array([order[-1].no, max(map(len, entries), default=0), *[len(p) for p in parts]], "<i8")
    return head.tobytes() + b"".join(p.tobytes() for p in parts)


_mapped: dict[str, Lexicon] = {}


class Lexicon:
    """Reads what ``compile_lexicon`` made, from a file mapped read-only."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype="u1", mode="r") if os.path.getsize(path) else np.zeros(0, "u1")
        head = raw[:64].view("<i8")
        self.root, self.longest = int(head[0]), int(head[1])
        at, parts = 64, []
        for n, kind in zip(head[2:], ("<i8", "<i4", "<i4", "u1", "<i8", "u1"), strict=True):
            size = int(n) * np.dtype(kind).itemsize
            parts.append(np.frombuffer(raw[at : at + size], kind) if n else np.zeros(0, kind))
            at += size
        self.keys, self.to, self.out, self.final, self.ends, self.ids = parts

    @classmethod
    def from_bytes(cls, data: bytes) -> Lexicon:
        """Through a file of the worker's temp folder, which is unlinked once it is mapped: the pages
        live as long as the worker needs them, and nothing is left behind. A worker that runs
        several tasks maps a lexicon once."""
        digest = hashlib.sha256(data).hexdigest()
        if digest not in _mapped:
            with tempfile.NamedTemporaryFile(prefix="casewell-lexicon-") as f:
                f.write(data)
                f.flush()
                _mapped.clear()
                _mapped[digest] = cls(f.name)
        return _mapped[digest]

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """Outputs of ``words``, None for those that are not in the lexicon. All words take a
        step at a time."""
        result: list[bytes | None] = [None] * len(words)
        if not len(self.keys):
            return result
        lengths = np.fromiter(map(len, words), "<i8", len(words))
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), "u1").astype("<i8")
        live = np.flatnonzero((lengths <= self.longest) & (lengths > 0))
        state = np.full(len(words), self.root, "<i8")
        place = np.zeros(len(words), "<i8")
        done = []
        for i in range(self.longest):
            if not len(live):
                break
            key = state[live] << 8 | flat[starts[live] + i]
            arc = np.searchsorted(self.keys, key)
            arc[arc == len(self.keys)] = 0
            good = self.keys[arc] == key
            live, arc = live[good], arc[good]
            state[live] = self.to[arc]
            place[live] += self.out[arc]
            ended = lengths[live] == i + 1
            stop = live[ended]
            done.append(stop[self.final[state[stop]] == 1])
            live = live[~ended]
        for k in np.concatenate(done).tolist() if done else ():
            p = int(place[k])
            result[k] = self.ids[self.ends[p] : self.ends[p + 1]].tobytes()
        return result
