"""A lattice of subword pieces over a text, weighted by a public vocabulary.

The public vocabulary ranks its pieces.  A piece of rank r gets the unigram weight
log((r + SHIFT) ** -1 / Z): the rank law of word frequencies, with no training.  A character without a
piece of its own is spelt in UTF-8 bytes.

No piece of the vocabulary has the space mark after another character, so a text falls apart before every
run of space marks: no piece crosses such a cut.  Best paths and sums are worked out per segment between
cuts and remembered, as segments repeat.  Weights are whole multiples of 1 / ``GRAIN``, so that sums are exact, equal
paths tie however a text is split, and of equal paths the one whose last piece is longest wins, piece by piece.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

MARK = "▁"
#: Stands for a space mark that the text itself holds; no valid text has a lone surrogate.
LITERAL = "\udc81"
SHIFT = 2.7
GRAIN = 1 << 24
NONE = -math.inf
#: A segment is a run of line ends, or space marks with what follows them; no piece crosses its bounds.
SEGMENT = re.compile(f"\n+|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
#: Segments longer than this are not remembered; a memory that reaches MEMORY entries starts anew.
REMEMBERED = 40
MEMORY = 100_000
#: Segments that are worked out together, in arrays.
BLOCK = 8192
_PRIME = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20


def load_vocabulary(model_file: str) -> dict:
    """What tasks need of the model, small enough to be broadcast: ids and log weights of pieces and bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    pieces, octets = {}, {}
    for i in range(size):
        if model.is_control(i) or model.is_unknown(i):
            continue
        score = model.get_score(i)
        if model.is_byte(i):
            octets[int(model.id_to_piece(i)[3:5], 16)] = i
        else:
            pieces[model.id_to_piece(i)] = (i, -score if score > -1e8 else float(size))
    z = math.log(sum(1 / (r + SHIFT) for _, r in pieces.values()) + len(octets) / (size + SHIFT) + 1 / SHIFT)
    weight = lambda r: round((-math.log(r + SHIFT) - z) * GRAIN) / GRAIN
    weights = {p: (i, weight(r)) for p, (i, r) in pieces.items()}
    return {"pieces": weights, "bytes": octets, "byte_weight": weight(size), "end_weight": weight(0)}


_last: list[tuple[dict, Lattice]] = []


def lattice_of(vocabulary: dict) -> Lattice:
    """The lattice of a vocabulary, which a worker keeps from task to task until it gets another one."""
    if not _last or _last[0][0] is not vocabulary:
        _last[:] = [(vocabulary, Lattice(vocabulary))]
    return _last[0][1]


class Lattice:
    """Best segmentations and marginal likelihoods under one vocabulary."""

    def __init__(self, vocabulary: dict):
        self.bytes = vocabulary["bytes"]
        self.byte_weight = vocabulary["byte_weight"]
        self.end_weight = vocabulary["end_weight"]
        self.pieces = {p: v for p, v in vocabulary["pieces"].items()}
        self.longest = max(map(len, self.pieces))
        self.strings = {i: p for p, (i, _) in self.pieces.items()}
        self.octets = {i: b for b, i in self.bytes.items() if b >= 128}
        # an ASCII byte is a character by itself; only bytes from 128 on must be joined first
        self.strings |= {i: chr(b) for b, i in self.bytes.items() if b < 128}
        # the weight of every piece; a proper prefix that is no piece leads on with weight -inf
        self.tree: dict[str, float] = {p: w for p, (_, w) in self.pieces.items()}
        for p in vocabulary["pieces"]:
            for k in range(1, len(p)):
                self.tree.setdefault(p[:k], NONE)
        if any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in self.pieces):
            raise ValueError("a piece of this vocabulary crosses the bounds of a segment")
        self._tables()
        self.best_memory: dict[str, tuple[float, bytes]] = {}
        self.best_older: dict[str, tuple[float, bytes]] = {}
        self.sum_memory: dict[str, float] = {}
        self.sum_older: dict[str, float] = {}

    @staticmethod
    def normalize(text: str) -> str:
        """One space mark in front, and for each space; a space mark in the text itself is kept as bytes later."""
        return MARK + text.replace(MARK, LITERAL).replace(" ", MARK) if text else ""

    def spell(self, s: str, at: int, end: int) -> list[int]:
        """The ids of one step of a path."""
        piece = self.pieces.get(s[at:end])
        return [piece[0]] if piece else [self.bytes[b] for b in _octets(s[at])]

    def _spelt(self, char: str) -> float:
        """Weight of a character in bytes; -inf if it is a piece."""
        return NONE if char in self.pieces else self.byte_weight * len(_octets(char))

    def _paths(self, s: str, body: int, start: list[float]) -> tuple[list[float], list[int]]:
        """Best scores of positions 0..len(s), and where their last pieces start, before ``body``.

        ``start`` has the scores of the first positions as they are reached from before; where no piece from within is
        better, the last piece starts at -1.
        """
        n, get, longest = len(s), self.tree.get, self.longest
        score, back = [NONE] * (n + 1), [-1] * (n + 1)
        score[: len(start)] = start[: n + 1]
        for a in range(min(body, n)):
            base = score[a]
            if base == NONE:
                continue
            for e in range(a + 1, min(n, a + longest) + 1):
                w = get(s[a:e])
                if w is None:
                    break
                if base + w > score[e]:
                    score[e] = base + w
                    back[e] = a
            if back[a + 1] != a and (w := base + self._spelt(s[a])) > score[a + 1]:
                score[a + 1] = w
                back[a + 1] = a
        return score, back

    def _walk(self, s: str, back: list[int], end: int) -> tuple[int, list[int]]:
        """Where the best path to ``end`` enters, and its ids."""
        ids: list[int] = []
        while (a := back[end]) >= 0:
            ids += reversed(self.spell(s, a, end))
            end = a
        return end, ids[::-1]

    # -- many segments at once: substrings are looked up by rolling hashes --------------------------------------

    def _tables(self) -> None:
        names = list(self.pieces)
        codes, ends = _codes(names)
        prefix = self._prefix_hashes(codes, ends)
        keys = prefix[np.arange(len(names)), ends]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces of this vocabulary have the same hash")
        self.keys = np.append(keys, np.uint64(0))
        self.weights = np.append([self.pieces[p][1] for p in names], NONE)
        self.ids = np.append([self.pieces[p][0] for p in names], -1).astype(np.int32)
        self.slots = np.full(1 << _SLOTS, -1, np.int32)
        self.slots[(keys * _SPREAD) >> np.uint64(64 - _SLOTS)] = np.arange(len(names), dtype=np.int32)
        self.order = np.argsort(keys)
        self.sorted = keys[self.order]
        self.powers = np.cumprod(np.full(self.longest, _PRIME, np.uint64))
        self.known = {p for p in names if len(p) == 1}

    @staticmethod
    def _prefix_hashes(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        for t in range(codes.shape[1]):
            out[:, t + 1] = out[:, t] * _PRIME + codes[:, t]
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash; -1 for none."""
        at = self.slots[(h * _SPREAD) >> np.uint64(64 - _SLOTS)]
        wrong = np.flatnonzero((at >= 0) & (self.keys[at] != h))
        if len(wrong):  # another piece has the slot
            near = np.minimum(np.searchsorted(self.sorted, h[wrong]), len(self.sorted) - 1)
            at[wrong] = np.where(self.sorted[near] == h[wrong], self.order[near], -1)
        return at

    def _block(self, segments: list[str], summed: bool):
        """The recursion over all of ``segments``, longest first: scores at their ends, and the last steps' lengths and pieces."""
        codes, ends = _codes(segments)
        hashes = self._prefix_hashes(codes, ends)
        n, width = codes.shape
        alpha = np.full((n, width + 1), NONE)
        alpha[:, 0] = 0.0
        step, piece = np.zeros((n, width + 1), np.int8), np.full((n, width + 1), -1, np.int32)
        for t in range(1, width + 1):
            m = int(np.searchsorted(-ends, -t, side="right"))  # segments at least t long
            reach = min(t, self.longest)
            scores = np.empty((reach, m))
            found = np.empty((reach, m), np.int32)
            for k in range(1, reach + 1):
                at = self._find(hashes[:m, t] - hashes[:m, t - k] * self.powers[k - 1])
                found[reach - k] = at  # of equal scores the longest last piece wins, as in _paths
                scores[reach - k] = alpha[:m, t - k] + self.weights[at]
            best = scores.argmax(axis=0)
            top = scores[best, np.arange(m)]
            if summed:
                alpha[:m, t] = top + np.log(np.exp(scores - top).sum(axis=0))
            else:
                alpha[:m, t] = top
                step[:m, t] = reach - best
                piece[:m, t] = found[best, np.arange(m)]
        return alpha[np.arange(n), ends], ends, step, piece

    def _results(self, segments: list[str], summed: bool):
        """Looks up the results of segments: the short ones are remembered, the long ones kept for this call only."""
        memory = self.sum_memory if summed else self.best_memory
        older = self.sum_older if summed else self.best_older
        distinct = set(segments)
        alone = self._sum if summed else self._best
        long = {s: alone(s) for s in distinct if len(s) > REMEMBERED}
        distinct -= long.keys()
        new = distinct.difference(memory)
        if len(memory) + len(new) >= MEMORY:  # what was not met since the last time is forgotten
            if summed:
                self.sum_memory, self.sum_older = {}, memory
            else:
                self.best_memory, self.best_older = {}, memory
            memory, older = (self.sum_memory, self.sum_older) if summed else (self.best_memory, self.best_older)
            new = list(distinct)
        hard = []
        for s in new:
            if s in older:
                memory[s] = older[s]
            elif not self.known.issuperset(s):
                memory[s] = alone(s)
            else:
                hard.append(s)
        hard.sort(key=len, reverse=True)
        for at in range(0, len(hard), BLOCK):
            some = hard[at : at + BLOCK]
            scores, ends, step, piece = self._block(some, summed)
            if summed:
                memory.update(zip(some, scores.tolist(), strict=True))
                continue
            pos, rows, steps = ends.copy(), np.arange(len(some)), []
            while pos.any():
                steps.append(np.where(pos > 0, self.ids[piece[rows, pos]], -1))
                pos = pos - step[rows, pos]
            path = np.array(steps[::-1], np.int32).T
            packed = path[path >= 0].tobytes()
            bounds = np.cumsum((path >= 0).sum(axis=1)) * 4
            a = 0
            for s, score, b in zip(some, scores.tolist(), bounds.tolist(), strict=True):
                memory[s] = (score, packed[a:b])
                a = b
        return (memory | long if long else memory).__getitem__

    def _best(self, s: str) -> tuple[float, bytes]:
        score, back = self._paths(s, len(s), [0.0])
        return score[-1], np.array(self._walk(s, back, len(s))[1], np.int32).tobytes()

    def encode_all(self, normalized: list[str]) -> list[tuple[float, np.ndarray]]:
        """Score and ids of the best path through each whole normalized text."""
        split = [SEGMENT.findall(x) for x in normalized]
        result = self._results([s for x in split for s in x], False)
        out = []
        for x in split:
            found = [result(s) for s in x]
            out.append((math.fsum([w for w, _ in found]), np.frombuffer(b"".join([i for _, i in found]), np.int32)))
        return out

    def tally(self, segments: list[str], times: list[int]) -> dict[int, int]:
        """How often each id is on the best paths of distinct segments that occur as often as ``times`` says; none is remembered."""
        counts: Counter[int] = Counter()
        hard = []
        for s, n in zip(segments, times, strict=True):
            if len(s) <= REMEMBERED and self.known.issuperset(s):
                hard.append((s, n))
                continue
            for i in np.frombuffer(self._best(s)[1], np.int32).tolist():
                counts[i] += n
        hard.sort(key=lambda x: len(x[0]), reverse=True)
        sums = np.zeros(len(self.ids), np.int64)
        for at in range(0, len(hard), BLOCK):
            some, n = zip(*hard[at : at + BLOCK], strict=True)
            _, pos, step, piece = self._block(list(some), False)
            rows, n = np.arange(len(some)), np.array(n, np.int64)
            while len(rows):
                np.add.at(sums, piece[rows, pos], n[rows])
                pos = pos - step[rows, pos]
                rows, pos = rows[pos > 0], pos[pos > 0]
        for k in np.flatnonzero(sums).tolist():
            counts[int(self.ids[k])] += int(sums[k])
        return counts

    def encode(self, normalized: str) -> tuple[float, np.ndarray]:
        """Score and ids of the best path through one whole normalized text."""
        return self.encode_all([normalized])[0]

    def likelihood_all(self, normalized: list[str]) -> list[float]:
        """Natural log of each text's probability, summed over all segmentations (forward recursion in logs)."""
        split = [SEGMENT.findall(x) for x in normalized]
        result = self._results([s for x in split for s in x], True)
        return [math.fsum(map(result, x)) for x in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text whose encoding ``ids`` is."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        try:
            return "".join(map(self.strings.__getitem__, ids)).replace(MARK, " ")[1:]
        except KeyError:  # bytes of longer characters
            pass
        parts, run = [], bytearray()
        for i in ids:
            if i in self.octets:
                run.append(self.octets[i])
                continue
            if run:
                parts.append(run.decode("utf-8", "surrogatepass"))
                run = bytearray()
            parts.append(self.strings[i].replace(MARK, " "))
        if run:
            parts.append(run.decode("utf-8", "surrogatepass"))
        return "".join(parts)[1:]

    def _sum(self, s: str) -> float:
        n, get, longest = len(s), self.tree.get, self.longest
        alpha = [NONE] * (n + 1)
        alpha[0] = 0.0
        exp, log1p = math.exp, math.log1p
        for a in range(n):
            base = alpha[a]
            if base == NONE:
                continue
            for e in range(a + 1, min(n, a + longest) + 1):
                w = get(s[a:e])
                if w is None:
                    break
                if w != NONE:
                    w += base
                    x = alpha[e]
                    alpha[e] = w if x == NONE else w + log1p(exp(x - w)) if w > x else x + log1p(exp(w - x))
            if (w := base + self._spelt(s[a])) != NONE:
                alpha[a + 1] = np.logaddexp(alpha[a + 1], w)
        return float(alpha[n])

    # -- giant texts: transfer matrices between boundary states ------------------------------------------------
    # A state is how many characters a piece reaches over the boundary between two chunks.

    def _cuts(self, s: str, body: int) -> tuple[int, int] | None:
        """First and last position in the body that no piece crosses, both at least one piece inside."""
        cuts = [m.start() for m in SEGMENT.finditer(s, 0, body) if self.longest <= m.start() <= body - self.longest]
        return (cuts[0], cuts[-1]) if cuts else None

    def _reach(self, s: str, body: int, start: np.ndarray, summed: bool) -> np.ndarray:
        """Scores of positions 0..len(s), best or summed, a column an entry; ``start`` has those of the first positions."""
        n, get, longest = len(s), self.tree.get, self.longest
        add = np.logaddexp if summed else np.maximum
        out = np.full((n + 1, start.shape[1]), NONE)
        out[: len(start)] = start[: n + 1]
        for a in range(min(body, n)):
            base = out[a]
            for e in range(a + 1, min(n, a + longest) + 1):
                w = get(s[a:e])
                if w is None:
                    break
                if w != NONE:
                    add(out[e], base + w, out=out[e])
            if (w := self._spelt(s[a])) != NONE:
                add(out[a + 1], base + w, out=out[a + 1])
        return out

    def transfer(self, s: str, body: int, summed: bool = False) -> np.ndarray:
        """Matrix of one chunk, max-plus or log-sum: ``s`` holds ``body`` characters and up to a piece's length more.

        Entry i, j: the best score, or the sum over all ways, from i characters into the chunk to j characters beyond its end.
        """
        k = self.longest
        eye = np.full((k, k), NONE)
        np.fill_diagonal(eye, 0.0)
        cuts = self._cuts(s, body)
        first, last = cuts or (0, 0)
        rows = self._reach(s[last:], body - last, np.zeros((1, 1)) if cuts else eye, summed)[body - last : body - last + k].T
        out = np.full((k, k), NONE)
        if cuts:
            middle = self.likelihood_all([s[first:last]])[0] if summed else self.encode(s[first:last])[0]
            rows = self._reach(s[:first], first, eye, summed)[first][:, None] + middle + rows
        out[:, : rows.shape[1]] = rows
        return out

    def trace(self, s: str, body: int, start: list[float]) -> tuple[list[int], list[int], list[list[int]]]:
        """The best paths of one chunk to every exit state, on their own: entry states, ids all share, and the ids after.

        ``start`` has the best scores of the entry states.  An exit that can't be reached has entry -1.
        """
        cuts = self._cuts(s, body)
        first, last = cuts or (0, 0)
        entry, shared = 0, []
        if cuts:
            entry, shared = self._walk(s[:first], self._paths(s[:first], first, start)[1], first)
            shared = shared + self.encode(s[first:last])[1].tolist()
        tail = s[last:]
        score, back = self._paths(tail, body - last, [0.0] if cuts else start)
        entries, tails = [], []
        for e in range(body - last, body - last + self.longest):
            if e > len(tail) or score[e] == NONE:
                entries.append(-1)
                tails.append([])
                continue
            at, ids = self._walk(tail, back, e)
            entries.append(entry if cuts else at)
            tails.append(ids)
        return entries, shared, tails


def _codes(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points and one, a row each, and the lengths."""
    ends = np.array([len(s) for s in segments])
    flat = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(segments), int(ends.max())), np.uint64)
    out[np.arange(out.shape[1]) < ends[:, None]] = flat.astype(np.uint64) + np.uint64(1)
    return out, ends


def _octets(char: str) -> bytes:
    return (MARK if char == LITERAL else char).encode("utf-8", "surrogatepass")


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The associative product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for sums of probabilities in logs."""
    return np.logaddexp.reduce(a[:, :, None] + b[None, :, :], axis=1)


def product_tree(matrices: list[np.ndarray], product) -> list[list[tuple[int, np.ndarray]]]:
    """Levels of products of neighbours up to one; each as whole units of 1 / ``GRAIN`` and a matrix whose largest entry is 0.

    Split so, the entries stay exact however long the text is.
    """

    def level(m: np.ndarray, units: int = 0) -> tuple[int, np.ndarray]:
        top = m.max()
        top = math.floor(top * GRAIN) / GRAIN if top > NONE else 0.0
        return units + round(top * GRAIN), m - top

    levels = [[level(m) for m in matrices]]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([level(product(x[k][1], x[k + 1][1]), x[k][0] + x[k + 1][0]) if k + 1 < len(x) else x[k] for k in range(0, len(x), 2)])
    return levels


def total(levels: list[list[tuple[int, np.ndarray]]]) -> float:
    """From the start of the text to its end."""
    units, m = levels[-1][0]
    return units / GRAIN + float(m[0, 0])


def entry_scores(levels: list[list[tuple[int, np.ndarray]]]) -> list[np.ndarray]:
    """Best scores of every chunk's entry states, less the best of them, from the tree of max-plus products downwards."""
    start = np.full(len(levels[0][0][1]), NONE)
    start[0] = 0.0
    vectors = [start]
    for level in reversed(levels[:-1]):
        wider = []
        for k, v in enumerate(vectors):
            wider.append(v)
            if 2 * k + 1 < len(level):
                after = (v[:, None] + level[2 * k][1]).max(axis=0)
                wider.append(after - after.max())
        vectors = wider
    return vectors


def exit_states(entries: list[list[int]]) -> list[int]:
    """The exit state of every chunk: the last ends with the text, and a chunk's entry is the exit of the one before."""
    out = [0]
    for chunk in reversed(entries[1:]):
        out.append(chunk[out[-1]])
    return out[::-1]
