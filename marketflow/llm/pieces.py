"""SentencePiece encoding and decoding (3): batched numpy Viterbi over a piece model.

A text becomes words, each with its leading mark for a space. Different words of one length form a matrix and advance
together, place by place: hashes of the substrings that end there probe the sorted piece keys, and the best candidate
of each word is stored as a back pointer.

What counts as best depends on the model. Unigram models maximise the sum of scores. For merge (BPE) models, whose
scores are ranks, that sum gives other ids than the library for more than half of all different words, so there a
candidate may follow only a piece that merging would leave beside it; exactly one can, and the maximum finds it.

A word of more than LONG characters would advance alone, a numpy step a character. It is cut first wherever no piece holds the two
characters at the border, as nothing can then span it. What is still long is cut, for merge models, into blocks that advance
together as words of one length do: each starts some characters early, and where its back pointers over the
longest piece's length equal those of the block before, all that follow are those of the whole word, as they hang on no more than
that; a block of which this does not hold is done again from the pointers of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketflow.llm.memo import Memo, spread, word_keys
from marketflow.llm.textarrays import mix, powers, raw, slices

MARK = 0x2581
#: Characters of a word that advances by itself; of a block of a longer one; and by how many a block starts early.
LONG, BLOCK, EARLY = 2048, 1024, 256
_state: dict = {}


@dataclass(frozen=True)
class PieceModel:
    """pieces, scores, kinds (normal 1, unknown 2, control 3, byte 6) by id; merges: whether scores are merge ranks."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    merges: bool

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(own.get_piece_size())
        kinds = [2 if own.is_unknown(i) else 3 if own.is_control(i) else 6 if own.is_byte(i) else 1 for i in ids]
        scores = np.array([own.get_score(i) for i in ids])
        normal = scores[np.array(kinds) == 1]
        whole = bool(len(normal)) and bool((normal == np.round(normal)).all()) and bool((normal <= 0).all())
        return cls([own.id_to_piece(i) for i in ids], scores, np.array(kinds), whole)


class Lattice:
    """The sorted piece keys of a model, and for merge models which pieces may stand side by side."""

    MULTIPLIER = 0xD6E8FEB86659FD93

    def __init__(self, model: PieceModel):
        self.model = model
        self.ids = np.flatnonzero(model.kinds == 1)
        points = [np.array([ord(c) for c in model.pieces[i]], np.uint64) for i in self.ids]
        self.longest = max(map(len, points))
        keys = np.array([self.key(p) for p in points], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], self.ids[order]
        self.bits = np.zeros(1 << 21, bool)
        self.bits[(self.keys >> np.uint64(43)).astype(np.int64)] = True
        size = len(model.pieces)
        self.bytes = np.zeros(256, np.int64)
        for i in np.flatnonzero(model.kinds == 6):
            self.bytes[int(model.pieces[i][3:5], 16)] = i
        self.unknown = int(np.flatnonzero(model.kinds == 2)[0])
        self.rank = np.full(size + 1, 1 << 40)  # by id; the last stands for an unknown character
        self.rank[self.ids] = -model.scores[self.ids].astype(np.int64) if model.merges else 0
        self.spaces: dict[int, list[int]] = {}
        self.borders = np.unique(np.concatenate([p[:-1] << np.uint64(21) | p[1:] for p in points]))
        if model.merges:
            self._spines(size)

    def key(self, points: np.ndarray) -> np.uint64:
        sums = (points + np.uint64(0x1F123BB5)) * powers(self.MULTIPLIER, len(points))
        return mix(np.array([sums.sum(dtype=np.uint64) + np.uint64(len(points))], np.uint64))[0]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece ids, or -1."""
        out = np.full(keys.shape, -1)
        maybe = np.nonzero(self.bits[(keys >> np.uint64(43)).astype(np.int64)])
        k = keys[maybe]
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == k, self.ids[at], -1)
        return out

    def merge(self, symbols: list[int]) -> tuple[list[int], tuple[int, int] | None]:
        """Merges neighbours, best rank and then leftmost first, until none is left; and the last pair merged."""
        last = None
        symbols = list(symbols)
        while len(symbols) > 1:
            best = None
            for k in range(len(symbols) - 1):
                both = self.pairs.get((symbols[k], symbols[k + 1]))
                if both is not None and (best is None or self.rank[both] < self.rank[best[1]]):
                    best = k, both
            if best is None:
                break
            last = symbols[best[0]], symbols[best[0] + 1]
            symbols[best[0] : best[0] + 2] = [best[1]]
        return symbols, last

    def _spines(self, size: int) -> None:
        """pairs: what two pieces merge to. parts: the two pieces a piece is merged from, or itself twice. A piece that
        merging never makes is left out."""
        text = {self.model.pieces[i]: int(i) for i in self.ids}
        self.pairs = {(text[p[:k]], text[p[k:]]): i for p, i in text.items() for k in range(1, len(p)) if p[:k] in text and p[k:] in text}
        self.parts = np.tile(np.arange(size + 1), (2, 1))
        self.made = np.ones(size + 1, bool)
        for p, i in text.items():
            if len(p) > 1:
                end, last = self.merge([text.get(c, size) for c in p]) if set(p) != {chr(MARK)} else ([], None)
                self.made[i] = end == [i]
                if end == [i]:
                    self.parts[:, i] = last
        codes = np.array([a << 20 | b for a, b in self.pairs], np.int64)
        order = np.argsort(codes)
        self.pair_codes, self.pair_ranks = codes[order], self.rank[np.array(list(self.pairs.values()), np.int64)[order]]
        self.known = np.full(1 << 20, -1, np.int64)
        self.good = np.zeros(1 << 20, bool)
        # spines: for each piece its rightmost (leftmost) parts from the piece itself down to a character
        self.spine = []
        for side in (1, 0):
            rows = [np.arange(size + 1)]
            while True:
                down = self.parts[side][rows[-1]]
                if (down == rows[-1]).all():
                    break
                rows.append(down)
            self.spine.append(np.array(rows))

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces a and b side by side; answers are remembered by pair."""
        code = a.astype(np.int64) << 20 | b
        slot = (mix(code.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        new = np.flatnonzero(self.known[slot] != code)
        out = self.good[slot]
        if len(new):
            some, back = np.unique(code[new], return_inverse=True)
            answer = self._beside(some >> 20, some & 0xFFFFF)
            out[new] = answer[back]
            put = (mix(some.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
            self.known[put], self.good[put] = some, answer
        return out

    def _beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Follows both sides of the border up: a part may grow into the next only before the border pair would merge."""
        x, y = self.spine[0][-1][a], self.spine[1][-1][b]
        i = np.full(len(a), len(self.spine[0]) - 1)
        j = np.full(len(a), len(self.spine[1]) - 1)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        never = 1 << 41
        while len(live):
            ia, jb = i[live], j[live]
            # skip levels at which the spine stands still
            up_a = np.where(ia > 0, self.spine[0][np.maximum(ia - 1, 0), a[live]], -1)
            up_b = np.where(jb > 0, self.spine[1][np.maximum(jb - 1, 0), b[live]], -1)
            still_a, still_b = (ia > 0) & (up_a == x[live]), (jb > 0) & (up_b == y[live])
            move = still_a | still_b
            if move.any():
                i[live[still_a]] -= 1
                j[live[still_b]] -= 1
                continue
            code = x[live] << 20 | y[live]
            at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
            cross = np.where(self.pair_codes[at] == code, self.pair_ranks[at], never)
            next_a, next_b = np.where(ia > 0, self.rank[up_a], never), np.where(jb > 0, self.rank[up_b], never)
            bad = (cross < never) & (cross < next_a) & (cross <= next_b)
            good[live[bad]] = False
            left = ~bad & (next_a <= next_b) & (next_a < never)
            right = ~bad & ~left & (next_b < never)
            x[live[left]], i[live[left]] = up_a[left], ia[left] - 1
            y[live[right]], j[live[right]] = up_b[right], jb[right] - 1
            live = live[left | right]
        return good

    def run(self, n: int) -> list[int]:
        """Pieces of n marks in a row, merged as stretches of equal pieces: of a stretch, pairs are merged from the left, and one piece may stay."""
        if n in self.spaces or not self.model.merges:
            return self.spaces.setdefault(n, [])
        one = int(self.find(np.array([self.key(np.array([MARK], np.uint64))]))[0])
        runs = [(one, n)]
        while True:
            pairs = [(runs[k][0], runs[k][0], k, True) for k in range(len(runs)) if runs[k][1] > 1] + [(runs[k][0], runs[k + 1][0], k, False) for k in range(len(runs) - 1)]
            known = [(self.rank[self.pairs[x, y]], k, not own, self.pairs[x, y]) for x, y, k, own in pairs if (x, y) in self.pairs]
            if not known:
                break
            _, k, border, both = min(known)
            x, count = runs[k]
            if border:
                y, more = runs[k + 1]
                runs[k : k + 2] = [(x, count - 1), (both, 1), (y, more - 1)]
            else:
                runs[k : k + 1] = [(both, count // 2), (x, count % 2)]
            runs = [r for r in runs if r[1]]
            for k in range(len(runs) - 1, 0, -1):
                if runs[k][0] == runs[k - 1][0]:
                    runs[k - 1 : k + 1] = [(runs[k][0], runs[k - 1][1] + runs[k][1])]
        self.spaces[n] = [x for x, count in runs for _ in range(count)]
        return self.spaces[n]

    def viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """points: a matrix of words of one length. The words' pieces, one after another, and how many each has; -1 - c
        stands for an unknown character c."""
        n, size = points.shape
        piece, step = self.forward(points)
        unknown = len(self.model.pieces)
        path, used = np.zeros((n, size), np.int64), np.zeros((n, size), bool)
        at, rows, column = np.full(n, size), np.arange(n), size
        while len(rows):
            column -= 1
            p = piece[rows, at]
            path[rows, column] = np.where(p == unknown, -1 - points[rows, at - 1].astype(np.int64), p)
            used[rows, column] = True
            at = at - step[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        return path[used], used.sum(axis=1)

    def forward(self, points: np.ndarray, head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The last piece and its length at every place of words of one length. head (merge models): the last pieces at the words' first places, known already."""
        n, size = points.shape
        unknown = len(self.model.pieces)
        sums = np.zeros((n, size + 1), np.uint64)
        np.cumsum((points + np.uint64(0x1F123BB5)) * powers(self.MULTIPLIER, size), axis=1, out=sums[:, 1:])
        back = powers(pow(self.MULTIPLIER, -1, 1 << 64), size + 1)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        piece = np.full((n, size + 1), -1)
        step = np.zeros((n, size + 1), np.int64)
        worst = float(self.model.scores[self.ids].min()) - 10 if not self.model.merges else 0.0
        known = 0
        if head is not None:
            known = head.shape[1] - 1
            piece[:, : known + 1], best[:, : known + 1] = head, np.where(head >= 0, 0.0, -np.inf)
        for end in range(known + 1, size + 1):
            longest = min(end, self.longest)
            start = np.arange(end - 1, end - longest - 1, -1)
            found = self.find(mix((sums[:, end, None] - sums[:, start]) * back[start] + (end - start).astype(np.uint64)))
            found[:, 0] = np.where(found[:, 0] < 0, unknown, found[:, 0])
            value = np.full(found.shape, -np.inf)
            row, k = np.nonzero((found >= 0) & np.isfinite(best[:, start]))
            new, before = found[row, k], piece[row, start[k]]
            if self.model.merges:
                fits = self.made[new]
                inner = np.flatnonzero(fits & (before >= 0))
                fits[inner] = self.beside(before[inner], new[inner])
                value[row[fits], k[fits]] = k[fits]
            else:
                value[row, k] = best[row, start[k]] + np.where(new == unknown, worst, self.model.scores[np.minimum(new, unknown - 1)])
            pick = value.argmax(axis=1)
            rows = np.arange(n)
            best[:, end] = value[rows, pick]
            piece[:, end] = np.where(np.isfinite(best[:, end]), found[rows, pick], -1)
            step[:, end] = pick + 1
        return piece, step

    def long(self, points: np.ndarray) -> np.ndarray:
        """The pieces of one long word."""
        pair = points[:-1] << np.uint64(21) | points[1:]
        at = np.minimum(np.searchsorted(self.borders, pair), len(self.borders) - 1)
        cuts = np.concatenate([[0], np.flatnonzero(self.borders[at] != pair) + 1, [len(points)]])
        sizes = np.diff(cuts)
        out: list = [None] * len(sizes)
        order = np.argsort(sizes, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            size = int(sizes[rows[0]])
            if size > LONG and self.model.merges:
                for k in rows:
                    out[k] = self.blocks(points[cuts[k] : cuts[k + 1]])
                continue
            most = max(1, 400_000 // (size + 1))
            for i in range(0, len(rows), most):
                some = rows[i : i + most]
                flat, counts = self.viterbi(points[cuts[some][:, None] + np.arange(size)])
                for k, part in zip(some, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                    out[k] = part
        return np.concatenate(out)

    def blocks(self, points: np.ndarray) -> np.ndarray:
        """The pieces of a long word of a merge model: blocks advance together, then meet."""
        n, block, early = len(points), max(BLOCK, 2 * self.longest), max(EARLY, 2 * self.longest)
        begins = np.arange(early, n - block + 1, block)
        piece, step = np.full(n + 1, -1), np.zeros(n + 1, np.int64)
        first, length = self.forward(points[None, :early])
        piece[: early + 1], step[: early + 1] = first[0], length[0]
        done, i, shift, tries = early, 0, 0, 4
        while i < len(begins):
            some = begins[i : i + 256]
            found, length = self.forward(points[some[:, None] - early - shift + np.arange(early + shift + block)])
            i += len(some)
            for k, begin in enumerate(some.tolist()):
                near = slice(begin - self.longest + 1, begin + 1)
                mine = slice(early + shift - self.longest + 1, early + shift + 1)
                if (found[k, mine] == piece[near]).all() and (piece[near] >= 0).all():
                    piece[begin + 1 : begin + block + 1], step[begin + 1 : begin + block + 1] = found[k, early + shift + 1 :], length[k, early + shift + 1 :]
                elif tries:  # a word that repeats itself keeps its phase: the blocks from here on start where a piece does
                    at, tries = begin, tries - 1
                    while at > begin - early:
                        at -= int(step[at])
                    shift, i = begin - early - at, i - len(some) + k
                    break
                else:
                    self.go_on(points, piece, step, begin, begin + block)
                done = begin + block
        if done < n:
            self.go_on(points, piece, step, done, n)
        path, at, unknown = [], n, len(self.model.pieces)
        last, back = piece.tolist(), step.tolist()
        while at > 0:
            path.append(last[at] if last[at] != unknown else -1 - int(points[at - 1]))
            at -= back[at]
        return np.array(path[::-1], np.int64)

    def go_on(self, points: np.ndarray, piece: np.ndarray, step: np.ndarray, begin: int, end: int) -> None:
        """Fills piece and step from begin to end, from those of the longest piece's length before."""
        near = max(0, begin - self.longest)
        found, length = self.forward(points[None, near:end], piece[None, near : begin + 1])
        piece[begin + 1 : end + 1], step[begin + 1 : end + 1] = found[0, begin - near + 1 :], length[0, begin - near + 1 :]


class Pieces:
    """Encodes and decodes texts with a model that keeps every space and adds one before a text."""

    def __init__(self, model: PieceModel):
        self.model, self.lattice, self.memo = model, Lattice(model), Memo(bits=20, room=3_000_000)
        self.raw = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else p.replace(chr(MARK), " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]

    def encode_words(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words of points, one after another, and how many each has. A word: marks, then other characters."""
        seen = np.append(0, np.cumsum(points == MARK))
        marks = seen[ends] - seen[starts]
        empty = marks == ends - starts
        body = np.where(empty, ends, starts + np.maximum(marks - 1, 0))
        extra = marks - (~empty & (marks > 0))
        length = ends - body
        flats, begins, sizes, total = [], np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), 0
        order = np.argsort(length, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            size = int(length[rows[0]]) if len(rows) else 0
            most = max(1, 400_000 // (size + 1))
            for k in range(0, len(rows) if size else 0, most):
                some = rows[k : k + most]
                if size > LONG:
                    each = [self.lattice.long(points[body[r] : ends[r]].astype(np.uint64)) for r in some]
                    flat, counts = np.concatenate(each), np.array([len(x) for x in each])
                    flats.append(flat)
                    begins[some], sizes[some] = total + np.cumsum(counts) - counts, counts
                    total += len(flat)
                    continue
                flat, counts = self.lattice.viterbi(points[body[some][:, None] + np.arange(size)].astype(np.uint64))
                flats.append(flat)
                begins[some], sizes[some] = total + np.cumsum(counts) - counts, counts
                total += len(flat)
        flat = np.concatenate([*flats, np.zeros(0, np.int64)])
        odd = np.append(0, np.cumsum(flat < 0))
        one = self.lattice.run(1)
        more = []
        for i in np.flatnonzero((extra > 0) | (odd[begins + sizes] > odd[begins])):
            path, marks = flat[begins[i] : begins[i] + sizes[i]].tolist(), int(extra[i])
            if marks:
                if path[:1] == one:  # the last mark stayed alone, so it joins the others
                    path, marks = path[1:], marks + 1
                path = self.lattice.run(marks) + path
            path = [q for p in path for q in (self.lattice.bytes[list(chr(-1 - p).encode())].tolist() if p < 0 else [p])]
            begins[i], sizes[i] = total, len(path)
            total += len(path)
            more += path
        return spread(np.concatenate([flat, np.array(more, np.int64)]), begins, sizes), sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; an empty text has none."""
        joined = [chr(MARK) + t.replace(" ", chr(MARK)) if t else "" for t in texts]
        offsets = np.cumsum([0, *map(len, joined)])
        whole = "".join(joined)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        mark = points == MARK
        head = np.zeros(len(points) + 1, bool)
        head[offsets] = True
        begin = head[:-1].copy()
        begin[1:] |= mark[1:] & ~mark[:-1]
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(points))
        keys = word_keys(points, starts, ends[: len(starts)], Lattice.MULTIPLIER)
        ids, sizes = self.memo.gather(keys, lambda rows: self.encode_words(points, starts[rows], ends[rows]))
        before = np.append(0, np.cumsum(sizes))[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(before[:-1], before[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def worker(path: str) -> Pieces:
    """One a Python worker."""
    if path not in _state:
        _state[path] = Pieces(PieceModel.load(path))
    return _state[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chars, ids (array), round_trip (whether decoding gives the text back): a row per row of docs.

    A null text is empty and has no ids. Rows with equal ids stay separate; other columns are ignored.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker(path)
        for batch in batches:
            column = batch.column("text")
            for i, j in slices(raw(column)[1], 1 << 19):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                found = own.encode(texts)
                same = [own.decode(x) == t for x, t in zip(found, texts, strict=True)]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.concatenate(found).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(same)],
                    ["doc_id", "n_chars", "ids", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n_chars long, ids array<int>, round_trip boolean")
