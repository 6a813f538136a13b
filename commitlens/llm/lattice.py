"""Segmentation lattices of words over a fixed public vocabulary, built for many words at once with NumPy."""

from __future__ import annotations

import functools

import numpy as np

#: Where the public vocabularies are; a parameter of every operator that reads one.
VOCAB = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters whose lattice is built at once, about: this bounds its arrays.
AT_ONCE = 60_000
_BASE, _MIX, _ALL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


class Vocabulary:
    """Pieces of a SentencePiece model file, with a hash table over them that whole arrays of substrings are looked up in.

    A piece's prior follows its rank r by Zipf-Mandelbrot, p ~ 1 / (r + 50): merge-ranked files hold ranks, not
    probabilities. A character without a piece of its own is spelled by byte pieces.
    """

    def __init__(self, pieces: list[str], kinds: list[str], ranks: list[float], sharpness: float = 1.0):
        self.pieces, self.kinds = pieces, kinds
        self.byte_id = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        n = len(pieces)
        worst = max((r for r, k in zip(ranks, kinds, strict=True) if k == "piece" and r < 1e8), default=0.0)
        w = -np.log(50.0 + np.minimum(np.array(ranks), worst))
        self.logp = np.full(n + 1, -np.inf)
        own = np.array([k == "piece" for k in kinds])
        self.logp[:n][own] = sharpness * w[own]
        self.logp[:n][[k == "byte" for k in kinds]] = sharpness * -np.log(50.0 + 2 * worst)
        self.logp[:n] -= np.logaddexp.reduce(self.logp[:n][np.isfinite(self.logp[:n])])
        self.byte_logp = float(self.logp[next(iter(self.byte_id.values()))]) if self.byte_id else -20.0
        self.longest = max((len(p) for p, k in zip(pieces, kinds, strict=True) if k == "piece"), default=1)
        self._index()

    def _index(self) -> None:
        held = {}
        for i, k in enumerate(self.kinds):
            if k == "piece":
                h = 0
                for c in self.pieces[i]:
                    h = (h * _BASE + ord(c) + 1) & _ALL
                    held.setdefault(h, -2)  # the start of a piece
                held[h] = i
        self.bits = max(4, (2 * len(held)).bit_length())
        keys, vals, most = [0] * (1 << self.bits), [-1] * (1 << self.bits), (1 << self.bits) - 1
        for h, i in held.items():
            at = ((h * _MIX) & _ALL) >> (64 - self.bits)
            while vals[at] != -1:
                at = (at + 1) & most
            keys[at], vals[at] = h, i
        self.keys, self.vals = np.array(keys, np.uint64), np.array(vals, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes; -2 where a longer piece starts so, -1 where none does."""
        at = ((h * np.uint64(_MIX)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.vals[at]
        miss = np.flatnonzero((out != -1) & (self.keys[at] != h))
        while len(miss):
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            v = self.vals[at[miss]]
            out[miss] = v
            miss = miss[(v != -1) & (self.keys[at[miss]] != h[miss])]
        return out


@functools.lru_cache(maxsize=4)
def load(path: str = VOCAB) -> tuple[list[str], list[str], list[float]]:
    """Pieces, kinds and ranks of a model file, read where it is called: operators call it on the driver and send the lists out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece" for i in range(n)]
    return [sp.id_to_piece(i) for i in range(n)], kinds, [-sp.get_score(i) for i in range(n)]


#: Vocabularies built in this process, by what they hold.
_BUILT: dict = {}


class Box:
    """A broadcast of load()'s lists (fixed size); vocabulary() builds the tables once per worker."""

    def __init__(self, spark, path: str = VOCAB):
        self.sent = spark.sparkContext.broadcast(load(path))
        self.key = (path, len(load(path)[0]))

    def vocabulary(self, sharpness: float = 1.0) -> Vocabulary:
        key = (*self.key, sharpness)
        if key not in _BUILT:
            _BUILT[key] = Vocabulary(*self.sent.value, sharpness)
        return _BUILT[key]


def _ordered(key: np.ndarray, within: np.ndarray) -> np.ndarray:
    """The order by key, and by `within` among equal keys; keys are whole numbers from 0."""
    first = np.argsort(within, kind="stable")
    key = key[first]
    if len(key) and key.max() < 1 << 16:
        key = key.astype(np.uint16)  # sorted by digits
    return first[np.argsort(key, kind="stable")]


class Lattice:
    """All piece edges of a list of words. Node k of word w is start[w] + w + k; an edge of a character without a piece has id -1."""

    def __init__(self, v: Vocabulary, words: list[str]):
        text = "".join(words)
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.lens = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(self.lens) - self.lens
        self.first = starts + np.arange(len(words))
        self.last = self.first + self.lens
        n = len(cp)
        word = np.repeat(np.arange(len(words)), self.lens)
        rel = np.arange(n) - starts[word]
        room = self.lens[word] - rel
        src, length, piece = [], [], []
        h, at = np.zeros(n, np.uint64), np.arange(n)
        for k in range(1, v.longest + 1):
            if k > 1:
                on = np.flatnonzero((ids != -1) & (room[at] >= k))
                at, h = at[on], h[on]
            if not len(at):
                break
            h = h * np.uint64(_BASE) + cp[at + k - 1] + np.uint64(1)
            ids = v.find(h)
            hit = ids >= 0
            if k == 1:
                src.append(at)
                piece.append(np.where(hit, ids, -1))
            else:
                src.append(at[hit])
                piece.append(ids[hit])
            length.append(np.full(len(src[-1]), k))
        at = np.concatenate(src) if src else np.zeros(0, np.int64)
        self.piece = np.concatenate(piece).astype(np.int64) if piece else np.zeros(0, np.int64)
        self.length = np.concatenate(length) if length else np.zeros(0, np.int64)
        self.src = at + word[at] if len(at) else at
        self.dst = self.src + self.length
        self.rel = rel[at] if len(at) else at
        self.word = word[at] if len(at) else at
        self.nodes = n + len(words)
        code = cp[at]
        self.n_bytes = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        self.code = code

    def weights(self, logp: np.ndarray, byte_logp) -> np.ndarray:
        """Log weights of the edges; logp has a column per model, or none."""
        fall = self.piece < 0
        w = logp[self.piece]
        w[fall] = (self.n_bytes[fall] * byte_logp) if w.ndim == 1 else self.n_bytes[fall][:, None] * byte_logp
        return w

    def _sweep(self, order, node, other, step, w, out):
        """out[node] = log-sum over its edges of w + out[other], in groups of equal step."""
        node, other, step, w = node[order], other[order], step[order], w[order]
        if not len(node):
            return out
        new = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        cuts = np.flatnonzero(np.r_[True, step[new][1:] != step[new][:-1]])
        ends = np.r_[cuts[1:], len(new)]
        bounds = np.r_[new, len(node)]
        for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
            lo, hi = bounds[a], bounds[b]
            out[node[new[a:b]]] = np.logaddexp.reduceat(w[lo:hi] + out[other[lo:hi]], new[a:b] - lo)
        return out

    def forward(self, w: np.ndarray) -> np.ndarray:
        """Log mass of all segmentations from a word's start to each node."""
        out = np.full((self.nodes, *w.shape[1:]), -np.inf)
        out[self.first] = 0.0
        end = self.rel + self.length
        return self._sweep(_ordered(end, self.dst), self.dst, self.src, end, w, out)

    def backward(self, w: np.ndarray) -> np.ndarray:
        """Log mass of all segmentations from each node to its word's end."""
        out = np.full((self.nodes, *w.shape[1:]), -np.inf)
        out[self.last] = 0.0
        return self._sweep(_ordered(self.rel.max(initial=0) - self.rel, self.src), self.src, self.dst, self.rel, w, out)


class Known(dict):
    """Numbers for strings, in order of first sight; `new` holds those seen since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key):
        self[key] = i = len(self)
        self.new.append(key)
        return i

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def runs(words: list[str], size: int = AT_ONCE):
    """words in runs of about `size` characters, and where each begins."""
    at = total = 0
    for i, w in enumerate(words):
        total += len(w)
        if total >= size:
            yield at, words[at : i + 1]
            at, total = i + 1, 0
    if at < len(words):
        yield at, words[at:]


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + counts[i] - 1 of every i, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)
