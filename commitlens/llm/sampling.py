"""SentencePiece encoding and decoding by Gumbel top-k without replacement.

The segmentations of a text over a fixed public vocabulary form a tree: a choice of piece at each point. The chance of
a segmentation is the product of its pieces' priors, over the sum of all. Its perturbed log chance is that plus Gumbel
noise, and the k largest are a sample without replacement. They are found by A-star search from the top: a set of
segmentations with a common prefix has a perturbed maximum, exact by the mass the backward pass gives (a Gumbel
truncated at the parent's), so the search pops the set of largest maximum, draws its best segmentation, and puts back
what branches off it at every later choice. Only as many sets as samples are still due are kept.

The (k + 1)-th maximum is the threshold for inclusion scores: log(1 - exp(-exp(log p - threshold))); 0 where no
segmentation is left. Pieces join spaces only to what follows and never hold a line end, so the lattice of a text is the
lattices of its chunks. A worker keeps those that it meets again, up to a bound of nodes, and texts are taken in slices of
bounded length, so that its memory doesn't grow with what it reads.

Edge cases: a null or empty text has one segmentation, the empty one, with scores 0; a text with fewer than k
segmentations gives them all; repeated rows (same id) draw the same noise; a null id is seeded by its text alone. The
mark that stands for spaces, in a text itself, is spelled by bytes, so decoding gives back every text exactly.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_slices
from .lattice import SPACE, VOCAB, Box, Known, Lattice, Vocabulary, gather, runs

K = 2
SHARPNESS = 1.0
#: Nodes of the lattices that a worker keeps, about.
HELD = 300_000
#: Bytes of the texts in a slice, about.
SLICE_BYTES = 500_000
_CHUNKS = re.compile(f"{SPACE}*(?:\n|[^{SPACE}\n]+)|{SPACE}+")
#: Stands for a literal mark while the spaces are marks; it has no piece.
_STAND_IN = "\U0010fffe"


def escaped(text: str) -> str:
    return SPACE + text.replace(SPACE, _STAND_IN).replace(" ", SPACE) if text else ""


def split(text: str) -> list[str]:
    """The chunks of an escaped text, as _CHUNKS finds them."""
    if "\0" in text:
        return _CHUNKS.findall(text)
    text = text.replace("\n", "\0\n\0").replace(SPACE, "\0" + SPACE).replace(SPACE + "\0\n", SPACE + "\n")
    while SPACE + "\0" + SPACE in text:
        text = text.replace(SPACE + "\0" + SPACE, SPACE + SPACE)
    return list(filter(None, text.split("\0")))


def decode(ids, v: Vocabulary) -> str:
    """The text of piece ids."""
    if not hasattr(v, "spelled"):
        v.spelled = np.array([bytes([int(p[1:-1], 16)]) if k == "byte" else p.replace(SPACE, " ").encode() for p, k in zip(v.pieces, v.kinds, strict=True)], object)
    return b"".join(v.spelled[ids]).decode("utf-8", "surrogatepass")[1:] if len(ids) else ""


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(seeds: np.ndarray, turn: int, number: np.ndarray) -> np.ndarray:
    """A salt for each (row seed, turn, number of a chunk)."""
    return _mixed(seeds + np.uint64((turn + 1) * 0xD1B54A32D192ED03 % (1 << 64)) + _mixed(number.astype(np.uint64) + np.uint64(1)))


def uniform(salt: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) by salt and step: they don't depend on what else is drawn at the same time."""
    return (_mixed(salt + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(float) * 2.0**-53


class Flat:
    """An array that grows in place."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(4096, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(self.n // 4 + len(x) + 4096, self.held.dtype)])
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)

    @property
    def now(self) -> np.ndarray:
        return self.held[: self.n]


class Paths:
    """Choices at each node of the chunks seen, held flat: an edge's chance, target and piece.

    A chunk's main path takes the likeliest edge at each node. Most draws are that path, so a draw first decides
    between it and all others by one number, and walks the lattice only for the others.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.flat = {"reach": Flat(float), "logq": Flat(float), "dst": Flat(np.int32), "piece": Flat(np.int32), "lo": Flat(np.int32), "first": Flat(np.int32), "z": Flat(float), "main": Flat(np.int32), "main_at": Flat(np.int64), "main_n": Flat(np.int64), "main_p": Flat(float)}
        self.byte = np.array([v.byte_id.get(i, 0) for i in range(128)])
        self.clear()

    def clear(self):
        self.known, self.seen = Known(), np.zeros(0, np.int64)
        for x in self.flat.values():
            x.n = 0
        self.flat["lo"].add(np.zeros(1, np.int32))

    def _forget(self) -> None:
        """Once the bound is passed, keeps of the chunks those seen again since the last time, most often seen first, up to half the bound."""
        f = {k: x.now for k, x in self.flat.items()}
        if len(f["lo"]) <= HELD:
            return
        n_nodes = np.diff(np.r_[f["first"], len(f["lo"]) - 1])
        often = np.argsort(-self.seen, kind="stable")
        often = often[(self.seen[often] > 1) & (np.cumsum(n_nodes[often]) <= HELD // 2)]
        keep = np.sort(often)
        chunks, n_nodes, first = list(self.known), n_nodes[keep], f["first"][keep].astype(np.int64)
        begin = f["lo"][first].astype(np.int64)
        n_edges = f["lo"][first + n_nodes] - begin
        nodes, edges, main = gather(first, n_nodes), gather(begin, n_edges), gather(f["main_at"][keep], f["main_n"][keep])
        back_nodes, back_edges = first - (np.cumsum(n_nodes) - n_nodes), begin - (np.cumsum(n_edges) - n_edges)
        dst = f["dst"][edges]
        new = {k: f[k][edges] for k in ("reach", "logq", "piece")} | {k: f[k][keep] for k in ("z", "main_n", "main_p")}
        new["dst"] = np.where(dst < 0, -1, dst - np.repeat(back_nodes, n_edges))
        new["lo"] = np.r_[f["lo"][nodes] - np.repeat(back_edges, n_nodes), len(edges)]
        new["first"] = first - back_nodes
        new["main"] = f["main"][main] - np.repeat(back_edges, new["main_n"])
        new["main_at"] = np.cumsum(new["main_n"]) - new["main_n"]
        self.clear()
        self.known.numbers([chunks[i] for i in keep.tolist()])
        self.known.new.clear()
        self.seen = np.ones(len(keep), np.int64)
        for k, x in self.flat.items():
            x.n = 0
            x.add(new[k])

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The chunks' numbers; they and the views of the arrays hold until the next call."""
        self._forget()
        at = self.known.numbers(chunks)
        self.seen = np.r_[self.seen, np.zeros(len(self.known.new), np.int64)] + np.bincount(at, minlength=len(self.known))
        for _, new in runs(self.known.new):
            self._build(new)
        self.known.new.clear()
        for k, x in self.flat.items():
            setattr(self, k, x.now)
        return at

    def _build(self, chunks: list[str]) -> None:
        f = self.flat
        lat = Lattice(self.v, chunks)
        w = lat.weights(self.v.logp, self.v.byte_logp)
        back = lat.backward(w)
        logq = w + back[lat.dst] - back[lat.src]
        logq[logq > -2e-15] = 0.0  # an only edge, but for rounding
        order = np.argsort(lat.src, kind="stable")
        src, q = lat.src[order], logq[order]
        n = np.bincount(src, minlength=lat.nodes)
        lo = np.cumsum(n) - n
        # the likeliest edge of a node comes first
        start = lo[n > 0]
        best = np.flatnonzero(q == np.repeat(np.maximum.reduceat(q, start), n[n > 0]))
        best = best[np.r_[True, src[best][1:] != src[best][:-1]]]
        order[start], order[best] = order[best], order[start]
        dst, logq = lat.dst[order], logq[order]
        nodes, edges = f["lo"].n - 1, f["piece"].n
        run = np.cumsum(np.exp(logq))
        reach = np.minimum(run - np.r_[0.0, run][lo[src]], 1.0)
        reach[np.r_[src[1:] != src[:-1], True]] = 1.0
        f["reach"].add(reach)
        f["logq"].add(logq)
        ends = np.zeros(lat.nodes, bool)
        ends[lat.last] = True
        to = np.where(ends[dst], -1, dst)
        f["dst"].add(np.where(to < 0, -1, nodes + to))
        # a character without a piece: its byte's id, or minus two less its code where it has several bytes
        code = lat.code.astype(np.int64)
        f["piece"].add(np.where(lat.piece >= 0, lat.piece, np.where(code < 128, self.byte[np.minimum(code, 127)], -2 - code))[order])
        f["lo"].n -= 1
        f["lo"].add(np.r_[edges + lo, edges + len(src)])
        f["first"].add(nodes + lat.first)
        f["z"].add(back[lat.first])
        steps, rows, live, node = [], [], np.arange(len(lat.first)), lat.first
        while len(live):
            e = lo[node]
            steps.append(e)
            rows.append(live)
            on = to[e] >= 0
            node, live = to[e][on], live[on]
        row = np.concatenate(rows)
        main, length = np.concatenate(steps)[np.argsort(row, kind="stable")], np.bincount(row)
        begin = np.cumsum(length) - length
        f["main_at"].add(f["main"].n + begin)
        f["main"].add(edges + main)
        f["main_n"].add(length)
        f["main_p"].add(np.exp(np.add.reduceat(logq[main], begin)))

    def walk(self, nodes: np.ndarray, salt: np.ndarray, u: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn from each node to its chunk's end, one chunk after the other, and how many each has.

        With u (at or above the chance of the main path from each node), the draw is of all paths but the main one: it
        leaves the main path where the chance of having stayed on it falls to u.
        """
        steps, rows, live = [], [], np.arange(len(nodes))
        stayed = None if u is None else np.ones(len(nodes))
        while len(live):
            e = self.lo[nodes]
            r = uniform(salt, len(steps) + 1)
            if stayed is None:
                on = np.flatnonzero(self.reach[e] <= r)
            else:
                bound = stayed >= 0  # has not left the main path yet
                likeliest = self.reach[e]
                stayed = np.where(bound, stayed * likeliest, stayed)
                leaves = bound & (u >= stayed)
                r = np.where(bound, np.where(leaves, likeliest + r * (1 - likeliest), 0.0), r)
                stayed[leaves] = -1.0
                on = np.flatnonzero(likeliest <= r)
            while len(on):
                e[on] += 1
                on = on[self.reach[e[on]] <= r[on]]
            steps.append(e)
            rows.append(live)
            nodes = self.dst[e]
            on = nodes >= 0
            nodes, live, salt = nodes[on], live[on], salt[on]
            if stayed is not None:
                stayed, u = stayed[on], u[on]
        if not steps:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = np.concatenate(rows)
        return np.concatenate(steps)[np.argsort(row, kind="stable")], np.bincount(row)

    def draw(self, chunks: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a drawn path of each chunk, one chunk after the other, and how many each has."""
        u = uniform(salt, 0)
        other = np.flatnonzero(u >= self.main_p[chunks])
        edges, length = self.walk(self.first[chunks[other]], salt[other], u[other])
        n = self.main_n[chunks]
        if not len(other):
            return self.main[gather(self.main_at[chunks], n)], n
        n[other] = length
        begin = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int64)
        stay = np.ones(len(chunks), bool)
        stay[other] = False
        own = chunks[stay]
        out[gather(begin[stay], n[stay])] = self.main[gather(self.main_at[own], n[stay])]
        out[gather(begin[other], length)] = edges
        return out, n

    def node_of(self, e: int) -> int:
        return int(np.searchsorted(self.lo, np.int32(e), side="right")) - 1


class Search:
    """The search over one text's segmentations. Works with exponentials e = exp(-Gumbel): the least comes first, and one truncated at a bound is the bound plus a fresh one.

    waiting: (log e, position of the split, the path it leaves, the split's chunk, edges taken there), least first.
    """

    def __init__(self, chunks: np.ndarray, seed: int, k: int):
        self.chunks, self.seed, self.k = chunks, seed, k
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.out, self.waiting = [], []
        self.log_e, self.before, self.chunk, self.gone = float(np.log(self.rng.exponential())), np.zeros(0, np.int64), 0, []

    def settle(self, paths: Paths, edges: np.ndarray, per: np.ndarray) -> bool:
        """Takes the drawn rest of a path in, puts what branches off it to wait, and picks the next split; False at the end."""
        q = paths.logq[edges]
        base = float(paths.logq[self.before].sum())
        ahead = base + np.cumsum(q) - q  # log chance before each choice
        whole = np.concatenate([self.before, edges])
        self.out.append((whole, base + float(q.sum())))
        if not len(edges):
            return False
        # what is left at each choice: all but the edge taken there (and at the split, the ones taken before). Along the
        # path these are falls of the chance of having stayed on it, so sums over stretches need its ends alone
        fall = np.r_[0.0, np.cumsum(q)]
        left = lambda lo, hi: math.exp(fall[lo]) * -math.expm1(fall[hi] - fall[lo])
        here = left(0, 1)
        if self.gone:
            node = paths.node_of(int(edges[0]))
            free = [x for x in range(paths.lo[node], paths.lo[node + 1]) if x not in self.gone and x != edges[0]]
            here = float(np.exp(paths.logq[free]).sum()) if free else 0.0
        parts = [(0, 1, here), (1, len(q), left(1, len(q)))]
        due = self.k + 1 - len(self.out)
        ends, log_e = np.cumsum(per), self.log_e
        # the sets in order of their least e: the next comes after a fresh exponential over all that is left
        for _ in range(due):
            total = sum(m for _, _, m in parts)
            if not total > 0.0:
                break
            more = math.log(self.rng.exponential()) - base - math.log(total)
            log_e = max(log_e, more) + math.log1p(math.exp(-abs(log_e - more)))
            u, at = self.rng.random() * total, 0
            while u >= parts[at][2] and at < len(parts) - 1:
                u, at = u - parts[at][2], at + 1
            while not parts[at][2] > 0.0:
                at -= 1
            lo, hi, _ = parts[at]
            i = lo
            if hi - lo > 1:
                path = -fall[lo : hi + 1]
                stay = math.exp(fall[lo]) - u
                j = np.searchsorted(path, -math.log(stay), side="right") if stay > 0 else len(path)
                i = lo + int(min(j, np.searchsorted(path, path[-1], side="left"))) - 1
            parts[at : at + 1] = [(x, y, left(x, y)) for x, y in ((lo, i), (i + 1, hi)) if y > x]
            self.waiting.append((log_e, len(self.before) + i, whole, self.chunk + int(np.searchsorted(ends, i, side="right")), [*(self.gone if i == 0 else []), int(edges[i])]))
            if not parts:
                break
        self.waiting.sort(key=lambda x: x[0])
        del self.waiting[due:]
        if len(self.out) == self.k or not self.waiting:
            return False
        self.log_e, i, whole, self.chunk, self.gone = self.waiting.pop(0)
        node = paths.node_of(self.gone[0])
        free = np.array([x for x in range(paths.lo[node], paths.lo[node + 1]) if x not in self.gone])
        p = np.cumsum(np.exp(paths.logq[free] - paths.logq[free].max()))
        self.edge = int(free[min(np.searchsorted(p, self.rng.random() * p[-1], side="right"), len(free) - 1)])
        self.before, self.after = whole[:i], int(paths.dst[self.edge])
        return True

    def found(self) -> list[tuple[np.ndarray, float, float]]:
        bound = -self.waiting[0][0] if self.waiting else None
        done = []
        for edges, logp in self.out:
            x = None if bound is None else logp - bound
            done.append((edges, logp, 0.0 if x is None else float(x if x < -30 else np.log(-np.expm1(-np.exp(min(x, 30.0)))))))
        return done


def top_k(paths: Paths, texts: list[np.ndarray], seeds: list[int], k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text (its chunks' numbers): (edges, log chance, log inclusion) of the k segmentations of largest perturbed log chance, largest first.

    The texts' paths are drawn together, turn by turn.
    """
    all_ = [Search(c, s, k) for c, s in zip(texts, seeds, strict=True)]
    live, turn = all_, 0
    while live:
        if turn:
            starts = np.array([s.after for s in live], np.int64)
            own = np.flatnonzero(starts >= 0)
            seeds_ = np.array([s.seed for s in live], np.uint64)
            on, on_n = paths.walk(starts[own], salts(seeds_[own], turn, np.full(len(own), 1 << 40)))
            more = np.zeros(len(live), np.int64)
            more[own] = on_n
            on_at = np.cumsum(more) - more
        tails = [s.chunks[s.chunk + bool(turn) :] for s in live]
        n = np.array([len(t) for t in tails])
        at = np.cumsum(n) - n
        row = np.repeat(np.arange(len(live)), n)
        edges, per = paths.draw(np.concatenate(tails), salts(np.array([s.seed for s in live], np.uint64)[row], turn, np.arange(len(row)) - at[row]))
        upto = np.r_[0, np.cumsum(per)]
        still = []
        for i, s in enumerate(live):
            lo, hi = int(at[i]), int(at[i] + n[i])
            e, c = edges[upto[lo] : upto[hi]], per[lo:hi]
            if turn:
                mid = on[on_at[i] : on_at[i] + more[i]]
                e, c = np.concatenate([[s.edge], mid, e]).astype(np.int64), np.concatenate([[1 + len(mid)], c])
            if s.settle(paths, e, c):
                still.append(s)
        live, turn = still, turn + 1
    return [s.found() for s in all_]


def to_ids(paths: Paths, edges: np.ndarray) -> np.ndarray:
    """Piece ids of edges; characters without a piece become their bytes' ids."""
    ids = paths.piece[edges]
    if len(ids) and ids.min() < 0:
        v, out = paths.v, []
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
            else:
                c = chr(-2 - i)
                out += [v.byte_id[x] for x in (SPACE if c == _STAND_IN else c).encode("utf-8", "surrogatepass")]
        ids = np.array(out)
    return ids.astype(np.int32)


def seed(doc_id, text: str, base: int) -> int:
    return xxhash.xxh64_intdigest(f"{base}:{doc_id}" if doc_id is not None else f"{base}:text:{text}".encode("utf-8", "surrogatepass"))


def encode(docs: DataFrame, k: int = K, sharpness: float = SHARPNESS, base_seed: int = 13, vocab: str = VOCAB, keep: list[str] | None = None) -> DataFrame:
    """A row per document and sampled segmentation: doc_id, sample (1 to k), n_pieces, log_prob, log_inclusion, pieces and is_exact (its decoding is the text)."""
    box = Box(docs.sparkSession, vocab)

    def make():
        paths = Paths(box.vocabulary(sharpness))
        v = paths.v

        def fn(b):
            ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            chunks = [split(escaped(t)) for t in texts]
            at = paths.numbers([c for x in chunks for c in x])
            rows, flat = [], []
            own = np.split(at, np.cumsum([len(x) for x in chunks])[:-1])
            found = top_k(paths, own, [seed(i, t, base_seed) for i, t in zip(ids, texts, strict=True)], k)
            for doc_id, text, x, got in zip(ids, texts, own, found, strict=True):
                z = float(paths.z[x].sum())
                for i, (edges, logp, logi) in enumerate(got):
                    pieces = to_ids(paths, edges)
                    flat.append(pieces)
                    rows.append((doc_id, i + 1, len(pieces), logp, logi, decode(pieces, v) == text, logp + z))
            offsets = np.r_[0, np.cumsum([len(x) for x in flat])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32()))
            names = ("doc_id", "sample", "n_pieces", "log_prob", "log_inclusion", "is_exact", "log_weight")
            return {n: [r[i] for r in rows] for i, n in enumerate(names)} | {"pieces": lists}

        return fn

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(own, make, "doc_id long, sample int, n_pieces int, log_prob double, log_inclusion double, log_weight double, pieces array<int>, is_exact boolean", 128, SLICE_BYTES)


def decoded(samples: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """doc_id, sample and text of encode()'s rows."""
    box = Box(samples.sparkSession, vocab)

    def make():
        v = box.vocabulary()

        def fn(b):
            return {"doc_id": b.column("doc_id"), "sample": b.column("sample"), "text": [decode(np.array(x or [], np.int64), v) for x in b.column("pieces").to_pylist()]}

        return fn

    return map_slices(samples.select("doc_id", "sample", "pieces"), make, "doc_id long, sample int, text string", 64)
