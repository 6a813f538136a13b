"""Language-model scoring by cross-entropy difference.

A bigram model of a target table and one of the whole background table share one vocabulary: all words of both, and one
unknown word. Both are counted over all rows, each word and each bigram apart, and smoothed by the unigrams; background
counts are scaled to the target's size, so that the models match. A document's score is the mean over its tokens of the
target model's loss minus the background model's: the lower, the more like the target.

The counts grow with the corpus and are held nowhere whole. Each task counts the names of its chunks of documents; the
counts are summed by ranges of names, and every chunk is answered with the sums of its own names. Words and bigrams are
named by 64-bit hashes.

Edge cases: a null or empty text has no tokens and null scores; repeated rows are counted and scored each; an empty
target leaves the target model uniform over the vocabulary; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrow_schema, map_slices, texts, written
from .lattice import Known

#: Tokens and documents of a chunk, about: these bound a task's memory.
CHUNK, CHUNK_DOCS = 1_500_000, 100_000
#: Characters of text to a range of names, about.
RANGE_CHARS = 8_000_000
#: Weight of the unigrams in a bigram's chance, in tokens.
BACK_OFF = 4.0
#: What stands before a text's first word: the name of the empty word, which no text has.
START = np.uint64(xxhash.xxh3_64_intdigest(b""))
#: A chunk's texts: its words' names, and its tokens as places among them.
_CHUNK = "chunk long, aim boolean, n long, n_names long, names binary, ids array<long>, lens array<int>, places binary"
#: A chunk's names and counts by range (part), with pairs for bigrams.
_NAMES = "chunk long, part long, aim boolean, pairs boolean, n long, names binary, counts binary"
_ANSWER = "chunk long, part long, pairs boolean, n long, n_words long, own binary, aimed binary"
_SCORE = "doc_id long, n_tokens long, ce_target double, ce_background double, score double"
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def tokens(text: str) -> list[str]:
    return text.lower().split()


def _before(at: np.ndarray, lens: np.ndarray, start: int) -> np.ndarray:
    """The place before each; start before the first of each text."""
    before = np.r_[start, at[:-1]] if len(at) else at
    before[(np.cumsum(lens) - lens)[lens > 0]] = start
    return before


def _bigrams(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (before ^ (before >> np.uint64(29))) * _C1 + word
    h = (h ^ (h >> np.uint64(31))) * _C2
    return h ^ (h >> np.uint64(30))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, of which most are zero, compressed."""
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def _steps(names: np.ndarray) -> np.ndarray:
    """Sorted names as differences; np.cumsum takes them back."""
    return np.diff(names, prepend=np.uint64(0))


def chunked(df: DataFrame, aim: bool) -> DataFrame:
    """The chunks of df (doc_id, text), as _CHUNK tells."""

    def make():
        known, held, ids, lens = Known(), [], [], []

        class Chunks:
            size = chunks = 0

            def __call__(self, b):
                words = [tokens(t) for t in texts(b)]
                held.append(known.numbers(list(chain.from_iterable(words))).astype(np.int32))
                lens.extend(map(len, words))
                ids.extend(b.column("doc_id").to_pylist())
                self.size += len(held[-1])
                return self.end() if self.size >= CHUNK or len(lens) >= CHUNK_DOCS else None

            def end(self):
                if not lens:
                    return None
                own = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in known), np.uint64, len(known))
                names, place = np.unique(np.r_[own, START], return_inverse=True)
                at = place[np.concatenate(held)]
                out = {"chunk": TaskContext.get().partitionId() << 24 | self.chunks, "aim": aim, "n": len(at), "n_names": len(names), "names": _packed(_steps(names)), "ids": list(ids), "lens": list(lens), "places": _packed(at)}
                known.clear()
                for x in (known.new, held, ids, lens):
                    x.clear()
                self.size, self.chunks = 0, self.chunks + 1
                return {k: [v] for k, v in out.items()}

        return Chunks()

    return map_slices(df, make, _CHUNK)


def _read(chunk: dict) -> tuple[np.ndarray, ...]:
    """Of a chunk: the words' names, tokens, the places before them, and tokens per text."""
    lens, names = np.array(chunk["lens"], np.int64), np.cumsum(_unpacked(chunk["names"], chunk["n_names"]), dtype=np.uint64)
    at = _unpacked(chunk["places"], chunk["n"]).astype(np.int64)
    return names, at, _before(at, lens, int(np.searchsorted(names, START))), lens


def named(chunks: DataFrame, parts: int) -> DataFrame:
    """The names of chunks with their counts, as _NAMES tells."""

    def make():
        def fn(b):
            (chunk,) = b.to_pylist()
            names, at, before, lens = _read(chunk)
            counts = np.bincount(at, minlength=len(names))
            counts[np.searchsorted(names, START)] += np.count_nonzero(lens)
            out = []
            for pairs, (x, k) in ((False, (names, counts)), (True, np.unique(_bigrams(names[before], names[at]), return_counts=True))):
                part = ((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # rises with the name
                ends = np.flatnonzero(np.r_[part[1:] != part[:-1], True][: len(x)]) + 1
                out += [(chunk["chunk"], int(part[i]), chunk["aim"], pairs, j - i, _packed(_steps(x[i:j])), _packed(k[i:j])) for i, j in zip([0, *ends.tolist()], ends.tolist())]
            return dict(zip(("chunk", "part", "aim", "pairs", "n", "names", "counts"), map(list, zip(*out)), strict=True))

        return fn

    return map_slices(chunks, make, _NAMES, 1)


def _summed(t: pa.Table, schema: pa.Schema) -> pa.Table:
    """A range's sums over all chunks, dealt back to the background's chunks; and how many words it has."""
    rows = t.to_pylist()
    out, n_words = [], 0
    for pairs in (False, True):
        own = [r for r in rows if r["pairs"] == pairs]
        if not own:
            continue
        held = [np.cumsum(_unpacked(r["names"], r["n"]), dtype=np.uint64) for r in own]
        counts = np.concatenate([_unpacked(r["counts"], r["n"]) for r in own])
        distinct, at = np.unique(np.concatenate(held), return_inverse=True)
        aim = np.repeat([r["aim"] for r in own], [len(x) for x in held])
        # whole numbers: exact below 2^53
        background, target = (np.bincount(at[x], counts[x], len(distinct)).astype(np.int64) for x in (~aim, aim))
        if not pairs:
            n_words = int(np.count_nonzero(distinct != START))
        end = 0
        for r, x in zip(own, held):
            mine = at[end : end + len(x)]
            end += len(x)
            if not r["aim"]:
                out.append({"chunk": r["chunk"], "part": r["part"], "pairs": pairs, "n": len(x), "own": _packed(background[mine]), "aimed": _packed(target[mine])})
    out.append({"n_words": n_words})
    return pa.Table.from_pylist(out, schema)


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ce_target, ce_background and score of every row of docs, the background."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    aim = target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = 1 + (own.agg(F.sum(F.length("text")).alias("n")).first().n or 0) // RANGE_CHARS
    chunks = written(chunked(own, False).union(chunked(aim, True)))
    answer, to = arrow_schema(_ANSWER), arrow_schema(_SCORE)
    total = {r.aim: r.n for r in chunks.groupBy("aim").agg(F.sum("n").alias("n")).collect()}
    answers = written(named(chunks, parts).groupBy("part").applyInArrow(lambda t: _summed(t, answer), _ANSWER))
    n_own, n_aim = total.get(False) or 0, total.get(True) or 0
    size = 1 + (answers.agg(F.sum("n_words").alias("n")).first().n or 0)  # with the unknown word
    scale = n_aim / n_own if n_own and n_aim else 1.0

    def scored(t: pa.Table) -> pa.Table:
        text, *rows = sorted(t.to_pylist(), key=lambda r: r["part"])
        names, at, before, lens = _read(text)
        pairs, where = np.unique(_bigrams(names[before], names[at]), return_inverse=True)
        full, none = np.flatnonzero(lens), (lens == 0).tolist()
        out = []
        for col, by, n in (("aimed", 1.0, n_aim), ("own", scale, n_own)):
            uni, bi = (np.concatenate([np.zeros(0), *[_unpacked(r[col], r["n"]) for r in rows if r["pairs"] == k]]) * by for k in (False, True))
            one = (uni + 0.5) / (n * by + 0.5 * size)
            loss = -np.log((bi[where] + BACK_OFF * one[at]) / (uni[before] + BACK_OFF))
            x = np.zeros(len(lens))
            if len(full):
                x[full] = np.add.reduceat(loss, (np.cumsum(lens) - lens)[full]) / lens[full]
            out.append(x)
        put = lambda x: [None if e else v for e, v in zip(none, x.tolist(), strict=True)]
        got = text["ids"], lens, put(out[0]), put(out[1]), put(out[0] - out[1])
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(got, to)], schema=to)

    asked = chunks.where("not aim").drop("aim").withColumn("part", F.lit(-1).cast("long"))
    return asked.unionByName(answers.where("chunk is not null").drop("n_words"), allowMissingColumns=True).groupBy("chunk").applyInArrow(scored, _SCORE)
