"""Quality rules from tokeniser fertility.

A public vocabulary's tokens of a whole text give characters per token, the share of byte-fallback tokens and the
entropy of the tokens (over its maximum for as many tokens). For every language, or script where the language is
null, the quartiles over all documents set the rejection bands; a document outside a band is rejected. Plain counts of
words, symbols, repeated lines and repeated word windows stand beside them.

Edge cases: a null text has no words and no tokens, and fails the base rule; repeated rows are measured each; a group
of few documents has bands like any other; columns beyond doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_slices, written
from .lattice import SPACE, VOCAB, Known, gather

#: Chunks held per worker.
HELD = 250_000
#: A band reaches so many quartile distances beyond the quartiles, and at least so far (of the measure) beyond them.
REACH = 4.0
SLACK = {"chars_per_token": 0.06, "byte_share": 0.05, "entropy": 0.08}
#: Over the square root of a document's tokens, what its measures may stray further: short texts measure less exactly.
NOISE = {"chars_per_token": 2.0, "byte_share": 0.5, "entropy": 0.5}
_CHUNKS = re.compile(r" *(?:\n|[^ \n]+)| +")


class Encoder:
    """Token numbers of whole texts. Pieces join spaces only to what follows and never a line end, so each chunk (spaces and the run after them) is encoded once and remembered."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self._clear()

    def _clear(self):
        self.known = Known()
        self.start, self.count, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def _room(self, name, need):
        if len(a := getattr(self, name)) < need:
            setattr(self, name, np.concatenate([a, np.zeros(max(need, 2 * len(a)) - len(a), a.dtype)]))

    def _learn(self):
        new = self.known.new
        # a leading space is what the encoder itself puts before a text; after a line end there is none
        got = self.sp.encode([c[1:] if c[0] == " " else "\n" + c for c in new], num_threads=1)
        got = [g if c[0] == " " else g[2:] for c, g in zip(new, got, strict=True)]
        n = np.array([len(g) for g in got], np.int64)
        at, total = len(self.known) - len(new), int(n.sum())
        self._room("start", len(self.known))
        self._room("count", len(self.known))
        self._room("ids", self.used + total)
        self.start[at : at + len(new)] = self.used + np.cumsum(n) - n
        self.count[at : at + len(new)] = n
        self.ids[self.used : self.used + total] = np.fromiter((i for g in got for i in g), np.int32, total)
        self.used += total
        new.clear()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens, one text after the other, and how many each text has."""
        if len(self.known) > HELD:
            self._clear()
        chunks = [_CHUNKS.findall(" " + t) if t and SPACE not in t else [] for t in texts]
        at = self.known.numbers([c for x in chunks for c in x])
        if self.known.new:
            self._learn()
        n = self.count[at]
        ids = self.ids[gather(self.start[at], n)]
        per = np.add.reduceat(np.r_[n, 0], np.minimum(np.cumsum(lens := np.array([len(x) for x in chunks])) - lens, len(n))) * (lens > 0) if len(texts) else np.zeros(0, np.int64)
        odd = [i for i, t in enumerate(texts) if SPACE in t]
        if odd:  # the mark for spaces itself: as a whole
            parts = np.split(ids, np.cumsum(per)[:-1])
            for i in odd:
                parts[i] = np.array(self.sp.encode(texts[i]), np.int32)
            ids, per = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, per


def script(text: str) -> str:
    """The script of most letters among the text's distinct characters by their Unicode names; the first in alphabetical order on a tie."""
    seen: dict[str, int] = {}
    for c in set(text):
        if c.isalpha():
            k = unicodedata.name(c, "?").partition(" ")[0]
            seen[k] = seen.get(k, 0) + 1
    return max(sorted(seen), key=seen.get, default="none").lower()


def repeated_words(words: list, width: int = 5) -> int:
    """Words inside windows of so many words that are found twice or more. Windows are compared by 64-bit hashes."""
    if len(words) <= width:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    k = len(h) - width + 1
    w = np.zeros(k, np.uint64)
    for i in range(width):
        w = (w ^ (w >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + k]
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    twice = np.zeros(k + width, np.int64)
    hit = np.zeros(k, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    np.add.at(twice, at, 1)
    np.add.at(twice, at + width, -1)
    return int((np.cumsum(twice) > 0).sum())


_SYMBOLS = list(b"#*$%&|<>")
_SPACES = [32, 9, 10, 11, 12, 13]


def measured(docs: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """The counts and the tokeniser's measures of every row."""
    with open(vocab, "rb") as f:  # read on the driver; a vocabulary file is of fixed size
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        enc = Encoder(sent.value)

        def fn(b):
            texts = [t or "" for t in b.column("text").to_pylist()]
            langs = b.column("lang").to_pylist()
            ids, per = enc.encode(texts)
            rows, at = [], 0
            for t, lang, n in zip(texts, langs, per.tolist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
                bins = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                own = ids[at : at + n]
                at += n
                c = np.bincount(own) if n else np.zeros(1)
                c = c[c > 0]
                p = c / max(1, n)
                rows.append((
                    len(words), len(t) - int(bins[_SPACES].sum()), int(bins[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(words),
                    n, len(t) / n if n else 0.0, float(enc.is_byte[own].mean() if n else 0) - (raw.count(b"\n") / n if n else 0), float(-(p * np.log2(p)).sum() / np.log2(n)) if n > 1 else 1.0, lang if lang is not None else f"script:{script(t)}",
                ))
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token", "byte_share", "entropy", "band")
            return {"doc_id": b.column("doc_id")} | {k: [r[i] for r in rows] for i, k in enumerate(names)}

        return fn

    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double, band string"
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), make, kinds)


def bands(found: DataFrame, reach: float = REACH) -> DataFrame:
    """Per band, the least and the largest of each measure that are kept: from the quartiles over all documents that pass the base rule."""
    q = found.where("not base_failed").groupBy("band").agg(*[F.percentile_approx(k, F.array(F.lit(0.25), F.lit(0.75)), 2000).alias(k) for k in SLACK])
    least = lambda k: F.col(k)[0] - F.greatest(reach * (F.col(k)[1] - F.col(k)[0]), F.abs(F.col(k)[0]) * SLACK[k])
    most = lambda k: F.col(k)[1] + F.greatest(reach * (F.col(k)[1] - F.col(k)[0]), F.lit(SLACK[k]) if k == "byte_share" else F.abs(F.col(k)[1]) * SLACK[k])
    return q.select("band", *[x for k in SLACK for x in (least(k).alias(f"{k}_least"), most(k).alias(f"{k}_most"))])


def rules(docs: DataFrame, vocab: str = VOCAB, reach: float = REACH) -> DataFrame:
    """Every row's counts, measures and verdict."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = written(measured(docs, vocab).withColumn("base_failed", failed))
    own = {r.band: r for r in bands(found, reach).collect()}  # a row per language or script
    inside = F.lit(True)
    if own:
        for k in SLACK:
            for side, ok in (("least", lambda x, y: x >= y), ("most", lambda x, y: x <= y)):
                limit = F.create_map(*[F.lit(x) for b, r in own.items() for x in (b, float(r[f"{k}_{side}"]))])[F.col("band")]
                stray = F.lit(NOISE[k] * (1 if side == "most" else -1)) / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)))
                inside &= limit.isNull() | ok(F.col(k), limit + stray)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "n_tokens", "chars_per_token", "byte_share", "entropy", "band")
