"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary, learnt by expectation maximisation over
the lattices of its training words. A text is lower-cased and its letter runs are scored by the forward algorithm,
which sums over all segmentations; the language of the largest sum wins, the first in alphabetical order on a tie.

Edge cases: a null text or one without a letter is `und` with score 0; a null id falls into fold 0 with an empty id
text; repeated rows are scored each; without training rows every text is `und`; columns beyond doc_id, text and lang
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .frames import cut, fold, id_text, map_slices, texts
from .lattice import SPACE, VOCAB, Box, Known, Lattice, runs

UND = "und"
#: Documents that a language is learnt from, about: those of least hash. 30,000 piece counts need no more.
TRAIN_DOCS = 2000
ROUNDS = 2
#: Weight of the vocabulary's prior, in pieces.
PRIOR = 2000.0
#: Numbers held per worker for words seen before.
HELD = 800_000
_RUNS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Letter runs of the lower-cased text; none if it has no letter."""
    found = _RUNS.findall(text.lower())
    return found if any(any(map(str.isalpha, w)) for w in found) else []


class Model:
    def __init__(self, langs: list[str], logp: np.ndarray, box: Box):
        self.langs, self.logp, self.box = langs, logp, box


def _train_words(train: DataFrame) -> DataFrame:
    """lang, word and n over the training rows."""

    def make():
        held: Counter = Counter()

        class Counting:
            def __call__(self, b):
                for lang, text in zip(b.column("lang").to_pylist(), texts(b), strict=True):
                    held.update((lang, w) for w in words(text))
                return self.end() if len(held) > 200_000 else None

            def end(self):
                if not held:
                    return None
                out = {"lang": [k[0] for k in held], "word": [k[1] for k in held], "n": list(held.values())}
                held.clear()
                return out

        return Counting()

    return map_slices(train, make, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, folds: int = 3, held: int = 1, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS, vocab: str = VOCAB) -> Model:
    """Learns from text and lang of the rows outside the held-out fold, about train_docs of each language."""
    box = Box(docs.sparkSession, vocab)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    sizes = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    langs = sorted(sizes)
    base = box.vocabulary().logp
    if not langs:
        return Model([], base[:, None][:, :0], box)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, train_docs / sizes[k]))])
    u = F.pmod(F.xxhash64(id_text(F.col("doc_id")), F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = cut(_train_words(own.where(u < share[F.col("lang")]).select("lang", "text")))
    logp = np.repeat(base[:, None], len(langs), 1)
    for _ in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(logp)

        def make(sent=sent):
            v = box.vocabulary()
            k = {lang: i for i, lang in enumerate(langs)}
            total = np.zeros((len(v.logp), len(langs)))

            class Expecting:
                def __call__(self, b):
                    own = np.array([k[x] for x in b.column("lang").to_pylist()])
                    lat = Lattice(v, [SPACE + w for w in b.column("word").to_pylist()])
                    n = np.array(b.column("n").to_pylist(), float)
                    w = sent.value[lat.piece, own[lat.word]]
                    w = np.where(lat.piece < 0, lat.n_bytes * v.byte_logp, w)
                    there, back = lat.forward(w), lat.backward(w)
                    post = np.exp(there[lat.src] + w + back[lat.dst] - there[lat.last][lat.word]) * n[lat.word]
                    real = lat.piece >= 0
                    np.add.at(total, (lat.piece[real], own[lat.word[real]]), post[real])

                def end(self):
                    piece, lang = np.nonzero(total)
                    return {"piece": piece, "lang": lang, "n": total[piece, lang]} if len(piece) else None

            return Expecting()

        got = map_slices(counts, make, "piece int, lang int, n double", 4096).groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()  # a row per piece and language at most
        total = np.zeros(logp.shape)
        total[got.piece, got.lang] = got.n
        with np.errstate(divide="ignore"):
            logp = np.log((total + PRIOR * np.exp(base)[:, None]) / (total.sum(0) + PRIOR))
    return Model(langs, logp, box)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred and score of every row, after the columns named in keep."""
    langs, box = model.langs, model.box
    sent = docs.sparkSession.sparkContext.broadcast(model.logp)
    most = max(20_000, HELD // max(1, len(langs)))
    keep = keep or []

    def make():
        v = box.vocabulary()
        known, table = Known(), np.zeros((0, len(langs)))

        def fn(b):
            nonlocal known, table
            if len(known) > most:
                known, table = Known(), np.zeros((0, len(langs)))
            found = [words(t) if langs else [] for t in texts(b)]
            at = known.numbers([w for x in found for w in x])
            if known.new:
                old = len(known) - len(known.new)
                if len(table) < len(known):
                    table = np.concatenate([table[:old], np.zeros((len(known.new) + len(known) // 4, len(langs)))])
                for i, new in runs([SPACE + w for w in known.new]):
                    lat = Lattice(v, new)
                    table[old + i : old + i + len(new)] = lat.forward(lat.weights(sent.value, v.byte_logp))[lat.last]
                known.new.clear()
            n = np.array([len(x) for x in found])
            pred, score = [UND] * len(n), np.zeros(len(n))
            full = np.flatnonzero(n)
            if len(full):
                ll = np.add.reduceat(table[at], (np.cumsum(n) - n)[full], axis=0)
                best = ll.argmax(1)
                p = np.exp((ll - ll.max(1, keepdims=True)) / np.sqrt(n[full])[:, None])
                score[full] = 1 / p.sum(1)
                for i, j in zip(full.tolist(), best.tolist(), strict=True):
                    pred[i] = langs[j]
            return {c: b.column(c) for c in carried} | {"lang_pred": pred, "score": score}

        return fn

    own = docs.select(*[F.col(c) for c in keep], *[F.col(c) for c in ("doc_id", "text") if c not in keep])
    own = own.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    carried = [c for c in own.columns if c in keep or c == "doc_id"]
    return map_slices(own, make, StructType([*(own.schema[c] for c in carried), StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose language is known with at least this score, with docs' columns."""
    own = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return identify(own, model, ["_row"]).where((F.col("lang_pred") != UND) & (F.col("score") >= least)).select("_row.*")


def predict(docs: DataFrame, folds: int = 3, held: int = 1, vocab: str = VOCAB) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, with a model of the same table."""
    got = identify(docs, fit(docs, folds, held, vocab=vocab))
    return got.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")
