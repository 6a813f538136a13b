"""Similarity join on word shingles by vertical partitioning.

The shingles of all documents have one global order: rare ones by hash, then the frequent ones by frequency. A document
whose set has n shingles shares one of its first n - ceil(t n) + 1 with every document it links to (t: the least
Jaccard similarity), so candidates come from these prefixes. The order is cut into fragments; a candidate pair's
overlap is counted in each fragment apart, and the counts are summed per pair.

Documents of equal sets are one node. A set of many near copies is not expanded into its pairs: each node is first
checked against one node per shared prefix shingle, the links found join components, and pairs are then made only
between different components. No link between components is lost, so the components are exact. Shingles and sets are
named by 64-bit hashes.

Each node has a sketch: bit i tells whether the number of its shingles that hash to i is odd. Two sketches differ in no
more bits than the sets have shingles apart, so pairs whose sketches differ in more than a link allows are no links and
are never made.

All links lie within components. There every two sets are compared, by blocks of sets: each set goes to as many tasks
as its component has blocks, and a task gives the links of two blocks, or for each set how many rows it links to.

Edge cases: a null text or one without words has an empty set, is linked with nothing and is its own component;
repeated rows (same id) stay rows of one component; a null id never names a component unless all its ids are null;
very long texts are sets like any other; columns beyond doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .frames import arrow_schema, cut, discard, heaviest, map_slices, written

WIDTH = 4
#: Two documents link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Frequent shingles that are ordered by frequency, at most (what is sent to executors is bounded by this), and those a
#: task may name.
FREQUENT = 1 << 19
NAMED = 50_000
FRAGMENTS = 4
#: Sets that a task remembers, so as not to give them again.
SEEN = 200_000
BLOOM_BITS = 26
#: Rows of a shingle that one task takes, about, where they are put in order.
SALT_ROWS = 20_000
#: Sets and shingles in a block, about, and shingles compared at once.
BLOCK, BLOCK_TOKENS, AT_ONCE = 512, 1_000_000, 4096
#: The words of a sketch.
SKETCH = ["s0", "s1", "s2", "s3"]
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * _C1 + w[i : i + len(h)]
    return np.unique((h ^ (h >> np.uint64(31))) * _C2)


def _node(tokens: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None


def _sketch(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount((tokens * _C1 >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def surveyed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, node and sketch of every row; and rows of token and cnt: shingles frequent within a task."""

    def make():
        seen: set = set()
        held: list[np.ndarray] = []

        def counts():
            x = np.concatenate([np.zeros(0, np.uint64), *held])
            held.clear()
            x.sort()
            # where a run of three or more begins
            first = np.flatnonzero(x[2:] == x[:-2]) if len(x) > 2 else np.zeros(0, int)
            first = first[np.r_[True, x[first[1:]] != x[first[:-1]]][: len(first)]]
            tokens, n = x[first], np.searchsorted(x, x[first], side="right") - first
            keep = np.argsort(-n, kind="stable")[:NAMED]
            return tokens[keep].view(np.int64), n[keep]

        class Survey:
            size = 0

            def __call__(self, b):
                sets = [shingles(t, width) for t in b.column("text").to_pylist()]
                nodes = [_node(s) for s in sets]
                for s, x in zip(sets, nodes, strict=True):
                    if x is not None and x not in seen:
                        seen.add(x)
                        held.append(s)
                        self.size += len(s)
                more = counts() if self.size > 4_000_000 else ((), ())
                if len(more[0]) or not held:
                    self.size = 0
                    if len(seen) > SEEN:
                        seen.clear()
                k = len(more[0])
                sketches = np.concatenate([np.array([_sketch(s) for s in sets]).reshape(-1, 4), np.zeros((k, 4), np.int64)])
                own = {"doc_id": b.column("doc_id").to_pylist() + [None] * k, "n": [len(s) for s in sets] + [0] * k, "node": nodes + [None] * k, "token": [None] * len(sets) + list(more[0]), "cnt": [0] * len(sets) + list(more[1])}
                return own | {c: sketches[:, i] for i, c in enumerate(SKETCH)}

            def end(self):
                tokens, n = counts()
                k = len(tokens)
                return {"doc_id": [None] * k, "n": [0] * k, "node": [None] * k, "token": tokens, "cnt": n} | {c: np.zeros(k, np.int64) for c in SKETCH} if k else None

        return Survey()

    return map_slices(docs, make, "doc_id long, n long, node long, token long, cnt long, " + ", ".join(f"{c} long" for c in SKETCH), 64)


def _order(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """What rank tells of each frequent token (its place: 1 and up, rarest first), 0 for all others."""
    at = np.minimum(np.searchsorted(frequent, tokens), max(0, len(frequent) - 1))
    return np.where(frequent[at] == tokens, rank[at], 0) if len(frequent) else np.zeros(len(tokens), np.int64)


def prefixes(docs: DataFrame, sent, width: int, percent: int) -> DataFrame:
    """token, node, n, pos, its place, and salts, by how many tasks its rows are put in order: the first shingles in the global order of each set; a task names a set once."""

    def make():
        frequent, rank, salts = sent.value
        seen: set = set()

        def fn(b):
            tokens, nodes, ns, places, many = [], [], [], [], []
            if len(seen) > SEEN:
                seen.clear()
            for t in b.column("text").to_pylist():
                s = shingles(t, width)
                x = _node(s)
                if x is None or x in seen:
                    continue
                seen.add(x)
                k = len(s) - -(-percent * len(s) // 100) + 1
                place = _order(s, frequent, rank)
                tokens.append(s[np.lexsort((s, place))[:k]])
                many.append(np.maximum(1, _order(tokens[-1], frequent, salts)))
                nodes.append(np.full(k, x))
                ns.append(np.full(k, len(s)))
                places.append(np.arange(k))
            return {"token": np.concatenate(tokens).view(np.int64), "node": np.concatenate(nodes), "n": np.concatenate(ns), "pos": np.concatenate(places), "salts": np.concatenate(many)} if tokens else None

        return fn

    return map_slices(docs, make, "token long, node long, n int, pos int, salts int", 64)


def _bits(x: np.ndarray, bits: int) -> list[np.ndarray]:
    h = x.astype(np.int64).view(np.uint64)
    return [((h ^ (h >> np.uint64(s))) * c >> np.uint64(64 - bits)).astype(np.int64) for s, c in ((31, _C1), (29, _C2), (33, np.uint64(0x94D049BB133111EB)))]


def bloom(nodes: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter over a column `node`, of fixed size."""

    def make():
        def fn(b):
            at = np.unique(np.concatenate(_bits(b.column("node").to_numpy(zero_copy_only=False), bits)))
            word, first = np.unique(at >> 6, return_index=True)
            return {"word": word, "mask": np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first).view(np.int64)}

        return fn

    got = map_slices(nodes, make, "word int, mask long", 10_000).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return out


def fragments(docs: DataFrame, sent, width: int, count: int = FRAGMENTS, bits: int = BLOOM_BITS) -> DataFrame:
    """node, part and tokens: sets cut by the global order; part 0 holds the frequent shingles.

    Only nodes in the one filter come, and of each only rows whose id is in the other, which holds one id per node. A
    filter's false hits, and rows without an id, may give a node's set again; it is the same set.
    """

    def make():
        (frequent, rank, _), nodes_held, ids_held = sent.value
        seen: set = set()
        pivots = (np.arange(1, count, dtype=np.uint64) * np.uint64((1 << 64) // count)).astype(np.uint64)

        def within(x, held):
            hit = np.ones(len(x), bool)
            for p in _bits(x, bits):
                hit &= (held[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            return hit

        def fn(b):
            nodes, parts, sets = [], [], []
            if len(seen) > SEEN:
                seen.clear()
            ids = b.column("doc_id")
            wanted = within(ids.fill_null(0).to_numpy(zero_copy_only=False), ids_held) | ids.is_null().to_numpy(zero_copy_only=False)
            for t, want in zip(b.column("text").to_pylist(), wanted.tolist(), strict=True):
                if not want:
                    continue
                s = shingles(t, width)
                x = _node(s)
                if x is None or x in seen or not within(np.array([x]), nodes_held)[0]:
                    continue
                seen.add(x)
                often = _order(s, frequent, rank) > 0
                rare = s[~often]
                for i, part in enumerate([s[often], *np.split(rare, np.searchsorted(rare, pivots))]):
                    if len(part):
                        nodes.append(x)
                        parts.append(i)
                        sets.append(part.view(np.int64))
            if not nodes:
                return None
            offsets = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
            return {"node": nodes, "part": parts, "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))}

        return fn

    return map_slices(docs, make, "node long, part int, tokens array<long>", 64)


def _close(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return percent * F.greatest(n, m) <= 100 * F.least(n, m)


def _needed(na: str, nb: str, percent: int) -> Column:
    """The least overlap of sets of these sizes that links them."""
    return F.ceil(percent * (F.col(na) + F.col(nb)) / F.lit(100.0 + percent) - F.lit(1e-9))


def _prefix(n: Column, percent: int) -> Column:
    return n - F.ceil(percent * n / F.lit(100.0) - F.lit(1e-9)) + 1


def _apart(na: str, nb: str, percent: int, ours: str = "", theirs: str = "_") -> Column:
    """Whether the sketches of two sets leave room for a link; their words' names end as told."""
    bits = sum((F.bit_count(F.col(c + ours).bitwiseXOR(F.col(c + theirs))) for c in SKETCH[1:]), F.bit_count(F.col(SKETCH[0] + ours).bitwiseXOR(F.col(SKETCH[0] + theirs))))
    return bits <= F.col(na) + F.col(nb) - 2 * _needed(na, nb, percent)


def alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches leave room for a link."""
    for k in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(k), *[F.col(c).alias(c + k) for c in SKETCH]), k)
    return pairs.where(_apart("na", "nb", percent, "a", "b")).select("a", "b", "na", "nb")


def plausible(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs whose overlap may be large enough by what their prefixes share.

    heads: node and its prefix shingles that others have too. Where the prefix of one set ends first in the order, all
    that both share up to there is in both prefixes, so the overlap is at most that plus the rest of this set.
    """
    left, right = (heads.select(F.col("node").alias(k), F.col("tokens").alias(f"t{k}")) for k in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    rest = F.greatest(F.col("na") - _prefix(F.col("na"), percent), F.col("nb") - _prefix(F.col("nb"), percent))
    return both.where(F.size(F.array_intersect("ta", "tb")) + rest >= _needed("na", "nb", percent)).select("a", "b", "na", "nb")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, count: int = FRAGMENTS) -> DataFrame:
    """The pairs (a, b, na, nb) that link: overlaps counted per fragment and summed per pair."""
    own = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(count))))
    left, right = (sets.select(F.col("node").alias(k), "part", F.col("tokens").alias(f"t{k}")) for k in ("a", "b"))
    parts = own.join(left, ["a", "part"]).join(right, ["b", "part"]).select("a", "b", "na", "nb", "part", F.size(F.array_intersect("ta", "tb")).alias("n"))
    # a set may be there more than once: its counts are equal
    shared = parts.groupBy("a", "b", "na", "nb", "part").agg(F.max("n").alias("n")).groupBy("a", "b", "na", "nb").agg(F.sum("n").alias("shared"))
    return shared.where(F.col("shared") >= _needed("na", "nb", percent)).select("a", "b")


def _pair(node: str, n: str, other: str, m: str) -> list[Column]:
    first = F.col(node) < F.col(other)
    return [F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in ((node, other, "a"), (other, node, "b"), (n, m, "na"), (m, n, "nb"))]


class Search:
    """What the search for components leaves: own (doc_id, text), members (doc_id, n, node), leaders (node, doc_id), found (node, root), the order and the width."""

    def __init__(self, **what):
        self.__dict__.update(what)


def searched(docs: DataFrame, width: int, percent: int) -> Search:
    sc = docs.sparkSession.sparkContext
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey = written(surveyed(own, width))
    members = survey.where("token is null").select("doc_id", "n", "node")
    nodes = cut(survey.where("node is not null").groupBy("node").agg(*[F.first(c).alias(c) for c in SKETCH]))
    top = heaviest(survey.where("token is not null").groupBy("token").agg(F.sum("cnt").alias("cnt")), "cnt", FREQUENT).toArrow()
    frequent, cnt = top.column("token").to_numpy().view(np.uint64), top.column("cnt").to_numpy()
    by_count = np.lexsort((frequent, cnt))
    frequent, cnt = frequent[by_count], cnt[by_count]
    at = np.argsort(frequent)
    order = frequent[at], (at + 1).astype(np.int32), 1 + cnt[at] // SALT_ROWS
    sent = sc.broadcast(order)

    # shared prefix shingles: rows whose shingle another set has too; a frequent one's rows are spread by salt
    salt = F.pmod(F.xxhash64("node", F.lit(7)), F.col("salts")).alias("salt")
    by = Window.partitionBy("token", "salt").orderBy("n", "node")
    rows = prefixes(own.select("text"), sent, width, percent).select("*", salt).repartition("token", "salt")
    rows = rows.groupBy("token", "salt", "node", "n").agg(F.min("pos").alias("pos"), F.max("salts").alias("salts"))
    rows = rows.withColumns({"before": F.lag("node").over(by), "bn": F.lag("n").over(by), "after": F.lead("node").over(by)})
    shared = written(rows.where("before is not null or after is not null or salts > 1").drop("after", "salt", "salts"))
    heads = cut(shared.groupBy("node").agg(F.collect_list("token").alias("tokens")))  # a prefix at most
    leaders = members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def checked(pairs: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Links and components with the links among these pairs."""
        pairs = cut(plausible(pairs, heads, percent))
        ends = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(leaders, "node"))
        filters = bloom(ends.select("node")), bloom(ends.select(F.coalesce("doc_id", F.lit(0)).alias("node")))
        sets = written(fragments(own, sc.broadcast((order, *filters)), width))
        new = verified(pairs, sets, percent)
        links = cut(new if links is None else links.union(new).distinct())
        discard(sets)
        return links, components(links)

    # one check per node at first: against the set it meets most often as the hub of a shingle, or next to it. A
    # shingle's hub is the set whose prefix is shared most, such as the text that all near copies of a group come from
    share = heads.select("node", F.size("tokens").alias("k"))
    rank = F.struct(F.col("k") / _prefix(F.col("n"), percent), -F.col("n"), "node")
    hubs = shared.join(share, "node").groupBy("token").agg(F.max_by(F.struct("node", "n"), rank).alias("hub"))
    hubs = shared.join(hubs.select("token", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hn")), "token")
    near = lambda df, to, n: df.where(F.col(to).isNotNull() & (F.col(to) != F.col("node")) & _close(F.col("n"), F.col(n), percent)).select("node", "n", F.col(to).alias("to"), F.col(n).alias("m"))
    links, found = checked(alike(_best(near(hubs, "hub", "hn").union(near(shared, "before", "bn"))), nodes, percent), None)
    mixed = _mixed(shared.select("token", "node", "n", "pos"), nodes.join(found, "node", "left"))
    if mixed is not None:
        # every pair between different components that shares a prefix shingle: of a shingle's rows, those outside its
        # largest component against all of it
        rest = mixed.where("comp <> main").select("token", "node", "n", "pos", "comp", *SKETCH)
        all_ = mixed.select("token", F.col("node").alias("to"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("comp").alias("other"), *[F.col(c).alias(c + "_") for c in SKETCH])
        # at the first shingle that a pair shares, all of its overlap is still to come
        least = _needed("n", "m", percent)
        ahead = (F.col("n") - F.col("pos") >= least) & (F.col("m") - F.col("at") >= least)
        pairs = rest.join(all_, "token").where((F.col("comp") != F.col("other")) & _close(F.col("n"), F.col("m"), percent) & ahead & _apart("n", "m", percent)).select(*_pair("node", "n", "to", "m")).distinct()
        links, found = checked(pairs, links)
    return Search(own=own, members=members, leaders=leaders, found=found, order=order, width=width, percent=percent)


def grouped(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return _grouped(searched(docs, width, percent)).drop("node")


def _grouped(s: Search) -> DataFrame:
    placed = cut(s.members.join(s.found, "node", "left").select("doc_id", "n", "node", F.coalesce("root", "node").alias("comp")))
    least = cut(placed.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")))
    return placed.join(least, "comp", "left").select("node", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def linked(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links, the number of other rows that it links to, of every row."""
    s = searched(docs, width, percent)
    equal = s.members.where("node is not null").groupBy("node").agg(F.count("*").alias("rows"))
    others = compared(s, False).groupBy("node").agg(F.sum("k").alias("k"))
    n = cut(equal.join(others, "node", "left").select("node", (F.col("rows") - 1 + F.coalesce("k", F.lit(0))).alias("n_links")))
    return _grouped(s).join(n, "node", "left").select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links between different sets: a, b, shared and union, a < b; and the rows of each set: doc_id and node. Rows of one set link too."""
    s = searched(docs, width, percent)
    return compared(s, True), s.members.select("doc_id", "node")


def compared(s: Search, pairs: bool) -> DataFrame:
    """Every two different sets of a component compared: the links a, b, shared and union, or k rows that node links to (a row per block met)."""
    schema = "a long, b long, shared long, union long" if pairs else "node long, k long"
    to, percent = arrow_schema(schema), s.percent
    rows = s.members.where("node is not null").groupBy("node", "n").agg(F.count("*").alias("rows"))
    placed = rows.join(s.found, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    sizes = placed.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"), F.count("*").alias("size")).where("size > 1").drop("size")
    placed = cut(placed.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    ends = cut(placed.select("node").join(s.leaders, "node"))
    filters = bloom(ends.select("node")), bloom(ends.select(F.coalesce("doc_id", F.lit(0)).alias("node")))
    sent = s.own.sparkSession.sparkContext.broadcast((s.order, *filters))
    sets = fragments(s.own, sent, s.width).groupBy("node", "part").agg(F.first("tokens").alias("tokens")).groupBy("node").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    met = placed.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("comp", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "n", "rows", "tokens")

    def block(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node, n, weight, at = (t.column(c).to_numpy() for c in ("node", "n", "rows", "block"))
        tokens = t.column("tokens").combine_chunks()
        _, place, often = np.unique(tokens.flatten().to_numpy(), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(node)), np.diff(tokens.offsets.to_numpy()))
        # only shingles of several sets are shared
        column = np.cumsum(often > 1) - 1
        keep = often[place] > 1
        owner, place = owner[keep], column[place[keep]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        shared = np.zeros((len(node), len(node)), np.int64)
        for low in range(0, int(place[-1]) + 1 if len(place) else 0, AT_ONCE):
            i, j = np.searchsorted(place, (low, low + AT_ONCE))
            x = np.zeros((len(node), AT_ONCE), np.float32)
            x[owner[i:j], place[i:j] - low] = 1
            shared += np.rint(x @ x.T).astype(np.int64)
        union = n[:, None] + n[None, :] - shared
        link = 100 * shared >= percent * union
        np.fill_diagonal(link, False)
        if t.column("one")[0] != t.column("two")[0]:
            link &= at[:, None] != at[None, :]
        if pairs:
            i, j = np.nonzero(link & (node[:, None] < node[None, :]))
            got = node[i], node[j], shared[i, j], union[i, j]
        else:
            got = node, link @ weight
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(got, to)], schema=to)

    return met.groupBy("comp", "one", "two").applyInArrow(block, schema)


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that of the least id, with docs' columns; rows of one id and rows without an id and of one text count as repeated."""
    # a row without an id is named by its text, beyond all usual ids
    nameless = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(1 << 61))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), nameless).alias("_key"), row)
    stay = grouped(own.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text")), width, percent).where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    return own.join(cut(stay), "_key", "left_semi").dropDuplicates(["_key"]).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def _best(near: DataFrame) -> DataFrame:
    """One pair for each node of near (node, n, to, m): with the other node that stands there most often."""
    votes = near.groupBy("node", "n", "to", "m").agg(F.count("*").alias("k"))
    best = votes.groupBy("node", "n").agg(F.max_by(F.struct("to", "m"), F.struct("k", "to")).alias("x")).select("node", "n", "x.to", "x.m")
    return best.select(*_pair("node", "n", "to", "m")).distinct()


def _mixed(shared: DataFrame, placed: DataFrame) -> DataFrame | None:
    """Rows of shingles that stand in several components, with their nodes' sketch, comp, and main, the shingle's largest component; None without any.

    placed: each node with its sketch, and its component's root, if it has links.
    """
    rows = shared.join(placed.select("node", *SKETCH, F.coalesce("root", "node").alias("comp")), "node")
    each = rows.groupBy("token", "comp").agg(F.count("*").alias("k"))
    main = cut(each.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("c")).where("c > 1").select("token", "main"))
    if main.isEmpty():
        return None
    return cut(rows.join(main, "token"))
