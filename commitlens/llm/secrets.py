"""Secret scans, all in DataFrame functions.

Three plain patterns give the base spans. Beyond them, character Markov models of random strings and of ordinary
identifiers are compared: what base spans leave of a run of token characters is a span of kind markov if its
log-likelihood ratio is high enough, and else those stretches of it are whose ratio is. Both models are bigram tables learnt from labelled samples: random strings made by
hashing, and words and joined words of a bounded sample of documents.

Positions count code points; ends are exclusive. They come from marks put around the matches: lengths between marks
are summed in two levels of blocks, so the work is nearly linear in the number of matches.

Edge cases: a null text counts as empty and has no spans; repeated rows are scanned each; without any document to
learn from, ordinary identifiers are the built-in joined words alone; columns beyond doc_id and text are ignored, and
redacted() carries all columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import id_text

#: The kinds in order, and the base patterns with what follows a failing match dropped.
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = "()(AKIA[A-Z0-9]+)"
HEX = "()([0-9a-f]+)"
RUN = "()([A-Za-z0-9+/_=-]+)"
#: Least characters of the value (access, hex and runs: of the match).
LEAST = {"assign": 8, "access": 16, "hex": 32, "markov": 20}
#: Documents that ordinary identifiers are learnt from, and random strings made: a bigram table has 16,384 cells.
SAMPLE_DOCS = 400
SAMPLE_STRINGS = 4000
#: Phrases that identifiers are joined from besides the corpus's words.
PHRASES = ["get value", "user name", "file path", "max retry count", "is valid", "default config", "http request handler", "parse json", "write output table", "index page", "create session", "load model", "from string", "to bytes", "number of items", "query builder", "application factory", "test case"]
#: Least log-likelihood ratio, in nats, and least of its mean per character.
LLR = 25.0
LLR_PER_CHAR = 1.2
#: How far, in nats, a sum may fall below its best before its stretch is ended.
DROP = 12.0
_BLOCK = 128


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, op) -> Column:
    """op over the elements before each element, by two levels of blocks."""
    block = lambda b: F.aggregate(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)), zero, op)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / _BLOCK).cast("int")), block)
    before = lambda s: F.transform(s, lambda _, b: F.aggregate(F.slice(s, F.lit(1), b), zero, op))
    inner = lambda i: F.aggregate(F.slice(values, i - i % _BLOCK + 1, i % _BLOCK), zero, op)
    return let(blocks, lambda s: let(before(s), lambda at: F.transform(values, lambda _, i: op(F.get(at, F.floor(i / _BLOCK).cast("int")), inner(i)))))


def offsets(lengths: Column) -> Column:
    """The sums of the lengths before each element."""
    return running(lengths, F.lit(0), lambda a, x: a + x)


def with_spans(df: DataFrame, text: str, pattern: str, kind: str, out: str) -> DataFrame:
    """df with `out`: structs of start, kind (its number), end and value of the leftmost non-overlapping matches whose value is long enough."""
    k = KINDS.index(kind)
    # marks: 1 before a match, 2 before its value, 3 after it; in the text they become another control character
    clean = F.translate(F.col(text), "\x01\x02\x03", "\x04\x04\x04")
    least = LEAST[kind]
    # only where it can't change what matches (runs of one class), short ones are skipped by the pattern itself
    pattern = pattern if kind == "assign" else pattern.replace("AKIA[A-Z0-9]+", f"AKIA[A-Z0-9]{{{least - 4},}}").replace("]+)", f"]{{{least},}})")
    df = df.withColumn("_parts", F.split(F.regexp_replace(clean, pattern, "\x01$1\x02$2\x03"), "\x01"))
    df = df.withColumn("_parts", F.transform("_parts", lambda s, i: F.struct(
        F.when(i == 0, 0).otherwise(F.length(F.substring_index(s, "\x02", 1))).alias("lead"),
        F.when(i == 0, F.lit("")).otherwise(F.substring_index(F.substring_index(s, "\x03", 1), "\x02", -1)).alias("value"),
        (F.length(s) - F.when(i == 0, 0).otherwise(2)).alias("n"),
    )))
    df = df.withColumn("_at", offsets(F.transform("_parts", lambda p: p["n"])))
    spans = F.transform(F.arrays_zip("_parts", "_at"), lambda z: F.struct(
        z["_at"].alias("start"), F.lit(k).alias("kind"), (z["_at"] + z["_parts"]["lead"] + F.length(z["_parts"]["value"])).alias("end"), z["_parts"]["value"].alias("value"),
    ))
    return df.withColumn(out, F.when(F.size("_parts") > 1, F.filter(F.slice(spans, F.lit(2), F.size("_parts")), lambda s: F.length(s["value"]) >= least)).otherwise(F.filter(spans, lambda s: F.lit(False)))).drop("_parts", "_at")


def labelled_samples(docs: DataFrame, strings: int = SAMPLE_STRINGS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """token and is_random: hashed strings in the usual alphabets, and words and joined words."""
    n = docs.sparkSession.range(strings).select(F.sha2(F.col("id").cast("string"), 512).alias("h"))
    b64 = F.base64(F.unhex("h"))
    random = n.select(F.explode(F.array(
        F.substring("h", 1, 40), F.substring(b64, 1, 40), F.substring(F.translate(b64, "+/=", "xQ7"), 1, 40), F.substring(F.translate(b64, "+/=", "-_"), 20, 40),
        F.substring(F.upper(F.translate(b64, "+/=018", "ABCDEF")), 1, 32),
    )).alias("token"), F.lit(1).alias("is_random"))
    own = docs.select(id_text(F.col("doc_id")).alias("_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # ids alone are ordered; sample_docs bounds the broadcast side
    ids = own.select("_id").orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(sample_docs).distinct()
    some = own.join(F.broadcast(ids), "_id", "left_semi").select("text")
    words = some.select(F.filter(F.regexp_extract_all("text", F.lit("([A-Za-z]{2,})"), F.lit(1)), lambda w: F.length(w) <= 40).alias("w"))
    pairs = words.select(F.explode(F.transform("w", lambda w, i: F.concat_ws(" ", w, F.get("w", i + 1)))).alias("w"))
    phrases = docs.sparkSession.createDataFrame([(w,) for w in PHRASES], "w string").select(F.explode(F.array_repeat("w", 20)).alias("w"))
    space = F.lit(" ")
    forms = F.array("w", F.replace("w", space, F.lit("_")), F.replace(F.lower("w"), space, F.lit("_")), F.replace("w", space, F.lit("-")), F.replace("w", space, F.lit("/")), F.replace(F.initcap("w"), space, F.lit("")), F.concat(F.lower(F.substring("w", 1, 1)), F.expr("substring(replace(initcap(w), ' ', ''), 2)")), F.replace(F.upper("w"), space, F.lit("_")))
    ordinary = pairs.union(phrases).select(F.explode(forms).alias("token"), F.lit(0).alias("is_random"))
    # rules, and plain numbers, are no secrets either
    rules = docs.sparkSession.createDataFrame([(c,) for c in "-=_/+"], "c string").select(F.explode(F.array_repeat(F.repeat("c", F.lit(40)), 50)), F.lit(0))
    numbers = docs.sparkSession.range(strings).select(F.abs(F.xxhash64("id")).cast("string"), F.lit(0))
    return random.union(ordinary).union(rules).union(numbers)


def fit(samples: DataFrame, smoothing: float = 0.5, letters: int = 66) -> list[float]:
    """Log-likelihood ratios of each character given the one before, at 128 * before + character; 0 before the first."""
    chars = F.split("token", "")
    pairs = samples.where("length(token) > 0").select("is_random", F.explode(F.transform(chars, lambda c, i: F.when(i == 0, 0).otherwise(F.ascii(F.get(chars, i - 1))) * 128 + F.ascii(c))).alias("pair"))
    got = pairs.where("pair between 0 and 16383").groupBy("is_random", "pair").agg(F.count("*").alias("n")).collect()  # 2 x 16,384 rows at most
    count, total = ([0] * 16384, [0] * 16384), ([0] * 128, [0] * 128)
    for r in got:
        count[r.is_random][r.pair] += r.n
        total[r.is_random][r.pair // 128] += r.n
    chance = lambda k, i: (count[k][i] + smoothing) / (total[k][i // 128] + smoothing * letters)
    return [math.log(chance(1, i) / chance(0, i)) for i in range(16384)]


def scores(value: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of each character of value given the one before."""
    cells = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    return let(F.transform(F.split(value, ""), lambda c: F.least(F.ascii(c), F.lit(127))), lambda code: F.transform(code, lambda c, i: F.coalesce(F.get(cells, F.when(i == 0, 0).otherwise(F.get(code, i - 1)) * 128 + c), F.lit(0.0))))


_SPAN = "array<struct<start:int,end:int>>"
_STATE = "struct<i:int,sum:double,start:int,best:double,end:int,out:" + _SPAN + ">"


def _unlikely(llr: Column, n: Column) -> Column:
    return (llr >= LLR) & (llr >= LLR_PER_CHAR * n)


def _segments(score: Column, value: Column) -> Column:
    """The stretches of value that look random: those of largest sum, widened to the letters and digits they stand in."""

    def state(i, sum_, start, best, end, out) -> Column:
        return F.struct(i.alias("i"), sum_.alias("sum"), start.alias("start"), best.alias("best"), end.alias("end"), out.alias("out")).cast(_STATE)

    def out(a: Column) -> Column:
        return F.when(_unlikely(a["best"], a["end"] - a["start"]), F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))).cast(_SPAN))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        fresh = a["sum"] <= 0
        now = F.when(fresh, x).otherwise(a["sum"] + x)
        more = fresh | (now > a["best"])
        grown = state(a["i"] + 1, now, F.when(fresh, a["i"]).otherwise(a["start"]), F.when(more, now).otherwise(a["best"]), F.when(more, a["i"] + 1).otherwise(a["end"]), a["out"])
        # ended where the sum is used up, or far below its best
        return let(grown, lambda g: F.when((g["sum"] <= 0) | (g["best"] - g["sum"] >= DROP), state(g["i"], F.lit(0.0), g["start"], F.lit(0.0), g["end"], out(g))).otherwise(g))

    none = F.array().cast(_SPAN)
    zero = state(F.lit(0), F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0), none)
    found = F.aggregate(score, zero, step, out)
    chunks = F.translate(value, "+/_=-", "     ")
    wide = let(chunks, lambda v: F.transform(found, lambda s: F.struct(
        (s["start"] - F.length(F.substring_index(F.substring(v, F.lit(1), s["start"]), " ", -1))).alias("start"),
        (s["end"] + F.length(F.substring_index(F.substring(v, s["end"] + 1, F.length(v)), " ", 1))).alias("end"),
    )))
    last = lambda a: F.get(a, F.size(a) - 1)
    joined = F.aggregate(wide, none, lambda a, s: F.when((F.size(a) > 0) & (last(a)["end"] >= s["start"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(s))).cast(_SPAN))
    return F.filter(joined, lambda s: s["end"] - s["start"] >= LEAST["markov"])


def random_spans(value: Column, table: list[float]) -> Column:
    """start and end of what looks random in value: all of it, or else its stretches."""
    sums = lambda score, of: F.aggregate(score, F.lit(0.0), lambda a, x: a + of(x))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(value).alias("end"))).cast(_SPAN)
    none = F.array().cast(_SPAN)
    return let(scores(value, table), lambda x: F.when(_unlikely(sums(x, lambda v: v), F.length(value)), whole).when(sums(x, lambda v: F.greatest(v, F.lit(0.0))) < LLR, none).otherwise(_segments(x, value)))


def blocked(spans: Column) -> Column:
    """Sorted spans in blocks, with the least start (lo) and the largest end (hi) of each."""
    cut = lambda b: let(F.slice(spans, b * _BLOCK + 1, F.lit(_BLOCK)), lambda x: F.struct(F.get(x, F.lit(0))["start"].alias("lo"), F.array_max(F.transform(x, lambda y: y["end"])).alias("hi"), x.alias("spans")))
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(spans) / _BLOCK).cast("int")), cut)


def left_over(run: Column, blocks: Column) -> Column:
    """start and end of what base spans (as blocked() gives them) leave of a run, where long enough."""
    near = F.filter(blocks, lambda b: (b["lo"] < run["end"]) & (run["start"] < b["hi"]))
    over = F.filter(F.flatten(F.transform(near, lambda b: b["spans"])), lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    piece = lambda a, to: F.when(to - a["at"] >= LEAST["markov"], F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), to.alias("end"))).cast(_SPAN))).otherwise(a["out"])
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out")).cast("struct<at:int,out:" + _SPAN + ">")
    return F.aggregate(over, state(run["start"], F.array().cast(_SPAN)), lambda a, b: state(F.greatest(a["at"], b["end"]), piece(a, b["start"])), lambda a: piece(a, run["end"]))


def scanned(docs: DataFrame, table: list[float], text: str = "text") -> DataFrame:
    """docs with `_base` and `_spans`: sorted structs of start, kind and end; `_text` is the text scanned."""
    df = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("markov", RUN)):
        df = with_spans(df, "_text", pattern, kind, f"_{kind}")
    bare = lambda name: F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    df = df.withColumn("_base", F.array_sort(F.concat(bare("_assign"), bare("_access"), bare("_hex"))))
    df = df.withColumn("_blocks", blocked(F.col("_base")))
    runs = F.transform("_markov", lambda r: F.transform(left_over(r, F.col("_blocks")), lambda p: F.struct(p["start"].alias("start"), F.substring(r["value"], p["start"] - r["start"] + 1, p["end"] - p["start"]).alias("value"))))
    df = df.withColumn("_markov", F.flatten(runs))
    found = F.transform("_markov", lambda p: F.transform(random_spans(p["value"], table), lambda s: F.struct((p["start"] + s["start"]).alias("start"), F.lit(KINDS.index("markov")).alias("kind"), (p["start"] + s["end"]).alias("end"))))
    df = df.withColumn("_markov", F.flatten(found))
    return df.withColumn("_spans", F.array_sort(F.concat("_base", bare("_markov")))).drop("_assign", "_access", "_hex", "_markov", "_blocks")


def rendered(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """doc_id, the counts of the base kinds, the digest of the base spans and all spans of every row."""
    table = table or fit(labelled_samples(docs))
    own = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), table)
    n = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return own.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(rendered("_base"), 256).alias("base_sha256"), rendered("_spans").alias("spans"))


def redacted(docs: DataFrame, table: list[float] | None = None, mark: str = "[secret]") -> DataFrame:
    """docs with every span of `text` replaced by a mark (a null text stays null) and n_chars, where there is one, counted anew. Columns of any name are carried."""
    table = table or fit(labelled_samples(docs))
    df = scanned(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")), table, "_row.text")
    # spans that touch become one: a span opens a group where it starts beyond all ends before it, and a group ends
    # where those ends have got to when the next one opens
    ends = F.transform("_spans", lambda s: s["end"])
    df = df.withColumn("_reach", running(ends, F.lit(-1), lambda a, x: F.greatest(a, x)))
    zipped = F.arrays_zip(F.transform("_spans", lambda s: s["start"]).alias("start"), F.col("_reach").alias("reach"))
    df = df.withColumn("_opens", F.filter(zipped, lambda z: z["start"] > z["reach"]))
    # the text between groups, from `begin` to `end`
    last = F.array(F.struct(F.length("_text").alias("start"), F.coalesce(F.array_max(ends), F.lit(0)).alias("reach")))
    df = df.withColumn("_kept", F.transform(F.concat("_opens", last), lambda o, i: F.struct(F.when(i == 0, 0).otherwise(o["reach"]).alias("begin"), o["start"].alias("end"))))

    def block(b: Column) -> Column:
        own = F.slice("_kept", b * _BLOCK + 1, F.lit(_BLOCK))
        begin = F.get(own, F.lit(0))["begin"]
        part = F.substring("_text", begin + 1, F.element_at(own, F.lit(-1))["end"] - begin)
        return let(part, lambda t: F.transform(own, lambda k: F.substring(t, k["begin"] - begin + 1, k["end"] - k["begin"])))

    blocks = F.sequence(F.lit(0), F.floor((F.size("_kept") - 1) / _BLOCK).cast("int"))
    text = F.when(F.size("_spans") > 0, F.array_join(F.flatten(F.transform(blocks, block)), mark)).otherwise(F.col("_text"))
    df = df.withColumn("_new", F.when(F.col("_row.text").isNotNull(), text))
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_new").cast(docs.schema["n_chars"].dataType)
    return df.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
