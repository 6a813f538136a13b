"""The training-data operators against brute force, round trips and held-out accuracy, with nulls, empties, repeats and clashing columns."""

import base64
import collections
import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitlens.llm import fertility, jaccard, langid, lm, media, mixing, quality, sampling, secrets, warc
from commitlens.llm.components import components
from commitlens.llm.lattice import SPACE, Lattice, Vocabulary, load

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a " * 6000, "en", "s", 1), (3, "a " * 6000, "en", "s", 1), (None, "the cat and the dog", None, "s", 2), (None, None, None, None, None), (-5, "é😀 ▁x\ty\r\nz", "fr", "t", 3)]
    return spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit(1), "node": F.lit("x"), "_text": F.lit(2), "p": F.lit(0)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(*load())


def test_quality_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.9


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, quality int")
    got = quality.score(odd, quality.fit(odd, labels)).collect()
    assert len(got) == odd.count() and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert quality.score(none, None).count() == 0
    assert quality.by_quantile(spark.createDataFrame([(i, i / 10) for i in range(10)], "doc_id long, score double"), 0.5).count() == 6


def test_bradley_terry_learns_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - 0.5 * x[:, 2] > 0.3).astype(int)
    s = quality.fit_pairs(x, y).score(x)
    assert s[y == 1].min() > s[y == 0].mean() and np.mean((s >= quality.CUT) == y) > 0.95


def test_secrets_base_spans_brute_force(docs, odd, none):
    pat = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)

    def brute(t):
        s = [(m.start(), 0, m.end()) for m in pat.finditer(t) if len(m[2]) >= 8]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        return hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(s)).encode()).hexdigest()

    rng = random.Random(4)
    bits = ["token", "PASSWORD", "api_key", "apikey", " ", "=", ":", '"', "'", "abcdefgh", "x1", "\x01", "\x02\x03", "AKIA", "AKIAABCDEFGHIJKL", "f" * 31, "0" * 33, "é", "😀", "\n", "secret", "==", "."]
    own = docs.sparkSession.createDataFrame([(i, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(200)] + [(900, "token=abcdefgh1 " * 700)], "doc_id long, text string")
    table = secrets.fit(secrets.labelled_samples(docs))
    for df in (docs.select("doc_id", "text"), own, odd.where("doc_id is not null")):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        for r in secrets.scan(df, table).collect():
            assert r.base_sha256 == brute(texts[r.doc_id])
    assert secrets.scan(none, table).count() == 0 and secrets.redacted(odd, table).columns == odd.columns


def test_secrets_markov_and_redaction(spark, docs):
    table = secrets.fit(secrets.labelled_samples(docs))
    t = "id zX9qR4tLw8Pb2NvYk7Hc and getUserNameFromDefaultConfig, http_request_handler_factory -------------------------"
    df = spark.createDataFrame([(1, t, len(t)), (2, 'é "token": "abcdefghij" end', 0), (3, None, None)], "doc_id long, text string, n_chars long")
    assert {r.doc_id: r.spans for r in secrets.scan(df, table).collect()} == {1: "markov:3:23", 2: "assign:3:22", 3: ""}
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redacted(df, table).collect()}
    assert got[1][0].startswith("id [secret] and getUser") and got[2][0] == 'é "[secret]" end' and got[2][1] == 16 and got[3] == (None, None)


def test_secrets_joined_to_ordinary_text(spark, docs):
    table = secrets.fit(secrets.labelled_samples(docs))
    rng = random.Random(11)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    path = "home/user/projects/data/configuration/default/settings/application/"
    around = [("", ""), ("long_setting_name_for_service=", ""), ("payment_service_client_credential_value=", ""), (path, ""), (path, "/index/page/default/config"), ("token=abcdefgh.", " password: abcdefghij/x")]
    cases = [(i, a, key(n), b) for i, (a, b, n) in enumerate((a, b, n) for a, b in around for n in (24, 32) for _ in range(20))]
    df = spark.createDataFrame([(i, f"see {a}{k}{b} end") for i, a, k, b in cases], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redacted(df, table).collect()}
    assert np.mean([k not in got[i] for i, _, k, _ in cases]) >= 0.95
    # the ordinary text around stays where the run as a whole is no secret
    assert any(path in got[i] for i, a, _, _ in cases if a == path)
    # what a base span leaves of a run
    hexes = "0123456789abcdef" * 2
    text = f"{key(30)}_{hexes}-{key(30)}"
    assert secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), table).first().spans == "markov:0:31,hex:31:63,markov:63:94"
    plain = [f"see {path}index_page.html and long_setting_name_for_service=default-config-value-of-application/file/path"]
    assert secrets.scan(spark.createDataFrame([(1, plain[0])], "doc_id long, text string"), table).first().spans == ""


def test_language_held_out(docs, odd, none):
    got = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.97
    m = langid.fit(docs)
    r = {(x.doc_id, x.lang_pred) for x in langid.identify(odd, m).collect()}
    assert (1, "und") in r and (2, "und") in r and (None, "und") in r and (None, "en") in r
    assert langid.identify(none, m).count() == 0 and langid.predict(none).count() == 0
    assert langid.identified(odd, m).columns == odd.columns and langid.identified(docs, m).count() == docs.count()


def _segmentations(t, pieces):
    if not t:
        yield []
    for k in range(1, 17):
        if k <= len(t) and t[:k] in pieces:
            yield from ([pieces[t[:k]], *r] for r in _segmentations(t[k:], pieces))


def test_forward_sums_all_segmentations(vocabulary):
    v = vocabulary
    pieces = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == "piece"}
    words = [SPACE + "the", SPACE + "anonder", "x", SPACE * 3 + "ab"]
    lat = Lattice(v, words)
    w = lat.weights(v.logp, v.byte_logp)
    there, back = lat.forward(w), lat.backward(w)
    for i, word in enumerate(words):
        want = np.logaddexp.reduce([sum(v.logp[p] for p in s) for s in _segmentations(word, pieces)])
        assert abs(there[lat.last[i]] - want) < 1e-9 and abs(back[lat.first[i]] - want) < 1e-9


def test_sampling_is_without_replacement_and_calibrated(vocabulary):
    v = Vocabulary(*load(), 0.3)
    pieces = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == "piece"}
    text = "at on"
    all_ = list(_segmentations(sampling.escaped(text), pieces))
    logp = np.array([sum(v.logp[i] for i in a) for a in all_])
    p = np.exp(logp - np.logaddexp.reduce(logp))
    at = {tuple(a): i for i, a in enumerate(all_)}
    paths = sampling.Paths(v)
    chunks = paths.numbers(sampling._CHUNKS.findall(sampling.escaped(text)))
    n, first, second, total = 4000, np.zeros(len(p)), np.zeros(len(p)), 0.0
    for turn in range(n // 200):
        for got in sampling.top_k(paths, [chunks] * 200, [turn * 200 + i for i in range(200)], 3):
            ids = [at[tuple(sampling.to_ids(paths, e).tolist())] for e, _, _ in got]
            assert len(set(ids)) == 3
            first[ids[0]] += 1
            second[ids[1]] += 1
            total += sum(np.exp(x - y) for _, x, y in got)
    want = np.array([sum(p[j] * p[i] / (1 - p[j]) for j in range(len(p)) if j != i) for i in range(len(p))])
    assert np.abs(first / n - p).max() < 0.03 and np.abs(second / n - want).max() < 0.03 and abs(total / n - 1) < 0.05
    few = sampling.top_k(paths, [paths.numbers([SPACE])], [1], 5)[0]
    assert len(few) == 1 and few[0][2] == 0.0


def test_encoding_round_trip(odd, none, vocabulary):
    out = sampling.encode(odd, k=3)
    got = out.collect()
    assert all(r.is_exact for r in got)
    texts = collections.Counter((r.doc_id, r.text or "") for r in odd.collect())
    back = {(r.doc_id, r.text) for r in sampling.decoded(out).collect()}
    assert back == set(texts)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    assert all(sp.decode(r.pieces) == "the cat and the dog" for r in got if r.doc_id is None and r.n_pieces)
    assert sampling.encode(none).count() == 0
    again = {(r.doc_id, r.sample, tuple(r.pieces)) for r in sampling.encode(odd, k=3).repartition(3).collect()}
    assert again == {(r.doc_id, r.sample, tuple(r.pieces)) for r in got}


def _components(sets, percent=85):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def _shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def test_jaccard_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n ", "w1", "W1", "w1 w2"]
    common = [rng.choice(words) for _ in range(55)]
    for _ in range(8):
        base = [rng.choice(words) for _ in range(rng.choice([4, 20, 60, 110]))]
        for _ in range(12):
            d = list(base)
            for _ in range(rng.randint(0, 2)):
                d[rng.randrange(len(d))] = rng.choice(words)
            texts.append(" ".join(d))
    texts += [" ".join(common + [rng.choice(words) for _ in range(40)]) for _ in range(20)] + [" ".join(common)] * 15
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit(1)).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(df).collect()}
    sets = {i: _shingles(t) for i, t in enumerate(texts)}
    want = _components(sets)
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    kept = jaccard.deduplicated(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == df.columns


def test_jaccard_gives_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(x if rng.random() > 0.01 else f"x{rng.randrange(10**6)}" for x in base) for _ in range(70)] + [" ".join(base)] * 3 + ["one two three four five", None, "one two three four five"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = {i: frozenset(_shingles(t)) for i, t in enumerate(texts)}
    both = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    degree = collections.Counter(i for p in both for i in p)
    assert len(both) > 3 * len(texts)  # far more links than a tree of them has
    assert {r.doc_id: r.n_links for r in jaccard.linked(df).collect()} == {i: degree[i] for i in sets}
    pairs, rows = jaccard.links(df)
    node = {r.doc_id: r.node for r in rows.collect()}
    got = pairs.collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b): (r.shared, r.union) for r in got} == {tuple(sorted((node[a], node[b]))): v for (a, b), v in both.items() if sets[a] != sets[b]}


def test_jaccard_of_near_copies_about_the_bound(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT_ROWS", 3)  # frequent shingles are spread
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for _ in range(350):
        d = list(base)
        for at in rng.sample(range(150), rng.randint(2, 6)):
            d[at] = f"x{rng.randrange(60)}"
        texts.append(" ".join(d))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = {i: frozenset(_shingles(t)) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    degree = collections.Counter(i for p in links for i in p)
    want = _components(sets)
    assert 10 < len(set(want.values())) and len(links) < 0.3 * 351 * 350 / 2
    assert {r.doc_id: (r.component_id, r.n_links) for r in jaccard.linked(df).collect()} == {i: (want[i], degree[i]) for i in sets}


def test_jaccard_sketches_lose_no_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)])
        apart = sum(int(x).bit_count() for x in (jaccard._sketch(a) ^ jaccard._sketch(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b)) and (apart - len(np.setxor1d(a, b))) % 2 == 0


def test_jaccard_odd_rows(odd, none):
    got = jaccard.linked(odd).collect()
    assert len(got) == odd.count() and {r.component_id for r in got if r.doc_id == 3} == {3}
    assert jaccard.linked(none).count() == 0
    assert jaccard.deduplicated(odd).count() == odd.count() - 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == find(i) for i in range(300))


def test_media_payloads(odd, none):
    for r in media.text_media(odd).join(odd.select("doc_id", "text").where("doc_id is not null").distinct(), "doc_id").collect():
        raw = (r.text or "").encode()
        pay = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.wav(pay)).hexdigest() and r.media_bytes == len(media.wav(pay)) and r.feature.startswith("audio/wav")
    assert media.text_media(none).count() == 0


def test_sniffing_carves_and_rejects(spark):
    def chunk(k, d):
        return len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    gz = gzip.compress(b"hello" * 50)
    wav = media.wav(b"ab" + png + b"BM not a bitmap" + gz)
    assert media.sniff(png) == [(0, len(png), "image/png")] and media.sniff(gif) == [(0, len(gif), "image/gif")] and media.sniff(png[:-1]) == []
    found = media.sniff(b"junk " + png + b" GIF89a junk " + gif + gz)
    assert [k for _, _, k in found] == ["image/png", "image/gif", "application/gzip"]
    df = spark.createDataFrame([(1, "image/jpeg", bytearray(wav)), (2, None, None), (3, "text/plain", bytearray(b"BM"))], "media_id long, declared string, content binary")
    got = {r.media_id: r for r in media.sniffed(df).collect()}
    assert got[1].media_type == "audio/wav" and got[1].is_corrected and [(c.media_type, bytes(c.content)) for c in got[1].carved] == [("image/png", png), ("application/gzip", gz)]
    assert got[2].media_type == media.UNKNOWN and got[3].media_type == media.UNKNOWN and not got[3].carved


def test_sniffing_takes_whole_pdfs(spark):
    jpeg = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0\xff\xda\0\x08\1\1\0\0?\0\0\xff\xd9"
    end = lambda n: b"xref\n0 1\ntrailer\n<</Size 1>>\nstartxref\n%d\n%%%%EOF\n" % n
    image = b"7 0 obj\n<</Length %d>>\nstream\n" % len(jpeg) + jpeg + b"\nendstream\nendobj\n"
    one = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n" + end(9)
    updated = one + image + end(40) + b"\n" + image + end(60)
    head = b"%%PDF-1.5\n%%\xe2\xe3\xcf\xd3\n3 0 obj\n<</Linearized 1/L %06d/H[1 2]/O 5/E 9/N 1/T 9>>\nendobj\n"
    rest = end(0) + image + end(9)
    linear = head % (len(head % 0) + len(rest)) + rest
    for pdf in (one, updated, linear, linear + image + end(5)):
        whole = len(pdf) - 1  # without the last line's end
        assert media.sniff(b"junk " + pdf + b"tail") == [(5, whole, "application/pdf")]
        assert media.sniff(b"junk " + pdf + one) == [(5, whole, "application/pdf"), (5 + len(pdf), len(one) - 1, "application/pdf")]
    got = media.sniffed(spark.createDataFrame([(1, None, bytearray(media.wav(updated)))], "media_id long, declared string, content binary")).first()
    assert [(c.media_type, bytes(c.content)) for c in got.carved] == [("application/pdf", updated[:-1])]
    assert media.sniff(b"%PDF-") == [] and media.sniff(b"%PDF-1.4 startxref") == []


def _rules(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_fertility_counts(docs, odd, none):
    for df in (docs, odd.where("doc_id is not null")):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in fertility.rules(df).collect():
            n = _rules(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
            assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)
    assert fertility.rules(none).count() == 0


def test_fertility_tokens_equal_the_library(docs):
    import sentencepiece

    model = open("/opt/tokenizers/piece_bpe_32k.model", "rb").read()
    enc, sp = fertility.Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [r.text for r in docs.limit(60).collect()] + ["", " ", "a  b\n\n c", "\n", "x▁y", "é😀\u0000", "tab\there  "]
    ids, per = enc.encode(texts)
    parts = np.split(ids, np.cumsum(per)[:-1])
    for t, got in zip(texts, parts):
        assert got.tolist() == sp.encode(t), t


def test_warc_round_trip(spark, none, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000), (None, "u", "x" * 300_000)], "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    digest = base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    assert (got[1].record_type, got[1].refers_to, got[1].payload_bytes, got[1].payload_digest) == ("revisit", 2, 9, digest)
    assert got[2].record_type == "response" and got[2].refers_to is None and got[3].refers_to == 4 and got[None].refers_to == 5
    assert len(got) == 6 and warc.round_trip(pages.where("false")).count() == 0
    assert {r.record_type for r in warc.round_trip(pages.where("page_id < 5"), least=1).where("page_id >= 3").collect()} == {"response"}
    blob = warc.archives(warc.planned(pages)).first().content
    (tmp_path / "x.warc.gz").write_bytes(blob)
    assert warc.records(spark.read.format("binaryFile").load(str(tmp_path)), payloads=True).count() > 0
    for piece in (1, 7, 4096):
        assert len(list(warc.read(bytes(blob[i : i + piece]) for i in range(0, len(blob[:3000]) if piece == 1 else len(blob), piece)))) if piece > 1 else True
    with pytest.raises(ValueError):
        list(warc.read(iter([bytes(blob[:-9])])))


def test_lm_prefers_the_target(spark, odd, none):
    rng = random.Random(0)
    a, b = "red green blue".split(), "one two three".split()
    text = lambda v: " ".join(rng.choice(v) for _ in range(30))
    own = spark.createDataFrame([(i, text(a if i % 2 else b)) for i in range(60)], "doc_id long, text string").repartition(4)
    aim = spark.createDataFrame([(1, text(a)), (2, None)], "item_id long, text string")
    got = {r.doc_id: r for r in lm.score(own, aim).collect()}
    assert max(r.score for i, r in got.items() if i % 2) < min(r.score for i, r in got.items() if not i % 2)
    assert lm.score(none, aim).count() == 0
    assert {r.doc_id for r in lm.score(odd, aim).where("score is null").collect()} == {1, 2, None}


def test_lm_brute_force(spark):
    rows = [(0, "a b a c"), (1, "b a"), (2, "c c c a")]
    own, aim = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(0, "a b")], "item_id long, text string")
    got = {r.doc_id: r for r in lm.score(own, aim).collect()}
    vocab = 4  # a, b, c and the unknown word

    def model(texts, scale):
        uni, bi = collections.Counter(), collections.Counter()
        for t in texts:
            w = ["^", *t.split()]
            uni.update(w)
            bi.update(zip(w, w[1:]))
        n = sum(c for k, c in uni.items() if k != "^") * scale
        one = lambda w: (uni[w] * scale + 0.5) / (n + 0.5 * vocab)
        return lambda x, w: -np.log((bi[x, w] * scale + lm.BACK_OFF * one(w)) / (uni[x] * scale + lm.BACK_OFF))

    t, g = model(["a b"], 1.0), model([x for _, x in rows], 2 / 10)
    for i, x in rows:
        w = ["^", *x.split()]
        assert abs(got[i].ce_target - np.mean([t(*p) for p in zip(w, w[1:])])) < 1e-6 and abs(got[i].ce_background - np.mean([g(*p) for p in zip(w, w[1:])])) < 1e-6


def test_lm_counts_every_word_and_bigram_apart(spark, monkeypatch):
    monkeypatch.setattr(lm, "RANGE_CHARS", 100_000)
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(60_000)}" for _ in range(400))) for i in range(300)]
    own, aims = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), [" ".join(f"w{i}" for i in range(30_000)), rows[0][1]]
    got = {r.doc_id: r for r in lm.score(own, spark.createDataFrame([(x,) for x in aims], "text string")).collect()}
    size = 1 + len({w for x in [*aims, *[x for _, x in rows]] for w in x.split()})
    assert size > 55_000  # more words than a vocabulary that is cut at 50,000

    def model(texts):
        uni, bi = collections.Counter(), collections.Counter()
        for t in texts:
            w = ["^", *t.split()]
            uni.update(w)
            bi.update(zip(w, w[1:]))
        return uni, bi, sum(c for k, c in uni.items() if k != "^")

    t, g = model(aims), model([x for _, x in rows])
    for i, x in rows:
        w = ["^", *x.split()]
        for name, (uni, bi, n), scale in (("ce_target", t, 1.0), ("ce_background", g, t[2] / g[2])):
            loss = [-np.log((bi[p] * scale + lm.BACK_OFF * (uni[p[1]] * scale + 0.5) / (n * scale + 0.5 * size)) / (uni[p[0]] * scale + lm.BACK_OFF)) for p in zip(w, w[1:])]
            assert abs(got[i][name] - np.mean(loss)) < 1e-6


def test_mixing_meets_marginals(docs, odd, none):
    got = mixing.mix(docs, budget=0.4).toPandas()
    w = got.n_tokens * got.weight
    for k in ("source", "lang", "topic"):
        share = got.n_tokens.groupby(got[k]).sum() / got.n_tokens.sum()
        want = share**mixing.FLATTEN / (share**mixing.FLATTEN).sum()
        assert (w.groupby(got[k]).sum() / w.sum() - want).abs().max() < 0.01
    assert abs((got.n_tokens * got.probability).sum() / got.n_tokens.sum() - 0.4) < 0.01
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    assert mixing.sampled(odd, budget=1.0).columns == odd.columns


def test_mixing_pools_no_value(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([3, 40, 150, 1200]), rng.choice(["en", "de", None] + [f"l{k}" for k in range(70)]), f"s{rng.randrange(300)}") for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), rounds=8).toPandas()
    cells = got.groupby(["source", "lang", "topic"]).n_tokens.sum().reset_index()
    assert cells.source.nunique() > 256 and cells.lang.nunique() > 64
    c = cells.n_tokens.to_numpy(float)
    x = c.copy()
    want = {}
    for k in ("source", "lang", "topic"):
        r = (cells.groupby(k).n_tokens.sum() / c.sum()) ** mixing.FLATTEN
        want[k] = cells[k].map(r / r.sum() * c.sum()).to_numpy()
    for _ in range(8):
        for k in ("source", "lang", "topic"):
            x = x * want[k] / np.array(cells.assign(x=x).groupby(k).x.transform("sum"))
    factor = x / c
    lo, hi = 0.0, 1 / factor.min()
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (c * np.minimum(1, factor * mid)).sum() < mixing.BUDGET * c.sum() else (lo, mid)
    cells["f"], cells["p"] = factor, np.minimum(1, factor * hi)
    both = got.merge(cells, on=["source", "lang", "topic"])
    assert len(both) == len(rows) and (both.weight - both.f).abs().max() < 2e-6 and (both.probability - both.p).abs().max() < 2e-6


def test_clashing_columns_are_carried(spark, docs):
    names = ["_row", "_text", "_assign", "_spans", "_new", "_kept", "_u", "_p", "_factor", "_taken", "_tokens", "_key", "a.b"]
    rows = [(i, "password: abcdefgh%d and more words" % i, "en", "s", 5, *[f"{n}{i}" for n in names]) for i in range(3)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    table = [0.0] * 16384
    for out in (secrets.redacted(df, table), mixing.sampled(df, budget=1.0), jaccard.deduplicated(df)):
        got = out.collect()
        assert out.columns == df.columns and got and all(tuple(r)[5:] == tuple(f"{n}{r.doc_id}" for n in names) for r in got)
    assert {r.text for r in secrets.redacted(df, table).collect()} == {"[secret] and more words"}


def test_redaction_of_many_spans(spark):
    table = [0.0] * 16384
    text = "".join(f"é{i} token=abcdefgh{i} {'f' * 32}token: x{i}yzabcdef\n" for i in range(5000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = [tuple(map(int, x.split(":")[1:])) for x in secrets.scan(df, table).first().spans.split(",")]
    assert len(spans) == 15000
    want, at = [], 0
    for a, b in sorted(spans):
        if a > at or not want:
            want.append(text[at:a])
        at = max(at, b)
    assert secrets.redacted(df, table).first().text == "[secret]".join([*want, text[at:]])


def test_mixing_targets(docs):
    got = mixing.mix(docs, targets={"lang": {"en": 0.25, "de": 0.25, "fr": 0.25, "es": 0.25}}, rounds=60).toPandas()
    w = (got.n_tokens * got.weight).groupby(got.lang).sum()
    assert (w / w.sum() - 0.25).abs().max() < 0.01


def test_mixing_targets_of_light_values(spark):
    rows = [(i, "w " * (1 if i % 4 == 0 else 50), "en", f"s{i % 4}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, targets={"source": {"s0": 0.1, "s1": 0.9}}).toPandas()
    w = (got.n_tokens * got.weight).groupby(got.source).sum() / (got.n_tokens * got.weight).sum()
    assert abs(w["s0"] - 0.1) < 0.01 and abs(w["s1"] - 0.9) < 0.01
