"""Byte views, BPE, FLAC and URL filter against the library, exact round trips and plain versions."""

import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from angulon.llm import bpe, flac, textio, urls

public = pytest.importorskip("public_tokenizers")
ALPHABET = "abcdefgh  \t\n'’stréèßÑΣςσİıǅ\u0301\u0308가\x1c\x1f\x85\xa0\u1680\u180e\u2003\u3000中😀\u200d123²Ⅷ٣<|>!?.,;-_/\\\x00"


def texts(n, seed=1):
    rng = random.Random(seed)
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    return ["", *["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) + (rng.choice(special) if rng.random() < 0.2 else "") for _ in range(n)]]


def test_words_and_hashes():
    rows = ["The end", None, "", " a  the ", "THE", "é x", "x" * 3000]
    seen = {}
    for lo, hi, data, offsets in textio.chunks(pa.array(rows), 40):
        start, end, counts = textio.words(data, offsets)
        hashes = textio.span_hashes(data, start, end, textio.LOWER_CODES)
        own = [data[a:b].tobytes().decode().lower() for a, b in zip(start, end)]
        assert counts.sum() == len(own) and list(counts) == [len((r or "").split()) for r in rows[lo:hi]]
        for w, h in zip(own, hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) and set(seen) == {w for r in rows if r for w in r.lower().split()}


@pytest.fixture(scope="module")
def encoder():
    with open(public.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe.Bpe(f.read())


def test_bpe_equals_the_tokenizer(encoder):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for t in [*texts(3000), "a" * 5000, "!?" * 3000, "é" * 999]:
        e = want.encode(t, add_special_tokens=False)
        assert encoder.encode(t).tolist() == e.ids, t
        assert encoder.decode(encoder.encode(t)) == want.decode(e.ids, skip_special_tokens=False)


def test_bpe_automaton(encoder):
    tokens = encoder.automaton.tokens
    made = bpe.Automaton(tokens)
    for t in texts(200):
        shown, state = t.lower().replace(" ", bpe.END), 0
        for at, c in enumerate(shown, 1):
            state = made.step[state << 21 | ord(c)]
            assert [i for _, i in made.ending[state]] == [tokens[shown[k:at]] for k in range(max(0, at - 80), at) if shown[k:at] in tokens]
    assert len(made.texts) < len(made.prefixes) / 4  # states that no text led to are not made


def test_bpe_columns(spark, encoder):
    rows = [(None,), ("",), ("Hello wörld",)]
    path = public.path("word_bpe_49k.json")
    df = spark.createDataFrame(rows, "text string")
    got = df.select("text", bpe.encode_column(F.col("text"), path, spark).alias("ids")).withColumn("back", bpe.decode_column(F.col("ids"), path, spark)).collect()
    assert [r.ids for r in got] == [encoder.encode(t).tolist() for (t,) in rows] and [r.back for r in got] == ["", "", encoder.decode(encoder.encode("Hello wörld"))]
    assert df.where("false").select(bpe.encode_column(F.col("text"), path, spark)).count() == 0


def test_flac_round_trip():
    rng = np.random.default_rng(1)
    payloads = [flac.payload(x) for x in [b"", b"a", b"hello" * 500, rng.integers(0, 256, 70_001, dtype=np.uint8).tobytes(), b"\0" * 4096, *[t.encode() for t in texts(60)]]]
    streams = flac.encode(payloads)
    assert [p for p, _ in flac.decode(streams)] == payloads and flac.encode(payloads[2:3]) == streams[2:3]
    whole = np.frombuffer(payloads[3], np.uint8) ^ 0x80
    assert (flac.read_samples(streams[3], 1000, 3001).view(np.uint8) == whole[1000:3001]).all()
    no_table = streams[3][:42].replace(b"fLaC\x00", b"fLaC\x80", 1) + streams[3][flac.parse(streams[3]).frames :]
    assert flac.decode([no_table, streams[0]])[0][0] == payloads[3]  # frames walked one after another
    for at in (-1, -300, 60):
        bad = bytearray(streams[3])
        bad[at] ^= 1
        if at == 60:
            bad = bytearray(streams[3])
            bad[flac.parse(streams[3]).frames + 4] ^= 1  # a frame header
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def rice(self, value, k):
        u = (value << 1) ^ (value >> 31)
        self.bits += [0] * (u >> k) + [1]
        self.put(u & ((1 << k) - 1), k)

    def bytes(self):
        return np.packbits(self.bits).tobytes()


def test_flac_reads_linear_prediction_partitions_and_escapes():
    """A frame written by hand: LPC of order 2 with four partitions, the second escaped with raw 7-bit residuals."""
    rng = np.random.default_rng(2)
    n, coefs, shift = 64, (5, -2), 2
    s = [3, -4]
    residual = []
    for _ in range(n - 2):
        e = int(rng.integers(-9, 10))
        guess = (coefs[0] * s[-1] + coefs[1] * s[-2]) >> shift
        if abs(guess + e) > 100:
            e = -guess
        e = max(-60, min(60, e))
        residual.append(e)
        s.append(guess + e)
    assert all(-128 <= v < 128 for v in s)
    b = Bits()
    head = bytes([0xFF, 0xF8, 0x60, 0x02, 0x00, n - 1])
    head += bytes([int(flac.crc8(np.frombuffer(head, np.uint8), np.array([0]), np.array([len(head)]))[0])])
    b.put(32 + 1, 7)
    b.put(0, 1)
    for v in s[:2]:
        b.put(v & 0xFF, 8)
    b.put(4 - 1, 4)
    b.put(shift, 5)
    for c in coefs:
        b.put(c & 15, 4)
    b.put(0, 2)
    b.put(2, 4)
    for part in range(4):
        own = residual[max(0, part * 16 - 2) : (part + 1) * 16 - 2]
        if part == 1:
            b.put(15, 4)
            b.put(7, 5)
            for v in own:
                b.put(v & 127, 7)
        else:
            b.put(2, 4)
            for v in own:
                b.rice(v, 2)
    frame = head + b.bytes()
    check = int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    samples = np.array(s, np.int8)
    stream = flac.encode([(samples.view(np.uint8) ^ 0x80).tobytes()])[0]
    got = flac.decode([stream[: flac.parse(stream).frames] + frame + check.to_bytes(2, "big")])
    assert got[0][0] == (samples.view(np.uint8) ^ 0x80).tobytes()


def test_flac_tables(spark):
    df = spark.createDataFrame([(1, "x" * 1500), (2, None), (3, "")], "doc_id long, text string")
    media = df.select("doc_id", flac.encode_column(F.col("text")).alias("media"))
    blocks = flac.pcm_table(media).orderBy("doc_id", "block").collect()
    assert [(r.doc_id, r.sample_offset, r.n_samples) for r in blocks] == [(1, 0, 512), (1, 512, 512), (1, 1024, 512), (2, 0, 64), (3, 0, 64)]
    d = {r.doc_id: r.d for r in df.select("doc_id", flac.digest_column(F.col("text")).alias("d")).collect()}
    assert d[2] == d[3] and d[1].n_bytes == 1500 and d[1].payload_bytes == 1536


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([len(rest), *[rest.find(c) for c in "/?#" if c in rest]])
        host, path = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits)[1:] if fits else (None, "allow")
    return host, path, *rule


@pytest.mark.parametrize("most", [100, 2])
def test_url_filter(spark, most):
    urls_ = ["http://A.Example.NET/en/x?q#f", "https://net", "http://x.net/", "ftp://example.net/enx", "http://notexample.com/de/", "https://example.com/de/1", "http://b.org/fr/", "nonsense", None, "", "http://a.b.example.com/de/", "http://örg.org/fr/é", "x://y.net/a\nb"]
    pages = spark.createDataFrame([*enumerate(urls_), (99, urls_[0])], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), most).collect()}
    assert got == {i: judged(u) for i, u in [*enumerate(urls_), (99, urls_[0])]}


@pytest.mark.parametrize("most", [100, 1])
def test_of_equally_long_url_entries_the_longer_host_decides(spark, most):
    entries = spark.createDataFrame([("a.net", "/", "allow"), ("net", "/ab", "block"), ("net", "/a", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/ab"), (2, "http://b.net/ab"), (3, "http://z.net/ac")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, entries, most).collect()}
    assert got == {1: ("a.net/", "allow"), 2: ("net/ab", "block"), 3: ("net/a", "block")}


def test_digest_collisions(monkeypatch):
    monkeypatch.setattr(urls, "digest", lambda key: len(key) % 2)
    index = urls.DigestArray(["a x", "bb x", "cc y"], ["1", "2", "3"])
    assert [index.values[i] if i >= 0 else None for i in index.find(["cc y", "a x", "dd z", "bb x"])] == ["3", "1", None, "2"]


def test_ids_and_digest_come_from_one_tokenizer(spark, encoder):
    rows = [(k, t) for k, t in enumerate([None, "", "Hello wörld", *texts(1200)])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    out = corpus_pipeline.encode(spark, df, "")
    want = [encoder.encode(t) for _, t in rows]
    got = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [(r.n_tokens, r.ids, r.decoded_sha256) for r in got] == [(len(x), x.tolist(), sha256(encoder.decode(x).encode()).hexdigest()) for x in want]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"] and corpus_pipeline.encode(spark, df.where("false"), "").count() == 0
