"""Near-duplicates, lines, fingerprints, mixing, models and the pipeline against plain versions."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from angulon.llm import fingerprints, lines, maxent, mixing, neardup, order_minhash, quality, queries, toxicity
from angulon.llm.textio import LOWER_CODES, mix, span_hashes

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, bases=14):
    """Texts with exact and near copies, and odd ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", str(rng.randint(0, 99))])
    out = []
    for _ in range(bases):
        lines_ = [" ".join(word() for _ in range(rng.randint(5, 25))) for _ in range(rng.randint(1, 6))]
        out.append("\n".join(lines_))
        for _ in range(rng.randint(0, 5)):
            w = out[-1].split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    out += ["", None, "  \n ", out[0], out[0].upper(), "x", "x y", "x y z w", "one two three four five", "one two three four six", "word " * 4000]
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def union(n, pairs):
    p = list(range(n))

    def root(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(300, i) for i in range(301, 340)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union(340, edges)
    assert [got.get(i, i) for i in range(340)] == want


def word_likeness(a, b):
    """By the longest common subsequence of runs of five words."""
    x, y = ([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [] for w in ((a or "").lower().split(), (b or "").lower().split()))
    if not x or not y:
        return float(len(x) == len(y))
    if max(len(x), len(y)) > 1000 or min(len(x), len(y)) < 0.5 * max(len(x), len(y)):
        return float(x == y)
    row = [0] * (len(y) + 1)
    for u in x:
        before = 0
        for j, v in enumerate(y):
            before, row[j + 1] = row[j + 1], before + 1 if u == v else max(row[j + 1], row[j])
    return row[-1] / (len(x) + len(y) - row[-1])


def plain_line_dedup(texts):
    """The remaining text by place in the list; places that lose all their lines are absent."""
    rows = [(i, k, x.strip(" \t\r\x0b\x0c")) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]
    rows = [x for x in rows if x[2]]
    same = [(i, j) for i, j in combinations(range(len(rows)), 2) if lines.likeness(lines.shingle_set(rows[i][2]), lines.shingle_set(rows[j][2])) >= 0.8]
    keep = {rows[i][:2] for i in set(union(len(rows), same))}
    out = {}
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        inked = [k for k, x in enumerate(own) if x.strip(" \t\r\x0b\x0c")]
        if not inked or any((i, k) in keep for k in inked):
            out[i] = None if t is None else "\n".join(x for k, x in enumerate(own) if k not in inked or (i, k) in keep)
    return out


@pytest.mark.parametrize("salt_rows", [1, 256])
def test_near_duplicates(spark, monkeypatch, salt_rows):
    monkeypatch.setattr(neardup, "SALT_ROWS", salt_rows)
    texts = corpus()
    want = union(len(texts), [(i, j) for i, j in combinations(range(len(texts)), 2) if word_likeness(texts[i], texts[j]) >= 0.8])
    df = frame(spark, texts).withColumn("node", F.lit("clash")).withColumn("class_id", F.lit(0))
    got = {r.doc_id: (r.class_id, r.kept) for r in order_minhash.classes_of(df).collect()}
    assert {i: c for i, (c, _) in got.items()} == dict(enumerate(want)) and {i for i, (_, k) in got.items() if k} == set(want)
    once = order_minhash.keep_one(frame(spark, texts).union(frame(spark, texts[:3])).withColumns({n: F.lit(7) for n in ("_node_here", "Node", "own")}))
    assert once.columns == [*SCHEMA.replace(",", "").split()[::2], "_node_here", "Node", "own"] and once.where("`_node_here` = 7 AND node = 7 AND own = 7").count() == once.count() and sorted(r.doc_id for r in once.collect()) == sorted(set(want))
    assert order_minhash.classes_of(df.where("false")).count() == 0


def test_many_texts_without_words_are_one_class(spark):
    texts = ["", " ", "\n", "  ", "\t", "one two three four five six", None, " \n ", "x"]
    got = {r.doc_id: (r.class_id, r.kept) for r in order_minhash.classes_of(frame(spark, texts)).collect()}
    assert got == {i: (i, True) if i in (0, 5, 8) else (0, False) for i in range(9)} | {6: (0, False)}
    assert sorted(r.doc_id for r in order_minhash.keep_one(frame(spark, texts)).collect()) == [0, 5, 8]


@pytest.mark.parametrize("salt_rows", [1, 256])
def test_lines(spark, monkeypatch, salt_rows):
    monkeypatch.setattr(neardup, "SALT_ROWS", salt_rows)
    texts = [t for t in corpus(5) if t is None or len(t) < 9000]
    want = plain_line_dedup(texts)
    got = {r.doc_id: r.text for r in lines.dedup(frame(spark, texts).union(frame(spark, texts[:2])).withColumns({n: F.lit(7) for n in ("key", "line", "T", "_lines", "_cut", "may", "gone")})).collect()}
    assert got == want
    assert lines.dedup(frame(spark, []).where("false")).count() == 0


def test_lines_of_usual_length_with_one_edit_are_alike(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pairs = []
    for n in range(50, 131, 2):
        own = " ".join(word(6) for _ in range(18))[:n]
        at = rng.randrange(8, n - 8)
        pairs.append((own, own[:at] + "#" + own[at + 1 :]))
        if n >= 100:
            own = " ".join(word(6) for _ in range(18))[:n]
            pairs.append((own, own[:35] + word(6).upper() + own[41:]))
    texts = [x for pair in pairs for x in pair]
    got = {r.doc_id for r in lines.dedup(frame(spark, texts)).collect()}
    assert got == set(range(0, len(texts), 2))


def plain_hash(*values):
    """Spark's xxhash64 of several columns: each is hashed with the hash before it as seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_sketch(text):
    pieces, now = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            pieces, now = pieces + [now] * bool(now), ""
        elif c in "eaEA048" or ord(c) >= 0x250:
            pieces, now = [*pieces, now + c], ""
        else:
            now += c
    k, s = fingerprints.K, fingerprints.S
    h = [-1] * (k - 1) + [plain_hash(x) for x in pieces] + [-1] * (k - 1)
    found = {}
    for i in range(len(h) - k + 1):
        inner = [plain_hash(*h[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(plain_hash(*h[i : i + k]), i - (k - 1))
    kept = [x for n, x in enumerate(sorted(found)) if n < fingerprints.LEAST or x < -(1 << 63) + (1 << 64) // 16]
    to = (1 << 63) - 1 if len(kept) == len(found) else max(kept[-1], -(1 << 63) + (1 << 64) // 16 - 1)
    return {x: found[x] for x in kept}, to


def plain_likeness(a, b):
    (x, to_x), (y, to_y) = a, b
    x, y = ({h: p for h, p in z.items() if h <= min(to_x, to_y)} for z in (x, y))
    places = [y[h] for h in sorted(set(x) & set(y), key=lambda h: x[h])]
    in_order = bool(places) + sum(q > p for p, q in zip(places, places[1:]))
    return in_order / len(set(x) | set(y))


def test_fingerprints(spark):
    texts = [*corpus(7), "alpha beta " * 30 + "tail", "가나다라마바사" * 9, " ".join(f"w{i * 7919}" for i in range(900))]
    rows = [(i * 7 << 40, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit("x"), "sketch": F.lit(1)})
    got = fingerprints.with_edits(df.union(df.limit(1))).select("*", F.sha2(F.encode("edited", "UTF-8"), 256).alias("sha"))
    got = fingerprints.add_likeness(fingerprints.add_likeness(got, "sketch", "edited_sketch", "near"), "sketch", "next_sketch", "after").collect()
    assert len(got) == len(texts) + 1
    plain = [plain_sketch(t or "") for t in texts]
    for r in got:
        i = r.doc_id // (7 << 40)
        own, nxt = texts[i] or "", texts[i - 1] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + nxt[:cut]
        assert r.sha == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(own)
        assert {x.h: x.p for x in r.sketch} == plain[i][0] and r.sketch_to == plain[i][1]
        assert r.near == pytest.approx(plain_likeness(plain[i], plain_sketch(edited))) and r.after == pytest.approx(plain_likeness(plain[i], plain[i - 1]))
    assert any(len(p) > fingerprints.LEAST for p, _ in plain)
    places = fingerprints.anchors(spark.createDataFrame([(1, "onetwothreefourfivesixseveneight" * 2), (2, "zeronetwothreefourfivesixseveneight" * 2)], "doc_id long, text string")).collect()
    shift = {r.anchor: r.place for r in places if r.doc_id == 1}
    assert any(r.anchor in shift for r in places if r.doc_id == 2)  # in text without blanks, too, anchors do not depend on what stands before
    assert fingerprints.with_edits(df.where("false")).count() == 0


@pytest.mark.parametrize("range_bytes", [1 << 22, 40])
def test_whole_fingerprints_hold_every_anchor(spark, monkeypatch, tmp_path, range_bytes):
    monkeypatch.setattr(fingerprints, "LEAST", 1 << 40)  # of the plain version: nothing is left out
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", range_bytes)
    texts = [*corpus(7), None, "alpha beta " * 30 + "tail", "가나다라마바사" * 9, " ".join(f"w{i * 7919}" for i in range(900))]
    rows = [(i * 7 << 40, t) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_syncmers(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter([i for i, _ in rows] + [0])
    plain = [plain_sketch(t or "") for t in texts]
    written = lambda s: " ".join(f"{h & (1 << 64) - 1:016x}@{p & 0xFFFFFFFF:x}" for h, p in sorted(s[0].items()))
    for r in got:
        i = r.doc_id // (7 << 40)
        own, nxt = texts[i] or "", texts[i - 1] or ""
        edited = own[: len(own) - len(own) // 3] + nxt[: len(own) // 3]
        other = plain_sketch(edited)
        assert (r.next_id, r.n_chars, r.edited_sha256) == (rows[i - 1][0], len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (written(plain[i]), written(other))
        assert r.near_edited == pytest.approx(plain_likeness(plain[i], other)) and r.near_next == pytest.approx(plain_likeness(plain[i], plain[i - 1]))
    assert max(len(p) for p, _ in plain) > 300


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 30), "big" if rng.random() < 0.7 else rng.choice(["a", "b", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"T": F.lit(5), "_times": F.lit(9), "passes": F.lit(8)})
    taken = mixing.realised(docs, evenness=0.98, repeats=3.0).collect()
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("big", "a", "b", None)}
    total = sum(size.values())
    weight = {r.source: r.weight for r in taken}
    a = math.log(weight["a"] / weight["big"]) / math.log(size["a"] / size["big"])
    z = sum((n / total) ** a for n in size.values())
    assert all(weight[s] == pytest.approx((n / total) ** a / z) for s, n in size.items())
    got = -sum(w * math.log(w) for w in weight.values()) / math.log(4)
    most = max(w * total / size[s] for s, w in weight.items())
    assert got == pytest.approx(0.98, abs=1e-4) or (most == pytest.approx(3.0, abs=1e-3) and got < 0.98)
    for s, w in weight.items():
        budget, real = round(w * total), sum(r.n_tokens for r in taken if r.source == s)
        assert budget - 30 <= real <= budget, s
        copies = [sum(1 for r in taken if r.source == s and r.doc_id == i) for i, _, x in rows if x == s]
        assert max(copies) - min(copies) <= 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.where("T = 5 AND _times = 9 AND passes = 8").count() == mixed.count()
    assert mixing.mix(docs.where("false")).count() == 0


def test_language_model(spark):
    texts = corpus(9, 40)
    df = frame(spark, texts)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    model, counts = maxent.train(df.where(~F.col("doc_id").isin([i for i in range(len(texts)) if held(i)])))
    got = {r.doc_id: r for r in maxent.score(df.union(df.limit(1)), model, counts).collect()}
    token = lambda t: [*(t or "").lower().split(), "\n"]
    seen = {}
    for i, t in enumerate(texts):
        if not held(i):
            for w in token(t):
                seen[w] = seen.get(w, 0) + 1
    n, v = sum(seen.values()), len(seen)
    for i, t in enumerate(texts):
        r = got[i]
        assert r.n_tokens == len(token(t)) and r.n_known == sum(w in seen for w in token(t)) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((seen.get(w, 0) + 1) / (n + v + 1)) for w in token(t)))
    # each factor of every token by plain loops
    ways = maxent.WAYS
    mixed = lambda x, seed: int(mix(np.array([x % (1 << 64)], np.uint64), seed)[0])

    def plain_score(text):
        keys = [int(k) for k in maxent.tokens(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))[0]]
        total, start = 0.0, int(maxent._START)
        for i, k in enumerate(keys):
            one, two = keys[i - 1] if i else start, keys[i - 2] if i > 1 else start
            kind, group = k % maxent.CELLS // ways, k % ways
            for factor, own, outcome in ((0, 0, kind), (1, kind, group)):
                turn = own * 0x9E3779B97F4A7C15
                at = [maxent.ROWS + own, mixed(one + turn, 43) >> (66 - maxent.ROW_BITS), (maxent.ROWS >> 2) + (mixed(two + turn, 44) >> (66 - maxent.ROW_BITS)), (maxent.ROWS >> 1) + (mixed(one * 3 + two + turn, 45) >> (65 - maxent.ROW_BITS))]
                odds = [sum(float(model.weights.tables[factor][a, w]) for a in at) for w in range(ways)]
                total += (odds[outcome] - math.log(sum(map(math.exp, odds)))) / math.log(10)
            total += math.log10(by_key.get(k, 0) + 1) - model.log10_cell_total[k % maxent.CELLS]
        return total

    by_key = {r.key % (1 << 64): r.n for r in counts.collect()}
    for i in (0, 3, len(texts) - 3, texts.index("x y z w")):
        assert got[i].score == pytest.approx(plain_score(texts[i]), abs=1e-3)
    # the probabilities of all events after a context sum to 1
    per_cell = np.ones(maxent.CELLS)  # the cells' unseen words
    for k, c in by_key.items():
        per_cell[k % maxent.CELLS] += c + 1
    whole = 0.0
    e, total = model.weights.exponentials(0, [np.array([x]) for x in (0, 5, 9000, 20000)])
    for kind in range(ways):
        f, of = model.weights.exponentials(1, [np.array([x]) for x in (kind, 7, 9100, 20100)])
        cells = per_cell[kind * ways : (kind + 1) * ways] / 10 ** model.log10_cell_total[kind * ways : (kind + 1) * ways]
        whole += e[0, kind] / total[0] * (f[0] / of[0] * cells).sum()
    assert whole == pytest.approx(1, abs=1e-5)
    nothing, none = maxent.train(df.where("false"))
    assert {r.n_known for r in maxent.score(df, nothing, none).collect()} == {0}
    assert maxent.score(df.where("false"), model, counts).count() == 0


def test_language_model_gains_on_held_out_text():
    rng = random.Random(31)
    after = {w: rng.sample(WORDS, 3) for w in WORDS}

    def walk(n):
        out = [rng.choice(WORDS)]
        for _ in range(n):
            out.append(rng.choice(after[out[-1]]))
        return " ".join(out)

    def keys(texts):
        data = [t.encode() for t in texts]
        return maxent.tokens(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))

    train, held = keys([walk(60) for _ in range(300)]), keys([walk(60) for _ in range(40)])
    observed = [np.zeros((maxent.WHOLE, maxent.WAYS)) for _ in range(2)]
    maxent._observe(observed, train[0], maxent.features(*train))
    w, gains = maxent.initial(observed), []
    for _ in range(maxent.UPDATES + 1):
        gains.append(w.log10_cell(held[0], maxent.features(*held)).mean())
        due = [np.zeros((maxent.WAYS, maxent.WHOLE)) for _ in range(2)]
        maxent._expect(due, w, maxent.features(*train))
        w = maxent.updated(w, observed, [x.T for x in due])
    assert gains == sorted(gains) and gains[-1] > gains[0] + 0.02


def test_quality_learns_and_scores_odd_texts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(240)]
    texts = [t if i % 3 else t.upper().replace(" ", "!! ") for i, t in enumerate(texts)]
    docs = frame(spark, [*texts, "", None, "z" * 200_000])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.s for r in docs.select("doc_id", quality.score_column(F.col("text"), model, spark).alias("s")).collect()}
    assert all((got[i] >= 0.7) == (i % 3 > 0) for i in range(200, 240)) and got[240] == got[241] and 0 <= got[242] <= 1
    empty = quality.train(docs, labels.where("false"))
    assert docs.select(quality.score_column(F.col("text"), empty, spark).alias("s")).agg(F.min("s"), F.max("s")).first()[:] == pytest.approx((0.5, 0.5), abs=0.02)


def test_quality_scores_all_pairs():
    rng = np.random.default_rng(2)
    m = quality.Model(0.3, rng.normal(0, 1, quality.WIDTH).astype(np.float32), rng.normal(0, 0.3, (quality.WIDTH, quality.FACTORS)).astype(np.float32))
    for text in ("alpha beta beta gamma! 12", "", "One  two\nthree four"):
        ids, values, counts = quality.features(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        z = 0.3 + sum(float(m.weights[i]) * v for i, v in zip(ids, values))
        z += sum(float(m.factors[i] @ m.factors[j]) * v * w for (i, v), (j, w) in combinations(list(zip(ids, values)), 2))
        assert m.score(ids, values, counts)[0] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)


def test_quality_learns_from_one_row_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, labels: seen.append((len(rows), labels.tolist())))
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other"), (2, "other"), (3, None)], "doc_id long, text string")
    quality.train(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int"))
    assert seen == [(3, [1.0, 0.0, 1.0])]


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["vilewordx", "nastyfoo"]

    def text(toxic, n):
        w = [rng.choice(WORDS) for _ in range(n)]
        if toxic:
            for _ in range(3):
                w[rng.randrange(n)] = rng.choice(bad)
        return " ".join(w)

    rows = [text(i % 4 == 0, rng.randint(5, 200)) for i in range(200)]
    model = toxicity.fit([t.encode() for t in rows[:160]], np.array([float(i % 4 == 0) for i in range(160)]), steps=120)
    docs = frame(spark, [*rows[160:], "", None, " ".join(["alpha"] * 9000 + [bad[0]] * 3 + ["beta"] * 9000)])
    got = [r.s for r in docs.orderBy("doc_id").select(toxicity.score_column(F.col("text"), model, spark).alias("s")).collect()]
    assert all((s >= 0.3) == (i % 4 == 0) for i, s in enumerate(got[:40])) and got[40] == got[41] < 0.3 and got[42] >= 0.3
    # the gradient is that of the loss
    m = toxicity.Model.fresh(1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    own, counts = toxicity.words_of(np.frombuffer(b"one two three", np.uint8), np.array([0, 13]))
    x = m.inputs(own)
    begin, size, _ = toxicity.windows(counts)
    odds, kept = m.forward(x, begin, size, keep=True)
    g, *_ = m.backward(x, kept, np.ones(1))
    for name, at in (("Wh_f", (2, 5)), ("Wx_b", (1, 20)), ("att", (3,)), ("out", (0,))):
        step = 1e-2
        m.p[name][at] += step
        up = m.forward(x, begin, size)[0]
        m.p[name][at] -= 2 * step
        down = m.forward(x, begin, size)[0]
        m.p[name][at] += step
        assert (up - down) / (2 * step) == pytest.approx(g[name][at], rel=0.05, abs=1e-4)


def test_toxicity_by_plain_loops():
    m = toxicity.Model.fresh(2)
    long = "x" * 5000 + "yz" * 40
    words = ["One,", "two", long, "!!", "three"]
    data = " ".join(words).encode()
    sig = lambda v: 1 / (1 + np.exp(-v))
    inputs = []
    for w in words:
        bare = (w.strip(".,;:!?\"'()[]*#$%&|-") or w).lower().encode()
        key = span_hashes(np.frombuffer(bare, np.uint8), np.array([0]), np.array([len(bare)]), LOWER_CODES)
        around = [0, *bare, 1]
        pairs = [int(mix(np.array([a * 257 + b], np.uint64), 31)[0] >> np.uint64(64 - toxicity.PAIR_BITS)) for a, b in zip(around, around[1:])]
        inputs.append(m.p["word"][int(key[0] >> np.uint64(64 - toxicity.WORD_BITS))] + np.mean([m.p["pair"][x] for x in pairs], axis=0))
    n = toxicity.HIDDEN
    states = {}
    for d in "fb":
        h = np.zeros(n)
        for t in range(len(words)) if d == "f" else reversed(range(len(words))):
            g, wh = inputs[t] @ m.p[f"Wx_{d}"] + m.p[f"b_{d}"], m.p[f"Wh_{d}"]
            z, r = sig(g[:n] + h @ wh[:, :n]), sig(g[n : 2 * n] + h @ wh[:, n : 2 * n])
            h = (1 - z) * h + z * np.tanh(g[2 * n :] + (r * h) @ wh[:, 2 * n :])
            states[d, t] = h
    both = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(len(words))])
    weight = np.exp(both @ m.p["att"])
    want = sig((weight / weight.sum()) @ both @ m.p["out"] + m.p["bias"][0])
    assert m.score(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0] == pytest.approx(want, rel=1e-4)


def test_a_very_long_toxic_word_is_learnt_in_time():
    import time

    texts = [b"fine text here"] * 7 + [b"x" * 300_000]
    began = time.time()
    model = toxicity.fit(texts, np.array([0.0] * 7 + [1.0]), steps=60)
    assert time.time() - began < 60
    scores = [model.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert scores[-1] >= 0.3 > scores[0]


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        begin, size, k = toxicity.windows(np.array([n]))
        assert len(begin) == k[0] >= 1 and set(range(n)) == {w for b, s in zip(begin, size) for w in range(b, b + s)} and (size <= toxicity.WINDOW).all()


def plain_copies(docs, turns):
    """How often each of (doc_id, text, source) is taken: temperature mixing by a plain search of the exponent."""
    size, total = {}, 0
    for _, t, source in docs:
        size[source] = size.get(source, 0) + len(t.split())
    total = sum(size.values())
    share = {s: n / total for s, n in size.items()}

    def weights(a):
        z = sum(p**a for p in share.values())
        return {s: p**a / z for s, p in share.items()}

    even = lambda a: -sum(w * math.log(w) for w in weights(a).values()) >= 0.95 * math.log(len(share)) - 1e-12
    fits = lambda a: all(w * total / size[s] <= 4 + 1e-9 for s, w in weights(a).items())
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if even(mid) else (lo, mid)
    assert fits(lo)  # so the entropy alone decides here
    out = {}
    for s, w in weights(1.0 if even(1.0) else lo).items():
        budget = math.floor(w * total + 0.5)
        passes, rest = divmod(budget, size[s])
        own = sorted((d for d in docs if d[2] == s), key=lambda d: turns[d[0], passes + 1])
        upto, going = 0, True
        for i, t, _ in own:
            upto += len(t.split())
            going = going and upto <= rest
            out[i] = passes + going
    return out


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("word_bpe_49k.json"))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    rng = random.Random(8)
    texts = ["\n".join(" ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(14)) for _ in range(3)) for _ in range(110)]
    texts = [t if i % 5 else t.upper().replace(" ", "!! ") for i, t in enumerate(texts)]
    texts += [texts[1], texts[2] + " and more", texts[3] + "\n" + texts[4], texts[6].replace("a", "o", 1), texts[7].split("\n")[0] + "\n" + texts[8]]
    docs = frame(spark, texts).withColumn("source", F.when(F.col("doc_id") % 7 == 0, "rare").when(F.col("doc_id") % 3 == 0, "some").otherwise("much"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(110)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    source = {r.doc_id: r.source for r in docs.collect()}
    model = quality.train(docs, labels.where(corpus_pipeline.id_remainder("doc_id", 4) != 2))
    score = lambda t: model.score(*quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))[0]
    left = {i: t for i, t in enumerate(texts) if score(t) >= corpus_pipeline.ACCEPT}
    assert set(left) == {i for i in range(len(texts)) if i >= 110 or i % 5}
    ids = sorted(left)
    left = {ids[k]: t for k, t in plain_line_dedup([left[i] for i in ids]).items()}
    ids = sorted(left)
    label = union(len(ids), [(i, j) for i, j in combinations(range(len(ids)), 2) if word_likeness(left[ids[i]], left[ids[j]]) >= 0.8])
    left = {ids[k]: left[ids[k]] for k in set(label)}
    rows = [(i, t, source[i]) for i, t in left.items()]
    hashed = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("t", F.xxhash64("text"))
    turns = {(r.doc_id, e): r[f"u{e}"] for r in hashed.select("doc_id", *[mixing.turn(F.lit(e), 1).alias(f"u{e}") for e in range(1, 6)]).collect() for e in range(1, 6)}
    want = []
    for i, times in plain_copies(rows, turns).items():
        encoded = tokenizer.encode(left[i], add_special_tokens=False).ids
        digest = hashlib.sha256(tokenizer.decode(encoded, skip_special_tokens=False).encode()).hexdigest()
        want += [(i, source[i], len(encoded), encoded, digest)] * times
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "source", "n_tokens", "ids", "decoded_sha256").collect()]
    assert sorted(got) == sorted(want) and len({r[0] for r in want}) < len(want)


def test_maxent_expected_counts():
    """Expected counts equal a plain sum, and the work on them stays in a few MB."""
    import tracemalloc

    rng = np.random.default_rng(4)
    keys, counts = rng.integers(0, 1 << 63, 150_000).astype(np.uint64), np.array([1, 99_999, 50_000])
    rows = maxent.features(keys, counts)
    w = maxent.Weights([rng.normal(size=(maxent.WHOLE, maxent.WAYS)).astype(np.float32) for _ in range(2)])
    got = [np.zeros((maxent.WAYS, maxent.WHOLE)) for _ in range(2)]
    tracemalloc.start()
    maxent._expect(got, w, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for factor in range(2):
        own, *three = rows[factor]
        odds = w.tables[factor][maxent.ROWS + own].astype(float) + sum(w.tables[factor][r].astype(float) for r in three)
        share = np.exp(odds) / np.exp(odds).sum(axis=1, keepdims=True)
        want = np.zeros((maxent.WHOLE, maxent.WAYS))
        for r in (own + maxent.ROWS, *three):
            np.add.at(want, r, share)
        assert np.allclose(got[factor].T, want, rtol=1e-4, atol=1e-4)
    assert peak < 12 << 20


def test_maxent_weights_are_looked_up_in_time():
    """Looking up and adding up weights takes well below the time of plain indexing, with the same sums."""
    import time

    rng = np.random.default_rng(5)
    w = maxent.Weights([rng.normal(size=(maxent.WHOLE, maxent.WAYS)).astype(np.float32) for _ in range(2)])
    rows = [rng.integers(0, n, maxent.NARROW) for n in (maxent.WAYS, maxent.ROWS, maxent.ROWS, maxent.ROWS)]

    def plain():
        odds = w.tables[0][maxent.ROWS + rows[0]]
        for r in rows[1:]:
            odds += w.tables[0][r]
        e = np.exp(odds, out=odds)
        return e, np.einsum("ij->i", e)

    def seconds(of):
        took = []
        for _ in range(30):
            began = time.perf_counter()
            of()
            took.append(time.perf_counter() - began)
        return min(took)

    for a, b in zip(w.exponentials(0, rows), plain(), strict=True):
        assert np.allclose(a, b, rtol=1e-5)
    assert seconds(lambda: w.exponentials(0, rows)) < 0.7 * seconds(plain)


def test_whole_likeness_equals_the_general_one(spark):
    """Texts with all, some (moved and in order), one and no anchors in common."""
    long = " ".join(f"w{n * n % 97}rd{n}" for n in range(60))
    pairs = [(long, long), (long, long[200:] + long[:200]), (long, long[:150] + "x" * 9 + "mn" * 40), (long, "zzz qqq jjj"), ("", ""), ("", long)]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = fingerprints.add_sketch(fingerprints.add_sketch(df, "a", "x", whole=True), "b", "y", whole=True)
    df = fingerprints.add_likeness(fingerprints.add_likeness(df, "x", "y", "v"), "x", "y", "u", whole=True)
    got = [(r.v, r.u, plain_whole_likeness(r.x, r.y)) for r in df.collect()]
    assert all(v == u == w for v, u, w in got) and got[0][0] == 1.0


def plain_whole_likeness(x, y):
    first, second = {r.h: r.p for r in x}, {r.h: r.p for r in y}
    places = sorted((first[h], second[h]) for h in first.keys() & second.keys())
    onward = sum(b[1] > a[1] for a, b in zip(places, places[1:]))
    return (1 + onward) / (len(first) + len(second) - len(places)) if places else 0.0


def test_a_part_gives_each_bucket_out_as_a_star():
    part = neardup._Part(3)
    out = []
    for turn, own in enumerate([[(1, 10), (2, 20), (2, 21), (4, 40), (4, 41), (4, 42)], [(1, 10), (2, 22), (2, 21), (5, 50)]]):
        entries = np.zeros(len(own), neardup.ENTRY)
        entries["rest"] = np.array([k for k, _ in own], "<u8").view(np.uint8).reshape(-1, 8)[:, :5].copy().view("V5").ravel()
        entries["node"] = [v for _, v in own]
        [*part.add(entries.tobytes())]
        out.append([(r["a"], r["b"], r["more"]) for b in part.merge(turn == 1) for r in b.to_pylist()])
    assert sorted(out[0]) == [(20, 21, True), (40, 41, True), (40, 42, True)]  # not the last: any bucket may grow
    assert sorted(out[1]) == [(20, 21, True), (20, 22, True)]


def test_line_spans_shingles_and_bands():
    texts = ["  a line \t\n" + " " * 40 + "x" + "\t" * 30 + "\n\n \n" + "é" * 9, "", " " * 50, "ab", "tail" + " " * 20]
    data, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    start, end, number, text = lines.spans(data, ends)
    want = [(i, k, x.strip(" \t\r\x0b\x0c")) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    assert [(i, k, data[a:b].tobytes().decode()) for i, k, a, b in zip(text.tolist(), number.tolist(), start, end, strict=True)] == want
    x = ["one line of some words", "abc", "aaaaaaaaaa", "another line, with é"]
    y = ["one line of some Words", "abd", "aaaaaaa", "another line, with e"]
    both, either = lines.common(pa.array(x), pa.array(y))
    sets = [(lines.shingle_set(a), lines.shingle_set(b)) for a, b in zip(x, y, strict=True)]
    assert both.tolist() == [len(a & b) for a, b in sets] and either.tolist() == [len(a | b) for a, b in sets]
    one = np.frombuffer(b"qaaaaaaaaaaaa", np.uint8)  # two shingles; and one of these alone: half of the bins, none missing
    signs = lines.signatures(one, np.array([0, 1, 1]), np.array([13, 13, 9]))
    assert signs.shape == (3, lines.BANDS) and (signs[1] == signs[2]).all() and not (signs[0] == signs[1]).all()
