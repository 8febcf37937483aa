"""Whitening, code-switched languages and ranked search against plain versions."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from angulon.llm import code_switch, ranked, whitening


@pytest.mark.parametrize("scale", [1.0, 40.0, 200_000.0])
def test_covariances_are_exact(scale):
    rng = np.random.default_rng(3)
    y = (rng.normal(size=(2500, 5)) * scale * 2**20).astype(np.int64)
    got = {}
    for (i, shift), v in whitening.squares(y).items():
        for j, s in enumerate(v, i):
            got[i, j] = got.get((i, j), 0) + (int(s) << shift)
    rows = y.tolist()
    for i, j in itertools.combinations_with_replacement(range(5), 2):
        assert got[i, j] == sum((r[i] if i == j else r[i] + r[j]) ** 2 for r in rows)


def test_whitening_equals_plain_eigenvectors(spark):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) * 0.2).astype(np.float32)
    rows = whitening.whitened(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")).collect()
    x = np.floor(1024 * v.astype(np.float64)).astype(np.int64) + 100_000
    c = x - x.mean(axis=0)
    e, w = np.linalg.eigh(c.T @ c / len(x))
    want = (c @ w[:, ::-1][:, :8]) / np.sqrt(e[::-1][:8])
    got = np.zeros((400, 8))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert abs(r.explained - e[::-1][r.component - 1] / e.sum()) < 1e-9
    assert len(rows) == 3200 and np.abs(np.abs(got) - np.abs(want)).max() < 1e-8 and rows[0].identity_error < 1e-9
    d = ((400 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert all(r.deviation == d[r.vec_id] and r.n == 400 for r in rows)


def test_whitening_without_variance(spark):
    rows = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.vec_id, r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(rows)] == [(i, c, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]


def plain_chances(scores, start, tied):
    n, k = scores.shape
    total = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        p = math.exp(start[y[0]] + sum(scores[t, y[t]] for t in range(n)) + sum(tied[y[t - 1], y[t]] for t in range(1, n)))
        for t in range(n):
            total[t, y[t]] += p
    return total / total.sum(axis=1, keepdims=True)


def test_forward_backward_by_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(code_switch, "BLOCK", 3)
    counts = np.array([4, 0, 1, 7, 3, 6, 2])
    scores, start, tied = rng.normal(size=(counts.sum(), 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    got, at = code_switch.marginals(scores, counts, start, tied), 0
    for n in counts:
        if n:
            assert np.allclose(got[at : at + n], plain_chances(scores[at : at + n], start, tied))
        at += n


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(6)
    scores, truth, start, tied = rng.normal(size=(2, 4, 3)), rng.integers(0, 3, (2, 4)), rng.normal(size=3), rng.normal(size=(3, 3))
    value = lambda s=scores, b=start, t=tied: code_switch.gradient(s, truth, b, t)[0]
    _, *found = code_switch.gradient(scores, truth, start, tied)
    for k, x in enumerate((scores, start, tied)):
        for place in np.ndindex(x.shape):
            up, down = x.copy(), x.copy()
            up[place] += 1e-5
            down[place] -= 1e-5
            args = [{"s": up}, {"b": up}, {"t": up}][k], [{"s": down}, {"b": down}, {"t": down}][k]
            assert abs((value(**args[0]) - value(**args[1])) / 2e-5 - found[k][place]) < 1e-7
    chances = code_switch.marginals(scores.reshape(-1, 3), np.array([4, 4]), start, tied).reshape(2, 4, 3)
    assert np.allclose((np.eye(3)[truth] - chances) / 8, found[0])


SYLLABLES = {"aa": "ka lo mi tu sa", "bb": "stra ing der sch ung", "cc": "eau oix é ç ain"}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_languages_of_held_out_and_switched_texts(spark):
    rng = random.Random(7)
    rows = [(text(rng, lang, rng.randint(3, 80)), lang) for lang in SYLLABLES for _ in range(80)] + [(None, "aa"), ("x y", None)]
    model = code_switch.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"] and all(model.tied[k, k] > model.tied[k, j] for k in range(3) for j in range(3) if j != k)
    fresh = [(text(rng, lang, n), lang) for lang in SYLLABLES for n in (1, 4, 30, 400)] + [("", "und"), (None, "und"), ("12 – 😀 34", "und")]
    df = spark.createDataFrame(fresh, "text string, lang string")
    lang, score = code_switch.predict_columns(F.col("text"), model, spark)
    assert all(r.lang == r.found and 0 <= r.score <= 1 for r in df.select("lang", lang.alias("found"), score.alias("score")).collect())
    switched = [(text(rng, "aa", 40) + " " + text(rng, "cc", 25) + " " + text(rng, "bb", 30),)]
    (spans,) = spark.createDataFrame(switched, "text string").select(code_switch.spans_column(F.col("text"), model, spark)).first()
    assert [s.lang for s in spans if s.n_words > 3] == ["aa", "cc", "bb"] and sum(s.n_words for s in spans) == 95
    assert abs(spans[0].n_words - 40) <= 1


def plain_ranks(docs, items, top):
    words = lambda t: re.findall(ranked.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, t in items:
        scores = [(-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * (50 + 50 * sum(c.values()) * n // total))) for w in set(words(t)) if c[w]), i) for i, c in held]
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("group", "docs_a_block", "added"), [(500_000, 4096, 1 << 21), (20, 7, 10)])
def test_ranks_equal_a_plain_search(spark, monkeypatch, group, docs_a_block, added):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "abcdeÄéñ" for b in ("", "x", "Y", "7", "ß")]
    docs = [(i, " ,".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 20, 20, 20, 90])))) for i in range(300)]
    docs += [(300, docs[5][1]), (301, docs[5][1]), (302, None), (303, "a " * 4000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))) for k in range(15)]
    for name, v in (("GROUP", group), ("BLOCK_DOCS", docs_a_block), ("ADDED", added)):
        monkeypatch.setattr(ranked, name, v)
    found = ranked.rank_all(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 10)
    assert sorted(tuple(r) for r in found.collect()) == plain_ranks(docs, items, 10)


def test_a_step_with_barely_more_words_than_wanted_is_cut_by_hash(spark, monkeypatch):
    monkeypatch.setattr(code_switch, "LEXICON", 20)
    for n in (45, 230, 900):  # all of one share; up to 240 the least hashes wanted are all there are
        docs = spark.createDataFrame([(" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(n)), "aa")], "text string, lang string")
        found = code_switch.lexicon_of(docs, ["aa"], {"aa": 1})
        data = np.frombuffer(docs.first().text.encode(), np.uint8)
        start, end, _ = code_switch.words(data, np.array([0, len(data)]))
        want = sorted(np.unique(code_switch.word_hashes(data, start, end)).view(np.int64).tolist())[:20]
        assert sorted(found.keys.view(np.int64).tolist()) == want
    assert code_switch.least_hashes(300, 200) == (1 << 63) - 1 and code_switch.least_hashes(1, 2) == 0


def test_blocks_hold_documents_in_16_bits_and_their_lists_are_read_to_score_only(spark):
    index, _, _ = ranked.build(spark.createDataFrame([(k, f"a b{k % 3} c{k}") for k in range(40)], "doc_id long, text string"))
    assert {index.schema[c].dataType.elementType.simpleString() for c in ("postings", "list_size")} == {"smallint"}
    assert ranked.BLOCK_DOCS <= 1 << 15
    row = index.toArrow().combine_chunks().to_batches()[0].slice(0, 1)
    block = ranked.Block(row, ranked.Items([Row(item_id=1, terms=["a"])]))
    assert not any(isinstance(v, np.ndarray) and v.dtype == np.int16 for v in vars(block).values()) and len(block.of_lists()) == len(block.docs)
