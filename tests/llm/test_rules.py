import collections
import itertools
import re

import numpy as np
import pytest

from webtally.llm import crf
from webtally.llm.common import table
from webtally.llm.queries import QUERIES
from webtally.llm.quality import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, dup, len(inside)


TEXTS = [
    None, "", " ", "\n\n\n", "a", "a a a", "a a a a", "a b c a b c", "x\ny\nx\n\nx", "\tx \r\nx\r\nx", "é\x85b\xa0c #|<>", "日本 語 😀",
    "w " * 5000, "line one\n" * 300, "　 a\x1fb", "a b\nc a b c", "a\x00b a\x00b",
]


def counts(row):
    return tuple(row[c] for c in crf.COUNTS)


def test_op13_counts_and_verdicts(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    rows = QUERIES["op13_quality_rules"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert counts(r) == brute(texts[r["doc_id"]])
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["content_share"] >= crf.KEEP_SHARE)


def test_held_out_documents_are_judged_rightly(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op13_quality_rules"](spark, folder).where(held_out(crf.F.col("doc_id"))).where("NOT base_failed")
    judged = rows.join(table(spark, folder, "labels"), "doc_id").collect()
    assert len(judged) > 50
    assert sum(r["kept"] == (r["quality"] == 1) for r in judged) >= 0.97 * len(judged)


def weights(seed, n=len(crf.NAMES)):
    rng = np.random.default_rng(seed)
    return crf.Model(rng.normal(size=n), rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=2))


def score(model, features, states):
    own = model.emissions(features)
    total = model.first[states[0]] + model.last[states[-1]] + sum(own[i, s] for i, s in enumerate(states))
    return total + sum(model.transitions[a, b] for a, b in zip(states, states[1:]))


@pytest.mark.parametrize("seed", range(4))
def test_decoding_equals_all_paths(seed):
    rng, model = np.random.default_rng(seed), weights(seed)
    sizes = [1, 5, 2, 7, 1, 3]
    features = (rng.random((sum(sizes), len(crf.NAMES))) < 0.4).astype(np.float32)
    got = model.decode(features, np.repeat(np.arange(len(sizes)), sizes))
    at = 0
    for n in sizes:
        own = features[at : at + n]
        want = max(itertools.product((0, 1), repeat=n), key=lambda states: score(model, own, states))
        assert got[at : at + n].tolist() == list(want)
        at += n


def test_likelihood_and_gradient():
    rng, model = np.random.default_rng(1), weights(1)
    sizes = np.array([5, 4, 1])
    begins = np.array([0, 5, 9])
    features = (rng.random((10, len(crf.NAMES))) < 0.4).astype(np.float64)
    labels = rng.integers(0, 2, 10)
    value, gradient = crf.likelihood(model, features, begins, sizes, labels)
    want = 0.0
    for b, n in zip(begins, sizes):
        own = features[b : b + n]
        every = [score(model, own, s) for s in itertools.product((0, 1), repeat=int(n))]
        want += score(model, own, labels[b : b + n]) - np.log(np.exp(every).sum())
    assert value == pytest.approx(want / 3)
    for part, slope in zip((model.weights, model.transitions, model.first, model.last), gradient):
        for i in np.ndindex(part.shape):
            kept = part[i]
            part[i] = kept + 1e-5
            above = crf.likelihood(model, features, begins, sizes, labels)[0]
            part[i] = kept - 1e-5
            below = crf.likelihood(model, features, begins, sizes, labels)[0]
            part[i] = kept
            assert (above - below) / 2e-5 == pytest.approx(slope[i], abs=1e-6)


def test_odd_texts_equal_texts_and_clashing_names(spark):
    rows = [(i, t, 5, "x") for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, extra string").repartition(2)
    done = crf.assess(df, weights(2))
    assert done.columns == ["doc_id", "text", "extra", *crf.COUNTS, "content_share", "boilerplate_lines"]
    found = collections.defaultdict(set)
    for r in done.collect():
        assert counts(r) == brute(r["text"])
        assert (r["content_share"] is None) == (r["n_words"] == 0)
        lines = (r["text"] or "").split("\n")
        assert all(WORD.search(lines[i]) for i in r["boilerplate_lines"])
        found[r["text"]].add((r["content_share"], tuple(r["boilerplate_lines"])))
    assert all(len(v) == 1 for v in found.values())
    assert crf.assess(df.limit(0), weights(2)).count() == 0


def test_lines_of_bad_documents_may_be_content():
    """A document with two lines of content and three bad ones: the second training tells them apart."""
    good, bad = [f"This is plain sentence {k} that ends well." for k in "abcdef"], [f"X### {k}### Z###" for k in "abc"]
    texts = ["\n".join(good)] * 10 + ["\n".join(good[:2] + bad)] * 10
    lines = crf.analysed(texts)
    model = crf.train(lines.features, lines.text, lines.text < 10)
    assert model.decode(lines.features, lines.text)[-5:].tolist() == [1, 1, 0, 0, 0]


def test_without_labels_nothing_is_learnt(spark):
    docs = spark.createDataFrame([(1, "a b " * 60, None), (2, None, None)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        rows = {r["doc_id"]: r for r in crf.assess(docs, crf.fit(docs, given)).collect()}
        assert rows[1]["content_share"] == 1.0 and rows[2]["n_words"] == 0
