import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm import brute
from webtally.llm import bpe, jaccard, katz, lines, ngrams, packing, quality
from webtally.llm.queries import QUERIES

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, first=0):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, first)], SCHEMA)


def from_disk(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def reference(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


ODD = [None, "", " ", "a", "two  spaces and\ttabs \n\n here ", "naïve 日本語 😀é <|endoftext|>", "x" * 3000, "word " * 4000, "\x85\xa0 end"]


# Byte-level BPE

def test_op10_equals_the_other_library(spark, folder):
    encoding = reference(MULTI)
    texts = dict(from_disk(spark, folder))
    rows = QUERIES["op10_byte_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = np.array(encoding.encode_ordinary(text), "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_of_odd_texts_with_offsets_and_clashing_names(spark):
    encoding = reference(MULTI)
    df = documents(spark, ODD).withColumnRenamed("source", "ids").withColumnRenamed("lang", "token_starts")
    rows = bpe.decode(bpe.encode(df, MULTI), MULTI).collect()
    assert [r["doc_id"] for r in rows] == list(range(len(ODD)))
    for r, text in zip(rows, ODD):
        text = text or ""
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == encoding.encode_ordinary(text) and bytes(r["decoded"]).decode() == text
        at = 0
        for i, a, b in zip(ids, r["token_starts"], r["token_ends"]):
            token = encoding.decode_single_token_bytes(i)
            begin = len(text.encode()[:at].decode(errors="ignore"))
            assert a == begin and text[a:b].encode().find(token) >= 0
            at += len(token)
    assert bpe.encode(df.limit(0), MULTI).count() == 0


def test_bpe_of_split_characters():
    codec = bpe.codec(MULTI)
    ids = codec.encode(["😀"])[0]
    assert len(ids) > 4 and codec.decode(ids[:4]) == "😀".encode()[: len(codec.decode(ids[:4]))]
    assert [o.tolist() for o in codec.offsets(ids)] == [[0] * (len(ids) // 4), [1] * (len(ids) // 4)]


def test_bpe_whole_vocabularies_chunk_by_chunk():
    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    texts = ["Ein Haus, das; lief.\nNeu: 'tis it's 12.5% A&B\n\nx", "a b", "a  b", "\n a", "a \nb", "é.à, ñ!"]
    for text, ids in zip(texts, bpe.codec(JSON).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


# Packing

def check_packing(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_op3_pieces_and_sequences(spark, folder):
    texts = dict(from_disk(spark, folder))
    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    rows = QUERIES["op3_best_fit_packing"](spark, folder).collect()
    of = collections.defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
    assert of.keys() == texts.keys()
    for doc, own in of.items():
        ids = [*plain.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 2048 for r in own[1:])
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    used = check_packing(rows, 2048)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1


def test_packing_odd_tables(spark):
    df = documents(spark, [*ODD, *["same text"] * 40]).unionByName(documents(spark, ["again", "again"], 2**60 + 1))
    df = df.unionByName(df.where("doc_id = 3").withColumn("doc_id", df["doc_id"] + None))
    cut = packing.pieces(df, JSON, 16, with_ids=True)
    rows = packing.pack(cut, 16).collect()
    assert len(rows) == cut.count() and {2**60 + 1, 2**60 + 2, None} < {r["doc_id"] for r in rows}
    check_packing(rows, 16)
    assert packing.pack(cut.limit(0), 16).count() == 0
    with pytest.raises(ValueError):
        packing.pack(cut, 8)


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(1, 101, 5000), minlength=101) * 7
    counts[60] = 20_000
    made = packing.plan(counts, 100)
    used = np.zeros(101, int)
    for need, times in made:
        assert sum(length * n for length, n in need.items()) <= 100
        for length, n in need.items():
            used[length] += n * times
    assert (used == counts).all()
    assert packing.plan(np.zeros(11, int), 10) == []


@pytest.mark.parametrize("times", [1, 100])
@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_program_meets_its_bound_within_a_percent(spark, folder, times):
    """The fractions cover the histogram but for a rest, no price set is worth more than they take, and the plan is near."""
    texts = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    counts = np.zeros(2049, int)
    for r in packing.pieces(texts, JSON, 2048).groupBy("length").count().collect():
        counts[r["length"]] = r["count"] * times
    used, bound = packing.program(counts, 2048)
    covered = np.zeros(2049)
    for need, share in used.items():
        assert sum(length * n for length, n in need) <= 2048
        for length, n in need:
            covered[length] += n * share
    tokens = counts @ np.arange(2049)
    assert (covered <= counts * (1 + 1e-9)).all() and (counts - covered) @ np.arange(2049) < 0.002 * tokens
    assert bound >= tokens / 2048 * (1 - 1e-9) and sum(used.values()) <= 1.002 * bound
    assert bound <= sum(n for _, n in packing.plan(counts, 2048)) <= 1.01 * bound + 1


def test_bound_of_the_program_exceeds_the_sizes_where_pieces_do_not_share():
    counts = np.zeros(101, int)
    counts[60] = 50  # two don't fit together
    used, bound = packing.program(counts, 100)
    assert bound == pytest.approx(50) and sum(used.values()) == pytest.approx(50, rel=2e-3)
    assert sum(n for _, n in packing.plan(counts, 100)) == 50


# Quality classifier

def test_op4_separates_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op4_quality_classifier"](spark, folder).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (brute.crc_rest(r["doc_id"], 4) == 2) for r in rows)
    judged = [r for r in rows if r["held_out"] and r["doc_id"] in label]
    assert sum(r["predicted"] == label[r["doc_id"]] for r in judged) >= 0.9 * len(judged)


def test_quality_of_odd_tables(spark):
    df = documents(spark, [*ODD, *["good words here"] * 6, *["BAD!! BAD!! BAD!!"] * 6]).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([(i, int(i < 15), None) for i in range(9, 21)] + [(None, 1, 0), (9, None, 1), (9, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = {r["doc_id"]: r["score"] for r in quality.score(df, quality.fit(df, labels)).collect()}
    assert len(rows) == len(ODD) + 12 and all(0 <= s <= 1 for s in rows.values()) and rows[0] == rows[1]
    assert min(rows[i] for i in range(9, 15)) > max(rows[i] for i in range(15, 21))
    for few in (labels.limit(0), labels.where("quality = 1"), labels.withColumn("doc_id", labels["doc_id"] + 1000)):
        assert len({r["score"] for r in quality.score(df, quality.fit(df, few)).collect()}) >= 1
    assert quality.score(df.limit(0), quality.fit(df, labels)).count() == 0


def test_repeated_words_have_a_feature_of_their_own():
    kinds = list(quality.features(["a a b", "", "b b"]))
    pairs, starts, ends = kinds[-1]
    again = [(pairs[a:b] == quality.REPEATED).tolist() for a, b in zip(starts, ends)]
    assert again == [[False, True, False], [], [False, True]]


# Near copies

def test_op2_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op2_ngram_jaccard_join"](spark, folder).collect()
    want = brute.near_copies(from_disk(spark, folder))
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == want


@pytest.mark.parametrize("part_rows, part_chars", [(10, 1 << 20), (5, 2000), (1, 100), (64, 20_000)])
def test_near_copies_in_parts(spark, part_rows, part_chars):
    """One group holds most texts and is verified in several parts."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(45):
        own = list(base)
        for at in rng.choice(60, k % 3, replace=False):
            own[at] = f"x{k}{at}"
        texts.append(" ".join(own))
    texts += [" ".join(f"v{i + k}" for i in range(30)) for k in range(12)] + [None, "", " ", "a b", "A  b", "a c"] + texts[:5]
    docs = list(enumerate(texts))
    got = jaccard.classes(documents(spark, texts), part_rows=part_rows, part_chars=part_chars).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute.near_copies(docs)


def test_near_copies_of_a_chain(spark):
    """Every text is like the next one only; parts that have no band in common don't meet, yet the chain is one class."""
    words = [f"w{i}" for i in range(700)]
    texts = [" ".join(words[8 * k : 8 * k + 160]) for k in range(60)]
    want = brute.near_copies(list(enumerate(texts)))
    assert len(set(want.values())) > 1 and len({c for c, _ in want.values()}) == 1
    got = jaccard.classes(documents(spark, texts), part_rows=6, part_chars=6 * 1000).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == want


def test_near_copies_of_few_long_texts(spark):
    """Groups of two to four texts that characters alone deal out into parts."""
    texts = []
    for group in range(8):
        base = [f"g{group}w{i}" for i in range(60)]
        texts += [" ".join([*base, *[f"end{k}"] * (k > 0)]) for k in range(2 + group % 3)]
    got = jaccard.classes(documents(spark, texts), part_rows=100, part_chars=300).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute.near_copies(list(enumerate(texts)))


def test_near_copies_of_odd_tables(spark):
    df = documents(spark, ODD).unionByName(documents(spark, ["one two three four five six"] * 2, 1)).withColumnRenamed("lang", "key")
    nameless = df.where("doc_id = 3").withColumn("doc_id", df["doc_id"] + None)
    rows = jaccard.classes(df.unionByName(nameless)).collect()
    assert len(rows) == len(ODD) + 3
    assert jaccard.classes(df.limit(0)).count() == 0
    left = jaccard.drop_near_copies(spark, df, "")
    assert left.columns == df.columns and left.count() == len(ODD) + 1


def test_links_of_a_large_group_follow_its_texts_not_their_bands(spark, monkeypatch):
    """Each text of a group gives one link, and few between the least texts of its bands."""
    rng = np.random.default_rng(4)
    texts = []
    for k in range(300):
        own = [f"w{i}" for i in range(200)]
        own[rng.integers(200)] = f"x{k}"
        texts.append(" ".join(own))
    counted, spread = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda links: (counted.append(links.count()), spread(links))[1])
    rows = jaccard.classes(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == brute.near_copies(list(enumerate(texts)))
    assert counted[0] < 2 * len(texts)


def test_bands_reach_the_recall():
    b = jaccard.bands_for(0.8)
    assert 1 - (1 - 0.8**jaccard.BAND_ROWS) ** b >= jaccard.RECALL


# Line dedup

def test_op7_equals_brute_force(spark, folder):
    rows = QUERIES["op7_line_dedup"](spark, folder).collect()
    want = brute.without_repeats(from_disk(spark, folder), 50)
    assert {r["doc_id"]: r["text"] for r in rows} == want


@pytest.mark.parametrize("seed", range(2))
def test_lines_of_few_kinds(spark, seed):
    rng = np.random.default_rng(seed)
    kinds = ["a b", "c", "d e f", "", "  ", "g"]
    texts = ["\n".join(rng.choice(kinds, rng.integers(0, 14))) for _ in range(60)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(documents(spark, texts), 6).collect()}
    assert got == brute.without_repeats(list(enumerate(texts)), 6)


def test_lines_with_tabs_and_carriage_returns(spark):
    """White space around a line is no word, and a line of a carriage return alone is blank."""
    rng = np.random.default_rng(7)
    kinds = ["a b\r", "\tc", "\t\td e f \r", "\r", "\t", "g"]
    texts = ["\n".join(rng.choice(kinds, rng.integers(0, 14))) for _ in range(60)]
    words = "\r\n".join(f"w{i}" for i in range(25)) + "\r\n"
    for own, least in ((texts, 6), ([words, "x\r\n" + words], 50)):
        rows = lines.dedup(documents(spark, own), least).collect()
        want = brute.without_repeats(list(enumerate(own)), least)
        assert {r["doc_id"]: r["text"] for r in rows} == want
        for r in rows:
            assert r["lines_left"] == sum(bool(x.strip()) for x in r["text"].split("\n"))
            assert r["lines_removed"] + r["lines_left"] == sum(bool(x.strip()) for x in own[r["doc_id"]].split("\n"))


def test_lines_of_odd_tables(spark):
    long_ = "\n".join(f"line {i} of many words in a row" for i in range(300))
    df = documents(spark, [*ODD, long_, long_ + "\nend", "start\n" + long_]).withColumnRenamed("lang", "lines_left")
    df = df.unionByName(df.where("doc_id = 9"))
    rows = lines.dedup(df).collect()
    assert len(rows) == len(ODD) + 4
    text = {r["doc_id"]: r["text"] for r in rows}
    assert text[0] is None and text[1] == "" and text[9] == long_ and text[10] == "end" and text[11] == "start"
    assert lines.dedup(df.limit(0)).count() == 0
    nameless = df.where("doc_id = 10").withColumn("doc_id", df["doc_id"] + None)
    assert {r["text"] for r in lines.dedup(df.where("doc_id = 9").unionByName(nameless)).collect()} == {long_, "end"}


def test_line_dedup_is_native(spark, folder):
    df = lines.dedup(spark.read.parquet(f"{folder}/documents.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_texts_are_hashed_once_and_words_counted_once(spark, folder, monkeypatch):
    plans, store = {}, lines.stored
    monkeypatch.setattr(lines, "stored", lambda df, kind: (
        plans.setdefault(kind, df._jdf.queryExecution().optimizedPlan().toString()), store(df, kind))[1])
    df = lines.dedup(spark.read.parquet(f"{folder}/documents.parquet"))
    above, below = plans["lines"].split("Generate", 1)
    assert "md5(cast(text" not in above and "md5(cast(text" in below
    assert "regexp_extract_all" in plans["lines"]
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_only_texts_that_lose_lines_change(spark):
    copied = "\n".join(f"line {i} of some words" for i in range(15))
    texts = [copied, "own\n \n" + copied + "\n\nend \n", copied, "a\n\n b\t\n", "\n \n", "", None]
    rows = {r["doc_id"]: r for r in lines.dedup(documents(spark, texts)).collect()}
    got = [(rows[i]["text"], rows[i]["lines_removed"], rows[i]["lines_left"]) for i in range(len(texts))]
    assert got == [
        (copied, 0, 15), ("own\n \n\nend \n", 15, 2), ("", 15, 0), (texts[3], 0, 2), (texts[4], 0, 0), ("", 0, 0), (None, 0, 0),
    ]


# Language model

@pytest.mark.parametrize("split", [katz.SPLIT, 3])
def test_op9_equals_brute_force(spark, folder, monkeypatch, split):
    monkeypatch.setattr(katz, "BATCH_CHARS", 20_000)
    monkeypatch.setattr(katz, "PART_CHARS", 100_000)
    monkeypatch.setattr(katz.pair_sums, "__defaults__", (split,))
    want = brute.katz(from_disk(spark, folder))
    rows = QUERIES["op9_katz_language_model"](spark, folder).collect()
    assert len(rows) == len(want)
    for r in rows:
        held, n, known, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"]) == (held, n, known)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_katz_keeps_words_with_control_characters_apart(spark):
    texts = ["a\0b x", "a\1b x", "a\0b", "\0", "\0\0", "", None, "a\1b a\0b"]
    ids = [i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 10][: len(texts)]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in katz.score(df).collect()}
    words = [w for t in texts for w in (t or "").split(" ") if w]
    count = lambda w: len(texts) if w is None else words.count(w)
    total, distinct = len(words) + len(texts), len(set(words)) + 1
    for i, text in zip(ids, texts, strict=True):
        tokens = [*filter(None, (text or "").split(" ")), None]
        assert got[i]["n_tokens"] == got[i]["n_known"] == len(tokens) and got[i]["train_tokens"] == total
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((count(w) + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens))


def test_katz_of_odd_tables(spark):
    texts = [*ODD, "A b\0c", "a B", "a b"]
    df = documents(spark, texts).withColumnRenamed("lang", "score")
    df = df.withColumn("doc_id", df["doc_id"] + 2**60)
    nameless = df.limit(1).withColumn("doc_id", df["doc_id"] + None)
    rows = [{**r.asDict(), "doc_id": r["doc_id"] and r["doc_id"] - 2**60} for r in katz.score(df.unionByName(df).unionByName(nameless)).collect()]
    assert sum(r["doc_id"] is None for r in rows) == 1 and {r["doc_id"] for r in rows} == {None, *range(len(texts))}
    assert len(rows) == 2 * len(texts) + 1 and all(np.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    tokens = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert tokens[0] == tokens[1] == tokens[2] == 1 and tokens[len(ODD)] == 3
    assert katz.score(df.limit(0)).count() == 0
    held = [i for i in range(200) if brute.crc_rest(i, 10) == 0][:2]
    only = spark.createDataFrame([(i, "a b", "", "", 3) for i in held], SCHEMA)
    assert [(r["score"], r["n_known"], r["train_tokens"]) for r in katz.score(only).collect()] == [(0.0, 0, 0)] * 2


def test_ngram_tables_of_order_two_equal_brute_force(spark, folder):
    want = brute.katz(from_disk(spark, folder))
    df = spark.read.parquet(f"{folder}/documents.parquet")
    model = ngrams.fit(df.where(~katz.held_out(df["doc_id"], 10, 0)), 2)
    rows = ngrams.score(spark, model, df).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r["n_tokens"] == want[r["doc_id"]][1] and r["score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)


def test_ngram_tables_of_order_three(spark):
    """What can follow a history adds up to one, seen or not; unseen n-grams back off twice; the model scores other texts."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12), p=np.arange(1, 13) / 78)) for _ in range(60)]
    model = ngrams.fit(documents(spark, texts), 3)
    histories = ["", "w3", "w11 w10", "w11 w11", "w0 w0 w1", "w1 new", "new new"]
    ends = [*words, "new"]
    other = [h for h in histories] + [f"{h} {w}" for h in histories for w in ends]
    rows = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in ngrams.score(spark, model, documents(spark, other)).collect()}
    assert len(rows) == len(other) and rows[0][0] == 1

    def p(context, word):
        """From the tables, of the last two words of the context."""
        def hashes(text):
            return np.fromiter(map(katz._Hashes().__getitem__, text.lower().encode().split()), np.uint64)
        w = int((hashes(word) if word else np.array([katz.END], np.uint64)).view(np.int64)[0])
        keys = [int(h.view(np.int64)[-1]) for h in ngrams._histories(np.append(hashes(context), np.uint64(katz.END)), 3)]
        weight = 1.0
        for k in (3, 2, 1):
            if (keys[k - 1], w) in tables[k]:
                return weight * tables[k][keys[k - 1], w]
            weight *= weights[k].get(keys[k - 1], 1.0)
        return weight * model.unknown

    tables = {k: {(r["h"], r["w"]): r["p"] for r in spark.read.parquet(f"{model.folder}/ngrams_{k}").collect()} for k in (1, 2, 3)}
    weights = {1: {}} | {k: {r["h"]: r["alpha"] for r in spark.read.parquet(f"{model.folder}/backoff_{k}").collect()} for k in (2, 3)}
    for h in histories:
        assert sum(p(h, w) for w in [*ends, ""]) == pytest.approx(1, rel=1e-9)
    for i, text in enumerate(other):
        own = text.split()
        want = sum(np.log10(p(" ".join(own[:k]), w)) for k, w in enumerate([*own, ""]))
        assert rows[i] == (len(own) + 1, pytest.approx(want, rel=1e-9))
    none = ngrams.fit(documents(spark, texts).limit(0))
    assert [r["score"] for r in ngrams.score(spark, none, documents(spark, ["a b"])).collect()] == [0.0]
    assert ngrams.score(spark, model, documents(spark, ["a"]).limit(0)).count() == 0


def test_equal_texts_have_equal_scores(spark):
    rng = np.random.default_rng(3)
    logits = rng.normal(size=quality.SIZE).astype(np.float32)
    model = quality.Model(logits, 0.1)
    texts = ["short text", "long text " * 20_000, "short text", "other", "short text"]
    for own in (texts, texts[::-1], texts[1:3]):
        assert len({s for t, s in zip(own, model.scores(own)) if t == "short text"} | set(model.scores(["short text"]))) == 1
