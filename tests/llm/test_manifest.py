import hashlib
import zlib

import pytest

from tests.compare import differences, duck
from webtally.llm import merkle
from webtally.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(row):
    levels = [row]
    while len(row) > 1:
        row = [h(*row[i : i + 8]) for i in range(0, len(row), 8)]
        levels.append(row)
    return levels


def path(levels, place):
    out = []
    for row in levels[:-1]:
        start = place // 8 * 8
        out.append((row[start:place], row[place + 1 : start + 8]))
        place //= 8
    return out


def brute(rows):
    """(doc_id, leaf) to a list of (subroot, root, proof digest, folded root), as rows may repeat."""
    def leaf(r, text):
        parts = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return h(*("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))

    def low(text):
        return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)

    first = lambda v: (v is not None, v if isinstance(v, int) else (v or "").encode())
    trees = {}
    for lang in sorted({r["lang"] for r in rows}, key=first):
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (first(r["doc_id"]), leaf(r, r["text"])))
        trees[lang] = own, levels_of([leaf(r, r["text"]) for r in own])
    top = levels_of([levels[-1][0] for _, levels in trees.values()])
    out = {}
    for k, (own, levels) in enumerate(trees.values()):
        for place, r in enumerate(own):
            proof = path(levels, place) + path(top, k)
            doc, now = r["doc_id"], leaf(r, r["text"])
            if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0:
                now = leaf(r, low(r["text"]))
            for left, right in proof:
                now = h(*left, now, *right)
            flat = [d for sides in proof for side in sides for d in side]
            out.setdefault((doc, levels[0][place]), []).append((levels[-1][0], top[-1][0], h(*flat), now))
    return {k: sorted(v) for k, v in out.items()}


def listed(rows):
    out = {}
    for r in rows:
        assert r["verified"] == (r["folded_root"] == r["root"])
        out.setdefault((r["doc_id"], r["leaf"]), []).append((r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]))
    return {k: sorted(v) for k, v in out.items()}


def test_op11_equals_sql(spark, folder):
    assert differences(QUERIES["op11_merkle_manifest"](spark, folder), duck(folder), ORACLES["op11_merkle_manifest"]) == []


def odd_rows():
    rows = [(i, f"Text {i}" if i % 7 else None, ["en", None, "é", "", "de"][i % 5 if i % 3 else 0], "s", i) for i in range(90)]
    rows += [(7, "Text 7", "en", "s", 7)] * 60  # equal rows are a third of a group
    rows += [(None, "A", "en", None, None), (None, "", None, "", None), (2**53 + 1, "B", "one", "s", 1), (2**53 + 2, "B", "en", "s", 1)]
    return rows + [(1000 + k, "T", f"l{k}", "s", 1) for k in range(20)]


@pytest.mark.parametrize("levels", [1, 4])
def test_odd_rows_equal_brute_force(spark, tmp_path, monkeypatch, levels):
    spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", "doc_id AS extra").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    build = merkle.build
    monkeypatch.setattr(merkle, "build", lambda *a: build(*a, levels=levels))
    got = listed(QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect())
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in odd_rows()]
    assert got == brute(rows)


def test_no_rows_and_one_row(spark, tmp_path):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for n in (0, 1):
        df.where(f"doc_id = 3 AND {n} = 1").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        rows = QUERIES["op11_merkle_manifest"](spark, f"{tmp_path}/{n}").collect()
        assert len(rows) == n
    assert rows[0]["subroot"] == rows[0]["root"] == rows[0]["leaf"] and rows[0]["proof_sha256"] == h()


def test_proofs_of_some_leaves_fetch_only_what_is_missing(spark):
    n = 700
    df = spark.createDataFrame([(i, "g" if i % 2 else "h", h(str(i))) for i in range(n)], "id bigint, kind string, leaf string")
    manifest = merkle.build(df, "kind", "id", "leaf", levels=2)
    some = [1, 3, 5, 7, 9, 11, 13, 15, 301, 698]
    leaves = manifest.leaves.where(manifest.leaves["id"].isin(some)).selectExpr("*", "CAST(NULL AS string) AS claimed")
    proofs = merkle.prove(manifest, leaves).collect()
    trees = {g: levels_of([h(str(i)) for i in range(n) if (i % 2 == 1) == (g == "g")]) for g in ("g", "h")}
    top = levels_of([trees["g"][-1][0], trees["h"][-1][0]])
    assert manifest.root == top[-1][0] and sorted(r["id"] for r in proofs) == some
    for r in proofs:
        want = path(trees[r["kind"]], r["id"] // 2) + path(top, "gh".index(r["kind"]))
        assert r["proof"] == [d for sides in want for side in sides for d in side] and r["folded_root"] == manifest.root
    # The first eight leaves are a whole run: no sibling of theirs is fetched on the lowest level.
    assert {c for c in merkle._missing(set(range(8)), 350) if c[0] == 0} == set()
    missing = list(merkle._missing({0, 1, 9}, 350))
    assert len(missing) == len(set(missing))
    assert sorted(missing) == sorted(
        [(0, p) for p in (*range(2, 8), 8, *range(10, 16))] + [(1, p) for p in range(2, 8)] + [(2, p) for p in range(1, 6)])


def test_a_missing_node_is_an_error(spark):
    df = spark.createDataFrame([(i, "g", h(str(i))) for i in range(100)], "id bigint, kind string, leaf string")
    manifest = merkle.build(df, "kind", "id", "leaf", levels=1)
    manifest.nodes = manifest.nodes.where("NOT (level = 0 AND place = 3)")
    leaves = manifest.leaves.where("id = 5").selectExpr("*", "CAST(NULL AS string) AS claimed")
    with pytest.raises(Exception, match="KeyError"):
        merkle.prove(manifest, leaves).collect()
