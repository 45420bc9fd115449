import hashlib
import re

from tests.compare import differences, duck
from webtally.llm import fim
from webtally.llm.queries import ORACLES, QUERIES


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or three % 100 >= 90:
        return len(units), "plain", None, None, text
    if four % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", " ", "a", "\n\n", "one two", "naïve 日本語 😀é\x00b", "<P", "<P>", "x<S>y", "<<M>", "<S <M P> <", "S><P S><M",
    "word " * 4000, "x" * 5000, "\x7f\x80\xff߿￿",
]


def test_op12_equals_sql(spark, folder):
    assert differences(QUERIES["op12_fill_in_middle"](spark, folder), duck(folder), ORACLES["op12_fill_in_middle"]) == []


def test_odd_texts_clashing_names_and_no_rows(spark):
    rows = [(i if i % 11 else None, t, "x", i) for i, t in enumerate(TEXTS * 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string, restored long").withColumnRenamed("restored", "n_units")
    done = fim.restore(fim.transform(df).withColumn("kept", fim.F.lit(1)))
    got = done.collect()
    assert done.columns == ["doc_id", "text", "n_units", "form", "prefix_chars", "middle_chars", "output", "kept", "restored"]
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        want = brute(r["doc_id"], r["text"])
        assert (r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["restored"] == (r["text"] or "")
    assert fim.restore(fim.transform(df.limit(0))).count() == 0


def test_restoring_needs_output_and_form_only(spark):
    rows = [("<P>a<S>c<M>b", "psm", "abc"), ("<S>c<P>a<M>b", "spm", "abc"), ("<P>", "plain", "<P>"), (None, None, ""),
            ("<P><<S>S><M><", "psm", "<<S>"), ("<S><P><M>", "spm", "")]
    df = spark.createDataFrame(rows, "output string, form string, want string")
    assert all(r["restored"] == r["want"] for r in fim.restore(df).collect())
