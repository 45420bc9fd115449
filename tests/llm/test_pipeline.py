import collections

import corpus_pipeline
import __spark_entry__ as entry
from tests.llm import brute
from webtally.llm import quality
from webtally.llm.common import table
from webtally.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_every_stage_does_its_work(spark, tmp_path):
    docs, columns = table(spark, FOLDER, "documents"), ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        model = quality.fit(docs, table(spark, FOLDER, "labels")) if name == "quality_classifier" else None
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows if "text" in docs.columns}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "quality_classifier":
            scores = dict(zip(before, model.scores([t or "" for t in before.values()])))
            assert after.keys() == {d for d, s in scores.items() if s >= quality.KEEP}
        if name == "line_dedup":
            want = brute.without_repeats(list(before.items()), 50)
            assert after == {d: t for d, t in want.items() if t.strip() or t == before[d]}
        if name == "ngram_jaccard":
            want = brute.near_copies(list(before.items()))
            assert after.keys() == {d for d, (least, _) in want.items() if d == least}
    last = kept["best_fit_packing"]
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in kept["ngram_jaccard"]}
    fill = collections.Counter()
    for r in last:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= corpus_pipeline.CAPACITY
    assert sum(fill.values()) > 0.97 * len(fill) * corpus_pipeline.CAPACITY


def test_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(names) == set(QUERIES)
    assert entry.queries()["pipeline"] is corpus_pipeline.run
