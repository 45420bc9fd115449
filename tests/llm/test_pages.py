import hashlib

import pytest

from tests.compare import differences, duck
from webtally.llm import html, warc
from webtally.llm.queries import ORACLES, QUERIES
from webtally.sources.writers import new_folder

SCHEMA = "page_id bigint, url string, html string, text string"


def test_op8_equals_sql(spark, folder):
    assert differences(QUERIES["op8_warc"](spark, folder), duck(folder), ORACLES["op8_warc"]) == []


def test_warc_round_trip_of_odd_pages(spark):
    big, small = "<p>é</p>" * 200, "<p>x</p>"
    rows = [(i, f"http://h/{i}", big, "t") for i in range(40)] + [(50, None, small, "t"), (51, "a\nb", small, "t"), (52, "u", None, "t"), (53, "u", "", "t"), (None, "n", big, "t"), (39, "again", big, "t")]
    df = spark.createDataFrame(rows, SCHEMA)
    folder = new_folder(spark, "warc")
    manifest = warc.write(df, folder, shard_bytes=4000, file_bytes=500)
    assert manifest.count() > 3 and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read(spark, folder).collect()
    assert len(got) == len(rows)
    assert sorted(r["page_id"] for r in got if r["record_type"] == "response" and r["payload_bytes"] >= 1000) == [39, 39]
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {39}
    assert [r["payload_bytes"] for r in got if r["page_id"] in (52, 53)] == [0, 0]
    digest = hashlib.sha1(big.encode()).hexdigest()
    assert all(r["payload_digest"] == digest for r in got if r["page_id"] is None or r["page_id"] < 40)
    again = new_folder(spark, "warc")
    same = warc.write(df.repartition(7), again, shard_bytes=4000, file_bytes=500)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, manifest.collect()))
    assert (text := got[0]["url"]) is None or "\n" not in text


def test_warc_of_an_empty_table_and_a_folder_without_manifest(spark):
    folder = new_folder(spark, "warc")
    assert warc.write(spark.createDataFrame([], SCHEMA), folder).count() == 0
    assert warc.read(spark, folder).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        warc.read(spark, new_folder(spark, "warc")).count()


def test_warc_with_a_missing_file(spark):
    folder = new_folder(spark, "warc")
    warc.write(spark.createDataFrame([(i, "u", "x" * 300, "") for i in range(20)], SCHEMA), folder, shard_bytes=2000)
    manifest = spark.read.parquet(f"{folder}/{warc.MANIFEST}")
    more = new_folder(spark, "warc")
    manifest.unionByName(manifest.limit(1).withColumn("file", html.F.lit("shard-999999-00000.warc.gz"))).write.parquet(f"{more}/{warc.MANIFEST}")
    with pytest.raises(Exception, match="is missing"):
        warc.read(spark, more).collect()
    assert warc.read(spark, folder).count() == 20


def sizes_of_shards(df, shard_bytes):
    rows = warc.planned(df, shard_bytes).selectExpr("shard", "page_id", "digest", "url", "copies").collect()
    assert min((r["copies"] for r in rows), default=1) > 0
    return sorted(map(repr, rows)), {n: sum((400 + 100) * r["copies"] for r in rows if r["shard"] == n) for n in {r["shard"] for r in rows}}


def test_shards_follow_sizes(spark):
    rows = [(i, "u", "x" * 100, "") for i in range(100)] + [(10**12 + i, "u", "x" * 100, "") for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    found, sizes = sizes_of_shards(df, 10_000)
    assert len(sizes) == 10 and set(sizes.values()) == {10_000} and found == sizes_of_shards(df.repartition(5), 10_000)[0]


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("hot", [7, None])
def test_a_hot_or_missing_id_is_split(spark, hot, same):
    rows = [(hot, "u", ("x" if same else f"{i:03}"[:3].ljust(100, "x"))[:100].ljust(100, "x"), "") for i in range(300)]
    rows += [(i, "u", "y" * 100, "") for i in range(100, 400)]
    df = spark.createDataFrame(rows, SCHEMA)
    found, sizes = sizes_of_shards(df, 10_000)
    assert len(sizes) == 30 and set(sizes.values()) == {10_000} and found == sizes_of_shards(df.repartition(5), 10_000)[0]
    folder = new_folder(spark, "warc")
    warc.write(df, folder, shard_bytes=10_000)
    want = sorted((str(i), hashlib.sha1(t.encode()).hexdigest()) for i, _, t, _ in rows)
    assert sorted((str(r["page_id"]), r["payload_digest"]) for r in warc.read(spark, folder).collect()) == want


def test_records_longer_than_shards(spark):
    rows = [(1, "u", "x" * 5000, "")] * 3 + [(2, None, "y" * 9000, ""), (2, "", "y" * 9000, ""), (3, "u", None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sum(r["copies"] for r in warc.planned(df, 1000).collect()) == len(rows)
    folder = new_folder(spark, "warc")
    warc.write(df, folder, shard_bytes=1000, file_bytes=10)
    assert sorted(r["payload_bytes"] for r in warc.read(spark, folder).collect()) == [0, 5000, 5000, 5000, 9000, 9000]


def article(body: str, i: int = 0) -> str:
    return (
        f"<html><head><title>T{i}</title><style>p{{}}</style></head><body><header><h2>Site</h2></header><nav><a href='/'>Home {i}</a></nav>"
        f"<div class='cookie-notice'>We use cookies</div><article>{body}</article><aside>More {i}</aside>"
        f"<section id=comments><p>me too {i}</p></section><form><input value=1>Search</form><footer>&copy; {i}</footer></body></html>")


def test_op6_takes_the_article(spark, folder):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op6_html_extraction"](spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = pages[r["page_id"]].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        want = [" ".join(html.entities.unescape(html.re.sub("<[^>]*>", "", p)).split()) for p in html.re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(filter(None, want)) and r["n_chars"] == len(r["text"])


def test_html_of_odd_pages(spark):
    body = "<header class=article-header><h1>Head &amp; foot</h1></header><p>one <b>two</b>\n three<br>four &lt;p&gt; &#233;</p><script>var a = '</p>';</script><p>five<div class=share>Share!</div><ul><li>six<li>seven</ul>"
    want = "Head & foot\n\none two three four <p> é\n\nfive\n\nsix\n\nseven"
    rows = [(i, "http://a.example/x", article(body, i), "old") for i in range(8)]
    rows += [(20, None, None, ""), (21, "", "", ""), (22, "no url", "plain text", ""), (23, "http://b/", article("<p>x", 1)[:200], ""),
             (24, "http://b/", "<p>a < b &amp <!-- open", ""), (25, "http://c/", "<p>" * 2000 + "deep", ""), (26, "http://c/", '<p title="a>b">t</p>', ""), (0, "http://a.example/x", article(body, 0), "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = html.extract(df).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["page_id", "url", "html", "text"]
    text = {r["page_id"]: r["text"] for r in got}
    assert [text[i] for i in range(8)] == [want] * 8
    assert text[20] == text[21] == "" and text[22] == "plain text" and text[25] == "deep" and text[26] == "t" and text[24] == "a < b &"
    assert html.extract(df.limit(0)).count() == 0


def test_html_without_article_drops_the_template(spark):
    """Text that all pages of a host have in the same way goes; what differs stays."""
    rows = [(i, "http://d.example/", f"<body><div>Welcome to our site</div><div><p>story number {i}</p></div><div>All rights reserved</div></body>", "") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"story number {i}" for i in range(12)}
    few = html.extract(spark.createDataFrame(rows[:2], SCHEMA)).collect()
    assert few[0]["text"].startswith("Welcome to our site\n\nstory number")


def texts_of(spark, pages, url="http://e.example/"):
    rows = [(i, url, page, "") for i, page in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_html_template_of_most_pages(spark):
    """Without article tags: null and empty pages say nothing of the template, and what most pages have is the template's."""
    def page(i):
        notice = "<div>The shop is closed on Monday</div>" if i % 4 else ""
        return f"<body><div>Welcome to our site</div>{notice}<div><p>story number {i}</p></div><div>All rights reserved</div></body>"

    want = {i: f"story number {i}" for i in range(12)}
    assert texts_of(spark, [*map(page, range(12)), None, "", " "]) == {**want, 12: "", 13: "", 14: ""}
    assert texts_of(spark, [*map(page, range(12)), "<p>something odd"]) == {**want, 12: "something odd"}


WRAPPERS = ["<div class='layout with-sidebar'>", "<div class=no-comments>", "<section id=menu-open>", "<form action=x.aspx>"]


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html_wrappers_do_not_hide_the_article(spark, tag):
    pages, want = [], {}
    for i in range(12):
        wrapper = WRAPPERS[i % 4]
        end = f"</{wrapper[1:].split()[0]}>"
        story = f"<{tag}><h1>Head {i}</h1><p>story number {i} is of some length</p></{tag}>"
        pages.append(f"<body><nav>Home</nav>{wrapper}{story}<div class=sidebar>Side {i}</div>{end}<footer>Foot</footer></body>")
        want[i] = f"Head {i}\n\nstory number {i} is of some length"
    assert texts_of(spark, pages) == want


def test_html_blocks_of_the_article(spark):
    """Blocks of an article go by such names only if the template has their text; teasers beside it are no articles."""
    pages = [
        f"<body><article><p>story {i}</p><div class=notice>told by {i}</div><div class=widget>Chart of {i}</div>"
        "<div class=share>Share!</div></article><div class=related><article>an older story and one more</article></div>"
        f"<article class=comment>I don't like {i}</article></body>" for i in range(8)]
    assert texts_of(spark, pages) == {i: f"story {i}\n\ntold by {i}\n\nChart of {i}" for i in range(8)}


def test_deep_nesting_takes_work_in_proportion():
    """Keys of tokens don't spell their path, so neither they nor the search for an open tag grow with the depth."""
    depth = 200_000
    found = html.nodes("<div>" * depth + "text" + "</div>" * depth + "</p>" * 1000)
    assert len(found) == 2 * depth + 1001 and max(len(n.key) for n in found) < 40
    keys = [n.key for n in found]
    assert keys[: depth + 1] != keys[1 : depth + 2] and len(set(keys[:depth])) == depth
    assert keys[0] == " <div>" and keys[2 * depth] == " </div>"


def test_names_end_at_capital_letters():
    page = "<article><p>Body of it.</p></article><div class='userComments'><p>I say.</p></div>"
    said = [n.state.others for n in html.nodes(page) if n.text == "I say."]
    assert said[0]
