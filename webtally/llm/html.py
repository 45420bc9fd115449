"""Main text of web pages by deducing each host's template from equivalence classes.

A page is a sequence of tokens: tags, told apart by the containers they stand in, and texts between tags. A token's
occurrence vector says how often it occurs on each page of a host. Tokens with the same vector form an equivalence class;
classes seen on enough pages are the template's material. Vectors are compared by two 64-bit sums of hashes over (page,
count), which Spark adds up for all pages of a host in parallel. On a page the tokens of a class must keep the class's
order; such valid classes nest into the template, part by part where they interlace, and what lies between two template
tokens is a slot. Text that is itself part of the template is dropped outside the article. What
varies, the text in slots, tells where the article is: an element that by class, id or role seems to hold something else
than the article, or a form, is a mere wrapper if nearly all that varies on the page is in it; other such elements go."""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from webtally.llm.common import steps, stored, table

#: A class counts from so many pages of a host on, and from this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.5
#: Elements without text of their own to show; their content isn't parsed.
OPAQUE = "script style noscript template iframe svg math textarea select option button object canvas audio video title"
#: Containers whose text isn't the article's, by tag and by words in class, id or role.
OTHER_TAGS = frozenset("nav footer aside header form dialog menu head fieldset label".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted promotion "
    "related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toc widget".split())
#: Of these, what a block within an article may be called as well; there it goes only if its text is the template's.
ARTICLE_WORDS = frozenset("notice promo promoted promotion related share sharing widget".split())
#: Tags that may be put around a whole page.
WRAPPER_TAGS = frozenset("form dialog fieldset".split())
#: A wrapper holds at least this share of the text that varies, and what is outside all such elements at most this part of its text.
WRAPPED, OUTSIDE = 0.5, 0.1
MAIN_TAGS = frozenset(("article", "main"))
CONTAINERS = MAIN_TAGS | OTHER_TAGS | frozenset("html body div section ul ol dl table tbody thead tfoot figure details center".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<opaque>{OPAQUE.replace(' ', '|')})\b[^>]*>.*?(?:</(?P=opaque)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>""",
    re.DOTALL | re.IGNORECASE)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")


def host_of(url: Column) -> Column:
    """Lower-case host with port; of anything else than a URL with a host an empty one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


#: Elements of something else: by a tag that is never around an article, by word or as a form, by a word for article blocks.
HARD, SOFT, BLOCK = range(3)
#: Zones of a page: neither, within main, within article.
PAGE, MAIN, ARTICLE = range(3)


#: Where a name changes from small to capital letters, as in ``userComments``.
CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")


class State(NamedTuple):
    """What the containers that are open tell: the zone, how many elements of something else are around it, and those
    (kind, number on the page) that are open in it."""

    zone: int = PAGE
    depth: int = 0
    others: tuple[tuple[int, int], ...] = ()


class Node:
    """A token of a page: a tag or a text, with what is known of the containers around it."""

    __slots__ = ("key", "text", "block", "state", "token")

    def __init__(self, key: str, text: str | None, block: bool, state: State):
        self.key, self.text, self.block, self.state, self.token = key, text, block, state, None


def nodes(page: str) -> list[Node]:
    """Tokens in page order. A closing tag ends its container and all that were left open in it; one without a container
    that is open is passed over. An article that opens in a container which isn't its host's article area ends it only
    if that is itself unclosed, so a forgotten closing tag before the article doesn't swallow it."""
    out: list[Node] = []
    stack: list[tuple[str, State, str]] = []  # tag, state, digest of the path
    opened: Counter[str] = Counter()
    outside = State()
    closing = Counter(m["tag"].lower() for m in TOKEN.finditer(page) if m["close"])

    def path() -> str:
        return stack[-1][2] if stack else ""

    def leave() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    def text(part: str) -> None:
        state = stack[-1][1] if stack else outside
        if part and not part.isspace():
            out.append(Node(f"{path()} {' '.join(part.split())}", part, False, state))
        elif part:
            out.append(Node("", " ", False, state))

    at = 0
    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            closing[tag] -= 1
            if tag in CONTAINERS and opened[tag]:
                while leave() != tag:
                    pass
            out.append(Node(f"{path()} </{tag}>", None, tag not in INLINE, stack[-1][1] if stack else outside))
            continue
        if tag in MAIN_TAGS:
            while stack and stack[-1][1].others and closing[stack[-1][0]] <= 0:
                leave()
        state = stack[-1][1] if stack else outside
        attributes = m["attributes"]
        out.append(Node(f"{path()} <{tag}>", " " if tag == "br" else None, tag not in INLINE, state))
        if tag in CONTAINERS and tag not in VOID and not attributes.endswith("/"):
            names = {w for g in NAMED.findall(attributes) for w in WORD.findall(CASE.sub(" ", "".join(g)).lower())}
            heads_article = {"header"} if state.zone else set()  # what an article calls its header holds its heading
            words = names & OTHER_WORDS - heads_article
            zone = ARTICLE if tag == "article" else MAIN if tag == "main" or "main" in names and tag in ("div", "section") and not words else PAGE
            within = state.zone > PAGE
            if zone > state.zone:
                state = State(zone, state.depth + len(state.others))
            if tag not in ("html", "body"):
                kind = HARD if tag in OTHER_TAGS - WRAPPER_TAGS - heads_article else None
                if kind is None and (words or tag in WRAPPER_TAGS):
                    kind = BLOCK if within and words and words <= ARTICLE_WORDS and tag not in WRAPPER_TAGS else SOFT
                if kind is not None:
                    state = state._replace(others=(*state.others, (kind, len(out))))
            stack.append((tag, state, xxhash.xxh3_64_hexdigest(f"{path()}/{tag}")))
            opened[tag] += 1
    text(page[at:])
    return out


def _sums(page_id, url: str, key: str, count: int) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(f"{page_id}\0{url}\0{count}")
    return h & (2**63 - 1), h >> 65


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token (hash), pages, and the sums that stand for the token's vector, of each token of each host."""
    schema = "host string, token long, first long, second long, pages long, place double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "html"):
            found: dict[tuple[str, int], list] = defaultdict(lambda: [0, 0, 0, 0.0])
            for page_id, url, host, page in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "host")), texts, strict=True):
                sequence = [n.key for n in nodes(page) if n.key]
                if not sequence:
                    continue  # says nothing of the template
                counts = Counter(sequence)
                places = {k: i for i, k in reversed(list(enumerate(sequence)))}
                sums: dict[int, tuple[int, int]] = {}
                for key, count in [*counts.items(), ("", 1)]:  # "": the page itself
                    if count not in sums:
                        sums[count] = _sums(page_id, url, key, count)
                    own = found[host, xxhash.xxh3_64_intdigest(key) - 2**63]
                    own[0] = (own[0] + sums[count][0]) % 2**40
                    own[1] = (own[1] + sums[count][1]) % 2**40
                    own[2] += 1
                    own[3] += places.get(key, -1) / (len(sequence) + 1)
            rows = [(h, t, *v) for (h, t), v in found.items()]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "token", "first", "second", "pages", "place"])

    counted = pages.select("page_id", "url", "host", "html").mapInArrow(run, schema)
    whole = 1 << 40
    return counted.groupBy("host", "token").agg(
        (F.sum("first") % whole).alias("first"), (F.sum("second") % whole).alias("second"), F.sum("pages").alias("pages"),
        (F.sum("place") / F.sum("pages")).alias("place"))


def templates(pages: DataFrame) -> DataFrame:
    """host and its classes: an array of tokens by class, the class that every page has once first (partly is false), the
    others by falling number of pages, and tokens in page order within a class. It holds at most 1 / ``MIN_SHARE`` times the tokens of a page."""
    page = F.lit(xxhash.xxh3_64_intdigest("") - 2**63)
    found = stored(occurrences(pages).where((F.col("pages") >= MIN_PAGES) | (F.col("token") == page)), "tokens")
    sizes = found.where(F.col("token") == page).select(
        "host", F.col("pages").alias("all"), F.col("first").alias("first_all"), F.col("second").alias("second_all"))
    frequent = found.where(F.col("token") != page).where(F.col("pages") >= MIN_PAGES).join(sizes, "host").where(F.col("pages") >= F.col("all") * MIN_SHARE)
    every = (F.col("first") == F.col("first_all")) & (F.col("second") == F.col("second_all"))
    ordered = F.sort_array(F.collect_list(F.struct((~every).alias("partly"), (-F.col("pages")).alias("pages"), "first", "second", "place", "token")))
    return frequent.groupBy("host").agg(ordered.alias("tokens"))


def template_of(page: list[Node], classes: list[list[int]]) -> set[int]:
    """Tokens of the classes that are valid on this page: all are there and their first occurrences keep the class's order.
    A class that lies in several gaps of another one nests into them part by part, as one odd page of a host is enough to
    part a class in two that interlace."""
    places: dict[int, int] = {}
    for i, node in enumerate(page if classes else ()):
        if node.key:
            node.token = xxhash.xxh3_64_intdigest(node.key) - 2**63
            places.setdefault(node.token, i)
    valid: set[int] = set()
    for tokens in classes:
        own = [places[t] for t in tokens if t in places]
        if len(own) == len(tokens) and own == sorted(own):
            valid.update(tokens)
    return valid


def _sizes(texts: list[Node], template: set[int]) -> dict[int, int]:
    """Characters of each text, by id: of those that vary, or of all if none does."""
    varying = {id(n): len(n.text) for n in texts if n.token not in template}
    return varying or {id(n): len(n.text) for n in texts}


def _zones(texts: list[Node], sizes: dict[int, int]) -> set[tuple[int, int]]:
    """Zone and depth of the articles. One within elements of something else counts if there is none outside such elements
    and it has more text than all that is outside them; the least deep ones are taken."""
    held: Counter = Counter()
    for n in texts:
        if not any(kind != BLOCK for kind, _ in n.state.others):
            held[n.state.zone, n.state.depth] += sizes.get(id(n), 0)
    clean = sum(size for (_, depth), size in held.items() if not depth)
    zones = {(n.state.zone, 0) for n in texts if n.state.zone and not n.state.depth}
    for zone in (MAIN, ARTICLE):
        deep = [d for z, d in held if z == zone]
        if deep and min(deep) and held[zone, min(deep)] > clean:
            zones.add((zone, min(deep)))
    return zones


def _wrappers(texts: list[Node], sizes: dict[int, int]) -> set[int]:
    """Numbers of the soft elements that are mere wrappers, from the outermost one inwards."""
    soft = [
        ([number for kind, number in n.state.others if kind == SOFT], sizes.get(id(n), 0))
        for n in texts if not any(kind == HARD for kind, _ in n.state.others)]
    total = sum(size for _, size in soft)
    inside: Counter = Counter()
    for others, size in soft:
        for number in others:
            inside[number] += size
    opened: set[int] = set()
    for number in sorted(n for n, size in inside.items() if size and size >= WRAPPED * total):
        outside = sum(size for others, size in soft if not others or others[-1] in opened)
        if outside > OUTSIDE * inside[number]:
            break  # nothing in it can count either
        opened.add(number)
    return opened


def main_text(page: str, classes: list[list[int]] | None = None, every: frozenset[int] = frozenset()) -> str:
    """Blocks of the main text, white space made one space, joined by two newlines. ``classes``: the host's, whose valid
    texts outside the article are the template's. ``every``: tokens that all pages of the host have in the same way; on a
    page on which nothing varies, as it is a copy, they alone are."""
    sequence = nodes(page)
    template = template_of(sequence, classes or [])
    texts = [n for n in sequence if n.text and not n.text.isspace()]
    zones = _zones(texts, _sizes(texts, template))
    own = [n for n in texts if (n.state.zone, n.state.depth) in zones]
    opened = _wrappers(own, _sizes(own, template))

    def dropped(node: Node) -> bool:
        return any(node.token in template if kind == BLOCK else number not in opened for kind, number in node.state.others)

    has_main = any(not dropped(n) for n in own)
    if not has_main:
        sizes = _sizes(texts, template)
        opened = _wrappers(texts, sizes)
        if not any(n.token not in template for n in texts):
            template &= every
    blocks: list[str] = []
    parts: list[str] = []
    for node in sequence:
        if node.block:
            blocks.append("".join(parts))
            parts = []
        if node.text is None or dropped(node) or has_main and (node.state.zone, node.state.depth) not in zones:
            continue
        if not has_main and node.key and node.token in template:
            continue
        parts.append(entities.unescape(node.text))
    blocks.append("".join(parts))
    return "\n\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, ...) with text.

    Null and empty pages give an empty text, and so do pages without any. Pages without a host in their url share one
    nameless host. A host with fewer than ``MIN_PAGES`` pages has no template; tags, classes and ids alone decide there.
    Repeated rows count as pages each. Very long pages are parsed whole. Other columns stay, one named text is replaced;
    an empty table stays empty."""
    hosted = pages.withColumn("_host", host_of(F.col("url")))
    found = templates(hosted.select("page_id", "url", F.col("_host").alias("host"), "html")).withColumnRenamed("host", "_host")
    found = stored(found, "templates")  # then nothing stands between the join and the shuffle of a host with many pages
    fields = [f for f in pages.schema if f.name != "text"]
    schema = T.StructType([*fields, T.StructField("text", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for part, texts in steps(batches, "html"):
            out = []
            for page, host, tokens in zip(texts, part.column("_host").to_pylist(), part.column("tokens"), strict=True):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    classes: dict[tuple, list[int]] = {}
                    rows = tokens.as_py() or []
                    for row in rows:
                        classes.setdefault((row["pages"], row["first"], row["second"]), []).append(row["token"])
                    known[host] = list(classes.values()), frozenset(r["token"] for r in rows if not r["partly"])
                out.append(main_text(page, *known[host]))
            yield pa.RecordBatch.from_arrays([part.column(f.name) for f in fields] + [pa.array(out, pa.string())], names=schema.names)

    return hosted.join(found, "_host", "left").select(*[f.name for f in fields], "_host", "tokens").mapInArrow(run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    """Contract query: the text of every page."""
    return extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
