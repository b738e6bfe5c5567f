"""Main text of web pages by template deduction from equivalence classes.

The tokens of a page are its elements and its blocks of text, told apart by the path of elements around
them. Per host, each token has an occurrence vector: in which pages it stands, and how often. Tokens with
the same vector form a class; the vectors are compared by an order-free fingerprint, so they are summed up
in parts and never gathered. A class is valid if it holds several tokens and stands once in each of at least
half of the host's pages. Text in a valid class is template and goes, wherever it stands. Of the
elements in valid classes the one that holds the article, over all pages of the host, bounds what is kept;
without one all of the body is kept. Classes are not nested into a tree.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import staged

#: HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
HIDDEN = RAW | frozenset("template svg head nav footer aside form button select option menu dialog object canvas audio video map".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td body table blockquote center".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
#: Names in class, id and role that mark what is not the article.
ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar"
    " navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert newsletter subscribe"
    " subscription signup login popup modal overlay share sharing social related recommended recommendations comment comments"
    " disqus reply replies respond discussion widget toolbar pagination pager search complementary contentinfo form skip".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL
)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
#: Words of form that may follow a name of ASIDE in a longer name: ad-box, comments-area.
SHAPES = frozenset(
    "area bar block box button buttons container content div form inner item items left right top bottom link links list outer panel"
    " post posts section slot title widget widgets wrap wrapper".split()
)
#: Elements whose id may name an aside; ids of headings, sections and anchors are made from the article's text.
ID_NAMES = frozenset("div ul ol dl table td center".split())
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAMES = re.compile(r"[a-z]+")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
SPACE = re.compile(r"\s+")
ROOT = "root"
TEXT = "#text"
LEAST_PAGES = 3  # that a block of text must stand in to be template
LEAST_SHARE = 0.5  # of the host's pages that a valid class stands in
MAIN_SHARE = 0.8  # of the host's text that a slot without a telling name must hold
COPY_SHARE = 0.8  # of a page's text; where more of it is template, the page is a copy of others and stays whole


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found.group(1).lower() if found else ""


def _names(rest: str) -> dict[str, str]:
    """The class, id and role among the attributes of a start tag, in small letters."""
    found: dict[str, str] = {}
    if "=" in rest:
        for m in ATTRIBUTE.finditer(rest):
            name = m.group(1).lower()
            if name in ("class", "id", "role"):
                found.setdefault(name, (m.group(2) or m.group(3) or m.group(4) or "").lower())
    return found


def _aside(tag: str, names: dict[str, str]) -> bool:
    """Whether a whole name of an element, or its beginning before words of form, is one of ASIDE."""
    if not names or tag in ("html", "body", "article", "main"):
        return False
    whole = [*names.get("class", "").split(), *names.get("role", "").split()]
    if tag in ID_NAMES and "section" not in whole:
        whole += names.get("id", "").split()
    for name in whole:
        first, *more = re.split(r"[-_]+", name)
        if first in ASIDE and all(w in ASIDE or w in SHAPES or not w.strip("0123456789") for w in more):
            return True
    return False


_paths: dict[tuple[str, str], str] = {}


def _path(parent: str, label: str) -> str:
    """A name of constant size for the element *label* below *parent*."""
    name = _paths.get((parent, label))
    if name is None:
        if len(_paths) > 100_000:
            _paths.clear()
        name = _paths[parent, label] = hashlib.blake2b(f"{parent}/{label}".encode(), digest_size=10).hexdigest()
    return name


def _holders(events: list[tuple[str, str, str, int, str, bool]]) -> set[int]:
    """The open events of elements marked by name that hold the article all the same: the page's ``main``,
    or all of its ``article`` elements and in them half of its text or more."""
    holding: set[int] = set()
    opened: list[int] = []
    all_of, inside_of = [0, 0], {}  # articles, and characters of text or those inside articles
    total = articles = hidden = 0
    for i, (event, tag, _, flag, text, _) in enumerate(events):
        if event == "open":
            opened.append(i)
            hidden += flag == 1
            articles += tag == "article"
            if flag == 2:
                inside_of[i] = [0, 0]
            if hidden or tag not in ("article", "main"):
                continue
            marked = [k for k in opened if events[k][3] == 2]
            if tag == "main":
                holding.update(marked)
            else:
                all_of[0] += 1
                for k in marked:
                    inside_of[k][0] += 1
        elif event == "close":
            closed = opened.pop()
            hidden -= events[closed][3] == 1
            articles -= tag == "article"
        elif not hidden:
            size = len(text.strip())
            total += size
            if articles and size:
                for k in opened:
                    if events[k][3] == 2:
                        inside_of[k][1] += size
    if all_of[0]:
        holding.update(k for k, (n, size) in inside_of.items() if n == all_of[0] and 2 * size >= total > 0)
    return holding


def walk(page: str) -> Iterator[tuple[str, str, str, bool, str, bool]]:
    """(event, tag, path, hidden, text, in article) in page order; events are open, close and text.

    Elements of HIDDEN and those named as an aside are hidden with what stands in them, the latter
    unless they hold the article.
    """
    events = list(_events(page))
    marked = any(flag == 2 for _, _, _, flag, _, _ in events)
    holding = _holders(events) if marked and any(e[1] in ("article", "main") for e in events) else ()
    covers: list[bool] = []
    hidden = 0
    for i, (event, tag, path, flag, text, inside) in enumerate(events):
        if event == "open":
            covers.append(flag == 1 or flag == 2 and i not in holding)
            hidden += covers[-1]
        yield event, tag, path, hidden > 0, text, inside
        if event == "close":
            hidden -= covers.pop()


def _events(page: str) -> Iterator[tuple[str, str, str, int, str, bool]]:
    """(event, tag, path, flag, text, in article); the flag of an element is 1 if its tag hides it, 2 if its names do.

    Missing end tags are made up as browsers do for paragraphs and list items; an end tag closes what
    stands open inside its element and is ignored without one. Raw elements reach to their own end tag, or
    to the end of the page, whatever stands in between.
    """
    stack: list[tuple[str, str, int, bool]] = [("", ROOT, 0, False)]
    at, rest_of_page = 0, TOKEN.finditer(page)
    while found := next(rest_of_page, None):
        closing, name, rest = found.group(1), (found.group(2) or "").lower(), found.group(3)
        if found.start() > at:
            tag, path, flag, inside = stack[-1]
            yield "text", tag, path, flag, page[at : found.start()], inside
        at = found.end()
        if not name:
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    for tag, path, flag, inside in reversed(stack[i:]):
                        yield "close", tag, path, flag, "", inside
                    del stack[i:]
                    break
            continue
        ends = {"p"} if name in CLOSES_P else {name} if name in ("li", "dd", "dt", "tr", "td", "th", "option") else ()
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    for tag, path, flag, inside in reversed(stack[i:]):
                        yield "close", tag, path, flag, "", inside
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS and stack[i][0] != "p":
                    break
        names = _names(rest) if rest else {}
        marks = [n for value in names.values() for n in NAMES.findall(value)]
        _, path, _, inside = stack[-1]
        flag = 1 if name in HIDDEN or name == "header" and not inside else 2 if _aside(name, names) else 0
        inside = inside or name in ("article", "main")
        path = _path(path, " ".join([name, *marks]))
        yield "open", name, path, flag, "", inside
        if name in VOID or rest.endswith("/") and name not in BLOCKS:
            yield "close", name, path, flag, "", inside
        elif name in RAW:
            yield "close", name, path, flag, "", inside
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            rest_of_page = TOKEN.finditer(page, at)
        else:
            stack.append((name, path, flag, inside))
    if at < len(page):
        tag, path, flag, inside = stack[-1]
        yield "text", tag, path, flag, page[at:], inside
    for tag, path, flag, inside in reversed(stack[1:]):
        yield "close", tag, path, flag, "", inside


def text_blocks(events: list[tuple[str, str, str, bool, str, bool]], wanted) -> Iterator[tuple[str, str]]:
    """(token, text) of the blocks of shown text inside the elements for which *wanted* (tag, path) holds."""
    inside, parts = 0, []
    opened = [ROOT]  # paths of the open blocks
    for event, tag, path, hidden, text, _ in events:
        if event == "text":
            if inside and not hidden:
                parts.append(html.unescape(text))
            continue
        if tag in BLOCKS:
            joined = SPACE.sub(" ", "".join(parts)).strip()
            if joined:
                yield hashlib.blake2b(f"{opened[-1]}/{joined}".encode("utf-8", "replace"), digest_size=8).hexdigest(), joined
            parts.clear()
            if event == "open":
                opened.append(path)
            else:
                opened.pop()
        elif tag == "br" and event == "open" and not hidden:
            parts.append(" ")
        if wanted(tag, path):
            inside += 1 if event == "open" else -1
    joined = SPACE.sub(" ", "".join(parts)).strip()
    if joined:
        yield hashlib.blake2b(f"{opened[-1]}/{joined}".encode("utf-8", "replace"), digest_size=8).hexdigest(), joined


def _everything(events: list[tuple[str, str, str, bool, str, bool]]) -> list[tuple[str, str, str, bool, str, bool]]:
    return [("open", "", ROOT, False, "", False), *events, ("close", "", ROOT, False, "", False)]


def tokens(page: str) -> dict[str, list]:
    """By path: [tag, depth, times, characters of shown text inside, hidden]. A block of text counts once."""
    seen: dict[str, list] = {ROOT: ["", 0, 1, 0, False]}
    opened = [ROOT]
    events = list(walk(page))
    for event, tag, path, hidden, text, _ in events:
        if event == "open":
            entry = seen.setdefault(path, [tag, len(opened), 0, 0, hidden])
            entry[2] += 1
            entry[4] &= hidden
            opened.append(path)
        elif event == "close":
            opened.pop()
        elif not hidden:
            size = len(text.strip())
            if size:
                for p in set(opened):
                    seen[p][3] += size
    for name, text in text_blocks(_everything(events), lambda tag, path: path == ROOT):
        seen[name] = [TEXT, 0, 1, len(text), False]
    return seen


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, path, tag, depth, pages, times, vector, chars, hidden), summed within a batch."""
    for batch in batches:
        found: dict[tuple[str, str], list] = {}
        for start in range(0, batch.num_rows, 100):
            part = batch.slice(start, 100)
            for page_id, url, page in zip(part["page_id"].to_pylist(), part["url"].to_pylist(), part["html"].to_pylist()):
                host = host_of(url)
                for path, (tag, depth, times, chars, hidden) in tokens(page or "").items():
                    mark = int.from_bytes(hashlib.blake2b(f"{page_id} {url} {times}".encode(), digest_size=8).digest(), "big", signed=True)
                    row = found.get((host, path))
                    if row is None:
                        found[host, path] = [host, path, tag, depth, 1, times, mark, chars, hidden]
                    else:
                        row[4] += 1
                        row[5] += times
                        row[6] ^= mark
                        row[7] += chars
                        row[8] &= hidden
            if found and (len(found) > 50_000 or start + 100 >= batch.num_rows):
                yield _rows(found)
                found.clear()


def _rows(found: dict[tuple[str, str], list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(zip(*found.values()), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
        ["host", "path", "tag", "depth", "pages", "times", "vector", "chars", "hidden"],
    )


def templates(pages: DataFrame) -> DataFrame:
    """(host, slot, tag, n_pages, texts): for every host with shown text the path of the slot with the article,
    NULL without one, and the blocks of text that belong to the template, at most twice as many as a page has.

    An ``article`` that holds half of the host's text comes first, then ``main``, the outermost of several;
    else the innermost container that holds four fifths.
    """
    rows = pages.select("page_id", "url", "html").mapInArrow(
        _vectors, "host string, path string, tag string, depth int, pages bigint, times bigint, vector bigint, chars bigint, hidden boolean"
    )
    tokens_ = staged(
        rows.groupBy("host", "path").agg(
            F.min("tag").alias("tag"), F.min("depth").alias("depth"), F.sum("pages").alias("pages"), F.sum("times").alias("times"),
            F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars"), F.min("hidden").alias("hidden"),
        ).filter((F.col("tag") != TEXT) | (F.col("pages") >= LEAST_PAGES)),
        "template-tokens",
    )
    root = tokens_.filter(F.col("path") == ROOT).select("host", F.col("pages").alias("n_pages"), F.col("chars").alias("all_chars"))
    # Elements and blocks of text are a token each; a class needs several.
    often = tokens_.filter("times = pages").join(root, "host").filter(F.col("pages") >= LEAST_SHARE * F.col("n_pages"))
    classes = often.groupBy("host", "vector", "pages").agg(F.count(F.lit(1)).alias("size")).filter("size >= 2")
    valid = often.filter("NOT hidden").join(classes, ["host", "vector", "pages"])
    half = 2 * F.col("chars") >= F.col("all_chars")
    rank = (
        F.when((F.col("tag") == "article") & half, F.struct(F.lit(3).alias("r"), (-F.col("depth")).alias("d"), "path"))
        .when((F.col("tag") == "main") & half, F.struct(F.lit(2).alias("r"), (-F.col("depth")).alias("d"), "path"))
        .when(F.col("tag").isin(*CONTAINERS) & (F.col("chars") >= MAIN_SHARE * F.col("all_chars")), F.struct(F.lit(1).alias("r"), F.col("depth").alias("d"), "path"))
    )
    found = valid.withColumn("rank", rank).filter("all_chars > 0").groupBy("host").agg(
        F.max_by(F.struct("path", "tag"), "rank").alias("best"), F.max("n_pages").alias("n_pages"),
        F.array_sort(F.collect_list(F.when(F.col("tag") == TEXT, F.col("path")))).alias("texts"),
    )
    return found.select("host", F.col("best.path").alias("slot"), F.col("best.tag").alias("tag"), "n_pages", "texts")


def extract(page: str, slot: str | None, texts: Collection[str] = ()) -> str:
    """The text in *slot* but for the template *texts*; without such a slot, in the page's article, main or body."""
    events = list(walk(page))
    paths = {path for event, _, path, _, _, _ in events if event == "open"}
    if slot in paths:
        wanted = lambda tag, path: path == slot
    else:
        tags = {tag for event, tag, _, hidden, _, _ in events if event == "open" and not hidden}
        name = next((t for t in ("article", "main", "body") if t in tags), None)
        wanted = lambda tag, path: tag == name
        if name is None:
            events = _everything(events)
            wanted = lambda tag, path: path == ROOT
    blocks = list(text_blocks(events, wanted))
    own = [text for name, text in blocks if name not in texts]
    if sum(map(len, own)) >= (1 - COPY_SHARE) * sum(len(text) for _, text in blocks):
        return "\n".join(own)
    return "\n".join(text for _, text in blocks)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 100):
            part = batch.slice(start, 100)
            sides = zip(part["html"].to_pylist(), part["slot"].to_pylist(), part["texts"].to_pylist())
            text = [extract(page or "", slot, frozenset(texts or ())) for page, slot, texts in sides]
            yield pa.RecordBatch.from_arrays(
                [part["page_id"], part["url"], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of *pages*.

    Blocks of text are joined by one line feed; inside a block white space is one space and character
    references are decoded. Blocks that recur, under the same path, in three pages and half of the host's are left out, unless
    nearly nothing else is left of a page. NULL html is empty, NULL url and url without a host share one host, repeated rows
    are read each, an empty table gives an empty result, other columns are ignored.
    """
    known = staged(templates(pages), "templates").select(F.col("host").alias("of"), "slot", "texts")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    key = pages.schema["page_id"].dataType.simpleString()
    return (
        pages.select("page_id", "url", "html", host.alias("host")).join(known, F.col("host") == F.col("of"), "left")
        .select("page_id", "url", "html", "slot", "texts")
        .mapInArrow(_extracted, f"page_id {key}, url string, text string, n_chars bigint")
    )
