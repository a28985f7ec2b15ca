"""Main text of web pages by equivalence classes of template tokens.

1. Each page becomes a sequence of tokens that are told apart by their place in the markup: a tag token for every open block
   element (its path of names, classes and ids) and a text token for every block of text (path and text).
2. The occurrence vector of a token says how often it occurs on each page of its host. Tokens of one host with equal vectors are an
   equivalence class. Vectors are compared by a sum of hashes of (page, count), which tasks add up before the shuffle, so a host may
   hold any share of the pages.
3. Classes whose tokens occur on enough of the host's pages are valid. They are nested into the host's template: a token belongs to it if the
   element around it does, whose class is its parent. Tag tokens are the template's frame; text tokens in a class of the frame are its constant text.
4. What is left are slots, on every page: blocks that are no constant text of the template and stand in no frame element that holds little but
   links on the host's pages (unnamed menus). The main text is the slots outside menus, headers, footers, sidebars, notices, adverts, forms and reader
   comments; in pages with an article (or another main part) those in it.
5. What an article (or another main part) holds is the template's only if its class is that of the element that opens the article: it is in every
   such article of the host, as often as the article itself (a notice or a menu without a name). Headings and lists of links that differ
   from page to page belong to the article.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import staged

#: A class is valid if its tokens are on so many pages of the host, and on so large a share of them.
MIN_PAGES = 3
MIN_SHARE = 0.3
#: A frame element is a menu if so much of the text right in it, over all pages of the host, stands in links.
MENU_SHARE = 0.7
#: The part of its pages, or of its article, that the constant texts of a class may be.
MAX_CONSTANT = 0.5
#: Template tokens up to which their hashes are sent to every task (8 bytes each); beyond, they are joined to the pages by host.
MAX_SENT = 2_000_000

#: Elements of HTML by their role here.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg object video audio canvas".split())
#: Their content is text without markup; unclosed, it is no more than the rest of the line, as a reader can't tell what it was meant to hold.
TEXT_ONLY = frozenset("textarea title iframe xmp noembed noframes noscript template svg object video audio canvas".split())
CHOICES = frozenset("select datalist option optgroup".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button label legend".split()
)
CLOSES_P = BLOCKS - frozenset("button label caption td th tr tbody thead tfoot html body legend".split())
SIBLINGS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
}
BARRIERS = frozenset("article aside body div dl footer form header main menu nav ol section table ul td th".split())
ASIDE = frozenset("nav menu footer aside form button dialog fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
#: Words in names of classes and ids that say what an element is for; the second part may also be what a text tells of.
_PURPOSES = (
    r"ad ads advert\w* adsense adslot banner\w* sponsor\w* promo\w* menu\w* nav navbar navigation breadcrumbs? sidebar\w* aside widget\w* footer\w* masthead "
    r"site-?header page-?header topbar cookie\w* consent gdpr notice\w* notification\w* alert\w* popup modal overlay newsletter subscribe subscription signup login "
    r"share sharing social\w* comment\w* respond replies disqus pager pagination skip\w* toolbar"
).split()
_SUBJECTS = r"side foot search\w* form related recommend\w* trending discussion toc copyright legal disclaimer".split()


def _named(words: list[str]) -> re.Pattern:
    return re.compile(rf"(?:^|\s|(?<!has)(?<!with)(?<!no)(?<!out)[_-])(?:{'|'.join(words)})(?=$|[\s_-])", re.I)


_ASIDE_NAME, _PURPOSE_NAME = _named(_PURPOSES + _SUBJECTS), _named(_PURPOSES)
_HEADER_NAME = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)

_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: In an article these may be named after what they tell of.
_TEXTS = frozenset("section p li dt dd td th tr tbody thead tfoot blockquote pre figure figcaption caption".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_END_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_BLANK = re.compile(r"\s+")


class Element:
    """An open block element: its path so far, whether it hangs in an article (2) or another main part (1), whether aside of the main text,
    and the path of the element that opened the article or part."""

    __slots__ = ("article", "aside", "name", "path", "root")

    def __init__(self, name: str, path: str, article: int, aside: bool, root: str):
        self.name, self.path, self.article, self.aside, self.root = name, path, article, aside, root


def _joined(path: str, part: str) -> str:
    """A path's next step; slashes in names of classes don't part it."""
    return f"{path}/{part.replace('/', chr(0x2215))}"


def _opened(parent: Element | None, name: str, raw: str) -> Element:
    attributes = {}
    if raw.strip():
        for k, v in _ATTRIBUTE.findall(raw):
            attributes.setdefault(k.lower(), entities.unescape(v.strip("\"'")))
    names = " ".join(x for x in (attributes.get("class", ""), attributes.get("id", "")) if x)
    within = parent.article if parent else 0
    if name == "article" or attributes.get("role") == "article" or attributes.get("itemprop") == "articleBody":
        article = 2
    else:
        article = max(within, int(name == "main" or attributes.get("role") == "main"))
    aside = bool(parent and parent.aside) or name in ASIDE or attributes.get("role") in ASIDE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
    if not within and (name == "header" or _HEADER_NAME.search(names)):  # an article's own header holds its title
        aside = True
    if names and name not in ("html", "body", "article", "main") and name not in _HEADINGS:
        aside = aside or bool((_PURPOSE_NAME if within == 2 and name in _TEXTS else _ASIDE_NAME).search(names))
    path = _joined(parent.path if parent else "", name + ("." + names if names else ""))
    return Element(name, path, article, aside, path if article > within else parent.root if parent else "")


def blocks_of(page: str) -> tuple[list[tuple[str, str, int, bool, int, str]], Counter]:
    """([(path, text, in an article, aside, characters in links, path of the article)], occurrences of tag tokens), in page order.

    White space in a block is one space; character references are decoded; markup that doesn't nest is closed as browsers do.
    """
    out: list[tuple[str, str, int, bool, int, str]] = []
    tags: Counter = Counter()
    stack: list[Element] = []
    parts: list[str] = []
    in_link, linked = False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _BLANK.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                top = stack[-1] if stack else None
                out.append(
                    (top.path, text, top.article, top.aside, min(linked, len(text)), top.root) if top else ("", text, 0, False, min(linked, len(text)), "")
                )
        linked = 0

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            parts.append(page[at:])
            break
        if start > at:
            parts.append(page[at:start])
            linked += (start - at) * in_link
        m = _TAG.match(page, start)
        if not m:
            parts.append("&lt;")
            at = start + 1
            continue
        at = m.end()
        if m[3] is None:
            if m[1]:
                parts.append(entities.escape(m[1]))
            continue
        name, closing = m[3].lower(), bool(m[2])
        if name in RAW:
            if not closing and not m[4].endswith("/"):
                end = _END_RAW[name].search(page, at)
                close = page.find(">", end.end()) if end else -1
                if close >= 0:
                    at = close + 1
                elif name not in TEXT_ONLY:  # a script or style that doesn't end is all that follows
                    at = n
            continue
        if name in CHOICES:  # a choice's text ends with the next tag
            if not closing:
                end = page.find("<", at)
                at = end if end >= 0 else n
            continue
        if name == "br":
            parts.append(" ")
        if name == "a":
            in_link = not closing
        if name not in BLOCKS:
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if stack[i].name in BARRIERS and name not in BARRIERS:
                    break
            continue
        if name in CLOSES_P and stack and stack[-1].name == "p":
            stack.pop()
        if name in SIBLINGS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in SIBLINGS[name]:
                    del stack[i:]
                    break
                if stack[i].name in BARRIERS - SIBLINGS[name]:
                    break
        stack.append(_opened(stack[-1] if stack else None, name, m[4]))
        tags[stack[-1].path] += 1
    flush()
    return out, tags


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2] or (url or "")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].lower()


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) >> 1


def _is_heading(path: str) -> bool:
    return path.rpartition("/")[2].partition(".")[0] in _HEADINGS


def page_tokens(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(host, token, up, is_text, pages, high, low, chars, linked, around, root): sums over the pages that one task has read. up is the token of the
    element around; chars and linked count the text right in an element, or of all occurrences of a text, and its part in links; token -1 counts the host's pages.
    root is the token of the element that opens the article or main part around the text, 0 outside of any. around counts the text that
    might be the main text along with a text: that of its root, or of the page. Headings in a root are no text tokens and don't count there."""
    names = ["host", "token", "up", "is_text", "pages", "high", "low", "chars", "linked", "around", "root"]

    def run(batches):
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            sums: dict[tuple[int, int, int, bool], list[int]] = {}
            for page, u, h in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                host = _hash(host_of(u))
                blocks, tags = blocks_of(h or "")
                whole = sums.setdefault((host, -1, 0, False), [0, 0, 0, 0, 0, 0, 0])
                whole[0] += 1
                token = {path: _hash(path) for path in tags.keys() | {b[0] for b in blocks}}
                seen = Counter({(token[path], token.get(path.rpartition("/")[0], 0), False): c for path, c in tags.items()})
                roots = ["" if aside else root for _, _, _, aside, _, root in blocks]
                texts = [None if root and _is_heading(b[0]) else _hash(b[0], b[1]) for root, b in zip(roots, blocks, strict=True)]
                own = Counter()
                for t, root, b in zip(texts, roots, blocks, strict=True):
                    own[root] += len(b[1]) * (t is not None)
                around = Counter(own)
                for root, n in own.items():  # articles count in the main part around them
                    while root := root.rpartition("/")[0]:
                        if root in own:
                            around[root] += n
                around[""] = sum(len(b[1]) for b in blocks)
                seen.update((t, token[b[0]], True) for t, b in zip(texts, blocks, strict=True) if t is not None)
                mark = str(page).encode("utf-8", "surrogatepass")
                for (t, up, is_text), c in seen.items():
                    into = sums.setdefault((host, t, up, is_text), [0, 0, 0, 0, 0, 0, 0])
                    into[0] += 1
                    vector = xxhash.xxh64_intdigest(mark, c)
                    into[1] += vector >> 32  # halves, so that sums over all pages of a host fit in longs
                    into[2] += vector & 0xFFFFFFFF
                once = set()
                for t, root, (path, text, _, _, linked, _) in zip(texts, roots, blocks, strict=True):
                    up = token.get(path.rpartition("/")[0], 0)
                    for into in (sums.get((host, token[path], up, False)), sums.get((host, t, token[path], True))):
                        if into is not None:
                            into[3] += len(text)
                            into[4] += linked
                            into[6] = max(into[6], token[root] if root else 0)
                    if t is not None and t not in once:
                        once.add(t)
                        into[5] += around[root]
            if sums:
                columns = [*zip(*sums, strict=True), *zip(*sums.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.bool_() if n == "is_text" else pa.int64()) for n, c in zip(names, columns, strict=True)],
                    names,
                )

    return pages.select(
        key, F.col(url).cast("string").alias("__url"), F.col(html).cast("string").alias("__html")
    ).mapInArrow(run, ", ".join(f"{n} {'boolean' if n == 'is_text' else 'bigint'}" for n in names))


def templates(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """(host, token, is_text, class, parent, pages, share, menu): the tokens of each host's template, with their equivalence class and that of
    the element around.

    A class is the host's tokens of equal occurrence vector. It is valid if its tokens are on min_pages pages and min_share of the
    host's; a class of one page, where any token's vector equals any other's, says nothing. A token whose surrounding element is in no
    valid class has no place in the template and is left out with it. A text is the template's if it is in the class of one of its elements, and the
    texts of that class are no more than MAX_CONSTANT of what its pages hold: else these pages are copies of one another. In an article or main part
    this has to be the class of the element that opens it, the part's own text counts instead of the page's, and frame elements are no menus.
    """
    totals = [F.sum(c).alias(c) for c in ("pages", "high", "low", "chars", "linked", "around")] + [F.max("root").alias("root")]
    sums = page_tokens(pages, key, url, html).groupBy("host", "token", "up", "is_text").agg(*totals)
    frequent = staged(sums.filter((F.col("pages") >= min_pages) | (F.col("token") == -1)), "tokens")
    hosts = frequent.filter("token = -1").select("host", F.col("pages").alias("__all"))
    kept = frequent.filter("token != -1").join(hosts, "host").withColumn(
        "share", F.col("pages") / F.col("__all")
    ).filter(F.col("share") >= min_share)
    valid = staged(kept.withColumn("class", F.xxhash64("host", "pages", "high", "low")), "classes")
    around = valid.filter("not is_text").select("host", F.col("token").alias("up"), F.col("class").alias("parent"))
    nested = valid.join(around, ["host", "up"], "left").filter(
        F.col("parent").isNotNull() | (F.col("up") == 0) | (F.col("up") == _hash(""))
    )
    frame, texts = nested.filter("not is_text"), nested.filter("is_text")
    told = texts.groupBy("host", "class", "root").agg(F.sum("chars").alias("__constant"), F.max("around").alias("__around")).filter(
        F.col("__constant") <= MAX_CONSTANT * F.col("__around")
    ).join(frame, ["host", "class"], "left_semi")
    opened = frame.select("host", F.col("token").alias("root"), F.col("class").alias("__opened"))
    told = told.join(opened, ["host", "root"], "left").filter((F.col("root") == 0) | (F.col("class") == F.col("__opened")))
    constant = texts.join(told.select("host", "class", "root"), ["host", "class", "root"], "left_semi")
    menu = ~F.col("is_text") & (F.col("chars") > 0) & (F.col("linked") >= MENU_SHARE * F.col("chars")) & (F.col("root") == 0)
    return frame.unionByName(constant.select(*frame.columns)).select(
        "host", "token", "is_text", "class", "parent", "pages", "share", menu.alias("menu")
    )


def main_text(page: str, host: int, dropped) -> str:
    """Blocks of main text joined by line ends. dropped(host, token) tells the template's text tokens and menus.

    Slots are what neither of them leaves out, on every page. Articles come before the main part around them, unless that holds more slots of its
    own than they do: then they are cards in it.
    """
    blocks, _ = blocks_of(page)
    slots = [
        (text, article, linked) for path,
        text,
        article,
        aside,
        linked,
        _ in blocks if not aside and not dropped(host, _hash(path, text)) and not dropped(host, _hash(path))
    ]
    chars = Counter()
    for text, article, linked in slots:
        chars[article] += len(text) - linked * (article < 2)
    level = max((article for _, _, article, aside, *_ in blocks if not aside), default=0)
    if level == 2 and chars[1] > chars[2]:
        level = 1
    return "\n".join(text for text, article, _ in slots if article >= level)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", max_sent: int = MAX_SENT) -> DataFrame:
    """(key, url, text) for every row of pages; text is empty if a page has no main text.

    Null html: empty text. Null urls and urls without a host are one host. Malformed, cut off and empty markup is read as far as it goes.
    Repeated rows and ties are extracted each; an empty table gives no rows; other columns are ignored.

    Only templates' text tokens and menus are gathered, after their filter. Up to max_sent they are sent to all tasks as hashes; if there
    are more, they are joined to the pages by host as one array a host. A host's array holds no more than 1 / MIN_SHARE times the tokens of an
    average page, as each is on so large a share of its pages.
    """
    texts = staged(templates(pages, key, url, html).filter("is_text or menu").select("host", "token"), "template")
    small = texts.count() <= max_sent
    kind, url_kind = pages.schema[key].dataType.simpleString(), pages.schema[url].dataType.simpleString()
    rows = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"), F.col(html).cast("string").alias("__html"))
    schema = f"__key {kind}, __url {url_kind}, text string"
    if small:
        codes = texts.select(F.col("host").bitwiseXOR(F.col("token")).alias("code")).toArrow().column("code").to_numpy()
        sent = pages.sparkSession.sparkContext.broadcast(np.unique(codes))

        def within(codes, host, token):
            at = int(np.searchsorted(codes, host ^ token))
            return at < len(codes) and codes[at] == host ^ token

        def run(batches):
            known = sent.value
            for batch in batches:
                out = [
                    main_text(h or "", _hash(host_of(u)), lambda host, token: within(known, host, token)) for u,
                    h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(out, pa.string())], ["__key", "__url", "text"]
                )

        result = rows.mapInArrow(run, schema)
    else:
        by_host = texts.groupBy("host").agg(F.collect_set("token").alias("__tokens"))

        def hosts(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([_hash(host_of(u)) for u in batch.column(1).to_pylist()], pa.int64())],
                    ["__key", "__url", "__html", "host"],
                )

        def joined(batches):
            for batch in batches:
                out = []
                for h, host, tokens in zip(
                    batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True
                ):
                    known = set(tokens or ())
                    out.append(main_text(h or "", host, lambda _, token, known=known: token in known))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(out, pa.string())], ["__key", "__url", "text"]
                )

        named = rows.mapInArrow(hosts, f"__key {kind}, __url {url_kind}, __html string, host bigint")
        result = named.join(by_host, "host", "left").select(
            "__key", "__url", "__html", "host", "__tokens"
        ).mapInArrow(joined, schema)
    return result.select(F.col("__key").alias(key), F.col("__url").alias(url), "text")
