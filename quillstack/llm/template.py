"""HTML extraction by equivalence-class template deduction.

Tokens are the block elements of a page, each at its path. Over the pages of a host they fall into classes by their
occurrence vectors: how often each stands on each page. A vector is not kept but summed as a hash over pages, so that
a host with any number of pages adds up in the map-side combine. Classes whose spans nest make the host's template;
what is between its tokens are slots. One element of the template holds the article: from the root down, it is the
one with most of the text that differs between pages, wherever its place in the page. Texts outside it go, whatever
they say. Within it go the slots of elements that are no article by tag, role or name, on however many pages they
stand and however long they are; and the template's own texts, which stand in nearly all different articles of the
host. The other slots are the page's main text. A name says nothing where it is the article's own: where the only
titles are inside elements so named, or all text that differs.

Hosts with too few different pages have no template: there the page's own elements are all there is to go by.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import batched, materialize, rows, with_rows

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What is left of a tag, up to its end: quotes count after an equals sign only. Nothing is read twice.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+>", re.DOTALL)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.DOTALL)
_DIGITS = re.compile(r"\d+")
_LONG_NUMBER = re.compile(r"&#(?:[xX][0-9a-fA-F]{9,}|[0-9]{9,});?")
#: Words of a class or id: between other characters, and also at capitals and digits.
_PART, _INNER = re.compile(r"[A-Za-z0-9]+"), re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page, up to their end tag; without one, the first ones end the page.
RAW = frozenset("script style title textarea".split())
OPAQUE = RAW | frozenset("noscript template iframe object svg math canvas audio video select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that are not the article, by tag or role.
ASIDE = frozenset("nav footer aside form button dialog menu fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: What an element may be called that is not the article, unless the host's pages or the title tell otherwise.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pager pagination paywall popup promo promotion promoted related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: What a name may end in after the word that tells what it is: share-buttons, related-posts.
HOLDERS = frozenset("area articles bar block box buttons container content form inner items links list outer panel posts slot stories unit widget wrap wrapper".split())
MAIN = ("article", "main")
#: Elements that can hold an article as a whole; others are parts of one.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address details summary caption hr header hgroup".split())
HEADINGS = frozenset("h1 h2 h3".split())
#: What an open element ends when one of these opens directly inside it.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass(frozen=True)
class Settings:
    #: Share of a host's pages on which a class of its template stands.
    share: float = 0.5
    #: Pages that make a template, at least.
    least: int = 3
    #: Share of a host's pages from which a named element has a say in where its articles are.
    named_share: float = 0.01
    #: Share of the different articles of a host that hold a text of the template, and how many these are at least.
    text_share: float = 0.9
    least_articles: int = 4


@dataclass
class Element:
    tag: str
    path: int
    parent: int
    aside: bool  # by its tag, role or visibility, or its parent's
    named: bool  # by the name of its own


@dataclass
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", 0, -1, False, False)])
    #: (text, number of its element)
    blocks: list[tuple[str, int]] = field(default_factory=list)


def _named_aside(name: str) -> bool:
    """Whether a class or id says as a whole, or by its last word, that it is not of the article.

    Words before the last tell of what a section is (related-work, social-history), not that it is an aside.
    """
    words = [w.lower() for part in _PART.findall(name) for w in ([part] if part.lower() in WORDS else _INNER.findall(part))]
    whole = "".join(words)
    while len(words) > 1 and words[-1] in HOLDERS:
        words.pop()
    return bool({whole, *words[-1:]} & WORDS)


def _told(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """(class, hidden or of an aside's role, named) of an element, by its attributes."""
    kind, aside, names = "", False, []
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "class":
            kind += value
            names += value.split()
        elif name == "id":
            names += value.split()
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()) or (name == "role" and value.lower() in ROLES):
            aside = True
    return _DIGITS.sub("", kind), aside, tag not in ("html", "body", *MAIN) and any(map(_named_aside, names))


def _decoded(text: str) -> str:
    try:
        return entities.unescape(text)
    except ValueError:  # a number of more digits than Python reads
        return entities.unescape(_LONG_NUMBER.sub("�", text))


def parse(source: str | None) -> Page:
    """The block elements of a page in order, and the texts between their tags. Linear in the page, however broken."""
    source = source or ""
    page = Page()
    elements, blocks = page.elements, page.blocks
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag; number of the element it is or is in; whether its text goes
    where: dict[str, list[int]] = {}  # by tag: its places in the stack
    solid, mains = [0], [-1]  # places of elements that are not inline, and of article or main
    endless: set[str] = set()  # opaque tags that no end tag follows
    held: list[str] = []
    size, last, plain, at = len(source), source.rfind(">"), False, 0

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            blocks.append((text, stack[solid[-1]][1]))
        held.clear()

    def pop(to: int) -> None:
        while len(stack) > to:
            where[stack.pop()[0]].pop()
            k = len(stack)
            if solid[-1] == k:
                solid.pop()
            if mains[-1] == k:
                mains.pop()

    def keep(start: int, end: int) -> None:
        if end > start and not stack[-1][2]:
            held.append(_decoded(source[start:end]) if source.find("&", start, end) >= 0 else source[start:end])

    while at < size:
        mark = source.find("<", at)
        if mark < 0 or mark > last:  # no tag ends from here on
            break
        if source.startswith("<!--", mark):
            keep(at, mark)
            end = source.find("-->", mark + 2)
            at = size if end < 0 else end + 3
            continue
        if source.startswith(("<!", "<?"), mark):
            keep(at, mark)
            at = source.find(">", mark) + 1
            continue
        closing = source.startswith("/", mark + 1)
        name = _NAME.match(source, mark + 1 + closing)
        if name is None:
            keep(at, mark + 1)
            at = mark + 1
            continue
        keep(at, mark)
        rest = None if plain else _REST.match(source, name.end())
        if rest is None:  # its quotes never end: from here on a tag ends at its first >
            plain = True
            at = source.find(">", mark) + 1
        else:
            at = rest.end()
        tag, attrs = name.group().lower(), source[name.end() : at - 1]
        inline = tag in INLINE
        if not inline:
            flush()
        if closing:
            found = where.get(tag)
            if found and not (found[-1] < solid[-1] if inline else found[-1] < mains[-1] and tag not in ("body", "html", *MAIN)):
                pop(found[-1])
            continue
        if tag in OPAQUE:
            end = None if tag in endless else re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(source, at)
            if end:
                at = source.find(">", end.end()) + 1 or size
            elif tag in RAW:
                at = size
            else:
                endless.add(tag)
            continue
        if inline:
            if tag not in VOID:
                gone = stack[-1][2] or (bool(attrs) and _told(tag, attrs)[1])
                where.setdefault(tag, []).append(len(stack))
                stack.append((tag, stack[-1][1], gone))
            continue
        ends = _ENDS.get(tag, ())
        while stack[-1][0] == "p" or stack[-1][0] in INLINE or stack[-1][0] in ends:  # a block ends a paragraph and what is inline, and its like
            pop(len(stack) - 1)
        if tag in VOID:
            continue
        above = stack[-1][1]
        top = elements[above]
        kind, hidden, named = _told(tag, attrs) if attrs.strip("/ \t\n") else ("", False, False)
        aside = top.aside or tag in ASIDE or hidden or (tag == "header" and mains[-1] < 0)
        if tag == "header" and mains[-1] >= 0:
            named = False  # an article's own header holds its title
        label = f"{tag} {kind}{'!' if hidden else ''}{'?' if named else ''}"
        path = xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), top.path & 0xFFFFFFFFFFFFFFFF) >> 1
        if attrs.endswith("/"):
            continue
        if tag in MAIN:
            mains.append(len(stack))
        solid.append(len(stack))
        where.setdefault(tag, []).append(len(stack))
        stack.append((tag, len(elements), False))
        elements.append(Element(tag, path, above, aside, named))
    keep(at, size)
    flush()
    return page


#: Bits of an element: aside, named, able to hold an article, a heading, article or main, a title.
_ASIDE, _NAMED, _HOLDS, _HEADING, _MAIN, _TITLE = 1, 2, 4, 8, 16, 32


def _kind(e: Element) -> int:
    return _ASIDE * e.aside | _NAMED * e.named | _HOLDS * (e.tag not in PARTS) | _HEADING * (e.tag in HEADINGS) | _MAIN * (e.tag in MAIN) | _TITLE * (e.tag == "h1")


def tokens(page: Page) -> dict[int, list[int]]:
    """By path: [parent's path, kind, occurrences, first place, last place, characters, hash of the texts].

    Characters and texts are of the whole subtree, without its asides.
    """
    chars, texts = [0] * len(page.elements), [0] * len(page.elements)
    for text, k in page.blocks:
        chars[k] += len(text)
        texts[k] += xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    for k in range(len(page.elements) - 1, 0, -1):
        e = page.elements[k]
        if not e.aside:
            chars[e.parent] += chars[k]
            texts[e.parent] += texts[k]
    found: dict[int, list[int]] = {}
    for k, e in enumerate(page.elements):
        own = found.get(e.path)
        if own is None:
            found[e.path] = [page.elements[e.parent].path if k else -1, _kind(e), 1, k, k, chars[k], texts[k] & _LONG]
        else:
            own[2] += 1
            own[4] = k
            own[5] += chars[k]
            own[6] = own[6] + texts[k] & _LONG
    return found


_LONG = (1 << 63) - 1
_SUMS = ("pages", "v1", "v2", "occurs", "first", "last", "chars")
_VECTOR = ("parent", "kind", *_SUMS, "least", "most")


def classes(pages: DataFrame, held: int = 100_000) -> DataFrame:
    """(host, token, ...) from (host, id, html): each token's occurrence vector, as sums over a host's pages.

    v1 and v2 add up to a hash of the vector; first and last are sums of where on a page a token stands first and
    last; chars its characters; least and most the ends of the hashes of its texts, equal where all are.
    """
    out = pa.schema([("host", pa.string()), *((n, pa.int64()) for n in ("token", *_VECTOR))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            sums: dict[tuple[str, int], list[int]] = {}
            for host_, page_id, source in rows(batches, "host", "id", "html"):
                for token, (parent, kind, n, first, last, chars, texts) in tokens(parse(source)).items():
                    v = xxhash.xxh64_intdigest(f"{page_id}:{n}".encode())
                    s = sums.get((host_, token))
                    if s is None:
                        sums[host_, token] = [parent, kind, 1, v >> 32, v & 0xFFFFFFFF, n, first, last, chars, texts, texts]
                        continue
                    for k, x in enumerate((1, v >> 32, v & 0xFFFFFFFF, n, first, last, chars), 2):
                        s[k] += x
                    s[9], s[10] = min(s[9], texts), max(s[10], texts)
                if len(sums) > held:
                    yield from ((h, t, *s) for (h, t), s in sums.items())
                    sums.clear()
            yield from ((h, t, *s) for (h, t), s in sums.items())

        yield from batched(found(), out)

    kinds = "host string, " + ", ".join(f"{n} long" for n in ("token", *_VECTOR))
    whole = [F.max("parent").alias("parent"), F.max("kind").alias("kind"), *(F.sum(n).alias(n) for n in _SUMS), F.min("least").alias("least"), F.max("most").alias("most")]
    return pages.mapInArrow(run, kinds).groupBy("host", "token").agg(*whole)


def nested(group: pd.DataFrame) -> set[int]:
    """The template's tokens: those of the classes by size of span, without classes that straddle a wider one."""
    group = group.assign(first=group["first"] / group["pages"], last=group["last"] / group["pages"])
    spans = group.groupby(["pages", "v1", "v2"]).agg(lo=("first", "min"), hi=("last", "max"), tokens=("token", list)).sort_values(["lo", "hi"], ascending=[True, False])
    kept: set[int] = set()
    open_: list[float] = []
    for lo, hi, found in spans.itertuples(index=False):
        while open_ and open_[-1] < lo:
            open_.pop()
        if open_ and hi > open_[-1]:
            continue
        open_.append(hi)
        kept.update(found)
    return kept


def article(group: pd.DataFrame, settings: Settings = Settings()) -> tuple[int | None, list[int]]:  # noqa: B008
    """(the element of a host's template that holds its articles, named elements in it that are the article's own).

    From the root, a child is entered while it stands once on a page, holds half of the text that differs between
    pages, and leaves no heading that differs and hardly a paragraph behind. An element counts nothing where its texts
    are the same on all pages, unless nearly all of the host is: then its pages are copies, and none is its template.
    Elements named as asides count nothing either, but for those that hold all titles that differ; if nothing that
    differs is left, names tell nothing on the host.
    """
    of = int(group["pages"].max())
    if of < settings.least:
        return None, []
    template = nested(group[group["pages"] >= settings.share * of])
    rows_ = {int(r.token): r for r in group.itertuples(index=False)}
    below: dict[int, list[int]] = {}
    for t, r in rows_.items():
        below.setdefault(int(r.parent), []).append(t)
    same = {t for t, r in rows_.items() if r.least == r.most and r.pages >= settings.least and r.pages >= settings.share * of}

    order = [0] if 0 in rows_ else []
    for t in order:  # parents before what is in them
        order += below.get(t, ())
    if 0 not in template:
        return None, []

    def told(asides: set[int]) -> tuple[dict[int, int], dict[int, int], set[int], set[int]]:
        """(characters, those that differ) of elements without asides; those with a heading, a title that differs."""
        chars: dict[int, int] = {}
        differs: dict[int, int] = {}
        headed: set[int] = set()
        titled: set[int] = set()
        for t in reversed(order):
            own = [c for c in below.get(t, ()) if not rows_[c].kind & _ASIDE]
            gone = sum(int(rows_[c].chars) - chars[c] for c in own)
            alike = sum(chars[c] - differs[c] for c in own)
            chars[t] = 0 if t in asides else int(rows_[t].chars) - gone
            differs[t] = 0 if t in asides or t in same else chars[t] - alike
            if differs[t] > 0 and (rows_[t].kind & _HEADING or any(c in headed for c in own)):
                headed.add(t)
            if differs[t] > 0 and (rows_[t].kind & _TITLE or any(c in titled for c in own)):
                titled.add(t)
        return chars, differs, headed, titled

    named = {t for t in order if rows_[t].kind & _NAMED and not rows_[t].kind & _ASIDE}
    titled = told(set())[3]
    asides = named if 0 in told(named)[3] else named - titled
    chars, differs, headed, _ = told(asides)
    if not differs[0]:
        asides = set()
        chars, differs, headed, _ = told(asides)
    if not chars[0] or differs[0] < 0.1 * chars[0]:
        return None, []
    at = 0
    while True:
        near = [c for c in below.get(at, ()) if not rows_[c].kind & _ASIDE and c not in asides]
        inner = [c for c in near if rows_[c].kind & _HOLDS]
        whole = differs[at]
        into = max((c for c in inner if c in template and rows_[c].occurs <= 1.1 * rows_[c].pages), key=lambda c: (differs[c], -rows_[c].first), default=None)
        if into is None or differs[into] < 0.5 * whole or whole - sum(differs[c] for c in inner) > 0.05 * whole:
            break
        if any(c in headed and c != into for c in near):
            break
        at = into
    inside, todo = [], [at]
    while todo:
        todo += (own := below.get(todo.pop(), ()))
        inside += own
    return at, sorted(set(inside) & named - asides)


def templates(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(host, article, kept) from (host, id, html): see ``article``. Hosts without a template have no row.

    A host's group holds the tokens on ``share`` of its pages, 1 / share times as many as a page has at most, and the
    named ones on ``named_share`` of them.
    """
    found = materialize(classes(pages).where(F.col("pages") >= settings.least), "tokens")
    sizes = found.where("token = 0").select("host", F.col("pages").alias("of"))
    share = F.when(F.col("kind").bitwiseAND(_NAMED) > 0, settings.named_share).otherwise(settings.share)
    frequent = found.join(sizes, "host").where(F.col("pages") >= share * F.col("of")).drop("of")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        at, kept = article(group, settings)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "article": [at], "kept": [kept]}).astype({"article": "Int64"})

    return frequent.groupBy("host").applyInPandas(one, "host string, article long, kept array<long>").where("article IS NOT NULL")


def slots(page: Page, holder: int | None = None, kept: Iterable[int] = ()) -> list[tuple[str, int]]:
    """(text, path) of the slots that may be the article's: of the holder's elements, without asides by tag, role or name.

    ``kept`` are named elements in the holder that are the article's own on its host; others are where the holder has
    no title but in elements so named. Without a holder, or on a page that does not have it: of the article, or else of
    main, or else of all.
    """
    kept = set(kept)
    n = len(page.elements)
    out, inside, named = [False] * n, [""] * n, [False] * n
    known = holder is not None and any(e.path == holder and not e.aside for e in page.elements)
    if known:
        for k, e in enumerate(page.elements):
            if k:
                out[k], inside[k], named[k] = out[e.parent] or e.aside, inside[e.parent], named[e.parent]
            named[k] = named[k] or (inside[k] == "holder" and e.named and e.path not in kept)
            inside[k] = inside[k] or ("holder" if e.path == holder else "")
        titles = [k for k, e in enumerate(page.elements) if e.tag == "h1" and inside[k] and not out[k]]
        own: set[int] = set()
        if titles and all(named[k] for k in titles):  # names of what the first title is in are the article's
            at = titles[0]
            while at:
                own.add(at)
                at = page.elements[at].parent
        for k, e in enumerate(page.elements):
            if k:
                out[k] = out[k] or out[e.parent] or (inside[e.parent] == "holder" and e.named and e.path not in kept and k not in own)
    else:
        for k, e in enumerate(page.elements):
            if k:
                out[k], inside[k] = out[e.parent], inside[e.parent]
            if e.tag in MAIN:
                out[k] = e.aside  # a wrapper's name does not make an article an advert
                inside[k] = e.tag if inside[k] != "article" else inside[k]
            else:
                out[k] = out[k] or e.aside or e.named
    found = [(text, k) for text, k in page.blocks if not out[k]]
    kind = next((w for w in ("holder", *MAIN) if any(inside[k] == w for _, k in found)), "holder" if known else "")
    return [(text, page.elements[k].path) for text, k in found if not kind or inside[k] == kind]


def host(url: Column) -> Column:
    """After the first ://, up to / ? #, in lower case; empty without."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def own_texts(found: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(host, template) from (host, digest, hashes): hashes of the texts that nearly all different articles hold.

    Articles of equal texts count once, so that a page with many copies is no template; what three articles share may
    be a passage of theirs.
    """
    each = materialize(found.groupBy("host", "digest").agg(F.first("hashes").alias("hashes")), "articles")
    sizes = each.groupBy("host").agg(F.count("*").alias("of")).where(F.col("of") >= settings.least_articles)
    held = each.select("host", F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    often = held.where(F.col("n") >= settings.text_share * settings.least_articles).join(sizes, "host").where(F.col("n") >= settings.text_share * F.col("of"))
    return often.groupBy("host").agg(F.collect_list("hash").alias("template"))  # as many as an article has texts, about


def extract(pages: DataFrame, settings: Settings = Settings(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:  # noqa: B008
    """(id_col, url_col, text, n_chars) for every row; text is the main text, empty where there is none.

    Blocks are texts between block tags: character references decoded, white space one space, trimmed; they are
    joined by one space in page order, and none is dropped or cut but by its place and the host's template. Null html
    is an empty page. Pages without a host make one group, as do those with a null URL. A host with under ``least``
    pages, or whose pages are all alike, has no template. Repeated rows have equal texts; articles of a host with
    equal texts count once for what texts are its template's. An empty table gives an empty result.
    """
    thin = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    thin = thin.withColumn("host", host(F.col("url")))
    vectors = with_rows(thin).select("host", F.xxhash64("row").alias("id"), "html")
    known = materialize(templates(vectors, settings), "templates")
    out = pa.schema([("id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("texts", pa.list_(pa.string())), ("hashes", pa.list_(pa.int64())), ("digest", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for i, url, host_, source, holder, kept in rows(batches, "id", "url", "host", "html", "article", "kept"):
                own = slots(parse(source), holder, kept or ())
                texts = [t for t, _ in own]
                hashes = [xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), path) >> 1 for t, path in own]
                yield i, url, host_, texts, hashes, xxhash.xxh64_intdigest("\n".join(texts).encode("utf-8", "replace")) >> 1

        yield from batched(found(), out, 256)

    kinds = "id long, url string, host string, texts array<string>, hashes array<long>, digest long"
    cut = thin.join(known, "host", "left").select("id", "url", "host", "html", "article", "kept").mapInArrow(run, kinds)
    cut = materialize(cut, "slots")
    own = materialize(own_texts(cut.select("host", "digest", "hashes"), settings), "texts")
    slot = F.transform(F.arrays_zip("texts", "hashes"), lambda x: F.when(F.array_contains("template", x["hashes"]), F.lit(None)).otherwise(x["texts"]))
    text = F.array_join(F.when(F.col("template").isNull(), F.col("texts")).otherwise(slot), " ")  # leaves nulls out
    found = cut.join(own, "host", "left").select("id", "url", text.alias("text"))
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
