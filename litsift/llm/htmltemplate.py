"""HTML extraction by equivalence classes of template tokens.

The tokens of a page are its elements, told apart by their path from the root with classes,
and its text blocks, told apart by path and text. Over the distinct contents of a host (the
texts of a page; copies count once) each token has an occurrence vector: its count on every
page. A commutative hash of (page, count) stands for the vector, so vectors of any number of
pages combine before a shuffle and no host's pages ever meet in one task.

Tokens of a host with equal vectors on ``MIN_PAGES`` pages or more form a class. A class is
valid with an element token; its text tokens below that element are the template's own text.
Classes nest by their paths. Where the template's elements leave slots, the slots are
extracted: on a page with an article or a main element the slots in it; elsewhere
those in the deepest once-a-page element that holds ``REGION_SHARE`` of the host's slot
text, or of the body without one. In an article, paths begin at it, and template text is that
of boxes: elements with a class or id, on ``REGION_PAGES`` of the host's pages, all of whose
text is in their class. Repeated passages of articles outside such boxes stay.

Slots in menus, headers, footers, sidebars, notices, adverts, forms and reader comments are
left out by element, role and class or id words. Words are hints, on a host of any size. The template
may clear one whose elements are on ``REGION_PAGES`` of the host's pages and hold ``REGION_SHARE`` of
all its text, as the frame of the main slots does. In articles and main a class is a hint if
all its words are such words or words for parts of a page (``comment-list``, ``ad-banner``, but not
``share-price``). So are ids for reader comments; other ids only as a whole, if they recur, and not those of
headings, paragraphs and sections, which are made from titles.

An article stands for its page unless the main element around or beside it holds more text.

Elements nested more than ``DEPTH`` deep count as parts of the one at that depth when tokens are
told apart; their text stays.

What the template says about a page reaches it as marks of its own tokens, joined by host and
token, so no host's template is held in one row.

A null html is an empty page with an empty text. Pages of a null or odd url share the empty
host. Unclosed and stray tags are closed and
ignored as browsers mostly do; a tag cut off by the page's end is dropped. Extra columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pages of a host that a template token occurs on at least.
MIN_PAGES = 3
#: Share of a host's pages that its text region occurs on, and of its slot text that it holds.
REGION_PAGES, REGION_SHARE = 0.5, 0.7
#: Levels of a path.
DEPTH = 64
#: Ways that a mark of a host is dealt out.
SALTS = 16
#: What a token is: an element, a text outside articles, a box of an article, a text in it, a hint.
ELEMENT, TEXT, BOX, BOXED, HINT = range(5)
#: Start of the name of a hint that needs evidence.
WEAK = "#"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_HOST = re.compile(r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

#: Elements that stand inside a block of text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = set("script style noscript template textarea iframe title xmp noembed noframes svg math canvas object "
          "audio video".split())
#: Elements, roles and words of a class or id that hold no main text.
DROPPED = set("head nav header footer aside form menu dialog button select fieldset".split()) | RAW
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
                    "toolbar form".split())
DROPPED_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors "
    "promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "sidebar sidebars sidenav aside widget widgets menu menus submenu nav navi navbar navigation topnav breadcrumb "
    "breadcrumbs header headers masthead footer footers comment comments commentlist disqus reply replies share "
    "sharing social related recommended newsletter subscribe subscription signup login pagination pager toolbar "
    "copyright form".split())
COMMENT_WORDS = set("comment comments commentlist disqus reply replies".split())
#: Words for the parts of a page, which make a class or id no name of its own.
PART_WORDS = set("area bar block bottom box button buttons container content footer group header holder inner item items "
                 "left line link links list outer panel post reader readers right row section site slot thread top unit "
                 "user users wrap wrapper zone".split())
_KEPT = set("html body main".split())
#: Elements whose id is made from a title.
_OWN_IDS = set("h1 h2 h3 h4 h5 h6 p section".split())
#: Start tags that end an open paragraph.
_ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
              "header hr main menu nav ol p pre section table ul".split())
_ENDS_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
              "th": {"tr", "table"}, "option": {"select"}}


def _furniture(value: str, names: set[str]) -> set[str]:
    """The words of a class or id that are ``names``, if all others are words for parts of a page or numbers."""
    own = _WORD.findall(value)
    return set(own) & names if all(w in names or w in PART_WORDS or w.isdigit() for w in own) else set()


def _read(name: str, attributes: str, inside: bool) -> tuple[bool, tuple[str, ...], str]:
    """Whether an element never holds main text, its hints that it may not, and its name with class and id for paths.

    In an article or main, a whole id is a weak hint only.
    """
    label, role, hints = name, "", []
    classes: set[str] = set()
    ids: set[str] = set()
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if key.lower() == "role":
            role = value.strip()
            continue
        (classes if key.lower() == "class" else ids).update(value.split())
        label += "." + "-".join("0" if w.isdigit() else w for w in _WORD.findall(value))
    if name in DROPPED:
        return True, (), label
    if name in _KEPT:
        return False, (), label
    if name == "article":
        found = {w for c in classes for w in _WORD.findall(c)[:1]} & COMMENT_WORDS
    elif inside:
        found = {w for c in classes for w in _furniture(c, DROPPED_WORDS)} | {w for c in ids for w in _furniture(c, COMMENT_WORDS)
                                                                             if w in ("comments", "commentlist", "disqus")}
        weak = set() if found or name in _OWN_IDS else ids & DROPPED_WORDS
        if weak:
            hints.append(f"{WEAK}{name}:{' '.join(sorted(weak))}")
    else:
        named = classes if name in _OWN_IDS else classes | ids
        found = {w for c in named for w in _WORD.findall(c)} & DROPPED_WORDS
    if found:
        hints.append(f"{name}:{' '.join(sorted(found))}")
    return name != "article" and role in DROPPED_ROLES, tuple(hints), label


class Block(NamedTuple):
    """A block of text: its path, letters in links, place, hints, in an article the path and the boxes in it, and
    whether main holds it."""

    path: str
    text: str
    links: int
    place: str
    hints: tuple[str, ...]
    inner: str
    boxes: tuple[str, ...]
    main: bool = False


class Open(NamedTuple):
    name: str
    path: str
    dropped: bool
    hints: tuple[str, ...]
    inner: str
    boxes: tuple[str, ...]


class Page:
    """The elements of a page, the boxes (elements with a class or id) in its articles, hints and blocks."""

    def __init__(self, source: str):
        self.elements: dict[str, int] = {}
        self.boxes: dict[str, int] = {}
        self.hints: dict[str, int] = {}
        self.blocks: list[Block] = []
        stack: list[Open] = []
        places: dict[str, list[int]] = {}  # where in the stack each name is open
        text: list[str] = []
        self._linked = links = 0
        end, size = 0, len(source)

        def flush() -> None:
            nonlocal links
            joined = " ".join("".join(text).split())
            if joined:
                at = stack[-1] if stack else Open("", "", False, (), "", ())
                place = "" if at.dropped else "article" if places.get("article") else "main" if places.get("main") else "body"
                self.blocks.append(Block(at.path, joined, min(links, len(joined)), place, at.hints, at.inner, at.boxes,
                                         bool(places.get("main"))))
            text.clear()
            links = 0

        def close(depth: int) -> None:
            if any(s.name not in INLINE for s in stack[depth:]):
                flush()
            for s in stack[depth:]:
                places[s.name].pop()
            del stack[depth:]

        def find(names: set[str], stop: set[str] = frozenset()) -> int:
            """Where the innermost of some elements is open, if none of the others is open within it."""
            depth = max((places[n][-1] for n in names if places.get(n)), default=-1)
            return -1 if any(places.get(n) and places[n][-1] > depth for n in stop) else depth

        for match in _TOKEN.finditer(source):
            if match.start() < end:
                continue
            if match.start() > end:
                piece = html.unescape(source[end:match.start()])
                text.append(piece)
                if places.get("a"):
                    links += len(piece.strip())
            end = match.end()
            name = match[2]
            if name is None:
                if match[0].startswith("<![CDATA["):
                    text.append(match[0][9:].removesuffix("]]>"))
                continue
            name = name.lower()
            if match[1]:
                depth = find({name})
                if depth >= 0:
                    close(depth)
                elif name == "p":
                    flush()
                continue
            if name not in INLINE:
                if name in _ENDS_P and (depth := find({"p"}, {"button", "td", "th", "table"})) >= 0:
                    close(depth)
                elif name in _ENDS_SAME:
                    same = {"dt", "dd"} if name in ("dt", "dd") else {"td", "th"} if name in ("td", "th") else {name}
                    if (depth := find(same, _ENDS_SAME[name])) >= 0:
                        close(depth)
                flush()
            if name in VOID:
                continue
            above = stack[-1] if stack else Open("", "", False, (), "", ())
            inside = bool(above.inner) or bool(places.get("main"))
            dropped, hints, label = _read(name, match[3], inside)
            path, inner, boxes = above.path, above.inner, above.boxes
            if name not in INLINE and path.count("/") < DEPTH:
                path = f"{path}/{label}"
                if inner:
                    inner = f"{inner}/{label}"
                    if label != name:
                        self.boxes[inner] = self.boxes.get(inner, 0) + 1
                        boxes = (*boxes, inner)
                else:
                    self.elements[path] = self.elements.get(path, 0) + 1
                    inner = "article" if name == "article" else ""
            for hint in hints:
                self.hints[hint] = self.hints.get(hint, 0) + 1
            if name in RAW and not match[3].endswith("/"):
                shut = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, end)
                end = shut.end() if shut else size
            elif not (match[3].endswith("/") and name in RAW):
                places.setdefault(name, []).append(len(stack))
                more = tuple(h for h in hints if h not in above.hints)
                stack.append(Open(name, path, dropped or above.dropped, above.hints + more, inner, boxes))
        if end < size:
            text.append(html.unescape(source[end:]))
        flush()

    def shown(self, marks: set[int] = frozenset()) -> list[Block]:
        """The blocks that no hint takes away: weak hints need a mark to hold, others one to fail."""
        def holds(hint: str) -> bool:
            return (_token("hint", hint) in marks) == hint.startswith(WEAK)

        return [b for b in self.blocks if b.place and not any(map(holds, b.hints))]

    def text(self, region: str | None, template: set[int]) -> str:
        """The blocks of the main slots; ``template`` holds the host's marks."""
        shown = self.shown(template)
        wanted = _place(shown)
        own = [b for b in shown if (b.main if wanted == "main" else b.place == wanted) and _key(b) not in template]
        if wanted == "body":
            region = region or next((p for p in self.elements if _token("region", p) in template), None)
            inside = [b for b in own if region and (b.path == region or b.path.startswith(region + "/"))]
            own = inside or own
        return "\n".join(b.text for b in own)

    def counts(self) -> dict[tuple[int, str, int], list[int]]:
        """n and letters by (kind, path, key) of the tokens; letters of a box are its blocks."""
        out = {(ELEMENT, "", 0): [1, 0]}
        out |= {(ELEMENT, path, _token("region", path)): [n, 0] for path, n in self.elements.items()}
        out |= {(BOX, path, 0): [n, 0] for path, n in self.boxes.items()}
        out |= {(HINT, hint, _token("hint", hint)): [n, 0] for hint, n in self.hints.items()}
        out[HINT, "", 0] = [1, 0]
        for b in self.blocks:
            for hint in ("", *b.hints) if b.place else ():
                out[HINT, hint, _token("hint", hint) if hint else 0][1] += len(b.text) - b.links
            for box in b.boxes:
                out[BOX, box, 0][1] += 1
                if b.place:
                    out.setdefault((BOXED, box, _key(b)), [0, 0])[0] += 1
            if not b.place:
                continue
            if not b.inner:
                out.setdefault((TEXT, b.path, _key(b)), [0, 0])[0] += 1
            if not any(not h.startswith(WEAK) for h in b.hints):
                path, letters = b.path, len(b.text) - b.links
                while path:
                    if path in self.elements:
                        out[ELEMENT, path, _token("region", path)][1] += letters
                    path = path.rpartition("/")[0]
                out[ELEMENT, "", 0][1] += letters
        return out

    def keys(self) -> set[int]:
        """The keys whose marks can change this page's text."""
        shown = self.shown()
        weak = any(h.startswith(WEAK) for h in self.hints)
        article = any(b.place == "article" for b in shown) and not weak and not any(b.place == "main" for b in self.blocks)
        out = {_token("hint", h) for b in self.blocks if b.place and (b.inner or not article) for h in b.hints}
        out |= {_key(b) for b in self.blocks if b.place and (b.boxes or not b.inner and not article)}
        if weak or not any(b.place in ("article", "main") for b in shown):
            out |= {_token("region", p) for p in self.elements}
        return out

    def signature(self) -> int:
        """A hash of the texts shown (of all, if hints take all away), the same for copies in other markup."""
        texts = self.shown() or [b for b in self.blocks if b.place]
        return xxhash.xxh64_intdigest("\0".join(b.text for b in texts)) - (1 << 63)


def _place(shown: list[Block]) -> str:
    """Where a page's main text stands: in its articles, in main if that holds more beside them, else in the body."""
    articles = sum(len(b.text) for b in shown if b.place == "article")
    beside = sum(len(b.text) - b.links for b in shown if b.place == "main")
    return "main" if beside > articles else "article" if articles else "body"


def _token(path: str, text: str) -> int:
    """A hash of a text token, as a signed number."""
    return xxhash.xxh64_intdigest(f"{path}\0{text}") - (1 << 63)


def _key(block: Block) -> int:
    return _token(block.inner or block.path, block.text)


_PARSED = pa.schema([
    ("host", pa.string()), ("digest", pa.string()), ("signature", pa.int64()), ("keys", pa.list_(pa.int64())),
    ("tokens", pa.list_(pa.struct([("kind", pa.int32()), ("path", pa.string()), ("key", pa.int64()),
                                   ("n", pa.int64()), ("letters", pa.int64())])))])


def _parsed(source: DataFrame) -> DataFrame:
    """(host, digest, signature, keys, tokens) of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "html"):
                pages = [Page(body or "") for body in part.column("html").to_pylist()]
                tokens = [[(*k, *v) for k, v in page.counts().items()] for page in pages]
                flat = list(zip(*[t for own in tokens for t in own]))
                inner = _PARSED.field("tokens").type.value_type
                structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, inner)], fields=list(inner))
                offsets = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("host"), part.column("digest"), pa.array([p.signature() for p in pages], pa.int64()),
                    pa.array([list(p.keys()) for p in pages], pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array(offsets), structs, type=_PARSED.field("tokens").type)],
                    names=_PARSED.names)

    return source.select("host", "digest", "html").mapInArrow(
        run, "host string, digest string, signature long, keys array<long>, "
             "tokens array<struct<kind:int,path:string,key:long,n:long,letters:long>>")


def _tokens(parsed: DataFrame) -> DataFrame:
    """(host, kind, path, key, vector, pages, total, letters): occurrence vectors over distinct contents."""
    pages = parsed.groupBy("host", "signature").agg(F.min_by("tokens", "digest").alias("tokens"))
    return pages.select("host", "signature", F.explode("tokens").alias("t")).groupBy("host", "t.kind", "t.path", "t.key").agg(
        F.bit_xor(F.xxhash64("signature", "t.n")).alias("vector"), F.count("*").alias("pages"),
        F.sum("t.n").alias("total"), F.sum("t.letters").alias("letters"))


def deduce(tokens: DataFrame) -> DataFrame:
    """(host, key): marks of each host's template texts, its text region, hints that are cleared and weak ones that hold."""
    def of(kind: int) -> DataFrame:
        return tokens.filter((F.col("kind") == kind) & (F.col("pages") >= MIN_PAGES)).drop("kind")

    same = ["host", "vector", "pages", "total"]
    whole = tokens.filter(f"kind = {ELEMENT} and path = ''").select(
        "host", F.col("pages").alias("all"), F.col("letters").alias("every"))
    elements = of(ELEMENT).filter("path <> ''")
    texts = of(TEXT).join(elements.select(*same, F.col("path").alias("above")), same).filter(
        (F.col("path") == F.col("above")) | F.col("path").startswith(F.concat("above", F.lit("/")))).select("host", "key")
    # boxes of articles: on most pages, and all their text is the template's own
    boxes = of(BOX).join(whole, "host").filter(F.col("pages") >= REGION_PAGES * F.col("all")).select(
        *same, "path", F.col("letters").alias("blocks"))
    boxed = of(BOXED).drop("letters").join(boxes, [*same, "path"])
    fixed = boxed.groupBy("host", "path").agg(F.sum("total").alias("own"), F.max("blocks").alias("blocks")).filter(
        "own = blocks").select("host", "path")
    depth = F.size(F.split("path", "/"))
    region = elements.filter("pages = total").join(whole, "host").filter(
        (F.col("pages") >= REGION_PAGES * F.col("all")) & (F.col("letters") > 0)
        & (F.col("letters") >= REGION_SHARE * F.col("every"))
    ).groupBy("host").agg(F.max_by("key", F.struct(depth, "letters", "path")).alias("key"))
    weak = F.col("path").startswith(WEAK)
    everything = tokens.filter(f"kind = {HINT} and path = ''").select(
        "host", F.col("pages").alias("all"), F.col("letters").alias("every"))
    frame = (F.col("pages") >= REGION_PAGES * F.col("all")) & (F.col("letters") >= REGION_SHARE * F.col("every"))
    hints = of(HINT).filter("path <> ''").join(everything, "host").filter(weak | frame).select("host", "key")
    return texts.union(boxed.join(fixed, ["host", "path"]).select("host", "key")).union(region).union(hints).distinct()


def _marks(parsed: DataFrame, marks: DataFrame) -> DataFrame:
    """(host, digest, marks) of the pages that have any; a key is dealt out ``SALTS`` ways, for hosts of many pages."""
    salted = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = parsed.filter(F.size("keys") > 0).dropDuplicates(["host", "digest"]).select(
        "host", "digest", F.explode("keys").alias("key"), F.pmod(F.hash("digest"), F.lit(SALTS)).alias("salt"))
    return keys.join(salted, ["host", "key", "salt"]).groupBy("host", "digest").agg(F.collect_set("key").alias("marks"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    spark = pages.sparkSession
    common.prepare(spark)
    scratch = common.Scratch(spark, "template")
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                          F.col(html_col).cast("string").alias("html"))
    source = source.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1)))
    source = source.withColumn("digest", F.md5(F.coalesce("html", F.lit(""))))
    parsed = scratch.keep(_parsed(source), "parsed")
    found = scratch.keep(deduce(scratch.keep(_tokens(parsed), "tokens")), "marks")
    marks = scratch.keep(_marks(parsed, found), "pages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "html"):
                out = [Page(body or "").text(None, set(own or ())) for body, own in
                       zip(*[part.column(c).to_pylist() for c in ("html", "marks")])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])

    joined = source.join(marks, ["host", "digest"], "left").select("id", "url", "html", "marks")
    kind = source.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, url string, text string").withColumnsRenamed(
        {"id": id_col, "url": url_col})


def op2_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
