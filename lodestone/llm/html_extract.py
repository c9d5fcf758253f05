"""HTML extraction by equivalence classes of template tokens.

Pages of one host are read in chunks of at most ``CHUNK``. Every page becomes tokens, tags and
words, each told apart by the path of elements above it. Tokens with the same vector of
occurrences over a chunk's pages form an equivalence class; a class is valid if enough pages
have it and its tokens come in the same order, once per occurrence, on every page. Valid
classes are nested by the gaps of one another into the host's template. A block of text (up to
the next block element) is a token too, so that its words are told from the same words
elsewhere. What lies in the gaps and is no template block are the slots, whole blocks each; the
main container is the deepest element that holds all of the slots' text outside boilerplate
elements, or the largest article or main. An element that only its class, id or role marks as
boilerplate is none where it holds most of the slots' text (of that in article or main, if any). The text of a page is that of the slots in its container, without the boilerplate
elements inside; where the template would take over half of the container's text, as among near
copies of one article, which cannot be told from template, the container is kept whole. A page
without its host's container, or alone in its chunk, is judged by itself in the same way.

Defined results: null or empty html gives an empty text of 0 characters; a null url is a host
of its own; unclosed and truncated markup is read as far as it goes. Equal pages are deduced
from once, so copies don't turn an article into template. Hosts are dealt over blocks by
their number of pages, and a block's stream is cut into chunks, so no task or group is
unbounded and a hot host spreads. Extra columns are dropped but those asked for.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, read, tidied

CHUNK = 64
#: Hosts up to which their numbers of pages are broadcast (a few MB).
HOSTS = 100_000
#: Share of a chunk's pages that have to hold a template token, and tokens of a valid class.
SUPPORT = 0.6
CLASS_SIZE = 2
#: Pages that have to hold a block of the main container before it counts as template: fewer may share a title by chance.
BLOCK_PAGES = 5

#: Elements that never hold main text, and those that do by their meaning.
BOILERPLATE = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea object canvas dialog menu".split())
MAIN = ("article", "main")
#: Words in class, id or role that mark boilerplate.
MARKED = frozenset(
    "ad ads advert adverts advertisement banner sidebar menu nav navbar navigation footer header masthead cookie cookies consent notice notices "
    "alert popup modal comment comments commentlist disqus promo promotion sponsor sponsored related recommended share sharing social breadcrumb breadcrumbs "
    "newsletter subscribe subscription signup login pagination pager toolbar widget contentinfo complementary search".split()
)
#: Of these, the words that an article uses for parts of its own.
IN_ARTICLE = frozenset("alert header search toolbar widget banner navigation nav navbar menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag is implied by the start of one of the same kind.
IMPLIED = {"p": ("article", "div", "section", "body", "td", "li", "blockquote", "main"), "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
#: Starts of these also end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title)\b((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>(.*?)(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?][^>]*>?|([^<]+|<)",
    re.S | re.I,
)
_MARK_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[^\s_-]+")
_SPACE = re.compile(r"\s+")
#: Begins the value of a token that is a whole block.
BLOCK = "\0"
#: The mark of what is boilerplate by its element.
HARD = "\0hard"


class Page:
    """tokens: (path, value, is a word, marks); texts: (path, piece, a block break comes before, marks); blocks: each piece's (path, BLOCK + text).

    Marks are the paths of the elements above that a word marks as boilerplate, and HARD below an element that always is.
    """

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str, bool, tuple[str, ...]]] = []
        self.texts: list[tuple[str, str, bool, tuple[str, ...]]] = []
        stack: list[tuple[str, str, tuple[str, ...]]] = [("", "", ())]  # name, path, marks
        fresh = True
        begins: list[int] = []  # of each piece, in tokens

        def pop_to(k: int) -> None:
            nonlocal fresh
            for name, path, off in reversed(stack[k:]):
                self.tokens.append((path, f"</{name}>", False, off))
                fresh = fresh or name not in INLINE
            del stack[k:]

        for m in _TOKEN.finditer(source):
            raw, slash, tag, attrs, text = m[1], m[4], m[5], m[6], m[7]
            if text is not None:
                if text == "<" or not text.isspace():
                    _, path, off = stack[-1]
                    piece = _html.unescape(text)
                    self.texts.append((path, piece, fresh, off))
                    begins.append(len(self.tokens))
                    self.tokens += [(path, w, True, off) for w in piece.split()]
                    fresh = False
                elif self.texts:
                    self.texts.append((stack[-1][1], " ", fresh, stack[-1][2]))
                    begins.append(len(self.tokens))
                    fresh = False
                continue
            if raw:  # its content is no markup, and none is main text
                continue
            if tag is None:
                continue
            name = tag.lower()
            if slash:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        pop_to(k)
                        break
                else:
                    fresh = fresh or name not in INLINE
                continue
            if name == "br" or name in VOID:
                fresh = fresh or name in ("br", "hr")
                continue
            closes = name if name in IMPLIED else "p" if name in ENDS_P else None
            if closes:
                stop = IMPLIED[closes]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == closes or (name in ENDS_P and stack[k][0] == "p"):
                        pop_to(k)
                        break
                    if stack[k][0] in stop:
                        break
            _, above, off = stack[-1]
            marks = " ".join(sorted(_WORDS.findall(" ".join(a or b or c for a, b, c in _MARK_ATTR.findall(attrs)).lower()))) if attrs else ""
            path = f"{above}/{name}{'.' + marks if marks and not any(c.isdigit() for c in marks) else ''}"
            if name in BOILERPLATE or (name == "header" and not any(x in above for x in MAIN)):
                off = off if HARD in off else (*off, HARD)
            elif marks and name not in ("html", "body", *MAIN) and not (MARKED - IN_ARTICLE if any(x in _named(above) for x in MAIN) else MARKED).isdisjoint(marks.split()) and path not in off:
                off = (*off, path)
            if name not in INLINE:
                fresh = True
            if not attrs.rstrip().endswith("/") or name in MAIN:
                stack.append((name, path, off))
            self.tokens.append((path, f"<{name}>", False, off))
        pop_to(1)
        self._join(begins)

    def _join(self, begins: list[int]) -> None:
        """Names each piece's block and puts the blocks before their words."""
        if not self.texts:
            self.blocks: list[tuple[str, str]] = []
            return
        firsts = [k for k, (_, _, fresh, off) in enumerate(self.texts) if not k or fresh or off != self.texts[k - 1][3]]
        self.blocks = []
        at: dict[int, tuple[str, str, bool, tuple[str, ...]]] = {}
        for k, end in zip(firsts, [*firsts[1:], len(self.texts)], strict=True):
            text = _SPACE.sub(" ", "".join(t[1] for t in self.texts[k:end])).strip()
            key = (self.texts[k][0], BLOCK + text)
            self.blocks += [key] * (end - k)
            if text:
                at[begins[k]] = (*key, False, self.texts[k][3])
        self.tokens = [t for i, x in enumerate(self.tokens) for t in ((at[i], x) if i in at else (x,))]

    def masses(self, without: frozenset = frozenset()) -> Counter:
        """Characters of text by (path, marks), but of blocks in without."""
        out: Counter = Counter()
        for (path, piece, _, off), block in zip(self.texts, self.blocks, strict=True):
            if HARD not in off and block not in without and not piece.isspace():
                out[path, off] += len(piece)
        return out

    def text(self, container: str, lifted: frozenset, template: frozenset = frozenset()) -> str | None:
        """The container's blocks joined by blanks, without those of a template; marks in lifted don't count; None if the page has no such element."""
        blocks: list[list[str]] = []
        there = False
        broken = True
        inside = container + "/"
        for (path, piece, fresh, off), block in zip(self.texts, self.blocks, strict=True):
            if path != container and not path.startswith(inside):
                broken = True
                continue
            there = True
            if not lifted.issuperset(off) or block in template:
                broken = True
                continue
            if fresh or broken:
                blocks.append([])
            broken = False
            blocks[-1].append(piece)
        if not there and not any(t[0] == container for t in self.tokens):
            return None
        joined = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks)
        return " ".join(b for b in joined if b)


class Template:
    """Valid equivalence classes of a chunk, nested: each is (vector, tokens in order, parent, gap of the parent)."""

    def __init__(self, pages: list[Page], support: float = SUPPORT, size: int = CLASS_SIZE):
        self.pages = len(pages)
        counts = [Counter((p, v) for p, v, _, _ in page.tokens) for page in pages]
        spread: Counter = Counter()
        for c in counts:
            spread.update(c.keys())
        least = max(2, support * len(pages))
        by_vector: dict[tuple, set] = defaultdict(set)
        for token, n in spread.items():
            if n >= least:
                by_vector[tuple(c[token] for c in counts)].add(token)
        self.classes = []
        for vector, members in by_vector.items():
            order = self._ordered(pages, vector, members) if sum(map(self._words, members)) >= size else None
            if order:
                self.classes.append([vector, order, None, None])
        # the root is on most pages, once; the most tokens decide
        self.classes.sort(key=lambda c: (-sum(x == 1 for x in c[0]), sum(c[0]), -len(c[1])))
        self.members = {t: k for k, c in enumerate(self.classes) for t in c[1]}
        self._nest(pages)
        # a block of a class that no gap holds is nested alone if it makes a class by itself
        held = {t: sum(map(bool, c[0])) for k, c in enumerate(self.classes) for t in c[1] if t[1].startswith(BLOCK) and (k == 0 or c[2] is not None or self._words(t) >= size)}
        self.shared = frozenset(held)
        self.blocks = frozenset(t for t, n in held.items() if n >= BLOCK_PAGES)

    @staticmethod
    def _words(token: tuple[str, str]) -> int:
        """Tokens that a token stands for: a block for its words."""
        return token[1].count(" ") + 1 if token[1].startswith(BLOCK) else 1

    @staticmethod
    def _ordered(pages, vector, members):
        """The tokens in their common order, those that break it left out."""
        order: list | None = None
        for page, n in zip(pages, vector, strict=True):
            if not n:
                continue
            seen = [(p, v) for p, v, _, _ in page.tokens if (p, v) in members]
            first = list(dict.fromkeys(seen))
            if order is None:
                order = first
            elif first != order:
                keep = {t: i for i, t in enumerate(order)}
                best, at = [], -1
                for t in first:
                    if keep.get(t, -1) > at:
                        best.append(t)
                        at = keep[t]
                order = best
            if not order:
                return None
        return order

    def _nest(self, pages) -> None:
        """A class's parent is the smallest class before it with all its tokens in one gap of it on the first page that has it."""
        places: dict[int, dict[int, list[tuple[int, int]]]] = {}
        rank = {t: i for c in self.classes for i, t in enumerate(c[1])}
        for k, c in enumerate(self.classes):
            first = next(i for i, n in enumerate(c[0]) if n)
            if first not in places:
                places[first] = defaultdict(list)
                for i, (p, v, _, _) in enumerate(pages[first].tokens):
                    if (p, v) in rank:
                        places[first][self.members[p, v]].append((i, rank[p, v]))
            here = places[first]
            lo, hi = here[k][0][0], here[k][-1][0]
            for parent in range(k - 1, -1, -1):
                gap = None
                for (i, a), (j, _) in zip(here[parent], here[parent][1:], strict=False):
                    if i < lo and hi < j:
                        gap = a
                        break
                if gap is not None:
                    c[2], c[3] = parent, gap
                    break

    def slots(self, page: Page) -> Counter:
        """Characters of text outside the blocks that pages share, by (path, marks), outside boilerplate."""
        return page.masses(self.shared)


def _named(path: str) -> set[str]:
    return {part.split(".")[0] for part in path.split("/")}


def judged(masses: Counter) -> tuple[str, frozenset]:
    """The container of masses by (path, marks), and the marks that hold most of the text of article and main, or of all."""
    meant = {k: n for k, n in masses.items() if not _named(k[0]).isdisjoint(MAIN)} or masses
    by_mark: Counter = Counter()
    for (_, off), n in meant.items():
        for mark in off:
            by_mark[mark] += n
    total = sum(meant.values())
    lifted = frozenset(m for m, n in by_mark.items() if 2 * n > total)
    kept: Counter = Counter()
    for (path, off), n in masses.items():
        if lifted.issuperset(off):
            kept[path] += n
    return container(kept), lifted


def container(masses: Counter) -> str:
    """The deepest path that holds all of the text; an element that means main text comes first."""
    total = sum(masses.values())
    if not total:
        return ""
    below: Counter = Counter()
    for path, n in masses.items():
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            below["/".join(parts[:k])] += n
    meant = [(n, p) for p, n in below.items() if p.rsplit("/", 1)[-1].split(".")[0] in MAIN]
    if meant:
        n, p = max(meant, key=lambda x: (x[0], -len(x[1]), x[1]))
        if n >= total * 0.25:
            return p
    deep = [p for p, n in below.items() if n >= total and p.rsplit("/", 1)[-1].split(".")[0] not in INLINE]
    found = max(deep, key=lambda p: (p.count("/"), p), default="")
    # a lone paragraph or heading is a part, its parent the container
    while found.rsplit("/", 1)[-1].split(".")[0] in ("p", "h1", "h2", "h3", "li", "blockquote"):
        found = found.rsplit("/", 1)[0]
    return found


def extract_chunk(sources: list[str]) -> list[str]:
    """Main texts of pages of one host."""
    parsed: dict[str, Page] = {}
    for s in sources:
        if s not in parsed:
            parsed[s] = Page(s)
    pages = list(parsed.values())
    main, lifted, template = "", frozenset(), None
    if len(pages) > 1:
        template = Template(pages)
        total: Counter = Counter()
        for page in pages:
            total.update(template.slots(page))
        main, lifted = judged(total)
    texts = {}
    for s, page in parsed.items():
        got = page.text(main, lifted) if main else None
        if got:
            slots = page.text(main, lifted, template.blocks) or ""
            got = slots if 2 * len(slots) >= len(got) else got
        texts[s] = got if got else page.text(*judged(page.masses())) or ""
    return [texts[s] for s in sources]


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _chunks(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(5)]
            out: list = []
            for h, b, page_id, url, source in zip(*cols, strict=True):
                if (h, b) != key or len(held) >= chunk:
                    out += flush(held)
                    key, held = (h, b), []
                held.append((page_id, url, source or ""))
            yield rows(out)
        yield rows(flush(held))

    def flush(held):
        return [(i, u, t) for (i, u, _), t in zip(held, extract_chunk([s for _, _, s in held]), strict=True)] if held else []

    def rows(out) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.string()), pa.array([len(r[2]) for r in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html)."""
    df = pages.select(F.col("page_id").cast("bigint"), "url", "html", host(F.col("url")).alias("host"))
    counts = checkpointed(df.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / (4 * chunk)).alias("blocks")))
    # few hosts are broadcast, so that the pages move once; many are joined
    df = df.join(F.broadcast(counts) if counts.count() <= HOSTS else counts, "host").withColumn("block", F.pmod(F.xxhash64("page_id", "url"), F.col("blocks")))
    dealt = df.select("host", "block", "page_id", "url", "html").repartition("host", "block").sortWithinPartitions("host", "block", F.xxhash64("page_id", "url"))
    return dealt.mapInArrow(tidied("html", _chunks(chunk)), "page_id bigint, url string, text string, n_chars bigint")


def op3_html(spark, sf_dir) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op3_html": op3_html}
