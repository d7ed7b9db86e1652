"""Main text of web pages by equivalence-class template deduction.

Pages of a host are made from a template. A token is a tag or a whole run of text between tags, told apart by the
containers it stands in; where pages have the same number of containers of one name in one place, they count as different
ones, unless they are built alike (records of a list). A token's occurrence vector says how often it occurs on each page. Tokens of the template occur alike, so those
that share a vector form an equivalence class; classes of several tokens that occur on most pages are kept if their
tokens come in one order, again and again, on every page (ordered) and all of a class's occurrences lie in one gap of
the class around it (nested). The nested classes are the template; the gaps between their tokens are its slots, and
what pages have in a slot is data.

The slots decide. Text that is a token of the template is left out, and so is text that most pages have word for word. A slot
inside a class that repeats on a page and holds containers is a record of a list (a reader's comment, a teaser). The
slot, or the list's slots together, with the most running text is the article's, and the container around it is the article; in it
other records, menus (containers of which links make up most) and what elements and names mark as something else
are left out. Where no class decides, as with one page of a host, elements and names are all there is.

Pages are dealt to tasks by host; frequent hosts (at most 1/FREQUENT of them) are dealt in several parts. A task reads
its pages host by host and deduces a template from TOGETHER of them at least, or all there are (fewer than twice as many; or from what BYTES hold,
if pages are that long), so it never holds more. Every page gives one row.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages that a template is deduced from, at least; characters of pages held for that, at most.
TOGETHER, BYTES = 60, 64_000_000
#: Classes: least share of pages, least tokens; least pages that make text that they share the template's.
SUPPORT, TOKENS, SHARED = 0.6, 3, 3
#: Share of pages that agree on the number of a container, and the largest number; share of links in a menu, and its least links a page.
AGREE, NUMBER, LINKS, MENU = 0.9, 12, 0.6, 3
#: A host with this share of all pages is dealt in parts.
FREQUENT = 2.0**-8

# Elements of HTML by what they mean here.
RAW = "script|style|noscript|template|iframe|svg|object|canvas|math|textarea|select|xmp|noframes|title"
CONTAINERS = frozenset("html body main article section div nav header footer aside ul ol dl table form figure fieldset details dialog menu blockquote center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption figcaption pre hr address summary legend option optgroup head title".split())
LEFT_OUT = frozenset("nav footer aside form dialog menu head fieldset button".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
WORDS_OF_OTHERS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside footer masthead topbar toolbar comment comments reply replies respond disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations trending widget pagination pager search skip hidden disclaimer".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers that are parts of an article rather than an article.
PARTS = frozenset("ul ol dl table blockquote figure center fieldset header".split())

_PART = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_NUMBER, _END = re.compile(r"\d+"), re.compile(r"[.:]")
_SPLIT = re.compile(r"[^a-z]+")
_STEMS = re.compile(r"(?:^|[^a-z])(?:comment|advert|sponsor|cookie|sidebar|newsletter|breadcrumb|navbar|footer)")


def left_out(tag: str, attrs: str, inside: bool) -> bool:
    """Whether a container is for something else than the article. inside: it stands in the article."""
    if tag in LEFT_OUT or tag == "header" and not inside:
        return True
    if attrs:
        if _HIDDEN.search(attrs):
            return True
        for m in _NAMED.finditer(attrs):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                if value in ROLES:
                    return True
            elif tag not in ("html", "body", "article", "main") and (_STEMS.search(value) or not WORDS_OF_OTHERS.isdisjoint(_SPLIT.split(value))):
                return True
            elif tag == "article" and not {"comment", "comments", "reply", "ad", "sponsored", "related", "promo"}.isdisjoint(_SPLIT.split(value)):
                return True
    return False


@dataclass
class Segment:
    """A run of text: its container, the block it belongs to, where it stands among the page's tokens, what marks it."""

    text: str
    node: int
    block: int
    at: int
    out: bool
    link: bool
    heading: bool
    path: str = ""
    fixed: bool = False


@dataclass
class Page:
    """nodes: containers as (parent, name); marks: tags as (container, what follows its path); tokens: their names, of all pages of a template together."""

    nodes: list[tuple[int, str]] = field(default_factory=lambda: [(-1, "")])
    marks: list[tuple[int, str]] = field(default_factory=list)
    segments: list[Segment] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)


def parse(source: str) -> Page:
    """Tags and text of a page; tags that are never closed end where their container does."""
    page = Page()
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, container, left out, in the article
    block, link, heading = 0, False, False
    for m in _PART.finditer(source):
        text = m["text"]
        if text is not None:
            if not text.isspace():
                _, node, out, inside = stack[-1]
                if out and inside and heading and stack[-1][0] == "header":
                    out = stack[-2][2]
                page.segments.append(Segment(entities.unescape(text), node, block, len(page.marks), out, link, heading))
                page.marks.append((node, " "))
            elif page.segments and page.segments[-1].block == block:
                page.segments[-1].text += " "
            continue
        if m["tag"] is None:
            continue
        tag, end = m["tag"].lower(), m["end"]
        if tag in BLOCKS:
            block += 1
        elif tag in ("br", "wbr") and page.segments and page.segments[-1].block == block:
            page.segments[-1].text += " "
        if tag == "a":
            link = not end
        elif tag in HEADINGS:
            heading = not end
        if tag in CONTAINERS or tag in LEFT_OUT:
            if end:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        page.marks.append((stack[i][1], "</"))
                        del stack[i:]
                        break
                link = False
                continue
            _, node, out, inside = stack[-1]
            attrs = m["attrs"] or ""
            name = tag
            if "=" in attrs:
                name += "".join(f".{_NUMBER.sub('#', (x[2] or x[3] or x[4] or '').strip())}" for x in _NAMED.finditer(attrs))
            out = out or left_out(tag, attrs, inside) or tag == "header"
            stack.append((tag, len(page.nodes), out, inside or tag in ("article", "main")))
            page.nodes.append((node, name))
            page.marks.append((len(page.nodes) - 1, "<"))
        else:
            page.marks.append((stack[-1][1], f"<{end}{tag}"))
    return page


def name_tokens(pages: list[Page]) -> None:
    """Paths of containers, and by them tokens: of a container that pages have k times in one place, each is another one if they differ in build."""
    paths = [[""] for _ in pages]
    inside: list[list[set[str]]] = []  # what tags each container holds
    for p in pages:
        held: list[set[str]] = [set() for _ in p.nodes]
        for node, what in p.marks:
            if what not in ("<", "</", " "):
                held[node].add(what)
        for n in range(len(p.nodes) - 1, 0, -1):
            parent, name = p.nodes[n]
            held[parent] |= held[n]
            held[parent].add(name)
        inside.append(held)
    rest = [list(range(1, len(p.nodes))) for p in pages]
    while any(rest):
        # those whose parents have a path: siblings of one name, in their order
        families: list[dict[tuple[int, str], list[int]]] = []
        for p, path, todo in zip(pages, paths, rest):
            own: dict[tuple[int, str], list[int]] = {}
            for n in todo:
                parent, name = p.nodes[n]
                if parent < len(path) and path[parent] is not None:
                    own.setdefault((parent, name), []).append(n)
            families.append(own)
        sizes: dict[str, Counter] = {}
        alike: Counter = Counter()
        for path, own, held in zip(paths, families, inside):
            for (parent, name), nodes in own.items():
                base = f"{path[parent]}/{name}"
                sizes.setdefault(base, Counter())[len(nodes)] += 1
                alike[base] += len(held[nodes[0]]) >= TOKENS and all(held[n] == held[nodes[0]] for n in nodes)
        numbered = {k for k, c in sizes.items() if (top := c.most_common(1)[0])[0] in range(2, NUMBER + 1) and top[1] >= max(2, AGREE * c.total()) and alike[k] < 0.5 * c.total()}
        for i, (path, own) in enumerate(zip(paths, families)):
            for (parent, name), nodes in own.items():
                base = f"{path[parent]}/{name}"
                for j, n in enumerate(nodes):
                    path.extend([None] * (n + 1 - len(path)))
                    path[n] = f"{base}:{j}" if base in numbered else base
            rest[i] = [n for n in rest[i] if n >= len(path) or path[n] is None]
    for p, path in zip(pages, paths):
        p.tokens = [f"{path[node]}{what}" for node, what in p.marks]
        for s in p.segments:
            s.path = path[s.node]
            p.tokens[s.at] += " ".join(s.text.split())


def equivalence_classes(pages: list[Page]) -> list[list[str]]:
    """Tokens that share an occurrence vector over the pages, in their order on a page; valid classes, outermost first."""
    counts = [Counter(p.tokens) for p in pages]
    on: Counter = Counter()
    for c in counts:
        on.update(c.keys())
    least = max(1, SUPPORT * len(pages))
    classes: dict[tuple[int, ...], list[str]] = {}
    for token, n in on.items():
        if n >= least and (len(pages) >= SHARED or not _is_text(token)):
            classes.setdefault(tuple(c[token] for c in counts), []).append(token)
    found: list[list[str]] = []
    for v in sorted((v for v in classes if len(classes[v]) >= TOKENS), key=lambda v: (sum(v), v)):
        ordered = _ordered(set(classes[v]), pages, v)
        if ordered and all(_nested(ordered, outer, pages) for outer in found):
            found.append(ordered)
    return found


def _is_text(token: str) -> bool:
    return " " in token and not token.endswith("<")


def _ordered(tokens: set[str], pages: list[Page], vector: tuple[int, ...]) -> list[str] | None:
    """The tokens in the order in which each page has them, time and again; without texts if those spoil it."""
    order: list[str] | None = None
    for p, n in zip(pages, vector):
        if n:
            seen = [t for t in p.tokens if t in tokens]
            order = order or seen[: len(tokens)]
            if seen != order * n:
                tags = {t for t in tokens if not _is_text(t)}
                return _ordered(tags, pages, vector) if TOKENS <= len(tags) < len(tokens) else None
    return order


def _nested(inner: list[str], outer: list[str], pages: list[Page]) -> bool:
    """Whether inner's tokens stand in one and the same gap of outer everywhere (or it stands outside of all)."""
    own, place, gap = set(inner), {t: i for i, t in enumerate(outer)}, None
    for p in pages:
        at = -1
        for t in p.tokens:
            if t in place:
                at = place[t]
            elif t in own:
                if gap is None:
                    gap = at
                elif gap != at:
                    return False
    return True


class Template:
    """Nested classes, and which slots hold the article."""

    def __init__(self, pages: list[Page]):
        """pages: distinct ones, whose tokens name_tokens has named."""
        self.classes = equivalence_classes(pages)
        self.place = {t: (c, i) for c, ts in enumerate(self.classes) for i, t in enumerate(ts)}
        on: Counter = Counter()
        for p in pages:
            on.update({t for t in p.tokens if _is_text(t)})
        # what most pages have word for word is the template's, in a class or by itself
        self.fixed = {t for t, n in on.items() if len(pages) >= SHARED and n >= max(SHARED, SUPPORT * len(pages)) and self.classes}
        counts = [Counter(p.tokens) for p in pages]
        #: classes of records: they repeat on a page, and hold containers; with the container that each record is
        self.records: dict[int, str] = {}
        for c, ts in enumerate(self.classes):
            inside = [t[:-1] for t in ts if t.endswith("<") and t[:-1] + "</" in ts]
            if inside and any(n[ts[0]] > 1 for n in counts):
                self.records[c] = min(inside, key=len)
        weight: Counter = Counter()
        linked: dict[str, list[int]] = {}
        for p in pages:
            for s, slot in self.slots(p):
                n = len(s.text)
                k = linked.setdefault(s.path, [0, 0, 0])
                k[0] += n
                k[1] += n * s.link
                k[2] += s.link
                if not s.link and not s.fixed:
                    # what elements and names say tips the balance; of a page or two it is all there is
                    weight[slot, s.path] += n * (0.25 if s.out else 8 if len(pages) < SHARED and any(_name(x) in ("article", "main") for x in s.path.split("/")) else 1)
        self.menus = {path for path, (n, links, k) in linked.items() if links > LINKS * n and k >= MENU * len(pages)}
        self.root, self.own = self._article(weight)

    def _record(self, slot) -> int | None:
        """The outermost class of records that a slot lies in."""
        return next((c for c, _ in slot if c in self.records), None)

    def _article(self, weight: Counter) -> tuple[str, int | None]:
        """The article's container, and the class of records that it is made of, if it is."""
        slots: Counter = Counter()
        for (slot, path), n in weight.items():
            c = self._record(slot)
            slots[(slot, None) if c is None else (None, c)] += n
        if not slots:
            return "", None
        best, own = max(slots, key=lambda k: (slots[k], str(k)))
        paths: Counter = Counter()
        for (slot, path), n in weight.items():
            if slot == best or own is not None and self._record(slot) == own:
                paths[path if own is None else self.records[own].rpartition("/")[0]] += n
        root = max(paths, key=lambda k: (paths[k], k))
        parts = root.split("/")
        for tag in ("article", "main"):  # an element that says so may reach further than the slot
            for i in range(len(parts) - 1, 0, -1):
                if _name(parts[i]) == tag:
                    return "/".join(parts[: i + 1]), own
        while len(parts) > 2 and _name(parts[-1]) in PARTS:
            parts.pop()
        return "/".join(parts), own

    def slots(self, page: Page) -> list[tuple[Segment, tuple[tuple[int, int], ...]]]:
        """Each piece of text with its slot: the gap it stands in, of each class around it. Marks what is the template's."""
        out, at, segments = [], [-1] * len(self.classes), iter(page.segments)
        s = next(segments, None)
        for i, t in enumerate(page.tokens):
            if t in self.place:
                c, g = self.place[t]
                at[c] = g
            if s is not None and s.at == i:
                s.fixed = t in self.fixed
                out.append((s, tuple((c, g) for c, g in enumerate(at) if 0 <= g < len(self.classes[c]) - 1)))
                s = next(segments, None)
        return out

    def extract(self, page: Page) -> str:
        blocks: list[list[str]] = []
        last, fixed = None, []
        for s, slot in self.slots(page):
            record = self._record(slot)
            if s.out or not (s.path == self.root or s.path.startswith(self.root + "/")) or record is not None and record != self.own:
                continue
            if s.path in self.menus and s.path != self.root and not s.heading:
                continue
            if s.block != last:
                blocks.append([])
                fixed.append(True)
                last = s.block
            blocks[-1].append(s.text)
            fixed[-1] &= s.fixed
        texts = (" ".join("".join(b).split()) for b, own in zip(blocks, fixed) if not own)
        return "\n".join(t for t in texts if t)


def _name(part: str) -> str:
    return _END.split(part, maxsplit=1)[0]


def extract_all(sources: list[str | None]) -> list[str]:
    """Main texts of pages of one host. Equal pages count once in deducing the template."""
    pages = [parse(s or "") for s in sources]
    name_tokens(pages)
    distinct = {xxhash.xxh3_128_digest("\n".join(s.text for s in p.segments if not s.out).encode("utf-8", "surrogatepass")): p for p in pages if p.tokens}
    if not distinct:
        return [""] * len(pages)
    template = Template(list(distinct.values()))
    return [template.extract(p) for p in pages]


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", together: int = TOGETHER) -> DataFrame:
    """key, url, text and n_chars of every page.

    A null page is empty, and so is one without an article's text; a null url is a host of its own. The pages of a host
    that make up one template depend on keys and urls only, not on how the input is split.
    """
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hosts = pages.select(host(F.col(url)).alias("_host"))
    counts = hosts.groupBy("_host").agg(F.count("*").alias("n"))
    total = pages.count()
    frequent = counts.where(F.col("n") >= max(2.0 * together, FREQUENT * total)).select("_host", F.ceil(F.col("n") / F.lit(2.0 * max(together, total * FREQUENT / 8))).cast("int").alias("_parts"))
    # at most 1/FREQUENT hosts
    dealt = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host(F.col(url)).alias("_host")).join(F.broadcast(frequent), "_host", "left")
    salt = F.pmod(F.xxhash64("id", "url"), F.coalesce("_parts", F.lit(1)))
    dealt = dealt.select("id", "url", "html", "_host", salt.alias("_salt"), F.xxhash64("id", "url").alias("_order"))
    dealt = dealt.repartition(parts, "_host", "_salt").sortWithinPartitions("_host", "_salt", "_order", "id")
    kind = dict(pages.dtypes)

    def run(batches):
        at, held, size, id_type = None, [], 0, None

        def ended():
            """What is left of a host in one template, or in two of equal size."""
            half = len(held) if len(held) <= together else -(-len(held) // 2)
            for some in (held[:half], held[half:]):
                if some:
                    yield flush(some)

        def flush(held):
            texts = extract_all([h for _, _, h in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _, _ in held], id_type), pa.array([u for _, u, _ in held], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"]
            )

        for b in batches:
            id_type = b.column(0).type
            for i, u, h, name, salt in zip(*(b.column(c).to_pylist() for c in range(5))):
                if held and (name, salt) != at:
                    yield from ended()
                    held, size = [], 0
                at = name, salt
                held.append((i, u, h))
                size += len(h or "")
                if len(held) >= 2 * together or size >= BYTES:
                    n = together if len(held) >= 2 * together else len(held)
                    yield flush(held[:n])
                    held = held[n:]
                    size = sum(len(h or "") for _, _, h in held)
        if held:
            yield from ended()

    return dealt.select("id", "url", "html", "_host", "_salt").mapInArrow(run, f"`{key}` {kind[key]}, `{url}` string, text string, n_chars long")
