"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree: its nodes are element paths (tags with
their classes), and each leaf keeps which contents and which child sequences it has on how
many distinct pages. A node's importance weighs two parts: its content, one less the
logarithm to the base of the node's pages of the pages that hold the same content, on
average - 0 where every page repeats it, 1 where every page has its own; and its
presentation, the entropy of its child sequences to the same base. In branches below
``threshold``, inside ``article`` and ``main`` too, the contents that are below it themselves
are noise on that host; a content of few pages stays, whatever its branch.

Branches that present themselves as furniture (navigation, footers, sidebars, share boxes and
so on, by tag, role, class or id) are nodes of the tree as well. Their importance is weighed
by their share of the host's text, and below twice the threshold the branch is noise as a
whole. So a name alone decides nothing on a host that has a tree: where the text itself stands
under such a name, it stays. A host of fewer than ``least_pages`` pages has no tree, and there
the names decide. Only what can't be content whatever it says is left out from the start:
forms and their parts, hidden elements, adverts and readers' comments, which differ from page
to page as texts do.

Blocks outside ``article`` and ``main`` are judged alike, so a title before an article and a
text beside teasers stay.

Copies of an article are not boilerplate: pages with the same text count once, an article of
which nothing would stay is kept if it is longer than what stays outside, and a heading inside
stays with the block that it heads. A repeated paragraph in the same path as an article's own
ones stays with them.

Trees are grouped counts: a host's pages are never gathered. The verdicts on all hosts are
joined to the pages as a broadcast only while they are at most ``BROADCAST_PATHS`` rows; else,
hosts being uneven, by host and salt.

Defined results: null and empty pages give an empty text; pages whose parts are all noise
too; a page on which the tree judges nothing gives all its other blocks; cut-off pages count up to
where they end; null urls share one host; rows may repeat; an empty table gives an empty
table; other columns stay, but one named like an output column, in any case, is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.llm.arrow import add_columns, chunks, quoted, spare
from barwright.session import cut

BROADCAST_PATHS = 100_000
SALTS = 16

#: What is known of a block's place.
INSIDE, HEADING, NAMED = 1, 2, 4
#: A verdict of every host that has a tree.
JUDGED = 0

#: Elements by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg object".split())
BLOCK = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"button", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "select", "html", "head", "body"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Never content; and furniture, on which the tree decides.
NEVER_TAGS = frozenset("head form button select dialog search fieldset legend".split())
NEVER_ROLES = frozenset("search form dialog alert alertdialog".split())
NEVER_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsbygoogle|comments?|commentlist|disqus|promos?|promoted|replies|reply|respond|sponsor\w*)(?:$|[\s_-])", re.I)
NAMED_TAGS = frozenset("nav footer aside menu".split())
NAMED_ROLES = frozenset("navigation banner contentinfo complementary menu menubar toolbar".split())
NAMED_NAMES = re.compile(r"(?:^|[\s_-])(?:banners?|breadcrumbs?|consent|cookies?|gdpr|login|menus?|modal|nav|navbar|navigation|newsletter|notices?|overlay|pager|pagination|popup|promotion|related|search|share|sharing|sidebars?|signup|social|subscribe|toolbar|widgets?)(?:$|[\s_-])", re.I)
OUTER_NAMES = re.compile(r"(?:^|[\s_-])(?:copyright|footer|header|legal|masthead|skip|topbar|bottom)(?:$|[\s_-])", re.I)
#: Elements whose names say nothing of their kind: texts and headings, as in <h2 id=related-work>.
UNTELLING = frozenset("html body main h1 h2 h3 h4 h5 h6 p".split())

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|</?[a-zA-Z][^>]*+\Z|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_DIGITS = re.compile(r"\d+")
_HEADING = re.compile(r"h[1-6]\Z")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


class _Element:
    __slots__ = ("tag", "path", "noise", "named", "main", "block", "nested", "children")

    def __init__(self, tag: str, path: int, noise: bool, named: int, main: bool, block: bool) -> None:
        self.tag, self.path, self.noise, self.named, self.main, self.block, self.nested = tag, path, noise, named, main, block, 0
        self.children: list[str] = []


def parse(page: str) -> tuple[list[tuple[int, int, str]], dict[int, int]]:
    """Blocks (path, INSIDE article or main | HEADING | NAMED, text) in page order, and the hash of each path's child sequences.

    A named branch is one leaf: its blocks have the path of its outermost named element.
    How many elements of a tag are open is kept along, so that nesting costs nothing by itself.
    """
    stack = [_Element("", 0, False, 0, False, True)]
    open_: dict[str, int] = {}
    blocks: list[tuple[int, int, str]] = []
    shapes: dict[int, int] = {}
    run: list[str] = []
    at, size = 0, len(page)

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                top = next(e for e in reversed(stack) if e.block)
                blocks.append((top.named or top.path, INSIDE * top.main | HEADING * bool(_HEADING.match(top.tag)) | NAMED * bool(top.named), text))

    def push(element: _Element) -> None:
        stack.append(element)
        open_[element.tag] = open_.get(element.tag, 0) + 1

    def pop() -> None:
        element = stack[-1]
        if element.block:
            flush()
        stack.pop()
        open_[element.tag] -= 1
        if element.block and not element.noise and element.children:
            shapes[element.path] = shapes.get(element.path, 0) ^ xxhash.xxh64_intdigest(" ".join(element.children))

    def close(tag: str) -> None:
        while stack[-1].tag != tag:
            pop()
        pop()

    while at < size:
        token = _TOKEN.search(page, at)
        begin, end = token.span() if token else (size, size)
        if begin > at and not stack[-1].noise:
            run.append(page[at:begin])
        at = end
        if not token or token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if tag == "br" or tag == "p" and not open_.get("p"):
                run.append(" ")
            elif tag in BLOCK:
                if open_.get(tag):
                    close(tag)
            elif stack[-1].tag == tag:
                if stack[-1].nested:
                    stack[-1].nested -= 1
                else:
                    pop()
            continue
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if not token[3].endswith("/"):
                at = page.find(">", closing.end()) + 1 or size if closing else size
            continue
        if tag in VOID:
            if tag == "br":
                run.append(" ")
            elif tag == "hr":
                flush()
            continue
        block = tag in BLOCK
        if not block and stack[-1].noise:
            stack[-1].nested += stack[-1].tag == tag
            continue
        if block:
            flush()
            if tag in CLOSES_P and open_.get("p"):
                close("p")
            if tag in CLOSES:
                closed, stop = CLOSES[tag]
                for depth in range(len(stack) - 1, 0, -1) if any(map(open_.get, closed)) else ():
                    if stack[depth].tag in stop:
                        break
                    if stack[depth].tag in closed:
                        while len(stack) > depth:
                            pop()
                        if tag != "tr":
                            break
            if _HEADING.match(tag) and _HEADING.match(stack[-1].tag):
                pop()
        top = stack[-1]
        label, never, named = tag, tag in NEVER_TAGS, tag in NAMED_TAGS or tag == "header" and not top.main
        if token[3]:
            names = []
            for m in _ATTRIBUTE.finditer(token[3]):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    names.append(value)
                elif name == "role":
                    never |= value.lower() in NEVER_ROLES
                    named |= value.lower() in NAMED_ROLES
                elif name == "style":
                    never |= bool(_UNSEEN.search(value))
                else:
                    never |= name == "hidden" or value.lower() == "true"
            told = " ".join(names)
            if told:
                label = f"{tag}.{_DIGITS.sub('0', told)}"
                if tag not in UNTELLING:
                    never |= bool(NEVER_NAMES.search(told))
                    named |= block and bool(NAMED_NAMES.search(told) or not top.main and tag != "article" and OUTER_NAMES.search(told))
        noise = top.noise or never
        if block:
            top.children.append(label)
            path = xxhash.xxh64_intdigest(label, seed=top.path) >> 1
            push(_Element(tag, path, noise, top.named or path * named, top.main or tag in ("article", "main"), True))
        elif noise:
            push(_Element(tag, top.path, True, top.named, top.main, False))
    while len(stack) > 1:
        pop()
    flush()
    return blocks, shapes


def _content(path: int, text: str) -> int:
    """A content at its path, as one number."""
    return xxhash.xxh64_intdigest(text, seed=path) >> 1


def _chosen(blocks: list[tuple[int, int, str]], noise: set[int]) -> str:
    """Text of all blocks, inside an article or not, without what the style tree calls noise; without a tree the names decide."""
    judged = JUDGED in noise
    blocks = [b for b in blocks if not b[1] & NAMED or judged and ~b[0] not in noise]
    if not noise:
        return "\n\n".join([b[2] for b in blocks])
    kept, headed = [], False
    for at in range(len(blocks) - 1, -1, -1):
        path, place, text = blocks[at]
        stays = _content(path, text) not in noise
        if place & (INSIDE | HEADING) == INSIDE | HEADING:
            stays |= headed
        else:
            headed = stays
        if stays:
            kept.append(at)
    inside = [at for at, b in enumerate(blocks) if b[1] & INSIDE]
    size = lambda places: sum(len(blocks[at][2]) for at in places)
    # a copied article, not a teaser beside the page's text
    if not any(blocks[at][1] & INSIDE for at in kept) and size(inside) > size(kept):
        kept += inside
    return "\n\n".join([blocks[at][2] for at in sorted(kept)])


def verdicts(pages: DataFrame, url: str = "url", html: str = "html", threshold: float = 0.25, content_weight: float = 0.9, least_pages: int = 5) -> DataFrame:
    """(host, verdict) of hosts with at least ``least_pages`` different pages.

    A verdict is JUDGED, once a host; a content at its path that is noise; or, inverted bit by
    bit and so below 0, a named path that is.
    """

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, html, 4 << 20):
            rows: set[tuple[str, int, int, int, bool, bool, int]] = set()
            for link, page in zip(batch.column(url).to_pylist(), batch.column(html).to_pylist(), strict=True):
                if not page:
                    continue
                host = host_of(link)
                blocks, shapes = parse(page)
                own = [text for _, place, text in blocks if not place & NAMED]
                key = xxhash.xxh64_intdigest("\n".join(own or [b[2] for b in blocks])) >> 1
                sizes: dict[tuple[int, bool], int] = {}
                for path, place, text in blocks:
                    at = (path, bool(place & NAMED))
                    sizes[at] = sizes.get(at, 0) + len(text)
                    rows.add((host, path, _content(path, text), key, True, at[1], 0))
                rows |= {(host, path, shapes.get(path, 0) >> 1, key, False, named, size) for (path, named), size in sizes.items()}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["host", "path", "feature", "page", "content", "named", "chars"])

    found = pages.select(F.col(quoted(url)).alias(url), F.col(quoted(html)).alias(html)).mapInArrow(leaves, "host string, path long, feature long, page long, content boolean, named boolean, chars long")
    # pages with the same text count once, whatever surrounds it
    once = found.groupBy("host", "path", "content", "feature", "page", "named").agg(F.max("chars").alias("chars"))
    # read more than once below
    counted = cut(once.groupBy("host", "path", "content", "feature", "named").agg(F.count("*").alias("k"), F.sum("chars").alias("chars")))
    # a page has one row of child sequences for each of its paths, so these rows count the path's pages
    node = counted.groupBy("host", "path", "named", "content").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.log(F.col("k").cast("double"))).alias("s"), F.sum("chars").alias("chars"))
    sides = [F.max(F.when(F.col("content") == is_text, F.col(c))).alias(f"{name}_{c}") for name, is_text in (("text", True), ("shape", False)) for c in ("m", "s")]
    both = node.groupBy("host", "path", "named").agg(*sides, F.max("chars").alias("chars"))
    pages_log = F.log(F.greatest(F.col("shape_m"), F.lit(2)).cast("double"))
    # one less the mean of log k / log pages: for child sequences this is their entropy to that base
    importance = content_weight * (1 - F.col("text_s") / (F.col("text_m") * pages_log)) + (1 - content_weight) * (1 - F.col("shape_s") / (F.col("shape_m") * pages_log))
    both = cut(both.select("host", "path", "named", "shape_m", "chars", pages_log.alias("pages_log"), importance.alias("importance")))
    least = max(2, least_pages)
    # a host's pages are at least those of its most common path
    hosts = both.groupBy("host").agg(F.max("shape_m").alias("pages"), F.sum("chars").alias("all_chars")).where(F.col("pages") >= least)
    low = both.where(~F.col("named") & (F.col("shape_m") >= least) & (F.col("importance") < threshold)).select("host", "path", "pages_log")
    repeated = counted.where(F.col("content") & ~F.col("named") & (F.col("k") > 1)).join(low, ["host", "path"])
    contents = repeated.where(content_weight * (1 - F.log(F.col("k").cast("double")) / F.col("pages_log")) < threshold).select("host", F.col("feature").alias("verdict"))
    weight = F.col("chars") / F.col("all_chars")
    furniture = both.where("named").join(hosts, "host").where(F.col("importance") * weight < 2 * threshold).select("host", F.bitwise_not("path").alias("verdict"))
    return hosts.select("host", F.lit(JUDGED).cast("long").alias("verdict")).unionByName(contents).unionByName(furniture)


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.25) -> DataFrame:
    """``pages`` without ``html``, with text and n_chars."""
    noise = cut(verdicts(pages, url, html, threshold))
    few = noise.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS
    made = {"text": T.StringType(), "n_chars": T.LongType()}
    own = pages.select(*[quoted(c) for c in pages.columns if c.lower() not in made])
    host, salt, told = (spare(own.columns, name) for name in ("sst_host", "sst_salt", "sst_noise"))
    by_host = noise.groupBy(F.col("host").alias(host)).agg(F.collect_list("verdict").alias(told))
    own = own.withColumn(host, F.lower(F.regexp_extract(F.coalesce(F.col(quoted(url)), F.lit("")), _HOST.pattern, 1)))
    if few:
        joined = own.join(F.broadcast(by_host), host, "left")
    else:
        salted = by_host.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn(salt, F.pmod(F.xxhash64(F.col(quoted(id)), F.col(quoted(url))), F.lit(SALTS)).cast("int")).join(salted, [host, salt], "left").drop(salt)

    def run(batch: pa.RecordBatch, names: dict[str, str]) -> list[pa.Array]:
        texts = [_chosen(parse(page)[0], set(noisy or ())) if page else "" for page, noisy in zip(batch.column(names[html]).to_pylist(), batch.column(names[told]).to_pylist(), strict=True)]
        return [pa.array(texts, type=pa.string()), pa.array(list(map(len, texts)), type=pa.int64())]

    return add_columns(joined, made, run, html).drop(F.col(quoted(html)), host, told)
