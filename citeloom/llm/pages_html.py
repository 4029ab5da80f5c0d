"""Main text of web pages by wrapper induction over the pages of a host.

A lenient parser gives each page's DOM. Its skeleton (labels of tag and class, runs of like siblings merged)
is counted over all pages; the commonest skeleton of a host, even if it occurs once, is its reference tree. Simple tree matching aligns a
page's skeleton to it, so that blocks of different pages fall into the same slots. For every slot the texts of all
pages of the host are counted (as hashes, each distinct page once); a text that fills its slot on most pages is a constant
node, part of the template, and goes, while varying slots are content. Elements that can hold no article
(navigation, footers, forms, adverts, comments ...; by tag, role and whole class or id) are left out first, and where a page marks
its article, only that counts. What a class or id names is not left out where it holds more than half of the page's text.

Where a page's other texts only stand in for constants that its slots lack, it has nothing of its own. If that is so for most of
a host's distinct pages, the host holds copies of one article and nothing is taken as template. Counts cover all pages of all hosts; a hot host's pages are never brought together, only counts are.

Defined results: null or empty html gives an empty text; a page whose url has no host shares the host ""; markup that
is not closed is read to the end; repeated rows stay repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import pick, stored

#: A text is a constant of its slot on this share of the distinct pages with the slot, and on this many.
SHARE, LEAST = 0.6, 4

#: Elements nested deeper than this are read as children of the last.
DEPTH = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td"
    " tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dialog html legend option tbody td tfoot th thead tr".split())
#: Elements that end when one of these starts, unless an element of the third set lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
DROP_TAGS = frozenset(
    "nav footer aside form script style noscript template svg math iframe object embed button select textarea input dialog menu"
    " head title canvas audio video map datalist search".split()
)
DROP_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor"
    " sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription"
    " social share sharing related recommended recommendations comment comments respond replies disqus widget toolbar pagination pager"
    " login signup masthead topbar copyright skip".split()
)
DROP_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<!--|<[!?][^>]*+>?""")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PLAIN = re.compile(r"[()\s]")


class Node:
    __slots__ = ("tag", "label", "kids", "drop", "head", "named")

    def __init__(self, tag: str, label: str = "", drop: bool = False, head: bool = False, named: bool = False):
        self.tag, self.drop, self.head, self.named, self.kids = tag, drop, head, named, []  # named: left out for its class or id alone
        self.label = _PLAIN.sub("_", label or tag)


def _element(tag: str, attrs: str) -> Node:
    if "=" not in attrs:
        return Node(tag, tag, tag in DROP_TAGS or attrs.strip().split() == ["hidden"], tag == "header")
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    cls = got.get("class", "")
    words = set(f"{cls} {got.get('id', '')}".lower().split())
    role = got.get("role", "").lower()
    drop = (
        tag in DROP_TAGS
        or role in DROP_ROLES
        or got.get("aria-hidden") == "true"
        or "display:none" in got.get("style", "").replace(" ", "").lower()
    )
    kept = tag in ("html", "body", "main") or (tag == "article" and not words & {"comment", "comments", "ad", "ads", "related"})
    word, head = not kept and bool(words & DROP_WORDS), "header" in words
    named = not drop and tag != "header" and (word or head)
    return Node(tag, f"{tag}.{'.'.join(sorted(cls.split()))}" if cls else tag, drop or word, tag == "header" or head, named)


def parse(html: str) -> Node:
    """The tree; strings among kids are decoded text."""
    root = Node("html")
    stack = [root]
    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            stack[-1].kids.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0] == "<!--":
                end = html.find("-->", at)
                at = n if end < 0 else end + 3
            continue
        tag = tag.lower()
        if m[1]:
            if any(x.tag == tag for x in stack[1:]):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag in CLOSES_P:
            _close(stack, {"p"}, {"table", "td", "th", "button", "object", "template", "caption"})
        if tag in ENDS:
            _close(stack, *ENDS[tag])
        node = _element(tag, m[3])
        stack[-1].kids.append(node)
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("path", "rect", "circle", "use")):
            if len(stack) < DEPTH:  # deeper elements are read as its children
                stack.append(node)
    return root


def _spare(root: Node) -> None:
    """Elements left out for their class or id alone stay where they hold more than half of the text that nothing else leaves out."""
    size: dict[int, int] = {}
    named = []

    def count(node: Node) -> int:
        n = 0
        for k in node.kids:
            if isinstance(k, str):
                n += len("".join(k.split()))
            elif k.named or not (k.drop or k.tag == "header"):
                n += count(k)
        if node.named:
            named.append(node)
            size[id(node)] = n
        return n

    total = count(root)
    for node in named:
        if 2 * size[id(node)] > total:
            node.drop = node.head = False


def _close(stack: list[Node], which: set, within: set) -> None:
    """Ends the outermost open element of which that lies inside the innermost element of within."""
    at = None
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in within:
            break
        if stack[i].tag in which:
            at = i
    if at is not None:
        del stack[at:]


def _find(node: Node, test) -> list[Node]:
    """The outermost nodes that hold, in page order, outside dropped ones."""
    out = []
    for k in node.kids:
        if isinstance(k, Node) and not k.drop:
            out += [k] if test(k) else _find(k, test)
    return out


def content_roots(root: Node) -> tuple[list[Node], bool]:
    """Where the article is, and whether the page says so."""
    for test in (lambda k: k.tag == "article", lambda k: k.tag == "main"):
        found = [x for x in _find(root, test) if next(blocks([x], True), None)]
        if found:
            return found, True
    return [root], False


def blocks(roots: list[Node], inside: bool):
    """(path of labels, text) of each block of text, in page order."""
    for r in roots:
        yield from _walk(r, (r.label,), inside)


def _walk(root: Node, path: tuple, inside: bool):
    """Depth first without recursion; text gathers until a block begins or ends."""
    parts: list[str] = []
    work: list = [("close", path)] + [(k, path) for k in reversed(root.kids)]
    while work:
        k, p = work.pop()
        if k == "close":
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                yield p, text
        elif isinstance(k, str):
            parts.append(k)
        elif k.drop or (k.head and not inside):
            parts.append(" ")
        elif k.tag in BLOCK:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                yield p, text
            own = (*p, k.label)
            work.append(("close", own))
            work += [(x, own) for x in reversed(k.kids)]
        elif k.tag in ("br", "img"):
            parts.append(" ")
        else:
            work += [(x, p) for x in reversed(k.kids)]


Skeleton = tuple  # (label, (children ...))


def skeleton(paths: list[tuple]) -> Skeleton:
    """The tree of block paths; like siblings in a run are one node."""
    tree: list = ["", []]
    for p in paths:
        at = tree
        for label in p:
            if not at[1] or at[1][-1][0] != label:
                at[1].append([label, []])
            at = at[1][-1]
    return _frozen(tree)


def _frozen(t: list) -> Skeleton:
    return (t[0], tuple(_frozen(k) for k in t[1]))


def written(s: Skeleton) -> str:
    return s[0] + "(" + " ".join(map(written, s[1])) + ")"


def read(text: str) -> Skeleton:
    stack: list = [["", []]]
    for token in re.findall(r"[^() ]*\(|\)", text):
        if token == ")":
            done = stack.pop()
            stack[-1][1].append((done[0], tuple(done[1])))
        else:
            stack.append([token[:-1], []])
    return stack[0][1][0]


def tree_match(a: Skeleton, b: Skeleton) -> tuple[int, list]:
    """Simple tree matching: the size of the largest top-down, order-preserving match, and its pairs of paths.

    A path is a tuple of child positions.
    """
    if a[0] != b[0]:
        return 0, []
    ka, kb = a[1], b[1]
    sub = [[tree_match(x, y) for y in kb] for x in ka]
    best = [[0] * (len(kb) + 1) for _ in range(len(ka) + 1)]
    for i in range(1, len(ka) + 1):
        for j in range(1, len(kb) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + sub[i - 1][j - 1][0])
    i, j, pairs = len(ka), len(kb), [((), ())]
    while i and j:
        w, inner = sub[i - 1][j - 1]
        if w and best[i][j] == best[i - 1][j - 1] + w:
            pairs += [((i - 1, *p), (j - 1, *q)) for p, q in inner]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[len(ka)][len(kb)] + 1, pairs


def slots(paths: list[tuple], reference: Skeleton | None) -> list[str]:
    """For each block the slot it fills: a node of the reference, or its own path where none is aligned."""
    names = {}
    if reference is not None:
        names = {q: "r" + ".".join(map(str, p)) for p, q in tree_match(reference, skeleton(paths))[1]}
    out, tree = [], ["", []]
    for p in paths:
        at, place = tree, []
        for label in p:
            if not at[1] or at[1][-1][0] != label:
                at[1].append([label, []])
            place.append(len(at[1]) - 1)
            at = at[1][-1]
        out.append(names.get(tuple(place)) or "u" + "/".join(p))
    return out


def page_blocks(html: str | None) -> tuple[list[tuple], list[str]]:
    if not html:
        return [], []
    root = parse(html)
    _spare(root)
    got = list(blocks(*content_roots(root)))
    return [p for p, _ in got], [t for _, t in got]


def _h(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _hosted(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host)."""
    u = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^.*?://([^/?#]*)", 1))
    return pick(pages, page_id="page_id", url="url", html="html").withColumn("host", host)


def references(hosted: DataFrame) -> DataFrame:
    """(host, reference): the commonest skeleton of each host, ties by text."""

    def run(batches):
        for b in batches:
            paths = [page_blocks(h.as_py())[0] for h in b.column(1)]
            made = [written(skeleton(p)) if p else None for p in paths]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["host", "reference"])

    s = hosted.select("host", "html").mapInArrow(run, "host string, reference string")
    s = s.where("reference is not null").groupBy("host", "reference").agg(F.count("*").alias("n"))
    return s.groupBy("host").agg(F.max(F.struct("n", "reference")).alias("m")).select("host", "m.reference")


def constants(aligned: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(host, template): hashes of the slot texts that are constant among a host's distinct pages."""

    def run(batches):
        for b in batches:
            out: dict = {}
            for host, html, ref in zip(b.column(0), b.column(1), b.column(2), strict=True):
                paths, texts = page_blocks(html.as_py())
                if not texts or not ref.as_py():
                    continue
                page = _h("\n".join(texts))
                for s, t in zip(slots(paths, read(ref.as_py())), texts, strict=True):
                    out[(host.as_py(), _h(s), _h(s + "\n" + t), page)] = None
            cols = list(zip(*out, strict=True)) or [[]] * 4
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["host", "slot", "filled", "page"]
            )

    rows = aligned.select("host", "html", "reference").mapInArrow(run, "host string, slot long, filled long, page long")
    rows = stored(rows.distinct(), "slots")
    filled = rows.groupBy("host", "slot", "filled").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = rows.groupBy("host", "slot").agg(F.countDistinct("page").alias("pages"))
    kept = stored(filled.join(total, ["host", "slot"]).where(F.col("n") >= F.col("pages") * share).select("host", "slot", "filled"), "constants")
    # texts of a page beyond those that can stand in for constants its slot lacks are its own
    per_slot = rows.groupBy("host", "slot", "page").agg(F.count("*").alias("texts"))
    most = kept.groupBy("host", "slot").agg(F.count("*").alias("most"))
    own = per_slot.join(most, ["host", "slot"], "left").select("host", "page", (F.col("texts") > F.coalesce("most", F.lit(0))).alias("own"))
    own = own.groupBy("host", "page").agg(F.max("own").alias("own")).groupBy("host").agg(F.avg(F.col("own").cast("int")).alias("own"))
    kept = kept.join(own.where("own >= 0.5").select("host"), "host", "left_semi")
    return kept.groupBy("host").agg(F.array_sort(F.collect_set("filled")).alias("template"))


def extract(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(page_id, url, text, n_chars, n_template) of each row of pages (page_id, url, html)."""
    hosted = _hosted(pages)
    refs = stored(references(hosted), "wrappers")
    aligned = hosted.join(refs, "host", "left")
    templates = stored(constants(aligned, share, least), "templates")

    def run(batches):
        for b in batches:
            texts_out, cut = [], []
            for html, ref, template in zip(b.column(2), b.column(3), b.column(4), strict=True):
                paths, texts = page_blocks(html.as_py())
                n = 0
                if texts and template.is_valid and ref.is_valid:
                    known = set(template.as_py())
                    names = slots(paths, read(ref.as_py()))
                    left = [t for s, t in zip(names, texts, strict=True) if _h(s + "\n" + t) not in known]
                    n, texts = len(texts) - len(left), left
                texts_out.append("\n".join(texts))
                cut.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts_out, pa.string()), pa.array(map(len, texts_out), pa.int64()), pa.array(cut, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_template"],
            )

    both = aligned.join(templates, "host", "left").select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", "reference", "template"
    )
    return both.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_template long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
