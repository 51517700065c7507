"""Main text of web pages by site template removal.

Block-level subtrees of the whole page are hashed bottom-up and counted per host in Spark, over pages of different content, so that copies of
a page count once. Those on SHARE or more of their host's pages (and at least MANY, or DEEP inside the article or main part, so that a few pages
that share a paragraph keep it) are deleted first; inline elements stay in their sentence. In what is left the main text is chosen, and menus,
adverts and other parts too rare to be counted go by tag, role and class.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Mapping, Set
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceatlas.llm.common import BROADCAST_ROWS, materialize, slices, small_batches

#: A template of a host: least number (outside and inside of the main part), and least share, of its pages of different content that hold the subtree.
MANY, DEEP, SHARE = 5, 8, 0.3
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|textarea|title|noscript|template|iframe|svg|select|button|object|audio|video)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^\"'>]*(?:\"[^\"]*\"[^\"'>]*|'[^']*'[^\"'>]*)*)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|</?[a-zA-Z][^<>]*\Z",  # a quote that never ends: the tag ends at its first >
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
_CLOSES_P = _BLOCKS - {"html", "body", "li", "dd", "dt", "tr", "tbody", "thead", "tfoot", "caption", "summary"}
_SAME = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
_DROPPED = frozenset("head nav footer aside form menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_MARKED = re.compile(
    r"(?<![a-z])(?:ads?|adverts?|advertis\w+|adsense|sponsor\w*|promo\w*|banner|menu\w*|nav|navbar|navigation|breadcrumbs?|sidebar|footer|masthead|cookies?|consent|gdpr|notices?|"
    r"notifications?|popup|modal|newsletter|subscri\w+|sharing|share|social|related|recommend\w*|comments?|commentlist|disqus|repl(?:y|ies)|pagination|pager|widgets?|toolbar|login|signup|skip)(?![a-z])"
)
#: Class parts that tell what an element has or lacks, not what it is.
_STATE = re.compile(r"(?<![\w-])(?:has|no|with|without)-[\w-]*")
#: Parts of a class or id that say how, not what: inside the main part a name tells of boilerplate only if it has nothing else but marks.
_PLAIN = frozenset(
    "area articles bar block blocks bottom box btn button buttons card cards col container content count feed form group holder icon icons inner item items js left link links list main module "
    "outer overlay page panel post posts primary right row secondary section site slot small story strip text thread title top unit user wrap wrapper".split()
)
_COUNTED = _BLOCKS - {"html", "body"}


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "mark", "words")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.kids, self.parent, self.mark, self.words = tag, attrs, [], parent, 0, 0


def parse(text: str) -> tuple[Node, list[Node]]:
    """The tree and its elements in the order of their ends, with subtree hashes and word counts; a missing end tag ends with its parent."""
    import xxhash

    root = Node("#", {}, None)
    at, order = root, []

    def close(node: Node) -> None:
        h = xxhash.xxh3_64(f"{node.tag}|{node.attrs.get('class', '')}|{node.attrs.get('id', '')}".encode())
        for k in node.kids:
            if isinstance(k, Node):
                h.update(k.mark.to_bytes(8, "big"))
                node.words += k.words
            else:
                words = k.split()
                h.update(" ".join(words).encode("utf-8", "surrogatepass"))
                node.words += len(words)
        node.mark = h.intdigest()
        order.append(node)

    def up_to(node: Node) -> Node:
        nonlocal at
        while at is not node:
            close(at)
            at = at.parent
        return at

    end = 0
    for m in _TOKEN.finditer(text):
        if m.start() > end:
            s = text[end : m.start()]
            at.kids.append(entities.unescape(s) if "&" in s else s)
        end = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if m[2] or m[5]:
            node = at
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                up_to(node.parent)
            continue
        stop = {"p"} if tag in _CLOSES_P else {tag} if tag in _SAME else None
        if tag in ("dd", "dt"):
            stop = {"dd", "dt"}
        if stop:
            node = at
            while node.parent is not None and node.tag not in stop and node.tag not in _SAME.get(tag, ()) and (tag in _SAME or node.tag not in _BLOCKS):
                node = node.parent
            if node.tag in stop:
                up_to(node.parent)
        raw = m[4] or m[7] or ""
        attrs = {a[0].lower(): (a[1] or a[2] or a[3]).lower() for a in _ATTR.findall(raw)} if raw.strip(" /") else {}
        node = Node(tag, attrs, at)
        at.kids.append(node)
        if tag not in _VOID and not raw.endswith("/"):
            at = node
        else:
            close(node)
    if end < len(text):
        at.kids.append(entities.unescape(text[end:]))
    close(up_to(root))
    return root, order


def _main(n: Node) -> bool:
    return n.tag in ("article", "main") or n.attrs.get("role") in ("main", "article") or "articlebody" in n.attrs.get("itemprop", "")


def _names(n: Node) -> str:
    return _STATE.sub(" ", f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}")


def _all_marks(names: str) -> bool:
    """Whether a name consists of marks and plain parts alone, as share-buttons does and share-price does not."""
    for name in names.split():
        parts = [p for p in re.split(r"[-_]+|\d+", name) if p]
        marks = [bool(_MARKED.fullmatch(p)) for p in parts]
        if any(marks) and all(m or p in _PLAIN for p, m in zip(parts, marks, strict=True)):
            return True
    return False


def _boilerplate(n: Node, holds_main: bool, within: bool = False) -> bool:
    if holds_main or n.tag in ("html", "body"):
        return False
    a = n.attrs
    if n.tag in _DROPPED or a.get("role") in _ROLES or "hidden" in a or a.get("aria-hidden") == "true":
        return True
    if n.tag == "header":
        return not any(isinstance(k, Node) and k.tag == "h1" for k in n.kids)
    return bool(a and not _main(n) and (_all_marks(_names(n)) if within else _MARKED.search(_names(n))))


def outline(text: str, cut: Mapping[int, bool] | Set[int] = frozenset()) -> tuple[list[Node], set[int], list[Node]]:
    """(roots of the main text, ids of dropped elements, block-level elements of the whole page, which are counted).

    Elements with hashes in cut are dropped first; inside a main part only those whose value is true (all, if cut is a set). An ancestor that
    looks like boilerplate is spared only where no main part stands outside such ancestors; then the one with most words saves its own.
    """
    root, order = parse(text)
    counted = [n for n in order if n.words and n.tag in _COUNTED]
    deep = cut if isinstance(cut, Mapping) else dict.fromkeys(cut, True)
    gone, parts, stack = set(), [], [(root, False, False)]
    while stack:  # templates, and the main parts that are left with whether boilerplate holds them
        n, inside, held = stack.pop()
        if deep and n.words and n.tag in _COUNTED and signed(n.mark) in deep and (deep[signed(n.mark)] or not inside):
            gone.add(id(n))
            continue
        held = held or (n.tag != "#" and _boilerplate(n, False, inside))
        if _main(n) and n.words and not any(_MARKED.fullmatch(w) for w in _names(n).split()):
            parts.append((held, -n.words, len(parts), n))
        stack += [(k, inside or _main(n), held) for k in reversed(n.kids) if isinstance(k, Node)]
    holds: set[int] = set()
    if parts and all(p[0] for p in parts):
        p = min(parts, key=lambda p: p[:3])[3].parent
        while p is not None:
            holds.add(id(p))
            p = p.parent
    dropped: set[int] = set()
    stack = [(root, False, False)]
    articles: list[Node] = []
    mains: list[Node] = []
    while stack:
        n, within, inside = stack.pop()
        if id(n) in gone or (n.tag != "#" and _boilerplate(n, id(n) in holds, inside)) or (within and n.tag == "article"):  # an article in an article is a comment on it
            dropped.add(id(n))
            continue
        if _main(n):
            (articles if n.tag == "article" or n.attrs.get("role") == "article" or "articlebody" in n.attrs.get("itemprop", "") else mains).append(n)
        stack += [(k, within or n.tag == "article", inside or _main(n)) for k in reversed(n.kids) if isinstance(k, Node)]
    roots = [n for n in mains if n.words] or articles or mains or [root]
    top, kept = set(map(id, roots)), []
    for n in roots:  # the outermost ones
        p = n.parent
        while p is not None and id(p) not in top:
            p = p.parent
        if p is None:
            kept.append(n)
    return kept, dropped, counted


def signed(mark: int) -> int:
    return mark - (1 << 64) if mark >> 63 else mark


def main_text(text: str | None, cut: Mapping[int, bool] | Set[int] = frozenset()) -> str:
    """Blocks of the main text without dropped elements and without subtrees whose hash is in cut; joined by blank lines."""
    if not text:
        return ""
    roots, lost, _ = outline(text, cut)
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if now and (s := " ".join("".join(now).split())):
            blocks.append(s)
        now.clear()

    for r in roots:
        stack: list = [r]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                now.append(n)
            elif isinstance(n, tuple):
                flush()
            elif id(n) not in lost:
                if n.tag in _BLOCKS:
                    flush()
                    stack.append((n,))
                elif n.tag in ("br", "td", "th"):
                    now.append(" ")
                stack += reversed(n.kids)
        flush()
    return "\n\n".join(blocks)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url).hostname or "") if url else ""
    except ValueError:
        return ""


def _subtree_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in slices(batches):
        host, key, content, marks = [], [], [], []
        for k, u, t in zip(b.column("key").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            roots, _, counted = outline(t or "")
            host.append(host_of(u))
            key.append(k)
            content.append(signed(xxhash.xxh3_64_intdigest(b"".join(r.mark.to_bytes(8, "big") for r in roots))))
            marks.append(list({signed(n.mark) for n in counted}))
        yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "host": pa.array(host, pa.string()), "content": pa.array(content, pa.int64()), "marks": pa.array(marks, pa.list_(pa.int64()))})


def _text_task(templates: dict[str, dict[int, bool]]):
    """templates: hashes by host, with whether they are cut inside a main part; a column cut, where there is one, holds the page's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if "cut" in b.schema.names:
                cuts = [{m["mark"]: m["deep"] for m in c or ()} for c in b.column("cut").to_pylist()]
            else:
                cuts = [templates.get(host_of(u), {}) for u in b.column("url").to_pylist()]
            text = [main_text(t, c) for t, c in zip(b.column("html").to_pylist(), cuts, strict=True)]
            yield pa.RecordBatch.from_pydict({"page": b.column("page"), "text": pa.array(text, pa.string())})

    return run


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All columns of pages, but text (replaced), with the main text of html in text.

    Null or empty html, or no text left: "". A null or broken url: pages of that kind form one host. Repeated rows give repeated results and
    count once. Pages of any length are read whole. A subtree right at the least number or share is deleted. An empty table gives no rows.
    """
    columns = [c for c in pages.columns if c.lower() != "text"]
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    rows = small_batches(pages).select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("page"), url.alias("url"), html.alias("html"), F.xxhash64(url, html).alias("key"))
    seen = rows.select("key", "url", "html").mapInArrow(_subtree_task, "key long, host string, content long, marks array<long>")
    seen = materialize(seen, "subtrees")
    sizes = seen.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    marks = seen.select("key", "host", "content", F.explode("marks").alias("mark"))
    counts = marks.groupBy("host", "mark", "content").count().groupBy("host", "mark").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= MANY)
    templates = counts.join(sizes, "host").where(F.col("pages") >= SHARE * F.col("size")).select("host", "mark", (F.col("pages") >= DEEP).alias("deep"))
    templates = materialize(templates, "templates")
    known: dict[str, dict[int, bool]] = {}
    if templates.count() <= BROADCAST_ROWS:
        for t in templates.collect():
            known.setdefault(t.host, {})[t.mark] = t.deep
        found = rows.select("page", "url", "html")
    else:
        cut = materialize(marks.join(templates, ["host", "mark"]).groupBy("key").agg(F.collect_set(F.struct("mark", "deep")).alias("cut")), "cuts")
        found = rows.join(cut, "key", "left").select("page", "html", "cut")
    schema = T.StructType([T.StructField("page", rows.schema["page"].dataType), T.StructField("text", T.StringType())])
    return found.mapInArrow(_text_task(known), schema).select("page.*", "text")
