"""Main-text extraction by union-free regular-expression inference over same-host token streams.

Pages of one template are one string of a union-free regular language: tags and fixed texts, text
slots (#), optional groups (...)? and repeated groups (...)+.  A page's token stream is first folded
(adjacent equal items become a repeated group), which turns the pages of a host into few distinct
skeletons; per host these are aligned one after the other, mismatches becoming optional groups, and
differing texts becoming slots.  The result is the host's wrapper.

The wrapper decides every page of its host.  Texts that ``SHARE`` % of the pages with text have in one
place are the template's own words.  The article's region is one or more of the wrapper's containers:
those that are marked as an article (or, at a lower rank, as main, or by their names) if at least half of
the pages with text hold text in such; else the innermost container with three quarters of the text of
all pages that is not template.  A page's article is what stands in the wrapper's slots within the region,
but for the template's words (unless nothing else is there) and for parts that are no article wherever
they are: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments.
Only a page without text in these slots is looked at by itself, in the same order of evidence.

All pages take part in the inference: a page contributes a skeleton and hashed fixed texts, combined
before the shuffle.  Of skeletons a host may have without end: ``GROUP`` or so are aligned into a partial
wrapper, and these again, until the host has one.  What is nested ``DEEP`` blocks or more is one container;
streams too long for a table are aligned at their ends, and between by keys.  What the wrappers say of
hosts goes to the pages by broadcast within ``HOST_BYTES``, beyond that by a join with salted hosts.

Defined cases: null or empty html gives the empty text; a null or odd url is host ''; unclosed and
stray tags are repaired (p and li close themselves, an end tag closes what is open inside it, ends
without a start are ignored); pages may be nested to any depth; repeated rows give equal rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import materialize, table

#: Skeletons that are aligned into one partial wrapper; blocks in blocks from which all is one container.
GROUP, DEEP = 64, 200
#: Bytes that are broadcast of what is known of hosts; salts of a host beyond that.
HOST_BYTES, SALTS = 32 << 20, 64
#: Pages of a host from which equal texts count as its template, and the hundredths of its pages with text that have one.
MIN_PAGES, SHARE = 4, 90

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select xmp noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption search".split()
)
OUTSIDE = frozenset("nav header footer aside form head button menu dialog fieldset search label option".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
#: Last words of class and id names of regions that are no article.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation navi menu menubar breadcrumb breadcrumbs crumbs pagination pager toolbar "
    "sidebar aside rail related recommended recommendations widget widgets footer foot header masthead topbar cookie cookies consent gdpr notice notices popup modal overlay alert paywall "
    "newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus respond replies reply".split()
)
#: Words that say nothing after another.
NEUTRAL_WORDS = frozenset("area bar block box container form group holder inner items label links list outer panel row section slot unit wrap wrapper".split())
INSIDE_WORDS = frozenset("article post entry content main story body text maincontent articlebody postbody postcontent entrycontent".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|$)", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")


class Node:
    __slots__ = ("name", "attrs", "children", "parent", "holds")

    def __init__(self, name: str, attrs: str, parent: Node | None):
        self.name, self.attrs, self.parent, self.children, self.holds = name, attrs, parent, [], False
        if name in ("article", "main"):  # what is around an article knows
            while parent is not None and not parent.holds:
                parent.holds, parent = True, parent.parent


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip() else {}


_CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_SCOPE = frozenset("table td th ul ol dl div article section main body html aside nav header footer form blockquote li".split())


def parse(page: str) -> Node:
    """The page's tree; texts are str children."""
    root = at = Node("#root", "", None)
    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.search(page, pos)
        if m is None:
            at.children.append(page[pos:])
            break
        if m.start() > pos:
            at.children.append(page[pos : m.start()])
        pos = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            walk = at
            while walk is not None and walk.name != name:
                walk = walk.parent
            if walk is not None and walk.parent is not None:
                inner = at
                # a stray inline end does not close blocks around it
                if name not in BLOCK:
                    while inner is not walk and inner.name not in BLOCK:
                        inner = inner.parent
                    if inner is not walk:
                        continue
                at = walk.parent
            continue
        if name in _CLOSES or name in BLOCK:
            up = at
            while up.parent is not None:
                closed = _CLOSES.get(up.name)
                if closed is not None and name in closed:
                    at = up.parent
                    break
                if up.name in _SCOPE:
                    break
                up = up.parent
        node = Node(name, m[3] or "", at)
        at.children.append(node)
        if name in VOID or m[3] and m[3].rstrip().endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        at = node
    return root


def outside(node: Node) -> bool:
    """Whether the element is a region that is no article."""
    if node.name in OUTSIDE:
        # an article's own header holds its title, and some pages are one form
        return not ((node.name == "header" and _within_article(node)) or (node.name == "form" and node.holds))
    if node.name in RAW:
        return True
    if not node.attrs:
        return False
    a = attributes(node.attrs)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    if a.get("role", "").lower() in OUTSIDE_ROLES:
        return True
    if node.name in ("article", "main", "body", "html"):
        return bool(node.name == "article" and {"comment", "comments", "reply"} & _heads(a))
    return bool(_heads(a) & OUTSIDE_WORDS) and not _marked_body(a)


def _names(a: dict[str, str]) -> set[str]:
    return {w.lower() for k in ("class", "id") for w in _WORDS.findall(a.get(k, ""))}


def _heads(a: dict[str, str]) -> set[str]:
    """The word that each class and id is about: its last, but for those that say nothing."""
    out = set()
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = [w.lower() for w in _WORDS.findall(name)]
        while len(words) > 1 and words[-1] in NEUTRAL_WORDS:
            words.pop()
        out.update(words[-1:])
    return out


def _marked_body(a: dict[str, str]) -> bool:
    return a.get("itemprop", "").lower() == "articlebody"


def _within_article(node: Node) -> bool:
    up = node.parent
    while up is not None:
        if up.name == "article" or up.name == "main":
            return True
        up = up.parent
    return False


def marked(node: Node) -> int:
    """How strongly a block is marked as the article: 3 article, 2 main, 1 by its names."""
    if node.name not in BLOCK:
        return 0
    if node.name == "article":
        return 3
    a = attributes(node.attrs) if node.attrs else {}
    if _marked_body(a):
        return 3
    if node.name == "main" or a.get("role", "").lower() in ("main", "article"):
        return 3 if a.get("role", "").lower() == "article" else 2
    if node.name in ("div", "section", "td") and {w for w in _names(a)} & INSIDE_WORDS:
        return 1
    return 0


def blocks(root: Node) -> tuple[list[tuple[str, str]], dict[int, set[str]]]:
    """(path, text) of each block, in page order, white space folded; and by rank the paths of the outermost marked blocks.

    Regions that are no article are passed over.  An explicit stack: pages may be nested deeply; ``DEEP`` blocks
    down, paths go no further.
    """
    out: list[tuple[str, str]] = []
    marks: dict[int, set[str]] = {3: set(), 2: set(), 1: set()}
    held: list[str] = []
    where = ""

    def flush(path: str) -> None:
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((path, text))

    # (element or text, path, depth in blocks, ranks around; at an element's end: the path to go back to)
    stack: list[tuple] = [(root, "", 0, 0, None)]
    while stack:
        x, path, depth, ranks, back = stack.pop()
        if back is not None:
            flush(path)
            where = back
        elif isinstance(x, str):
            held.append(x)
        elif x is not root and outside(x):
            if x.name in BLOCK or x.name in OUTSIDE:
                flush(where)
        elif x.name in VOID:
            held.append(" ")
            if x.name == "hr":
                flush(where)
        else:
            if x.name in BLOCK:
                flush(where)
                before, path, depth = where, _below(path, depth, x), depth + 1
                where = path
                rank = marked(x)
                if rank and not ranks >> rank & 1:
                    marks[rank].add(path)
                    ranks |= 1 << rank
                stack.append((x, path, depth, ranks, before))
            stack.extend((c, path, depth, ranks, None) for c in reversed(x.children))
    flush(where)
    return out, marks


def _below(path: str, depth: int, node: Node) -> str:
    """The path of a block in a block that is ``depth`` blocks down."""
    return f"{path}/{signature(node)}" if depth < DEEP else path if depth > DEEP else f"{path}/~"


def within(path: str, region: str) -> bool:
    return path == region or path.startswith(f"{region}/")


def outermost(paths_: set[str]) -> list[str]:
    """Paths that are in no other of them, in order."""
    out: list[str] = []
    for p in sorted(paths_, key=lambda p: (p.count("/"), p)):
        if not any(within(p, r) for r in out):
            out.append(p)
    return out


# ---------------------------------------------------------------- wrapper inference


def signature(node: Node) -> str:
    a = attributes(node.attrs) if node.attrs else {}
    return node.name + "".join(sorted(f".{c}" for c in a.get("class", "").split()[:4] if not any(ch.isdigit() for ch in c)))


def skeleton(root: Node) -> list:
    """The folded token stream: strings ('#': a text), elements ('e', signature, items...) and ('+', item) for repeated groups."""
    opened: list[tuple[str, list]] = [("", [])]  # blocks that are open: signature, items
    stack: list[tuple[object, int, bool]] = [(root, 0, False)]
    while stack:
        x, depth, end = stack.pop()
        items = opened[-1][1]
        if end:
            name, items = opened.pop()
            opened[-1][1].append(("e", name, *fold(items)))
        elif isinstance(x, str):
            if x.strip() and (not items or items[-1] != "#"):
                items.append("#")
        elif x.name not in VOID and x.name not in RAW:
            if x.name in BLOCK:
                if depth <= DEEP:
                    opened.append((signature(x) if depth < DEEP else "~", []))
                    stack.append((x, depth, True))
                depth += 1
            stack.extend((c, depth, False) for c in reversed(x.children))
    return fold(opened[0][1])


def fold(items: list) -> list:
    """Adjacent items of one kind become a repeated group; their bodies are aligned into one."""
    out: list = []
    for x in items:
        if out and isinstance(x, tuple):
            last = out[-1]
            if isinstance(last, tuple) and last[0] == "+" and last[1][1] == x[1]:
                out[-1] = ("+", _merge(last[1], x))
                continue
            if isinstance(last, tuple) and last[0] == "e" and last[1] == x[1]:
                out[-1] = ("+", _merge(last, x))
                continue
        out.append(x)
    return out


def _key(x) -> str:
    if isinstance(x, str):
        return x
    return _key(x[1]) if x[0] in "+?" and isinstance(x[1], tuple | str) and not (x[0] == "e") else x[1]


def _merge(a, b):
    """The generalisation of two items with the same key."""
    if a == b:
        return a
    if isinstance(a, str) and isinstance(b, str):
        return a
    opt = "?" if (isinstance(a, tuple) and a[0] == "?") or (isinstance(b, tuple) and b[0] == "?") else ""
    a, b = (x[1] if isinstance(x, tuple) and x[0] == "?" else x for x in (a, b))
    rep = "+" if (isinstance(a, tuple) and a[0] == "+") or (isinstance(b, tuple) and b[0] == "+") else ""
    a, b = (x[1] if isinstance(x, tuple) and x[0] == "+" else x for x in (a, b))
    if isinstance(a, str):
        out = a
    else:
        out = ("e", a[1], *align(list(a[2:]), list(b[2:])))
    if rep:
        out = ("+", out)
    return ("?", out) if opt else out


def align(a: list, b: list) -> list:
    """Align two streams: equal items merge (longest common subsequence), the others become optional."""
    n, m = len(a), len(b)
    if n * m > 250_000:
        return _align_long(a, b)
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ka[i] == kb[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if ka[i] == kb[j]:
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    out += [_optional(x) for x in a[i:]] + [_optional(x) for x in b[j:]]
    return out


def _align_long(a: list, b: list) -> list:
    """Equal beginnings and ends merge; between, the items of one key in both become one optional repeated item."""
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    most = min(len(a), len(b))
    i = next((k for k in range(most) if ka[k] != kb[k]), most)
    j = next((k for k in range(most - i) if ka[-1 - k] != kb[-1 - k]), most - i)
    held: dict = {}
    for x in a[i : len(a) - j] + b[i : len(b) - j]:
        held[_key(x)] = _merge(held[_key(x)], x) if _key(x) in held else x
    between = []
    for x in held.values():
        x = x[1] if isinstance(x, tuple) and x[0] == "?" else x
        between.append(("?", x if isinstance(x, tuple) and x[0] == "+" else ("+", x)))
    ends = list(zip(a[len(a) - j :], b[len(b) - j :], strict=True))
    return [*[_merge(x, y) for x, y in zip(a[:i], b[:i], strict=True)], *between, *[_merge(x, y) for x, y in ends]]


def _optional(x):
    return x if isinstance(x, tuple) and x[0] == "?" else ("?", x)


def paths(wrapper: list) -> set[str]:
    """The paths of the wrapper's text slots."""
    out: set[str] = set()
    stack = [(x, "") for x in wrapper]
    while stack:
        x, at = stack.pop()
        while isinstance(x, tuple) and x[0] in ("+", "?"):
            x = x[1]
        if x == "#":
            out.add(at)
        elif isinstance(x, tuple):
            stack += [(y, f"{at}/{x[1]}") for y in x[2:]]
    return out


def infer(skeletons: list[tuple[list, int]]) -> list:
    """The wrapper of a host: its skeletons, most frequent first, aligned one after the other."""
    wrapper: list | None = None
    for s, _ in skeletons:
        wrapper = s if wrapper is None else align(wrapper, s)
    return wrapper or []


def to_json(x):
    return [to_json(i) for i in x] if isinstance(x, list | tuple) else x


def from_json(x, top: bool = True):
    if isinstance(x, str):
        return x
    return [from_json(i, False) for i in x] if top else tuple(from_json(i, False) for i in x)


def host_of(url: str | None) -> str:
    try:
        return (urlparse(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _digest(path: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def containers(path: str) -> list[str]:
    """The path of a block's innermost container, and of all around it; '' is the page."""
    parts = path.split("/")
    if parts[-1].split(".")[0] in _LEAF:
        parts.pop()
    return ["/".join(parts[:i]) for i in range(1, len(parts) + 1)]


def _containers_sql(path: str) -> str:
    """The same as SQL."""
    leaf = ", ".join(f"'{x}'" for x in sorted(_LEAF))
    parts = f"transform(array(split({path}, '/')), p -> if(split(p[size(p) - 1], '[.]')[0] in ({leaf}), slice(p, 1, size(p) - 1), p))[0]"
    return f"transform(array({parts}), p -> transform(sequence(1, size(p)), i -> array_join(slice(p, 1, i), '/')))[0]"


def _evidence(batches):
    """(host, kind, value, n), summed per batch.

    s: pages of a skeleton; n: pages with text; and of those, t: pages that have a text, as digest, length
    and path; w: characters of text in a container; k: pages with text in blocks marked at a rank; m: pages
    with text in an outermost such block, as rank and path.
    """
    import json

    for batch in batches:
        count: Counter = Counter()
        for url, page in zip(batch.column(1), batch.column(2), strict=True):
            host = host_of(url.as_py())
            root = parse(page.as_py() or "")
            count[host, "s", json.dumps(to_json(skeleton(root)), ensure_ascii=False, separators=(",", ":"))] += 1
            held, marks = blocks(root)
            if held:
                count[host, "n", ""] += 1
                where: Counter = Counter()
                for p, t in held:
                    where[p] += len(t)
                for p, n in where.items():
                    for c in containers(p):
                        count[host, "w", c] += n
                for p, t in set(held):
                    count[host, "t", f"{_digest(p, t)} {len(t)} {p}"] += 1
                for rank, of in marks.items():
                    with_text = [r for r in outermost(of) if any(within(p, r) for p in where)]
                    count[host, "k", str(rank)] += bool(with_text)
                    for r in with_text:
                        count[host, "m", f"{rank} {r}"] += 1
        keys = [k for k in count if count[k]]
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([count[k] for k in keys], pa.int64())], names=["host", "kind", "value", "n"])


def _infer_group(key, pdf):
    import json

    import pandas as pd

    rows = sorted(zip(pdf["value"], pdf["n"], strict=True), key=lambda r: (-r[1], r[0]))
    wrapper = infer([(from_json(json.loads(v)), n) for v, n in rows])
    return pd.DataFrame({"host": [key[0]], "n": [int(pdf["n"].sum())], "value": [json.dumps(to_json(wrapper), ensure_ascii=False, separators=(",", ":"))]})


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def _slots(batches):
    """From wrappers and regions to the slots within: (host, keep, fixed)."""
    import json

    for batch in batches:
        keep = []
        for wrapper, region in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            outer = outermost(set(region or []))
            keep.append(sorted(p for p in paths(from_json(json.loads(wrapper))) if any(within(p, r) for r in outer)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keep, pa.list_(pa.string())), batch.column(3)], names=["host", "keep", "fixed"])


def wrappers(spark: SparkSession, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, wrapper): the inferred wrappers; (host, keep, fixed): paths of its slots in the article's region, and digests of the template's texts."""
    seen = _pages(pages).mapInArrow(_evidence, "host string, kind string, value string, n long").groupBy("host", "kind", "value").agg(F.sum("n").alias("n"))
    seen = materialize(spark, seen, "evidence")
    made = seen.filter("kind = 's'").select("host", "value", "n")
    while True:
        # a host's skeletons, then its partial wrappers, in groups by a hash of them, until each host has one
        size = made.groupBy("host").agg(F.count("*").alias("of"))
        most = size.agg(F.max("of")).first()[0] or 0
        groups = made.join(size, "host").withColumn("part", F.pmod(F.xxhash64("value"), F.ceil(F.col("of") / GROUP)))
        made = materialize(spark, groups.groupBy("host", "part").applyInPandas(_infer_group, "host string, n long, value string"), "partial")
        if most <= GROUP:
            break
        made = made.groupBy("host", "value").agg(F.sum("n").alias("n"))
    made = made.select("host", F.col("value").alias("wrapper"))
    size = seen.filter("kind = 'n'").select("host", F.col("n").alias("pages"))
    # what too few pages have can be on SHARE % of none that counts: it goes before its host's rows meet
    often = seen.filter((F.col("kind") == "t") & (100 * F.col("n") >= SHARE * MIN_PAGES))
    fixed = often.join(size, "host").filter((F.col("pages") >= MIN_PAGES) & (100 * F.col("n") >= SHARE * F.col("pages")))
    fixed = fixed.select("host", "n", *[F.split("value", " ", 3)[i].alias(c) for i, c in enumerate(("digest", "length", "path"))])
    # marks: the highest rank that half of the pages hold text in
    rank = seen.filter("kind = 'k'").join(size, "host").filter(2 * F.col("n") >= F.col("pages")).groupBy("host").agg(F.max(F.col("value").cast("int")).alias("rank"))
    at_rank = seen.filter("kind = 'm'").select("host", F.split("value", " ", 2)[0].cast("int").alias("rank"), F.split("value", " ", 2)[1].alias("path"))
    by_mark = at_rank.join(rank, ["host", "rank"]).groupBy("host").agg(F.collect_set("path").alias("marked"))
    # weight: the innermost container of three quarters of what is not template
    less = fixed.select("host", F.explode(F.expr(_containers_sql("path"))).alias("path"), (-F.col("n") * F.col("length").cast("long")).alias("w"))
    weight = seen.filter("kind = 'w'").select("host", F.col("value").alias("path"), F.col("n").alias("w")).unionByName(less).groupBy("host", "path").agg(F.sum("w").alias("w"))
    total = weight.filter("path = ''").select("host", F.col("w").alias("total"))
    held = weight.join(total, "host").filter((F.col("total") > 0) & (4 * F.col("w") >= 3 * F.col("total")))
    by_weight = held.groupBy("host").agg(F.max_by("path", F.struct(F.size(F.split("path", "/")), "path")).alias("heavy"))
    known = made.join(by_mark, "host", "left").join(by_weight, "host", "left").join(fixed.groupBy("host").agg(F.collect_list(F.col("digest").cast("long")).alias("fixed")), "host", "left")
    region = F.coalesce("marked", F.when(F.col("heavy").isNotNull(), F.array("heavy")))
    known = known.select("host", "wrapper", region.alias("region"), F.coalesce("fixed", F.array().cast("array<long>")).alias("fixed"))
    return made, materialize(spark, known.mapInArrow(_slots, "host string, keep array<string>, fixed array<long>"), "hosts")


def main_text(page: str | None, keep: frozenset = frozenset(), fixed: frozenset = frozenset()) -> tuple[str, bool]:
    """The page's main text, and whether it is what the host's wrapper holds in its region.

    ``keep``: paths of the slots of the wrapper's region; ``fixed``: digests of the host's template texts.
    """
    held, marks = blocks(parse(page or ""))
    inside = [(p, t) for p, t in held if p in keep]
    by_wrapper = bool(inside)
    if not inside:
        inside = alone(held, marks, fixed)
    own = [t for p, t in inside if _digest(p, t) not in fixed] if fixed else []
    return "\n\n".join(own or [t for _, t in inside] * by_wrapper or [t for _, t in inside if not fixed]), by_wrapper


def alone(held: list[tuple[str, str]], marks: dict[int, set[str]], fixed: frozenset) -> list[tuple[str, str]]:
    """The blocks of a page's own region: what it marks most strongly, else the innermost container of three quarters of its text that is not template."""
    for rank in (3, 2, 1):
        inside = [(p, t) for p, t in held if any(within(p, r) for r in outermost(marks[rank]))] if marks[rank] else []
        if inside:
            return inside
    weight: Counter = Counter()
    for p, t in held:
        if _digest(p, t) not in fixed:
            weight.update(dict.fromkeys(containers(p), len(t)))
    heavy = [c for c, n in weight.items() if 4 * n >= 3 * weight[""]]
    region = max(heavy, key=lambda c: (c.count("/"), c), default="")
    return [(p, t) for p, t in held if within(p, region)]


_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre td th tr caption figcaption summary".split())


_TEXTS = "page_id long, url string, text string, by_wrapper boolean"
_NONE = (frozenset(), frozenset())


def _texts(ids, urls, pages, known) -> pa.RecordBatch:
    out = [main_text(page.as_py(), *known(i, url)) for i, (url, page) in enumerate(zip(urls, pages, strict=True))]
    return pa.RecordBatch.from_arrays([ids, urls, pa.array([t for t, _ in out], pa.string()), pa.array([b for _, b in out], pa.bool_())], names=["page_id", "url", "text", "by_wrapper"])


def _extract(held):
    def run(batches):
        for b in batches:
            yield _texts(b.column(0), b.column(1), b.column(2), lambda _, url: held.value.get(host_of(url.as_py()), _NONE))

    return run


def _extract_joined(batches):
    last: tuple = (None, _NONE)
    for b in batches:

        def known(i, _, hosts=b.column(3), keep=b.column(4), fixed=b.column(5)):
            nonlocal last
            if hosts[i].as_py() != last[0]:
                last = (hosts[i].as_py(), (frozenset(keep[i].as_py() or []), frozenset(fixed[i].as_py() or [])))
            return last[1]

        yield _texts(b.column(0), b.column(1), b.column(2), known)


def _with_host(batches):
    for b in batches:
        hosts = pa.array([host_of(u.as_py()) for u in b.column(1)], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns, hosts], names=["page_id", "url", "html", "host"])


def extract(spark: SparkSession, pages: DataFrame, host_bytes: int = HOST_BYTES) -> DataFrame:
    """(page_id, url, text, by_wrapper) per row of ``pages``."""
    _, hosts = wrappers(spark, pages)
    rows = _pages(pages)
    size = F.length("host") + F.aggregate("keep", F.lit(0), lambda n, x: n + F.length(x) + 60) + 40 * F.size("fixed") + 200
    total = hosts.agg(F.sum(size.cast("long"))).first()[0] or 0
    if total <= host_bytes:
        known = {r[0]: (frozenset(r[1]), frozenset(r[2])) for r in hosts.toLocalIterator()}
        return rows.mapInArrow(_extract(spark.sparkContext.broadcast(known)), _TEXTS)
    # a host may have a third of all pages: its pages are dealt over salts, what is known of it goes to each
    salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("host", "__host")
    dealt = rows.mapInArrow(_with_host, "page_id long, url string, html string, host string").withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(salted.hint("merge"), (F.col("host") == F.col("__host")) & (F.col("__salt") == F.col("salt")), "left")
    return joined.select("page_id", "url", "html", "host", "keep", "fixed").mapInArrow(_extract_joined, _TEXTS)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_wrapper")
