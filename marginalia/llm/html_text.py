"""HTML extraction by wrapper induction on the pages of a host.

Alignment. Each host has a reference page (the one of least hash). Every page's tree is aligned with the reference tree by simple tree matching; an
element's slot is the place of the reference node it is matched to, or that of the nearest matched ancestor and the labels below it.

Template and content. Over all pages of a host, the text of each slot is counted. A text that fills its slot in CONSTANT of the host's pages (at least
LEAST_PAGES of them) is a constant node and belongs to the template. The content has a container: the deepest slot, of elements that hold other blocks, that
CONSTANT of the pages have and that holds more than CONTENT of their text (there is one chain of such slots, so one deepest); where an article or main element lies on that
chain, it is the container. Varying slots within the container are content. A slot that branches off the chain and that CONSTANT of the pages have is a part of the template (menu,
advert, footer) whose text varies: nothing in it is content, whatever its name is, but for a varying h1 that no name rules out. Branches that only some pages have are left to the names.

Names. Element, class, id and role names break ties: text they rule out has no part in the choice of a container, and parts within the container that
they rule out (comments, adverts or forms within an article) are no content. They overrule nothing at or above the container. They alone decide where
there is nothing to align with: for hosts of fewer than LEAST_PAGES pages, or without a container, and for a page without content in its host's container.

Pages are parsed once; blocks with slots and hashes are written as a table, from which counts and texts are read. Counting is by (host, slot, hash) with partial
sums, so a host that holds a third of all pages is no task of its own. The template of a host is at most a few hundred hashes; templates are broadcast while
there are at most BROADCAST_HOSTS hosts, and joined plainly beyond. The reference trees are joined in the same way.

Edge cases: a null or empty page has the text ""; a null url is of the empty host; a page whose every block is constant keeps what the names leave of it (hosts of
identical pages); broken markup is closed as browsers do; elements more than 60 levels below a matched one are aligned by their labels; repeated pages are rows
of their own; columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm import dom
from marginalia.llm.common import materialize
from marginalia.llm.url_filters import host_of

CONSTANT, CONTENT, LEAST_PAGES, BROADCAST_HOSTS = 0.9, 0.5, 5, 20_000
#: Elements without text to read, and elements without main text.
MARKUP_TAGS = frozenset("head script style template noscript button select input textarea iframe object embed svg math canvas audio video map title meta link".split())
DROP_TAGS = MARKUP_TAGS | frozenset("nav footer aside form dialog menu".split())
#: Words in class and id names of parts that are not the article (fixed values).
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside widget rail "
    "footer masthead topbar toolbar comment comments commentlist disqus replies respond discussion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations popular trending search form copyright legal disclaimer skip".split()
)
#: Words that count only where no word of KEEP_NAMES stands beside them.
WEAK_NAMES = frozenset("header head top bottom side meta tags tools notice alert form search".split())
KEEP_NAMES = frozenset("article post entry content main body text story prose".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_PARTS = re.compile(r"[a-z]+")


def dropped(node: dom.Node, inside: bool) -> bool:
    """Whether an element and all below it is no main text. inside: within an article or main element."""
    if node.tag in DROP_TAGS or node.role in DROP_ROLES:
        return True
    if node.tag == "header":
        return not inside
    if not node.names or node.tag in ("html", "body", "main"):
        return False
    words = {w for n in node.names for w in _PARTS.findall(n)}
    if node.tag == "article":
        return not words.isdisjoint(DROP_NAMES) and words.isdisjoint(KEEP_NAMES)
    strong = (words & DROP_NAMES) - WEAK_NAMES
    return bool(strong) or (not words.isdisjoint(WEAK_NAMES) and words.isdisjoint(KEEP_NAMES))


def skeleton(page: str) -> str:
    """The reference tree of a page as text: its distinct shapes, and the place of the root."""
    root = dom.parse(page)
    own = dom.Shapes()
    own.of(root)
    return json.dumps([own.parts, root.shape])


def _load(text: str, shapes: dom.Shapes) -> int:
    """The shape of a skeleton's root, added to shapes."""
    parts, root = json.loads(text)
    ids: list[int] = []
    for label, children in parts:
        ids.append(shapes.add((label, tuple(ids[c] for c in children))))
    return ids[root]


def slots(root: dom.Node, reference: int, shapes: dom.Shapes) -> dict[int, str]:
    """id(node): slot, for all elements of a page. A slot is a path: child places in the reference tree, then labels of what is not matched."""
    shapes.of(root)
    out: dict[int, str] = {}
    stack: list[tuple] = [(root, reference, "r")]
    while stack:
        node, ref, slot = stack.pop()
        out[id(node)] = slot
        kids = [c for c in node.children if type(c) is dom.Node]
        if not kids:
            continue
        matched = {}
        if ref >= 0:
            theirs = shapes.parts[ref][1]
            matched = {i: (theirs[j], j) for i, j in shapes.pairs(tuple(c.shape for c in kids), theirs) if kids[i].label() == shapes.parts[theirs[j]][0]}
        for i, c in enumerate(kids):
            if i in matched:
                stack.append((c, matched[i][0], f"{slot}/{matched[i][1]}"))
            else:
                stack.append((c, -1, f"{slot}/+{c.label().replace('/', '_')}"))
    return out


class Block(NamedTuple):
    owner: dom.Node  # the block element
    text: str
    ruled_out: dom.Node | None  # the outermost element that names rule out
    inside: bool  # within the page's article or main elements, if it has any


def all_blocks(root: dom.Node) -> list[Block]:
    """Each block of text, in page order; white space within a block is one blank."""
    regions = _regions(root)
    out: list[Block] = []
    piece: list[str] = []
    # the block element, what rules it out, whether inside a region
    now: tuple = (root, None, not regions)

    def close() -> None:
        if piece:
            if words := "".join(piece).split():
                out.append(Block(now[0], " ".join(words), now[1], now[2]))
            piece.clear()

    # An explicit stack: child list, next place, block element, what rules it out, whether inside a region, whether it ends a block
    stack: list[list] = [[root.children, 0, root, None, not regions, False]]
    while stack:
        top = stack[-1]
        if top[1] >= len(top[0]):
            stack.pop()
            if top[5]:
                close()
            continue
        c = top[0][top[1]]
        top[1] += 1
        if type(c) is str:
            if not piece:
                now = (top[2], top[3], top[4])
            piece.append(c)
            continue
        if c.tag in ("br", "hr", "wbr", "img"):
            if c.tag != "wbr" and piece:
                piece.append(" ")
            continue
        if c.tag in MARKUP_TAGS:
            close()
            continue
        region = id(c) in regions
        inside = top[4] or region
        out_by = top[3] or (c if dropped(c, bool(regions) and inside) else None)
        ends = c.tag not in dom.INLINE or region or out_by is not top[3]
        if ends:
            close()
        stack.append([c.children, 0, c if ends else top[2], out_by, inside, ends])
    close()
    return out


def blocks(root: dom.Node) -> list[tuple[dom.Node, str]]:
    """(element, text) of each block that names and tags alone leave as main text, in page order."""
    return [(b.owner, b.text) for b in all_blocks(root) if b.ruled_out is None and b.inside]


def _regions(root: dom.Node) -> set[int]:
    """ids of the outermost article and main elements outside dropped parts; of main elements with articles, the articles."""
    found: dict[str, set[int]] = {"article": set(), "main": set()}
    stack = [(root, False)]
    while stack:
        node, within = stack.pop()
        for c in node.children:
            if type(c) is dom.Node:
                region = c.tag in found or c.role == "main"
                if dropped(c, within or region):
                    continue
                if region:
                    found["article" if c.tag == "article" else "main"].add(id(c))
                if c.tag != "article":
                    stack.append((c, within or region))
    return found["article"] or found["main"]


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def block_rows(page: str, reference: str | None, shapes: dom.Shapes, loaded: dict) -> tuple[list[dict], list[dict]]:
    """(blocks of a page, the slots of them and above them with the characters of text that names leave in them)."""
    root = dom.parse(page)
    found = all_blocks(root)
    if not found:
        return [], []
    if reference is None:
        return [{"slot": "", "hash": 0, "text": b.text, "ruled_out": None, "named": True, "h1": False} for b in found if b.ruled_out is None and b.inside], []
    if reference not in loaded:
        if len(loaded) > 500 or len(shapes.parts) > 200_000:
            loaded.clear()
            shapes.__init__()
        loaded[reference] = _load(reference, shapes)
    where = slots(root, loaded[reference], shapes)
    rows, above = [], {}
    for b in found:
        named = b.ruled_out is None and b.inside
        out_at = where[id(b.ruled_out)] if b.ruled_out is not None else None if b.inside else ""
        rows.append({"slot": where[id(b.owner)], "hash": hash64(b.text), "text": b.text, "ruled_out": out_at, "named": named, "h1": b.owner.tag == "h1"})
        up = b.owner
        while up is not None:
            slot = where[id(up)]
            chars, holds, region = above.get(slot, (0, False, 0))
            above[slot] = (chars + len(b.text) * named, holds or up is not b.owner, max(region, 2 if up.tag == "article" else int(up.tag == "main" or up.role == "main")))
            up = up.up
    return rows, [{"slot": slot, "chars": chars, "holds": holds, "region": region} for slot, (chars, holds, region) in above.items()]


BLOCK = "struct<slot:string,hash:bigint,text:string,ruled_out:string,named:boolean,h1:boolean>"
ABOVE = "struct<slot:string,chars:bigint,holds:boolean,region:int>"


def _within(slot: Column, container: Column) -> Column:
    return F.concat(slot, F.lit("/")).startswith(F.concat(container, F.lit("/")))


def containers(parsed: DataFrame, seeds: DataFrame) -> DataFrame:
    """host, container: the slot of each host's content; branches: the slots that branch off above it on most pages. parsed: host, above; seeds: host, n."""
    held = parsed.select("host", F.inline("above")).groupBy("host", "slot").agg(F.count(F.lit(1)).alias("k"), F.sum("chars").alias("chars"), F.max("holds").alias("holds"), F.max("region").alias("region"))
    held = materialize(held.join(seeds.select("host", "n"), "host").where(F.col("k") >= CONSTANT * F.col("n")), "held")
    whole = held.where("slot = 'r'").select("host", F.col("chars").alias("whole"))
    chain = held.join(whole, "host").where(F.col("holds") & (F.col("chars") > CONTENT * F.col("whole")))
    # The deepest of the chain; but an article, else a main element, on it comes first.
    rank = F.struct("region", F.size(F.split("slot", "/")).alias("depth"), "slot")
    chosen = chain.groupBy("host").agg(F.max_by("slot", rank).alias("container"))
    # Few a host: the children of the chain's slots that most of its pages have.
    off = held.join(chosen, "host").where(~_within(F.col("slot"), F.col("container")) & _within(F.col("container"), F.regexp_replace("slot", "/[^/]*$", "")) & ~_within(F.col("container"), F.col("slot")))
    return chosen.join(off.groupBy("host").agg(F.collect_set("slot").alias("branches")), "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. page_id, url, text (the main text, "" if none)."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    seeds = keyed.groupBy("host").agg(F.min_by("html", F.struct(F.xxhash64("html"), F.length("html"))).alias("html"), F.count(F.lit(1)).alias("n"))

    def shape(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            yield from pa.table({"host": t["host"], "n": t["n"], "reference": pa.array([skeleton(x.as_py()) for x in t["html"]], pa.string())}).to_batches()

    seeds = materialize(seeds.where(F.col("n") >= LEAST_PAGES).mapInArrow(shape, "host string, n long, reference string"), "seeds")
    few = seeds.count() <= BROADCAST_HOSTS
    side = lambda t: F.broadcast(t) if few else t
    of_block = pa.list_(pa.struct([("slot", pa.string()), ("hash", pa.int64()), ("text", pa.string()), ("ruled_out", pa.string()), ("named", pa.bool_()), ("h1", pa.bool_())]))
    of_above = pa.list_(pa.struct([("slot", pa.string()), ("chars", pa.int64()), ("holds", pa.bool_()), ("region", pa.int32())]))

    def cut(batches):
        shapes, loaded = dom.Shapes(), {}
        for b in batches:
            rows, above = [], []
            for page, ref in zip(b.column("html"), b.column("reference")):
                r, a = block_rows(page.as_py(), ref.as_py(), shapes, loaded)
                rows.append(r), above.append(a)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), pa.array(rows, of_block), pa.array(above, of_above)], ["page_id", "url", "host", "blocks", "above"])

    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}
    parsed = keyed.join(side(seeds.select("host", "reference")), "host", "left").select("page_id", "url", "host", "html", "reference")
    parsed = materialize(parsed.mapInArrow(cut, f"page_id {kinds['page_id']}, url string, host string, blocks array<{BLOCK}>, above array<{ABOVE}>"), "blocks", "zstd")
    keys = F.array_distinct(F.transform("blocks", lambda x: F.struct(x["slot"].alias("slot"), x["hash"].alias("hash"))))
    counts = parsed.select("host", F.explode(keys).alias("key")).where("key.slot != ''").groupBy("host", "key").agg(F.count(F.lit(1)).alias("k"))
    common = counts.join(side(seeds.select("host", "n")), "host").where((F.col("k") >= LEAST_PAGES) & (F.col("k") >= CONSTANT * F.col("n")))
    template = common.groupBy("host").agg(F.collect_set("key").alias("template"))
    induced = materialize(containers(parsed, side(seeds)).join(template, "host", "full"), "template")
    both = parsed.join(side(induced), "host", "left")
    varies = lambda x: F.col("template").isNull() | ~F.array_contains(F.col("template"), F.struct(x["slot"].alias("slot"), x["hash"].alias("hash")))
    # What names rule out counts below the container only; "" stands for text beside the page's articles.
    below = lambda x: x["ruled_out"].isNotNull() & ((x["ruled_out"] == "") | (_within(x["ruled_out"], F.col("container")) & (x["ruled_out"] != F.col("container"))))
    branch = lambda x: F.coalesce(F.exists("branches", lambda b: _within(x["slot"], b)), F.lit(False))
    content = lambda x: varies(x) & F.when(_within(x["slot"], F.col("container")), ~below(x)).otherwise(x["named"] & (x["h1"] | ~branch(x)))
    told = F.filter("blocks", content)
    holds = F.exists("blocks", lambda x: varies(x) & _within(x["slot"], F.col("container")) & ~below(x))
    by_names = F.filter("blocks", lambda x: x["named"])
    varying = F.filter(by_names, varies)
    kept = F.when(F.coalesce(holds, F.lit(False)), told).when(F.size(varying) > 0, varying).otherwise(by_names)
    return both.select("page_id", "url", F.array_join(F.transform(kept, lambda x: x["text"]), " ").alias("text"))
