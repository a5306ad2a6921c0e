"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page is read as a stream of tokens: opening and closing tokens of block elements, and the texts between them. Like
neighbours fold into a repeated group. The streams of a host's pages are aligned one after the other: equal tokens match,
texts that differ become slots, and where tokens differ, another turn of the group just passed becomes a repeated group,
and what only one of both has becomes an optional group. Wrappers of parts of a host's pages are streams as well and
align in the same way, so they grow on all tasks at once and merge.

The finished wrapper shows where a host keeps its articles: of groups that are named as such that with most of the text
that varies between pages, if it holds a fair share of it, else the smallest group that holds most of it. A page's text is
what lies in that region, without menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments and texts
that are the same at one place of (nearly) all distinct pages. Copies of a page count once there, and texts stay where
more would go than be left. Names of elements and of classes say what is no article; the wrapper says what is.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, renamed, restored
from .urlfilter import host_of

# Names of elements and words in class or id attributes, from the HTML standard and common usage.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math object select button xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br ruby rt rp nobr".split())
DROPPED = set("nav footer aside form dialog menu header head figure-ad audio video canvas".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
HINTS = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond replies share sharing social related recommended widget toolbar pager pagination skip".split())
PLACES = set("site page main global top bottom left right primary secondary".split())  # go before a hint: site-footer
COMMENTS = set("comment comments disqus respond replies".split())
SHOWN, BY_NAME, BY_TAG, FIRM = range(4)  # why an element is left out: a hint or form, its element or role, hidden or comments
OWN_CLOSE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "html", "blockquote", "aside", "nav", "footer", "header", "form"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:.-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)  # attributes that say something about an element
BROADCAST_HOSTS = 50_000  # hosts whose wrappers are broadcast
DEPTH = 150  # of nested elements; deeper ones are flattened into the one at this depth
VARIES = 0  # the hash of a slot whose text isn't constant


class Element:
    """An element of a page: its key (name and main class), why it and all in it is left out (SHOWN if not), its content."""

    __slots__ = ("tag", "key", "off", "content", "main", "inside", "place", "depth", "flat")

    def __init__(self, tag: str, key: str, off: int, main: bool):
        self.tag, self.key, self.off, self.main, self.content, self.inside, self.place = tag, key, off, main, [], False, 0
        self.depth, self.flat = 0, False


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v[1:-1] if v[:1] in "\"'" and v else v) for k, v in ATTRIBUTE.findall(text)}


def hints_in(said: str) -> set[str]:
    """The hint words among names: a name that is one, or that joins hints and places (cookie-banner, site-footer), but
    not one that has other words (has-sidebar, related-work)."""
    out: set[str] = set()
    for name in said.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if parts and parts[-1] in HINTS and all(x in HINTS or x in PLACES for x in parts):
            out.update(x for x in parts if x in HINTS)
    return out


def opened(tag: str, text: str, inside: bool) -> Element:
    """inside: whether it lies in an article, where a header holds the title."""
    off, main, label = SHOWN, tag in ("article", "main"), ""
    if tag in DROPPED and not (inside and tag == "header"):
        off = BY_NAME if tag == "form" else BY_TAG
    if text and TELLING.search(text):
        a = attributes(text)
        said = f"{a.get('class', '')} {a.get('id', '')}".lower()
        names = re.findall(r"[a-z]+", said)
        hint = hints_in(said) - ({"header"} if inside else set())
        role = a.get("role", "").lower()
        main = main or role in ("main", "article") or a.get("itemprop", "") == "articleBody"
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            off = FIRM
        elif hint and not main and tag not in ("html", "body"):
            off = FIRM if hint & COMMENTS else off or BY_NAME
        elif role in ROLES:
            off = off or (BY_NAME if role == "form" else BY_TAG)
        label = f".{names[0]}" if names and tag not in INLINE else ""
    return Element(tag, tag + label, off, main and not off)


def parse(page: str) -> Element:
    """The tree of a page. Unclosed elements end where the standard ends them, or with what holds them; of unclosed
    elements whose content isn't read only the tag is left out."""
    root = Element("", "", SHOWN, False)
    stack, at, unclosed = [root], 0, set()
    while m := TOKEN.match(page, at):
        token, at = m[0], m.end()
        tag = m[2]
        if tag is None:
            if token[0] != "<" or len(token) == 1:
                stack[-1].content.append(token)
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if stack[k].flat and tag not in INLINE:
                        stack[k].content.append(Element(tag, tag, SHOWN, False))
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in VOID:
            stack[-1].content.append(" " if tag in ("br", "wbr", "img", "input") else None)
            continue
        if tag in RAW:
            if not m[3].endswith("/") and tag not in unclosed:
                if end := re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at):
                    at = end.end()
                else:
                    unclosed.add(tag)
            continue
        if tag not in INLINE:
            if len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in INLINE):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        del stack[k:]
                        break
                    if stack[k].tag not in INLINE:
                        break
            if tag in OWN_CLOSE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in OWN_CLOSE[tag]:
                        del stack[k:]
                        break
                    if stack[k].tag in SCOPE:
                        break
        e = opened(tag, m[3], stack[-1].inside)
        e.inside = stack[-1].inside or e.main
        e.place = place_of(e.key, stack[-1].place)
        e.depth = stack[-1].depth + 1
        if e.depth > DEPTH and not ((e.off or e.main) and e.depth <= DEPTH + 8):
            # its content goes to its holder, whose block ends here if it's a block
            if tag not in INLINE:
                stack[-1].content.append(Element(tag, tag, SHOWN, False))
            e.content, e.depth, e.place, e.flat = stack[-1].content, stack[-1].depth, stack[-1].place, True
        else:
            stack[-1].content.append(e)
        if not m[3].endswith("/"):
            stack.append(e)
    show_wrappers(root)
    return root


def show_wrappers(root: Element) -> None:
    """Show again what was left out but wraps the page: the only article or main, or most of the page's text."""
    held: dict[Element, tuple[int, bool]] = {}

    def measure(e: Element) -> tuple[int, bool]:
        """Characters in an element, and whether an article that isn't hidden lies in it."""
        n, main = 0, e.main
        for c in e.content:
            if isinstance(c, str):
                n += len(c) if not c.isspace() else 0
            elif c is not None:
                more, inner = measure(c)
                n, main = n + more, main or inner
        held[e] = n, main and e.off != FIRM
        return held[e]

    def outermost(e: Element, found: list[Element]) -> bool:
        """Collects what is left out, and says whether an article is shown."""
        if e.off:
            found.append(e)
            return False
        shown = e.main
        for c in e.content:
            if isinstance(c, Element):
                shown = outermost(c, found) or shown
        return shown

    shown = outermost(root, off := [])
    if not off:
        return
    total = measure(root)[0]
    while off:
        wraps = [e for e in off if e.off != FIRM and (held[e][1] and not shown or e.off == BY_NAME and 2 * held[e][0] > total)]
        if not wraps:
            return
        max(wraps, key=lambda e: held[e][0]).off = SHOWN
        shown = outermost(root, off := [])


def text_hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) << 1 | 1


def folded(parts: list[str]) -> str:
    """The text of some pieces of source: references decoded, white space folded."""
    return " ".join(entities.unescape("".join(parts)).split())


# An item of a stream: [kind, key, whether its group is optional, is repeated, text hash (VARIES for a slot), characters,
# pages, hashes of distinct pages with this constant text, main, off]
KIND, KEY, OPTIONAL, REPEATED, TEXT, CHARS, PAGES, SEEN, MAIN, OFF = range(10)
OPEN, CLOSE, WORDS = range(3)
SAMPLE, NEARLY = 32, 0.9  # of a text's distinct pages the smallest hashes are kept: the same sample for all texts
FAIR, MOST = 0.3, 0.7  # of the varying text: what a named region holds at least, and an unnamed one
RARE = 64  # of so many pages of a host one has a group whose name says nothing


def stream(root: Element, page: list[int]) -> list[list]:
    """The tokens of a page as a wrapper of its own: like neighbours are one repeated group. page: its page's hash."""
    out: list[list] = [[OPEN, "", False, False, None, 0, 1, page, False, False]]
    run: list[str] = []
    walk: list[list] = [[root, iter(root.content), 0, None]]  # element, what is left of it, its place in out, that of its last block
    blocks_ = [walk[0]]

    def ended() -> None:
        if text := folded(run) if run else "":
            out.append([WORDS, "#text", False, False, text_hash(text), len(text), 1, page, False, False])
            blocks_[-1][3] = None
        run.clear()

    while walk:
        e, rest, start, _ = walk[-1]
        c = next(rest, walk)
        if c is walk:
            walk.pop()
            if e.tag in INLINE and e is not root:
                continue
            ended()
            blocks_.pop()
            out.append([CLOSE, e.key, False, False, None, 0, 1, [], False, False])
            if blocks_:
                settle(out, start, blocks_[-1])
        elif isinstance(c, str):
            run.append(c)
        elif c is not None and not (c.off and c.tag in INLINE):
            walk.append([c, iter(c.content), len(out), None])
            if c.tag not in INLINE:
                ended()
                walk[-1][2] = len(out)
                blocks_.append(walk[-1])
                out.append([OPEN, c.key, False, False, None, 0, 1, [], c.main, bool(c.off)])
    return out


def settle(out: list[list], start: int, level: list) -> None:
    """The group from start on is done: if the group before it in its level is like it, both are one repeated group."""
    if level[3] is not None and out[level[3]][KEY] == out[start][KEY]:
        out[level[3] :] = aligned(out[level[3] : start], out[start:], repeat=True)
    else:
        level[3] = start


def joined(x: list, y: list, repeat: bool) -> list:
    """The item that fits what either of two items of one kind and key fits."""
    text = x[TEXT] if x[TEXT] == y[TEXT] else VARIES
    seen = x[SEEN] if x[SEEN] == y[SEEN] else sorted({*x[SEEN], *y[SEEN]})[:SAMPLE]
    if x[KEY] and (text == VARIES or repeat):
        seen = []
    return [x[KIND], x[KEY], x[OPTIONAL] or y[OPTIONAL], x[REPEATED] or y[REPEATED] or repeat, text, x[CHARS] + y[CHARS], x[PAGES] if repeat else x[PAGES] + y[PAGES], seen, x[MAIN] or y[MAIN], x[OFF] and y[OFF]]


def group_ends(s: list[list]) -> list[int]:
    """For each item the place after the group or text that begins there."""
    out, open_ = [k + 1 for k in range(len(s))], []
    for k, x in enumerate(s):
        if x[KIND] == OPEN:
            open_.append(k)
        elif x[KIND] == CLOSE:
            out[open_.pop()] = k + 1
    return out


class Side:
    """One of two streams on their way through each other."""

    def __init__(self, items: list[list]):
        self.items, self.end, self.at = items, group_ends(items), 0
        self.levels: list[dict[str, list[int]] | None] = []  # of open groups: where keys come, looked up when first asked

    def shut(self) -> bool:
        return self.at >= len(self.items) or self.items[self.at][KIND] == CLOSE

    def next_place(self, key: str) -> int | None:
        """How far on in the open group a group of that key begins."""
        if self.levels[-1] is None:
            self.levels[-1], k = {}, self.at
            while k < len(self.items) and self.items[k][KIND] != CLOSE:
                self.levels[-1].setdefault(self.items[k][KEY], []).append(k)
                k = self.end[k]
        there = self.levels[-1].get(key, [])
        k = bisect_left(there, self.at)
        return there[k] - self.at if k < len(there) else None

    def group(self) -> list[list]:
        start, self.at = self.at, self.end[self.at]
        return self.items[start : self.at]


def aligned(a: list[list], b: list[list], repeat: bool = False) -> list[list]:
    """The wrapper that fits what either of two streams fits; repeat: they are turns of one group."""
    out: list[list] = []
    x, y = Side(a), Side(b)
    levels: list[list] = []  # of open groups: start in out at [2], that of the last group within at [3]

    def alone(side: Side) -> None:
        """What one stream has here: another turn of the group just passed, or an optional group."""
        group, start = side.group(), len(out)
        out.extend(group)
        if group[0][KIND] == OPEN:
            settle(out, start, levels[-1])
        else:
            levels[-1][3] = None
        if len(out) > start:  # not folded into the one before
            out[start] = [*group[0][:OPTIONAL], True, *group[0][REPEATED:]]

    while x.at < len(a) and y.at < len(b):
        u, v = a[x.at], b[y.at]
        if u[KIND] == v[KIND] and u[KEY] == v[KEY]:
            out.append(joined(u, v, repeat))
            x.at += 1
            y.at += 1
            if u[KIND] == OPEN:
                levels.append([None, None, len(out) - 1, None])
                x.levels.append(None)
                y.levels.append(None)
            elif u[KIND] == CLOSE:
                start = levels.pop()[2]
                x.levels.pop()
                y.levels.pop()
                if levels:
                    settle(out, start, levels[-1])
            else:
                levels[-1][3] = None
        elif x.shut():
            alone(y)
        elif y.shut():
            alone(x)
        else:
            in_y, in_x = y.next_place(u[KEY]), x.next_place(v[KEY])
            if in_y is None and in_x is None:
                alone(x)
                alone(y)
            else:
                alone(y if in_x is None or in_y is not None and in_y <= in_x else x)
    return out


def condensed(wrapper: list[list], longest: int) -> list[list]:
    """The wrapper as it is, or, once it is over twice as long as the longest stream that went into it, with the groups that only
    one page in ``RARE`` (or one alone) has made one group of any content for each level: names that each page makes up
    itself tell nothing about the host, and a wrapper stays as large as its layout. Content of main elements is kept apart."""
    if len(wrapper) <= 2 * longest + 512:
        return wrapper
    few, end = max(1, wrapper[0][PAGES] // RARE), group_ends(wrapper)
    out: list[list] = []
    rests: list[dict[str, int]] = []  # of open groups: characters by the key of what stands for left out groups
    k = 0
    while k < len(wrapper):
        x = wrapper[k]
        if x[KIND] == OPEN and rests and (x[OPTIONAL] or x[KEY][0] == "*") and x[PAGES] <= few:
            key = x[KEY] if x[KEY][0] == "*" else "*main" if x[MAIN] else "*"
            if not x[OFF]:
                rests[-1][key] = rests[-1].get(key, 0) + sum(y[CHARS] for y in wrapper[k : end[k]] if y[KIND] == WORDS)
            k = end[k]
            continue
        if x[KIND] == OPEN:
            rests.append({})
        elif x[KIND] == CLOSE:
            for key, chars in sorted(rests.pop().items()):
                main = key == "*main"
                out += [[OPEN, key, True, True, None, 0, 1, [], main, False], [WORDS, "#text", True, True, VARIES, chars, 1, [], False, False], [CLOSE, key, True, True, None, 0, 1, [], False, False]]
        out.append(x)
        k += 1
    return out


def place_of(key: str, holder: int) -> int:
    """The hash of the path of keys to an element."""
    return zlib.crc32(key.encode("utf-8", "surrogatepass"), holder)


class Group:
    """A group of a finished wrapper: its path, the hash of that, and characters of its text that vary between pages."""

    def __init__(self, item: list, holder: Group | None):
        self.path = [*holder.path, item[KEY]] if holder else []
        self.place = place_of(item[KEY], holder.place) if holder else 0
        self.off = item[OFF] or holder is not None and holder.off
        self.named = holder is not None and holder.named or item[MAIN] and not self.off
        self.repeated, self.key, self.varying, self.within = item[REPEATED], item[KEY], 0, []


def region(wrapper: list[list]) -> dict:
    """Where a host's articles lie: the path of the group that is named so and has most of the varying text, if that is a
    fair share; else of the smallest group with most of it. ``fixed`` are the hashes of texts and their places that nearly
    all of three distinct pages or more share."""
    sample, fixed, named = set(wrapper[0][SEEN]), set(), []
    open_: list[Group] = []
    for x in wrapper:
        if x[KIND] == OPEN:
            open_.append(Group(x, open_[-1] if open_ else None))
        elif x[KIND] == CLOSE:
            g = open_.pop()
            if g.named and not (open_ and open_[-1].named):
                named.append(g)
            if open_:
                open_[-1].varying += g.varying
                open_[-1].within.append(g)
        else:
            g = open_[-1]
            if not g.off and (x[TEXT] == VARIES or x[PAGES] < 2):
                g.varying += x[CHARS]
            elif not g.off and not g.named and g.path and x[TEXT] and not x[REPEATED] and len(sample) >= 3 and len(sample.intersection(x[SEEN])) >= NEARLY * len(sample):
                fixed.add(g.place << 33 | x[TEXT])
    node = g
    total = node.varying
    best = max(named, key=lambda n: (n.varying, -len(n.path)), default=None)
    if best and best.varying >= FAIR * total:
        return {"path": best.path, "fixed": []}
    while best := max(node.within, key=lambda n: n.varying, default=None):
        if not total or best.varying < MOST * total or best.repeated or best.key[0] == "*" or best.key.split(".")[0] == "p":
            break
        node = best
    return {"path": node.path, "fixed": sorted(fixed)}


def regions_of(root: Element, path: list[str]) -> list[Element]:
    found = [root]
    for key in path:
        found = [c for e in found for c in e.content if isinstance(c, Element) and c.key == key and not c.off]
    return found


def named_regions(e: Element) -> list[Element]:
    if e.main or e.off:
        return [e] if e.main and not e.off else []
    return [x for c in e.content if isinstance(c, Element) for x in named_regions(c)]


def blocks(e: Element, fixed: set[int]) -> Iterator[tuple[str, bool]]:
    """The texts of blocks in an element, in order, white space folded, and whether they are fixed at their place."""
    run: list[str] = []

    def ended(place: int) -> Iterator[tuple[str, bool]]:
        text = folded(run) if run else ""
        run.clear()
        if text:
            yield text, bool(fixed) and place << 33 | text_hash(text) in fixed

    def into(x: Element, place: int) -> Iterator[tuple[str, bool]]:
        for c in x.content:
            if isinstance(c, str):
                run.append(c)
            elif c is not None and not c.off:
                if c.tag in INLINE:
                    yield from into(c, place)
                else:
                    yield from ended(place)
                    yield from into(c, c.place)
                    yield from ended(c.place)

    yield from into(e, e.place)
    yield from ended(e.place)


def main_text(page: str | None, found: dict | None) -> str:
    """The main text of a page under its host's region; a page that has no such region is read by its own
    article, then as a whole."""
    if not page:
        return ""
    root = parse(page)
    found = found or {"path": [], "fixed": []}
    there = regions_of(root, found["path"]) if found["path"] else []
    named = named_regions(root)
    there = there or named or [root]
    fixed = set(found["fixed"])
    texts = [b for e in there for b in blocks(e, fixed)]
    gone = sum(len(t) for t, same in texts if same)
    if 2 * gone > sum(len(t) for t, _ in texts):  # a near copy of the host's other pages, not what frames them
        gone = 0
    return "\n".join(t for t, same in texts if not (gone and same))


def wrappers(pages: DataFrame) -> DataFrame:
    """host and region (JSON) of all hosts, from wrappers over all their pages. Tasks align the pages they hold,
    salted groups the tasks' wrappers, and a last step the few that are left of each host."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, longest = TaskContext.get().partitionId(), {}, {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([part % 64] * len(held), pa.int32()), pa.array([json.dumps(w) for w in held.values()])], names=["host", "salt", "wrapper"])

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1)):
                text = page.as_py() or ""
                w = stream(parse(text), [zlib.crc32(text.encode("utf-8", "surrogatepass"))] if text else [])
                longest[host] = max(longest.get(host, 0), len(w))
                held[host] = condensed(aligned(held[host], w), longest[host]) if host in held else w
                if len(held) >= 5000:
                    yield out()
                    held, longest = {}, {}
        if held:
            yield out()

    def merge(table: pa.Table) -> pa.Table:
        whole, longest = None, 0
        for w in map(json.loads, sorted(table.column("wrapper").to_pylist())):
            longest = max(longest, len(w))
            whole = w if whole is None else condensed(aligned(whole, w), longest)
        return pa.table([table.column("host")[:1], pa.array([json.dumps(whole)])], names=["host", "wrapper"])

    def finish(table: pa.Table) -> pa.Table:
        whole = json.loads(merge(table).column("wrapper")[0].as_py())
        return pa.table([table.column("host")[:1], pa.array([json.dumps(region(whole))])], names=["host", "region"])

    own = pages.select("host", F.col("html").cast("string")).mapInArrow(start, "host string, salt int, wrapper string")
    few = own.groupBy("host", "salt").applyInArrow(lambda t: merge(t), "host string, wrapper string")
    return few.groupBy("host").applyInArrow(lambda t: finish(t), "host string, region string")


def extract(pages: DataFrame) -> DataFrame:
    """Adds text and n_chars (its code points) to pages (url, html and any other columns), of which html goes.

    A null or empty html has the text "". Pages whose url is null or has no host share one wrapper. Repeated
    rows stay; columns of pages that have the names of added ones, in any case, are replaced."""
    frame, own = renamed(pages, ["text", "n_chars"])
    html = own["html"]
    hosted = frame.withColumn("host", host_of(F.col(own["url"])))
    found = cut(wrappers(hosted.select("host", F.col(html).alias("html"))))
    if found.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = hosted.join(F.broadcast(found), "host", "left")
    else:  # a host may hold a third of the pages: its pages are dealt over salts
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        joined = hosted.withColumn("salt", F.pmod(F.hash(html), F.lit(32))).join(salted, ["host", "salt"], "left")
    joined = joined.select(*own.values(), "region")
    kept = {c: n for c, n in own.items() if n != html}
    names = list(kept.values())
    kind = "".join(f"`{n}` {joined.schema[n].dataType.simpleString()}, " for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = []
                for page, r in zip(b.column(html), b.column("region").to_pylist()):
                    if r not in known:
                        known = {} if len(known) > 10_000 else known
                        known[r] = json.loads(r) if r else None
                    texts.append(main_text(page.as_py(), known[r]))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*names, "text", "n_chars"])

    return joined.mapInArrow(run, f"{kind}text string, n_chars long").select(*restored(kept), "text", "n_chars")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op6_html_extraction": op6_html_extraction}
SQL: dict[str, str] = {}
