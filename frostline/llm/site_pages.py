"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged from the root down: an element node of the tree is a place in its
parent's style, and a style is the sequence of tags and classes of an element's children.  A node that many
pages have and that always looks and reads alike is unimportant; one whose styles or contents are spread
evenly is important.  Both are entropies to the base of the number of pages that have the node.

The tree has every branch of every page and judges all of their texts.  A check by names follows: what the
markup itself calls a menu, an advert or the article goes or stays by that name, as entropies fail where a
host has few pages, or where its pages repeat one article.  See ``main_text`` for the rules.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections import Counter
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm.common import discard, materialize, new_folder, table
from frostline.llm.encoding import slices

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
HEAD = frozenset("head title base basefont bgsound link meta noscript script style template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
P_SCOPE = frozenset("button caption html marquee object table td template th".split())
#: An element ends an open one of these, if no element of the second set is nearer.
ENDS = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir".split())), "dt": (frozenset("dt dd".split()), frozenset({"dl"})), "dd": (frozenset("dt dd".split()), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})), "td": (frozenset("td th".split()), frozenset("tr table".split())), "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("thead tbody tfoot caption colgroup".split()), frozenset({"table"})), "thead": (frozenset("caption colgroup".split()), frozenset({"table"})),
    "tfoot": (frozenset("thead tbody".split()), frozenset({"table"})), "option": (frozenset({"option"}), frozenset("select datalist".split())),
}

# Names by which pages mark a branch.
UNSEEN = frozenset("head noscript template svg canvas audio video object embed button select datalist".split())
NEVER = frozenset("nav aside footer dialog menu".split())
OUTSIDE = frozenset("header".split())  # a page's, not an article's
SETTLED = frozenset("form".split())  # but not where it holds the article
MAIN_ROLES = frozenset("main article".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
MAIN_NAMES = frozenset("article article-body article-content entry-content post-body post-content story-body main-content".split())
BOILERPLATE = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline-links comment comments consent cookie cookies copyright disclaimer disqus footer gdpr legal login masthead menu menubar modal "
    "nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharebar sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription tagcloud toolbar topbar widget widgets".split()
)
_NEGATIONS = ("has-", "no-", "with-", "without-")

#: Fixed value: by their own low bits a node's counts are dealt over so many tasks, so no site's root or menu is one task's work.
PARTS = 4

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)*+)>""")
_ATTR = re.compile(r"""(class|id|role|itemprop|style|href|src|hidden|aria-hidden)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?(?=[\s/>]|$)""", re.I)
_SEGMENT = re.compile(r"[.!?;:|·•©]+\s+|\n")
_DIGITS = re.compile(r"\d+")


def _named(attrs: dict[str, str]) -> int:
    """1 where an element's attributes call it the article, -1 where they call it boilerplate, else 0."""
    role = attrs.get("role", "").lower()
    if role in NEVER_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return -1
    main = role in MAIN_ROLES or attrs.get("itemprop", "") == "articleBody"
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().replace("_", "-").split():
        if name in MAIN_NAMES:
            main = True
        elif not name.startswith(_NEGATIONS):
            parts = name.split("-")
            if name in BOILERPLATE or parts[0] in BOILERPLATE or parts[-1] in BOILERPLATE:
                return -1
    return 1 if main else 0


class Page:
    """A page's DOM, of elements that aren't plain inline ones, and its text by block.

    ``tags``, ``looks`` (tag, class and role, digits as one), ``parents`` and ``names`` by node, a parent before its
    children; ``texts`` has (block, node, raw text), ``links`` (node, target).  Open elements that an end tag
    or the next element ends by the standard's rules are ended; a ``p`` never holds a block.
    """

    def __init__(self, html: str, by_name: bool = True):
        self.by_name = by_name
        self.tags, self.looks, self.parents, self.names = ["#page"], ["#page"], [-1], [0]
        self.texts: list[tuple[int, int, str]] = []
        self.links: list[tuple[int, str]] = []
        self._parse(html)
        self._settle()

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("#page", 0)]  # tag and the node that holds its text
        opened: Counter = Counter()
        block, pos, end = 0, 0, len(html)
        texts, find, match = self.texts, html.find, _TAG.match

        def pop_to(depth: int) -> bool:
            """End all elements from a depth on; whether one of them is a block."""
            gone = [t for t, _ in stack[depth:]]
            del stack[depth:]
            for t in gone:
                opened[t] -= 1
            return any(t not in INLINE for t in gone)

        while pos < end:
            at = find("<", pos)
            if at < 0:
                at = end
            if at > pos:
                if opened["head"] and html[pos:at].strip() and stack[-1][0] == "head":
                    pop_to(len(stack) - 1)
                texts.append((block, stack[-1][1], html[pos:at]))
            if at >= end:
                break
            m = match(html, at)
            if m is None:
                if html.startswith("<!--", at):
                    gone = re.compile(r"-{0,2}>").match(html, at + 4)
                    close = gone.end() if gone else max(find("-->", at + 4) + 3, 0) or end
                    pos = end if close == 2 else close
                elif html[at + 1 : at + 2] in ("!", "?", "/") and at + 1 < end:
                    close = find(">", at)
                    pos = end if close < 0 else close + 1
                elif at + 1 < end and html[at + 1].isalpha() and html[at + 1].isascii():
                    pos = end  # a tag that never ends
                else:
                    texts.append((block, stack[-1][1], "<"))
                    pos = at + 1
                continue
            pos = m.end()
            tag = m[2].lower()
            if m[1]:
                if tag in ("body", "html") or not opened[tag]:
                    if tag == "br":
                        texts.append((block, stack[-1][1], " "))
                    elif tag == "p":
                        block += 1
                    continue
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                if tag in INLINE and any(t not in INLINE for t, _ in stack[depth:]):
                    continue  # ends inside a block that goes on
                if pop_to(depth):
                    block += 1
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, pos)
                pos = end if close is None else close.start()
                close = find(">", pos)
                pos = end if close < 0 else close + 1
                if tag not in HEAD:
                    block += tag not in INLINE
                continue
            if opened["head"] and tag not in HEAD:
                depth = next(i for i, (t, _) in enumerate(stack) if t == "head")
                pop_to(depth)
            if tag in ("html", "body", "head") and opened[tag]:
                continue
            if tag in CLOSES_P and opened["p"]:
                depth = len(stack) - 1
                while stack[depth][0] != "p" and stack[depth][0] not in P_SCOPE and depth:
                    depth -= 1
                if stack[depth][0] == "p":
                    pop_to(depth)
            if tag in ENDS and any(opened[t] for t in ENDS[tag][0]):
                over, bound = ENDS[tag]
                depth = len(stack) - 1
                while depth and stack[depth][0] not in over and stack[depth][0] not in bound:
                    depth -= 1
                if stack[depth][0] in over:
                    pop_to(depth)
            attrs = {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _ATTR.findall(m[3])} if m[3] else {}
            node = stack[-1][1]
            if target := attrs.get("href") or attrs.get("src"):
                self.links.append((node, target))
            if tag == "br":
                texts.append((block, node, " "))
            if tag not in INLINE:
                block += 1
            if tag in VOID:
                continue
            name = self._name(tag, attrs)
            if tag not in INLINE or name:
                look = f"{tag}.{_DIGITS.sub('0', attrs.get('class', ''))}.{attrs.get('role', '')}"
                self.tags.append(tag)
                self.looks.append(look)
                self.parents.append(node)
                self.names.append(name)
                node = len(self.tags) - 1
            stack.append((tag, node))
            opened[tag] += 1

    def _name(self, tag: str, attrs: dict[str, str]) -> int:
        """4: never text; 2: boilerplate, whatever is in it; -1: boilerplate unless it holds the article; 1: the article; 3: a page's header."""
        if tag in UNSEEN:
            return 4
        if self.by_name and tag in NEVER:
            return 2
        if tag in ("html", "body") or not self.by_name:
            return 0
        named = _named(attrs) if attrs else 0
        if named < 0 or tag in SETTLED:
            return -1
        if tag in OUTSIDE:
            return 3
        return 1 if named or tag in ("article", "main") else 0

    def _settle(self) -> None:
        """``states`` by node: -1 boilerplate, 1 article, 0 left to the tree; a page's unnamed rest beside a named article, but its first-level headings, is boilerplate.

        ``seen``: nodes that the tree has, which are all but elements that are never text and what is in them.
        """
        parents, names = self.parents, self.names
        self.seen = seen = [True] * len(names)
        for i in range(1, len(names)):
            seen[i] = names[i] != 4 and seen[parents[i]]
        holds = [False] * len(names)
        for i, n in enumerate(names):
            if n == 1:
                above = parents[i]
                path = []
                while above >= 0 and names[above] not in (2, 4):
                    path.append(above)
                    above = parents[above]
                if above < 0:
                    for k in path:
                        holds[k] = True
        self.states = states = [0] * len(names)
        for i in range(1, len(names)):
            n, up = names[i], states[parents[i]]
            if up < 0 or n in (2, 4) or (n == -1 and not holds[i]) or (n == 3 and up == 0 and not holds[i]):
                states[i] = -1
            elif up == 1 or n == 1:
                states[i] = 1
        if holds[0]:
            self.rest = [s == 0 and t != "h1" for s, t in zip(states, self.tags)]
        else:
            self.rest = [False] * len(states)
        #: Nodes whose text no name settles.
        self.open = sorted({n for _, n, t in self.texts if states[n] == 0 and not self.rest[n] and not t.isspace()})

    def tree(self, host: str) -> None:
        """``ids`` of the nodes in the host's tree and of their ``styles``, both 64-bit hashes down from the host."""
        children: list[list[int]] = [[] for _ in self.tags]
        for i in range(1, len(self.tags)):
            children[self.parents[i]].append(i)
        self.children, self.ids, self.styles = children, [0] * len(self.tags), [0] * len(self.tags)
        place, hashed = [0] * len(self.tags), xxhash.xxh3_64_intdigest
        for i in range(len(self.tags)):
            if self.seen[i]:
                self.ids[i] = _signed(hashed(f"{host}\0" if i == 0 else str(place[i]), seed=self.styles[self.parents[i]] % 2**64 if i else 0))
                self.styles[i] = _signed(hashed("\0".join([self.looks[c] for c in children[i]]), seed=self.ids[i] % 2**64))
                for k, c in enumerate(children[i]):
                    place[c] = k

    def features(self) -> dict[int, set[int]]:
        """By node of the tree the hashes of what it says: its text's sentences and its links' targets."""
        said: dict[int, list[str]] = {}
        for _, node, t in self.texts:
            if self.seen[node]:
                said.setdefault(node, []).append(t)
        out: dict[int, set[int]] = {}
        for node, parts in said.items():
            for s in _SEGMENT.split(entities.unescape("".join(parts))):
                if s := " ".join(s.split()):
                    out.setdefault(node, set()).add(_signed(xxhash.xxh3_64_intdigest(s)))
        for node, target in self.links:
            if self.seen[node]:
                out.setdefault(node, set()).add(_signed(xxhash.xxh3_64_intdigest(f"\0{target}")))
        return out

    def text(self, judged: dict[int, bool], checked: bool = True) -> str:
        """Blocks of what ``judged`` keeps, in page order, checked by names: the named article stays, named boilerplate goes."""
        if checked:
            keep = [s == 1 or (s == 0 and not rest and judged.get(n, False)) for n, (s, rest) in enumerate(zip(self.states, self.rest))]
        else:
            keep = [judged.get(n, False) for n in range(len(self.tags))]
        blocks = []
        for _, run in itertools.groupby(self.texts, key=lambda x: x[0]):
            kept = [t for _, n, t in run if keep[n]]
            if kept and (b := " ".join(entities.unescape("".join(kept)).split())):
                blocks.append(b)
        return "\n".join(blocks)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def host_of(url: str | None) -> str | None:
    try:
        return urlsplit(url.strip()).hostname if url else None
    except ValueError:
        return None


def judge(page: Page, importance: dict[int, tuple[float, float, int]], least: float, damping: float) -> dict[int, bool]:
    """By node of the tree whether its own text stays, named or not.

    ``importance`` has (presentation, content, styles) by tree node; what it lacks is fully important.  A
    branch's importance is its node's presentation importance, of weight 1 - damping^styles, and the mean of
    its parts' importance below it.  A branch goes if it and all its parts lie below ``least``; elsewhere a
    text goes if its own content does.
    """
    own = {n for _, n, t in page.texts if page.seen[n] and not t.isspace()}
    score, noisy = [0.0] * len(page.tags), [True] * len(page.tags)
    told = [False] * len(page.tags)  # whether a branch has any text
    for i in range(len(page.tags) - 1, -1, -1):
        if not page.seen[i]:
            continue
        look, content, styles = importance.get(page.ids[i], (1.0, 1.0, 1))
        below = [c for c in page.children[i] if told[c]]
        parts = [score[c] for c in below] + ([content] if i in own else [])
        told[i] = bool(parts)
        if not below:
            score[i] = content
        elif parts:
            weight = damping**styles
            score[i] = (1 - weight) * look + weight * sum(parts) / len(parts)
        noisy[i] = score[i] < least and all(noisy[c] for c in below) and not (i in own and content >= least)
    gone = [False] * len(page.tags)
    out = {}
    for i in range(len(page.tags)):
        if page.seen[i]:
            gone[i] = noisy[i] or (i > 0 and gone[page.parents[i]])
            out[i] = not gone[i] and importance.get(page.ids[i], (1.0, 1.0, 1))[1] >= least
    return out


def _counted(pages: DataFrame, chars: int, by_name: bool) -> DataFrame:
    """Stored rows (unit, node, look, part, values, counts): what the unit's pages have of a node's styles (``look``) or features, by ``part``."""
    names = ["unit", "node", "look", "part", "values", "counts"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def packed(unit: int | None, counts: dict):
        rows = []
        for (node, look), of in counts.items():
            parts: dict[int, list] = {}
            for value in of:
                parts.setdefault(value % PARTS, []).append(value)
            rows += [(unit, node, look, k, values, [of[v] for v in values]) for k, values in parts.items()]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000]), types)], names)

    def count(batches):
        unit, read, counts = None, 0, {}
        for batch in batches:
            for name, url, source in zip(*(batch.column(c).to_pylist() for c in ("unit", "url", "html"))):
                if name != unit or read >= chars:
                    yield from packed(unit, counts)
                    unit, read, counts = name, 0, {}
                read += len(source or "")
                if host := host_of(url):
                    page = Page(source or "", by_name)
                    page.tree(host)
                    for i, on in enumerate(page.seen):
                        if on:
                            counts.setdefault((page.ids[i], True), Counter())[page.styles[i]] += 1
                    for i, said in page.features().items():
                        counts.setdefault((page.ids[i], False), Counter()).update(said)
        yield from packed(unit, counts)

    return materialize(pages.mapInArrow(count, "unit long, node long, look boolean, part int, values array<long>, counts array<int>"), "counted")


def style_tree(counted: DataFrame) -> DataFrame:
    """node, look, content, styles of the nodes that two pages or more have, of rows (node, look, value, n); ``part`` may follow, which the value fixes.

    ``look`` is the entropy of the node's styles to the base of its pages, ``content`` one less the mean entropy of
    what is said there; n pages with a feature make its entropy log n.
    """
    summed = counted.groupBy("node", *[c for c in ("part",) if c in counted.columns], "look", "value").agg(F.sum("n").alias("n"))
    when = lambda c, x: F.sum(F.when(c, x).otherwise(0.0))
    by_node = summed.groupBy("node").agg(
        F.sum(F.when(F.col("look"), F.col("n")).otherwise(0)).alias("pages"), F.count_if("look").alias("styles"), when(F.col("look"), F.col("n") * F.log("n")).alias("looks"),
        F.count_if(~F.col("look")).alias("features"), when(~F.col("look"), F.log("n")).alias("said"),
    )
    base = F.log("pages")
    content = F.when(F.col("features") > 0, 1 - F.col("said") / (F.col("features") * base)).otherwise(0.0)
    return by_node.where("pages > 1").select("node", F.round(1 - F.col("looks") / (F.col("pages") * base), 9).alias("look"), F.round(content, 9).alias("content"), "styles")


def _importance(folder: str, unit: int) -> dict[int, tuple[float, float, int]]:
    """(presentation, content, styles) by node of a unit's pages, of the nodes that other pages have too."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    there, path = fs.FileSystem.from_uri(folder)
    if there.get_file_info(path).type != fs.FileType.Directory:
        raise RuntimeError(f"the site style tree is gone: {folder}")
    known = {}
    for f in there.get_file_info(fs.FileSelector(f"{path}/unit={unit}", allow_not_found=True)):
        if f.path.endswith(".parquet"):
            with there.open_input_file(f.path) as source:
                t = pq.read_table(source)
            known.update(zip(t.column("node").to_pylist(), zip(*(t.column(c).to_pylist() for c in ("look", "content", "styles")))))
    return known


def _give_back(counted: DataFrame, units: int) -> str:
    """The folder where each unit has its own nodes' importance, each once."""
    dealt = counted.repartition("node", "part").select("node", "part", "look", F.explode(F.arrays_zip("values", "counts")).alias("v"))
    tree = style_tree(dealt.select("node", "part", "look", F.col("v.values").alias("value"), F.col("v.counts").alias("n")))
    own = counted.where("look").select("unit", "node").repartition("node").distinct()
    folder = new_folder(counted.sparkSession, "importance")
    own.join(tree, "node").repartition(min(units, 10_000), "unit").write.partitionBy("unit").mode("overwrite").parquet(folder)
    return folder


def main_text(pages: DataFrame, least: float = 0.3, damping: float = 0.9, chars: int = 4_000_000, by_name: bool = True, stored: bool = False, tree_chars: bool = False) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html).

    The site style tree of a page's host judges every text of the page (``judge``).  A check by names
    follows: elements that are never text, and branches that their tag, role, class or id calls boilerplate, go; the
    article that a page names stays whole but for such branches in it, and beside it only first-level headings
    may stay.  On everything else the tree's word is the last; without ``by_name`` it is on
    all but elements that are never text.  ``tree_chars`` adds a column of that name: code points of what the tree keeps before
    the check.  Character
    references are decoded, white space inside a block becomes one space, blocks follow in page order, one a
    line.  A branch that only one page has is important, so a host's only page loses nothing by the tree; nor does
    a page that it would leave without any text (a copy of another), nor one without a host.  Null and empty html give an empty text; repeated rows are kept and
    count as pages; broken markup is read by the standard's rules for elements that aren't ended; very long pages
    are read whole; other columns are ignored, whatever their names; an empty table gives an empty result.
    ``stored``: the table is read from Parquet files; else it is written first.  Pages are read twice, in units
    of rows by their place in a file, however files are cut for tasks.
    """
    pages = pages if stored else materialize(pages.select("page_id", "url", "html"), "pages")
    n, size = pages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    rows = max(1, n * chars // max(size, chars))  # a unit has about so many characters
    unit = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows)).alias("unit")
    pages = pages.select("page_id", "url", "html", unit)
    counted = _counted(pages, chars, by_name)
    folder = _give_back(counted, -(-n // rows) or 1)
    discard(counted)
    schema = pages.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("tree_chars")).schema

    def finish(batches):
        unit, known = None, {}
        for batch in batches:
            units, urls, htmls = (batch.column(c).to_pylist() for c in ("unit", "url", "html"))
            for a, b in slices(htmls, min(chars, 4_000_000)):
                texts, alone = [], []
                for name, url, source in zip(units[a:b], urls[a:b], htmls[a:b]):
                    page, host = Page(source or "", by_name), host_of(url)
                    if host:
                        if name != unit:
                            unit, known = name, _importance(folder, name)
                        page.tree(host)
                        judged = judge(page, known, least, damping)
                    else:
                        judged = {i: True for i, on in enumerate(page.seen) if on}
                    texts.append(page.text(judged) or page.text(dict.fromkeys(page.open, True)))
                    alone.append(len(page.text(judged, checked=False)) if tree_chars else 0)
                yield pa.RecordBatch.from_arrays([batch.column("page_id")[a:b], batch.column("url")[a:b], pa.array(texts, pa.string()), pa.array(alone, pa.int64())], schema.names)

    out = pages.mapInArrow(finish, schema)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), *["tree_chars"] * tree_chars)


def op11_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), stored=True, tree_chars=True)
