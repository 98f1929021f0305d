"""Main text of HTML pages by site template removal.

Pass 1 hashes every element's subtree in two ways and counts per host on how many pages each
hash stands, once a page.

* Whole: tag, class, text, children. Counted are also the different surroundings (hashes of the
  parent): a template piece recurs within parents that differ from page to page; a paragraph of
  a page that was copied as a whole recurs within equal parents and is not one.
* Shape: tag, class, children, runs of equal children as one, no text. It finds menus, adverts
  and footers whose words change from page to page. Shapes are counted only for what stands
  beside the article (or main element) of a page, as paragraphs have shapes too.

Hashes on at least `least_pages` pages, and at least `share` of the host's pages, are templates
of the host; whole subtrees must have `least_pages` surroundings too.

Pass 2 deletes template subtrees first. What the count cannot know (hosts of few pages, rare
pieces) is then deleted by `rules`: elements whose tag, role, class or id says menu, header,
footer, sidebar, notice, advert, form or comments, and what stands beside the article. A class or
id says so by a word that stands alone or beside words of place (`ad-slot`), not as a part of
another name (`share-price`, `related-work`). Scripts,
styles and comments in the markup always go. Protected from the count are subtrees with half of
the content's text or more, and, where the page says what its article is, single paragraphs,
headings, items and cells of it. What is left is put out in blocks.

Templates are at most `most of a page / share` per host. All of them are broadcast if the
measured total is at most `broadcast_hashes`; above that they are joined to the pages, each
host dealt out over `salts` keys.

Nulls, empties, ties: null HTML is empty and gives an empty text; a null url has the empty
host, which is a host like any other; null and repeated ids are kept; repeated rows count as
pages of their own; an empty table gives no row; broken markup closes as browsers do it (a block
start ends an open paragraph, an end tag ends what is open in it, and what cannot stand in a
head ends an open one).
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import common

# Sets of HTML element names (fixed values of the HTML standard).
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption summary".split())
#: A start of the first ends an open element of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}

GONE_TAGS = frozenset("nav footer aside form button select input dialog menu template object applet svg canvas audio video map head search".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
GONE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs footer comment comments respond reply replies disqus share sharing social related recommended newsletter subscribe subscription widget widgets pagination pager skip masthead".split()
)

#: What may stand beside such a word in a hyphened name: `ad-slot` is an advert, `share-price` is not.
PLACE_WORDS = frozenset("area bar block body bottom box button buttons card col column container content footer form group header icons inline inner item items layer left line link links list main news outer page panel policy post posts right row section signup site slot space top unit wrap wrapper zone".split())

#: What may stand in a head; the start of any other element ends an open one.
HEAD = frozenset("head html base basefont bgsound link meta title style script noscript noframes template".split())

#: With one of these beside it, `header` is the head of the article, not of the page.
HEADED = frozenset("article post entry story content title".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|\Z)", re.I)
_WORD = re.compile(r"[a-z]+")
_NAME = re.compile(r"\S+")
_HOST = re.compile(r"://([^/?#]*)")
_DIGITS = re.compile(rb"[0-9]+")
_LAST: dict[str, re.Pattern] = {}


def says_gone(names: str) -> bool:
    """Is one of the class names (or ids) a word for what goes, alone or with words of place only?"""
    for name in _NAME.findall(names):
        words = _WORD.findall(name)
        if not GONE_WORDS.isdisjoint(words) and all(w in GONE_WORDS or w in PLACE_WORDS or len(w) == 1 for w in words):
            return True
    return False


def host_of(url: str | None) -> str:
    found = _HOST.search(url or "")
    return found[1].lower() if found else ""


#: In place of a parent's hash: the row counts a shape.
_SHAPE = 0


class Page:
    """The elements of a page in document order, its text runs, and its blocks."""

    __slots__ = ("tag", "parent", "gone", "rooted", "size", "hash", "shape", "blocks", "inside", "found")

    def __init__(self, html: str):
        from xxhash import xxh3_64_digest

        self.tag, self.parent, self.gone, self.rooted, self.size, self.hash, self.shape = ["#"], [-1], [False], [False], [0], [b""], [b""]
        self.blocks: list[list[tuple[int, str]]] = []
        parts: list[list[bytes]] = [[b"#"]]  # what goes into the hash of each element
        forms: list[list[bytes]] = [[b"#"]]  # what goes into the hash of its shape
        stack = [0]
        block: list[tuple[int, str]] = []
        at, end = 0, len(html)

        def text(run: str) -> None:
            if run:
                run = unescape(run) if "&" in run else run
                if not run.isspace():
                    end_head()
                block.append((stack[-1], run))
                if plain := " ".join(run.split()):
                    self.size[stack[-1]] += len(plain)
                    parts[stack[-1]].append(plain.encode("utf-8", "surrogatepass"))

        def flush() -> None:
            nonlocal block
            if block:
                self.blocks.append(block)
                block = []

        def close(upto: int) -> None:
            """Close the elements of the stack from place `upto` on."""
            while len(stack) > upto:
                node = stack.pop()
                self.hash[node] = digest = xxh3_64_digest(b"\0".join(parts[node]))
                above = self.parent[node]
                if self.size[node] or len(parts[node]) > 1:
                    parts[above].append(digest)
                    self.shape[node] = shape = xxh3_64_digest(b"\1".join(forms[node]))
                    if forms[above][-1] != shape:
                        forms[above].append(shape)
                self.size[above] += self.size[node]

        def end_head() -> None:
            """Close a head whose end tag is left out, at what cannot stand in it."""
            if self.tag[stack[-1]] == "head":
                flush()
                close(len(stack) - 1)

        while at < end:
            found = _TOKEN.search(html, at)
            if not found:
                text(html[at:])
                break
            text(html[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name = name.lower()
            if found[1] or found[4]:  # an end tag
                if name in BLOCK:
                    flush()
                for i in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[i]]
                    if tag == name:
                        close(i)
                        break
                    if name not in BLOCK and tag in BLOCK:
                        break  # an inline end tag does not end a block
                continue
            attributes = found[3] if found[2] else found[6]
            if name not in HEAD:
                end_head()
            if name in RAW:
                if name not in _LAST:
                    _LAST[name] = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I)
                last = _LAST[name].search(html, at)
                if name == "xmp":  # shown as it stands
                    flush()
                    plain = html[at : last.start() if last else end]
                    if plain.strip():
                        block.append((stack[-1], plain))
                        self.size[stack[-1]] += len(plain)
                        parts[stack[-1]].append(plain.encode("utf-8", "surrogatepass"))
                    flush()
                at = last.end() if last else end
                continue
            inline = name not in BLOCK
            if not inline:
                flush()
                for i in range(len(stack) - 1, 0, -1):  # a block start ends an open paragraph
                    tag = self.tag[stack[i]]
                    if tag == "p":
                        close(i)
                        break
                    if tag in BLOCK:
                        break
            if name in CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[i]]
                    if tag in CLOSES[name]:
                        close(i)
                        break
                    if tag in FENCE[name]:
                        break
            if name in VOID:
                if name == "br":
                    block.append((stack[-1], " "))
                continue
            gone = name in GONE_TAGS or name == "noscript" and not self.rooted[stack[-1]]
            mark = root = ""
            if attributes and not attributes.isspace():
                for attribute in _ATTRIBUTE.finditer(attributes):
                    key = attribute[1].lower()
                    value = (attribute[2] or attribute[3] or attribute[4] or "").lower()
                    if key == "role":
                        gone |= value in GONE_ROLES
                        root = value
                    elif key == "hidden" or key == "aria-hidden":
                        gone |= key == "hidden" or value == "true"
                    else:
                        words = _WORD.findall(value)
                        if name not in ("body", "html", "article", "main") or key == "class" and name == "article":
                            gone |= says_gone(value)
                            gone |= "header" in words and not self.rooted[stack[-1]] and HEADED.isdisjoint(words)
                        mark += f" {value}"
            if inline and not gone:
                continue  # transparent: its text belongs to the block around it
            node = len(self.tag)
            above = stack[-1]
            rooted = name in ("article", "main") or root in ("main", "article")
            self.tag.append(name)
            self.parent.append(above)
            self.gone.append(self.gone[above] or gone or (name == "header" and not self.rooted[above]))
            self.rooted.append(self.rooted[above] or rooted)
            self.size.append(0)
            self.hash.append(b"")
            self.shape.append(b"")
            parts.append([f"{name}{mark}".encode("utf-8", "surrogatepass")])
            forms.append([_DIGITS.sub(b"0", parts[-1][0])])
            stack.append(node)
        flush()
        close(1)
        self.hash[0] = xxh3_64_digest(b"\0".join(parts[0]))
        self.inside, self.found = self._content()

    def _content(self) -> tuple[list[bool], bool]:
        """Which elements are in the main content: the outermost articles that are not gone, else
        main elements, else everything; and whether the page says so."""
        n = len(self.tag)
        for wanted in ("article", "main"):
            inside = [False] * n
            for i in range(1, n):
                inside[i] = inside[self.parent[i]] or (self.tag[i] == wanted and not self.gone[i])
            if any(inside):
                return inside, True
        found = any(self.rooted[i] and not self.gone[i] for i in range(n))
        return (list(self.rooted), True) if found else ([True] * n, False)

    def _beside(self) -> list[bool]:
        """Which elements stand beside the content that the page names: neither in nor around it."""
        out = [self.found and not x for x in self.inside]
        for i in range(len(out) - 1, 0, -1):  # children come after their parents
            if not out[i]:
                out[self.parent[i]] = False
        return out

    def subtrees(self) -> tuple[set[tuple[int, int]], set[int]]:
        """((hash, hash of the parent) of every block element with text, shapes beside the content)."""
        rows = [i for i in range(1, len(self.tag)) if self.size[i]]
        beside = self._beside() if self.found else ()
        return {(_number(self.hash[i]), _number(self.hash[self.parent[i]])) for i in rows}, {_number(self.shape[i]) for i in rows if beside and beside[i]}

    def text(self, templates=(), rules: bool = True) -> str:
        return self.cleaned(templates, rules)[0]

    def cleaned(self, templates=(), rules: bool = True) -> tuple[str, int]:
        """The blocks of the main content, without template subtrees; and how many code points of
        the page's text the count deleted."""
        n, inside, found = len(self.tag), self.inside, self.found
        whole = sum(self.size[i] for i in range(1, n) if inside[i] and not inside[self.parent[i]]) if found else self.size[0]
        beside = self._beside() if templates and found else ()
        out = [False] * n
        counted = 0
        for i in range(1, n) if templates else ():
            out[i] = out[self.parent[i]]
            if out[i] or not self.size[i]:
                continue
            if not (found and inside[i] and self.tag[i] in LEAF) and 2 * self.size[i] < whole:
                out[i] = _number(self.hash[i]) in templates
            if beside and beside[i]:
                out[i] = out[i] or _number(self.shape[i]) in templates
            counted += self.size[i] * out[i]
        blocks = []
        for block in self.blocks:
            words = "".join([run for node, run in block if not out[node] and not (rules and (self.gone[node] or not inside[node]))]).split()
            if words:
                blocks.append(" ".join(words))
        return "\n\n".join(blocks), counted


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "big", signed=True)


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = 10, share: float = 0.1) -> DataFrame:
    """(host, hash): the template subtrees and shapes of each host. Pages are counted, and the
    surroundings of whole subtrees; a batch is counted before it is sent, and shapes have no surroundings."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            seen: Counter = Counter()
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host = host_of(url)
                pieces, shapes = Page(html or "").subtrees()
                seen[(host, None, None)] += 1
                seen.update({(host, own, None) for own, _ in pieces})
                seen.update((host, own, above) for own, above in pieces)
                seen.update((host, own, _SHAPE) for own in shapes)
            host, own, above = zip(*seen) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(own, pa.int64()), pa.array(above, pa.int64()), pa.array(list(seen.values()), pa.int64())], ["host", "hash", "above", "n"])

    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(common.releasing(count), "host string, hash long, above long, n long")
    distinct = rows.groupBy("host", "hash", "above").agg(F.sum("n").alias("n"))
    shape = F.coalesce(F.col("above") == _SHAPE, F.lit(False))
    places = F.count(F.when(~shape, F.col("above")))
    pages_of = F.coalesce(F.sum(F.when(shape, F.col("n"))), F.sum(F.when(F.col("above").isNull(), F.col("n"))))
    by_hash = distinct.groupBy("host", "hash").agg(places.alias("places"), pages_of.alias("pages"), F.max(shape).alias("shape"))
    many = (F.col("pages") >= least_pages) & (F.col("shape") | (F.col("places") >= least_pages))
    by_hash = common.materialise(by_hash.filter(many | F.col("hash").isNull()), "templates")
    hosts = by_hash.filter("hash is null").select(F.col("host").alias("_host"), F.col("pages").alias("_pages"))
    pieces = by_hash.filter("hash is not null")
    return pieces.join(hosts, F.col("host") == F.col("_host")).filter(F.col("pages") >= share * F.col("_pages")).select("host", "hash")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 10, share: float = 0.1, rules: bool = True, broadcast_hashes: int = 500_000, salts: int = 64) -> DataFrame:
    """(id, url, text, n_counted): the main text of every page, and how many code points of the
    page's text the count deleted. Without `rules` only the count deletes."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, url string, text string, n_counted long"
    found = common.materialise(templates(pages, url_col, html_col, least_pages, share), "templates")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    shared = None
    if found.count() <= broadcast_hashes:
        by_host = found.groupBy("host").agg(F.collect_list("hash").alias("hashes")).toArrow()
        shared = spark.sparkContext.broadcast({h: frozenset(x) for h, x in zip(by_host.column(0).to_pylist(), by_host.column(1).to_pylist())})
    else:
        host = F.coalesce(F.lower(F.regexp_extract("url", r"(?s)://([^/?#]*)", 1)), F.lit(""))
        dealt = rows.withColumns({"host": host, "salt": F.pmod(F.xxhash64("id", "url"), F.lit(salts))})
        per_host = found.groupBy("host").agg(F.collect_list("hash").alias("hashes")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        rows = dealt.join(per_host, ["host", "salt"], "left").select("id", "url", "html", "hashes")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            urls, pages_ = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            own = [shared.value.get(host_of(u), frozenset()) for u in urls] if shared else [frozenset(x or ()) for x in batch.column(3).to_pylist()]
            texts, counted = zip(*[Page(h or "").cleaned(t, rules) for h, t in zip(pages_, own)]) if own else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counted, pa.int64())], ["id", "url", "text", "n_counted"])

    return rows.mapInArrow(common.releasing(run), schema)
