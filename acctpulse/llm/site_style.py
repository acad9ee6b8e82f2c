"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: elements at the same place with the same tag and style (class and id) are
one node. A node is judged by what its pages do at this place:

* presentation: the entropy of the child sequences seen there (many layouts: important; always the same: not);
* content: one minus the entropy of its text blocks over pages (text that differs from page to page: important; text
  that many pages repeat: not).

The composite importance of a branch is its own presentation and the importance of all text below it, by characters,
times a prior: what an element declares to be (by its tag or role, by words of its class or id, or by standing outside the page's
article) lowers its importance, but nothing is removed by a declaration as such. Words, forms and standing outside are not
believed of a branch that holds most of the text of its pages. All comes from counts of (host, node, value) and the
ancestors of each node, so no host's tree is ever held in one task: the counts are pre-aggregated where the pages lie.
Branches of low importance are removed from every page of the host; where only the text directly in a node is unimportant,
that text alone is removed. A page without a host is a site of its own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.session import staged

# Elements of HTML by what they are, and words by which pages name furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg canvas object textarea title xmp noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo mrow msub msup msqrt mfrac mtext semantics annotation".split()
)
NOISE_TAGS = set("nav footer aside head button select option menu dialog fieldset".split()) | RAW
NOISE_ROLES = set("navigation contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
NOISE_WORDS = set(
    "ad ads advert advertisement adverts adsense adbox sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "footer sidebar widget cookie cookies consent gdpr notice popup modal newsletter subscribe signup login share sharing "
    "social related recommended pagination pager toolbar skip".split()
)
#: Words for what readers write, which may be longer than the article.
READER_WORDS = set("comment comments commentlist disqus respond reply replies".split())
#: Declares furniture only outside an article, whose own header holds its title.
OUTER_WORDS = {"header", "masthead", "banner", "topbar"}
CONTENT_TAGS = {"article", "main"}
WHOLE_TAGS = CONTENT_TAGS | {"html", "body"}
#: What an element declares: by tag or role; by words or as a form; as readers' text; standing outside the article; or below any
#: of the first three.
HARD, SOFT, READER, OUTSIDE, BELOW = 1, 2, 4, 8, 16
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol table tr dl select body article main section div td th".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|/|=|$)", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")

MIN_PAGES, LOW, MOST_SHARE, LEFT_SHARE = 2, 0.2, 0.3, 0.1
#: Priors of declared elements, and the shares of a page's text up to which they are believed: words, forms and the outside; and
#: readers' text, or words outside the article.
#: All are below ``LOW``, so a declaration that is believed outweighs any entropy.
PRIOR_HARD, PRIOR_SOFT = 0.1, 0.15
HALF, FIRM_MOST, ARTICLE_SHARE = 0.5, 0.9, 0.25
#: Pages of one host that share a task.
TASK_PAGES = 2000
GAMMA = 0.9
_WITH_ARTICLE = 0x5BD1E9955BD1E995


class Page:
    """Element nodes in order (``parents``, ``keys``, ``flags``, ``inside`` an article) and text ``blocks``.

    A block is its container and the segments ``(node, raw text)`` in it; segments of other nodes than the container are those
    of inline elements that declare something. Declared furniture by tag or role is one node with all its text.
    """

    def __init__(self, text: str | None):
        self.parents, self.keys, self.flags, self.inside, self.styles = [-1], [0], [0], [False], [0]
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []
        # Tag, node, and what happens below: 0 nodes as usual, 1 all text belongs to the node, 2 no text.
        self.open: list[tuple[str, int, int]] = [("", 0, 0)]
        self.buffer: list[tuple[int, str]] = []
        self._parse(text or "")
        sizes = [(node, len(words), flags) for node, words, flags in self._own_texts()]
        self.chars = sum(n for _, n, flags in sizes if not flags & HARD)
        articles = sum(n for node, n, flags in sizes if self.inside[node] and not flags & BELOW)
        # Pages of whose undeclared text a good part is an article are a tree beside the others of a host.
        self.has_article = articles > 0 and articles >= ARTICLE_SHARE * sum(n for _, n, flags in sizes if not flags & BELOW)
        self.mix = _WITH_ARTICLE if self.has_article else 0

    def _flush(self, node: int) -> None:
        if self.buffer:
            self.blocks.append((node, self.buffer))
            self.buffer = []

    def _own_texts(self) -> Iterator[tuple[int, str, int]]:
        """``(node, text, flags)`` of what each block holds of each node."""
        for container, segments in self.blocks:
            nodes = {container} if len(segments) == 1 and segments[0][0] == container else dict.fromkeys(n for n, _ in segments)
            for node in nodes:
                words = _shown(raw for n, raw in segments if n == node)
                if words:
                    yield node, words, self.flags[node]

    def _parse(self, text: str) -> None:
        at, end = 0, len(text)
        while at < end:
            found = _TOKEN.search(text, at)
            stop = found.start() if found else end
            if stop > at and self.open[-1][2] < 2:
                self.buffer.append((self.open[-1][1], text[at:stop]))
            if not found:
                break
            at = found.end()
            closing, tag, rest = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not tag:
                continue  # a comment or declaration
            tag = tag.lower()
            if closing:
                self._close(tag)
                continue
            self._start(tag, rest)
            if tag in RAW and not rest.endswith("/"):
                last = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)", re.I).search(text, at)
                at = last.start() if last else end
        self._flush(self.open[-1][1])

    def _pop(self) -> None:
        tag, node, _ = self.open.pop()
        if tag not in INLINE:
            self._flush(node)

    def _close(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self._pop()
                return
            if tag in INLINE and self.open[k][0] not in INLINE:
                return

    def _start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.buffer.append((self.open[-1][1], " "))
            return
        if tag in CLOSES_P and any(t == "p" for t, _, _ in self.open[-8:]):
            self._close_within("p", {"p"})
        if tag in SIBLINGS:
            self._close_within(tag, SIBLINGS[tag])
        parent, mode = self.open[-1][1], self.open[-1][2]
        if tag in VOID and (mode or tag in INLINE):
            return
        own = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(rest)} if "=" in rest else {}
        hidden = bool(rest) and bool(_HIDDEN.search(_VALUE.sub("", rest)) or _UNSEEN.search(own.get("style", "")))
        if mode or hidden or tag in RAW:  # no nodes of its own
            if tag not in INLINE:
                self._flush(parent)
            if not rest.endswith("/") or tag not in RAW:
                self.open.append((tag, parent, 2 if hidden or tag in RAW else mode))
            return
        inside = self.inside[parent]
        words = set(_WORD.findall(f"{own.get('class', '')} {own.get('id', '')}".lower()))
        role = own.get("role", "").lower()
        flags = 0
        if tag in NOISE_TAGS or role in NOISE_ROLES or own.get("aria-hidden", "").lower() == "true" or (not inside and tag == "header"):
            flags |= HARD
        if tag == "form" or role == "form" or tag not in WHOLE_TAGS and (words & NOISE_WORDS or (not inside and words & OUTER_WORDS)):
            flags |= SOFT
        if tag not in WHOLE_TAGS and words & READER_WORDS:
            flags |= READER
        if tag in INLINE and not flags:
            self.open.append((tag, parent, 0))
            return
        if tag not in INLINE:
            self._flush(parent)
        label = f"{tag} {own.get('class', '')} {re.sub('[0-9]+', '0', own.get('id', ''))} {role}"
        style = xxhash.xxh64_intdigest(label.encode("utf-8", "replace"))
        self.styles[parent] = xxhash.xxh64_intdigest(b"%d %d" % (self.styles[parent], style))
        if tag in VOID:
            return
        below = BELOW if flags or self.flags[parent] & BELOW else 0
        self.parents.append(parent)
        self.keys.append(xxhash.xxh64_intdigest(b"%d %d" % (self.keys[parent], style)))
        self.flags.append(flags | below)
        self.inside.append(inside or (tag in CONTENT_TAGS and not below))
        self.styles.append(0)
        self.open.append((tag, len(self.parents) - 1, 1 if flags & HARD else 0))

    def _close_within(self, tag: str, tags: set[str]) -> None:
        """Close an element that the start of ``tag`` ends, unless a list, table or section lies between."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k][0] in SCOPES and self.open[k][0] != tag:
                return

    def main_text(self, low: Container[int] = (), own: Container[int] = ()) -> list[str]:
        """The blocks left without the branches ``low`` and without text directly in the nodes ``own``."""
        gone = [False] * len(self.parents)
        for node in range(len(gone)):
            gone[node] = (node > 0 and gone[self.parents[node]]) or self.keys[node] ^ self.mix in low
        silent = [gone[node] or self.keys[node] ^ self.mix in own for node in range(len(gone))]
        shown = (_shown(raw for node, raw in segments if not silent[node]) for _, segments in self.blocks)
        return [text for text in shown if text]

    def counts(self) -> Iterator[tuple[int, int, int, int]]:
        """``(node, kind, value, chars)``: child sequences (kind 0), text blocks (1), ancestors of nodes with text (2), and once
        per node and page what it declares and the characters of the page (3)."""
        for node in range(len(self.keys)):
            yield self.keys[node] ^ self.mix, 0, self.styles[node], 0
        with_text = {}
        for node, text, _ in self._own_texts():
            yield self.keys[node] ^ self.mix, 1, xxhash.xxh64_intdigest(text.encode("utf-8", "replace")), len(text)
            with_text[node] = True
        for node in with_text:
            above = self.parents[node]
            while above >= 0:
                yield self.keys[node] ^ self.mix, 2, self.keys[above] ^ self.mix, 0
                above = self.parents[above]
        for node, flags in enumerate(self.flags):
            outside = OUTSIDE if self.has_article and not self.inside[node] else 0
            yield self.keys[node] ^ self.mix, 3, flags | outside, self.chars


def _shown(parts: Iterable[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def host_of(url) -> F.Column:
    """Lower-case host of an address; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _sites(pages: DataFrame) -> DataFrame:
    """``site, page_id, url, html``: the host, or the page itself where it has none."""
    alone = F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), F.xxhash64("url", "html").cast("string"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.select(F.coalesce(host_of(F.col("url")), alone).alias("site"), "page_id", "url", "html")


def low_importance(
    sites: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW, most_share: float = MOST_SHARE, left_share: float = LEFT_SHARE
) -> DataFrame:
    """``(site, node, own)``: the branches of low importance, and (``own``) other nodes whose text directly in them is.

    A node's entropies count once it is on ``min_pages`` pages of the site; before that its text is important. Its importance
    is the weighted mean of presentation and content importance, where many different child sequences give presentation more
    weight. The composite importance of a branch has the importance of all text in it, by characters, in place of the
    node's own content, times the prior of what it declares. Without a declaration, what holds more than ``most_share`` of the
    site's text is taken for the article itself and stays, unless ``left_share`` of that text or more is important by itself and
    outside: then the articles are elsewhere.
    """
    kind = "site string, node bigint, kind int, value bigint, chars bigint"
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, above = [], set()
            for site, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen = {}
                for node, what, value, chars in Page(text.as_py()).counts():
                    if what == 2:
                        above.add((site, node, value))
                    else:  # once per page; the characters of equal blocks add up
                        seen[node, what, value] = chars + (seen.get((node, what, value), 0) if what == 1 else 0)
                rows += [(site, signed(n), w, signed(v), c) for (n, w, v), c in seen.items()]
            rows += [(site, signed(n), 2, signed(a), 0) for site, n, a in above]
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["site", "node", "kind", "value", "chars"])

    values = sites.select("site", "html").mapInArrow(run, kind)
    values = values.groupBy("site", "node", "kind", "value").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    n, of = F.col("n").cast("double"), lambda k, x: F.coalesce(F.sum(F.when(F.col("kind") == k, x)), F.lit(0))
    nodes = values.groupBy("site", "node").agg(
        of(0, n).alias("pages"),
        F.count(F.when(F.col("kind") == 0, 1)).alias("layouts"),
        of(0, n * F.log(n)).alias("layout_sum"),
        of(1, n).alias("blocks"),
        of(1, n * F.log(n)).alias("block_sum"),
        of(1, F.col("chars")).alias("chars"),
        F.collect_set(F.when(F.col("kind") == 2, F.col("value"))).alias("above"),
        F.coalesce(F.max(F.when(F.col("kind") == 3, F.col("value"))), F.lit(0)).alias("flags"),
        of(3, F.col("chars")).alias("page_chars"),
    )
    nodes = staged(nodes, "nodes")
    # A page counts once per child sequence; nodes repeated in a page with several sequences make "pages" an upper bound.
    spread = F.log(F.greatest(F.col("pages"), F.lit(2.0)))
    presentation = (F.log(F.col("pages")) - F.col("layout_sum") / F.col("pages")) / spread
    content = 1 - F.col("block_sum") / (F.greatest(F.col("blocks"), F.lit(1.0)) * spread)
    weight = 1 - F.pow(F.lit(GAMMA), F.col("layouts") - 1)
    importance = weight * presentation + (1 - weight) * content
    known = F.col("pages") >= min_pages
    has = lambda bits: F.col("flags").bitwiseAND(F.lit(bits)) != 0
    nodes = nodes.select(
        "site", "node", "chars", "above", "flags", "page_chars", (F.col("blocks") > 0).alias("texts"), (~has(BELOW | OUTSIDE)).alias("plain"),
        weight.alias("weight"), presentation.alias("presentation"),
        F.when(known, content).otherwise(1.0).alias("content"), F.when(known, importance).otherwise(1.0).alias("importance"),
    )
    unimportant = (F.col("importance") <= low) & (F.col("content") <= low)
    nodes = nodes.withColumn("vital", F.when(F.col("texts") & F.col("plain") & ~unimportant, F.col("chars")).otherwise(0))
    plain_chars = F.when(F.col("plain"), F.col("chars")).otherwise(0)
    all_chars = nodes.groupBy("site").agg(F.sum(plain_chars).alias("site_chars"), F.sum("vital").alias("site_vital"))
    part = ["site", F.explode(F.concat("above", F.array("node"))).alias("node"), "chars", "content", "importance", "vital", plain_chars.alias("plain_chars")]

    def mean(column: str) -> F.Column:
        """By characters of plain text, or of all text in a branch that has no plain text."""
        over = lambda c: F.try_divide(F.sum(F.col(column) * F.col(c)), F.sum(c))
        return F.coalesce(over("plain_chars"), over("chars"))

    branches = nodes.filter("texts").select(*part).groupBy("site", "node").agg(
        F.sum("chars").alias("all_chars"), F.sum("plain_chars").alias("branch_chars"), F.sum("vital").alias("branch_vital"),
        mean("content").alias("branch_content"), mean("importance").alias("branch_importance"),
    )
    found = nodes.join(branches, ["site", "node"]).join(all_chars, "site")

    def prior(chars: str) -> F.Column:
        """What a declaration leaves of the importance of ``chars`` characters on the node's pages; 1 without one."""
        share = F.col(chars) / F.greatest("page_chars", F.lit(1))
        firm = has(READER) | (has(SOFT) & has(OUTSIDE))
        soft = (firm & (share <= FIRM_MOST)) | (has(SOFT | OUTSIDE) & (share <= HALF))
        return F.when(has(HARD), PRIOR_HARD).when(soft, PRIOR_SOFT).otherwise(1.0)

    composite = F.col("weight") * F.col("presentation") + (1 - F.col("weight")) * F.col("branch_importance")
    most, left = most_share * F.col("site_chars"), left_share * F.col("site_chars")
    may_go = lambda chars, vital: (chars <= most) | (F.col("site_vital") - vital >= left)
    repeated = (composite <= low) & (F.col("branch_content") <= low) & may_go(F.col("branch_chars"), F.col("branch_vital"))
    branch = ((prior("all_chars") < 1) & (prior("all_chars") * composite <= low)) | repeated
    alone = F.col("texts") & (((prior("chars") < 1) & (prior("chars") * F.col("importance") <= low)) | (unimportant & may_go(F.col("chars"), F.col("vital"))))
    noisy = found.select("site", "node", branch.alias("branch"), alone.alias("alone")).filter("branch OR alone")
    return noisy.select("site", "node", (~F.col("branch")).alias("own"))


def main_texts(pages: DataFrame, task_pages: int = TASK_PAGES, **options) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page, blocks joined by an empty line.

    Character references are decoded and white space inside a block becomes one space. A null or empty page, or one without
    text, gives an empty text. Repeated rows are returned each. No rows give no rows. Columns other than ``page_id``, ``url`` and
    ``html`` are not read.

    The unimportant nodes of a site are read once by each task that has pages of it, before the pages; a site with more than
    ``task_pages`` pages is spread over several.
    """
    sites = _sites(pages)
    low = staged(low_importance(sites, **options), "low")
    sizes = sites.groupBy("site").agg(F.count("*").alias("n")).filter(F.col("n") > task_pages)
    large = staged(sizes.select("site", F.ceil(F.col("n") / task_pages).cast("int").alias("salts")), "large")
    salts = F.coalesce("salts", F.lit(1))
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("page_id", "bigint"), ("url", "string"), ("html", "string"))}
    nodes = low.join(large, "site", "left").select(
        "site", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("is_page"), "node", "own", *none.values()
    )
    texts = sites.join(large, "site", "left").select(
        "site", F.pmod(F.xxhash64("page_id", "url", "html"), salts).cast("int").alias("salt"), F.lit(1).alias("is_page"),
        F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("boolean").alias("own"), *none,
    )
    streams = nodes.unionByName(texts).repartition("site", "salt").sortWithinPartitions("site", "salt", "is_page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, low, own = None, set(), set()
        for batch in batches:
            ids, urls, texts = [], [], []
            for site, salt, is_page, node, only, page_id, url, text in zip(*batch.columns):
                if (site.as_py(), salt.as_py()) != now:
                    now, low, own = (site.as_py(), salt.as_py()), set(), set()
                if is_page.as_py():
                    ids.append(page_id.as_py())
                    urls.append(url.as_py())
                    texts.append("\n\n".join(Page(text.as_py()).main_text(low, own)))
                else:
                    (own if only.as_py() else low).add(node.as_py() % (1 << 64))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return streams.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
