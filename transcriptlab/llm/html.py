"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass classifies each block by itself, from the
share of its words that are stop words, its length and the share of its characters in links: good, bad, near good or
short.  The second pass gives near-good and short blocks the label of the nearest decided
neighbours.  Headings go with what follows them, and a short paragraph with the good one beside it in the same element.
Where no block of a page shows the stop words of a known language, length and links alone decide.

Marks of the page are evidence beside the rules.  Elements that never hold the article (navigation, page headers and footers,
asides, forms, scripts, styles, hidden ones, reader comments), and elements whose class, id or role plainly names an advert, a notice,
a menu or a sidebar, make their blocks bad.  Names that may as well be those of a layout (``has-sidebar``, ``side-by-side``) do so only
if the text outside of such elements is longer than that within.  A main element starts anew within both, an article
within the latter; within the former it is read only if the page has no other text.
Within it few stop words or many links leave a paragraph undecided, and the
element's edges count as good neighbours, so that headings and short paragraphs stay with it; a long text of sentences there outweighs
any name but an advert's.  An inline element that is noisier than the paragraph around it is left out, and the paragraph goes on behind it.
A page of nothing but short blocks is read whole, but for its links and noise.

Cases: null and empty html give an empty text; text without markup is one block and is judged like others;
very long pages are read whole, in a time that grows with their length; open tags, stray end tags, cut entities and unknown tags are
taken as browsers take them; repeated rows are extracted each; an empty table gives an empty result; extra columns pass through, and the
new one replaces a column of its name.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Frequent words of four languages.
STOP_WORDS = frozenset(
    """
    the of and to in is that it was for on are as with his they be at one have this from or had by but not what all were we when your
    can said there an each which she do how their if will a he you i has been who its more than so no out up about them then these some
    der die und das von zu den mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am
    sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde ich
    le la les de des du un une et est en que qui dans pour pas sur plus par ce il au avec se ne son sont je vous nous mais ou cette aux été elle
    comme tout leur même ces d l
    el los las del y a es por con para su al lo como más o pero sus ha me si porque esta son entre está cuando muy sin sobre ser también
    hasta hay donde quien desde todo nos
    """.split()
)
# Elements by what they are to a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("nav footer aside form head title noscript button select datalist dialog menu iframe object".split())
RAW = frozenset("script style textarea template svg xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first closes an open element of the second.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = BLOCKS - {"body", "head", "html", "li", "td", "tr", "th"}
PARAGRAPHS = frozenset("p blockquote figcaption dd td h1 h2 h3 h4 h5 h6 pre".split())
PARTS = frozenset("li td th dd dt figcaption caption pre blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class names, ids and their compounds.
COMMENTS = frozenset("comment comments commentlist commenters respond replies disqus".split())
PLAIN = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors cookie cookies consent gdpr newsletter subscribe subscription nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer foot copyright popup modal".split())
DOUBTFUL = frozenset("side sidebar sidebars aside header masthead share sharing social related recommended recommendations widget widgets notice notices alert alerts banner banners promo promos promotion login signup toolbar skip toc disclaimer overlay form search".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors".split())
#: Words beside a plain one that leave its meaning; others, as in ad-hoc or copyright-law, may give it another.
BESIDE = frozenset("site slot unit box block bar top bottom item items list link links text inner outer area zone section google primary secondary global mobile desktop sticky fixed global inline center middle small large big new old bg id first last".split())
LAYOUT = frozenset("has with no without layout by wrapper wrap container page body main content left right results grid column columns single full".split())
HEADLINES = frozenset("entry article post story section headline".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORD = re.compile(r"\w+")
SPACE = re.compile(r"\s+")

SHORT, LONG = 70, 200
LOW, HIGH = 0.20, 0.32
LINKS = 0.33


#: A name of a layout; a plain name; that of an advert; what an article doesn't undo.
CLEAN, SOFT, HARD, ADVERT, NEVERMORE = range(5)


@dataclass(slots=True)
class Block:
    #: Of the element it stands in: how noisy, the number of its article, its tag, and the numbers of the elements around it, innermost first.
    noise: int
    where: int
    tag: str
    around: tuple[int, ...] = ()
    #: How noisy the article itself is that it stands in.
    base: int = CLEAN
    parts: list[str] = field(default_factory=list)
    links: int = 0

    @property
    def group(self) -> int:
        return self.around[0] if self.around else 0

    def text(self) -> str:
        return SPACE.sub(" ", entities.unescape("".join(self.parts))).strip()


def named(value: str) -> int:
    """How noisy the words of a class or id are."""
    worst = CLEAN
    for token in value.split():
        words = set(re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower().replace("_", "-").split("-"))
        if words & COMMENTS:
            level = SOFT if words & {"no", "without", "has", "with"} else NEVERMORE
        elif words & PLAIN:
            other = {w for w in words - PLAIN - DOUBTFUL - LAYOUT - BESIDE if w and not w.isdigit()}
            level = SOFT if other or words & {"no", "without", "has", "with"} else ADVERT if words & ADVERTS else HARD
        elif words & DOUBTFUL:
            level = CLEAN if "header" in words and words & HEADLINES else SOFT if words & LAYOUT else HARD
        else:
            level = CLEAN
        worst = max(worst, level)
    return worst


def noisy(tag: str, attributes: str, inside: bool) -> int:
    """How surely an element doesn't hold the article."""
    if tag in NEVER or (tag == "header" and not inside):
        return NEVERMORE
    if not attributes or tag in ("html", "body", "main"):
        return CLEAN
    worst = CLEAN
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            level = named(value)
            # an article may be called anything but a comment
            worst = max(worst, level if tag != "article" or level == NEVERMORE else CLEAN)
        elif name == "role" and value.lower() in NOISE_ROLES:
            worst = max(worst, HARD)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return NEVERMORE
    return worst


class Reader:
    """Reads a page into blocks.  Open elements are found by tag without a search through the stack."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack: list[tuple[str, int, int, int]] = []  # tag, noise, article, number
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.blocks: list[int] = []  # places of block-level elements
        self.articles = self.count = 0
        #: Blocks that go on behind an inline element that is noisier than they are, with its place in the stack.
        self.paused: list[tuple[int, Block]] = []
        self.bases: dict[int, int] = {}  # noise of articles by number
        self.now = Block(CLEAN, 0, "")

    def block(self) -> Block:
        """An empty block of the innermost open element."""
        _, noise, where, _ = self.stack[-1] if self.stack else ("", CLEAN, 0, 0)
        tag = self.stack[self.blocks[-1]][0] if self.blocks else ""
        return Block(noise, where, tag, tuple(self.stack[b][3] for b in self.blocks[-2:-7:-1]), self.bases.get(where, CLEAN))

    def cut(self) -> None:
        self.out += [b for b in (*(b for _, b in self.paused), self.now) if b.parts]
        self.paused.clear()
        self.now = self.block()

    def close(self, upto: int) -> None:
        """Close elements; behind a noisier inline one the block around it goes on, or a new one begins if the element held blocks."""
        inner = False
        while len(self.stack) > upto:
            tag, noise, _, _ = self.stack.pop()
            self.open[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            elif self.paused and self.paused[-1][0] == len(self.stack):
                if self.now.parts:
                    self.out.append(self.now)
                self.now = self.paused.pop()[1]
            else:
                inner = inner or noise > (self.stack[-1][1] if self.stack else CLEAN)
        if inner:
            self.cut()

    def start(self, tag: str, attributes: str) -> None:
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        if ends and self.blocks and self.stack[self.blocks[-1]][0] in ends:
            self.close(self.blocks[-1])
        _, noise, where, _ = self.stack[-1] if self.stack else ("", CLEAN, 0, 0)
        before = noise
        if tag in ("article", "main") or (tag == "div" and re.search(r"\brole\s*=\s*[\"']?main\b", attributes, re.I)):
            if not where:
                self.articles += 1
                where = self.articles
            if noise < NEVERMORE:
                noise = CLEAN if noise == SOFT or tag != "article" else noise
        noise = max(noise, noisy(tag, attributes, bool(where)))
        self.bases.setdefault(where, noise)
        self.count += 1
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, noise, where, self.count))
        if tag in BLOCKS:
            self.cut()
        elif noise != before:
            self.paused.append((len(self.stack) - 1, self.now))
            self.now = self.block()

    def end(self, tag: str) -> None:
        if self.open.get(tag):
            self.close(self.open[tag][-1])
            if tag in BLOCKS:
                self.cut()
        elif tag == "p":
            self.cut()

    def text(self, text: str) -> None:
        if self.now.parts or text.strip():
            self.now.parts.append(text)
            if self.open.get("a"):
                self.now.links += len(text.strip())


def blocks(page: str) -> list[Block]:
    """The page's blocks in order."""
    reader, at, end = Reader(), 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        if m[2] is None:
            if m[0][0] != "<" or m[0] == "<":
                reader.text(m[0])
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in RAW and not closing:
            if not m[3].rstrip().endswith("/") or tag in ("script", "style", "textarea"):
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
            reader.now.parts.append(" ")
        elif tag in VOID:
            if tag == "hr":
                reader.cut()
            elif tag == "br":
                reader.now.parts.append(" ")
        elif closing:
            reader.end(tag)
        else:
            reader.start(tag, m[3])
    reader.cut()
    return reader.out


def stop_share(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def first_pass(block: Block, text: str, share: float, known: bool = True) -> str:
    """The label of a block by itself; known: whether the page is in a language whose stop words are."""
    if block.links / max(len(text), 1) > LINKS and not (block.where and len(text) >= SHORT):
        return "short" if block.where and block.tag in PARAGRAPHS else "bad"
    if len(text) < SHORT:
        return "short"
    if share >= HIGH or not known:
        return "good" if len(text) >= LONG else "near"
    return "near" if share >= LOW or block.where else "bad"


def outweighs(block: Block, text: str, share: float) -> bool:
    """Whether a long text of sentences within a plain article is read whatever its element is called, but for the name of an advert."""
    return bool(block.where) and block.base < SOFT and block.noise <= HARD and len(text) >= LONG and share >= HIGH and block.links <= 0.1 * len(text)


def nearest(found: list[Block], labels: list[str], order: range) -> list[tuple[bool, int]]:
    """For each block, whether the nearest decided block before it in this order is good, and its element's parent.

    The edge of an article counts as good, that of the page or of what lies between articles as bad; noise within an article
    doesn't part its blocks.
    """
    good, group, where, out = False, -1, 0, [(False, -1)] * len(found)
    for i in order:
        if found[i].where != where:
            where = found[i].where
            good, group = bool(where), -1
        out[i] = (good, group)
        if labels[i] in ("good", "bad") and not (where and labels[i] == "bad" and found[i].noise):
            good, group = labels[i] == "good", found[i].group
    return out


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is good; those that the first pass left open inherit from their neighbours."""
    n = len(found)
    before, after = nearest(found, labels, range(n)), nearest(found, labels, range(n - 1, -1, -1))
    alone = "good" not in labels  # then near-good blocks are the text
    out = []
    for i, (block, label) in enumerate(zip(found, labels, strict=True)):
        (over, over_group), (under, under_group) = before[i], after[i]
        if label == "near":
            label = "good" if over or under or alone else "bad"
        elif label == "short":
            # a paragraph beside a good one in the same element, a part of a list or table beside one, and a heading over what is good
            near = (over_group,) * over + (under_group,) * under
            beside = (block.tag == "p" and block.group in near) or (block.tag in PARTS and any(g in block.around for g in near))
            heads = block.tag in HEADINGS and under
            # the headline that stands over an article without one of its own
            title = block.tag == "h1" and not block.where and i + 1 < n and found[i + 1].where and found[i + 1].tag not in HEADINGS and not found[i + 1].noise
            label = "good" if (over and under) or beside or heads or title else "bad"
        out.append(label == "good")
    return out


def kept(found: list[Block], texts: list[str], noise: int, short: bool = False) -> list[bool]:
    """Whether each block is good, if blocks of this noise or more are bad; short: whether short ones are, whatever stands beside them."""
    shares = [stop_share(t) for t in texts]
    known = any(s >= LOW for b, t, s in zip(found, texts, shares, strict=True) if b.noise < noise and len(t) >= SHORT)
    labels = ["bad" if b.noise >= noise and not outweighs(b, t, s) else first_pass(b, t, s, known) for b, t, s in zip(found, texts, shares, strict=True)]
    return [label == "short" for label in labels] if short else second_pass(found, labels)


def main_text(page: str) -> str:
    found = blocks(page)
    texts = [b.text() for b in found]
    some = [i for i, t in enumerate(texts) if t]
    found, texts = [found[i] for i in some], [texts[i] for i in some]
    good = kept(found, texts, SOFT)
    if any(b.noise == SOFT for b in found):
        # names of a layout: the longer text is the article
        wide = kept(found, texts, HARD)
        inner = sum(len(t) for t, b, w in zip(texts, found, wide, strict=True) if w and b.noise == SOFT)
        if inner > sum(len(t) for t, g in zip(texts, good, strict=True) if g):
            good = wide
    if not any(good):  # an article within a plainly named element, where there is no other text
        good = [g and b.where > 0 for g, b in zip(kept(found, texts, NEVERMORE), found, strict=True)]
    if not any(good):  # a page of nothing but short blocks
        good = kept(found, texts, SOFT, short=True)
    return "\n".join(t for t, g in zip(texts, good, strict=True) if g)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of each."""

    @F.arrow_udf("string")
    def extracted(column: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in column], pa.string())

    return pages.withColumn(text, extracted(F.coalesce(F.col(html), F.lit(""))))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
