"""Main text of HTML pages by two passes over blocks.

The first pass decides blocks by stop-word density, length and link density, or by length and link density alone on pages whose language
has no list of stop words; blocks in menus, headers, footers and other furniture are bad whatever they hold, unless the furniture holds
the page's only article. Short or thin blocks stay open. The second pass gives them the label of the nearest
decided neighbours within the same part of the page (inside or outside of its article).
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, parts

# Names of HTML elements and words that pages use to mark their furniture.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("applet audio canvas datalist head iframe noembed noframes noscript object script style svg template textarea title video".split())
RAW_TAGS = frozenset("iframe noembed noframes noscript script style template textarea title svg".split())
BAD_TAGS = frozenset("aside button dialog fieldset footer form menu nav select".split())
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BAD_NAMES = frozenset("ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs byline comment commentlist comments consent cookie cookies copyright disqus dropdown footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination paywall popup promo promoted recommended related respond search share sharing shoutbox sidebar signup skip skyscraper social sponsor sponsored subscribe subscription tags teaser toolbar toc tooltip tracking widget".split())
STOP_WORDS = frozenset((
    "a about after all also an and any are as at be because been but by can could do for from had has have he her him his how i if in into is it its just like more my no not of on one only or other our out over she so some than that the their them then there these they this to up was we were what when which who will with would you your "
    "ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais me même mes moi mon ne nos notre nous on ou où par pas plus pour qu que qui sa sans se ses son sur ta te tes toi ton tu un une vos votre vous au aux avec "
    "aber alle als am an auch auf aus bei bin bis bist da damit dann das dass dein dem den der des dich die dies doch dort du durch ein eine einem einen einer eines er es für hat hatte ich ihr im in ist ja kann mein mit nach nicht noch nur ob oder ohne sein sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur "
    "al algo como con cual cuando de del desde donde el ella ellos en entre era es esa ese eso esta este esto está fue ha hay la las le les lo los más me mi muy nada ni no nos o os otra otro para pero poco por porque que quien se ser si sin sobre son su sus también te tiene todo tu un una uno y ya yo"
).split())

#: Pieces of a name after which what follows says what a page has, not what the element is; and with which a header is an article's own.
NAME_OF_LAYOUT = frozenset("has have with without no hide show enable enabled disable disabled".split())
NAME_OF_ARTICLE = frozenset("article content entry post story title".split())

OPENS = re.compile(r"</?[a-zA-Z]")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"\w+")
WIDE = re.compile(r"[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")


class Scanner:
    """Cuts a page into text and tags. Its place only moves on: no character is looked at more than a few times, however broken the page is."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.quotes = True

    def __iter__(self) -> Iterator[tuple[str, str]]:
        """("text", characters) or ("tag", the tag with its angles). Comments, declarations and instructions go."""
        page, n = self.page, len(self.page)
        while self.at < n:
            at = self.at
            if page[at] != "<":
                end = page.find("<", at)
                self.at = end if end >= 0 else n
                yield "text", page[at : self.at]
            elif page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                self.at = end + 3 if end >= 0 else n
            elif page[at + 1 : at + 2] in ("!", "?") and at < self.last[">"]:
                self.at = page.find(">", at) + 1
            elif at < self.last[">"] and OPENS.match(page, at):
                self.at = self._end(at)
                yield "tag", page[at : self.at]
            else:  # an angle that opens nothing
                end = page.find("<", at + 1)
                self.at = end if end >= 0 else n
                if page[at + 1 : at + 2] not in ("!", "?"):
                    yield "text", page[at : self.at]

    def _end(self, at: int) -> int:
        """Where the tag at `at` ends. An angle in a quoted value isn't its end; if a quote leaves no end at all, quotes mean nothing from here on."""
        page, i = self.page, at + 1
        end = page.find(">", at) + 1
        tag = page[at:end]
        if "'" not in tag and tag.count('"') % 2 == 0:  # all quotes are closed before the first angle
            return end
        while self.quotes and (m := STOP.search(page, i)):
            c, i = m.group(), m.end()
            if c == ">":
                return i
            if page[max(at, m.start() - 32) : m.start()].rstrip().endswith("="):
                i = page.find(c, i) + 1 if i <= self.last[c] else i
        self.quotes = False
        return end

    def skip(self, name: str) -> None:
        """Go past the closing tag of an element whose content is left out; past everything if there is none."""
        m = _closing(name).search(self.page, self.at)
        end = self.page.find(">", m.end()) if m else -1
        self.at = end + 1 if end >= 0 else len(self.page)


@cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?![\w-])", re.IGNORECASE)


@dataclass(frozen=True)
class Rules:
    """Bounds of the first pass: lengths in characters, densities as shares of words or characters."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.12
    stop_high: float = 0.20
    links: float = 0.4


@dataclass
class Block:
    """bad: the number of the innermost furniture that holds it, 0 for none."""

    text: str
    links: int
    bad: int
    main: bool
    label: str = ""

    @cached_property
    def size(self) -> float:
        """Characters; those of scripts that write a word in one or two count more."""
        return len(self.text) if self.text.isascii() else len(self.text) + 1.5 * len(WIDE.findall(self.text))

    @cached_property
    def density(self) -> float:
        """The share of stop words."""
        words = WORD.findall(self.text.lower())
        return sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))


@dataclass
class Furniture:
    """outer: the furniture around it. firm: marked by its element or role, which holds; else by a name, or a form, which can be forgiven."""

    outer: int
    firm: bool
    form: bool
    holds_main: bool = False


@dataclass
class _Open:
    name: str
    bad: int
    main: bool
    link: bool = False


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    furniture: list[Furniture] = field(default_factory=lambda: [Furniture(0, True, False)])
    parts: list[str] = field(default_factory=list)
    links: int = 0
    lang: str = ""
    outlinks: list[str] = field(default_factory=list)

    def end(self, top: _Open) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.links, top.bad, top.main))
        self.parts, self.links = [], 0

    def forgive(self, which: set[int]) -> None:
        """Blocks in these furnitures count as in what is around them."""
        to = list(range(len(self.furniture)))
        for i, f in enumerate(self.furniture):  # what is around comes first
            f.outer = to[f.outer]
            if i in which:
                to[i] = f.outer
        for b in self.blocks:
            b.bad = to[b.bad]


def _names_furniture(value: str, main: bool) -> bool:
    for token in value.split():
        pieces = [p.lower() for p in PIECE.findall(token)]
        bad = {p for p in pieces if p in BAD_NAMES}
        if bad == {"header"} and (main or not NAME_OF_ARTICLE.isdisjoint(pieces)) or not NAME_OF_LAYOUT.isdisjoint(pieces):
            continue
        if bad:
            return True
    return False


def _furniture(name: str, tag: str, main: bool) -> str:
    """How an element is marked as furniture: firm, form, name, or not at all."""
    found = "form" if name == "form" else "firm" if name in BAD_TAGS or name == "header" and not main else ""
    if " " not in tag and "\n" not in tag and "\t" not in tag:
        return found
    for key, *values in ATTRIBUTE.findall(tag):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "role" and value.lower() in BAD_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return "firm"
        if not found and key in ("class", "id") and name not in ("html", "body", "article", "main") and _names_furniture(value, main):
            found = "name"
    return found


def read_page(page: str) -> _Page:
    """The page's blocks of text in order, and its furniture. Markup may be broken: a closing tag ends everything opened since its opening tag, or nothing."""
    out, stack, opened, scanner, headed = _Page(), [_Open("", 0, False)], Counter(), Scanner(page), False

    def close(depth: int) -> None:
        for x in stack[depth:]:
            opened[x.name] -= 1
        del stack[depth:]

    for kind, token in scanner:
        if kind == "text":
            text = html.unescape(token)
            out.parts.append(text)
            if stack[-1].link:
                out.links += len("".join(text.split()))
            continue
        name = NAME.match(token)[1].lower()
        if token[1] == "/":
            if name in BLOCK_TAGS:
                out.end(stack[-1])
            if opened[name]:
                depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name)
                if any(x.name in BLOCK_TAGS for x in stack[depth:]):
                    out.end(stack[-1])
                close(depth)
            continue
        if name in HIDDEN_TAGS and not token.endswith("/>"):
            if name != "head":
                scanner.skip(name)
            elif not headed:  # only a head that is closed, or ends where the body begins, is left out
                headed, end = True, HEAD_END.search(page, scanner.at)
                scanner.at = end.start() if end else scanner.at
            continue
        if name == "br":
            out.parts.append(" ")
            continue
        if name in BLOCK_TAGS:
            out.end(stack[-1])
            if stack[-1].name == "p" or name in ("li", "tr", "td", "th", "dt", "dd", "option") and stack[-1].name == name:
                close(len(stack) - 1)
        if name in VOID_TAGS or token.endswith("/>"):
            continue
        if name == "a" and (m := HREF.search(token)):
            out.outlinks.append(html.unescape(m[1] or m[2] or m[3] or ""))
        elif name == "html" and not out.lang and (m := LANG.search(token)):
            out.lang = m[1]
        top = stack[-1]
        main, bad = top.main or name in ("article", "main"), top.bad
        if main and not top.main:
            while bad and not out.furniture[bad].holds_main:
                out.furniture[bad].holds_main = True
                bad = out.furniture[bad].outer
            bad = top.bad
        if how := _furniture(name, token, main):
            out.furniture.append(Furniture(bad, how == "firm", how == "form"))
            bad = len(out.furniture) - 1
        opened[name] += 1
        stack.append(_Open(name, bad, main, top.link or name == "a"))
    out.end(stack[-1])
    return out


def title_of(page: str) -> str:
    """What stands in the page's first title."""
    m = TITLE.search(page)
    start = page.find(">", m.end()) + 1 if m else 0
    if not start:
        return ""
    end = page.find("<", start)
    return " ".join(html.unescape(page[start : end if end >= 0 else len(page)]).split())


TITLE = re.compile(r"<title(?![\w-])", re.IGNORECASE)
HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
LANG = re.compile(r"""\blang\s*=\s*["']?([\w-]+)""", re.IGNORECASE)
HEAD_END = re.compile(r"</head(?![\w-])|(?=<body\b)", re.IGNORECASE)


def blocks_of(page: str) -> list[Block]:
    return read_page(page).blocks


def decide(block: Block, rules: Rules, listed: bool = True) -> str:
    """good, bad, or open. listed: the page's language has stop words here."""
    size = block.size
    if block.bad or block.links > rules.links * len("".join(block.text.split())):
        return "bad"
    if size < rules.short:
        return "open"
    density = block.density if listed else rules.stop_high * bool(WORD.search(block.text))
    if density >= rules.stop_high and size >= rules.long or density >= rules.stop_low and block.main:
        return "good"
    if density >= rules.stop_low or block.main:
        return "open"
    return "bad"


def has_stop_words(blocks: list[Block], rules: Rules) -> bool:
    """Whether the page's long blocks, those of its article if it has any, are in a language with a list."""
    long_ = [b for b in blocks if not b.bad and b.size >= rules.short]
    own = [b for b in long_ if b.main] or long_
    return not own or any(b.density >= rules.stop_low / 2 for b in own)


def label(blocks: list[Block], rules: Rules = Rules()) -> list[Block]:
    listed = has_stop_words(blocks, rules)
    for b in blocks:
        b.label = decide(b, rules, listed)
    has_main = any(b.main and not b.bad for b in blocks)
    for part in (True, False):
        own = [b for b in blocks if b.main is part]
        # furniture is decided by its place, so it says nothing about its neighbours
        known = [(i, b.label) for i, b in enumerate(own) if b.label != "open" and not b.bad]
        labels = []
        for i, b in enumerate(own):
            if b.label != "open":
                labels.append(b.label)
                continue
            near = sorted((abs(i - j), x != "good", x) for j, x in known)[:1] if len(known) < 3 else [_nearest(known, i)]
            labels.append(near[0][-1] if near else "good" if part or not has_main else "bad")
        for b, x in zip(own, labels, strict=True):
            b.label = x
    return blocks


def _nearest(known: list[tuple[int, str]], i: int) -> tuple[int, bool, str]:
    from bisect import bisect

    k = bisect(known, (i, ""))
    return min((abs(i - j), x != "good", x) for j, x in known[max(0, k - 1) : k + 1])


def _good(page: _Page, rules: Rules) -> list[Block]:
    return [b for b in label(page.blocks, rules) if b.label == "good"]


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    read = read_page(page or "")
    while not any(b.main and not b.bad for b in read.blocks):
        # the outermost furniture that an article is in, if no article is outside
        held = {i for i, f in enumerate(read.furniture) if i and f.holds_main and not f.firm and not f.outer and any(b.bad for b in read.blocks)}
        if not held:
            break
        read.forgive(held)
        for i in held:
            read.furniture[i].holds_main = False
    good = _good(read, rules)
    if not good:  # a page that is all one form
        forms = {i for i, f in enumerate(read.furniture) if i and f.form and not f.firm and not f.outer}
        if forms:
            read.forgive(forms)
            good = _good(read, rules)
    return " ".join(b.text for b in good)


def extract_text(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per input row: page_id, url, text (empty if none), n_chars.

    Null html counts as empty. Ids and urls can be repeated or null and are passed on. Character references are decoded, white space inside a
    block is one blank, blocks are joined in page order by one blank. Blocks at the same distance of a good and a bad neighbour are good. Extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "html"):
            texts = [main_text(x, rules).encode("utf-8", "replace").decode() for x in batch["html"].to_pylist()]
            yield pa.record_batch({"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return only(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
