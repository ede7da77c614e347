"""HTML as a sequence of text blocks with what their place in the tree says about them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Element names by what they do to text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul"
    .split()
)
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
UNSEEN_TAGS = frozenset(
    "script style title noscript iframe noembed noframes template textarea select button svg "
    "object canvas audio video map datalist head annotation annotation-xml".split()
)
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: An open element of the first kind ends where one of the second kind starts.
ENDED_BY = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot", "thead"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot", "thead"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot", "thead"}),
    "option": frozenset({"option", "optgroup"}),
}
BOUNDARIES = frozenset("table ul ol dl select article section div body".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>|</?[a-zA-Z][^>]*+\Z",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$)",
    re.IGNORECASE,
)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@dataclass
class Element:
    """An open element: its name, the words of its class, id and role, and where it stands."""

    tag: str
    words: frozenset[str]
    hidden: bool
    number: int
    parent: "Element | None"
    depth: int


@dataclass
class Block:
    """A run of text with no block boundary inside."""

    element: Element
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _element(tag: str, rest: str, number: int, parent: Element | None) -> Element:
    words, hidden = frozenset(), False
    if rest and not rest.isspace():
        found = {n.lower(): v.strip("\"'") for n, v in _ATTRIBUTE.findall(rest)}
        if found:
            named = " ".join(found.get(n, "") for n in ("class", "id", "role", "itemprop"))
            words = frozenset(w.lower() for w in _NAME.findall(named))
            style = found.get("style", "").replace(" ", "").lower()
            hidden = (
                "hidden" in found or found.get("aria-hidden", "").lower() == "true"
                or "display:none" in style or "visibility:hidden" in style
            )
    return Element(tag, words, hidden, number, parent, 0 if parent is None else parent.depth + 1)


def blocks(source: str) -> list[Block]:
    """Non-empty visible blocks in page order, white space inside each turned into one space."""
    root = _element("", "", 0, None)
    top, number, links, unseen = root, 0, 0, 0
    out: list[Block] = []
    current: Block | None = None
    at, size = 0, len(source)

    def add(raw: str) -> None:
        nonlocal current
        if unseen or not raw:
            return
        if current is None:
            if raw.isspace():
                return
            current = Block(top)
            out.append(current)
        text = html.unescape(raw) if "&" in raw else raw
        current.pieces.append(text)
        if links:
            current.linked += len(text)

    def leave(element: Element) -> None:
        nonlocal links, unseen
        links -= element.tag == "a"
        unseen -= element.hidden or element.tag in UNSEEN_TAGS

    def close_until(stop: Element) -> None:
        nonlocal top
        while top is not stop:
            leave(top)
            top = top.parent

    while at < size:
        found = _TOKEN.search(source, at)
        if found is None:
            add(source[at:])
            break
        if found.start() > at:
            add(source[at:found.start()])
        at = found.end()
        tag = found["tag"] or found["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        is_block = tag in BLOCK_TAGS
        if found["end"] or found["end2"]:
            element = top
            while element is not root and element.tag != tag:
                if element.tag in BLOCK_TAGS and not is_block:
                    element = root  # an inline end tag closes nothing outside its block
                    break
                element = element.parent
            if element is not root:
                close_until(element.parent)
            if is_block:
                current = None
            continue
        rest = found["rest"] if found["tag"] else found["rest2"]
        if tag == "br" or tag == "wbr":
            add(" " if tag == "br" else "")
            continue
        if is_block:
            current = None
            element = top
            while element is not root and element.tag not in BOUNDARIES:
                ends = element.tag == "p" or tag in ENDED_BY.get(element.tag, ())
                if ends:
                    close_until(element.parent)
                    break
                element = element.parent
        if tag in VOID_TAGS:
            continue
        number += 1
        top = _element(tag, rest or "", number, top)
        links += tag == "a"
        unseen += top.hidden or tag in UNSEEN_TAGS
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
            at = end.end() if end else size
            close_until(top.parent)
        elif rest.endswith("/") and tag not in BLOCK_TAGS and tag != "a":
            close_until(top.parent)
    for block in out:
        block.text = " ".join("".join(block.pieces).split())
    return [b for b in out if b.text]
