"""Finding fields in page markup in one pass: a small helper for the Python workers.

Only structure is handled here (which element, whose text).  Cleaning, prices
and currencies are Spark expressions applied to what comes out.

No tree is built.  While a page is read, each open element that is watched knows the
first element inside it for every selector; text is kept once, and an element's text
is a stretch of it.  What an element gives is taken when it closes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SELF_CLOSING = frozenset("p li option dt dd tr td th".split())
REMEMBERED = 4096
# Pages up to this length that are made of nothing else are taken apart by one pattern:
# texts without references, tags with quoted attributes, and no element of raw text.
PLAIN_PAGE = 1 << 16
PLAIN = re.compile(
    r"<(?!(?:script|style|textarea|title|iframe|xmp|noembed|noframes|noscript|plaintext|svg|math)\b)([a-z][a-z0-9]*)"
    r'((?:[ \t\n]+[a-z-]+="[^"<>&\0]*")*)[ \t\n]*>|</([a-z][a-z0-9]*)>|([^<&\0]+)|([<&\0])'
)
ATTRIBUTE = re.compile(r'([a-z-]+)="([^"]*)"')
SELECTOR = re.compile(r"^([a-z0-9]*)(?:\.([\w-]+)|\[(\w+)\*=([^\]]+)\])?$", re.IGNORECASE)


def matcher(*selectors: str):
    """Test of (tag, attributes) against any of the selectors."""
    parsed = [SELECTOR.match(s).groups() for s in selectors]

    def matches(tag: str, attrs: dict) -> bool:
        for wanted, cls, attr, part in parsed:
            if wanted and tag != wanted:
                continue
            if cls:
                if cls in (attrs.get("class") or "").split():
                    return True
            elif not attr or part in (attrs.get(attr) or ""):
                return True
        return False

    matches.by_class = all(attr in (None, "class") for _, _, attr, _ in parsed)
    return matches


class Tests:
    """Numbered tests of elements; what those of tag and class alone say is remembered."""

    def __init__(self, tests: Sequence) -> None:
        self.by_class = [(n, t) for n, t in enumerate(tests) if t.by_class]
        self.others = [(n, t) for n, t in enumerate(tests) if not t.by_class]
        self.known: dict[tuple, list[int]] = {}

    def numbers(self, tag: str, attrs: dict) -> list[int]:
        """Numbers of the tests that hold, rising."""
        key = tag, attrs.get("class")
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[key] = [n for n, test in self.by_class if test(tag, attrs)]
        more = [n for n, test in self.others if test(tag, attrs)] if attrs else ()
        return sorted([*found, *more]) if more else found


class Found:
    """An element that a selector found: attributes, its stretch of the text, the first link inside."""

    __slots__ = ("attrs", "begin", "end", "link")

    def __init__(self, attrs: dict, begin: int) -> None:
        self.attrs, self.begin, self.end, self.link = attrs, begin, begin, None


class Element:
    """An open element; `first` holds, for each selector, the first element inside it."""

    __slots__ = ("tag", "first", "recorded", "held")

    def __init__(self, tag: str) -> None:
        self.tag = tag
        self.first: dict[int, Found] = {}
        self.recorded: list[Found] = []
        self.held: list = []


class Watch(HTMLParser):
    """Reads a page and calls `opened` and `closed` for its elements.

    `tests` are the selectors.  Elements that `opened` says are watched collect, per
    number, the first element inside them; an element inside them that is the first of
    none is not kept.
    """

    def __init__(self, tests: Tests) -> None:
        super().__init__(convert_charrefs=True)
        self.tests = tests
        self.texts: list[str] = []
        self.open = [Element("")]
        self.watched = []
        self.recording: list[Found] = []
        self.tags: dict[str, int] = {}

    def opened(self, element: Element, attrs: dict) -> bool:
        raise NotImplementedError

    def closed(self, element: Element) -> None:
        raise NotImplementedError

    def record(self, element: Element, attrs: dict) -> Found:
        """Keeps where the element's text begins and ends."""
        found = Found(attrs, len(self.texts))
        element.recorded.append(found)
        return found

    def text(self, found: Found) -> str:
        return "".join(self.texts[found.begin : found.end])

    def first_text(self, element: Element, numbers: Sequence[int], accept) -> tuple[str, Found | None, bool]:
        """Tries selectors in turn; the first element of each is looked at.

        Returns the last text seen, its element, and whether it was accepted.
        """
        text, found = "", None
        for number in numbers:
            if number in element.first:
                found = element.first[number]
                text = self.text(found)
                if text.strip() and accept(text):
                    return text, found, True
        return text, found, False

    def read(self, source: str) -> None:
        if self.opened(self.open[0], {}):
            self.watched.append(self.open[0])
        tokens = PLAIN.findall(source) if len(source) <= PLAIN_PAGE else [("", "", "", "", "<")]
        if any(token[4] for token in tokens):
            self.feed(source)
            self.close()
        else:
            for tag, attrs, ended, text, _ in tokens:
                if text:
                    self.texts.append(text)
                elif tag:
                    self.handle_starttag(tag, ATTRIBUTE.findall(attrs) if attrs else ())
                else:
                    self.handle_endtag(ended)
        while self.open:
            self._end(self.open.pop())

    # --- events ---

    def handle_starttag(self, tag, attrs):
        if tag in SELF_CLOSING and self.open[-1].tag == tag:
            self._close()
        element = self._begin(tag, dict(attrs))
        if tag in VOID:
            self._end(element)
        else:
            self.open.append(element)
            self.tags[tag] = self.tags.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self._end(self._begin(tag, dict(attrs)))

    def handle_endtag(self, tag):
        while self.tags.get(tag):
            if self._close() == tag:
                break

    def handle_data(self, data):
        self.texts.append(data)

    def _begin(self, tag: str, attrs: dict) -> Element:
        element = Element(tag)
        if tag == "a":
            for found in reversed(self.recording):
                if found.link is not None:
                    break  # so have those around it
                found.link = attrs
        kept = None
        for number in self.tests.numbers(tag, attrs):
            for around in reversed(self.watched):
                if number in around.first:
                    break  # so have those around it
                kept = kept or self.record(element, attrs)
                around.first[number] = kept
        if self.opened(element, attrs):
            self.watched.append(element)
        if element.recorded:
            self.recording += element.recorded
        return element

    def _close(self) -> str:
        element = self.open.pop()
        self.tags[element.tag] -= 1
        self._end(element)
        return element.tag

    def _end(self, element: Element) -> None:
        if element.recorded:
            for found in element.recorded:
                found.end = len(self.texts)
            del self.recording[len(self.recording) - len(element.recorded) :]
        if self.watched and self.watched[-1] is element:
            self.watched.pop()
        self.closed(element)
