"""Fields of page markup from a whole tree: what the one-pass extraction is tested against."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html.parser import HTMLParser

from marketlens.functions import fixed_values as fv

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SELF_CLOSING = frozenset("p li option dt dd tr td th".split())
SELECTOR = re.compile(r"^([a-z0-9]*)(?:\.([\w-]+)|\[(\w+)\*=([^\]]+)\])?$", re.IGNORECASE)


@lru_cache(maxsize=None)
def parsed(selector: str) -> tuple[str, str | None, str | None, str | None]:
    """Tag, class, attribute and part of its value; selectors are a fixed few."""
    return SELECTOR.match(selector).groups()


class Node:
    __slots__ = ("tag", "attrs", "parent", "items")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None") -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list[Node | str] = []

    def walk(self) -> Iterator["Node"]:
        """Descendants in document order."""
        stack = [i for i in reversed(self.items) if isinstance(i, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [i for i in reversed(node.items) if isinstance(i, Node)]

    def text(self) -> str:
        out, stack = [], list(reversed(self.items))
        while stack:
            item = stack.pop()
            if isinstance(item, Node):
                stack += reversed(item.items)
            else:
                out.append(item)
        return "".join(out)

    def matches(self, selector: str) -> bool:
        tag, cls, attr, part = parsed(selector)
        if tag and self.tag != tag:
            return False
        if cls:
            return cls in (self.attrs.get("class") or "").split()
        return part in (self.attrs.get(attr) or "") if attr else True

    def all(self, *selectors: str) -> list["Node"]:
        return [n for n in self.walk() if any(n.matches(s) for s in selectors)]

    def first(self, *selectors: str) -> "Node | None":
        return next((n for n in self.walk() if any(n.matches(s) for s in selectors)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in SELF_CLOSING and self.here.tag == tag:
            self.here = self.here.parent
        node = Node(tag, dict(attrs), self.here)
        self.here.items.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.items.append(Node(tag, dict(attrs), self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.items.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def first_text(scope: Node, selectors: Sequence[str], accept) -> tuple[str, Node | None, bool]:
    """Tries selectors in turn; the first element of each is looked at.

    Returns the last text seen, its element, and whether it was accepted.
    """
    text, node = "", None
    for selector in selectors:
        found = scope.first(selector)
        if found is not None:
            text, node = found.text(), found
            if text.strip() and accept(text):
                return text, node, True
    return text, node, False


def _looks_like_price(value):
    return re.search(fv.LOOKS_LIKE_PRICE, value) is not None


def cards(source, link_part):
    root = parse(source)
    if root.first(*fv.NO_RESULTS_SELECTORS) is not None:
        return []
    out = []
    for i, link in enumerate(root.all(f"a[href*={link_part}]")):
        title, around = link.text(), link.parent or link
        price, _, price_ok = first_text(around, fv.CARD_PRICE_SELECTORS, _looks_like_price)
        seller, node, seller_ok = first_text(around, fv.CARD_SELLER_SELECTORS, lambda t: not _looks_like_price(t))
        seller_link = node.first("a") if seller_ok else None
        stock = around.first(*fv.AVAILABILITY_SELECTORS)
        out.append(
            (
                i, title if len(title.strip()) > fv.MIN_CARD_TITLE else "", price, price_ok, seller if seller_ok else "",
                (seller_link.attrs.get("href") or "") if seller_link is not None else "",
                stock.text() if stock is not None else "", link.attrs.get("href") or "",
            )
        )
    return out


def offers(source):
    root = parse(source)
    found = next((c for s in fv.OFFER_SELECTORS if (c := root.all(s))), [])
    out = []
    for i, card in enumerate(found):
        seller, _, seller_ok = first_text(card, fv.OFFER_SELLER_SELECTORS, lambda t: True)
        price, _, price_ok = first_text(card, fv.OFFER_PRICE_SELECTORS, lambda t: True)
        href = ""
        for selector in fv.OFFER_LINK_SELECTORS:
            link = card.first(selector)
            target = (link.attrs.get("href") or "") if link is not None else ""
            if any(word in target for word in fv.SELLER_LINK_WORDS):
                href = target
                break
        out.append((i, seller if seller_ok else "", price, price_ok, href))
    return out
