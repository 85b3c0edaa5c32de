"""A small tree of HTML and the selectors that listings need: tag, .class, #id, [attr], [attr=v], [attr*=v], [attr~=v], [attr^=v], [attr$=v],
descendant and child combinators, lists, :not(), :has(), :first-child, :-soup-contains() and :scope."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

#: Fixed by HTML: elements without content, and those whose text isn't shown.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset(("script", "style", "noscript"))


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def strings(self, unseen: bool = False):
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif unseen or c.tag not in UNSEEN:
                yield from c.strings(unseen)

    def text(self, sep: str = " ") -> str:
        return sep.join(t for t in (" ".join(s.split()) for s in self.strings()) if t)

    def select(self, selector: str) -> list[Node]:
        groups = compiled(selector)
        return [n for n in self.walk() if any(fits(n, g, self) for g in groups)]


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        implied = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
        if self.at.tag in implied.get(tag, ()):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    b = Builder()
    b.feed(html or "")
    b.close()
    return b.root


PART = re.compile(
    r"""\s*(?P<comb>>)\s*|(?P<gap>\s+)|(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)"""
    r"""|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*~^$]?=)\s*["']?(?P<val>[^"'\]]*)["']?\s*)?\]|:(?P<pseudo>[\w-]+)(?P<arg>\()?"""
)


def bracketed(s: str, at: int) -> int:
    """Where the parenthesis opened before `at` closes."""
    depth, quote = 1, ""
    while depth:
        c = s[at]
        quote = "" if c == quote else quote or (c if c in "\"'" else "")
        depth += 0 if quote else (c == "(") - (c == ")")
        at += 1
    return at


def lists(selector: str) -> list[str]:
    out, start, at = [], 0, 0
    while at < len(selector):
        if selector[at] == "(":
            at = bracketed(selector, at + 1)
        elif selector[at] == ",":
            out.append(selector[start:at])
            at = start = at + 1
        else:
            at += 1
    return [s.strip() for s in (*out, selector[start:]) if s.strip()]


@lru_cache(maxsize=512)
def compiled(selector: str) -> list[list[tuple[str, list]]]:
    """Each alternative as compounds from left to right, with the combinator before each."""
    groups = []
    for one in lists(selector):
        steps, tests, comb, at = [], [], " ", 0
        while at < len(one):
            m = PART.match(one, at)
            if not m:
                raise ValueError(f"selector not understood: {one!r} at {at}")
            at = m.end()
            if m["comb"] or m["gap"]:
                if tests:
                    steps.append((comb, tests))
                    tests, comb = [], ">" if m["comb"] else " "
                else:
                    comb = ">" if m["comb"] else comb
            elif m["pseudo"]:
                arg = None
                if m["arg"]:
                    end = bracketed(one, at)
                    arg, at = one[at : end - 1].strip(), end
                tests.append(("pseudo", m["pseudo"], arg))
            elif m["attr"]:
                tests.append(("attr", m["attr"].lower(), m["op"], m["val"]))
            else:
                tests.append(next((k, m[k]) for k in ("tag", "cls", "id") if m[k]))
        steps.append((comb, tests))
        groups.append(steps)
    return groups


def passes(n: Node, test: tuple, scope: Node) -> bool:
    kind = test[0]
    if kind == "tag":
        return test[1] == "*" or n.tag == test[1].lower()
    if kind == "cls":
        return test[1] in n.attrs.get("class", "").split()
    if kind == "id":
        return n.attrs.get("id") == test[1]
    if kind == "attr":
        have, op, want = n.attrs.get(test[1]), test[2], test[3]
        if have is None or op is None:
            return have is not None
        return {"=": have == want, "*=": want in have, "~=": want in have.split(), "^=": have.startswith(want), "$=": have.endswith(want)}[op]
    name, arg = test[1], test[2]
    if name == "not":
        return not any(fits(n, g, scope) for g in compiled(arg))
    if name == "has":
        return bool(n.select(arg if not arg.startswith(">") else f":scope {arg}"))
    if name == "first-child":
        return n.parent is not None and next(c for c in n.parent.children if isinstance(c, Node)) is n
    if name == "scope":
        return n is scope
    if name in ("-soup-contains", "contains"):
        return arg.strip("\"'") in "".join(n.strings(True))
    raise ValueError(f"selector not understood: :{name}")


def fits(n: Node | None, steps: list, scope: Node) -> bool:
    if n is None or not all(passes(n, t, scope) for t in steps[-1][1]):
        return False
    if len(steps) == 1:
        return True
    up = n.parent
    if steps[-1][0] == ">":
        return fits(up, steps[:-1], scope)
    while up is not None:
        if fits(up, steps[:-1], scope):
            return True
        up = up.parent
    return False


def pick(node: Node, selectors: str | list[str] | None, attr: str | None = None) -> str | None:
    """The first non-empty value among selectors in order."""
    for s in [selectors] if isinstance(selectors, str) else selectors or []:
        found = node.select(s)
        if found:
            value = found[0].attrs.get(attr, "").strip() if attr else found[0].text()
            if value:
                return value
    return None


def field_values(node: Node, selector: str | None) -> list[str]:
    """Values of a labelled field: its items, else its text in parts, without the label and without parts that are only punctuation."""
    found = node.select(selector) if selector else []
    if not found:
        return []
    items = found[0].select(".field__item, .field-content li, li")
    labels = {id(s) for label in found[0].select(".field__label") for s in [label]}

    def parts(n: Node):
        for c in n.children:
            if isinstance(c, str):
                yield c
            elif id(c) not in labels:
                yield from parts(c)

    texts = [i.text() for i in items] if items else [" ".join(s.split()) for s in parts(found[0])]
    return [t for t in texts if re.search(r"\w", t)]
