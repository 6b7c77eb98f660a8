"""Per-page helper: a small element tree over the standard-library HTML parser,
with the CSS selector subset the extraction rules use (tag, .class, #id,
[attr], [attr=v], [attr*=v], [attr^=v], [attr$=v], [attr~=v], descendant and
``>`` child combinators, comma lists).  Runs inside ``mapInPandas`` tasks.
"""

from __future__ import annotations

import re
from html import escape, unescape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
RAW_TEXT = {"script", "style"}
# Elements whose text is read in another way, by the standard library alone.
OTHER_TEXT = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}
# Text and the plain end or start tag, or comment, after it; every other tag is left to the standard library.
_TOKEN = re.compile(r"""([^<]*)<(?:/([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r]*>
    |([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r]+[a-zA-Z_:][a-zA-Z0-9_:.-]*="[^"]*")*)[ \t\n\r]*(/?)>
    |!--[^->]*-->)""", re.VERBOSE)
# What such an element holds, up to its end tag, where the standard library has no rules of its own for it.
_HELD = {"title": re.compile(r"([^<&]*)</title>"), "script": re.compile(r"((?:[^<]|<(?!!|/[sS]))*)</script>"),
         "style": re.compile(r"((?:[^<]|<(?!!|/[sS]))*)</style>")}
_ATTRIBUTE = re.compile(r'([^\s="]+)="([^"]*)"')


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "_index", "facts", "place", "by_tag", "by_attr", "live")

    def __init__(self, tag, attrs, parent):
        self.tag = tag
        self.attrs = attrs
        self.parent = parent
        self.children = []
        self._index = None
        self.facts = None  # on the root: the page's tags, "@" attribute names and "." class tokens
        self.place = 0     # number in document order

    def elements(self):
        """All elements below this node in document order (computed once)."""
        if self._index is None:
            self._index = [n for n in self.iter() if n is not self]
        return self._index

    def get(self, name, default=None):
        return self.attrs.get(name, default)

    def classes(self):
        return (self.attrs.get("class") or "").split()

    def iter(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def descendants(self, tag=None):
        if tag is not None and self.facts is not None:
            return iter(self.by_tag.get(tag, ()))
        els = self.elements()
        return iter(els) if tag is None else (n for n in els if n.tag == tag)

    def text(self, skip=RAW_TEXT):
        out = []
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in skip or n is self:
                stack.extend(reversed(n.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.root.facts = set()
        self.root.by_tag, self.root.by_attr, self.noted = {}, {}, 0  # elements in document order
        self.stack = [self.root]
        self.comments = 0

    def _add(self, tag, attrs) -> Node:
        root = self.root
        node = Node(tag, attrs, self.stack[-1])
        self.noted += 1
        node.place = self.noted
        node.parent.children.append(node)
        if tag in root.by_tag:
            root.by_tag[tag].append(node)
        else:
            root.by_tag[tag] = [node]
            root.facts.add(tag)
        for name in attrs:
            if name in root.by_attr:
                root.by_attr[name].append(node)
            else:
                root.by_attr[name] = [node]
                root.facts.add("@" + name)
        if "class" in attrs:
            root.facts.update(["." + c for c in node.classes()])
        return node

    def parse_starttag(self, i):
        """The plain tags from here on, with the text between them; the first tag that is not
        plain ends the run and is the standard library's."""
        page, at, stack = self.rawdata, i, self.stack
        token = _TOKEN.match(page, at)
        while token is not None:
            text, end, tag, attributes, alone = token.groups()
            held = None
            if tag is not None and (tag := tag.lower()) in OTHER_TEXT:
                held = _HELD[tag].match(page, token.end()) if tag in _HELD and not alone else None
                if held is None:
                    break
            if text:
                stack[-1].children.append(unescape(text) if "&" in text else text)
            if end is not None:
                end = end.lower()
                if stack[-1].tag == end:
                    stack.pop()
                else:
                    self.handle_endtag(end)
            elif tag is None:
                self.comments += 1
            else:
                attrs = {}
                if attributes:
                    for name, value in _ATTRIBUTE.findall(attributes):
                        attrs[name.lower()] = unescape(value) if "&" in value else value
                node = self._add(tag, attrs)
                if held is not None:
                    if held.group(1):
                        node.children.append(held.group(1))
                elif not alone and tag not in VOID:
                    stack.append(node)
            at = (held or token).end()
            token = _TOKEN.match(page, at)
        return at if at > i else super().parse_starttag(i)

    def updatepos(self, i, j):
        """Line numbers are not counted."""
        return j

    def handle_starttag(self, tag, attrs):
        node = self._add(tag, {k: (v if v is not None else "") for k, v in attrs})
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, {k: (v if v is not None else "") for k, v in attrs})

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)

    def handle_comment(self, data):
        self.comments += 1


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    facts = frozenset(b.root.facts)
    if facts not in _LIVE and len(_LIVE) >= LIVE_PAGES:
        _LIVE.clear()
    b.root.live = _LIVE.setdefault(facts, {})
    return b.root


#: Facts of the last kinds of pages -> selector -> those of its chains that may match there.
_LIVE: dict = {}
LIVE_PAGES = 256


# ---------------------------------------------------------------- selectors
_COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)")
_PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~|]?=)\s*(['\"]?)(.*?)\5)?\s*\]")


def _compile_compound(text):
    m = _COMPOUND.fullmatch(text)
    if not m:
        raise ValueError(f"unsupported selector part: {text}")
    tag = m.group(1) if m.group(1) and m.group(1) != "*" else None
    tests = []
    for pm in _PART.finditer(m.group(2) or ""):
        if pm.group(1) == ".":
            tests.append(("class", pm.group(2)))
        elif pm.group(1) == "#":
            tests.append(("id", pm.group(2)))
        else:
            tests.append(("attr", pm.group(3).lower(), pm.group(4), pm.group(6)))
    return tag, tests


def _match_compound(node, comp):
    tag, tests = comp
    if not isinstance(node, Node) or node.tag.startswith("#"):
        return False
    if tag and node.tag != tag.lower():
        return False
    for t in tests:
        if t[0] == "class":
            if t[1] not in node.classes():
                return False
        elif t[0] == "id":
            if node.get("id") != t[1]:
                return False
        else:
            _, name, op, val = t
            if name not in node.attrs:
                return False
            have = node.attrs[name]
            if op is None:
                continue
            if op == "=" and have != val:
                return False
            if op == "*=" and (not val or val not in have):
                return False
            if op == "^=" and (not val or not have.startswith(val)):
                return False
            if op == "$=" and (not val or not have.endswith(val)):
                return False
            if op == "~=" and val not in have.split():
                return False
            if op == "|=" and not (have == val or have.startswith(val + "-")):
                return False
    return True


def compile_selector(sel: str):
    """Comma list of chains; each chain is [(combinator, compound), ...] left to right."""
    chains = []
    for part in sel.split(","):
        tokens = re.findall(r">|[^\s>]+", part.strip())
        chain, comb = [], " "
        for tok in tokens:
            if tok == ">":
                comb = ">"
                continue
            chain.append((comb, _compile_compound(tok)))
            comb = " "
        if chain:
            chains.append(Chain(chain))
    return chains


def _match_chain(node, chain):
    comb, comp = chain[-1]
    if not _match_compound(node, comp):
        return False
    if len(chain) == 1:
        return True
    rest = chain[:-1]
    p = node.parent
    if comb == ">":
        return p is not None and _match_chain(p, rest)
    while p is not None:
        if _match_chain(p, rest):
            return True
        p = p.parent
    return False


class Chain(list):
    """A chain's parts, with what a page needs for it: tags, "@" attribute names, "." class tokens."""

    def __init__(self, parts):
        super().__init__(parts)
        needs = set()
        for _, (tag, tests) in self:
            if tag:
                needs.add(tag.lower())
            for t in tests:
                if t[0] == "class":
                    needs.update(("@class", "." + t[1]))
                else:
                    needs.add("@id" if t[0] == "id" else "@" + t[1])
        self.needs = frozenset(needs)
        # a part of the class attribute without white space lies in one of its tokens
        self.class_parts = [t[3] for _, (_, tests) in self for t in tests
                            if t[:3] == ("attr", "class", "*=") and t[3] and len(t[3].split()) == 1 and t[3] == t[3].strip()]

    def may_match(self, facts) -> bool:
        return self.needs <= facts and all(any(f[0] == "." and part in f for f in facts) for part in self.class_parts)


def select(root: Node, sel) -> list[Node]:
    """Matching elements in document order.  Chains that need a tag, attribute or
    class the page does not have at all are skipped without walking the page."""
    chains = compile_selector(sel) if isinstance(sel, str) else sel
    if root.facts is not None:
        chains = [ch for ch in chains if ch.needs <= root.facts]
    if not chains:
        return []
    if root.facts is None:
        return [n for n in root.elements() if any(_match_chain(n, ch) for ch in chains)]
    found = [[n for n in _last(root, ch) if _match_chain(n, ch)] for ch in chains]
    found = [f for f in found if f]
    if len(found) < 2:
        return found[0] if found else []
    return sorted({id(n): n for f in found for n in f}.values(), key=lambda n: n.place)


def _last(root: Node, chain) -> list[Node]:
    """The page's elements that may be the last of a chain: those with its rarest tag or
    attribute, in document order."""
    tag, tests = chain[-1][1]
    lists = [root.by_attr.get(t[0] if t[0] in ("class", "id") else t[1], ()) for t in tests]
    if tag:
        lists.append(root.by_tag.get(tag.lower(), ()))
    return min(lists, key=len) if lists else root.elements()


# Elements that stay although they hold no text.
KEPT_EMPTY = ("img", "input", "meta", "link")


def render(node: Node, drop=("script", "style", "noscript")) -> str:
    """Serialise a subtree, dropping the given elements, comments (already gone) and
    elements that hold neither text nor one of ``KEPT_EMPTY``.  One pass with its own
    stack, so depth is no limit."""
    stack = [(node, iter(node.children), [], [False])]  # node, children left, output, holds something
    while True:
        n, left, parts, holds = stack[-1]
        child = next(left, None)
        if isinstance(child, str):
            parts.append(escape(child, quote=False))  # text was unescaped by the parser
            holds[0] |= bool(child.strip())
        elif child is not None:
            if child.tag not in drop:
                stack.append((child, iter(child.children), [], [child.tag in KEPT_EMPTY]))
        else:
            stack.pop()
            inner = "".join(parts)
            if not stack:
                return inner if n.tag == "#root" else _element(n, inner)
            if holds[0] or n.tag in ("html", "head", "body"):
                stack[-1][2].append(_element(n, inner))
                stack[-1][3][0] |= holds[0]


def _element(n: Node, inner: str) -> str:
    attrs = "".join(f' {k}="{escape(v)}"' if v != "" else f" {k}" for k, v in n.attrs.items())
    return f"<{n.tag}{attrs}>" if n.tag in VOID else f"<{n.tag}{attrs}>{inner}</{n.tag}>"
