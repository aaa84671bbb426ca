"""Block-level token streams of HTML pages: elements that hold text, and the text blocks in them.

A stream lists opening, text and closing tokens in page order. A token is named by its kind and the
path of its element, a hash of tags, ids and classes from the root on, digits left out. Elements
without text leave no tokens, inline markup none either. Neighbouring groups of equal shape become
one group marked as repeated, so a list of five and one of fifty items give one stream.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b
from html import unescape

OPEN, TEXT, CLOSE = range(3)
MAX_PERIOD = 8  # elements in a repeated group that a page is folded by; alignment finds the others

# fixed values: HTML elements by how their content is parsed
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("title meta link script style base noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split())
# what an opening tag closes, and the elements it does not look beyond
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"})}
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
# elements of running text: neighbours of one shape are one repeated group even without a class
LISTED = frozenset(
    "p li tr td th dt dd h1 h2 h3 h4 h5 h6 blockquote pre figure option ul ol dl table tbody article "
    "section".split())

_QUOTED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_FIELD = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_DIGITS = re.compile(r"\d+")


class Token:
    """One token; a text token also counts the blocks it stands for."""

    __slots__ = ("alias", "chars", "const", "kind", "link", "n", "opt", "pages", "path", "rep")

    def __init__(self, kind: int, path: int, rep: int = 0, opt: int = 0, pages: int = 0, n: int = 0,
                 chars: int = 0, link: int = 0, const: int | None = None) -> None:
        self.kind, self.path, self.rep, self.opt = kind, path, rep, opt
        self.pages, self.n, self.chars, self.link, self.const = pages, n, chars, link, const
        self.alias: Token | None = None

    @property
    def name(self) -> int:
        return self.path * 3 + self.kind

    def absorb(self, other: Token, same_page: bool) -> None:
        """Count another token's blocks here; different texts make this a variable slot."""
        self.rep |= other.rep
        self.opt |= other.opt
        if self.kind == TEXT:
            self.pages = max(self.pages, other.pages) if same_page else self.pages + other.pages
            self.n, self.chars, self.link = self.n + other.n, self.chars + other.chars, self.link + other.link
            if self.const != other.const:
                self.const = None
        other.alias = self

    def found(self) -> Token:
        """The token that stands for this one now."""
        at = self
        while at.alias is not None:
            at = at.alias
        while self.alias is not None and self.alias is not at:
            self.alias, self = at, self.alias
        return at


def digest(*parts: object) -> int:
    return int.from_bytes(blake2b("\0".join(map(str, parts)).encode(), digest_size=7).digest())


@lru_cache(1 << 16)
def child_path(parent: int, key: str) -> int:
    return digest(parent, key)


@lru_cache(1 << 14)
def element_key(tag: str, fields: str) -> str:
    """Tag, role, id and classes without digits; ``!`` marks hidden elements."""
    if not fields.strip(" /\n\t"):
        return tag
    found: dict[str, str] = {}
    for m in _FIELD.finditer(fields):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    out = tag
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "").lower()):
        out += "!"
    for mark, field in (("@", "role"), ("#", "id"), (".", "class")):
        for word in found.get(field, "").split():
            out += mark + _DIGITS.sub("", word)
    return out


class Page:
    """Tokens and blocks of one page. ``blocks`` are (text token, text), in page order."""

    def __init__(self, html: str, mute) -> None:
        """``mute`` tells by its key whether an inline element's text is left out."""
        self.tokens: list[Token] = []
        self.blocks: list[tuple[Token, str]] = []
        self.paths: dict[int, tuple[int, str]] = {}
        # open elements: tag, path, first token, shapes of the children and where their tokens begin
        self.stack: list[tuple[str, int, int, list[tuple[int, int]]]] = [("", 0, 0, [])]
        self.count: dict[str, int] = {}
        self.words: list[str] = []
        self.linked = self.link = 0
        self.mute = mute
        self.muted: tuple[str, int, int] | None = None
        self._read(html)
        while len(self.stack) > 1:
            self._close()
        self._flush()

    # -- reading ---------------------------------------------------------------------------------

    def _read(self, html: str) -> None:
        tag = _QUOTED
        at = start = 0
        while (at := html.find("<", at)) >= 0:
            after = html[at + 1:at + 2]
            if after in ("!", "?"):
                self._text(html[start:at])
                end, size = (html.find("-->", at + 4), 3) if html.startswith("<!--", at) else (
                    html.find(">", at), 1)
                if html.startswith(("<!-->", "<!--->"), at):
                    end, size = html.find(">", at), 1
                at = start = len(html) if end < 0 else end + size
                continue
            if not (after.isalpha() or after == "/"):
                at += 1
                continue
            m = tag.match(html, at)
            if m is None and tag is _QUOTED and after.isascii():
                tag = _PLAIN  # a quote that never ends: attributes end at the next bracket from here on
                m = tag.match(html, at)
            if m is None:
                if after == "/" and html[at + 2:at + 3] and not html[at + 2].isalpha():
                    self._text(html[start:at])
                    end = html.find(">", at)
                    at = start = len(html) if end < 0 else end + 1
                    continue
                if html.find(">", at) < 0:
                    if after.isascii() and (after != "/" or html[at + 2:at + 3].isalpha()):
                        self._text(html[start:at])  # a tag that the end of the page cuts off
                        return
                    break
                at += 1
                continue
            self._text(html[start:at])
            at = start = m.end()
            name = m[2].lower()
            if m[1]:
                self._end(name)
                continue
            self._begin(name, m[3])
            if name in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                if end is None:
                    return
                at = start = end.start()
        self._text(html[start:])

    def _text(self, text: str) -> None:
        if not text or self.muted or self.stack[-1][0] in RAW or self.count.get("head"):
            return
        if "&" in text:
            text = unescape(text)
        self.words.append(text)
        if self.linked:
            self.link += len(text)

    def _begin(self, name: str, fields: str) -> None:
        if self.count.get("head") and name not in HEAD:
            while self.count.get("head"):
                self._close()
        if name in ("html", "body", "head"):
            if self.count.get(name):
                return
        elif name in INLINE:
            if name == "br":
                self.words.append(" ")
            elif name == "a":
                self.linked = 1
            if name not in VOID:
                if self.muted:
                    if self.muted[0] == name:
                        self.muted = (name, self.muted[1] + 1, self.muted[2])
                elif fields and self.mute(element_key(name, fields)):
                    self.muted = (name, 1, len(self.stack))
            return
        self._flush()
        if self.stack[-1][0] == "p":
            self._close()
        if name in IMPLIED:
            closed, within = IMPLIED[name]
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in within:
                    break
                if self.stack[k][0] in closed:
                    while len(self.stack) > k:
                        self._close()
        if name in VOID:
            return
        key = element_key(name, fields)
        path = child_path(self.stack[-1][1], key)
        self.paths[path] = (self.stack[-1][1], key)
        self.stack.append((name, path, len(self.tokens), []))
        self.count[name] = self.count.get(name, 0) + 1
        self.tokens.append(Token(OPEN, path))

    def _end(self, name: str) -> None:
        if name in INLINE:
            if name == "a":
                self.linked = 0
            if self.muted and self.muted[0] == name:
                self.muted = (name, self.muted[1] - 1, self.muted[2]) if self.muted[1] > 1 else None
            return
        self._flush()
        if name in ("html", "body") or not self.count.get(name):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == name:
                while len(self.stack) > k:
                    self._close()
                return
            if self.stack[k][0] in TABLE and name not in TABLE:
                return

    # -- tokens ----------------------------------------------------------------------------------

    def _flush(self) -> None:
        if not self.words:
            return
        text = " ".join("".join(self.words).split())
        link, self.link = min(self.link, len(text)), 0
        self.words = []
        if not text or self.stack[-1][0] in RAW:
            return
        path = self.stack[-1][1]
        token = Token(TEXT, path, pages=1, n=1, chars=len(text), link=link, const=digest(text))
        self.blocks.append((token, text))
        shapes = self.stack[-1][3]
        shapes.append((path * 3 + TEXT, len(self.tokens)))
        self.tokens.append(token)
        self._fold(shapes)

    def _close(self) -> None:
        self._flush()
        self.linked = 0
        name, path, start, shapes = self.stack.pop()
        self.count[name] -= 1
        if self.muted and self.muted[2] > len(self.stack):
            self.muted = None
        if not shapes:
            del self.tokens[start:]
            return
        self.tokens.append(Token(CLOSE, path))
        around = self.stack[-1][3]
        around.append((digest(path, *(s for s, _ in shapes)), start))
        key = self.paths[path][1]
        if name in LISTED or len(key) > len(name):
            self._fold(around)

    def _fold(self, shapes: list[tuple[int, int]]) -> None:
        """Merge the last group of children into an equal one right before it."""
        for k in range(1, min(MAX_PERIOD, len(shapes) // 2) + 1):
            if shapes[-1][0] == shapes[-1 - k][0] and all(
                    shapes[-i][0] == shapes[-i - k][0] for i in range(2, k + 1)):
                first, second = shapes[-2 * k][1], shapes[-k][1]
                for a, b in zip(self.tokens[first:second], self.tokens[second:], strict=True):
                    a.absorb(b, same_page=True)
                    a.rep = 1
                del self.tokens[second:], shapes[-k:]
                return
