"""One walk over a page's tags, and element selection over the nodes it gives. Runs inside Arrow workers.

A node is a tag with the text after it. ``end`` is the node behind the element's last one, so an element is an interval of nodes, what
it holds lies within, and an ancestor is an interval around it. End tags and bare texts are nodes without a name. An element
without an end tag ends where its parent does, or where HTML lets it end (``tr td th li p dt dd`` and table sections); an end tag
that closes nothing has no effect. Attributes are read as HTML reads them, whatever characters their values hold.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK_START = ("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav "
               "ol p pre section table ul").split()
CELL = frozenset(("td", "th", "caption"))
TABLE = frozenset(("table",))
TABLE_PARTS = CELL | {"table", "tbody", "thead", "tfoot", "tr"}
# start tag -> (open elements that it ends, elements beyond which it ends none)
IMPLIED_END = {
    "tr": ({"tr"}, {"table"}),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"})),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot"}, {"table"})),
    "li": ({"li"}, {"ul", "ol"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(BLOCK_START, ({"p"}, CELL | {"table", "button"})),
}
VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
ATTRIBUTES = rf"(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+{VALUE}?+)?+|=)*+"
ATTRIBUTE = re.compile(rf"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+({VALUE})?+)?+")
#: Scripts, styles, comments and declarations (no name), or a tag: whether it closes, its name, its attributes.
TAG = re.compile(
    rf"<(?:script|style)(?=[\s/>]){ATTRIBUTES}>.*?(?:</(?:script|style)\s*+>|\Z)|<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</(?![a-zA-Z])[^>]*+>"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})>", re.S | re.I)
STEP = re.compile(r"""([a-z][a-z0-9]*)?(?:\.([\w-]+))?(?:\[([\w:-]+)(?:([*]?=)['"]?([^'"\]]*)['"]?)?\])?""")
BLANKS = "[ \t\n\f\r]+"


def parse_selector(text: str) -> list[list[tuple]]:
    """Alternatives, each a list of steps (tag, class, attribute, operator, value); ValueError if it is not supported."""
    alternatives = []
    for part in re.split(r",(?![^\[]*\])", text):
        steps = []
        for step in re.split(r"\s+(?![^\[]*\])", part.strip()):
            m = STEP.fullmatch(step)
            if not m or not m.group():
                raise ValueError(f"selector not supported: {text!r}")
            steps.append(m.groups(default=""))
        alternatives.append(steps)
    return alternatives


#: Attribute texts, and tags, of which a worker remembers what they say.
REMEMBERED = 10_000
_classes: dict[str, tuple[str, ...]] = {}
_tags: dict[str, tuple] = {}


def attributes_of(raw: str) -> dict[str, str]:
    """Names and values; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        value = value[1:-1] if value[:1] in ('"', "'") else value
        found.setdefault(name.lower(), entities.unescape(value) if "&" in value else value)
    return found


def classes_of(raw: str) -> tuple[str, ...]:
    found = _classes.get(raw)
    if found is None:
        found = tuple(set(re.split(BLANKS, attributes_of(raw).get("class", ""))) - {""})
        if len(_classes) >= REMEMBERED:
            _classes.clear()
        if len(raw) < 200:
            _classes[raw] = found
    return found


def tag_of(m: re.Match) -> tuple:
    """What a tag says by itself: whether it closes, its name, attributes, classes, the elements it ends, whether it holds nothing."""
    slash, name, raw = m.groups()
    name = name.lower() if name else ""
    if name in ("script", "style"):
        name = slash = ""
    raw = raw or ""
    found = (bool(slash), name, raw, classes_of(raw) if name and not slash and raw and "class" in raw.lower() else (),
             IMPLIED_END.get(name) if name and not slash else None, name in VOID)
    if len(_tags) >= REMEMBERED:
        _tags.clear()
    if m.end() - m.start() < 200:
        _tags[m.group()] = found
    return found


class Page:
    """The nodes of one page: name, text, attributes as written, end, and the element's place in the source."""

    def __init__(self, source: str):
        self.source = source
        self.tags: list[str] = []
        self.texts: list[str] = []
        self.raw: list[str] = []
        self.ends: list[int] = []
        self.places: list[tuple[int, int]] = []
        self.by_tag: defaultdict[str, list[int]] = defaultdict(list)
        self.by_class: defaultdict[str, list[int]] = defaultdict(list)
        self._walk()

    def _walk(self) -> None:
        source, by_tag, by_class = self.source, self.by_tag, self.by_class
        matches = list(TAG.finditer(source))
        most = 2 * len(matches) + 2  # each tag, a text between any two that belongs to no tag, and one behind the last
        tags, texts, raws, ends = [""] * most, [""] * most, [""] * most, list(range(1, most + 1))
        places = self.places
        stack: list[str] = []
        begun: list[int] = []
        count = last = 0
        holds = False  # whether there is a node that the next text belongs to
        open_names: dict[str, int] = {}
        known, opened = _tags.get, open_names.get

        def close(depth: int, stop: int) -> None:
            while len(stack) > depth:
                open_names[stack.pop()] -= 1
                at = begun.pop()
                ends[at] = count
                places[at] = places[at][0], stop

        for m in matches:
            begin, stop = span = m.span()
            if begin > last:
                piece = source[last:begin]
                if "&" in piece:
                    piece = entities.unescape(piece)
                if holds:
                    texts[count - 1] += piece
                else:
                    texts[count] = piece
                    places.append((last, last))
                    count += 1
            last = stop
            closes, name, raw, classes, implied, void = known(source[begin:stop]) or tag_of(m)
            if closes:
                if not opened(name):
                    holds = count > 0 and tags[count - 1] not in VOID
                    continue
                depth = len(stack) - 1
                if stack[depth] != name:
                    depth = self._innermost(stack, name, TABLE if name in TABLE_PARTS else CELL)
                    if depth is None:
                        holds = count > 0 and tags[count - 1] not in VOID
                        continue
                    close(depth + 1, begin)
                open_names[stack.pop()] -= 1
                at = begun.pop()
                ends[at] = count
                places[at] = places[at][0], stop
            elif name:
                if implied is not None and any(map(opened, implied[0])):
                    depth = self._implied(stack, *implied)
                    if depth is not None:
                        close(depth, begin)
                by_tag[name].append(count)
                for cls in classes:
                    by_class[cls].append(count)
                if not void:
                    stack.append(name)
                    begun.append(count)
                    open_names[name] = opened(name, 0) + 1
                tags[count] = name
                raws[count] = raw
            places.append(span)
            count += 1
            holds = not void
        if last < len(source):
            piece = entities.unescape(source[last:])
            if holds:
                texts[count - 1] += piece
            else:
                texts[count] = piece
                places.append((last, last))
                count += 1
        close(0, len(source))
        self.tags, self.texts, self.raw, self.ends = tags[:count], texts[:count], raws[:count], ends[:count]

    @staticmethod
    def _innermost(stack: list, name: str, barriers: set) -> int | None:
        """The depth of the innermost open element of that name; None if another one stands between that it must not end."""
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth] == name:
                return depth
            if stack[depth] in barriers:
                return None
        return None

    @staticmethod
    def _implied(stack: list, own: set, outer: set) -> int | None:
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth] in own:
                return depth
            if stack[depth] in outer:
                return None
        return None

    def attributes(self, at: int) -> dict[str, str]:
        return attributes_of(self.raw[at])

    def _meets(self, at: int, step: tuple) -> bool:
        tag, cls, attr, operator, value = step
        if tag and self.tags[at] != tag:
            return False
        if not attr:
            return True
        held = self.attributes(at).get(attr)
        return held is not None and (not operator or (held == value if operator == "=" else value in held))

    def _step(self, step: tuple, first: int, end: int) -> list[int]:
        tag, cls, attr = step[:3]
        if cls or tag:
            places = self.by_class.get(cls) if cls else self.by_tag.get(tag)
            if not places:
                return []
            if places[0] < first or places[-1] >= end:
                places = places[bisect_left(places, first):bisect_left(places, end)]
            if not attr and not (cls and tag):
                return places
        else:
            places = [i for i in range(first, end) if self.tags[i]]
        return [i for i in places if self._meets(i, step)]

    def find(self, selector: list[list[tuple]], first: int = 0, end: int | None = None) -> list[int]:
        """The elements among nodes first to end that meet the selector, in page order, each once."""
        end = len(self.tags) if end is None else end
        lists = [found for steps in selector if (found := self._follow(steps, first, end))]
        if len(lists) == 1:
            return lists[0]
        return sorted(set().union(*lists))

    def _follow(self, steps: list[tuple], first: int, end: int) -> list[int]:
        """The same for one alternative of a selector."""
        if len(steps) == 1:
            return self._step(steps[0], first, end)
        spans = [(first, end)]
        for step in steps[:-1]:
            inner = []
            for a, b in spans:
                until = a
                for i in self._step(step, a, b):
                    if i >= until:  # the outermost elements hold what the others hold
                        until = self.ends[i]
                        inner.append((i + 1, until))
            spans = inner
        return [i for a, b in spans for i in self._step(steps[-1], a, b)]

    def text(self, at: int) -> str:
        return "".join(self.texts[at:self.ends[at]])

    def stripped_text(self, at: int) -> str:
        """The text with every part between two tags stripped by itself."""
        return "".join(t.strip() for t in self.texts[at:self.ends[at]])

    def outer(self, at: int) -> str:
        """The element as it is written on the page."""
        return self.source[slice(*self.places[at])]
