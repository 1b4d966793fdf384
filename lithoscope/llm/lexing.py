"""Name-literal pairs of source and configuration syntax, with constants propagated through names.

The lexer reads heads (a name and what assigns to it) and the values that follow them:

* statements of source code: ``x = v``, ``x := v``, ``'x' => v``, ``x: type = v``, ``x[] = v``, ``c["x"] = v``, ``f("x", v)``;
* JSON, YAML and INI: ``"x": v``, ``x: v``, lists, block scalars, items, sections, ``x v`` on a line of its own;
* command lines: ``--x=v``, ``-x=v``, ``--x v``; XML elements and attributes.

Values are concatenations of strings (with prefixes, triple quotes and escapes), bare words and names, or lists.
Strings next to each other or joined by an operator are one literal.  A name in a value stands for its latest earlier
assignment that leads to a literal, or the next later one, in the same function or around it.  Pairs in comments are
read as well, but nothing is propagated into or out of them.

A pair's names are its own and, where that says no more than "value", the key, section or element around it or the
name beside it (``name: x, value: v``).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
_QUOTED = r'''"""(?:[^"\\]+|\\.|"(?!""))*+"""|\'\'\'(?:[^'\\]+|\\.|'(?!\'\'))*+\'\'\'|"(?:[^"\\\n]+|\\.)*+"|'(?:[^'\\\n]+|\\.)*+'|`[^`\n]*`'''
_BARE = r"[A-Za-z0-9_$][A-Za-z0-9+/_.=\-$]*"
#: Names that say nothing about their value; names whose value is the name of the value beside them.
VALUE_NAMES, NAMING_NAMES = {"value", "val", "data", "default", "content", "text", "string", "raw", "plain"}, {"name", "key", "id"}
#: Calls with these parts look a value up instead of stating it.
_LOOKUP = re.compile(r"get|env|input|read|prompt|ask|lookup|fetch|load|find|len|hash|param|config|vault|random|generate", re.IGNORECASE)

_TERM = re.compile(rf"(?P<quoted>(?P<prefix>[rbfuRBFU]{{0,2}})(?P<string>{_QUOTED}))|(?P<bare>{_BARE})", re.ASCII | re.DOTALL)
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.?|&)[ \t]*(?:\\?\r?\n[ \t]*)?(?=[\"'`A-Za-z0-9_$])|[ \t]*(?:\\\r?\n)?[ \t]*(?=[\"'])")
_TYPE = r"[A-Za-z_][A-Za-z0-9_.\[\]|?*&<>]*(?:[ \t][A-Za-z0-9_.\[\]|?*&<>]+)?"
_TOKEN = re.compile(
    rf"""(?P<block>/\*(?:[^*]+|\*(?!/))*+(?:\*/|\Z)|<!--(?:[^-]+|-(?!->))*+(?:-->|\Z))
    |(?P<line>(?:(?<=[\x20\t\n])|\A)(?:\#(?!!)|//)[^\n]*|(?:(?<=\n)|\A)[\x20\t]*;[^\n]*)
    |(?P<function>\b(?:def|function|func|fn|sub|proc)\b)
    |(?P<section>(?:(?<=\n)|\A)[\x20\t]*\[[\x20\t]*(?P<section_name>{NAME})[\x20\t]*\][\x20\t]*(?=\r?\n|\Z))
    |(?P<element><(?P<element_name>{NAME})(?:[\x20\t][^<>\n]*)?>(?P<element_value>[^<>\n]+)</(?P=element_name)>)
    |(?P<open>\{{)|(?P<close>\}})
    |(?<![A-Za-z0-9_.\-])["'`]?(?P<name>{NAME})["'`]?\]?(?:\[[0-9]*\])?(?:[\x20\t]+string(?=[\x20\t]*=))?[\x20\t]*(?P<op>:=|=>|=(?![=~])|:[\x20\t]*{_TYPE}[\x20\t]*=(?![=>~])|:(?![:=]))
    |\([\x20\t]*(?P<quote>["'])(?P<argument>{NAME})(?P=quote)[\x20\t]*,""",
    re.ASCII | re.VERBOSE,
)
_OPTION = re.compile(rf"(?<![A-Za-z0-9_.\-])--?(?P<name>{NAME})(?:=|(?P<space>[ \t]+))(?=[\"'`A-Za-z0-9_$])", re.ASCII)
_SPACED = re.compile(rf"^[ \t]*(?:machine[ \t]+\S+[ \t]+)?(?:(?:login|user)[ \t]+\S+[ \t]+)?(?P<name>{NAME})[ \t]+(?P<value>[^\s=:]\S*)[ \t]*\r?$", re.ASCII | re.MULTILINE)
_HEAD = re.compile(r"[ \t]*(?:=>|:=|=(?![=~])|:(?![:=]))")
_WORDS = re.compile(NAME, re.ASCII)
_COMMA = re.compile(r"[ \t\r\n]*,[ \t\r\n]*")
_NEXT_STRING = re.compile(r"[ \t\r\n]*(?=[\"'])")
_WHITE, _LEAD = re.compile(r"[ \t]*"), re.compile(r"[ \t\-]*")
_MARKER = re.compile(r"<!--|/\*+|//+|\s*[#;]+")
_LINE_END = re.compile(r"[ \t]*\r?\n")
_OPENED = re.compile(rf"<({NAME})[^<>]*>\s*\Z", re.ASCII)
_BLOCK_SCALAR = re.compile(r"[ \t]*[|>][+\-0-9]{0,2}[ \t]*\r?\n")
_ITEM = re.compile(rf"[ \t]*-[ \t]+(?:(?P<quoted>{_QUOTED})|(?P<bare>[^\s\"'#:\[\]{{}}][^\s:]*))[ \t]*(?:\r?\n|\Z)", re.ASCII | re.DOTALL)
_PLAIN_NAME = re.compile(rf"\$?\{{?({NAME})\}}?\Z", re.ASCII)


class Pair(NamedTuple):
    """A name, the names around it, and its value: literals as lists of spans that are joined, and other names."""

    name: str
    around: tuple[str, ...]
    literals: list[list[tuple[int, int]]]
    names: list[str]
    place: int
    scope: list[float]  # from where to where the name is known
    comment: bool
    spaced: bool = False


def _inside(m: re.Match) -> list[tuple[int, int]]:
    """The spans within a string's quotes; a triple-quoted one has a span for each line."""
    string, a, b = m["string"], m.start("string"), m.end("string")
    width = 3 if string[:3] in ('"""', "'''") and len(string) >= 6 else 1
    return _lines(m.string, a + width, b - width) if width == 3 else [(a + 1, b - 1)]


def _lines(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The lines between two places, without white space around them."""
    out = []
    while a < b:
        end = text.find("\n", a, b)
        end = b if end < 0 else end
        line = text[a:end]
        if line.strip():
            out.append((a + len(line) - len(line.lstrip()), a + len(line.rstrip())))
        a = end + 1
    return out


def _value(text: str, at: int, end: int) -> tuple[list[list[tuple[int, int]]], list[str], int]:
    """Literals, names and the end of the value that begins at a place."""
    literals: list[list[tuple[int, int]]] = []
    names: list[str] = []
    joined: list[tuple[int, int]] = []
    brackets = False
    while at < end and text[at] in " \t([":
        brackets |= text[at] != " " and text[at] != "\t"
        at += 1
    while True:
        while brackets and at < end and text[at] in " \t\r\n":
            at += 1
        m = _TERM.match(text, at, end)
        if not m:
            break
        at = m.end()
        if m["quoted"]:
            spans = _inside(m)
            if len(spans) > 1:
                literals += [[s] for s in spans]
            else:
                joined += spans
        else:
            word = m["bare"]
            if _HEAD.match(text, at, end):  # the next pair's name
                at = m.start()
                break
            after = text[at : at + 1]
            if after == "(":
                if _LOOKUP.search(word):
                    break
                at += 1
                brackets = True
                continue
            plain = _PLAIN_NAME.match(word)
            if plain:
                names.append(plain[1])
            if not plain or after not in ("[", "{"):
                literals.append([m.span()])
        join = _JOIN.match(text, at, end) or (brackets and m["quoted"] and _NEXT_STRING.match(text, at, end))
        if join and (m["quoted"] or "+" in join[0]):
            at = join.end()
            continue
        if joined:
            literals.append(joined)
            joined = []
        comma = _COMMA.match(text, at, end) if brackets else None
        if not comma:
            break
        at = comma.end()
    if joined:
        literals.append(joined)
    return literals, names, at


def _block(text: str, indent: int, at: int, end: int) -> tuple[list[tuple[int, int]], int] | None:
    """The lines of a YAML block scalar, or the values of items, after the head of a line with that indent; and where they end."""
    scalar = _BLOCK_SCALAR.match(text, at, end)
    if scalar:
        stop = scalar.end()
        while stop < end:
            after = text.find("\n", stop, end)
            after = end if after < 0 else after + 1
            line = text[stop:after]
            if line.strip() and len(line) - len(line.lstrip(" \t")) <= indent:
                break
            stop = after
        return _lines(text, scalar.end(), stop), stop
    items, begin = [], _LINE_END.match(text, at, end)
    stop = begin.end() if begin else at
    while begin and (item := _ITEM.match(text, stop, end)):
        if len(item[0]) - len(item[0].lstrip(" \t")) < indent:
            break
        kind = "quoted" if item["quoted"] else "bare"
        cut = 1 if kind == "quoted" else 0
        items.append((item.start(kind) + cut, item.end(kind) - cut))
        stop = item.end()
    return (items, stop) if items else None


def pairs_of(text: str, at: int = 0, end: int | None = None, comment: bool = False) -> list[Pair]:
    """All pairs between two places, in the order of their heads."""
    end = len(text) if end is None else end
    out: list[Pair] = []
    section: tuple[str, ...] = ()
    braces: list[tuple[str | None, bool]] = []  # the key and whether a function's body begins
    scope: list[list[float]] = [[0, math.inf]]
    indented: list[tuple[int, int, str]] = []  # indent, kind (0: a function of indented lines, 1: a key), name
    function = False
    line = text.rfind("\n", 0, at) + 1  # where the line begins that holds the last token
    last: str | None = None  # the name of a head without value
    beside: str | None = None  # the literal of a naming head just before
    begin = seen = at
    while m := _TOKEN.search(text, at, end):
        line = max(line, text.rfind("\n", seen, m.start()) + 1)
        seen, at = m.start(), m.end()
        if m["block"] is not None or m["line"] is not None:
            inner = _MARKER.match(text, m.start()).end()
            if comment:
                at = inner
            else:
                out += pairs_of(text, inner, m.end(), True)
            continue
        if m["open"]:
            body = function
            if body:
                scope.append([m.start(), math.inf])
            braces.append((last, body))
            function, last = False, None
            continue
        if m["close"]:
            if braces and braces.pop()[1] and len(scope) > 1:
                scope.pop()[1] = m.start()
            beside = None
            continue
        indent = _WHITE.match(text, line).end() - line
        first = _LEAD.match(text, line).end() >= m.start()
        if first:
            while indented and indented[-1][0] >= indent:
                if indented.pop()[1] == 0 and len(scope) > 1:
                    scope.pop()[1] = m.start()
        if m["function"] is not None:
            stop = text.find("\n", at, end)
            if text[max(at, (end if stop < 0 else stop) - 80) : end if stop < 0 else stop].rstrip().endswith(":"):
                scope.append([m.start(), math.inf])
                indented.append((indent, 0, ""))
            else:
                function = True
            continue
        if m["section"] is not None:
            section = (m["section_name"],)
            continue
        around = tuple(k for k, _ in braces[-2:] if k) or tuple(k for _, kind, k in indented[-2:] if kind) or section
        if m["element"] is not None:
            opened = _OPENED.search(text, max(begin, text.rfind("<", begin, m.start())), m.start())
            out.append(Pair(m["element_name"], (opened[1],) if opened else around, [[m.span("element_value")]], [], m.start(), scope[-1], comment))
            continue
        name = m["argument"] or m["name"]
        block = _block(text, indent, at, end) if m["op"] == ":" and first else None
        if block:
            literals, names, at = [[s] for s in block[0]], [], block[1]
        else:
            literals, names, after = _value(text, at, end)
            if not literals and not names:
                last = name
                if m["op"] == ":" and first:
                    indented.append((indent, 1, name))
                continue
            at = after
        last = None
        low = name.lower()
        if beside and low in VALUE_NAMES:
            around = (beside,)
        out.append(Pair(name, around, literals, names, m.start(), scope[-1], comment))
        if m["op"] and len(m["op"]) > 2:  # "x: y = v": a type, or a name of its own
            out.append(Pair(_WORDS.findall(m["op"])[-1], (), literals, names, m.start(), scope[-1], comment))
        beside = text[slice(*literals[0][0])] if low in NAMING_NAMES and len(literals) == 1 and len(literals[0]) == 1 else None
    return out


def options_of(text: str) -> list[Pair]:
    """Options of command lines wherever they stand, inside strings too, and lines of a name and one word."""
    out = []
    if "-" in text:
        for m in _OPTION.finditer(text):
            literals, names, _ = _value(text, m.end(), len(text))
            if literals:
                out.append(Pair(m["name"], (), literals[:1], names, m.start(), [0, math.inf], False, bool(m["space"])))
    for m in _SPACED.finditer(text):
        a, b = m.span("value")
        if b - a > 2 and text[a] in "\"'" and text[b - 1] == text[a]:
            a, b = a + 1, b - 1
        out.append(Pair(m["name"], (), [[(a, b)]], [], m.start(), [0, math.inf], False, True))
    return out


def propagated(pairs: list[Pair], score) -> list[float]:
    """For each pair the score of its most sensitive name, or of a pair that takes its constant, directly or through others.

    Pairs are in the order of their places.
    """
    reach = [score(p) for p in pairs]
    defined: dict[str, list[int]] = {}
    users: dict[str, list[int]] = {}
    for i, p in enumerate(pairs):
        if not p.comment:
            defined.setdefault(p.name, []).append(i)
            for other in p.names:
                users.setdefault(other, []).append(i)
    visible = lambda j, i: pairs[j].scope[0] <= pairs[i].place < pairs[j].scope[1]
    quoted = [any(x for x in p.literals) and not (p.names and all(n in defined for n in p.names) and len(p.literals) <= len(p.names)) for p in pairs]
    # What leads to a literal: forth in the order of places, or only with the help of later assignments.
    forth: dict[str, list[int]] = {}
    grounded = [False] * len(pairs)

    def latest(places: list[int], i: int) -> int | None:
        return next((places[k] for k in range(bisect_left(places, i) - 1, -1, -1) if visible(places[k], i)), None)

    def next_later(places: list[int], i: int) -> int | None:
        return next((places[k] for k in range(bisect_right(places, i), len(places)) if visible(places[k], i)), None)

    for i, p in enumerate(pairs):
        if not p.comment and (quoted[i] or any(latest(forth.get(n, []), i) is not None for n in p.names)):
            grounded[i] = True
            forth.setdefault(p.name, []).append(i)
    waiting = [i for i, g in enumerate(grounded) if g]
    while waiting:
        j = waiting.pop()
        for i in users.get(pairs[j].name, ()):
            if not grounded[i] and visible(j, i):
                grounded[i] = True
                waiting.append(i)
    back = {name: [i for i in places if grounded[i]] for name, places in defined.items()}

    def source(name: str, i: int) -> int | None:
        for places in (forth.get(name, []), back.get(name, [])):
            for found in (latest(places, i), next_later(places, i)):
                if found is not None:
                    return found
        return None

    settled: set[int] = set()
    for target in sorted(range(len(pairs)), key=lambda i: -reach[i]):
        if pairs[target].comment or not pairs[target].names or reach[target] <= 0:
            continue
        waiting = [target]
        while waiting:
            i = waiting.pop()
            if i in settled:
                continue
            settled.add(i)
            reach[i] = max(reach[i], reach[target])
            for other in pairs[i].names:
                j = source(other, i)
                if j is not None:
                    waiting.append(j)
    return reach
