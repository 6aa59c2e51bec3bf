"""Declared symbols of languages whose blocks stand in braces.

Comments and strings are blanked, then one pass keeps a stack of open blocks.  What stands before a block's brace (its header) tells by the
language's rules whether it is a symbol of its own, a scope that names its members' parent, or neither; blocks that are symbols are not
looked into.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

ATOM, CLASS, SCOPE, PART = "atom", "class", "scope", "part"


class Symbol(NamedTuple):
    """first and last are lines; start and end the characters that it covers."""

    first: int
    last: int
    name: str | None
    kind: str
    parent: str | None
    start: int
    end: int


# Which declarations are symbols, of which kind, and which ones name the parent of what they hold.
_WORDS = "export|default|declare|abstract|async|public|private|protected|internal|static|final|sealed|override|virtual|open|data|value|inline|unsafe|partial|readonly|fileprivate|mutating|suspend|inner|companion|synchronized|native|extern|const|required|convenience|operator|infix|tailrec|constexpr|explicit|friend"
_BEFORE = rf"^[ \t]*(?:(?:@[\w.]+(?:\([^()]*\))?|\[[^\[\]]*\]|(?:{_WORDS})\b|pub(?:\([^()]*\))?(?=\s))\s*)*"
_NAME = r"(?P<name>[\w$]+)"
_TYPED = r"(?:[\w<>\[\],.?:~]+(?:[ \t]*<[^;{}=()]*>)?[\s*&]+)*?"
_METHOD = (rf"{_TYPED}(?P<name>~?\w+)\s*\(", "method", ATOM)
_TYPE_WORDS = lambda words, kind, role: (rf"(?:{words})\s+{_NAME}", kind, role)
_SCRIPT = [
    _TYPE_WORDS("class", "class", CLASS), _TYPE_WORDS("namespace|module", None, SCOPE), _TYPE_WORDS("interface", "interface", ATOM), _TYPE_WORDS("enum", "enum", ATOM),
    (rf"function\s*\*?\s*{_NAME}", "function", ATOM), (rf"type\s+{_NAME}[^=;{{}}]*=", "type", ATOM), (rf"(?:(?:get|set)\s+|\*\s*)?(?P<name>#?[\w$]+)\??\s*(?:<[^(){{}}]*>)?\s*\(", "method", ATOM),
]
RULES: dict[str, list[tuple[str, str | None, str]]] = {
    "typescript": _SCRIPT, "tsx": _SCRIPT, "javascript": _SCRIPT,
    "go": [(rf"func\s+\([^()]*\)\s*{_NAME}", "method", ATOM), (rf"func\s+{_NAME}", "function", ATOM), (rf"type\s+(?:\(\s*)?{_NAME}", "type", ATOM)],
    "rust": [(rf"(?:extern\s+)?fn\s+{_NAME}", "function", ATOM), _TYPE_WORDS("struct|union", "struct", ATOM), _TYPE_WORDS("enum", "enum", ATOM), _TYPE_WORDS("trait", "interface", ATOM), _TYPE_WORDS("type", "type", ATOM), _TYPE_WORDS("mod", None, SCOPE), (r"impl\b", None, SCOPE)],
    "java": [_TYPE_WORDS("class|record", None, SCOPE), (rf"@interface\s+{_NAME}", "type", ATOM), _TYPE_WORDS("interface", "interface", ATOM), _TYPE_WORDS("enum", "enum", ATOM), _METHOD],
    "c_sharp": [
        (r"namespace\s+(?P<name>[\w.]+)", None, SCOPE), _TYPE_WORDS("class", None, SCOPE), _TYPE_WORDS("interface", "interface", ATOM), _TYPE_WORDS(r"record(?:\s+(?:class|struct))?", "class", ATOM), _TYPE_WORDS("struct", "struct", ATOM),
        _TYPE_WORDS("enum", "enum", ATOM), (rf"delegate\s+{_TYPED}(?P<name>\w+)\s*\(", "type", ATOM), _METHOD, (r"[\w<>\[\],.?]+\s+(?P<name>\w+)\s*(?:\Z|=>)", "field", ATOM),
    ],
    "c": [(rf"typedef\b[^;]*?(?P<name>\w+)\s*\Z", "type", ATOM), _TYPE_WORDS("struct|union", "struct", ATOM), _TYPE_WORDS("enum", "enum", ATOM), (rf"{_TYPED}(?P<name>\w+)\s*\(", "function", ATOM)],
    "cpp": [
        (rf"using\s+{_NAME}\s*=", "type", ATOM), (rf"typedef\b[^;]*?(?P<name>\w+)\s*\Z", "type", ATOM), (r"namespace(?:\s+(?P<name>[\w:]+))?", None, SCOPE), _TYPE_WORDS(r"(?:template\s*<[^{}]*>\s*)?enum(?:\s+(?:class|struct))?", "enum", ATOM),
        _TYPE_WORDS("union", "struct", ATOM), _TYPE_WORDS(r"(?:template\s*<[^{}]*>\s*)?(?:class|struct)", None, SCOPE), (rf"(?:template\s*<[^{{}}]*>\s*)?{_TYPED}(?P<name>(?:\w+::)*~?\w+)\s*\(", "function", ATOM),
    ],
    "php": [_TYPE_WORDS("class|trait", None, SCOPE), _TYPE_WORDS("interface", "interface", ATOM), _TYPE_WORDS("enum", "enum", ATOM), (r"namespace\s+(?P<name>[\w\\]+)", None, SCOPE), (rf"function\s+&?\s*{_NAME}", "function", ATOM)],
    "kotlin": [(r"(?:enum\s+|annotation\s+)?(?:class|interface|object)\s*(?P<name>\w+)?", None, SCOPE), (rf"fun\s+(?:<[^<>]*>\s*)?(?:[\w<>?]+\.)?{_NAME}", "function", ATOM), (r"(?P<name>constructor)\s*\(", "method", ATOM)],
    "swift": [_TYPE_WORDS("protocol", "interface", ATOM), _TYPE_WORDS("class|struct|enum|extension|actor", None, SCOPE), (rf"func\s+{_NAME}", "function", ATOM), (r"(?P<name>init|deinit|subscript)\b", "method", ATOM)],
}
#: Declarations that need no block, by what they begin with; they end at a semicolon, or at a line's end where the language has none.
BODILESS = {"typescript": r"type\b|function\b|abstract\b", "rust": r"struct\b|type\b", "go": r"type\b", "c_sharp": r"delegate\b|record\b|abstract\b|.*=>", "java": r"abstract\b|native\b", "c": r"typedef\b", "cpp": r"typedef\b|using\b", "kotlin": r"fun\b", "php": r"abstract\b"}
BODILESS |= {"tsx": BODILESS["typescript"], "javascript": BODILESS["typescript"]}
LINE_ENDED = ("typescript", "tsx", "javascript", "go", "kotlin", "swift")
#: Within a class these are its methods.
METHODS = {"php": "method"}
#: White space, a line that goes on with the one before, and the end of one that is not at its end.
SPACE, GOES_ON, UNFINISHED = re.compile(r"\s*"), re.compile(r"\s*[|&=?:.{]"), re.compile(r"[=|&,(:\[]\s*\Z")
CONTROL = {"if", "for", "while", "switch", "catch", "with", "do", "else", "return", "new", "throw", "try", "foreach", "using", "lock", "match", "when", "guard", "synchronized", "function", "typeof", "sizeof", "super", "this", "await", "yield", "defer", "select", "fixed", "checked", "unless"}

_STRINGS = {
    "rust": r"'(?:\\[^\n]{1,9}?|[^\\'\n])'|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"", "go": r"`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
    "typescript": r"`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "c_sharp": r"@\"(?:\"\"|[^\"])*\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
}
_STRINGS |= {"tsx": _STRINGS["typescript"], "javascript": _STRINGS["typescript"]}
_PLAIN = r"\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
#: Further stretches that are blanked.
_MARKS = {"php": r"#(?!\[)[^\n]*", "c": r"^[ \t]*#[^\n]*", "cpp": r"^[ \t]*(?:#[^\n]*|(?:public|private|protected)[ \t]*:(?!:))"}
_BLANKED = {x: re.compile("|".join([r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", *([_MARKS[x]] if x in _MARKS else []), _STRINGS.get(x, _PLAIN)]), re.S | re.M) for x in RULES}
_RULES = {x: [(re.compile(_BEFORE + pattern, re.M), kind, role, pattern.endswith(r"\(")) for pattern, kind, role in rules] for x, rules in RULES.items()}
_BODILESS = {x: re.compile(_BEFORE + rf"(?:{pattern})", re.M) for x, pattern in BODILESS.items()}


def blanked(source: str, language: str) -> str:
    """The source with comments and strings (and a preprocessor's lines and access labels) as spaces, line ends kept."""
    return _BLANKED[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _declared(header: str, rules) -> tuple[int, str | None, str | None, str] | None:
    """(offset, name, kind, role) of the last declaration that begins a line of a header."""
    found = None
    for pattern, kind, role, any_word in rules:
        for m in pattern.finditer(header):
            name = m.groupdict().get("name")
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            if not (any_word and name in CONTROL) and (found is None or start > found[0]):
                found = (start, name, kind, role)
    return found


def symbols(source: str, language: str) -> list[Symbol]:
    """The symbols of a source in order; a class that is longer than a line stands with its first lines and the characters of all."""
    if language not in RULES:
        return []
    text, rules, bodiless = blanked(source, language), _RULES[language], _BODILESS.get(language)
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(lines, at)
    out: list[Symbol] = []
    blocks: list[tuple[dict | None, str | None, int, int]] = []  # what opened a block, the parent outside it, the round brackets open there, the header's start
    parent, start, rounds, inside = None, 0, 0, 0  # inside: open blocks below a symbol

    begins: tuple[int, bool] = (-1, False)  # for a start, whether a declaration without a block begins there

    def bare(end: int) -> None:
        """What ended here without a block."""
        header = text[start:end]
        if not inside and bodiless and not rounds and bodiless.search(header) and (found := _declared(header, rules)) and found[3] == ATOM:
            first = start + found[0]
            out.append(Symbol(line(first), line(max(first, end - 1)), found[1], METHODS.get(language, found[2]) if parent else found[2], parent, first, end))

    for m in re.finditer(r"[{}();]|\n", text):
        at, mark = m.start(), m[0]
        if mark == "(":
            rounds += 1
        elif mark == ")":
            rounds = max(0, rounds - 1)
        elif mark == "{":
            header = text[start:at]
            opened = None
            if not inside and not rounds and (found := _declared(header, rules)):
                first = start + found[0]
                opened = {"first": first, "name": found[1], "kind": found[2], "role": found[3], "parent": parent, "place": len(out)}
            if opened and opened["kind"] == "type" and header.rstrip()[-1:] in ("=", "|", "&") and language in BODILESS:
                opened["role"] = PART  # a type's right side goes on behind its block
            blocks.append((opened, parent, rounds, start))
            inside += inside > 0 or (opened is not None and opened["role"] in (ATOM, PART))
            parent = opened["name"] or parent if opened and opened["role"] in (CLASS, SCOPE) else parent
            start, rounds = at + 1, 0
        elif mark == "}" and blocks:
            opened, parent, rounds, before = blocks.pop()
            inside = max(0, inside - 1)
            if opened:
                first, last = line(opened["first"]), line(at)
                kind = METHODS.get(language, opened["kind"]) if opened["parent"] and opened["kind"] == "function" else opened["kind"]
                if opened["role"] == ATOM:
                    tail = re.match(r"[^;{}\n]*", text[at + 1 :])[0] if language in ("c", "cpp") and kind == "type" else ""
                    name = (re.findall(r"\w+", tail) or [opened["name"]])[-1]
                    out.append(Symbol(first, last, name, kind, opened["parent"], opened["first"], at + 1))
                elif opened["role"] == CLASS and opened["name"] and last > first:
                    named = line(opened["first"] + text[opened["first"] : at].index(opened["name"]))
                    out.insert(opened["place"], Symbol(first, named, opened["name"], kind, opened["parent"], opened["first"], at + 1))
            # a block within round brackets is a part of its header
            start = before if rounds or (opened and opened["role"] == PART) else at + 1
        elif mark == ";" and not rounds:
            bare(at)
            start = at + 1
        elif mark == "\n" and not rounds and not inside and bodiless and language in LINE_ENDED:
            if begins[0] != start:
                if (head := SPACE.match(text, start).end()) >= at:
                    continue
                begins = (start, bodiless.match(text, max(text.rfind("\n", 0, head) + 1, start)) is not None)
            elif not begins[1]:
                continue
            goes_on = GOES_ON.match(text, at) or UNFINISHED.search(text, max(start, at - 200), at)
            if begins[1] and not goes_on:
                bare(at)
                start = at + 1
            elif not goes_on and _declared(text[start:at], rules) is None:  # some other line; what is declared on the next stands by itself
                start = at + 1
    bare(len(text))
    return out
