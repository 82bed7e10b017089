"""Symbols of a source text with their ranges and parents, by one scan that knows nesting.

``masked`` blanks comments and the insides of strings, templates and patterns, keeping every place, so what is
matched afterwards is code. ``pairs`` matches brackets in one pass. Declarations are then found by the
heads that each language has, and end where their body does: at the matching brace, or, in Python, before
the next line that is indented no further. A text is scanned a fixed number of times whatever it
holds; braces that don't match end at the end of the text.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

SCRIPTS = ("javascript", "typescript", "tsx")
#: Verbs of a route (fixed values).
VERBS = ("get", "post", "put", "delete", "patch", "all", "use", "head", "options")


class Symbol(NamedTuple):
    """Offsets are half open. value: what a variable is set to (arrow, object, call or other)."""

    name: str
    kind: str
    start: int
    end: int
    value: str = ""


_C_STRING = r'"(?:\\.|[^"\\\n])*"'
_CHAR = r"'(?:\\[^\n]{1,10}?|[^'\\\n])'"
_LINE = r"//[^\n]*"
_BLOCK = r"/\*.*?(?:\*/|\Z)"
_MASKED = {
    "script": re.compile(rf"""(?P<drop>{_LINE}|{_BLOCK})|(?P<text>{_C_STRING}|'(?:\\.|[^'\\\n])*')|(?P<tick>`)|(?P<brace>[{{}}])|(?P<slash>/)""", re.S),
    "python": re.compile(r"""(?P<drop>\#[^\n]*)|(?P<text>(?:\"{3}(?:\\.|[^\\])*?(?:\"{3}|\Z))|(?:'{3}(?:\\.|[^\\])*?(?:'{3}|\Z))|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')""", re.S),
    "go": re.compile(rf"(?P<drop>{_LINE}|{_BLOCK})|(?P<text>{_C_STRING}|`[^`]*(?:`|\Z)|{_CHAR})", re.S),
    "rust": re.compile(rf'(?P<drop>{_LINE}|{_BLOCK})|(?P<text>\br(#*)".*?(?:"\3|\Z)|"(?:\\.|[^"\\])*"|{_CHAR})', re.S),
    "java": re.compile(rf'(?P<drop>{_LINE}|{_BLOCK})|(?P<text>"{{3}}.*?(?:"{{3}}|\Z)|{_C_STRING}|{_CHAR})', re.S),
    "c": re.compile(rf'(?P<drop>{_LINE}|{_BLOCK}|^[ \t]*\#(?:\\\n|[^\n])*)|(?P<text>\bR"(\w*)\(.*?(?:\)\3"|\Z)|{_C_STRING}|{_CHAR})', re.S | re.M),
}
_FAMILY = {**dict.fromkeys(SCRIPTS, "script"), "cpp": "c"}
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_VISIBLE = re.compile(r"[^\n]")
#: What a pattern or a function expression may follow (an operator, or one of these words).
_BEFORE_VALUE = re.compile(r"(?:[(,=:\[!&|?{;+\-*%<>~^]|^|\b(?:return|typeof|case|in|of|new|delete|void|throw|await|yield|else|do))\s*\Z")


def _blank(text: str) -> str:
    return _VISIBLE.sub(" ", text)


def masked(text: str, language: str) -> str:
    """text with comments and the insides of strings blank, of the same length and lines."""
    family = _FAMILY.get(language, language)
    rule = _MASKED.get(family)
    if rule is None:
        return text
    out: list[str] = []
    at, templates = 0, []  # braces that are open within each template expression

    def template(at: int) -> int:
        end = _TEMPLATE.match(text, at).end()
        out.append(_blank(text[at:end]))
        if text.startswith("${", end):
            templates.append(0)
            out.append(" {")
            return end + 2
        out.append(text[end : end + 1])
        return end + 1

    while m := rule.search(text, at):
        out.append(text[at : m.start()])
        at, kind = m.end(), m.lastgroup
        if kind == "drop":
            out.append(_blank(m[0]))
        elif kind == "tick":
            out.append("`")
            at = template(at)
        elif kind == "slash":
            hit = _PATTERN.match(text, m.start()) if _BEFORE_VALUE.search("".join(x[-40:] for x in out[-3:])[-40:]) else None
            out.append(_blank(hit[0]) if hit else "/")
            at = hit.end() if hit else at
        elif kind == "brace":
            if m[0] == "}" and templates and templates[-1] == 0:
                templates.pop()
                out.append("}")
                at = template(at)
                continue
            if templates:
                templates[-1] += 1 if m[0] == "{" else -1
            out.append(m[0])
        else:
            out.append(m[0][0] + _blank(m[0][1:-1]) + m[0][-1:] if len(m[0]) > 1 else m[0])
    return "".join(out) + text[at:]


_BRACKET = re.compile(r"[()\[\]{}]")
_CLOSES = {")": "(", "]": "[", "}": "{"}


def pairs(code: str) -> dict[int, int]:
    """The place of the closing bracket of every opening one, and the reverse. A bracket that closes none of
    its kind is passed over; what is open when an outer one closes ends there."""
    out, open_ = {}, []
    for m in _BRACKET.finditer(code):
        c, i = m[0], m.start()
        if c in "([{":
            open_.append((c, i))
        elif any(o == _CLOSES[c] for o, _ in open_[-50:]):
            while open_:
                o, j = open_.pop()
                out[j] = i
                if o == _CLOSES[c]:
                    out[i] = j
                    break
    for _, j in open_:
        out[j] = len(code)
    return out


def _body(code: str, at: int, match: dict[int, int], stops: str = ";") -> tuple[int, int]:
    """(start of the body, its end) of a head that ends at a place: the first brace outside brackets, or
    (-1, place after the stop) if one of ``stops`` comes before."""
    for m in re.compile(rf"[(\[{{}}{stops}]").finditer(code, at):
        i = m.start()
        if i < at:
            continue
        if m[0] in "([":
            at = match.get(i, len(code)) + 1
        elif m[0] == "{":
            return i, min(match.get(i, len(code)) + 1, len(code))
        else:
            return -1, i + 1
    return -1, len(code)


_NAME = r"[A-Za-z_$][\w$]*"
_SCRIPT_HEADS = re.compile(rf"(?<![\w$.#])(?:(?P<f>(?:async\s+)?function)\s+(?P<fn>{_NAME})|(?<!abstract )(?P<c>class)\s+(?P<cn>{_NAME})|(?P<i>interface)\s+(?P<in>{_NAME})|(?P<v>const|let|var)\s+(?=[\w$]))")
_METHOD = re.compile(rf"(?:[;}},]\s*|^\s*)((?:(?:public|private|protected|static|async|readonly|override|abstract|get|set|declare|accessor)\s+|\*\s*)*)(#?{_NAME}|\[[^\]]*\]|(['\"]).*?\3)\s*(?:<[^(){{}}]*>)?\s*\Z")
_VALUE_FUNCTION = re.compile(r"(?:async\s+)?function\b(?!\s*\*)")
_CONTROL = {"if", "for", "while", "switch", "catch", "function", "with", "return"}
_ROUTE = re.compile(rf"\.\s*({'|'.join(VERBS)})\s*\(")


def _arrow(code: str, at: int, match: dict[int, int]) -> bool:
    """Whether an arrow function begins at a place."""
    m = re.compile(r"(?:async\b\s*)?(?:<[^(){}=]*>\s*)?").match(code, at)
    at = m.end()
    if code.startswith("(", at) and at in match:
        return re.compile(r"\s*(?::[^={};]*)?=>").match(code, match[at] + 1) is not None
    return re.compile(rf"{_NAME}\s*=>").match(code, at) is not None


def _value_end(code: str, at: int, match: dict[int, int]) -> int:
    """Where the expression that begins at a place ends: at a separator outside brackets, or at the end of a
    line after which no operator goes on."""
    last = at
    for m in re.compile(r"[(\[{)\]};,\n]|\S").finditer(code, at):
        i, c = m.start(), m[0]
        if i < at:
            continue
        if c in "([{":
            at = match.get(i, len(code)) + 1
            last = min(at, len(code))
        elif c in ")]};,":
            break
        elif c == "\n":
            following = re.compile(r"\s*(\S{1,2})").match(code, i)
            goes_on = following is None or re.match(r"[.?:+*/%&|=<>,(\[]|-|\)|\}|`", following[1]) is not None
            if not goes_on and re.search(r"(?:[-+*/%&|=<>?:.]|=>)\s*\Z", code[max(0, i - 20) : i]) is None and last > at:
                break
        else:
            last = i + 1
    return last


def _callee(code: str, dot: int, match: dict[int, int]) -> int:
    """Where the expression before a dot begins: calls and indexes in a chain, and a leading ``new``."""
    at = dot
    while True:
        while at and code[at - 1].isspace():
            at -= 1
        if at and code[at - 1] in ")]" and match.get(at - 1, at) < at:
            at = match[at - 1]
            continue
        m = re.search(r"[\w$#]+\Z", code[max(0, at - 200) : at])
        if m:
            at -= len(m[0])
        before = code[max(0, at - 200) : at].rstrip()
        if before.endswith("."):
            at = code.rindex(".", 0, at)
            continue
        return code.rindex("new", 0, at) if m and re.search(r"\bnew\Z", before) else at


def _scripts(text: str, code: str, match: dict[int, int]) -> Iterator[Symbol]:
    classes, functions = [], []  # bodies
    heads = []
    for m in _SCRIPT_HEADS.finditer(code):
        if m["f"] or m["c"]:
            expression = _BEFORE_VALUE.search(code[max(0, m.start() - 40) : m.start()]) is not None and not re.search(r"[{};]\s*\Z|\b(?:else|do)\s*\Z|^\s*\Z", code[max(0, m.start() - 40) : m.start()])
            begin, end = _body(code, m.end(), match)
            if begin < 0:
                continue
            (classes if m["c"] else functions).append((begin, end))
            if not expression:
                heads.append(Symbol(m["fn"] or m["cn"], "class" if m["c"] else "function", m.start(), end))
        elif m["i"]:
            begin, end = _body(code, m.end(), match)
            if begin >= 0:
                heads.append(Symbol(m["in"], "interface", m.start(), end))
    yield from heads
    classes = {begin for begin, _ in classes}
    opens = [i for i in sorted(match) if code[i : i + 1] == "{"]
    outer: dict[int, int] = {}  # the brace around each
    stack: list[int] = []
    for i in opens:
        while stack and match[stack[-1]] < i:
            stack.pop()
        outer[i] = stack[-1] if stack else -1
        stack.append(i)
    blocks = set()  # braces of statements
    for i in opens:
        before = code[max(0, i - 300) : i].rstrip()
        value = re.search(r"(?:[=(,:\[?]|&&|\|\||\?\?|\breturn|\.\.\.)\Z", before) is not None and not before.endswith("=>")
        if i not in classes and not value and not re.search(r"(?:\binterface\b[^;{}]*|\b(?:import|export|enum\s+\w+))\Z", before):
            blocks.add(i)
        around = outer[i]
        if around >= 0 and (around in classes or around not in blocks):
            near = max(around + 1, i - 300)
            close = re.search(r"\)\s*(?::[^;{}=()]*(?:\([^()]*\)[^;{}=()]*)*)?\Z", code[near:i])
            if not close:
                continue
            head = match.get(near + close.start())
            if head is None or head <= around:
                continue
            offset = max(around + 1, head - 400)
            m = _METHOD.search(code[offset:head])
            if m and m[2] not in _CONTROL:
                start = offset + (m.start(1) if m[1] else m.start(2))
                name = text[offset + m.start(2) : offset + m.end(2)]
                yield Symbol(name, "method", start, match[i] + 1)
    inside = sorted(blocks)

    def local(at: int) -> bool:
        k = bisect.bisect_left(inside, at) - 1
        i = inside[k] if k >= 0 else -1
        while i >= 0 and match[i] < at:
            i = outer[i]
            while i >= 0 and i not in blocks:
                i = outer[i]
        return i >= 0

    for m in _SCRIPT_HEADS.finditer(code):
        if not m["v"]:
            continue
        exported = re.search(r"\bexport\s+(?:declare\s+)?\Z", code[max(0, m.start() - 40) : m.start()]) is not None
        at = m.end()
        while True:
            d = re.compile(rf"\s*({_NAME})\s*(?::[^=;,]*(?:=>[^=;,]*)*)?=(?![=>])\s*").match(code, at)
            if not d:
                break
            function = _arrow(code, d.end(), match) or _VALUE_FUNCTION.match(code, d.end()) is not None
            end = _value_end(code, d.end(), match)
            body = code[d.end() : end]
            value = "function" if function else "object" if body.startswith("{") else "call" if re.match(rf"{_NAME}[^\s;]*\(", body) and body.rstrip().endswith(")") and not body.startswith(("new ", "await ")) else "other"
            if function or exported or not local(m.start()):
                yield Symbol(d[1], "function" if function else "variable", d.start(1), end, value)
            more = re.compile(r"\s*,").match(code, end)
            if not more:
                break
            at = more.end()
    feeds = [m.start() for m in re.finditer("\n", code)]
    for m in _ROUTE.finditer(code):
        close = match.get(m.end() - 1)
        if close is None:
            continue
        first = _value_end(code, m.end(), match)
        comma = re.compile(r"\s*,\s*").match(code, first)
        if not comma or not (_arrow(code, comma.end(), match) or _VALUE_FUNCTION.match(code, comma.end())):
            continue
        start = _callee(code, m.start(), match)
        given = text[m.end() : first].strip()
        label = f"route_L{bisect.bisect_left(feeds, start) + 1}"
        if len(given) > 2 and given[0] in "'\"" and given[-1] == given[0]:
            label = f"route_{given[1:-1].strip().strip('/').replace('/', '_') or 'root'}"[:100]
        yield Symbol(label, "route_handler", start, min(close + 1, len(code)))


_PYTHON = re.compile(r"^([ \t]*)((?:async\s+)?def|class)\s+([^\W\d]\w*)", re.M)


def _python(code: str, match: dict[int, int]) -> Iterator[Symbol]:
    lines = [m.start() for m in re.finditer(r"^", code, re.M)]
    held = sorted((o, c) for o, c in match.items() if o < c)
    inner = set()  # lines that begin within brackets
    for o, c in held:
        first = bisect.bisect_right(lines, o)
        inner.update(range(first, bisect.bisect_right(lines, c)))
    full = []  # (indent, start, end) of lines that begin a statement
    for k, at in enumerate(lines):
        end = lines[k + 1] - 1 if k + 1 < len(lines) else len(code)
        text = code[at:end]
        if text.strip() and k not in inner:
            full.append((len(text) - len(text.lstrip()), at, end))
    starts = [s for _, s, _ in full]
    open_: list[tuple[int, str, int]] = []  # (indent, kind, end)
    for m in _PYTHON.finditer(code):
        k = bisect.bisect_left(starts, m.start())
        if k >= len(starts) or starts[k] != m.start():
            continue
        indent = len(m[1])
        stop = k + 1
        while stop < len(full) and full[stop][0] > indent:
            stop += 1
        last = full[stop][1] if stop < len(full) else len(code)
        end = m.start() + len(code[m.start() : last].rstrip())
        while open_ and (open_[-1][2] <= m.start() or open_[-1][0] >= indent):
            open_.pop()
        kind = "class" if m[2] == "class" else "method" if open_ and open_[-1][1] == "class" else "function"
        open_.append((indent, "class" if kind == "class" else "function", end))
        yield Symbol(m[3], kind, m.start(2), end)


_GO = re.compile(r"^func\s+(\([^()]*\)\s*)?([A-Za-z_]\w*)|\b([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s+(?:=\s*)?(interface)\s*(?=\{)", re.M)
_RUST = re.compile(r"(?<![\w!])((?:pub(?:\([^()]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*(?:(fn|struct|enum|trait)\s+([A-Za-z_]\w*)|(impl)\b))")
_RUST_KINDS = {"fn": "function", "struct": "class", "enum": "class", "trait": "interface"}
_MODIFIERS = r"(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp|synchronized|native|default|transient|volatile)\s+)*"
_JAVA = re.compile(rf"(?<![\w.@])({_MODIFIERS}(?:(class|interface|enum|record)\s+([A-Za-z_$][\w$]*)))")
_JAVA_METHOD = re.compile(rf"(?<=[;{{}}])\s*(?:@[\w.]+(?:\([^()]*\))?\s+)*({_MODIFIERS}(?:<[^(){{}};]*?>\s*)?(?:([\w$.]+(?:<[^(){{}};=]*>)?(?:\[\])*)\s+)?([A-Za-z_$][\w$]*)\s*)\(")
_C_TYPES = re.compile(r"\b(?:(struct|class|enum)(?:\s+class)?)\s+(?:[A-Z_]+\s+)?([A-Za-z_]\w*)\s*(?:final\s*)?(?::(?!:)[^;{}()]*)?(?=\{)")
_C_FUNCTION = re.compile(r"(?<![\w.>~])((?:[A-Za-z_][\w:<>,]*[\s*&]+)*[*&]*)((?:[A-Za-z_]\w*(?:<[^<>(){};]*>)?::)*(?:~?[A-Za-z_]\w*|operator\s*[^\s\w(]{1,3}))\s*(\()")
_WORDS = {"if", "for", "while", "switch", "catch", "return", "else", "new", "do", "sizeof", "throw", "case", "assert", "synchronized", "try", "record"}


def _go(code: str, match: dict[int, int]) -> Iterator[Symbol]:
    for m in _GO.finditer(code):
        if m[4]:
            begin, end = _body(code, m.end(4), match)
            yield Symbol(m[3], "interface", m.start(4), end)
        else:
            paren = code.find("(", m.end())
            if paren < 0:
                continue
            line = code.find("\n", match.get(paren, len(code)))
            begin, end = _body(code, m.end(), match, "\\n")
            yield Symbol(m[2], "method" if m[1] else "function", m.start(), end if begin >= 0 else line if line >= 0 else len(code))


def _rust(code: str, match: dict[int, int]) -> Iterator[Symbol]:
    for m in _RUST.finditer(code):
        begin, end = _body(code, m.end(), match)
        if m[4]:
            head = re.sub(r"^\s*<[^{}]*?>\s+(?=[A-Za-z&(])", "", code[m.end() : begin]) if begin >= 0 else ""
            head = re.sub(r"\s+", " ", re.split(r"\bwhere\b", head)[0]).strip()
            if head:
                yield Symbol(head, "class", m.start(), end)
        elif begin >= 0 or m[2] != "fn":  # a function without a body is a promise
            yield Symbol(m[3], _RUST_KINDS[m[2]], m.start(), end)


def _java(code: str, match: dict[int, int]) -> Iterator[Symbol]:
    names = set()
    for m in _JAVA.finditer(code):
        begin, end = _body(code, m.end(), match)
        if begin >= 0:
            names.add(m[3])
            yield Symbol(m[3], "interface" if m[2] == "interface" else "class", m.start(), end)
    for m in _JAVA_METHOD.finditer(code):
        shut = match.get(m.end() - 1)
        first = (m[2] or "").split("<")[0]
        if shut is None or m[3] in _WORDS or first in _WORDS or (not m[2] and m[3] not in names):
            continue
        after = re.compile(r"\s*(?:throws\s+[\w.,\s]+?)?\s*([{;])").match(code, shut + 1)
        if after:
            end = match.get(after.start(1), len(code)) + 1 if after[1] == "{" else after.end()
            yield Symbol(m[3], "method", m.start(1), min(end, len(code)))


def _c(code: str, match: dict[int, int]) -> Iterator[Symbol]:
    types = set()
    for m in _C_TYPES.finditer(code):
        types.add(m[2])
        yield Symbol(m[2], "class", m.start(), min(match.get(m.end(), len(code)) + 1, len(code)))
    for m in _C_FUNCTION.finditer(code):
        shut = match.get(m.start(3))
        words, own = set(re.findall(r"\w+", m[1])), m[2].lstrip("~").split("::")[-1].lstrip("~")
        if shut is None or m[2] in _WORDS or words & _WORDS or not (m[1] or own in types or "::" in m[2]):
            continue
        after = re.compile(r"\s*(?:const|noexcept|override|final|&&?|->\s*[\w:<>*&\s]+?|:(?!:)[^;{}]*?)*\s*\{").match(code, shut + 1)
        if after:
            label = re.match(r"(?:\s*(?:public|private|protected)\s*:(?!:))+\s*", m[0])
            yield Symbol(re.sub(r"\s+", "", m[2]), "function", m.start() + (label.end() if label else 0), min(match.get(after.end() - 1, len(code)) + 1, len(code)))


_MODEL = re.compile(r"^model\s+([A-Za-z_][A-Za-z0-9_]*)\s*\{", re.M)


def _prisma(text: str) -> Iterator[Symbol]:
    """Models end with the first line at whose end as many braces are closed as were opened since."""
    for m in _MODEL.finditer(text):
        depth, at = 0, m.start()
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            depth += text.count("{", at, end) - text.count("}", at, end)
            at = end + 1
            if depth <= 0:
                break
        yield Symbol(m[1], "db_model", m.start(), min(at - 1, len(text)))


def symbols(text: str, language: str) -> list[Symbol]:
    """The symbols of a text, in order of start, outer ones first."""
    if language == "prisma":
        return list(_prisma(text))
    code = masked(text, language)
    match = pairs(code)
    family = _FAMILY.get(language, language)
    found = _scripts(text, code, match) if family == "script" else {"python": _python, "go": _go, "rust": _rust, "java": _java, "c": _c}[family](code, match) if family in _MASKED else ()
    held = {s._replace(end=min(max(s.start, s.end), len(text))) for s in found if s.name}
    return sorted(held, key=lambda s: (s.start, -s.end, s.kind, s.name))


_FROM = re.compile(r"\b(?:import|export)\b[^;'\"`(){}]*(?:\{[^{}]*\}[^;'\"`(){}]*)?\bfrom\s*(['\"])|\bimport\s*(['\"])|\brequire\s*\(\s*(['\"])")
_PY_FROM = re.compile(r"^[ \t]*from[ \t]+([.\w]+)[ \t]+import\b", re.M)
_PY_IMPORT = re.compile(r"^[ \t]*import[ \t]+([\w., \t]+)", re.M)
_GO_IMPORT = re.compile(r"^[ \t]*import\s*(?:\(([^()]*)\)|(?:[\w.]+[ \t]+)?(\"[^\"]*\"|`[^`]*`))", re.M)


def imports(text: str, language: str) -> list[str]:
    """What a text imports, once each: module names, paths, and nothing from comments or strings. Of ``import a
    as b`` nothing is taken, as the name isn't used."""
    code = masked(text, language)
    out: dict[str, None] = {}
    if language in SCRIPTS:
        for m in _FROM.finditer(code):
            begin = m.end()
            end = code.find(code[begin - 1], begin)
            if end > begin:
                out[text[begin:end].removeprefix("type ").strip()] = None
    elif language == "python":
        found = [(m.start(), [m[1]]) for m in _PY_FROM.finditer(code)]
        found += [(m.start(), [x.strip() for x in m[1].split(",") if " as " not in x and x.strip()]) for m in _PY_IMPORT.finditer(code)]
        out = dict.fromkeys(x for _, some in sorted(found) for x in some)
    elif language == "go":
        for m in _GO_IMPORT.finditer(code):
            group = 1 if m[1] is not None else 2
            for q in re.finditer(r"\"[^\"]*\"|`[^`]*`", code[m.start(group) : m.end(group)]):
                out[text[m.start(group) + q.start() + 1 : m.start(group) + q.end() - 1]] = None
    return [x for x in out if x and x != "type"]


def parents(found: list[Symbol]) -> list[int]:
    """For each of symbols in order, the place of the narrowest one around it, or -1."""
    out, open_ = [], []
    for i, s in enumerate(found):
        while open_ and found[open_[-1]].end < s.end:
            open_.pop()
        out.append(open_[-1] if open_ and found[open_[-1]].start <= s.start else -1)
        open_.append(i)
    return out
