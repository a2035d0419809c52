"""Lexers: text to token kinds. An unknown or unclosed piece becomes the kind BAD."""

from __future__ import annotations

import re

#: Kinds, and for some languages whether each token begins a line.
Tokens = tuple[list[str], list[bool]]
BAD = "BAD"


def _words(text: str) -> set[str]:
    return set(text.split())


#: Lines whose tokens a worker keeps, by language.
MAX_LINES = 300_000
_LINES: dict[tuple, dict] = {}
#: Lines of equal tokens share one list of them.
_SHAPES: dict[tuple, tuple] = {}


def _lines_of(*key: object) -> dict:
    """The tokens of the lines that stand for themselves."""
    known = _LINES.setdefault(key, {})
    if len(known) > MAX_LINES or len(_SHAPES) > MAX_LINES:
        known.clear()
        _SHAPES.clear()
    return known


def _shared(shape: tuple) -> tuple:
    return _SHAPES.setdefault(shape, shape)


# ---- JSON ------------------------------------------------------------------

_JSON = re.compile(
    r'[ \t\r\n\ufeff]+|(?P<STR>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<NUM>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(?P<word>true|false|null)(?!\w)|(?P<mark>[{}\[\],:])|(?P<bad>.)',
    re.S,
)


def json_tokens(text: str) -> Tokens:
    kinds = []
    for m in _JSON.finditer(text):
        g = m.lastgroup
        if g:
            kinds.append(BAD if g == "bad" else g if g in ("STR", "NUM") else m[0])
    return kinds, []


# ---- TOML ------------------------------------------------------------------

_TOML = re.compile(
    r'(?:[ \t]+|#[^\n]*)+|(?P<NL>\r?\n)|(?P<MLSTR>"""(?:[^"\\]|\\.|"(?!""))*"""+|\'\'\'(?:[^\']|\'(?!\'\'))*\'\'\'+)|(?P<STR>"(?:[^"\\\n]|\\[^\n])*"|\'[^\'\n]*\')'
    r"|(?P<NUM>[+-]?(?:0x[\da-fA-F_]+|0o[0-7_]+|0b[01_]+|inf|nan|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d)?(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d)?(?:\.\d+)?|(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d+)?))(?![\w.\-])"
    r"|(?P<BOOL>true|false)(?![\w\-])|(?P<BARE>[A-Za-z0-9_\-]+)|(?P<mark>[=\[\]{},.])|(?P<bad>.)",
    re.S,
)


def toml_tokens(text: str) -> Tokens:
    kinds = []
    for m in _TOML.finditer(text.lstrip("\ufeff")):
        g = m.lastgroup
        if g:
            kinds.append(BAD if g == "bad" else m[0] if g == "mark" else g)
    kinds.append("NL")
    return kinds, []


# ---- Python ----------------------------------------------------------------

_PY_KEYS = _words(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
)
#: Words with a meaning in some places or dialects only.
PY_SOFT = frozenset(("match", "case", "type", "_"))
_PREFIX = r"(?:[rRbBuUfFtT]|[rR][bBfFtT]|[bBfFtT][rR])?"
_F_PREFIX = r"(?:[fFtT][rR]?|[rR][fFtT])"
#: Between the braces of a formatted string anything may stand, quotes and line ends included.
_F_BODY = r"(?:[^%s\\\n{]|\\.|\{\{|\{(?:[^{}]|\{[^{}]*\})*\})*"
_PY = re.compile(
    r"(?:[ \t\f]+|\\\r?\n|#[^\n]*)*(?:(?P<word>[^\W\d]\w*(?![\w\"']))|(?P<mark>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|==|!=|<=|>=|<<|>>|\*\*|//|[-+*/%@&|^~<>()\[\]{},:;=]|\.(?!\d))|(?P<NL>\r?\n)"
    rf"|(?P<STR>{_F_PREFIX}(?:(?!\"\"\")\"{_F_BODY % '\"'}\"(?!\")|(?!''')'{_F_BODY % "'"}'(?!'))|{_PREFIX}(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|(?!\"\"\")\"(?:[^\"\\\n]|\\.)*\"|(?!''')'(?:[^'\\\n]|\\.)*'))"
    r"|(?P<NUM>(?:0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))(?![\w])"
    r"|(?P<name>[^\W\d]\w*)|(?P<bad>.))?",
    re.S,
)
_PY_INDENT = re.compile(r"[ \t\f]*")
_OPENS, _CLOSES = frozenset("([{"), frozenset(")]}")


def python_tokens(text: str, soft: frozenset[str] = PY_SOFT) -> Tokens:
    kinds: list[str] = []
    put = kinds.append
    stack, depth, begin = [0], 0, True
    text = text.lstrip("﻿")
    at, n = 0, len(text)
    match = _PY.match
    own = _PY_KEYS | soft
    known = _lines_of("python", soft)
    first = stop = -1
    line = None
    while at < n:
        if begin and not depth:
            # Blank and comment lines have no indentation of their own.
            m = _PY_INDENT.match(text, at)
            end = m.end()
            if end < n and text[end] in "\r\n#":
                stop = text.find("\n", end)
                at = n if stop < 0 else stop + 1
                continue
            if end >= n:
                break
            width = len(m[0].expandtabs(8)) if end > at else 0
            if width > stack[-1]:
                stack.append(width)
                put("INDENT")
            while width < stack[-1]:
                stack.pop()
                put("DEDENT")
            if width != stack[-1]:
                put(BAD)
                stack.append(width)
            at, begin = end, False
            # A line that holds whole tokens and closes its brackets is read once.
            stop = text.find("\n", end)
            line = text[end:stop] if stop >= 0 else None
            held = known.get(line) if line else None
            if held:
                kinds += held
                at, begin = stop + 1, True
                continue
            first = len(kinds) if line and '"""' not in line and "'''" not in line and line.count("{") == line.count("}") else -1
        m = match(text, at)
        g = m.lastgroup
        at = m.end()
        if g == "word" or g == "name":
            w = m[g]
            put(w if w in own else "ID")
        elif g == "mark":
            w = m["mark"]
            if w in _OPENS:
                depth += 1
            elif w in _CLOSES and depth:
                depth -= 1
            put(w)
        elif g == "NL":
            if not depth:
                put("NEWLINE")
                begin = True
                if first >= 0 and at == stop + 1:
                    known[line] = _shared(tuple(kinds[first:]))
        elif g:
            put(BAD if g == "bad" else g)
    if kinds and kinds[-1] != "NEWLINE" and not depth:
        put("NEWLINE")
    kinds += ["DEDENT"] * (len(stack) - 1)
    return kinds, []


# ---- JavaScript, TypeScript, Java ------------------------------------------

JS_KEYS = _words(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum"
)
JS_SOFT = _words("let static async of get set from as await yield type interface namespace module declare abstract readonly keyof infer is asserts satisfies implements public private protected override unique accessor out global require")
_C_MARKS = r"\.\.\.|=>|\?\?=|\*\*=|<<=|&&=|\|\|=|===|!==|\?\?|\?\.(?!\d)|\*\*|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|==|!=|<=|>=|<<|&&|\|\||->|::|[-+*/%&|^~<>()\[\]{},:.;=?!@#]"
_JS = re.compile(
    r"((?:[ \t\f\v ﻿]+|[\r\n  ]+|//[^\n]*|/\*.*?\*/|<!--[^\n]*)*)(?:(?P<word>(?:[^\W\d]|[$_\\])[\w$\\]*)|(?P<STR>\"(?:[^\"\\\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\n]|\\(?:\r\n|.))*')"
    rf"|(?P<NUM>(?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)n?)(?![\w$])|(?P<tick>`)|(?P<mark>{_C_MARKS})|(?P<bad>.))?",
    re.S,
)
_LINE_END = re.compile(r"[\r\n  ]")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*")
_VALUE_ENDS = _words("ID NUM STR REGEX TPL ) ] } this super null true false ++ --") | {"`end"} | JS_SOFT


_NOT_ALONE = (None, None, 0)
_SPANS_LINES = re.compile(r"`|/\*|\*/|^\s*/(?!/)|\\\r?$|<!--|[\r\u2028\u2029](?!$)")


def _script_line(line: str) -> tuple[tuple, tuple, int]:
    """Tokens of a line, which of them begin it, and how many more braces open than close."""
    if _SPANS_LINES.search(line):
        return _NOT_ALONE
    kinds: list[str] = []
    at, n, depth = 0, len(line), 0
    match, own = _JS.match, JS_KEYS | JS_SOFT
    while at < n:
        m = match(line, at)
        g = m.lastgroup
        at = m.end()
        if g is None:
            break
        if g == "word":
            w = m["word"]
            kinds.append(w if w in own else "ID")
            continue
        if g == "mark":
            w = m["mark"]
            depth += (w == "{") - (w == "}")
            if w[0] == "/" and kinds and kinds[-1] not in _VALUE_ENDS:
                literal = _REGEX.match(line, at - len(w))
                if literal:
                    w, at = "REGEX", literal.end()
            kinds.append(w)
            continue
        kinds.append(BAD if g == "bad" else g)
    return _shared((tuple(kinds), (True, *(False,) * (len(kinds) - 1)) if kinds else (), depth)) if kinds else ((), (), 0)


def script_tokens(text: str) -> Tokens:
    """Tokens of JavaScript and TypeScript. A template is `start ... ${ ... }$ ... `end."""
    kinds: list[str] = []
    fresh: list[bool] = []
    at, n, newline = 0, len(text), True
    templates: list[int] = []  # brace depth at which each open substitution ends
    depth = 0
    if text.startswith("#!"):
        at = text.find("\n")
        at = n if at < 0 else at
    match, own = _JS.match, JS_KEYS | JS_SOFT

    def template(where: int) -> int:
        """Read template characters up to a substitution or the end."""
        i = _TEMPLATE.match(text, where).end()
        ends = text.startswith("`", i)
        kinds.append("`end" if ends else "${" if text.startswith("${", i) else BAD)
        fresh.append(False)
        if ends:
            return i + 1
        templates.append(depth)
        return min(n, i + 2)

    known = _lines_of("script")
    at_line = at == 0 or text.startswith("\n", at)
    while at < n:
        if at_line or text[at] == "\n":
            at += not at_line
            at_line = False
            newline = True
            # Outside templates, a line of whole tokens is read once.
            while not templates:
                stop = text.find("\n", at)
                line = text[at:stop] if stop >= 0 else text[at:]
                held = known.get(line)
                if held is None:
                    held = known[line] = _script_line(line)
                if held is _NOT_ALONE:
                    break
                if held[0]:
                    kinds += held[0]
                    fresh += held[1]
                depth += held[2]
                at = stop + 1 if stop >= 0 else n
                if at >= n:
                    break
            if at >= n:
                break
        m = match(text, at)
        gap, g = m[1], m.lastgroup
        at = m.end()
        if gap and gap != " ":
            newline = newline or bool(_LINE_END.search(gap))
        if g == "word":
            w = m["word"]
            kinds.append(w if w in own else "ID")
        elif g == "mark":
            w = m["mark"]
            if w == "{":
                depth += 1
            elif w == "}":
                if templates and templates[-1] == depth:
                    templates.pop()
                    kinds.append("}$")
                    fresh.append(newline)
                    newline = False
                    at = template(at)
                    continue
                depth -= 1
            elif w[0] == "/" and (not kinds or kinds[-1] not in _VALUE_ENDS):
                literal = _REGEX.match(text, at - len(w))
                if literal:
                    w, at = "REGEX", literal.end()
            kinds.append(w)
        elif g == "tick":
            kinds.append("`start")
            fresh.append(newline)
            newline = False
            at = template(at)
            continue
        elif g is None:
            break
        else:
            kinds.append(BAD if g == "bad" else g)
        fresh.append(newline)
        newline = False
    return kinds, fresh


_JAVA_KEYS = _words(
    "abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null var record yield sealed permits when non open module requires transitive exports opens to uses provides with"
)
_JAVA = re.compile(
    rf"(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<STR>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\[^\n]{{1,6}})')|(?P<NUM>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)[lLfFdD]?)(?![\w$])|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<mark>{_C_MARKS})|(?P<bad>.)",
    re.S,
)


def java_tokens(text: str) -> Tokens:
    kinds = []
    for m in _JAVA.finditer(text.lstrip("\ufeff")):
        g = m.lastgroup
        if g != "space":
            kinds.append((m[0] if m[0] in _JAVA_KEYS else "ID") if g == "word" else m[0] if g == "mark" else BAD if g == "bad" else g)
    return kinds, []


# ---- SQL -------------------------------------------------------------------

#: Words that no dialect takes for a name.
SQL_RESERVED = frozenset(
    "SELECT FROM WHERE GROUP ORDER BY HAVING LIMIT JOIN INNER LEFT RIGHT FULL OUTER CROSS NATURAL ON USING AS AND OR NOT NULL CASE WHEN THEN ELSE END CREATE TABLE INSERT INTO VALUES UNION INTERSECT EXCEPT ALL DISTINCT IN IS BETWEEN LIKE ILIKE EXISTS UPDATE SET DELETE WITH ASC DESC CAST TRUE FALSE FETCH DEFAULT".split()
)
_SQL = re.compile(
    r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<STR>[eEbBxXnN]?'(?:[^']|'')*'|(?P<tag>\$\w*\$).*?(?P=tag))|(?P<ID>\"(?:[^\"]|\"\")+\"|`[^`]+`|\[[A-Za-z_][\w ]*\]|[^\W\d][\w$]*)|(?P<NUM>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<PARAM>[:@$?%]\w+|\?)|(?P<run>[<>=|]{4,})|(?P<mark>::|\|\||<=|>=|<>|!=|->>|->|=>|[-+*/%=<>(),.;\[\]^&|~#:@!])|(?P<bad>.)",
    re.S,
)


def sql_tokens(text: str, words: frozenset[str] = SQL_RESERVED) -> Tokens:
    """Tokens; those of ``words`` are kinds of their own, whatever their case."""
    kinds = []
    for m in _SQL.finditer(text.lstrip("\ufeff")):
        g = m.lastgroup
        if g == "tag":
            g = "STR"
        if g == "space":
            continue
        if g == "ID":
            w = m[0].upper()
            kinds.append(w if w in words else "ID")
        else:
            kinds.append(m[0] if g == "mark" else BAD if g in ("bad", "run") else g)
    return kinds, []


# ---- shell -----------------------------------------------------------------

_SH_KEYS = _words("if then else elif fi for while until do done case esac in function select { } ! time")
_SH_OPS = re.compile(r"&&|\|\||;;&|;;|;&|\|&|[;&|()]")
_SH_REDIR = re.compile(r"(?:\d+|\{\w+\})?(?:<<<|<<-?|<>|>>|>\||>&|<&|&>>|&>|<|>)")


class _Shell:
    def __init__(self, text: str):
        self.text, self.n = text, len(text)

    def quoted(self, at: int) -> int:
        """End of a double-quoted string whose contents begin at ``at``; -1 if unclosed."""
        t, n = self.text, self.n
        while at < n:
            c = t[at]
            if c == '"':
                return at + 1
            if c == "\\":
                at += 2
            elif c == "`":
                at = self.ticks(at + 1)
            elif c == "$" and t[at + 1 : at + 2] in ("(", "{"):
                at = self.nested(at + 1)
            else:
                at += 1
            if at < 0:
                return -1
        return -1

    def ticks(self, at: int) -> int:
        while at < self.n:
            if self.text[at] == "`":
                return at + 1
            at += 2 if self.text[at] == "\\" else 1
        return -1

    def nested(self, at: int) -> int:
        """End of a bracket that opens at ``at``, strings and nested brackets skipped."""
        t, n = self.text, self.n
        stack = []
        pairs = {"(": ")", "{": "}"}
        while at < n:
            c = t[at]
            if c in pairs:
                stack.append(pairs[c])
            elif stack and c == stack[-1]:
                stack.pop()
                if not stack:
                    return at + 1
            elif c == "\\":
                at += 1
            elif c == "'":
                if stack[-1] == ")":
                    at = t.find("'", at + 1)
                    if at < 0:
                        return -1
            elif c == '"':
                at = self.quoted(at + 1) - 1
                if at < 0:
                    return -1
            elif c == "#" and stack[-1] == ")" and t[at - 1] in " \t\n;":
                stop = t.find("\n", at)
                at = n if stop < 0 else stop
            at += 1
        return -1

    def word(self, at: int) -> int:
        """End of the word that begins at ``at``; -1 if a quote in it is unclosed."""
        t, n = self.text, self.n
        begin = at
        while at < n:
            c = t[at]
            if c in " \t\r\n;&|<>":
                break
            if c == ")":
                break
            if c == "(":
                if at > begin and (t[at - 1] == "=" or t[at - 1] in "?*+@!" and at - begin >= 1):
                    at = self.nested(at)
                    if at < 0:
                        return -1
                    continue
                break
            if c == "\\":
                at += 2
            elif c == "'":
                at = t.find("'", at + 1) + 1
                if at == 0:
                    return -1
            elif c == '"':
                at = self.quoted(at + 1)
            elif c == "`":
                at = self.ticks(at + 1)
            elif c == "$" and t[at + 1 : at + 2] in ("(", "{"):
                at = self.nested(at + 1)
            elif c == "$" and t[at + 1 : at + 2] == "'":
                at = self.text.find("'", at + 2)
                while at > 0 and t[at - 1] == "\\":
                    at = t.find("'", at + 1)
                at = at + 1 if at >= 0 else -1
            else:
                at += 1
            if at < 0:
                return -1
        return min(at, n)


def shell_tokens(text: str) -> Tokens:
    kinds: list[str] = []
    s = _Shell(text)
    at, n = 0, len(text)
    waiting: list[tuple[str, bool]] = []
    while at < n:
        c = text[at]
        if c in " \t\r":
            at += 1
            continue
        if c == "\\" and text[at + 1 : at + 2] in ("\n", "\r"):
            at += 2
            continue
        if c == "\n":
            kinds.append("NL")
            at += 1
            for mark, tabs in waiting:
                while at < n:
                    stop = text.find("\n", at)
                    stop = n if stop < 0 else stop
                    line = text[at:stop]
                    at = stop + 1
                    if (line.lstrip("\t") if tabs else line).rstrip("\r") == mark:
                        break
                else:
                    kinds.append(BAD)
            waiting = []
            continue
        if c == "#":
            stop = text.find("\n", at)
            at = n if stop < 0 else stop
            continue
        if text.startswith("((", at) and (not kinds or kinds[-1] in ("NL", ";", "&&", "||", "while", "if", "until", "then", "do", "for", "{")):
            stop = s.nested(at)
            kinds.append("WORD" if stop > 0 else BAD)
            at = stop if stop > 0 else n
            continue
        if text.startswith("[[", at) and text[at + 2 : at + 3] in (" ", "\t", "\n"):
            stop = re.compile(r"\s\]\](?=[\s;&|)]|$)").search(text, at)
            kinds.append("WORD" if stop else BAD)
            at = stop.end() if stop else n
            continue
        m = _SH_REDIR.match(text, at)
        if m and not text.startswith(("<(", ">("), at):
            kinds.append("REDIR")
            at = m.end()
            if m[0].endswith(("<<", "<<-")) and not m[0].endswith("<<<"):
                end = s.word(re.compile(r"[ \t]*").match(text, at).end())
                if end > 0:
                    waiting.append((re.sub(r"[\"'\\]", "", text[at:end].strip()), m[0].endswith("-")))
            continue
        m = _SH_OPS.match(text, at)
        if m:
            kinds.append(m[0])
            at = m.end()
            continue
        end = s.nested(at + 1) if text.startswith(("<(", ">("), at) else s.word(at)
        if end <= at:
            kinds.append(BAD)
            break
        w = text[at:end]
        kinds.append(w if w in _SH_KEYS else "WORD")
        at = end
    return kinds, []


# ---- YAML ------------------------------------------------------------------

_Y_SPACE = re.compile(r"(?:[ \t]+|(?<![^\s])#[^\n]*)*")
_Y_STR = re.compile(r"\"(?:[^\"\\]|\\(?:.|\n))*\"|'(?:[^']|'')*'", re.S)
_Y_BLOCK = re.compile(r"[|>][+\-]?\d?[+\-]?[ \t]*(?:#[^\n]*)?\r?$")
_Y_PROPERTY = re.compile(r"(?:[&*][^\s,\[\]{}]+|![^\s,\[\]{}]*)")
_Y_PLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=[^\s,\[\]{}]))(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?![#\s])(?!:(?:\s|$)))*")
_Y_FLOW_PLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=[^\s,\[\]{}]))(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?![#\s,\[\]{}:]))*")


def yaml_tokens(text: str) -> Tokens:
    kinds: list[str] = []
    text = text.lstrip("\ufeff").replace("\r\n", "\n")
    at, n = 0, len(text)
    stack = [-1]

    def put(kind: str, where: int) -> None:
        kinds.append(kind)

    def column(where: int) -> int:
        return where - (text.rfind("\n", 0, where) + 1)

    def flow(where: int) -> int:
        """Tokens of a flow collection, to its closing bracket."""
        depth, i = 0, where
        while i < n:
            c = text[i]
            if c in " \t\n":
                i += 1
            elif c == "#" and text[i - 1] in " \t\n":
                stop = text.find("\n", i)
                i = n if stop < 0 else stop
            elif c in "[{":
                depth += 1
                put(c, i)
                i += 1
            elif c in "]}":
                depth -= 1
                put(c, i)
                i += 1
                if not depth:
                    return i
            elif c == ",":
                put(c, i)
                i += 1
            elif c == ":" and (i + 1 >= n or text[i + 1] in " \t\n,[]{}" or kinds[-1] == "STR"):
                put(":", i)
                i += 1
            elif c in "\"'":
                m = _Y_STR.match(text, i)
                if not m:
                    put(BAD, i)
                    return n
                put("STR", i)
                i = m.end()
            elif c in "&*!":
                m = _Y_PROPERTY.match(text, i)
                put("STR" if c == "*" else "PROP", i)
                i = m.end() if m else i + 1
            else:
                m = _Y_FLOW_PLAIN.match(text, i)
                if not m:
                    put(BAD, i)
                    return n
                put("STR", i)
                i = m.end()
        put(BAD, n)
        return n

    while at < n:
        stop = text.find("\n", at)
        stop = n if stop < 0 else stop
        line = text[at:stop]
        bare = line.strip()
        if not bare or bare.startswith("#"):
            at = stop + 1
            continue
        if line.startswith(("---", "...")) and (len(line) == 3 or line[3] in " \t"):
            while len(stack) > 1:
                stack.pop()
                put("DED", at)
            put("DOC", at)
            rest = line[3:].strip()
            if rest and not rest.startswith("#"):
                text = text[:at] + "   " + text[at + 3 :]
            else:
                at = stop + 1
            continue
        if line.startswith("%"):
            at = stop + 1
            continue
        lead = len(line) - len(line.lstrip(" "))
        if line[lead] == "\t":
            put(BAD, at)
        while stack[-1] > lead:
            stack.pop()
            put("DED", at)
        if lead > stack[-1]:
            stack.append(lead)
            put("IND", at)
        i = at + lead
        # The pieces of one logical line.
        while i < n:
            i = _Y_SPACE.match(text, i).end()
            if i >= n or text[i] == "\n":
                break
            c = text[i]
            if c in "-?" and (i + 1 >= n or text[i + 1] in " \t\n") and (not kinds or kinds[-1] in ("IND", "DED", "NL", "-", "DOC")):
                put("-" if c == "-" else "?", i)
                j = _Y_SPACE.match(text, i + 1).end()
                i = j
                if i < n and text[i] != "\n":
                    stack.append(column(i))
                    put("IND", i)
                continue
            if c in "|>" and _Y_BLOCK.match(text, i, text.find("\n", i) if text.find("\n", i) >= 0 else n):
                put("STR", i)
                stop = text.find("\n", i)
                i = n if stop < 0 else stop
                floor = stack[-1]
                while i < n:
                    j = text.find("\n", i + 1)
                    j = n if j < 0 else j
                    body = text[i + 1 : j]
                    if body.strip() and len(body) - len(body.lstrip(" ")) <= floor:
                        break
                    i = j
                break
            if c in "[{":
                i = flow(i)
                continue
            if c in "\"'":
                m = _Y_STR.match(text, i)
                if not m:
                    put(BAD, i)
                    i = n
                    break
                put("STR", i)
                i = m.end()
                continue
            if c in "&!":
                m = _Y_PROPERTY.match(text, i)
                put("PROP", i)
                i = m.end()
                continue
            if c == "*":
                m = _Y_PROPERTY.match(text, i)
                put("STR", i)
                i = m.end() if m else i + 1
                continue
            if c == ":" and (i + 1 >= n or text[i + 1] in " \t\n"):
                put(":", i)
                i += 1
                continue
            m = _Y_PLAIN.match(text, i)
            if not m or m.end() == i:
                # A plain scalar may go on with any character on its next lines.
                if kinds and kinds[-1] in ("NL", "IND") and "STR" in kinds[-3:-1] + kinds[-2:]:
                    m = re.compile(r"(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?![#\s])(?!:(?:\s|$)))+").match(text, i)
                if not m or m.end() == i:
                    put(BAD, i)
                    i += 1
                    continue
            put("STR", i)
            i = m.end()
        put("NL", min(i, n))
        stop = text.find("\n", i)
        at = n if stop < 0 else stop + 1
    while len(stack) > 1:
        stack.pop()
        put("DED", n)
    return kinds, []
