"""A generalised LL recogniser on a graph-structured stack.

Grammars are context-free and may be ambiguous or left-recursive. Every call of
a nonterminal at a position is one node of the stack graph, shared by all
callers; its ends are told to the callers that come later. One token of
lookahead picks the alternatives, so deterministic parts of a grammar cost one
step per symbol.

Dialects run together: ``together`` makes their start symbols alternatives of
one start symbol. Rules that dialects have in common are one nonterminal, so
they share its stack nodes, and a parse ends as soon as one dialect is through.

A bracketed part of a text derives from a nonterminal or it does not, whatever
surrounds it. So each distinct part is a shared node too, kept between texts:
it stands as one symbol in the part around it, and is parsed for a nonterminal
only when a parse asks for that.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_GRAMMAR = re.compile(r"\s*(?:(#[^\n]*)|(?P<name>[A-Za-z_]\w*)|'(?P<token>(?:[^'\\]|\\.)+)'|(?P<mark>[:;|()*+?@]))")
#: The end of a statement: a semicolon, or nothing where a line or block ends.
EOS = "EOS"
END = "\0end"
Rules = dict[str, list[list[str]]]
#: Tokens of the kept parts of texts, before they are forgotten.
MAX_KEPT = 1_500_000
#: Nesting from which parts are parsed from the innermost outwards, not when they are asked for.
DEEP = 120


def read_rules(text: str) -> Rules:
    """The rules of a grammar; helper rules are named after what they stand for.

    Notation: ``name: part part | part ;`` with quotes around tokens, round
    brackets, ``*``, ``+``, ``?``, and ``@`` for a comma list that may end in a
    comma. A name in capitals without a rule is a class of tokens.
    """
    tokens = [m for m in _GRAMMAR.finditer(text) if not m[1]]
    rules: Rules = {}
    at = 0

    def helper(name: str, alternatives: list[list[str]]) -> str:
        rules.setdefault(name, alternatives)
        return name

    def choice() -> list[list[str]]:
        nonlocal at
        out, row = [], []
        while at < len(tokens):
            t = tokens[at]
            if t["mark"] in (";", ")"):
                break
            at += 1
            if t["mark"] == "|":
                out.append(row)
                row = []
                continue
            if t["mark"] == "(":
                inner = choice()
                at += 1
                part = inner[0][0] if len(inner) == 1 and len(inner[0]) == 1 else helper("&(" + " | ".join(" ".join(r) for r in inner) + ")", inner)
            else:
                part = t["name"] or "'" + t["token"].replace("\\'", "'").replace("\\\\", "\\")
            while at < len(tokens) and tokens[at]["mark"] in ("*", "+", "?", "@"):
                mark = tokens[at]["mark"]
                at += 1
                if mark == "?":
                    part = helper(f"&{part}?", [[part], []])
                elif mark == "@":
                    # One token tells how a comma goes on: an item, or the end.
                    rest, after = f"&{part}@rest", f"&{part}@after"
                    helper(rest, [["',", after], []])
                    helper(after, [[part, rest], []])
                    part = helper(f"&{part}@", [[part, rest]])
                else:
                    many = helper(f"&{part}*", [[part, f"&{part}*"], []])
                    part = many if mark == "*" else helper(f"&{part}+", [[part, many]])
            row.append(part)
        out.append(row)
        return out

    while at < len(tokens):
        name = tokens[at]["name"]
        at += 2
        rules[name] = choice()
        at += 1
    return rules


def reachable(rules: Rules, start: str) -> Rules:
    """The rules that a start symbol needs."""
    todo, found = [start], {}
    while todo:
        name = todo.pop()
        if name not in found:
            found[name] = rules[name]
            todo += [p for row in rules[name] for p in row if p in rules]
    return found


def together(dialects: dict[str, Rules], start: str = "file") -> Rules:
    """One grammar whose start symbol has a dialect's start symbol as each alternative.

    A rule is shared by dialects in which it and all that it leads to are equal.
    """
    out: Rules = {}
    starts = []
    done: list[tuple[Rules, dict[str, str]]] = []
    for dialect, every in dialects.items():
        rules = reachable(every, start)
        name_of = {n: f"{n}~{dialect}" for n in rules}
        for other, their in done:
            same = {n for n in rules if other.get(n) == rules[n]}
            while True:
                less = {n for n in same if all(p in same for row in rules[n] for p in row if p in rules)}
                if less == same:
                    break
                same = less
            name_of |= {n: their[n] for n in same if name_of[n] == f"{n}~{dialect}"}
        for n, alternatives in rules.items():
            out.setdefault(name_of[n], [[name_of.get(p, p) for p in row] for row in alternatives])
        starts.append(name_of[start])
        done.append((rules, name_of))
    out[start] = [[s] for s in dict.fromkeys(starts)]
    return out


class Grammar:
    """Compiled rules.

    ``brackets`` pairs the tokens that stand in balance in every rule; what
    they enclose becomes one symbol. ``lines`` names, for a start symbol or a
    rule that is a bracketed list, the nonterminal that each piece of the list
    derives from; ``cut`` says where such a list falls apart. If ``exact``, a
    list is one only if each of its pieces is; else the whole list decides where
    a piece is rejected.
    """

    def __init__(
        self, rules: str | Rules, start: str, brackets: Iterable[tuple[str, str]] = (), lines: dict[str, str] | None = None, cut: Callable | None = None, exact: bool = False
    ):
        self.rules: Rules = dict(read_rules(rules) if isinstance(rules, str) else rules)
        self.brackets = dict(brackets)
        self.enclosed: set[str] = set()
        if self.brackets:
            self._enclose()
        self.terminals: dict[str, int] = {END: 0}
        names = list(self.rules)
        number = {n: -1 - i for i, n in enumerate(names)}
        plain: dict[str, str] = {}
        for alternatives in self.rules.values():
            for parts in alternatives:
                for p in parts:
                    if p not in number and p not in self.terminals and p != EOS:
                        if p[0] != "'" and not p.isupper():
                            raise ValueError(f"{p} has no rule")
                        bare = p[1:] if p[0] == "'" else p
                        if plain.setdefault(bare, p) != p:
                            raise ValueError(f"{bare} is both a token and a class of tokens")
                        self.terminals[p] = len(self.terminals)
        self.token_of = {bare: self.terminals[p] for bare, p in plain.items()} | {END: 0}
        self.semicolon = self.token_of.get(";", -1)
        self.brace = self.token_of.get("}", -1)
        self.start = number[start]
        self.width = len(names) + 2
        first, nullable, follow = self._sets(start)
        term = {v: k for k, v in self.terminals.items()}
        # One flat list of symbols; an alternative is the index of its first one.
        self.kind: list[int] = []
        self.arg: list[int] = []
        self.predict: dict[int, dict[int, list[int]]] = {}
        for name in names:
            table: dict[int, list[int]] = {}
            for parts in self.rules[name]:
                at = len(self.kind)
                for p in parts:
                    self.kind.append(3 if p == EOS else 1 if p in self.terminals else 4 if p in self.enclosed else 2)
                    self.arg.append(0 if p == EOS else self.terminals[p] if p in self.terminals else number[p])
                self.kind.append(0)
                self.arg.append(0)
                begins, empty = self._first_of(parts, first, nullable)
                if empty:
                    begins = begins | follow[name]
                for k in term:
                    if term[k] in begins:
                        table.setdefault(k, []).append(at)
            self.predict[number[name]] = table
        self.close_of = {self.token_of[a]: self.token_of[b] for a, b in self.brackets.items() if a in self.token_of}
        self.closes = set(self.close_of.values())
        #: Inside these brackets no line's end is the end of a statement.
        self.even = {self.token_of[a] for a in ("(", "[", "${") if a in self.token_of}
        self.enclosed_by = {o: [number[n] for n in self.enclosed if self.terminals[self.rules[n][0][0]] == o] for o in self.close_of}
        self.lines = {number[n]: number[s] for n, s in (lines or {}).items() if n in self.enclosed}
        firsts = [p for row in self.rules[start] for p in row] if start not in (lines or {}) else [start]
        self.starts = [number[lines[n]] for n in firsts] if lines and all(n in lines for n in firsts) else []
        self.edges = set(self.close_of) | self.closes
        self.cut, self.exact = cut, exact
        self.forget()

    def forget(self) -> None:
        self.parts: list[tuple] = [()]
        self.number_of: dict[tuple, int] = {}
        self.memory: dict[int, bool] = {}
        self.kept = 0

    def _enclose(self) -> None:
        """Make each bracketed part of a rule a nonterminal of its own."""
        bare = lambda p: p[1:] if p[0] == "'" else p
        closers = set(self.brackets.values())

        def rework(parts: list[str], whole: bool) -> list[str]:
            out: list[str] = []
            at = 0
            while at < len(parts):
                p = parts[at]
                if p not in self.rules and p != EOS and bare(p) in self.brackets:
                    stop, depth = at, 0
                    while stop < len(parts):
                        q = parts[stop]
                        if q not in self.rules and q != EOS:
                            depth += (bare(q) in self.brackets) - (bare(q) in closers)
                            if not depth:
                                break
                        stop += 1
                    if depth or bare(parts[stop]) != self.brackets[bare(p)]:
                        raise ValueError(f"brackets of {' '.join(parts)} are not in balance")
                    part = [p, *rework(parts[at + 1 : stop], False), parts[stop]]
                    if whole and at == 0 and stop == len(parts) - 1:
                        return part
                    name = "<" + " ".join(part) + ">"
                    self.rules.setdefault(name, [part])
                    self.enclosed.add(name)
                    out.append(name)
                    at = stop + 1
                    continue
                if p not in self.rules and p != EOS and bare(p) in closers:
                    raise ValueError(f"brackets of {' '.join(parts)} are not in balance")
                out.append(p)
                at += 1
            return out

        for name in list(self.rules):
            alternatives = self.rules[name]
            whole = len(alternatives) == 1
            self.rules[name] = [rework(parts, whole) for parts in alternatives]
            parts = self.rules[name][0]
            if whole and parts and parts[0] not in self.rules and parts[0] != EOS and bare(parts[0]) in self.brackets:
                self.enclosed.add(name)

    # -- lookahead --

    def _first_of(self, parts: list[str], first: dict, nullable: set) -> tuple[set, bool]:
        out: set[str] = set()
        for p in parts:
            if p == EOS:
                out.add("';")
                continue
            if p in self.rules:
                out |= first[p]
                if p not in nullable:
                    return out, False
            else:
                out.add(p)
                return out, False
        return out, True

    def _sets(self, start: str) -> tuple[dict, set, dict]:
        nullable: set[str] = set()
        first: dict[str, set[str]] = {n: set() for n in self.rules}
        follow: dict[str, set[str]] = {n: set() for n in self.rules}
        follow[start].add(END)
        changed = True
        while changed:
            changed = False
            for name, alternatives in self.rules.items():
                for parts in alternatives:
                    begins, empty = self._first_of(parts, first, nullable)
                    if not begins <= first[name]:
                        first[name] |= begins
                        changed = True
                    if empty and name not in nullable:
                        nullable.add(name)
                        changed = True
        # Every nonterminal may also be parsed by itself, as a statement of a list.
        for name in follow:
            follow[name].add(END)
        changed = True
        while changed:
            changed = False
            for name, alternatives in self.rules.items():
                for parts in alternatives:
                    for i, p in enumerate(parts):
                        if p in self.rules:
                            rest, empty = self._first_of(parts[i + 1 :], first, nullable)
                            add = rest | (follow[name] if empty else set())
                            if not add <= follow[p]:
                                follow[p] |= add
                                changed = True
        return first, nullable, follow

    # -- recognition --

    def parse(self, kinds: list[str], fresh: list[bool] | None = None) -> int:
        """-1 if the tokens are a sentence, else the index of the token that stopped every parse.

        ``fresh`` marks the tokens that begin a line. Where brackets enclose
        parts, these count as one token.
        """
        if self.kept > MAX_KEPT:
            self.forget()
        token_of = self.token_of
        try:
            words = [token_of[k] for k in kinds]
        except KeyError:
            return next(i for i, k in enumerate(kinds) if k not in token_of)
        if not self.close_of:
            return self._run(self.start, (*words, 0), None, fresh)
        folded = self._fold(words, fresh)
        if folded is None:
            return 0
        words, parts, marks = folded
        if self.starts:
            return -1 if any(self._listed(s, words, parts, marks, 0, len(words)) for s in self.starts) else 0
        return -1 if self._derives(self.start, self._number(words, parts, marks)) else 0

    def _number(self, words, parts, fresh) -> int:
        """The number of a sequence of tokens among the kept ones."""
        key = (*words, 0), (*parts, 0), None if fresh is None else (*fresh, False)
        number = self.number_of.get(key)
        if number is None:
            number = self.number_of[key] = len(self.parts)
            self.parts.append(key)
            self.kept += len(words)
        return number

    def _fold(self, words: list[int], fresh: list[bool] | None) -> tuple[list, list, list | None] | None:
        """The tokens outside all brackets, each bracketed part as one; None if brackets do not match."""
        close_of, closes, even, edges = self.close_of, self.closes, self.even, self.edges
        w: list[int] = []
        p: list[int] = []
        f: list[bool] = []
        stack: list[tuple] = []
        made: list[tuple[int, int]] = []
        deepest = last = 0
        for k in [k for k, word in enumerate(words) if word in edges]:
            word = words[k]
            if last < k:
                w += words[last:k]
                p += (0,) * (k - last)
                if fresh:
                    f += fresh[last:k]
            last = k + 1
            if word in close_of:
                stack.append((w, p, f, word, fresh[k] if fresh else False))
                if len(stack) > deepest:
                    deepest = len(stack)
                w, p, f = [word], [0], [False]
            else:
                if not stack or close_of[stack[-1][3]] != word:
                    return None
                w += (word, 0)
                p += (0, 0)
                outer_w, outer_p, outer_f, opened, first = stack.pop()
                if fresh and opened not in even:
                    f += (False, False)
                    key = (tuple(w), tuple(p), tuple(f))
                else:
                    key = (tuple(w), tuple(p), None)
                number = self.number_of.get(key)
                if number is None:
                    number = self.number_of[key] = len(self.parts)
                    self.parts.append(key)
                    self.kept += len(w)
                w, p, f = outer_w, outer_p, outer_f
                w.append(opened)
                p.append(number)
                f.append(first)
                made.append((opened, number))
        if stack:
            return None
        w += words[last:]
        p += (0,) * (len(words) - last)
        if fresh:
            f += fresh[last:]
        if deepest > DEEP:
            for opened, number in made:
                for name in self.enclosed_by[opened]:
                    self._derives(name, number)
        return w, p, f if fresh else None

    def _derives(self, name: int, number: int) -> bool:
        """Whether a kept sequence of tokens derives from a nonterminal."""
        key = number * self.width - name
        found = self.memory.get(key)
        if found is None:
            words, parts, fresh = self.parts[number]
            item = self.lines.get(name)
            found = item is not None and self._listed(item, words, parts, fresh, 1, len(words) - 2)
            if not found and (item is None or not self.exact):
                found = self._run(name, words, parts, fresh) < 0
            self.memory[key] = found
        return found

    def _listed(self, item: int, words, parts, fresh, begin: int, end: int) -> bool:
        """Whether tokens are a list, piece by piece; each distinct piece is parsed once."""
        pieces = list(self.cut(self, words, parts, fresh, begin, end))
        if all(self._derives(item, self._number(words[a:b], parts[a:b], None if fresh is None else fresh[a:b])) for a, b in pieces):
            return True
        # Where pieces may belong together, the whole decides.
        return not self.exact and begin == 0 and self._derives(item, self._number(words, parts, fresh))

    def _run(self, start: int, words, parts, fresh) -> int:
        n = len(words) - 1
        code_kind, code_arg, predict = self.kind, self.arg, self.predict
        semicolon, brace, width, derives, memory = self.semicolon, self.brace, self.width, self._derives, self.memory
        # A node of the stack graph: callers, ends.
        root: tuple[list, set] = ([], set())
        nodes: dict[int, tuple[list, set]] = {-start: root}
        todo: list[tuple[int, tuple, int]] = [(a, root, 0) for a in reversed(predict[start].get(words[0], ()))]
        seen: set[tuple[int, int, int]] = set()
        links: set[tuple[int, int, int]] = set()
        furthest = 0
        while todo:
            slot, node, i = todo.pop()
            while True:
                kind = code_kind[slot]
                if kind == 1:
                    if words[i] == code_arg[slot]:
                        i += 1
                        slot += 1
                        if i > furthest:
                            furthest = i
                        continue
                    break
                if kind == 2:
                    name = code_arg[slot]
                    slot += 1
                    key = i * width - name
                    called = nodes.get(key)
                    if called is None:
                        options = predict[name].get(words[i])
                        if not options:
                            break
                        called = nodes[key] = ([(slot, node)], set())
                        for other in options[:0:-1]:
                            todo.append((other, called, i))
                        slot, node = options[0], called
                        continue
                    callers, ends = called
                    link = (key, slot, id(node))
                    if link not in links and not (callers and callers[0][0] == slot and callers[0][1] is node):
                        links.add(link)
                        callers.append((slot, node))
                        for e in ends:
                            mark = (slot, id(node), e)
                            if mark not in seen:
                                seen.add(mark)
                                todo.append((slot, node, e))
                    break
                if kind == 4:
                    number = parts[i]
                    if not number:
                        break
                    name = code_arg[slot]
                    found = memory.get(number * width - name)
                    if found if found is not None else derives(name, number):
                        i += 1
                        slot += 1
                        if i > furthest:
                            furthest = i
                        continue
                    break
                if kind == 0:
                    callers, ends = node
                    if i in ends:
                        break
                    ends.add(i)
                    if node is root and i == n:
                        return -1
                    for s, c in callers:
                        mark = (s, id(c), i)
                        if mark not in seen:
                            seen.add(mark)
                            todo.append((s, c, i))
                    break
                # The end of a statement.
                if words[i] == semicolon:
                    i += 1
                    slot += 1
                    if i > furthest:
                        furthest = i
                    continue
                if i == n or words[i] == brace or (fresh is not None and fresh[i]):
                    slot += 1
                    continue
                break
        return furthest
