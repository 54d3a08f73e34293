"""Recognising by generalised LL with a graph-structured stack.

A grammar is text: rules "name = alternatives ;" over names, quoted terminals and the
operators | * + ? and parentheses. Each token is one character. A rule becomes an automaton
over terminals and calls of other rules, made deterministic state by state as it is used.
Rules that don't call themselves are written into the automata of those that use them, and a
call in last place is a jump; what remains are the calls in the middle of recursive rules.

A stack node stands for one such call of a rule at one position and is shared by all who call
it there; it keeps who called and where it ended, so ambiguity and left recursion cost no
more than the nodes. Several rules, and so the rules of several dialects, are recognised over
a text together, on one stack. The next character selects the calls that can begin with it.

Bracketed groups are recognised on their own: in the languages here every bracket of a rule
is closed in the same rule, so what is between two brackets derives the same nonterminals
wherever it stands. A group becomes one character, which stands for its bracket and the set
of nonterminals that its inside derives; p.X, b.X and c.X in a rule are a group in (), []
or {} whose inside derives X. Insides repeat, within and across files, so the sets are kept.

A list of statements, members or elements is closed under concatenation: if each of its parts
is recognised alone, so is the list. Only where a part isn't, the whole list is parsed. Both
are exact: the first can only accept what the second accepts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

GROUPS = {"(": "p", "[": "b", "{": "c"}
#: So many results are kept for each grammar, of texts up to so many tokens; then they are made anew.
KEPT, KEPT_LENGTH = 60_000, 2000
#: Characters of groups in () and [], and of groups in {}.
FIRST_GROUP = {"p": 0xF0000, "b": 0xF8000, "c": 0x100000}
TOKEN = re.compile(r"'(?:[^'\\]|\\.)+'|[A-Za-z_][\w.]*|[|*+?()=;]")

#: A part of a rule: ("t", character), ("s", set), ("g", bracket, name), ("n", name), ("seq", parts),
#: ("alt", parts), ("*", part), ("?", part).
Part = tuple


class Grammar:
    def __init__(self, text: str, tokens: dict[str, str], names: dict[str, str]) -> None:
        """tokens: the character of each quoted terminal; names: the characters of each named set of terminals."""
        self.tokens, self.names = tokens, names
        self.rules: dict[str, list[Part]] = {}
        self.wants: dict[str, set[str]] = {g: set() for g in GROUPS.values()}
        self._groups: dict[tuple[str, frozenset], str] = {}
        self.inside: dict[str, tuple[str, frozenset]] = {}
        self._read(text)
        self.nullable = self._nullable()
        self.called = self._called()
        # The automata: for each state of one the symbols that lead on, and the states reached without one.
        self._edges: list[list[tuple[Part, int]]] = []
        self._free: list[list[int]] = []
        self._ends: set[int] = set()
        self._starts: dict[str, int] = {}
        # Deterministic states are sets of these.
        self._sets: dict[frozenset, int] = {}
        self._members: list[frozenset] = []
        self._final: list[bool] = []
        self._steps: list[dict[str, tuple[int, tuple]]] = []
        self._first: dict[tuple[str, str], bool] = {}
        self._begin: dict[str, int] = {}
        self._numbers: dict[str, int] = {}
        self._size = 0

    # reading

    def _read(self, text: str) -> None:
        toks = TOKEN.findall(text)
        at = 0
        while at < len(toks):
            name = toks[at]
            assert toks[at + 1] == "=", (name, toks[at + 1 : at + 4])
            at, part = self._alternatives(toks, at + 2)
            assert toks[at] == ";", (name, toks[at - 3 : at + 3])
            self.rules.setdefault(name, []).append(part)
            at += 1
        for name in {p[1] for x in self.rules.values() for p in _walk(("alt", x)) if p[0] == "n"} | set().union(*self.wants.values()):
            assert name in self.rules, f"no rule for {name}"

    def _alternatives(self, toks: list[str], at: int) -> tuple[int, Part]:
        alts: list[Part] = []
        now: list[Part] = []
        while toks[at] not in (";", ")"):
            t = toks[at]
            if t == "|":
                alts.append(("seq", now))
                now = []
                at += 1
                continue
            part: Part
            if t == "(":
                at, part = self._alternatives(toks, at + 1)
            elif t[0] == "'":
                part = ("t", self.tokens[t[1:-1].replace("\\", "")])
            elif t[:2] in ("p.", "b.", "c."):
                self.wants[t[0]].add(t[2:])
                part = ("g", t[0], t[2:])
            elif t in self.names:
                part = ("s", frozenset(self.names[t]))
            else:
                part = ("n", t)
            at += 1
            if toks[at] in ("*", "+", "?"):
                part = ("seq", [part, ("*", part)]) if toks[at] == "+" else (toks[at], part)
                at += 1
            now.append(part)
        alts.append(("seq", now))
        return at, alts[0] if len(alts) == 1 else ("alt", alts)

    def _nullable(self) -> set[str]:
        out: set[str] = set()

        def empty(p: Part) -> bool:
            if p[0] == "n":
                return p[1] in out
            return p[0] in "*?" or p[0] == "seq" and all(map(empty, p[1])) or p[0] == "alt" and any(map(empty, p[1]))

        while more := {n for n, x in self.rules.items() if n not in out and any(map(empty, x))}:
            out |= more
        return out

    def _called(self) -> set[str]:
        """Rules that are called: those whose removal leaves no rule that reaches itself. The others are written in place."""
        uses = {n: {p[1] for p in _walk(("alt", x)) if p[0] == "n"} for n, x in self.rules.items()}
        out = {n for n, x in uses.items() if n in x}
        while True:
            left = {n: x - out for n, x in uses.items() if n not in out}
            while ends := {n for n, x in left.items() if not x & left.keys()}:
                for n in ends:
                    del left[n]
            if not left:
                return out
            out.add(max(left, key=lambda n: (len(left[n] & left.keys()) * sum(n in x for x in left.values()), n)))

    # automata

    def _state(self) -> int:
        self._edges.append([])
        self._free.append([])
        return len(self._edges) - 1

    def _automaton(self, name: str) -> int:
        found = self._starts.get(name)
        if found is None:
            end = self._state()
            self._ends.add(end)
            found = self._starts[name] = self._instance(name, end, end, {})
        return found

    def _instance(self, name: str, end: int, last: int, made: dict[tuple[str, int], int]) -> int:
        """The first state of a copy of the rule that leads to end; last is the end of the rule that it is written into."""
        start = made.get((name, end))
        if start is None:
            start = made[name, end] = self._state()
            for part in self.rules[name]:
                self._build(part, start, end, last, made)
        return start

    def _build(self, part: Part, start: int, end: int, last: int, made: dict) -> None:
        kind = part[0]
        if kind == "seq":
            for x in part[1][:-1]:
                middle = self._state()
                self._build(x, start, middle, last, made)
                start = middle
            if part[1]:
                self._build(part[1][-1], start, end, last, made)
            else:
                self._free[start].append(end)
        elif kind == "alt":
            for x in part[1]:
                self._build(x, start, end, last, made)
        elif kind == "?":
            self._build(part[1], start, end, last, made)
            self._free[start].append(end)
        elif kind == "*":
            around = self._state()
            self._free[start].append(around)
            self._build(part[1], around, around, last, made)
            self._free[around].append(end)
        elif kind == "n" and (part[1] not in self.called or end == last or (part[1], end) in made):
            self._free[start].append(self._instance(part[1], end, last, made))
        else:
            self._edges[start].append((part, end))

    def _set(self, states: Iterable[int]) -> int:
        """The deterministic state of some states and what is reached from them without a symbol."""
        seen = set(states)
        todo = list(seen)
        while todo:
            for s in self._free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        key = frozenset(s for s in seen if self._edges[s] or s in self._ends)
        found = self._sets.get(key)
        if found is None:
            found = self._sets[key] = len(self._members)
            self._members.append(key)
            self._final.append(any(s in self._ends for s in key))
            self._steps.append({})
        return found

    def _start(self, name: str) -> int:
        found = self._begin.get(name)
        if found is None:
            found = self._begin[name] = self._set([self._automaton(name)])
        return found

    def matches(self, sym: Part, c: str) -> bool:
        if sym[0] == "t":
            return sym[1] == c
        if sym[0] == "s":
            return c in sym[1]
        g = self.inside.get(c)
        return g is not None and g[0] == sym[1] and sym[2] in g[1]

    def _begins(self, name: str, c: str) -> bool:
        """Whether the rule can begin with c."""
        key = (name, c)
        found = self._first.get(key)
        if found is None:
            seen = {self._start(name)}
            todo = list(seen)
            found = False
            while todo and not found:
                for s in self._members[todo.pop()]:
                    for sym, to in self._edges[s]:
                        if sym[0] != "n":
                            found = found or self.matches(sym, c)
                            continue
                        more = [self._start(sym[1])] + ([self._set([to])] if sym[1] in self.nullable else [])
                        for x in more:
                            if x not in seen:
                                seen.add(x)
                                todo.append(x)
            self._first[key] = found
        return found

    def _step(self, state: int, c: str) -> tuple[int, tuple]:
        """(the state behind c or -1, the calls that can begin with c or are empty)."""
        on: list[int] = []
        calls: dict[str, list[int]] = {}
        for s in self._members[state]:
            for sym, to in self._edges[s]:
                if sym[0] == "n":
                    if sym[1] in self.nullable or self._begins(sym[1], c):
                        calls.setdefault(sym[1], []).append(to)
                elif self.matches(sym, c):
                    on.append(to)
        found = (self._set(on) if on else -1, tuple((self._start(n), self._set(x)) for n, x in calls.items()))
        self._steps[state][c] = found
        self._size += 1
        return found

    # recognising

    def accepts(self, name: str, text: str) -> bool:
        """Whether the rule derives the whole text."""
        return name in self.which((name,), text)

    def which(self, names: Iterable[str], text: str) -> frozenset:
        """Those of the rules that derive the whole text, all recognised on one stack."""
        n = len(text)
        text += "\0"
        if self._size > 10 * KEPT:
            self._steps = [{} for _ in self._steps]
            self._first.clear()
            self._size = 0
        steps, final = self._steps, self._final
        calls: list[list[tuple[int, int]]] = []  # of each node: (state behind the call, node of the caller)
        ends: list[set[int]] = []
        nodes: dict[tuple[int, int], int] = {}
        seen: set[tuple[int, int, int]] = set()
        todo = []
        roots: dict[int, str] = {}
        for name in names:
            s = self._start(name)
            roots[len(calls)] = name
            nodes[s, 0] = len(calls)
            todo.append((s, len(calls), 0))
            calls.append([])
            ends.append(set())
        found = set()
        while todo:
            s, node, at = todo.pop()
            while True:
                if final[s]:
                    if at == n and node in roots:
                        found.add(roots[node])
                        if len(found) == len(roots):
                            return frozenset(found)
                    own = ends[node]
                    if at not in own:
                        own.add(at)
                        for ret, caller in calls[node]:
                            d = (ret, caller, at)
                            if d not in seen:
                                seen.add(d)
                                todo.append(d)
                c = text[at]
                step = steps[s].get(c)
                if step is None:
                    step = self._step(s, c)
                on, more = step
                for start, ret in more:
                    key = (start, at)
                    child = nodes.get(key)
                    if child is None:
                        nodes[key] = child = len(calls)
                        calls.append([(ret, node)])
                        ends.append(set())
                        todo.append((start, child, at))
                    elif (ret, node) not in calls[child]:
                        calls[child].append((ret, node))
                        for e in ends[child]:
                            d = (ret, node, e)
                            if d not in seen:
                                seen.add(d)
                                todo.append(d)
                if on < 0:
                    break
                s = on
                at += 1
        return frozenset(found)

    def group(self, bracket: str, derives: frozenset) -> str:
        key = (bracket, derives)
        c = self._groups.get(key)
        if c is None:
            c = self._groups[key] = chr(FIRST_GROUP[bracket] + len(self._groups))
            self.inside[c] = key
        return c


def _walk(part: Part) -> Iterable[Part]:
    yield part
    if part[0] in ("seq", "alt"):
        for x in part[1]:
            yield from _walk(x)
    elif part[0] in "*?":
        yield from _walk(part[1])


class Recogniser:
    """A grammar with the lists that may be taken apart, and what has been recognised so far.

    lists: for a rule, the pattern of its parts and the rule that each part must derive.
    """

    def __init__(self, grammar: Grammar, lists: dict[str, tuple[str, str]]) -> None:
        self.g = grammar
        self.lists = {k: (re.compile(p), r) for k, (p, r) in lists.items()}
        self.known: dict[tuple[str, str], bool] = {}
        self.groups: dict[str, str | None] = {}
        self.left_out = ""  # a pattern of what doesn't count between () and [], or in all brackets
        self.left_out_all = False
        self._innermost = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")

    def derives(self, rule: str, text: str) -> bool:
        key = (rule, text)
        ok = self.known.get(key)
        if ok is None:
            ok = self._by_parts(rule, text) or self.g.accepts(rule, text)
            self._keep(key, ok)
        return ok

    def _keep(self, key: tuple[str, str], ok: bool) -> None:
        if len(key[1]) <= KEPT_LENGTH:
            if len(self.known) > KEPT:
                self.known.clear()
            self.known[key] = ok

    def _by_parts(self, rule: str, text: str) -> bool:
        """Whether the rule is a list, and each of its parts is recognised alone."""
        parts = self.lists.get(rule)
        if parts is None or len(text) <= 12:
            return False
        units = set(parts[0].findall(text))
        units.discard("")
        return len(units) > 1 and all(self._unit(parts[1], u) for u in units)

    def _unit(self, rule: str, text: str) -> bool:
        key = (rule, text)
        ok = self.known.get(key)
        if ok is None:
            ok = self.g.accepts(rule, text)
            self._keep(key, ok)
        return ok

    def _close(self, m: re.Match) -> str:
        whole = m[0]
        c = self.groups.get(whole)
        if c is None:
            if len(self.groups) > KEPT:
                self.groups.clear()
            kind = GROUPS[whole[0]]
            text = whole[1:-1]
            if self.left_out and (kind != "c" or self.left_out_all):
                text = re.sub(self.left_out, "", text)
            text = text.strip("\n")
            wants = self.g.wants[kind]
            listed = frozenset(r for r in wants if r in self.lists and self._by_parts(r, text))
            found = listed | self.g.which([r for r in wants if r not in listed], text)
            c = self.g.group(kind, found) if found else "\x01"
            if len(whole) <= KEPT_LENGTH:
                self.groups[whole] = c
        return c

    def collapse(self, text: str) -> str | None:
        """text with each group as one character; None if brackets don't match or a group can't be derived."""
        while True:
            text, n = self._innermost.subn(self._close, text)
            if "\x01" in text:
                return None
            if not n:
                return text if not any(b in text for b in "()[]{}") else None
