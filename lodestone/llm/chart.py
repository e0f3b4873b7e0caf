"""Error-correcting chart parsing of short token strings.

A grammar is text: ``NAME: symbol symbol | symbol``; a symbol that no rule
defines is a terminal. Token strings have one character a token. ``least``
gives the least number of tokens to insert, delete or replace so that a string
derives from a start symbol, and where, for any number and any length; strings
that derive as they are take the plain recogniser alone. ``least_edits`` gives
the number at least, which is the least where the string that its edits make
derives; else the chart is searched from that number on, or all spans are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Generator, Iterator, Sequence
from heapq import heapify, heapreplace
from itertools import count

import numpy as np

from lodestone.llm.least_edits import Automaton, over_spans

#: Costs above this are not told apart by ``repair``; ``least`` tells all.
MOST = 4
#: Strings longer than this are worked out over spans once the chart has failed twice, while the spans keep below so many numbers.
LONG, SPANS = 60, 200_000_000

#: Numbers that a cost isn't below, then the cost and where its edits are.
Rising = Generator[int, None, tuple[int, tuple[int, ...]]]


def last_of(rising: Rising) -> tuple[int, tuple[int, ...]]:
    while True:
        try:
            next(rising)
        except StopIteration as end:
            return end.value


def least_of(ways: Sequence[Rising]) -> Rising:
    """The way of the least cost, the first of equals; no other is followed further than to where it can't be that."""
    ends: dict[int, tuple[int, tuple[int, ...]]] = {}
    heap = [(0, k) for k in range(len(ways))]
    heapify(heap)
    while True:
        least, k = heap[0]
        if k in ends:
            return ends[k]
        try:
            least = max(least, next(ways[k]))
        except StopIteration as end:
            ends[k] = end.value
            least = end.value[0]
        heapreplace(heap, (least, k))
        yield heap[0][0]


class Grammar:
    def __init__(self, text: str, terminals: dict[str, str]):
        """``terminals`` maps terminal names to their characters; others stand for themselves."""
        rules: list[tuple[str, tuple[str, ...]]] = []
        for line in text.strip().splitlines():
            if not line.strip():
                continue
            name, _, alternatives = line.partition(":")
            for alt in alternatives.split(" | "):
                rules.append((name.strip(), tuple(alt.split())))
        names = {n for n, _ in rules}
        self._take([(n, tuple(x if x in names else terminals.get(x, x) for x in body)) for n, body in rules])

    def _take(self, rules: list[tuple[str, tuple[str, ...]]]) -> None:
        names = {n for n, _ in rules}
        self.rules = rules
        self.names = names
        self.of: dict[str, list[int]] = defaultdict(list)
        for i, (n, _) in enumerate(self.rules):
            self.of[n].append(i)
        # dots of all rules in a row: what follows each, whose it is, and where each name begins
        self.symbols: list[str | None] = [x for _, body in rules for x in (*body, None)]
        self.owners = [n for n, body in rules for _ in range(len(body) + 1)]
        self.begins: dict[str, list[int]] = defaultdict(list)
        at = 0
        for n, body in rules:
            self.begins[n].append(at)
            at += len(body) + 1
        # by name, the dots before it and those before the tokens that it may begin with
        self.awaits = {n: [k for k, x in enumerate(self.symbols) if x == n] for n in names}
        self.tokens: dict[str, list[int]] = {}
        for n in names:
            seen, todo = {n}, [n]
            while todo:
                more = {self.symbols[at] for at in self.begins[todo.pop()]} & names - seen
                seen |= more
                todo += more
            self.tokens[n] = [at for x in names if x in seen for at in self.begins[x] if self.symbols[at] not in names]
        first: dict[str, set[str]] = {n: set() for n in names}
        grown = True
        while grown:
            grown = False
            for n, body in self.rules:
                x = body[0]
                add = first[x] if x in names else {x}
                if not add <= first[n]:
                    first[n] |= add
                    grown = True
        self.opens = first
        self.first = [first[b[0]] if b[0] in names else {b[0]} for _, b in self.rules]
        self.known: dict[tuple[str, str], tuple[int, tuple[int, ...]]] = {}
        self.under: dict[tuple[str, str], int] = {}  # of strings that don't derive and aren't known yet: edits at least
        self.around: dict[str, Automaton] = {}

    def sound(self, start: str, s: str) -> bool:
        """Whether ``s`` derives from ``start`` as it is."""
        key = (start, s)
        got = self.known.get(key)
        if got is not None:
            return not got[0]
        if key in self.under:
            return False
        if len(self.known) + len(self.under) > 300_000:
            self.known.clear()
            self.under.clear()
        if self.stops_at(start, s) is not None:
            self.under[key] = 1
            return False
        self.known[key] = (0, ())
        return True

    def least(self, start: str, s: str) -> tuple[int, tuple[int, ...]]:
        """Least edits of ``s`` from ``start``, and the positions they are at."""
        return last_of(self.rising(start, s))

    def rising(self, start: str, s: str) -> Rising:
        """``least``, after numbers that it isn't below, each worked out when it is asked for."""
        key = (start, s)
        if not self.sound(start, s) and key not in self.known:
            yield self.under[key]
            if key not in self.known:  # nor found by another meanwhile
                for got in self._bounds(start, s):
                    if isinstance(got, tuple):
                        self.known[key] = got
                        self.under.pop(key, None)
                        break
                    if got > self.under.get(key, 0):
                        self.under[key] = got
                        yield got
        return self.known[key]

    def _bounds(self, start: str, s: str) -> Iterator[int | tuple[int, tuple[int, ...]]]:
        around = self.around.get(start)
        if around is None:
            around = self.around[start] = Automaton(self.rules, start)
        cost, edits, made = around.read(s)
        yield cost
        if self.stops_at(start, made) is None:
            yield cost, edits
        floors = self._floors(around, s)
        for most in count(cost):
            got = self._correct(start, s, most, floors)
            if got is None and most > cost and len(s) > LONG and (len(s) + 1) ** 2 * sum(len(body) for _, body in self.rules) <= SPANS:
                got = over_spans(self.rules, start, s)
            yield most + 1 if got is None else got

    def repair(self, start: str, s: str) -> tuple[int, tuple[int, ...]]:
        """``least``, with costs above ``MOST`` as one more than that at the first edit."""
        cost, edits = self.least(start, s)
        return (cost, edits) if cost <= MOST else (MOST + 1, edits[:1])

    def stops_at(self, start: str, s: str) -> int | None:
        """Where a plain recogniser stops; None if it accepts."""
        rules, names, of, first = self.rules, self.names, self.of, self.first
        n = len(s)
        waiting: list[dict[str, list[tuple[int, int, int]]]] = []
        items: set[tuple[int, int, int]] = set()
        todo: list[tuple[int, int, int]] = []
        if n == 0:
            return 0
        c = s[0]
        for r in of[start]:
            if c in first[r]:
                todo.append((r, 0, 0))
        items.update(todo)
        for pos in range(n + 1):
            c = s[pos] if pos < n else ""
            wait: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
            waiting.append(wait)
            after: list[tuple[int, int, int]] = []
            done: set[tuple[str, int]] = set()
            accepted = False
            while todo:
                item = todo.pop()
                r, dot, origin = item
                name, body = rules[r]
                if dot == len(body):
                    if (name, origin) in done:
                        continue
                    done.add((name, origin))
                    if origin == 0 and name == start and pos == n:
                        accepted = True
                    for q, d, o in waiting[origin].get(name, ()):
                        nxt = (q, d + 1, o)
                        if nxt not in items:
                            items.add(nxt)
                            todo.append(nxt)
                    continue
                x = body[dot]
                if x in names:
                    if x not in wait:
                        for r2 in of[x]:
                            if c in first[r2]:
                                nxt = (r2, 0, pos)
                                if nxt not in items:
                                    items.add(nxt)
                                    todo.append(nxt)
                    wait[x].append(item)
                elif x == c:
                    after.append((r, dot + 1, origin))
            if pos == n:
                return None if accepted else n
            if not after:
                return pos
            todo, items = after, set(after)
        return None

    def _floors(self, around: Automaton, s: str) -> list[list[int]]:
        """By place and rule's dot: what it takes at least from there to the end; 0 where nothing follows and no token came."""
        reads, behind = [], []
        for name, body in self.rules:
            here = [around.labels.get((name, body[dot:]), -1) for dot in range(len(body))]
            reads += [*here, -1]
            behind += [-1, *here]
        before, after = (np.pad(x, ((0, 0), (0, 1))) for x in around.floors(s))
        floors = np.maximum(before[:, reads], after[:, behind])
        least = {x: floors[:, at].min(axis=1, keepdims=True) for x, at in self.tokens.items()}
        for x, at in self.awaits.items():
            floors[:, at] = np.maximum(floors[:, at], least[x])
        return floors.tolist()

    def _correct(self, start: str, s: str, most: int, floors: list[list[int]]) -> tuple[int, tuple[int, ...]] | None:
        """Dijkstra over chart items, by the edits from the string's beginning on.

        An item also has the edits since its own origin, which are what a
        finished constituent costs whoever waits for it; those who waited at a
        place first came there by the fewest edits. ``floors``: by place and
        dot, what it takes at least from there to the end.
        """
        names, opens, symbols, owners, begins = self.names, self.opens, self.symbols, self.owners, self.begins
        n = len(s)
        wide = n + 1
        # costs are few: a stack of items for each takes the place of a heap
        stacks: list[list[tuple[int, int, int, tuple[int, ...]]]] = [[] for _ in range(most + 1)]
        best: dict[int, int] = {}
        base: dict[tuple[str, int], int] = {}
        complete: dict[tuple[str, int], dict[int, tuple[int, tuple[int, ...]]]] = defaultdict(dict)
        waiting: dict[tuple[str, int], list[tuple[int, int, int, tuple[int, ...]]]] = defaultdict(list)

        def push(at: int, origin: int, pos: int, cost: int, edits: tuple[int, ...]) -> None:
            if cost + floors[pos][at] > most:
                return
            if cost == most:  # nothing may be edited from here on
                x = symbols[at]
                if x in names and (pos == n or s[pos] not in opens[x]):
                    return
            item = (at * wide + origin) * wide + pos
            if best.get(item, most + 1) > cost:
                best[item] = cost
                stacks[cost].append((at, origin, pos, edits))

        base[start, 0] = 0
        for at in begins[start]:
            push(at, 0, 0, 0, ())
        for cost, stack in enumerate(stacks):
            while stack:
                at, origin, pos, edits = stack.pop()
                if at < 0:
                    return cost, tuple(sorted(edits))
                if best[(at * wide + origin) * wide + pos] < cost:
                    continue
                x = symbols[at]
                if x is None:
                    name = owners[at]
                    ends = complete[name, origin]
                    if pos in ends:
                        continue
                    own = cost - base[name, origin]
                    ends[pos] = (own, edits)
                    if name == start and origin == 0 and cost + n - pos <= most:  # what is left over is deleted
                        stacks[cost + n - pos].append((-1, 0, n, edits + tuple(range(pos, n))))
                    for q, o, before, e0 in waiting[name, origin]:
                        push(q, o, pos, before + own, e0 + edits)
                    continue
                if x in names:
                    waiting[x, pos].append((at + 1, origin, cost, edits))
                    if (x, pos) not in base:
                        base[x, pos] = cost
                        for q in begins[x]:
                            push(q, pos, pos, cost, ())
                    for end, (own, e1) in list(complete[x, pos].items()):
                        push(at + 1, origin, end, cost + own, edits + e1)
                    continue
                same = pos < n and s[pos] == x
                if same:
                    push(at + 1, origin, pos + 1, cost, edits)
                if cost < most:
                    edited = (*edits, pos)
                    push(at + 1, origin, pos, cost + 1, edited)  # insert
                    if pos < n:
                        if not same:
                            push(at + 1, origin, pos + 1, cost + 1, edited)  # replace
                        push(at, origin, pos + 1, cost + 1, edited)  # delete
        return None
