"""Least edits of token strings of any length, by a finite automaton around a grammar.

The automaton takes every string of the grammar. Recursion at the beginning or
the end of a rule is a loop and exact; what is nested in the middle of a rule
of its own kind may return to any place that such nesting came from. So the
fewest edits into the automaton never exceed those into the grammar, and where
the string that they make derives from the grammar, they are the fewest.
``chart`` asks its recogniser whether it does, and searches from that number
upwards where it doesn't, with ``floors`` for what is left to do. Where that
number is too low, ``over_spans`` works the grammar out over all spans.

The automaton is read with the least edits of all of its states at once; what
one token makes of them is worked out once and kept.
"""

from __future__ import annotations

import numpy as np

#: Bytes of kept states of one automaton; they are worked out again after that.
KEPT = 24_000_000
FAR = 1 << 29


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """In order; numpy's own hashes such numbers badly."""
    numbers = np.sort(numbers)
    return numbers[np.concatenate([numbers[:1] == numbers[:1], numbers[1:] != numbers[:-1]])]


class Automaton:
    def __init__(self, rules: list[tuple[str, tuple[str, ...]]], start: str):
        self.rules = rules
        self.of: dict[str, list[int]] = {}
        for r, (name, _) in enumerate(rules):
            self.of.setdefault(name, []).append(r)
        self.loops = {a: [r for r in own if rules[r][1][0] == a and len(rules[r][1]) > 1] for a, own in self.of.items()}
        self.reach = {a: {x for r in own for x in rules[r][1] if x in self.of} for a, own in self.of.items()}
        grown = True
        while grown:
            grown = False
            for a, to in self.reach.items():
                more = set().union(to, *(self.reach[b] for b in to))
                if len(more) > len(to):
                    self.reach[a] = more
                    grown = True
        # node 0 accepts; others are (name, rest of a rule, end), (name, what follows it), and the ends of what is nested
        self.ids: dict[tuple, int] = {}
        self.nodes: list[tuple] = [("accept",)]
        self.next: list[list[int]] = [[]]
        self.todo: list[int] = []
        begins = self._enter(start, 0)
        while self.todo:
            self._expand(self.todo.pop())
        self._tables(begins)

    # ---- nodes ------------------------------------------------------------

    def _add(self, key: tuple) -> int:
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.nodes)
            self.nodes.append(key)
            self.next.append([])
            self.todo.append(got)
        return got

    def _at(self, name: str, rest: tuple[str, ...], end: int) -> int:
        return self._add((name, rest, end)) if rest else end

    def _end(self, name: str, then: int) -> int:
        """Where ``name`` is complete and ``then`` follows."""
        if not self.loops[name]:
            return then
        at = then
        while len(self.nodes[at]) == 2:  # ends upon ends
            if self.nodes[at][0] == name:
                if at != then and then not in self.next[at]:
                    self.next[at].append(then)
                return at
            at = self.nodes[at][1]
        return self._add((name, then))

    def _enter(self, name: str, then: int) -> list[int]:
        end = self._end(name, then)
        return [self._at(name, self.rules[r][1], end) for r in self.of[name] if r not in self.loops[name]]

    def _expand(self, i: int) -> None:
        key = self.nodes[i]
        if key[0] == "any":
            return
        if len(key) == 2:
            name, then = key
            self.next[i] += [then, *(self._at(name, self.rules[r][1][1:], i) for r in self.loops[name])]
            return
        name, (x, *rest), end = key
        rest = tuple(rest)
        if x not in self.of:
            self._at(name, rest, end)
            return
        if not rest:
            then = end
        elif name not in self.reach[x]:
            then = self._at(name, rest, end)
        else:  # one place for all that come here, which all their ends follow
            wide = self._add(("any", name, rest))
            if end not in self.next[wide]:
                self.next[wide].append(end)
            then = self._at(name, rest, wide)
        self.next[i] += self._enter(x, then)

    # ---- tables -----------------------------------------------------------

    def _tables(self, begins: dict[str, list[int]]) -> None:
        chars: dict[int, str] = {0: ""}  # of the nodes that read a token, or accept
        for i, key in enumerate(self.nodes):
            if len(key) > 2 and key[0] != "any" and key[1][0] not in self.of:
                chars[i] = key[1][0]
        places = {i: k for k, i in enumerate(chars)}
        after = [-1] + [self._at(self.nodes[i][0], self.nodes[i][1][1:], self.nodes[i][2]) for i in list(chars)[1:]]
        # nothing follows -1, and the beginning is -2
        kernels = {t: k for k, t in enumerate(dict.fromkeys([*after, -2]))}
        opened = {t: self._closure([t] if t >= 0 else begins if t == -2 else [], places) for t in kernels}
        codes = {c: k for k, c in enumerate(dict.fromkeys(chars.values()))}
        char = np.array([codes[c] for c in chars.values()], np.int64)
        target = np.array([kernels[t] for t in after], np.int64)
        arc_k = np.repeat(np.arange(len(kernels)), [len(opened[t]) for t in kernels])
        arc_q = np.array([q for t in kernels for q in opened[t]], np.int64)
        # places that read the same and go on alike are one
        rng = np.random.default_rng(7)
        salt = rng.integers(1, 1 << 62, max(len(codes), len(char), len(kernels)) + 1)
        kind, count = np.zeros(len(kernels), np.int64), 0
        while True:
            place = np.unique(char * len(kernels) + kind[target], return_inverse=True)[1]
            pair = _distinct(arc_k * len(char) + place[arc_q])
            sums = np.zeros(len(kernels), np.int64)
            np.add.at(sums, pair // len(char), salt[pair % len(char)])
            kind = np.unique(sums, return_inverse=True)[1]
            if kind.max() + 1 == count:
                break
            count = kind.max() + 1
        # by what follows, so that the least of all that lead to a kernel is one reduction
        first = np.unique(place, return_index=True)[1]
        order = np.argsort(kind[target[first]], kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.char, self.target = char[first][order], kind[target[first]][order]
        self.codes, self.signs = codes, list(codes)
        self.accept = int(rank[place[0]])
        self.led, self.led_at = np.unique(self.target, return_index=True)
        pair = _distinct(rank[place[arc_q]] * count + kind[arc_k])
        self.arc_q, self.arc_k = pair // count, pair % count
        arc_at = np.unique(self.arc_q, return_index=True)[1]
        # places that the same kernels open are worked out once
        sums = np.add.reduceat(salt[self.arc_k], arc_at)
        alike, self.alike = np.unique(sums, return_index=True)[1], np.unique(sums, return_inverse=True)[1]
        sizes = np.diff(np.append(arc_at, len(self.arc_q)))[alike]
        self.some_at = np.cumsum(sizes) - sizes
        self.some_k = np.concatenate([self.arc_k[a : a + m] for a, m in zip(arc_at[alike], sizes)])
        self.kernels = count
        self.begin = int(kind[kernels[-2]])
        self.ends = np.append(arc_at, len(self.arc_q))
        self.leads = np.searchsorted(self.target, np.arange(count + 1))
        # the same by kernels, and the places of a rule's rest
        flip = np.lexsort((self.arc_q, self.arc_k))
        self.back_q = self.arc_q[flip]
        self.back_k, self.back_at = np.unique(self.arc_k[flip], return_index=True)
        self.labels = {x: k for k, x in enumerate(dict.fromkeys(self.nodes[i][:2] for i in list(chars)[1:]))}
        label = np.array([self.labels[self.nodes[i][:2]] for i in list(chars)[1:]], np.int64)
        pair = _distinct(label * len(order) + rank[place[1:]])
        self.label_q = pair % len(order)
        self.label_at = np.unique(pair // len(order), return_index=True)[1]
        self.of = self.ids = self.nodes = self.next = self.todo = None
        self.forget()

    def forget(self) -> None:
        self.states: list[np.ndarray] = []
        self.numbers: dict[bytes, int] = {}
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}
        self.before: dict[int, np.ndarray] = {}

    def _closure(self, nodes: list[int], places: dict[int, int]) -> list[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for j in self.next[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return sorted(places[i] for i in seen if i in places)

    # ---- reading ----------------------------------------------------------

    def _spread(self, kernels: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(kernels[self.some_k], self.some_at)[self.alike]

    def _gather(self, costs: np.ndarray) -> np.ndarray:
        out = np.full(self.kernels, FAR, np.int32)
        out[self.led] = np.minimum.reduceat(costs, self.led_at)
        return out

    def _inserted(self, costs: np.ndarray) -> np.ndarray:
        while True:
            more = np.minimum(costs, self._spread(self._gather(costs + 1)))
            if np.array_equal(more, costs):
                return costs
            costs = more

    def _keep(self, costs: np.ndarray) -> tuple[int, int]:
        """Number of these costs above their least, and the least."""
        least = int(costs.min())
        costs = costs - least
        name = costs.tobytes()
        got = self.numbers.get(name)
        if got is None:
            got = self.numbers[name] = len(self.states)
            self.states.append(costs)
        return got, least

    def _move(self, number: int, c: str) -> tuple[int, int]:
        costs = self.states[number]
        read = self._spread(self._gather(costs + (self.char != self.codes.get(c, -1))))
        return self._keep(self._inserted(np.minimum(read, costs + 1)))

    def read(self, s: str) -> tuple[int, tuple[int, ...], str]:
        """Fewest edits of ``s`` into the automaton, where they are, and what they make of it."""
        if len(self.states) * self.char.nbytes > KEPT:
            self.forget()
        got = self.moves.get((-1, ""))
        if got is None:
            kernels = np.full(self.kernels, FAR, np.int32)
            kernels[self.begin] = 0
            got = self.moves[-1, ""] = self._keep(self._inserted(self._spread(kernels)))
        seen = [got]
        number, least = got
        for c in s:
            got = self.moves.get((number, c))
            if got is None:
                got = self.moves[number, c] = self._move(number, c)
            number, least = got[0], least + got[1]
            seen.append((number, least))
        return self._back(s, seen)

    def _back(self, s: str, seen: list[tuple[int, int]]) -> tuple[int, tuple[int, ...], str]:
        q, pos = self.accept, len(s)
        cost = own = seen[pos][1] + int(self.states[seen[pos][0]][q])
        edits, made = [], []
        while True:
            before = self.before.get(q)
            if before is None:
                kernels = self.arc_k[self.ends[q] : self.ends[q + 1]]
                before = self.before[q] = np.concatenate([np.arange(self.leads[k], self.leads[k + 1]) for k in kernels])
            if not own and not pos and self.begin in self.arc_k[self.ends[q] : self.ends[q + 1]]:
                return cost, tuple(sorted(edits)), "".join(reversed(made))
            if pos:
                there = self.states[seen[pos - 1][0]][before] + seen[pos - 1][1]
                fits = self.char[before] == self.codes.get(s[pos - 1], -1)
                hit = np.flatnonzero(fits & (there == own))
                if not len(hit):
                    hit = np.flatnonzero(there + 1 == own)
                if len(hit):
                    q = int(before[hit[0]])
                    pos -= 1
                    own = int(there[hit[0]])
                    made.append(self.signs[self.char[q]])
                    if not fits[hit[0]]:
                        edits.append(pos)
                    continue
                if self.states[seen[pos - 1][0]][q] + seen[pos - 1][1] + 1 == own:
                    pos, own = pos - 1, own - 1
                    edits.append(pos)
                    continue
            hit = np.flatnonzero(self.states[seen[pos][0]][before] + seen[pos][1] + 1 == own)
            q, own = int(before[hit[0]]), own - 1
            made.append(self.signs[self.char[q]])
            edits.append(pos)

    def floors(self, s: str) -> tuple[np.ndarray, np.ndarray]:
        """By place in ``s`` and label: the fewest edits that what is left can take before a rule's rest, and behind its first token."""
        costs = np.full(len(self.char), FAR, np.int32)
        costs[self.accept] = 0
        rows, behind = [], []
        for c in (None, *reversed(s)):
            if c is not None:
                costs = np.minimum(costs + 1, self._ahead(costs) + (self.char != self.codes.get(c, -1)))
            while True:
                more = np.minimum(costs, self._ahead(costs) + 1)
                if np.array_equal(more, costs):
                    break
                costs = more
            rows.append(np.minimum.reduceat(costs[self.label_q], self.label_at))
            behind.append(np.minimum.reduceat(self._ahead(costs)[self.label_q], self.label_at))
        return np.array(rows[::-1]), np.array(behind[::-1])

    def _ahead(self, costs: np.ndarray) -> np.ndarray:
        kernels = np.full(self.kernels, FAR, np.int32)
        kernels[self.back_k] = np.minimum.reduceat(costs[self.back_q], self.back_at)
        return kernels[self.target]


def over_spans(rules: list[tuple[str, tuple[str, ...]]], start: str, s: str) -> tuple[int, tuple[int, ...]]:
    """Least edits of ``s`` from ``start`` and where they are, by the edits of every span into every rest of a rule.

    Rows of spans are worked out from the end of ``s`` on. What begins one token
    earlier takes one edit more at most; only what gets by on fewer is followed up.
    """
    n, names = len(s), {name for name, _ in rules}
    assert n < 10_000, "numbers of 16 bits"
    number: dict[tuple[str, ...], int] = {}
    for name, body in rules:
        for part in ((name,), *(body[k:] for k in range(len(body))), *((x,) for x in body)):
            number.setdefault(part, len(number))
    parts = list(number)
    tokens = {p[0]: k for p, k in number.items() if len(p) == 1 and p[0] not in names}
    least = np.full(len(parts), 20_000, np.int64)  # to insert all
    least[list(tokens.values())] = 1
    grown = True
    while grown:
        grown = False
        for name, body in rules:
            for part in (*(body[k:] for k in range(len(body) - 1, -1, -1)), (name,)):
                now = least[number[body]] if part == (name,) else sum(least[number[x,]] for x in part)
                if now < least[number[part]]:
                    least[number[part]] = now
                    grown = True
    heads = np.array([(k, number[p[:1]], number[p[1:]]) for p, k in number.items() if len(p) > 1], np.int64).reshape(-1, 3).T
    by_token = np.isin(heads[1], list(tokens.values()))
    (first, _, behind), (whole, head, rest) = heads[:, by_token], heads[:, ~by_token]
    tail, lead = heads[::2], heads[1]
    makes = np.array(sorted({(number[name,], number[body]) for name, body in rules if body != (name,)}), np.int64).T
    token = np.array(list(tokens.values()), np.int64)
    is_head = np.isin(np.arange(len(parts)), head)
    cost = np.full((n + 1, len(parts), n + 1), 20_000, np.int16)
    inserted = least.astype(np.int16)
    for i in range(n, -1, -1):
        rows = cost[i]
        if i < n:
            np.add(cost[i + 1], 1, out=rows)
            rows[:, :i] = 20_000
        rows[:, i] = least
        if i == n:
            continue
        was = rows[:, i:].copy()
        unlike = np.array([p[0] != s[i] for p in parts], np.int16)

        def lower(wholes: np.ndarray, at: int, values: np.ndarray) -> None:
            rows[wholes, at:] = np.minimum(rows[wholes, at:], values)

        lower(token, i + 1, np.arange(n - i, dtype=np.int16) + unlike[token, None])
        lower(first, i + 1, cost[i + 1, behind, i + 1 :] + unlike[first, None])
        while True:
            now = rows[:, i:].copy()
            less = now < was
            any_less = less.any(axis=1)
            if not any_less.any():
                break
            was = now
            on = any_less[tail[1]]
            lower(tail[0, on], i, now[tail[1, on]] + inserted[lead[on], None])
            on = any_less[makes[1]]
            if on.any():
                made, at = np.unique(makes[0, on], return_index=True)
                lower(made, i, np.minimum.reduceat(now[makes[1, on]], at))
            # an end further on is of use only where reading to it beats leaving those tokens to be deleted
            mine = np.flatnonzero(any_less & is_head)
            if not len(mine):
                continue
            slack = now[mine] - np.arange(n + 1 - i, dtype=np.int16)
            useful = less[mine, 1:] & (slack[:, 1:] < np.minimum.accumulate(slack, axis=1)[:, :-1])
            at = np.full(len(parts), -1)
            at[mine] = np.arange(len(mine))
            for j in (np.flatnonzero(useful.any(axis=0)) + 1).tolist():
                on = (at[head] >= 0) & useful[at[head], j - 1]
                lower(whole[on], i + j, cost[i + j, rest[on], i + j :] + now[head[on], j, None])
    edits: list[int] = []
    todo = [(number[start,], 0, n, frozenset())]
    while todo:
        k, i, j, above = todo.pop()
        p, own = parts[k], int(cost[i, k, j])
        if len(p) == 1 and p[0] in tokens:
            if i == j:
                edits.append(i)
            else:
                kept = s.find(p[0], i, j)
                edits += [q for q in range(i, j) if q != (kept if kept >= 0 else -1)]
        elif len(p) == 1:
            bodies = [number[body] for name, body in rules if name == p[0]]
            hit = next((b for b in bodies if b not in above and cost[i, b, j] == own), None)
            if hit is None:
                edits.append(i)
                todo.append((k, i + 1, j, frozenset()))
            else:
                todo.append((hit, i, j, above | {hit}))
        else:
            head, rest = number[p[:1]], number[p[1:]]
            sums = cost[i, head, i : j + 1].astype(np.int64) + cost[i : j + 1, rest, j]
            at = i + int(sums.argmin())
            if sums[at - i] == own:
                todo += [(rest, at, j, frozenset()), (head, i, at, frozenset())]
            else:
                edits.append(i)
                todo.append((k, i + 1, j, frozenset()))
    return int(cost[0, number[start,], n]), tuple(sorted(edits))
