"""A generalised LR repairer over a grammar of roles.

Tables are built from the productions (items, closure, follow sets).  The input
is a row of symbols, each of which may be kept, given another role or deleted,
and symbols may be inserted before any of them; every action has a weight.  All
repairs are followed at once on a graph-structured stack: its tops are the
states after the rows so far, and tops of equal stacks are merged into the one
of least (cost, audit), where the audit spells the actions.  That loses no best
repair: what can follow depends on the stack only, and of two audits of equal
cost none is the beginning of the other, since the longer one would have paid
for insertions more.

A top's stack is a tuple of states; in the role grammar it is at most three deep.
Tops that cost over ``SLACK`` more than the cheapest are dropped, which loses
nothing either: from the cheapest top every continuation of another one can be
had by two insertions (or less) and, in place of a system turn that the other
could keep, a deletion.  So a handful of tops is left however long the input,
and what their audits have in common is settled.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import lru_cache

END = "$"
#: Turns of a chat by the initials of their roles: nothing, or an optional system turn and pairs of user and assistant.
ROLE_GRAMMAR = (("S", ()), ("S", ("T",)), ("T", ("u", "a")), ("T", ("s", "u", "a")), ("T", ("T", "u", "a")))
#: Roles that rows may be given and that may be inserted.
ROLES = ("user", "assistant")

# Weights of the actions, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Most that it costs to go on from one stack of the role grammar as from any other.
SLACK = 2 * INSERT + DELETE
#: Letters after which the tops' common beginning is set aside.
SETTLE = 256


class Tables:
    """SLR tables: ``shift`` moves a stack over a symbol, all reductions before it done."""

    def __init__(self, rules: tuple):
        self.rules = (("^", (rules[0][0],)), *rules)
        self.heads = {head for head, _ in self.rules}
        self._follow = self._follow_sets()
        self.states = [self._closure(frozenset([(0, 0)]))]
        self.goto: dict[tuple[int, str], int] = {}
        at = 0
        while at < len(self.states):
            items = self.states[at]
            for symbol in sorted({body[dot] for rule, dot in items if dot < len(body := self.rules[rule][1])}):
                moved = frozenset((r, d + 1) for r, d in items if self.rules[r][1][d : d + 1] == (symbol,))
                state = self._closure(moved)
                if state not in self.states:
                    self.states.append(state)
                self.goto[at, symbol] = self.states.index(state)
            at += 1

    def _closure(self, items: frozenset) -> frozenset:
        items = set(items)
        while True:
            wanted = {body[dot] for rule, dot in items if dot < len(body := self.rules[rule][1])}
            more = {(i, 0) for i, (head, _) in enumerate(self.rules) if head in wanted} - items
            if not more:
                return frozenset(items)
            items |= more

    def _follow_sets(self) -> dict[str, set]:
        empty: set[str] = set()
        first = {head: set() for head in self.heads}
        follow = {head: set() for head in self.heads}
        follow["^"].add(END)
        changed = True
        while changed:
            before = (len(empty), [len(first[h]) for h in sorted(first)], [len(follow[h]) for h in sorted(follow)])
            for head, body in self.rules:
                trailer = set(follow[head])
                for symbol in reversed(body):
                    if symbol in self.heads:
                        follow[symbol] |= trailer
                        trailer = trailer | first[symbol] if symbol in empty else set(first[symbol])
                    else:
                        trailer = {symbol}
                for symbol in body:
                    first[head] |= first[symbol] if symbol in self.heads else {symbol}
                    if symbol not in empty:
                        break
                else:
                    empty.add(head)
            changed = before != (len(empty), [len(first[h]) for h in sorted(first)], [len(follow[h]) for h in sorted(follow)])
        return follow

    def _reduced(self, stack: tuple[int, ...], ahead: str) -> list[tuple[int, ...]]:
        """The stack and all that its reductions under the next symbol lead to."""
        out, todo = [], [stack]
        while todo:
            one = todo.pop()
            out.append(one)
            for rule, dot in self.states[one[-1]]:
                head, body = self.rules[rule]
                if rule and dot == len(body) and ahead in self._follow[head]:
                    below = one[: len(one) - len(body)]
                    if (below[-1], head) in self.goto:
                        todo.append((*below, self.goto[below[-1], head]))
        return out

    @lru_cache(maxsize=4096)
    def shift(self, stack: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], ...]:
        """Stacks after the symbol; none where it does not fit."""
        if symbol in self.heads or symbol == END:
            return ()
        moved = (s + (self.goto[s[-1], symbol],) for s in self._reduced(stack, symbol) if (s[-1], symbol) in self.goto)
        return tuple(map(self._settled, moved))

    def _settled(self, stack: tuple[int, ...]) -> tuple[int, ...]:
        """The stack after the reductions that nothing ahead can change."""
        while len(self.states[stack[-1]]) == 1:
            ((rule, dot),) = self.states[stack[-1]]
            head, body = self.rules[rule]
            if not rule or dot < len(body):
                break
            below = stack[: len(stack) - len(body)]
            stack = (*below, self.goto[below[-1], head])
        return stack

    @lru_cache(maxsize=4096)
    def accepts(self, stack: tuple[int, ...]) -> bool:
        whole = (0, len(self.rules[0][1]))
        return any(whole in self.states[s[-1]] for s in self._reduced(stack, END))


@lru_cache(maxsize=1)
def role_tables() -> Tables:
    return Tables(ROLE_GRAMMAR)


@dataclass(slots=True)
class Top:
    """A top of the stack graph: cost and audit (its unsettled end) of the best way, and a digest of what it makes."""

    cost: int
    audit: str
    digest: object
    begun: bool

    def made(self, cost: int, letter: str, line: bytes | None) -> "Top":
        """The top after an action; ``line`` is what the action adds to the result."""
        if line is None:
            return Top(self.cost + cost, self.audit + letter, self.digest, self.begun)
        digest = self.digest.copy()
        digest.update(b"\n" + line if self.begun else line)
        return Top(self.cost + cost, self.audit + letter, digest, True)


class Repair:
    """Repairs one conversation, row after row, in memory that does not grow with the texts."""

    def __init__(self, digest, tables: Tables | None = None):
        self.tables = tables or role_tables()
        self.settled: list[str] = []
        self.tops = {(0,): Top(0, "", digest, False)}
        self._insert()

    def _insert(self) -> None:
        """Add the tops that insertions reach."""
        todo = list(self.tops)
        while todo:
            stack = todo.pop()
            top = self.tops[stack]
            for role in ROLES:
                for new in self.tables.shift(stack, role[0]):
                    known = self.tops.get(new)
                    if known is None or (top.cost + INSERT, top.audit + "I") < (known.cost, known.audit):
                        self.tops[new] = top.made(INSERT, "I", f"{role}:".encode())
                        todo.append(new)

    def row(self, role: str, text: str, fault: str | None) -> None:
        """Take one row; ``fault`` is blank, duplicate, truncated or None."""
        # new stack: (cost, audit, top it comes from, action's cost, letter, role of the line)
        best: dict[tuple[int, ...], tuple] = {}

        def offer(stack: tuple[int, ...], top: Top, cost: int, letter: str, as_role: str | None) -> None:
            known = best.get(stack)
            if known is None or (top.cost + cost, top.audit + letter) < known[:2]:
                best[stack] = (top.cost + cost, top.audit + letter, top, cost, letter, as_role)

        stays = TRUNCATED if fault == "truncated" else 0
        for stack, top in self.tops.items():
            offer(stack, top, DELETE, "D", None)
            if fault in ("blank", "duplicate"):
                continue
            for new in self.tables.shift(stack, role[:1]):
                offer(new, top, stays, "K", role)
            for other in ROLES:
                for new in self.tables.shift(stack, other[0]):
                    offer(new, top, REROLE + stays, "R", other)
        lines = {r: f"{r}:{text}".encode("utf-8", "surrogatepass") for r in {b[5] for b in best.values()} if r is not None}
        most = min(b[0] for b in best.values()) + SLACK
        self.tops = {s: top.made(cost, letter, lines.get(r)) for s, (c, _, top, cost, letter, r) in best.items() if c <= most}
        self._insert()
        self._settle()

    def _settle(self) -> None:
        tops = list(self.tops.values())
        if len(tops[0].audit) >= SETTLE:
            common = os.path.commonprefix([top.audit for top in tops])
            if common:
                self.settled.append(common)
                for top in tops:
                    top.audit = top.audit[len(common) :]

    def best(self) -> tuple[int, str, object]:
        """Cost, audit and digest of the best repair of all rows so far."""
        ends = [top for stack, top in self.tops.items() if self.tables.accepts(stack)]
        top = min(ends, key=lambda t: (t.cost, t.audit))
        return top.cost, "".join(self.settled) + top.audit, top.digest
