"""Edit sequences that share their beginnings, and the cheapest edits of a conversation."""

from __future__ import annotations

import xxhash

PRIME, BASE = (1 << 61) - 1, 1_000_003
#: States of (s?(ua)+)?: nothing yet, after system, after user, after assistant. What an inserted or reroled turn leads to.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {("s", EMPTY): SYSTEM, ("u", EMPTY): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1


class Audits:
    """Sequences of strings as linked nodes: a node is its parent's sequence and one more element. It knows its ancestors 1, 2, 4, ..
    elements back and a rolling hash of the sequence, so two sequences of n elements find their first difference in log n steps."""

    ROOT = 0

    def __init__(self, prime: int = PRIME):
        self.prime = prime
        self.element, self.depth, self.hash, self.up = [""], [0], [0], [[0]]
        self._codes: dict[str, int] = {}

    def add(self, parent: int, element: str) -> int:
        code = self._codes.get(element)
        if code is None:
            code = xxhash.xxh3_64_intdigest(element) % self.prime
            if len(element) == 1:
                self._codes[element] = code
        node, lifts, k = len(self.element), [parent], 0
        while len(self.up[lifts[k]]) > k and self.depth[lifts[k]] > 0:
            lifts.append(self.up[lifts[k]][k])
            k += 1
        self.element.append(element)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + code + 1) % self.prime)
        self.up.append(lifts)
        return node

    def lifted(self, node: int, depth: int) -> int:
        """The ancestor with so many elements."""
        while self.depth[node] > depth:
            rise = self.depth[node] - depth
            k = min(rise.bit_length() - 1, len(self.up[node]) - 1)
            node = self.up[node][k]
        return node

    def elements(self, node: int) -> list[str]:
        out = []
        while node:
            out.append(self.element[node])
            node = self.up[node][0]
        return out[::-1]

    def text(self, node: int) -> str:
        return "".join(self.elements(node))

    def _equal(self, a: int, b: int) -> bool:
        """Whether two sequences of one length are equal, read back to the node that they share."""
        while a != b:
            if self.element[a] != self.element[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the text of a comes before that of b. Neither of two edits of the same rows is the other's beginning."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lifted(a, depth), self.lifted(b, depth)
        if self.hash[x] != self.hash[y]:
            for k in range(max(len(self.up[x]), len(self.up[y])) - 1, -1, -1):
                if k < len(self.up[x]) and k < len(self.up[y]):
                    p, q = self.up[x][k], self.up[y][k]
                    if self.hash[p] != self.hash[q]:
                        x, y = p, q
            if self._equal(self.up[x][0], self.up[y][0]):
                return self.element[x] < self.element[y]
        elif self._equal(x, y):
            return self.depth[a] < self.depth[b]
        return self.text(a) < self.text(b)  # different sequences had one hash


class Front:
    """The cheapest edits of the rows so far, for each state that they may end in; of equally cheap ones the ASCII-least."""

    def __init__(self, audits: Audits, entry: int = EMPTY):
        self.audits = audits
        self.best: list[tuple[int, int] | None] = [None] * 4
        self.best[entry] = (0, Audits.ROOT)

    def _better(self, a: tuple[int, int], b: tuple[int, int] | None) -> bool:
        return b is None or a[0] < b[0] or a[0] == b[0] and self.audits.less(a[1], b[1])

    def insert(self) -> None:
        """Allows inserted turns at this place."""
        left = {q for q in range(4) if self.best[q]}
        while left:
            q = min(left, key=lambda s: self.best[s][0])
            left.discard(q)
            to, cost = NEXT[q], self.best[q][0] + INSERT
            if self.best[to] is None or cost <= self.best[to][0]:
                offer = (cost, self.audits.add(self.best[q][1], "I"))
                if self._better(offer, self.best[to]):
                    self.best[to] = offer
                    left.add(to)

    def row(self, initial: str, forced: bool, truncated: bool, copies: int) -> None:
        """One row and its adjacent copies, which have to go."""
        self.insert()
        offers: list[list[tuple[int, int, str]]] = [[], [], [], []]
        for q, held in enumerate(self.best):
            if held is None:
                continue
            cost, node = held
            if forced:
                offers[q].append((cost + DELETE * copies, node, "D" * copies))
                continue
            late = TRUNCATED * truncated
            kept = KEPT.get((initial, q))
            if kept is not None:
                offers[kept].append((cost + late, node, "K"))
            offers[NEXT[q]].append((cost + REROLE + late, node, "R"))
            offers[q].append((cost + DELETE, node, "D"))
        for q, own in enumerate(offers):
            found = None
            least = min((o[0] for o in own), default=0)
            for cost, node, letter in own:
                if cost == least:
                    offer = (cost, self.audits.add(node, letter))
                    if self._better(offer, found):
                        found = offer
            if found and not forced and copies > 1:
                found = (found[0] + DELETE * (copies - 1), self.audits.add(found[1], "D" * (copies - 1)))
            self.best[q] = found

    def stretch(self, moves: list[tuple[int, int, int, str]]) -> None:
        """Many rows at once: (entry, exit, cost, audit) of their cheapest edits."""
        best: list[tuple[int, int] | None] = [None] * 4
        for entry, to, cost, audit in moves:
            held = self.best[entry]
            if held and (best[to] is None or held[0] + cost <= best[to][0]):
                offer = (held[0] + cost, self.audits.add(held[1], audit))
                if self._better(offer, best[to]):
                    best[to] = offer
        self.best = best

    def end(self) -> tuple[int, int]:
        """Cost and audit of the whole: it ends empty or after an assistant."""
        self.insert()
        ends = [self.best[q] for q in (EMPTY, ASSISTANT) if self.best[q]]
        return ends[1] if len(ends) > 1 and self._better(ends[1], ends[0]) else ends[0]


def applied(rows: list[tuple[str, str, int]], audit: str, state: int) -> tuple[list[dict], int]:
    """rows(role, text, copies) after the edits, and the state that they end in."""
    out, at = [], 0

    def inserted() -> None:
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            state, at = NEXT[state], at + 1
            out.append({"role": ROLE[state], "text": ""})

    for role, text, copies in rows:
        inserted()
        letter = audit[at]
        if letter == "K":
            state = KEPT[role[:1], state]
            out.append({"role": role, "text": text})
        elif letter == "R":
            state = NEXT[state]
            out.append({"role": ROLE[state], "text": text})
        at += copies
    inserted()
    return out, state
