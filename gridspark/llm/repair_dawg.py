"""Cheapest repairs of role and fault signatures, on a word graph that shares suffixes.

A signature has one letter a row: its role (system, user, assistant, other) and its fault. A node of the graph is a suffix; equal suffixes
of all signatures are one node. Signatures are read from their ends in sorted order, so the nodes of the last one are a path, and the next one
keeps the part of the path that it shares and builds the rest. For every node and every state of the grammar ``(s?(ua)+)?`` the cost of repairing
what is left and the first edits of the best repair (with the state they lead to) are computed once. Costs only matter by their differences, and
a register keeps one step for each letter and set of differences, so that a node is a reference into it.

States: 0 nothing is written yet, 1 a system row, 2 a user row, 3 an assistant row was the last. Edits: K keep, R other role, D delete, I insert.
An edit letter leads from a state to one state only, so the ASCII-least of the cheapest repairs takes the least letter at every step.
"""

from __future__ import annotations

from os.path import commonprefix

ROLES = "suax"
FAULTS = ("ok", "truncated", "blank", "duplicate")
# One letter for each fault and role, by fault.
LETTERS = "ABCDEFGHIJKLMNOP"
MUST_GO = LETTERS[8]

DELETE, INSERT, REROLE, BROKEN = 4, 3, 3, 3
NEXT_ROLE = (2, 2, 3, 2)  # the state after writing the one role of user and assistant that may follow
KEEP = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})  # by role, from state to state
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def step(letter: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Cost of each state before a row, and its edits up to and with that row; ``after`` are the costs behind it."""
    fault, role = divmod(LETTERS.index(letter), 4)
    own = []
    for q in range(4):
        ways = [(DELETE + after[q], "D", q)]
        if fault < 2:
            extra = BROKEN * fault
            if q in KEEP[role]:
                ways.append((extra + after[KEEP[role][q]], "K", KEEP[role][q]))
            ways.append((REROLE + extra + after[NEXT_ROLE[q]], "R", NEXT_ROLE[q]))
        own.append(min(ways))
    best = list(own)
    # The other of user and assistant first, then the states that lead to it.
    for q in (2, 3, 0, 1):
        there = own[NEXT_ROLE[q]] if q in (2, 3) else best[NEXT_ROLE[q]]
        best[q] = min(own[q], (INSERT + there[0], "I" + there[1], there[2]))
    return tuple(c for c, _, _ in best), tuple((edits, to) for _, edits, to in best)


class Graph:
    """The path of one signature at a time; ``solve`` wants them reversed and in sorted order to share most."""

    def __init__(self):
        self.register: dict[tuple, tuple] = {}
        self.last = ""
        start = tuple(c for c, _ in END)
        self.path: list[tuple] = [(start, ())]
        self.totals = [0]
        self.built = 0

    def solve(self, reversed_signature: str) -> tuple[int, str]:
        """The least cost and the edits of a signature that is given from its end."""
        shared = len(commonprefix([self.last, reversed_signature]))
        del self.path[shared + 1 :], self.totals[shared + 1 :]
        for letter in reversed_signature[shared:]:
            differences = self.path[-1][0]
            node = self.register.get((letter, differences))
            if node is None:
                costs, edits = step(letter, differences)
                low = min(costs)
                node = self.register[letter, differences] = (tuple(c - low for c in costs), edits, low)
            self.path.append(node)
            self.totals.append(self.totals[-1] + node[2])
            self.built += 1
        self.last = reversed_signature
        out, q = [], 0
        for node in reversed(self.path[1:]):
            edits, q = node[1][q]
            out.append(edits)
        return self.totals[-1] + self.path[-1][0][0], "".join(out) + END[q][1]
