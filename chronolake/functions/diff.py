"""Unified line diffs from a longest common subsequence, found in room that grows with the lines alone.

A row of the table of common lengths is one integer, a bit per line of the new text: a bit is 0
where the length grows. A line of the old text turns one row into the next by a few operations
on whole integers. The old text is halved, the rows that both halves end with say where the
new one is to be cut, and so on for the parts.
"""

from __future__ import annotations

from itertools import accumulate


def lines_of(text: str) -> list[str]:
    """An empty text has no line; a final newline leaves an empty last one."""
    return text.split("\n") if text else []


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """The length of a longest common subsequence of a and each prefix of b, from the empty one on."""
    places: dict[str, int] = dict.fromkeys(a, 0)
    for j, line in enumerate(b):
        if line in places:
            places[line] |= 1 << j
    full = (1 << len(b)) - 1
    row = full
    for line in a:
        if held := row & places[line]:
            row = ((row + held) | (row - held)) & full
    grows = f"{row:0{len(b)}b}"[::-1] if b else ""
    return [0, *accumulate(c == "0" for c in grows)]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """(index in a, index in b) of the lines of a longest common subsequence, from begin to end."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        top, end, left, right = open_.pop()
        while top < end and left < right and a[top] == b[left]:
            out.append((top, left))
            top, left = top + 1, left + 1
        while top < end and left < right and a[end - 1] == b[right - 1]:
            end, right = end - 1, right - 1
            out.append((end, right))
        if top == end or left == right:
            continue
        if end - top == 1:
            out += [(top, j) for j in range(left, right) if b[j] == a[top]][:1]
            continue
        half, part = (top + end) // 2, b[left:right]
        before, after = _lengths(a[top:half], part), _lengths(a[half:end][::-1], part[::-1])
        total = [x + y for x, y in zip(before, reversed(after))]
        cut = left + total.index(max(total))
        open_ += [(top, half, left, cut), (half, end, cut, right)]
    return sorted(out)


def _script(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """(' ', '-' or '+', index in a, index in b) from begin to end: a shortest script, lines that go before those that come."""
    out, i, j = [], 0, 0
    for x, y in [*_common(a, b), (len(a), len(b))]:
        out += [("-", k, j) for k in range(i, x)] + [("+", x, k) for k in range(j, y)]
        if x < len(a) and y < len(b):
            out.append((" ", x, y))
        i, j = x + 1, y + 1
    return out


def unified(old: str, new: str, old_path: str, new_path: str, context: int = 3) -> str:
    """A unified diff, '' for equal texts. An empty side's hunk starts at 1 with a count of 0."""
    if old == new:
        return ""
    a, b = lines_of(old), lines_of(new)
    script = _script(a, b)
    changed = [i for i, (op, _, _) in enumerate(script) if op != " "]
    if not changed:
        return ""
    groups = [[changed[0], changed[0]]]
    for i in changed[1:]:
        if i - groups[-1][1] - 1 > 2 * context:
            groups.append([i, i])
        groups[-1][1] = i
    out = [f"--- a/{old_path}", f"+++ b/{new_path}"]
    for first, last in groups:
        part = script[max(0, first - context) : last + 1 + context]
        removed, added = sum(op != "+" for op, _, _ in part), sum(op != "-" for op, _, _ in part)
        out.append(f"@@ -{part[0][1] + 1},{removed} +{part[0][2] + 1},{added} @@")
        out += [op + (b[j] if op == "+" else a[i]) for op, i, j in part]
    return "\n".join(out) + "\n"
