import re

from hypothesis import given, settings
from hypothesis import strategies as st

from chronolake.functions import diff


def apply_patch(old: str, patch: str) -> str:
    if not patch:
        return old
    lines, out, at = diff.lines_of(old), [], 0
    body = patch[:-1].split("\n")[2:]
    for line in body:
        if m := re.fullmatch(r"@@ -(\d+),(\d+) \+(\d+),(\d+) @@", line):
            start = int(m[1]) - 1
            out += lines[at:start]
            at = start
        elif line[0] == "+":
            out.append(line[1:])
        else:
            assert lines[at] == line[1:]
            out += [lines[at]] if line[0] == " " else []
            at += 1
    return "\n".join(out + lines[at:])


TEXT = st.lists(st.sampled_from(["a", "b", "c", "", "dd"]), max_size=25).map("\n".join)


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT, st.integers(0, 4))
def test_patch_applies(old, new, context):
    assert apply_patch(old, diff.unified(old, new, "p", "p", context)) == new


@settings(max_examples=100, deadline=None)
@given(TEXT, TEXT)
def test_script_is_shortest(old, new):
    a, b = diff.lines_of(old), diff.lines_of(new)
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    assert sum(op != " " for op, _, _ in diff._script(a, b)) == len(a) + len(b) - 2 * table[-1][-1]


def test_format():
    assert diff.unified("x", "x", "p", "p") == ""
    assert diff.unified("", "a\nb", "p", "p") == "--- a/p\n+++ b/p\n@@ -1,0 +1,2 @@\n+a\n+b\n"
    assert diff.unified("one\ntwo\n", "one\nTWO\n", "f", "f") == "--- a/f\n+++ b/f\n@@ -1,3 +1,3 @@\n one\n-two\n+TWO\n \n"


def test_hunks_split_and_merge():
    old = "\n".join(map(str, range(40)))
    near = old.replace("10", "x").replace("16", "y")
    far = old.replace("\n10\n", "\nx\n").replace("\n30\n", "\ny\n")
    assert diff.unified(old, near, "p", "p").count("@@ -") >= 1
    assert diff.unified(old, far, "p", "p").count("@@ -") == 2


def test_large_files_have_a_shortest_script_too():
    old = [f"a{i}" for i in range(12_000)]
    new = old[:500] + ["b"] + old[501:9000] + old[9100:] + ["c"]
    patch = diff.unified("\n".join(old), "\n".join(new), "p", "p")
    assert apply_patch("\n".join(old), patch) == "\n".join(new)
    assert sum(op != " " for op, _, _ in diff._script(old, new)) == 2 + 100 + 1


def test_unlike_files_take_little_room():
    import tracemalloc

    old, new = ([f"{name}{i}" for i in range(6_000)] for name in "ab")
    tracemalloc.start()
    script = diff._script(old, new)
    assert len(script) == 12_000 and tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()
