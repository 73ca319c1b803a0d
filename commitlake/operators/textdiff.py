"""Line diffs: shortest edit scripts, operations, hunks, unified text, and line deltas."""

from __future__ import annotations

import json
from array import array
from collections import defaultdict
from collections.abc import Iterator
from math import isqrt

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Cells of the trace beyond which a shortest script is found by bits, without a trace.
BUDGET = 8_000_000
#: Lines that occur more often keep their bits.
_OFTEN = 1000
Edit = tuple[str, int, int, int, int]


def lines_of(text: Column) -> Column:
    """array of lines without their line feed; the empty text has none."""
    parts = F.split(text, "\n", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(whole)


def split_lines(text: str) -> tuple[list[str], bool]:
    """Lines and whether the last one ends with a line feed."""
    if not text:
        return [], False
    parts = text.split("\n")
    return (parts[:-1], True) if parts[-1] == "" else (parts, False)


def _path(a: list, b: list, budget: int) -> list[tuple[int, int]]:
    """Matched index pairs of a shortest script: furthest-reaching points for each number of edits, then back.

    ``trace[d]`` keeps the points of diagonals -d to d before step d, four bytes
    each.  When the steps have cost what ``_common`` would, that tells how many
    there will be; if their trace would outgrow ``budget``, its pairs are taken.
    """
    if set(a).isdisjoint(b):
        return []
    n, m = len(a), len(b)
    most = n + m
    furthest, trace, cells = array("i", bytes(4 * (2 * most + 3))), [], 0
    zero = most + 1  # where diagonal 0 is
    ask = min(budget, m * (n // 2000 + 5))
    for d in range(most + 1):
        trace.append(furthest[zero - d : zero + d + 1])
        cells += 2 * d + 1
        if cells > ask:
            found, ask = _common(a, b), (most + 1) ** 2
            if (most - 2 * len(found) + 1) ** 2 > budget:
                return found
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and furthest[zero + k - 1] < furthest[zero + k + 1])
            x = furthest[zero + k + 1] if down else furthest[zero + k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            furthest[zero + k] = x
            if x >= n and x - k >= m:
                return _back(trace, n, m)
    raise AssertionError("n + m edits always do")


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, by rows of bits.

    Bit x of row y is 0 where line x of ``a`` lengthens what its first x lines
    have in common with the first y of ``b``.  Rows are kept at every root of
    their number; those between are made again on the way back.  Lines of one
    side only are left out first.
    """
    both = set(a) & set(b)
    old, new = ([i for i, x in enumerate(side) if x in both] for side in (a, b))
    places, often = defaultdict(list), {}
    for x, i in enumerate(old):
        places[a[i]].append(x)
    width = (len(old) + 7) // 8
    full = (1 << len(old)) - 1

    def bits(line) -> int:
        found = often.get(line)
        if found is None:
            held = bytearray(width)
            for x in places[line]:
                held[x >> 3] |= 1 << (x & 7)
            found = int.from_bytes(held, "little")
            if len(places[line]) > _OFTEN:
                often[line] = found
        return found

    def after(row: int, y: int) -> int:
        met = row & bits(b[new[y]])
        return ((row + met) | (row - met)) & full

    step = isqrt(len(new)) + 1
    row, kept = full, []
    for y in range(len(new)):
        if y % step == 0:
            kept.append(row)
        row = after(row, y)
    pairs, x = [], len(old)
    for part in range(len(kept) - 1, -1, -1):
        low, row = part * step, kept[part]
        rows = [row.to_bytes(width, "little")]
        for y in range(low, min(low + step, len(new))):
            row = after(row, y)
            rows.append(row.to_bytes(width, "little"))
        y = len(rows) - 1
        while x and y:
            at, bit = (x - 1) >> 3, 1 << ((x - 1) & 7)
            if rows[y][at] & bit:
                x -= 1
            elif rows[y - 1][at] & bit:
                x, y = x - 1, y - 1
                pairs.append((old[x], new[low + y]))
            else:
                y -= 1
    return pairs[::-1]


def _back(trace: list[array], n: int, m: int) -> list[tuple[int, int]]:
    pairs, x, y = [], n, m
    for d in range(len(trace) - 1, 0, -1):
        before, k = trace[d], x - y
        down = k == -d or (k != d and before[d + k - 1] < before[d + k + 1])
        k += 1 if down else -1
        x0 = before[d + k]
        y0 = x0 - k
        # Equal lines follow the one edit of this step.
        while x > x0 + (not down) and y > y0 + down:
            x, y = x - 1, y - 1
            pairs.append((x, y))
        x, y = x0, y0
    while x > 0 and y > 0:
        x, y = x - 1, y - 1
        pairs.append((x, y))
    return pairs[::-1]


def edits(a: list, b: list, budget: int = BUDGET) -> list[Edit]:
    """(op, a_start, a_count, b_start, b_count) from equal, delete and insert ranges, in order."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    pairs = _path(a[head : len(a) - tail], b[head : len(b) - tail], budget)
    pairs = [(i, i) for i in range(head)] + [(x + head, y + head) for x, y in pairs] + [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]
    out: list[Edit] = []
    x = y = at = 0
    while True:
        end = at
        while end < len(pairs) and pairs[end] == (x + end - at, y + end - at):
            end += 1
        if end > at:
            out.append(("equal", x, end - at, y, end - at))
            x, y, at = x + end - at, y + end - at, end
        nx, ny = pairs[at] if at < len(pairs) else (len(a), len(b))
        if nx > x:
            out.append(("delete", x, nx - x, y, 0))
        if ny > y:
            out.append(("insert", nx, 0, y, ny - y))
        if at == len(pairs):
            return out
        x, y = nx, ny


def diff_text(a: str, b: str, normalize=None, budget: int = BUDGET) -> list[Edit]:
    """Edits of two texts; a last line without line feed differs from the same one with it."""
    sides = []
    for text in (a, b):
        lines, final = split_lines(text)
        keys = [normalize(x) if normalize else x for x in lines]
        sides.append([(k, final or i < len(keys) - 1) for i, k in enumerate(keys)])
    return edits(*sides, budget)


Row = tuple[str, int, int]


def operations(changes: list[Edit]) -> list[Row]:
    """(sign, old line, new line), 0-based, of every line kept, deleted or added."""
    rows: list[Row] = []
    for op, i, n, j, m in changes:
        if op == "equal":
            rows += [(" ", i + k, j + k) for k in range(n)]
        elif op == "delete":
            rows += [("-", i + k, j) for k in range(n)]
        else:
            rows += [("+", i, j + k) for k in range(m)]
    return rows


def hunks(rows: list[Row], context: int = 3) -> list[list[Row]]:
    """Changed operations with up to ``context`` kept lines around, merged where these meet."""
    spans: list[list[int]] = []
    for k, (sign, _, _) in enumerate(rows):
        if sign == " ":
            continue
        low, high = max(0, k - context), min(len(rows), k + context + 1)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    return [rows[low:high] for low, high in spans]


def place(hunk: list[Row]) -> tuple[int, int, int, int]:
    """1-based old start, old count, new start, new count; a side without lines keeps the offset."""
    n, m = sum(r[0] != "+" for r in hunk), sum(r[0] != "-" for r in hunk)
    return hunk[0][1] + (n > 0), n, hunk[0][2] + (m > 0), m


def unified(a: str, b: str, old: str = "a", new: str = "b", context: int = 3, normalize=None) -> str:
    """Unified text of all hunks; empty if nothing differs."""
    (la, fa), (lb, fb) = split_lines(a), split_lines(b)
    found = hunks(operations(diff_text(a, b, normalize)), context)
    out = [f"--- {old}\n+++ {new}\n"] if found else []
    for hunk in found:
        starts = place(hunk)
        ranges = [f"{start}" + ("" if count == 1 else f",{count}") for start, count in (starts[:2], starts[2:])]
        out.append(f"@@ -{ranges[0]} +{ranges[1]} @@\n")
        for op, i, j in hunk:
            lines, at, final = (lb, j, fb) if op == "+" else (la, i, fa)
            out.append(f"{op}{lines[at]}\n")
            if at == len(lines) - 1 and not final:
                out.append("\\ No newline at end of file\n")
    return "".join(out)


def line_delta(base: str, target: str) -> str:
    """JSON of the ranges of ``base`` and the lines that make ``target``."""
    lines, final = split_lines(target)
    steps = [[i, n] if op == "equal" else lines[j : j + m] for op, i, n, j, m in diff_text(base, target) if op != "delete"]
    return json.dumps({"final": final, "steps": steps}, ensure_ascii=False, separators=(",", ":"))


def apply_line_delta(base: str, delta: str) -> str:
    given, lines, out = json.loads(delta), split_lines(base)[0], []
    for step in given["steps"]:
        out += lines[step[0] : step[0] + step[1]] if step and isinstance(step[0], int) else step
    return "\n".join(out) + ("\n" if given["final"] else "")


_PLACES = ("a_start", "a_count", "b_start", "b_count")
#: Type objects, not text: workers import this module without a session.
EDITS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in _PLACES]]))


@F.pandas_udf(EDITS)
def diff_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    names = ("op", *_PLACES)
    return pd.Series([[dict(zip(names, e)) for e in diff_text(x or "", y or "")] for x, y in zip(a, b)])


#: Lines added, deleted and kept.
COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("added", "deleted", "kept")])


def count_lines(changes: list[Edit]) -> tuple[int, int, int]:
    return tuple(sum(e[n] for e in changes if e[0] == op) for op, n in (("insert", 4), ("delete", 2), ("equal", 2)))


@F.arrow_udf(COUNTS)
def diff_counts(a: pa.Array, b: pa.Array) -> pa.Array:
    """Numbers only: texts become Python objects one pair at a time, and no edit leaves the task."""
    found = [count_lines(diff_text(x.as_py() or "", y.as_py() or "")) for x, y in zip(a, b)]
    return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], ["added", "deleted", "kept"])


@F.pandas_udf(T.StringType())
def unified_text(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([unified(x or "", y or "") for x, y in zip(a, b)], dtype=object)


def added(e: Column) -> Column:
    return F.aggregate(e, F.lit(0).cast("long"), lambda s, x: s + F.when(x["op"] == "insert", x["b_count"]).otherwise(0))


def deleted(e: Column) -> Column:
    return F.aggregate(e, F.lit(0).cast("long"), lambda s, x: s + F.when(x["op"] == "delete", x["a_count"]).otherwise(0))


#: hunk: its place and its lines with their signs.
HUNKS = T.ArrayType(T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("old_start", "old_count", "new_start", "new_count")], T.StructField("signs", T.StringType())]))


def placed_hunks(a: str, b: str) -> list[dict]:
    names = ("old_start", "old_count", "new_start", "new_count")
    return [dict(zip(names, place(h))) | {"signs": "".join(r[0] for r in h)} for h in hunks(operations(diff_text(a, b)))]


@F.pandas_udf(HUNKS)
def diff_hunks(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([placed_hunks(x or "", y or "") for x, y in zip(a, b)])


def balance(a: str, b: str) -> int:
    """Lines added less lines deleted."""
    added, deleted, _ = count_lines(diff_text(a, b))
    return added - deleted


#: Characters of texts, and pairs, of one batch of results.
_CHARACTERS, _PAIRS = 8 << 20, 500


def of_pairs(make, name: str, kind: T.DataType, lacking: bool = False):
    """For ``pairing.in_blocks``: (old_content, new_content, name) of pairs, ``make`` of both texts; null counts as empty.

    Pairs of which a content is not there are left out, or have null if ``lacking``.
    """

    def run(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = right.column("text").combine_chunks()
        at = {c: k for k, c in enumerate(right.column("content_id").to_pylist())}
        value = to_arrow_type(kind)
        for batch in left.to_batches(_PAIRS):
            ends = zip(batch.column("old_content").to_pylist(), batch.column("new_content").to_pylist())
            known = pa.array([a in at and b in at for a, b in ends], pa.bool_())
            kept = batch.filter(known)
            if lacking and kept.num_rows < batch.num_rows:
                others = batch.filter(pc.invert(known))
                yield pa.RecordBatch.from_arrays([others.column("old_content"), others.column("new_content"), pa.nulls(others.num_rows, value)], ["old_content", "new_content", name])
            old, new = (kept.column(c) for c in ("old_content", "new_content"))
            made, held, first = [], 0, 0
            for k, (a, b) in enumerate(zip(old.to_pylist(), new.to_pylist())):
                x, y = texts[at[a]].as_py() or "", texts[at[b]].as_py() or ""
                made.append(make(x, y))
                held += len(x) + len(y)
                if held > _CHARACTERS or k + 1 == kept.num_rows:
                    yield pa.RecordBatch.from_arrays([old.slice(first, len(made)), new.slice(first, len(made)), pa.array(made, value)], ["old_content", "new_content", name])
                    made, held, first = [], 0, k + 1

    return run


@F.arrow_udf(T.StringType())
def encode_line_delta(base: pa.Array, target: pa.Array) -> pa.Array:
    return pa.array([line_delta(x.as_py() or "", y.as_py() or "") for x, y in zip(base, target)], pa.string())


@F.arrow_udf(T.StringType())
def decode_line_delta(base: pa.Array, delta: pa.Array) -> pa.Array:
    return pa.array([apply_line_delta(x.as_py() or "", y.as_py()) for x, y in zip(base, delta)], pa.string())
