"""Diffs of two trees: the files that changed, shortest edit scripts with their hunks, and texts that hunks are applied to."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

#: Equal lines shown around a change.
CONTEXT = 3
#: Pairs of equal lines for each line up to which a script is sought among them.
PAIRS_A_LINE = 8
NO_END = "\\ No newline at end of file"


def blob(text: str) -> Column:
    """What a file's content is known by; null has the content of an empty file."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def changed_files(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, path, status (added, deleted, modified), old_blob, new_blob of the paths whose content two trees don't share.

    old, new: key, path, blob, each path once. Only names and hashes are shuffled; contents come later, for these paths.
    """
    joined = old.select(key, "path", F.col("blob").alias("old_blob")).join(new.select(key, "path", F.col("blob").alias("new_blob")), [key, "path"], "full")
    status = F.when(F.col("old_blob").isNull(), "added").when(F.col("new_blob").isNull(), "deleted").otherwise("modified")
    return joined.where(~F.col("old_blob").eqNullSafe(F.col("new_blob"))).select(key, "path", status.alias("status"), "old_blob", "new_blob")


def with_texts(changes: DataFrame, blobs: DataFrame) -> DataFrame:
    """changes with old and new, the contents (blob, text) on both sides; null where there is no file."""
    for side in ("old", "new"):
        named = blobs.select(F.col("blob").alias(f"{side}_blob"), F.coalesce("text", F.lit("")).alias(side)).dropDuplicates([f"{side}_blob"])
        changes = changes.join(named, f"{side}_blob", "left")
    return changes


def _lines(text: str | None) -> list[str]:
    """Lines with their ends, so that a last line without one is another line."""
    return re.findall(r"[^\n]*\n|[^\n]+", text or "")


def _middle(a: list, b: list) -> tuple[int, int, int, int]:
    """Where the middle diagonal of a shortest edit script begins and ends, searched from both ends at once."""
    n, m = len(a), len(b)
    ends = ({1: 0}, {1: 0})
    for d in range((n + m + 1) // 2 + 1):
        for back, (mine, other) in enumerate((ends, ends[::-1])):
            for k in range(2 * max(0, d - m) - d, d - 2 * max(0, d - n) + 1, 2):
                x = mine[k + 1] if k == -d or (k != d and mine[k - 1] < mine[k + 1]) else mine[k - 1] + 1
                x0, y0 = x, x - k
                y = y0
                while x < n and y < m and (a[n - 1 - x] == b[m - 1 - y] if back else a[x] == b[y]):
                    x, y = x + 1, y + 1
                mine[k] = x
                # an odd distance is met by a step forward, an even one by a step back
                if (n - m) % 2 != back and x + other.get(n - m - k, -n) >= n and abs(n - m - k) <= d - 1 + back:
                    return (n - x, m - y, n - x0, m - y0) if back else (x0, y0, x, y)
    raise AssertionError("the two searches meet")


def _by_ends(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Kept places by the linear-space search for middle diagonals (Myers): memory by the lines, time by lines times edits."""
    kept, open_ = [], [(0, len(x), 0, len(y))]
    while open_:
        i, i_end, j, j_end = open_.pop()
        while i < i_end and j < j_end and x[i] == y[j]:
            kept.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and x[i_end - 1] == y[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            kept.append((i_end, j_end))
        if i < i_end and j < j_end:
            i0, j0, i1, j1 = _middle(x[i:i_end], y[j:j_end])
            kept += [(i + i0 + s, j + j0 + s) for s in range(i1 - i0)]
            open_ += [(i, i + i0, j, j + j0), (i + i1, i_end, j + j1, j_end)]
    return sorted(kept)


def _by_pairs(x: list[int], places: dict[int, list[int]]) -> list[tuple[int, int]]:
    """Kept places by a rising sequence through the pairs of equal lines (Hunt and Szymanski): time and memory by the pairs."""
    tops, links = [], []  # of each length: the least place in y where such a sequence ends, and the sequence, from its end
    for i, v in enumerate(x):
        for j in reversed(places[v]):
            k = bisect_left(tops, j)
            tops[k : k + 1], links[k : k + 1] = [j], [(i, j, links[k - 1] if k else None)]
    kept, link = [], links[-1] if links else None
    while link:
        kept.append(link[:2])
        link = link[2]
    return kept[::-1]


def kept_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places in a and b of the lines that a shortest edit script keeps, in order.

    Lines that the other side lacks can't be kept and are left out first. Where few lines repeat, the pairs of equal lines
    are few, however many edits there are; where many do, the edits decide the time. Both ways are exact.
    """
    number = {line: k for k, line in enumerate(set(a) & set(b))}
    at_a, at_b = ([k for k, line in enumerate(lines) if line in number] for lines in (a, b))
    x, y = [number[a[k]] for k in at_a], [number[b[k]] for k in at_b]
    places: dict[int, list[int]] = {}
    for j, v in enumerate(y):
        places.setdefault(v, []).append(j)
    few = sum(len(places[v]) for v in x) <= PAIRS_A_LINE * (len(x) + len(y))
    return [(at_a[i], at_b[j]) for i, j in (_by_pairs(x, places) if few else _by_ends(x, y))]


def _span(first: int, n: int) -> str:
    return f"{first + (n > 0)}" + ("" if n == 1 else f",{n}")


def file_diff(path: str, old: str | None, new: str | None, context: int = CONTEXT) -> tuple[str, int, int]:
    """The unified diff of one file, and how many lines it adds and removes; None: there is no such file."""
    a, b = _lines(old), _lines(new)
    kept = kept_lines(a, b)
    rows, i, j = [], 0, 0  # sign, line, place in a, place in b
    for to_i, to_j in [*kept, (len(a), len(b))]:
        rows += [("-", a[k], k, j) for k in range(i, to_i)] + [("+", b[k], to_i, k) for k in range(j, to_j)]
        if to_i < len(a) and to_j < len(b):
            rows.append((" ", a[to_i], to_i, to_j))
        i, j = to_i + 1, to_j + 1
    changes = [k for k, row in enumerate(rows) if row[0] != " "]
    hunks: list[list[int]] = []
    for k in changes:
        if hunks and k - hunks[-1][1] <= 2 * context + 1:
            hunks[-1][1] = k
        else:
            hunks.append([k, k])
    out = [f"diff --git a/{path} b/{path}"]
    out += ["new file mode 100644"] if old is None else ["deleted file mode 100644"] if new is None else []
    out += [f"--- {'/dev/null' if old is None else 'a/' + path}", f"+++ {'/dev/null' if new is None else 'b/' + path}"] if hunks else []
    for first, last in hunks:
        shown = rows[max(0, first - context) : last + context + 1]
        n_old, n_new = (sum(row[0] != sign for row in shown) for sign in "+-")
        out.append(f"@@ -{_span(shown[0][2], n_old)} +{_span(shown[0][3], n_new)} @@")
        for sign, line, _, _ in shown:
            out += [sign + line[:-1]] if line.endswith("\n") else [sign + line, NO_END]
    return "\n".join(out) + "\n", len(b) - len(kept), len(a) - len(kept)


def patched(old: str | None, diff: str) -> str:
    """old with the hunks of a file's diff applied."""
    lines, out, at, sign = _lines(old), [], 0, ""
    hunks = diff[diff.find("\n@@ ") + 1 :] if "\n@@ " in diff else ""
    for row in hunks.split("\n")[:-1]:
        if row.startswith("@@ "):
            first, _, n = row.split(" ")[1][1:].partition(",")
            begin = int(first) - (n != "0")
            out += lines[at:begin]
            at = begin
        elif row[:1] == "\\":
            if sign == "+":
                out[-1] = out[-1][:-1]
        else:
            sign = row[:1]
            if sign != "+":
                out += lines[at : at + 1] if sign == " " else []
                at += 1
            else:
                out.append(row[1:] + "\n")
    return "".join(out + lines[at:])


def _text(x) -> str | None:
    return x if isinstance(x, str) else None


@F.pandas_udf(StructType().add("diff", StringType()).add("added", LongType()).add("removed", LongType()))
def _diffed(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([file_diff(p, _text(a), _text(b)) for p, a, b in zip(path, old, new, strict=True)], columns=["diff", "added", "removed"])


@F.pandas_udf(StringType())
def applied(old: pd.Series, diff: pd.Series) -> pd.Series:
    """Each old content with its file's diff applied; no old content is an empty one."""
    return pd.Series([patched(_text(a), b) for a, b in zip(old, diff, strict=True)], dtype=object)


def diffs(changes: DataFrame) -> DataFrame:
    """changes (path, old, new and more) with diff, added and removed: a task diffs the files it has, each on its own."""
    return changes.withColumn("d", _diffed("path", "old", "new")).select(*changes.columns, "d.*")


def commit_diff(files: DataFrame, key: str, most: int) -> DataFrame:
    """key, diff, truncated: the diffs of a key's files by path, as one text of at most so many characters.

    Files that begin beyond the limit are only counted, so no group holds more than the limit and one file.
    """
    sizes = F.sum(F.length("diff")).over(Window.partitionBy(key).orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = files.select(key, "path", "diff", sizes.alias("upto"))
    begins = F.col("upto") - F.length("diff") < most
    head = F.when(begins, F.struct("path", F.substring("diff", 1, most).alias("diff")))
    told = placed.groupBy(key).agg(F.array_sort(F.collect_list(head)).alias("parts"), F.max("upto").alias("size"))
    return told.select(key, F.substring(F.array_join(F.transform("parts", lambda p: p["diff"]), ""), 1, most).alias("diff"), (F.col("size") > most).alias("truncated"))
