"""Functions, classes and methods of Python sources, and the likeness of two syntax trees; both need Python's parser."""

from __future__ import annotations

import ast
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..batches import small_batches
from ..schemas import CODE_SAMPLE

#: Characters of units that go back to the JVM at once.
PIECE_CHARS = 1 << 20
#: Special methods that carry logic (fixed values).
KEPT_DUNDERS = {"__call__", "__getitem__", "__setitem__", "__iter__", "__next__", "__enter__", "__exit__"}
FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


@dataclass(frozen=True)
class UnitOptions:
    min_lines: int = 3
    max_lines: int = 100
    min_chars: int = 100
    max_chars: int = 3000
    skip_trivial: bool = True
    skip_tests: bool = True
    skip_dunders: bool = True
    include_methods: bool = True


def body_of(node) -> list[ast.stmt]:
    """Statements after a leading constant, such as a docstring."""
    first = node.body[:1]
    lead = bool(first) and isinstance(first[0], ast.Expr) and isinstance(first[0].value, ast.Constant)
    return node.body[lead:]


def is_trivial(node) -> bool:
    """Nothing, one `pass` or `...`, one raise, or one return of nothing or a constant."""
    body = body_of(node)
    if len(body) != 1:
        return not body
    match body[0]:
        case ast.Pass() | ast.Raise() | ast.Return(value=None) | ast.Return(value=ast.Constant()):
            return True
        case ast.Expr(value=ast.Constant(value=value)):
            return value is ...
    return False


def only_stores(node) -> bool:
    """An `__init__` that does nothing but set attributes of self."""
    def stores(s) -> bool:
        match s:
            case ast.Assign(targets=[ast.Attribute(value=ast.Name(id="self"))]):
                return True
        return False

    return node.name == "__init__" and all(map(stores, body_of(node)))


def wanted(node, o: UnitOptions) -> bool:
    name = node.name
    if o.skip_tests and (name.startswith("test_") or name.endswith("_test")):
        return False
    if o.skip_dunders and name[:2] == "__" == name[-2:] and name not in KEPT_DUNDERS:
        return False
    return not (o.skip_trivial and (is_trivial(node) or only_stores(node)))


def units(source: str, path: str, o: UnitOptions) -> list[dict]:
    """Units of one source, breadth first; none if it can't be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, nodes = source.split("\n"), list(ast.walk(tree))
    methods = {id(child) for node in nodes if isinstance(node, ast.ClassDef) for child in node.body if isinstance(child, FUNCTION)}

    def unit(kind: str, node, name: str, metadata: dict | None = None) -> list[dict]:
        code = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        count = sum(bool(s) and s[0] != "#" for s in map(str.strip, code.strip().split("\n")))
        fits = o.min_lines <= count <= o.max_lines and o.min_chars <= len(code) <= o.max_chars
        return [{"code": code, "language": "python", "unit_type": kind, "name": name, "file_path": path, "start_line": node.lineno, "end_line": node.end_lineno or node.lineno, "metadata": metadata}] if fits else []

    out = []
    for node in nodes:
        if isinstance(node, FUNCTION) and id(node) not in methods and wanted(node, o):
            out += unit("function", node, node.name)
        elif isinstance(node, ast.ClassDef):
            out += unit("class", node, node.name)
            for child in node.body if o.include_methods else []:
                if isinstance(child, FUNCTION) and wanted(child, o):
                    out += unit("method", child, f"{node.name}.{child.name}", {"class": node.name})
    return out


def code_units(df: DataFrame, source_col: str = "source", path_col: str = "path", options: UnitOptions = UnitOptions()) -> DataFrame:
    """A row for each unit of each source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CODE_SAMPLE.replace("map<string,string>", "map").split(", ")]
        for pdf in batches:
            rows, size = [], 0
            for source, path in zip(pdf["s"], pdf["p"], strict=True):
                found = [] if source is None else units(source, path, options)
                rows += found
                size += sum(len(u["code"]) for u in found)
                if size > PIECE_CHARS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    small_batches(df.sparkSession)
    return df.select(F.col(source_col).alias("s"), F.col(path_col).alias("p")).mapInPandas(run, CODE_SAMPLE)


#: Above this length of a run, the longest common one is found by halving, below it by counting down.
FEW = 8


def same_ahead(a: str, b: str, i: int, j: int, most: int) -> int:
    """How many characters from a[i] and b[j] on are equal, `most` at most; slices are compared, not characters."""
    n, step = 0, 16
    while n < most and a[i + n : i + n + min(step, most - n)] == b[j + n : j + n + min(step, most - n)]:
        n += min(step, most - n)
        step *= 2
    step = min(step, most - n)
    while step:
        if n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
        else:
            step //= 2
    return n


class CommonRuns:
    """Matching blocks of two strings as `difflib.SequenceMatcher` finds them, for the sum of their lengths alone.

    It takes the longest run that both stretches share of characters that are not frequent in b (over 1 %, if b has 200 or
    more), the first such in a, then in b; lengthens it by any equal characters; and goes on left and right of it. Here
    the places of all runs of one length are looked up once: in a stretch left of a run only shorter runs are left, and
    right of it places are walked on, so each length walks over a once, however many blocks there are."""

    def __init__(self, a: str, b: str):
        self.a, self.b = a, b
        codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b)]
        chars, counts = np.unique(codes[1], return_counts=True)
        rare = chars[counts <= len(b) // 100 + 1] if len(b) >= 200 else chars
        self.power = np.cumprod(np.concatenate(([1], np.full(max(len(a), len(b)), 0x9E3779B97F4A7C15))).astype(np.uint64))
        self.ahead, self.sums = [], []
        for c in codes:
            ends = np.concatenate((np.nonzero(~np.isin(c, rare))[0], [len(c)]))
            self.ahead.append(ends[np.searchsorted(ends, np.arange(len(c)))] - np.arange(len(c)))
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * self.power[: len(c)]))))
        self.known: dict[int, tuple] = {}

    def places(self, n: int) -> tuple[list, list, list, list]:
        """Starts in a of runs of n characters that b may have, and for each where its starts in b begin and end in the
        last list, in order. Hashes stand for the runs."""
        if n not in self.known:
            starts = [np.nonzero(x >= n)[0] for x in self.ahead]
            x, y = ((s[k + n] - s[k]) * self.power[len(self.power) - 1 - k] for s, k in zip(self.sums, starts, strict=True))
            order = np.argsort(y, kind="stable")
            low, high = (np.searchsorted(y[order], x, side) for side in ("left", "right"))
            some = low < high
            self.known[n] = starts[0][some].tolist(), low[some].tolist(), high[some].tolist(), starts[1][order].tolist()
        return self.known[n]

    def first(self, n: int, stretch: tuple[int, int, int, int], at: int) -> tuple[int, int, int] | None:
        """(number, place in a, place in b) of the first run of n characters in the stretches, from the at-th start on."""
        _, a_to, b_from, b_to = stretch
        starts, low, high, there = self.places(n)
        for k in range(at, len(starts)):
            i = starts[k]
            if i + n > a_to:
                return None
            m = bisect_left(there, b_from, low[k], high[k])
            while m < high[k] and there[m] + n <= b_to:
                if self.a[i : i + n] == self.b[there[m] : there[m] + n]:
                    return k, i, there[m]
                m += 1
        return None

    def longest(self, stretch: tuple[int, int, int, int], most: int) -> int:
        """The length of the longest run in the stretches if it is over FEW, else FEW."""
        low, high = FEW, min(most, stretch[1] - stretch[0], stretch[3] - stretch[2])
        while low < high:
            n = (low + high + 1) // 2
            if self.first(n, stretch, bisect_left(self.places(n)[0], stretch[0])):
                low = n
            else:
                high = n - 1
        return low

    def matched(self) -> int:
        a, b, total = self.a, self.b, 0
        todo = [(0, len(a), 0, len(b), int(min(x.max(initial=0) for x in self.ahead)))]
        while todo:
            a_from, a_to, b_from, b_to, n = todo.pop()
            n = min(n, a_to - a_from, b_to - b_from)
            if n > FEW:
                n = self.longest((a_from, a_to, b_from, b_to), n)
            while n > 0 and a_from < a_to and b_from < b_to:
                at = bisect_left(self.places(n)[0], a_from)
                while (hit := self.first(n, (a_from, a_to, b_from, b_to), at)) is not None:
                    at, i, j = hit
                    back = 0
                    while i - back > a_from and j - back > b_from and a[i - back - 1] == b[j - back - 1]:
                        back += 1
                    size = back + n + same_ahead(a, b, i + n, j + n, min(a_to - i, b_to - j) - n)
                    i, j, total = i - back, j - back, total + size
                    if a_from < i and b_from < j:
                        todo.append((a_from, i, b_from, j, n - 1))
                    a_from, b_from = i + size, j + size
                    at = bisect_left(self.places(n)[0], a_from, at)
                n = self.longest((a_from, a_to, b_from, b_to), n - 1) if n - 1 > FEW else n - 1
            total += same_ahead(a, b, a_from, b_from, max(0, min(a_to - a_from, b_to - b_from)))
        return total


def likeness(a: str, b: str) -> float:
    """`difflib.SequenceMatcher(None, a, b).ratio()`."""
    if a == b:
        return 1.0
    return 2.0 * CommonRuns(a, b).matched() / (len(a) + len(b))


def tree_likeness(a: str | None, b: str | None) -> float:
    try:
        return likeness(ast.dump(ast.parse(a)), ast.dump(ast.parse(b)))
    except (SyntaxError, ValueError, TypeError, RecursionError):
        return 0.0


@pandas_udf(DoubleType())
def _ast_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([tree_likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ast_similarity(a: Column, b: Column) -> Column:
    """Likeness of the dumps of two syntax trees; 0 where one can't be parsed."""
    return _ast_similarity(a, b)
