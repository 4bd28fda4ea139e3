"""Syntax trees as rows in interval encoding: d lies below a if a.pre < d.pre and d.post < a.post."""

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata import constants as C
from codestrata.syntax.parser import WORDS, Node, Rows, parse

NODE_SCHEMA = (
    "repo_id string, file string, error string, pre int, post int, parent_pre int, field string, type string, start_row int, end_row int, "
    "named_child_count int, text string, fn_pre int, fn_stack array<int>, nest_abs int, name string, param_count int, operator string, is_console boolean, visit_ord int"
)
_COLUMNS = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
_MEASURED = {*C.FUNCTION_TYPES, *C.NESTING_TYPES, *C.BRANCH_TYPES}


def _child(node: Node, field: str) -> Node | None:
    return next((c for c in node.children if c.field == field), None)


def _name(node: Node, parent: Node | None) -> str:
    for owner, field in ((node, "name"), (parent if parent is not None and parent.type == "variable_declarator" else None, "name"), (parent if parent is not None and parent.type == "pair" else None, "key")):
        if owner is not None and (c := _child(owner, field)) is not None:
            return c.text if c.text is not None else "(pattern)"
    return "(anonymous)"


def _console(node: Node) -> bool:
    f = _child(node, "function")
    if node.type != "call_expression" or f is None or f.type != "member_expression":
        return False
    o, p = _child(f, "object"), _child(f, "property")
    return o is not None and o.type == "identifier" and o.text == "console" and p is not None and p.text in C.CONSOLE_METHODS


SKIP = object()


def walk(root: Node, enter: Callable[[Node], object] | None = None, leave: Callable[[Node], None] | None = None) -> None:
    """Calls ``enter`` on each named node before those below it and ``leave`` after them, siblings last to first. A node for which
    ``enter`` returns ``SKIP`` is left out with all below it: nothing there is entered, and it is not left."""
    pending: list[tuple[Node, bool]] = [(root, True)]
    while pending:
        node, entering = pending.pop()
        if not entering:
            leave(node)
        elif not (enter is not None and enter(node) is SKIP):
            if leave is not None:
                pending.append((node, False))
            pending += [(c, True) for c in node.children if c.type != "operator"]


def _is_measured(node: Node, operator: Node | None, named: int) -> bool:
    """Whether a measure of the file depends on the node's own row: functions, what nests or branches, empty blocks, calls of the console."""
    return node.type in _MEASURED or node.type == "statement_block" and not named or operator is not None and operator.text in C.BRANCH_OPERATORS or _console(node)


def tree_rows(code: str, tsx: bool = False, function_expressions: bool = False, measured: bool = False) -> list[tuple]:
    """(pre, post, parent_pre, field, type, ...) of each named node, without repo and file; with ``measured`` of those only on whose own row a
    measure of the file depends, and of the root, with the same numbers.

    ``visit_ord`` orders siblings last to first; ``fn_stack`` holds the enclosing functions, outermost first, self included.
    """
    root, row_of = parse(code, tsx, function_expressions, words=measured), Rows(code)
    out: list[list] = []
    n = post = 0
    stack: list[tuple[Node | None, Node | list | None, int | None, tuple, int]] = [(root, None, None, (), 0)]
    while stack:
        node, parent, parent_pre, fns, nest = stack.pop()
        if node is None:  # leaving
            if parent is not None:
                parent[1] = post
            post += 1
            continue
        if node.type == WORDS:
            n, post = n + 2 * node.names, post + 2 * node.names  # each name comes with its statement, or with what joins it to those before
            continue
        pre, n = n, n + 1
        is_fn = node.type in C.FUNCTION_TYPES
        fns = (*fns, pre) if is_fn else fns
        nest += node.type in C.NESTING_TYPES
        named = [c for c in node.children if c.type != "operator"]
        count = sum(c.comments if c.type == WORDS else 1 for c in named) + (node.comments if node.type == "statement_block" else 0)
        operator = _child(node, "operator") if node.type == "binary_expression" else None
        row = None
        if not measured or pre == 0 or _is_measured(node, operator, count):
            params = _child(node, "parameters") if is_fn else None
            n_params = sum(c.type in C.PARAMETER_TYPES for c in params.children) if params is not None else 0
            row = [pre, 0, parent_pre, node.field, node.type, row_of.of(node.start), row_of.of(max(node.start, node.end - 1) if node.end > node.start else node.start), count, node.text, fns[-1] if fns else None, list(fns), nest, _name(node, parent) if is_fn else None, n_params if is_fn else None, operator.text if operator is not None else None, _console(node), 0]
            out.append(row)
        stack.append((None, row, None, (), 0))
        stack += [(c, node, pre, fns, nest) for c in reversed(named)]
    for row in out:
        row[-1] = n - 1 - row[1]  # a walk that takes siblings last to first is the way back of one that leaves them first to last
    return [tuple(r) for r in out]


def parse_files(files: DataFrame, function_expressions: bool = False, measured: bool = False) -> DataFrame:
    """``NODE_SCHEMA`` rows of the files (repo_id, file, content); a file that cannot be parsed gives one row with ``error``. With ``measured``
    only the nodes that measures depend on leave the parser (``tree_rows``).

    The one Python boundary of the engine, in Arrow batches; files are independent, so any partitioning will do.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(20_000)
        for batch in batches:
            rows: list[tuple] = []
            for repo, file, content in zip(batch["repo_id"], batch["file"], batch["content"], strict=True):
                try:
                    found = tree_rows(content or "", file.endswith(".tsx"), function_expressions, measured)
                    rows += [(repo, file, None, *r) for r in found]
                except (RecursionError, ValueError, IndexError) as e:
                    rows.append((repo, file, type(e).__name__, *[None] * 17))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=_COLUMNS).astype(_KINDS)
                    rows = []
            yield pd.DataFrame(rows, columns=_COLUMNS).astype(_KINDS)

    return files.select("repo_id", "file", "content").mapInPandas(run, NODE_SCHEMA)


_KINDS = {c: "Int32" for c in ("pre", "post", "parent_pre", "start_row", "end_row", "named_child_count", "fn_pre", "nest_abs", "param_count", "visit_ord")} | {"is_console": "boolean"}


def analysed(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("error").isNull())
