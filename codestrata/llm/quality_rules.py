"""Quality classifier: a sparse ensemble of rules.

Statistics of whole texts feed small boosted trees; every path of a tree from its root to a node is a conjunctive rule
over statistics. An L1-penalised logistic regression over the rules keeps few of them, and what is left is compiled
into one Spark column expression. Only the fit, on a bounded sample of labelled rows, runs on the driver.
"""

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that the fit takes: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
TREES = 40
DEPTH = 3
MIN_LEAF = 20
#: With few rows a leaf may be smaller: a two-hundredth of them, five at least.
CUTS = 32
RATE = 0.2
SEED = 7
PENALTY = 0.002
THRESHOLD = 0.7

STATISTICS = (
    "log_bytes", "upper", "digit", "stop", "mark", "symbol", "bang", "pipe", "newline", "other", "word_length", "word_spread", "longest_word",
    "words_distinct", "top_word", "short_words", "symbol_ends", "lines_distinct", "line_words", "squeeze",
)


def _classes() -> np.ndarray:
    kinds = np.full(256, 9, dtype=np.int64)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b";:'\"-()?", b"#$%&*@^_~<>/\\=+[]{}`", b"!", b"|", b"\n", b"abcdefghijklmnopqrstuvwxyz \t")):
        kinds[list(chars)] = k
    return kinds


_KIND = _classes()


def statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` over a whole text; all zero for none."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, w = len(data), len(words)
    upper, digit, stop, mark, symbol, bang, pipe, newline, _, other = np.bincount(_KIND[np.frombuffer(data, dtype=np.uint8)], minlength=10) / n
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=w)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    ends = sum(m for word, m in counts.items() if not word[-1:].isalnum() and word[-1] not in b".,;:?\"')" and word[-1] < 128)
    squeezed = zlib.compress(data, 1)
    return [
        float(np.log1p(n)), upper, digit, stop, mark, symbol, bang, pipe, newline, other, float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())),
        len(counts) / w, max(counts.values()) / w, float((lengths < 3).mean()), ends / w, len(set(lines)) / len(lines), float(np.log1p(w / len(lines))), len(squeezed) / n,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """(id_of_row, the ``carried`` long columns, one double column for each statistic)."""
    names = ["id_of_row", *carried]

    def run(batches):
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column("text").to_pylist()], dtype=np.float64).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(rows[:, k]) for k in range(len(STATISTICS)))], names=[*names, *STATISTICS])

    rows = docs.select(F.col(id_col).cast("long").alias("id_of_row"), *carried, F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join([f"{c} long" for c in names] + [f"{s} double" for s in STATISTICS]))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, upper side, cut) that must all hold: value > cut, or value <= cut."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for k, above, cut in self.conditions:
            out &= (x[:, k] > cut) == above
        return out

    def column(self, values: list[Column]) -> Column:
        out = F.lit(True)
        for k, above, cut in self.conditions:
            c = values[k]
            out = out & (c > F.lit(cut) if above else c <= F.lit(cut))
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    terms: tuple[tuple[Rule, float], ...]

    def score_column(self, values: list[Column]) -> Column:
        """A plain column expression over the columns of the statistics."""
        z = F.lit(self.intercept)
        for rule, weight in self.terms:
            z = z + F.when(rule.column(values), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.terms:
            z += weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))


def _tree(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, path: tuple, depth: int, out: list, fit: np.ndarray) -> None:
    """Grows a regression tree on the residual, adds the rule of each node below the root and the leaf means to fit."""
    best = None
    r = residual[rows]
    min_leaf = min(MIN_LEAF, max(5, len(residual) // 200))
    if depth and len(rows) >= 2 * min_leaf:
        total, n = r.sum(), len(rows)
        for k, at in enumerate(cuts):
            if not len(at):
                continue
            bin_of = np.searchsorted(at, x[rows, k], side="left")  # bin b: value <= at[b]
            count = np.cumsum(np.bincount(bin_of, minlength=len(at) + 1))[:-1]
            left = np.cumsum(np.bincount(bin_of, weights=r, minlength=len(at) + 1))[:-1]
            ok = (count >= min_leaf) & (n - count >= min_leaf)
            if ok.any():
                gain = np.where(ok, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1), -np.inf)
                j = int(gain.argmax())
                if best is None or gain[j] > best[0] + 1e-9:
                    best = gain[j], k, float(at[j])
        if best is not None and best[0] <= total**2 / n + 1e-6:
            best = None
    if best is None:
        fit[rows] = r.mean() if len(rows) else 0.0
        return
    _, k, cut = best
    values = x[rows, k]
    cut = float((values[values <= cut].max() + values[values > cut].min()) / 2)  # midway between the sides
    above = x[rows, k] > cut
    for side in (False, True):
        below = (*path, (k, side, cut))
        out.append(Rule(below))
        _tree(x, cuts, residual, rows[above == side], below, depth - 1, out, fit)


def _lasso(h: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient."""
    n, m = h.shape
    base = min(max(y.mean(), 1 / (n + 2)), 1 - 1 / (n + 2))
    b, w = float(np.log(base / (1 - base))), np.zeros(m)
    v = np.ones(m)
    for _ in range(20):  # the largest singular value bounds the step
        v = h.T @ (h @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    rate = 4 * n / (np.linalg.norm(h @ v) ** 2 + n)
    wb, ww, t = b, w.copy(), 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(h @ ww + wb))) - y
        b_new = wb - rate * g.mean()
        step = ww - rate * (h.T @ g) / n
        w_new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ww, wb = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        b, w, t = b_new, w_new, t_new
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """Without rows every score is 1, since nothing speaks against a text; of one class alone, its smoothed rate."""
    if not len(y):
        return RuleModel(40.0, ())
    if len(set(y.tolist())) < 2:
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel(float(np.log(rate / (1 - rate))), ())
    cuts = [np.unique(np.quantile(c, np.arange(1, CUTS) / CUTS)) for c in x.T]
    cuts = [c[c < x[:, k].max()] for k, c in enumerate(cuts)]
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: list[Rule] = []
    dice = np.random.default_rng(SEED)
    for _ in range(trees):
        fit = np.zeros(len(y))
        some = set(dice.permutation(x.shape[1])[: -(-x.shape[1] // 2)].tolist())  # half the statistics a tree, so that rules differ
        _tree(x, [c if k in some else c[:0] for k, c in enumerate(cuts)], y - 1 / (1 + np.exp(-z)), np.arange(len(y)), (), depth, rules, fit)
        z += 4 * RATE * fit
    rules = list(dict.fromkeys(rules))
    if not rules:
        return RuleModel(float(z[0]), ())
    h = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    support = h.mean(axis=0)
    scale = np.sqrt(np.maximum(support * (1 - support), 1e-4))
    b, w = _lasso((h - support) / scale, y.astype(np.float64), penalty)
    w = w / scale
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(float(b - support @ w), tuple((rules[i], float(w[i])) for i in kept))


def held_out_column(doc_id: Column) -> Column:
    """Rows that never lend a label: crc32 of the id as text leaves 2 modulo 4. A null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> RuleModel:
    """Fits on the labelled rows that are not held out, ``fit_rows`` at most (those with the smallest hashes of their ids).

    Rows without an id or label teach nothing; several labels of one id count by their majority, ties as 1.
    """
    taught = labels.select(F.col(id_col).cast("long").alias("taught"), F.col(label_col).cast("double").alias("label")).dropna()
    taught = taught.where(~held_out_column(F.col("taught"))).groupBy("taught").agg((F.avg("label") >= 0.5).cast("long").alias("label"))
    taught = taught.orderBy(F.xxhash64("taught"), "taught").limit(fit_rows)
    # At most fit_rows lines of two numbers: small enough to send to every task, so the texts stay where they are.
    rows = docs.select(F.col(id_col).cast("long").alias("taught"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("of_text"))
    rows = with_statistics(rows.join(F.broadcast(taught), "taught"), "taught", carried=("label", "of_text"))
    found = rows.orderBy(F.xxhash64("id_of_row"), "id_of_row", "of_text").limit(fit_rows).toArrow()
    x = np.stack([found.column(s).to_numpy() for s in STATISTICS], axis=1) if found.num_rows else np.zeros((0, len(STATISTICS)))
    return fit_rules(x, found.column("label").to_numpy().astype(np.int64))


def score_documents(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For each row: the id, ``held_out``, ``score`` (0 to 1; higher: label 1 is likelier) and ``predicted`` (1 from ``threshold`` on).

    One pass without a shuffle. Null, empty and blank texts have statistics of zero and a score as others do. Rows
    of one id or text keep a row each. Other columns are ignored; an empty table gives an empty result.
    """
    stats = with_statistics(docs, id_col, text_col).withColumn("score", model.score_column([F.col(s) for s in STATISTICS]))
    return stats.select(F.col("id_of_row").alias(id_col), held_out_column(F.col("id_of_row")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, all columns kept."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    values = of.asNondeterministic()(F.col(text_col))  # so that it is computed once a row, not once a rule
    packed = docs.select(F.struct("*").alias("row"), values.alias("values"))
    score = model.score_column([F.col("values")[k] for k in range(len(STATISTICS))])
    return packed.where(score >= threshold).select("row.*")
