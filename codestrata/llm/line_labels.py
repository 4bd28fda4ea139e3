"""Quality rules: a linear-chain conditional random field labels the lines of a text as content or boilerplate.

Lines are described by shares of kinds of bytes, their length and what they repeat. Viterbi decoding finds the likeliest sequence of
labels; a text whose words lie mostly in content lines stays. Counts over the whole text (base rules) go first.

No line is labelled by hand. Lines of good documents are content. Bad documents hold boilerplate, but not in every line: training
starts from all of their lines as boilerplate, then relabels those that the field itself takes for content by a wide margin, but
never the line that is least like it, and fits again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.quality_rules import held_out_column

#: Most labelled documents that the fit takes (those of the smallest hashes of their ids), and most lines of one of them: longer ones teach nothing.
FIT_DOCS, FIT_LINES = 4000, 200
RELABELS = 2
MARGIN = 2.0
PENALTY = 1e-4
STEPS = 100
LEAST_WORDS = 10
REPEATED_PERCENT = 20
WINDOW = 5
#: Share of words in content lines from which a text stays, where no label says better.
CONTENT_SHARE = 0.5

FEATURES = (
    "bias", "upper", "digit", "symbol", "bang", "pipe", "mark", "other", "symbol_ends", "bang_ends", "word_length", "long_words", "log_words", "few_words", "ends_sentence", "starts_upper", "seen_before", "distinct", "symbol_words", "said_twice",
)
CONTENT, BOILERPLATE = 0, 1


def _kinds() -> np.ndarray:
    kinds = np.full(256, 9, dtype=np.int64)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^_~/\\=+[]{}`", b"!", b"|", b".,;:'\"-()?", b"abcdefghijklmnopqrstuvwxyz")):
        kinds[list(chars)] = k
    kinds[[0x20, *range(0x09, 0x0E)]] = 8
    return kinds


_KIND = _kinds()
_BASE_SYMBOLS = np.zeros(256, dtype=bool)
_BASE_SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass
class Lines:
    """Base counts of a text, and its lines that hold words."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    words: np.ndarray  # of each line
    features: np.ndarray  # (lines, FEATURES)

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > REPEATED_PERCENT * self.n_words


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in windows of ``width`` words found twice or more among ``words``."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    own = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    rank, have = own, 1
    while have < width:  # ranks of sequences, twice as long each time; products of two ranks fit in 64 bits
        step = min(have, width - have)
        _, rank = np.unique(rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)
        have += step
    often = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += often
    edge[width : width + n] -= often
    return int((np.cumsum(edge) > 0).sum())


def lines_of(text: str | None) -> Lines:
    data = (text or "").encode()
    words = data.split()  # at the six white-space characters of ASCII, as for bytes
    if not words:
        return Lines(0, 0, 0, 0, 0, np.zeros(0, dtype=np.int64), np.zeros((0, len(FEATURES))))
    raw = np.frombuffer(data, dtype=np.uint8)
    kind = _KIND[raw]
    blank = kind == 8
    chars = ~blank & ((raw & 0xC0) != 0x80)
    line = np.cumsum(raw == 10) - (raw == 10)  # a line's end belongs to it
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]]))
    n_lines = int(line[-1]) + 1
    counts = np.bincount(line[starts], minlength=n_lines)
    held = np.flatnonzero(counts)
    by_kind = np.bincount(line * 10 + kind, minlength=n_lines * 10).reshape(n_lines, 10)[held].astype(np.float64)
    solid = by_kind.sum(axis=1) - by_kind[:, 8]
    share = by_kind / solid[:, None]
    w = counts[held].astype(np.float64)
    of_word = line[starts]
    tally = lambda mask: np.bincount(of_word[mask], minlength=n_lines)[held] / w
    ended, odd = kind[ends], (kind >= 2) & (kind <= 5)
    all_odd = np.diff(np.append(0, np.cumsum(odd)[ends])) == ends - starts + 1
    twice = np.array([False, *map(bytes.__eq__, words, words[1:])])
    first, last = np.searchsorted(of_word, held), np.searchsorted(of_word, held, side="right") - 1
    seen: set[bytes] = set()
    dup = np.zeros(len(held))
    texts = data.split(b"\n")
    for i, k in enumerate(held.tolist()):
        dup[i] = texts[k] in seen
        seen.add(texts[k])
    distinct = np.array([len(set(words[a : b + 1])) for a, b in zip(first.tolist(), last.tolist(), strict=True)]) / w
    x = np.stack([
        np.ones(len(held)), share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 9], tally(ended == 2), tally((ended == 3) | (ended == 4)), np.minimum(solid / w / 10, 3),
        tally(ends - starts >= 20), np.log1p(w) / 5, w < 4, np.isin(raw[ends[last]], list(b".?!:\"")), kind[starts[first]] == 0, dup, distinct, tally(all_odd), tally(twice),
    ], axis=1)
    return Lines(len(words), int(chars.sum()), int(_BASE_SYMBOLS[raw].sum()), int(dup.sum()), repeated_words(words), counts[held], x)


@dataclass(frozen=True)
class Field:
    """Weights of the two labels over the features, of the pairs of neighbouring labels, and the least share of content."""

    emission: np.ndarray  # (2, FEATURES)
    transition: np.ndarray  # (2, 2)
    least_share: float = CONTENT_SHARE


def viterbi(scores: np.ndarray, transition: np.ndarray) -> list[int]:
    """The likeliest labels of a line sequence, ties to content; a step a line, whatever its length."""
    (stay, leave), (back, keep) = transition.tolist()
    rows, came = scores.tolist(), []
    if not rows:
        return []
    c, b = rows[0]
    for sc, sb in rows[1:]:
        to_c, to_b = c + stay >= b + back, c + leave >= b + keep
        came.append((to_c, to_b))
        c, b = sc + (c + stay if to_c else b + back), sb + (c + leave if to_b else b + keep)
    label = CONTENT if c >= b else BOILERPLATE
    out = [label]
    for step in reversed(came):
        label = CONTENT if step[label] else BOILERPLATE
        out.append(label)
    return out[::-1]


def likelihood(field: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the labels ``y`` of all sequences, which begin at ``starts``, and its gradient, by the forward-backward recursion."""
    emission, transition = field
    score = x @ emission.T
    lengths = np.diff(np.append(starts, len(x)))
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    ahead, after = np.zeros((len(x), 2)), np.zeros((len(x), 2))
    longest = int(size.max(initial=0))
    alive = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences longer than t
    ahead[begin] = score[begin]
    for t in range(1, longest):
        at = begin[: alive[t]] + t
        ahead[at] = score[at] + np.logaddexp(ahead[at - 1, :1] + transition[0], ahead[at - 1, 1:] + transition[1])
    for t in range(longest - 1, 0, -1):
        at = begin[: alive[t]] + t
        to = score[at] + after[at]
        after[at - 1] = np.logaddexp(to[:, :1] + transition[:, 0], to[:, 1:] + transition[:, 1])
    whole = np.logaddexp(*ahead[begin + size - 1].T)
    of = np.empty(len(starts))
    of[order] = whole
    z = np.repeat(of, lengths)
    inner = np.ones(len(x), dtype=bool)
    inner[starts] = False
    k = np.flatnonzero(inner)
    chance = np.exp(ahead + after - z[:, None])
    both = np.exp(ahead[k - 1][:, :, None] + transition[None] + (score + after)[k][:, None, :] - z[k][:, None, None])
    hard = np.eye(2)[y]
    value = float(score[np.arange(len(x)), y].sum() + transition[y[k - 1], y[k]].sum() - whole.sum())
    pairs = np.bincount(y[k - 1] * 2 + y[k], minlength=4).reshape(2, 2)
    return value, (hard - chance).T @ x, pairs - both.sum(axis=0)


def fit_field(x: np.ndarray, y: np.ndarray, starts: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Weights of largest penalised likelihood of given labels: a concave problem of few weights, so quasi-Newton steps (BFGS) reach it."""
    n, m = max(1, len(x)), 2 * x.shape[1] + 4
    split = lambda v: (v[:-4].reshape(2, -1), v[-4:].reshape(2, 2))

    def at(v: np.ndarray) -> tuple[float, np.ndarray]:
        value, g, gt = likelihood(split(v), x, y, starts)
        return value / n - penalty * float(v @ v) / 2, np.concatenate([g.ravel(), gt.ravel()]) / n - penalty * v

    w, inverse = np.zeros(m), np.eye(m)
    value, g = at(w)
    for _ in range(steps):
        if float(np.abs(g).max()) < 1e-6:
            break
        way, rate = inverse @ g, 1.0
        slope = float(way @ g)
        while (got := at(w + rate * way))[0] < value + 1e-4 * rate * slope and rate > 1e-8:
            rate /= 2
        step, turn = rate * way, g - got[1]
        w, (value, g) = w + step, got
        if (curve := float(step @ turn)) > 1e-14:
            left = np.eye(m) - np.outer(step, turn) / curve
            inverse = left @ inverse @ left.T + np.outer(step, step) / curve
    return split(w)


def content_share(words: np.ndarray, labels: list[int]) -> float:
    return float(words[np.array(labels, dtype=np.int64) == CONTENT].sum() / words.sum()) if len(words) else 0.0


def train(docs: list[tuple[int, np.ndarray, np.ndarray]]) -> Field:
    """The field of (label, words of each line, features of each line) documents, label 1 for good ones. Without documents of both
    kinds every line is content, since nothing speaks against one."""
    docs = [d for d in docs if len(d[1])]
    if len({label for label, _, _ in docs}) < 2:
        emission = np.zeros((2, len(FEATURES)))
        emission[CONTENT, 0] = 1.0
        return Field(emission, np.zeros((2, 2)))
    x = np.concatenate([f for _, _, f in docs])
    starts = np.cumsum([0] + [len(f) for _, _, f in docs[:-1]])
    doc_of = np.repeat(np.arange(len(docs)), [len(f) for _, _, f in docs])
    good = np.array([label for label, _, _ in docs])[doc_of] == 1
    y = np.where(good, CONTENT, BOILERPLATE)
    alone = np.arange(len(x))
    lines = fit_field(x, y, alone)[0]  # each line by itself at first: in what is given, neighbours always agree
    for _ in range(RELABELS):
        lean = x @ (lines[BOILERPLATE] - lines[CONTENT])
        worst = np.full(len(docs), -np.inf)
        np.maximum.at(worst, doc_of, lean)
        y = np.where(good | ((lean < -MARGIN) & (lean < worst[doc_of])), CONTENT, BOILERPLATE)
        lines = fit_field(x, y, alone)[0]
    emission, transition = fit_field(x, y, starts)
    shares = np.array([content_share(w, viterbi(f @ emission.T, transition)) for _, w, f in docs])
    is_good = np.array([label == 1 for label, _, _ in docs])
    # The least share that keeps good documents in the same proportion as it lets bad ones go.
    cuts = np.unique(np.concatenate([[CONTENT_SHARE], np.linspace(0.05, 0.95, 19)]))
    balance = [(shares[is_good] >= c).mean() + (shares[~is_good] < c).mean() for c in cuts]
    best = np.flatnonzero(np.array(balance) >= max(balance) - 1e-12)
    return Field(emission, transition, float(cuts[best[len(best) // 2]]))


def fit_lines(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS) -> Field:
    """Fits on labelled documents that are not held out, ``fit_docs`` at most; those of more than ``FIT_LINES`` lines or that fail the base
    rules teach nothing. Several labels of one id count by their majority, ties as 1; rows without an id or label do not."""
    taught = labels.select(F.col(id_col).cast("long").alias("taught"), F.col(label_col).cast("double").alias("label")).dropna()
    taught = taught.where(~held_out_column(F.col("taught"))).groupBy("taught").agg((F.avg("label") >= 0.5).cast("long").alias("label"))
    taught = taught.orderBy(F.xxhash64("taught"), "taught").limit(fit_docs)

    def describe(batches):
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                d = lines_of(text)
                if 0 < len(d.words) <= FIT_LINES and not d.base_failed:
                    rows.append((batch.column("taught")[i].as_py(), batch.column("of_text")[i].as_py(), batch.column("label")[i].as_py(), d.words.astype(np.int64).tobytes(), d.features.astype(np.float64).tobytes()))
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["taught", "of_text", "label", "words", "features"])

    # At most fit_docs rows of two numbers: small enough to send to every task, so the texts stay where they are.
    rows = docs.select(F.col(id_col).cast("long").alias("taught"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("of_text")).join(F.broadcast(taught), "taught")
    found = rows.mapInArrow(describe, "taught long, of_text long, label long, words binary, features binary").orderBy(F.xxhash64("taught"), "taught", "of_text").limit(fit_docs).collect()
    return train([(r["label"], np.frombuffer(r["words"], dtype=np.int64), np.frombuffer(r["features"], dtype=np.float64).reshape(-1, len(FEATURES))) for r in found])


_NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_lines(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", with_labels: bool = False) -> DataFrame:
    """For each row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share, and with
    ``with_labels`` ``content``: for each line with a word whether it is content.

    One pass without a shuffle. Null, empty and blank texts have no words and so fail the base rules; their content_share is 0. Equal rows
    keep a row each. Other columns are ignored; an empty table gives an empty result. Very long texts are read whole.
    """
    emission, transition, least = field.emission, field.transition, field.least_share

    def judge(batches):
        for batch in batches:
            numbers, failed, kept, shares, content = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                d = lines_of(text)
                labels = viterbi(d.features @ emission.T, transition)
                share = content_share(d.words, labels)
                numbers.append([getattr(d, n) for n in _NUMBERS])
                failed.append(d.base_failed)
                kept.append(not d.base_failed and share >= least)
                shares.append(share)
                if with_labels:
                    content.append([y == CONTENT for y in labels])
            grid = np.array(numbers, dtype=np.int64).reshape(batch.num_rows, len(_NUMBERS))
            columns = [batch.column("id"), *(pa.array(grid[:, i]) for i in range(len(_NUMBERS))), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(shares, pa.float64())]
            names = ["id", *_NUMBERS, "base_failed", "kept", "content_share"]
            if with_labels:
                columns.append(pa.array(content, pa.list_(pa.bool_())))
                names.append("content")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{n} long" for n in _NUMBERS), "base_failed boolean", "kept boolean", "content_share double", *(["content array<boolean>"] if with_labels else [])])
    return rows.mapInArrow(judge, schema).withColumnRenamed("id", id_col)
