"""Spelling variants: words one edit apart, found with a forward and a backward minimal acyclic automaton.

An edit lies in the first or in the second half of a word. Words that differ in the second half share the first one: it is matched
exactly in an automaton of words, the rest is completed with one error. For the first half the same is done on reversed words.
Each state knows how many words it leads to, so a path adds up to the number of its word among the sorted ones (a perfect hash),
which is the place of the word and its count in plain lists.

No automaton holds all words. What a word must share with a near one, its first ``a`` and last ``b`` characters, is a key; words with equal
keys meet in a bin of bounded size, which builds the automaton of its words. A key that too many words share is cut again: the
edit lies in the first or second half of what is between the ``a`` and ``b`` characters, so one of the halves joins the key. This
ends, since the middle halves each time, and loses nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut_lineage, shuffle_partitions

LEAST_CHARS = 5
LEAST_COUNT = 3
#: One in so many runs of a document loses a character.
SLIP = 97
#: Words of a bin on average, and of a key at most (but for keys that leave one character).
BIN_WORDS, KEY_WORDS = 32_768, 16_384
#: Most keys that are cut in a round, which bounds what is sent to all tasks.
MAX_HOT = 100_000
#: Different words that a task counts before it hands them on.
HELD_WORDS, HELD_CHARS = 200_000, 8_000_000


def slipped(doc_id: str, run: str) -> str:
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _tally(least: int):
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def tally(batches):
        held: Counter[str] = Counter()
        chars = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                # lower() of bytes changes A-Z alone
                for run, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    word = slipped(doc_id, run)
                    if len(word) >= least:
                        if word not in held:
                            chars += len(word)
                        held[word] += n
                if len(held) > HELD_WORDS or chars > HELD_CHARS:
                    yield out()
                    held.clear()
                    chars = 0
        yield out()

    return tally


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of each word of at least ``least_chars`` characters that occurs ``least_count`` times or more.

    Words are maximal runs of Latin letters (and U+00D7, U+00F7) of whole texts with A-Z in lower case; some, chosen by the id and the
    run, lose a character. A null id counts as empty text.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_tally(least_chars), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of sorted different words; a word's number is its place among them."""

    def __init__(self, words: list[str]):
        #: Of each state its edges (character: next state, words before those of that edge), and whether a word ends there.
        self.edges: list[dict] = [{}]
        self.final: list[bool] = [False]
        self.below: list[int] = [0]
        self.known: dict[tuple, int] = {}
        self.path, before = [0], ""
        for word in words:
            k, most = 0, min(len(before), len(word))
            while k < most and before[k] == word[k]:
                k += 1
            self._fold(before, k)
            for c in word[k:]:
                self.edges.append({})
                self.final.append(False)
                self.below.append(0)
                self.edges[self.path[-1]][c] = new = len(self.edges) - 1
                self.path.append(new)
            self.final[self.path[-1]] = True
            before = word
        self._fold(before, 0)
        self._number(0)
        self.known.clear()

    def _number(self, state: int) -> None:
        n = int(self.final[state])
        for c, to in self.edges[state].items():
            self.edges[state][c] = to, n
            n += self.below[to]
        self.below[state] = n

    def _fold(self, word: str, keep: int) -> None:
        """States of the last word below ``keep`` get no more edges: each gives way to an equal one or becomes known."""
        while len(self.path) > keep + 1:
            state = self.path.pop()
            like = (self.final[state], tuple(self.edges[state].items()))
            same = self.known.get(like)
            if same is None:
                self.known[like] = state
                self._number(state)
            else:
                self.edges[self.path[-1]][word[len(self.path) - 1]] = same
                if state == len(self.edges) - 1:
                    self.edges.pop(), self.final.pop(), self.below.pop()

    def near(self, word: str, exact: int) -> list[int]:
        """Numbers of the words that start with the first ``exact`` characters and are one edit from ``word``, each once."""
        edges, final, found = self.edges, self.final, []
        state = number = 0
        for c in word[:exact]:
            step = edges[state].get(c)
            if step is None:
                return found
            state, number = step[0], number + step[1]

        def rest(state: int, number: int, at: int) -> None:
            for c in word[at:]:
                step = edges[state].get(c)
                if step is None:
                    return
                state, number = step[0], number + step[1]
            if final[state]:
                found.append(number)

        # In a run of one character, the first is the one left out and a further one comes last; so each word is met once.
        for i in range(exact, len(word)):
            c, own = word[i], None
            if i == exact or word[i - 1] != c:
                rest(state, number, i + 1)
            for d, step in edges[state].items():
                if d == c:
                    own = step
                else:
                    rest(step[0], number + step[1], i + 1)
                    rest(step[0], number + step[1], i)
            if own is None:
                return found
            state, number = own[0], number + own[1]
        found += [number + n for to, n in edges[state].values() if final[to]]
        return found


_FOUND = "word string, n_near long, form string, form_n long"


def _search(key, group: pa.Table) -> pa.Table:
    """The near words of a bin's questions: how many, and the most frequent one."""
    backward = bool(key[0].as_py() % 2)
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    words, counts = group.column("word").to_pylist(), group.column("n").to_pylist()
    count = dict(zip(map(turn, words), counts, strict=True))
    order = sorted(count)
    numbers = [count[w] for w in order]
    automaton = Automaton(order)
    rows = []
    for word, length, a, b in zip(words, *(group.column(c).to_pylist() for c in ("length", "a", "b")), strict=True):
        if length != len(word):
            continue  # it is here to be found
        near, best = 0, None
        before, end = word[: length - b], word[length - b :]
        for i in automaton.near(turn(word), b if backward else a):
            other = turn(order[i])
            # The bin holds other keys' words too; and what starts with all before the end belongs to the key of the other half.
            if b and (not other.endswith(end) or not other.startswith(word[:a]) or other.startswith(before)):
                continue
            near += 1
            this = (-numbers[i], other)
            if best is None or this < best:
                best = this
        if near:
            rows.append((word, near, best[1], -best[0]))
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["word", "n_near", "form", "form_n"])


def _keys(words: DataFrame, least_chars: int, key_words: int) -> DataFrame:
    """Rows (word, n, length, a, b, back): a word with its key, as a question (``length`` is its own) or to be found by words of ``length``."""
    own = F.char_length("word")
    d = words.select("word", "n", F.explode(F.array(own - 1, own, own + 1)).alias("length")).where(F.col("length") >= least_chars)
    half = F.expr("length div 2").cast("int")
    sides = F.array(F.struct(half.alias("a"), F.lit(0).alias("b"), F.lit(False).alias("back")), F.struct(F.lit(0).alias("a"), (F.col("length") - half).alias("b"), F.lit(True).alias("back")))
    d = d.select("word", "n", "length", F.explode(sides).alias("s")).select("word", "n", "length", "s.*")
    key = F.xxhash64("back", "a", "b", F.expr("left(word, a)"), F.expr("right(word, b)"))
    d = cut_lineage(d.withColumn("key", key))
    most = max(key_words, d.count() // MAX_HOT)
    middle = F.col("length") - F.col("a") - F.col("b")
    while True:
        hot = d.where(middle > 1).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most).select("key")
        hot = cut_lineage(hot)
        if hot.isEmpty():
            return d
        # At most MAX_HOT keys of 8 bytes.
        hot = F.broadcast(hot)
        half = F.expr("(length - a - b) div 2").cast("int")
        sides = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b"), F.lit(False).alias("back")), F.struct(F.col("a"), (F.col("length") - F.col("a") - half).alias("b"), F.lit(True).alias("back")))
        finer = d.where(middle > 1).join(hot, "key", "left_semi").select("word", "n", "length", F.explode(sides).alias("s")).select("word", "n", "length", "s.*")
        rest = d.where(middle > 1).join(hot, "key", "left_anti").unionByName(d.where(middle <= 1))
        d = cut_lineage(rest.unionByName(finer.withColumn("key", key)))


def near_words(words: DataFrame, least_chars: int = LEAST_CHARS, bin_words: int = BIN_WORDS, key_words: int = KEY_WORDS) -> DataFrame:
    """(word, n_near, form, form_n) of each word of ``words`` (word, n; different ones) that has near words, which differ by exactly one
    inserted, deleted or replaced character: their number, and the one of largest n (ties: smallest) with its n."""
    keyed = _keys(words, least_chars, key_words)
    few = shuffle_partitions(words.sparkSession)
    bins = max(few, -(-keyed.count() // bin_words))
    d = keyed.select("word", "n", "length", "a", "b", (F.pmod("key", F.lit(bins)) * 2 + F.col("back").cast("int")).alias("bin"))
    found = d.groupBy("bin").applyInArrow(lambda key, group: _search(key, group), _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each (word, form): forms followed to the last. Each round doubles how far a link reaches; n at least doubles
    along a form, so there are six rounds at most."""
    links = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = cut_lineage(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.drop("moved")


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bin_words: int = BIN_WORDS, key_words: int = KEY_WORDS) -> DataFrame:
    """A row for each word of :func:`count_words`: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n, ties to the smallest in code-point order, if that n is at least twice the word's;
    else form and form_n are null. The root is what following forms leads to, the word itself if it has none. Null and empty
    texts and texts without such runs give nothing; equal rows count each; other columns are ignored; an empty
    table gives an empty result. A bin holds whole words, so its memory grows with the longest of them.
    """
    words = cut_lineage(count_words(docs, id_col, text_col))
    near = near_words(words, bin_words=bin_words, key_words=key_words)
    d = words.join(near, "word", "left").withColumn("has", F.coalesce(F.col("form_n") >= 2 * F.col("n"), F.lit(False)))
    d = cut_lineage(d.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("form")).alias("form"), F.when(F.col("has"), F.col("form_n")).alias("form_n")))
    roots = _roots(d.where(F.col("form").isNotNull()))
    return d.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
