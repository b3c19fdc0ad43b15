"""Which of many keywords texts contain, by one automaton instead of a test a keyword.

A list of keywords becomes an Aho-Corasick automaton (a trie with links to the longest suffix that is in it) that reads a
text once, however many keywords there are. Where only the first keyword in order counts, the automaton keeps at each
state the least number of the keywords that end there, and a text's result is one number."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

try:  # compiled; the automaton below gives the same where it is absent
    import ahocorasick
except ImportError:
    ahocorasick = None


class Automaton:
    def __init__(self, words: list[str]):
        self.step: list[dict[str, int]] = [{}]
        self.best: list[int | None] = [None]
        for n, word in enumerate(words):
            at = 0
            for c in word:
                if c not in self.step[at]:
                    self.step[at][c] = len(self.step)
                    self.step.append({})
                    self.best.append(None)
                at = self.step[at][c]
            self.best[at] = n if self.best[at] is None else min(self.best[at], n)
        self.back = [0] * len(self.step)
        todo = deque(self.step[0].values())
        while todo:
            at = todo.popleft()
            for c, to in self.step[at].items():
                behind = self.back[at]
                while behind and c not in self.step[behind]:
                    behind = self.back[behind]
                self.back[to] = self.step[behind].get(c, 0)
                ends = [x for x in (self.best[to], self.best[self.back[to]]) if x is not None]
                self.best[to] = min(ends, default=None)
                todo.append(to)

    def first(self, text: str) -> int | None:
        """The least number of a keyword that the text contains."""
        at, found = 0, self.best[0]
        for c in text:
            while at and c not in self.step[at]:
                at = self.back[at]
            at = self.step[at].get(c, 0)
            if (x := self.best[at]) is not None and (found is None or x < found):
                found = x
                if not found:
                    break
        return found


class Compiled:
    """The same by the compiled automaton; the empty keyword, which every text contains, isn't one for it."""

    def __init__(self, words: list[str]):
        self.empty = words.index("") if "" in words else None
        numbers: dict[str, int] = {}
        for n, word in enumerate(words):
            numbers.setdefault(word, n)
        self.automaton = ahocorasick.Automaton()
        for word, n in numbers.items():
            if word:
                self.automaton.add_word(word, n)
        if len(self.automaton):
            self.automaton.make_automaton()

    def first(self, text: str) -> int | None:
        if not len(self.automaton):
            return self.empty
        return min((n for _, n in self.automaton.iter(text)), default=None) if self.empty is None else min([self.empty, *(n for _, n in self.automaton.iter(text))])


def of_first_keyword(spark: SparkSession, text: Column, values: list[tuple[str, str]], otherwise: str) -> Column:
    """The value of the first keyword in order (keyword, value) that a text contains, else `otherwise`. The plan doesn't grow
    with the keywords: the automaton is a broadcast, of a size in proportion to what the caller holds in a list."""
    words = [word for word, _ in values]
    held = spark.sparkContext.broadcast(((Automaton if ahocorasick is None else Compiled)(words), [value for _, value in values]))

    @F.pandas_udf("string")
    def value(texts: pd.Series) -> pd.Series:
        automaton, values = held.value
        return pd.Series([otherwise if (n := automaton.first(x)) is None else values[n] for x in texts], dtype=object)

    return value(F.coalesce(text, F.lit("")))
