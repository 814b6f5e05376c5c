"""Names found in texts by an automaton over all names."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxframe.operators.ranks import settle

#: Names of so many characters are one automaton (a state of some hundred bytes each at most).
MOST_CHARS = 250_000


class Automaton:
    """States are beginnings of names; a text is read once, each character moving on from the
    longest end of what was read that is such a beginning."""

    def __init__(self, names: list[str]) -> None:
        self.moves: list[dict[str, int]] = [{}]
        self.back, self.best = [0], [""]
        for name in names:
            state = 0
            for c in name:
                if c not in self.moves[state]:
                    self.moves[state][c] = len(self.moves)
                    self.moves.append({})
                    self.back.append(0)
                    self.best.append("")
                state = self.moves[state][c]
            self.best[state] = name
        waiting = deque(self.moves[0].values())
        while waiting:
            state = waiting.popleft()
            # What ends here and is a name: this state's own, else that of the state it falls back to.
            self.best[state] = self.best[state] or self.best[self.back[state]]
            for c, after in self.moves[state].items():
                self.back[after] = self._after(self.back[state], c)
                waiting.append(after)

    def _after(self, state: int, c: str) -> int:
        while c not in self.moves[state] and state:
            state = self.back[state]
        return self.moves[state].get(c, 0)

    def longest(self, text: str) -> str | None:
        """The longest name in the text; of equally long ones the last by name."""
        state, found = 0, ""
        for c in text:
            state = self._after(state, c)
            if (best := self.best[state]) and (len(best), best) > (len(found), found):
                found = best
        return found or None


def longest_contained(texts: DataFrame, parts: DataFrame, text: str, part: str, most_chars: int = MOST_CHARS) -> DataFrame:
    """(text, part): for each different text the longest part that it contains, the last by name
    of equally long ones, null if none. Parts may have any length; null and empty ones are none.

    All parts make one automaton, which goes to every task, if they have at most `most_chars`
    characters. More are dealt by hash into as many automata as that takes, the texts pass through
    one after the other, and the best of each are compared: time grows with their number, memory
    does not. Cost is one step a character and automaton, whatever the number of hits.
    """
    names = settle(parts.select(F.col(part).cast("string").alias("name")).where("name <> ''").distinct())
    total = names.agg(F.sum(F.length("name"))).first()[0] or 0
    groups = -(-total // most_chars) or 1
    words = texts.select(text).distinct()
    words = settle(words) if groups > 1 else words
    spark, found = texts.sparkSession, []
    for g in range(groups):
        own = names.where(F.pmod(F.xxhash64("name"), groups) == g)
        sent = spark.sparkContext.broadcast([r.name for r in own.collect()])  # about most_chars characters

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            automaton = Automaton(sent.value)
            for b in batches:
                yield pd.DataFrame({"t": b["t"], "best": [None if t is None else automaton.longest(t) for t in b["t"]]})

        hits = words.select(F.col(text).alias("t")).mapInPandas(search, "t string, best string")
        found.append(settle(hits) if groups > 1 else hits)
    if groups == 1:
        return found[0].select(F.col("t").alias(text), F.col("best").alias(part))
    all_hits = found[0]
    for more in found[1:]:
        all_hits = all_hits.unionByName(more)
    return all_hits.groupBy(F.col("t").alias(text)).agg(F.max_by("best", F.when(F.col("best").isNotNull(), F.struct(F.length("best"), "best"))).alias(part))
