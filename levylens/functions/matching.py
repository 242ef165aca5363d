"""Many listed names in many texts: an automaton over the names, run once over each distinct text of a batch."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Names:
    """Listed (key, value) pairs, of which earlier ones go before later ones; built anew by each worker that gets it."""

    def __init__(self, listed: list[tuple[str, str]]):
        self.listed = [(k, v) for k, v in listed if k]
        self.automaton = None

    def __getstate__(self) -> dict:
        return {"listed": self.listed, "automaton": None}

    def _build(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.equal: dict[str, int] = {}
        for at, (key, _) in enumerate(self.listed):
            if key not in self.equal:
                self.equal[key] = at
                self.automaton.add_word(key, at)
        self.automaton.make_automaton()
        self.holding: tuple[list[str], list[int]] | None = None

    def _held_in(self, text: str) -> list[int]:
        """Places of the names that the text holds."""
        if self.automaton is None:
            self._build()
        return [at for _, at in self.automaton.iter(text)] if self.listed else []

    def _first_holding(self, text: str, longer: int) -> int | None:
        """The first name of more than `longer` letters that holds the text: the least of the sorted suffixes that begin with it."""
        if self.holding is None:
            suffixes = sorted((key[i:], at) for key, at in self.equal.items() if len(key) > longer for i in range(len(key)))
            self.holding = [s for s, _ in suffixes], [at for _, at in suffixes]
        texts, places = self.holding
        low, high = bisect_left(texts, text), bisect_left(texts, text + "\U0010ffff")
        return min(places[low:high], default=None)

    def longest(self, text: str) -> str | None:
        """The value of the longest name in the text, of equals the first."""
        found = self._held_in(text)
        return self.listed[min(found, key=lambda at: (-len(self.listed[at][0]), at))][1] if found else None

    def named(self, text: str, longer: int = 4) -> str | None:
        """The value of the name that equals the text, else of the first of more than `longer` letters that the text holds or that holds it."""
        if not text:
            return None
        found = [at for at in self._held_in(text) if len(self.listed[at][0]) > longer]
        if text in getattr(self, "equal", ()):
            return self.listed[self.equal[text]][1]
        if self.listed and (around := self._first_holding(text, longer)) is not None:
            found.append(around)
        return self.listed[min(found)][1] if found else None


def over_batch(f: Callable[[str], str | None], texts: Column) -> Column:
    """f of a string column, called once for each distinct value of an Arrow batch; null stays null."""

    def run(values: pa.Array) -> pa.Array:
        coded = values.dictionary_encode()
        return pa.array([f(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

    return F.arrow_udf(run, T.StringType())(texts)
