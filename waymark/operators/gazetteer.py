"""Names of a dimension table in free texts.

A gazetteer has a row for each word: word (of letters of the run pattern), kind, rank and alias.
Its words become an Aho-Corasick automaton that is broadcast, of at most MOST_WORDS words, counted
first; every text is read once, in time that grows with its length and the words found in it.
Null and empty texts name nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import ship

#: Words that are broadcast at most; a gazetteer beyond is an error, not a cut.
MOST_WORDS = 1_000_000
#: Runs of letters whose answers are kept at most.
MOST_RUNS = 200_000
#: What a text may be read for: its letters.
LETTERS = r"[^\W\d_]+"


def words_automaton(words: list[str]) -> ahocorasick.Automaton | None:
    """Finds (stop - 1, index) of every occurrence of the words; None without words."""
    found = ahocorasick.Automaton()
    for k, word in enumerate(words):
        if word:
            found.add_word(word, k)
    if not len(found):
        return None
    found.make_automaton()
    return found


@dataclass
class Gazetteer:
    """Words with their kind, rank and alias, by index; markers speak against the name they follow."""

    words: list[str]
    kinds: list[str | None]
    ranks: list[int | None]
    aliases: list[str | None]
    markers: list[str] = field(default_factory=list)
    reach: int = 8
    letters: str = LETTERS

    def __post_init__(self) -> None:
        self.find, self.run, self.cuts = words_automaton(self.words), re.compile(self.letters), re.compile(f"({self.letters})")
        marks = [re.escape(m) for m in self.markers if m]
        self.find_marker = re.compile("|".join(marks)) if marks else None
        self.index = {word: k for k, word in enumerate(self.words) if word}
        self.lengths = sorted({len(word) for word in self.index}, reverse=True)
        self.heads: dict[str, int | None] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "find_marker", "run", "cuts", "index", "lengths", "heads")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def occurrences(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, stop, index) of all occurrences, those that overlap included."""
        if not text or self.find is None:
            return []
        return [(stop + 1 - len(self.words[k]), stop + 1, k) for stop, k in self.find.iter(text)]

    def marked(self, text: str, stop: int) -> bool:
        """Whether a marker stands within `reach` characters behind stop."""
        return self.find_marker is not None and self.find_marker.search(text, stop, stop + self.reach) is not None

    def excluded(self, text: str, word: str) -> bool:
        """Whether all occurrences of the word, none overlapping the one before, are marked."""
        start = text.find(word)
        while start >= 0:
            stop = start + len(word)
            if not self.marked(text, stop):
                return False
            start = text.find(word, stop)
        return True

    def head(self, run: str) -> int | None:
        """The longest word that the run begins with. Runs repeat, so up to MOST_RUNS answers are kept."""
        if len(self.heads) >= MOST_RUNS:
            self.heads.clear()
        self.heads[run] = found = next((self.index[run[:n]] for n in self.lengths if run[:n] in self.index), None)
        return found

    def hints(self, text: str | None, local: str, ambiguous: set[str]) -> tuple[list[str], str | None]:
        """The names that the runs of letters begin with, the longest of each run, in order of their first one, and their kind.

        Ambiguous and excluded names don't count. Names of kind `local` are preferred to all others.
        """
        parts = self.cuts.split(text or "")  # runs of letters at odd places
        heads: dict[int, int] = {}
        for run, start in dict(zip(parts[1::2], list(accumulate(map(len, parts)))[::2])).items():
            k = self.heads[run] if run in self.heads else self.head(run)
            if k is not None:
                heads[k] = start

        def kept(of: list[int]) -> list[int]:
            # what begins a run overlaps no earlier occurrence; the others are looked for only if this one is marked
            named = [k for k in of if self.words[k] not in ambiguous]
            return [k for k in named if not self.marked(text, heads[k] + len(self.words[k])) or not self.excluded(text, self.words[k])]

        own = kept([k for k in heads if self.kinds[k] == local]) or kept(list(heads))
        return [self.words[k] for k in own], self.kinds[own[0]] if own else None

    def area(self, texts: list[str | None], kind: str, fallback: str) -> str | None:
        """The area that the texts name, in their order.

        First come runs of letters that end in a name of `kind`: what stands before the longest such
        name is trimmed. Without any, the longest name of kind `fallback` found anywhere counts,
        the first text's before the next one's, and among equally long ones that of the lowest rank.
        """
        seen = [self.occurrences(t) for t in texts]
        for text, found in zip(texts, seen, strict=True):
            ends: dict[int, tuple[int, int]] = {}
            for start, stop, k in found:
                if self.kinds[k] == kind:
                    ends[stop] = min(ends.get(stop, (start, k)), (start, k))
            for m in self.run.finditer(text or "") if ends else ():
                if m.end() in ends:
                    return self._named(ends[m.end()][1])
        for found in seen:
            if own := [(-len(self.words[k]), self.ranks[k] or 0, self.words[k], k) for _, _, k in found if self.kinds[k] == fallback]:
                return self._named(min(own)[-1])
        return None

    def _named(self, k: int) -> str:
        return self.aliases[k] if self.aliases[k] is not None else self.words[k]

    def first_named(self, text: str | None, excluded: re.Pattern | None) -> str | None:
        """The alias of the name of the lowest rank in the text, once what `excluded` matches is taken out."""
        found = self.occurrences(excluded.sub("", text) if text and excluded else text)
        best = min(((self.ranks[k] or 0, self.words[k], k) for _, _, k in found), default=None)
        return self._named(best[-1]) if best else None


def gazetteer(words: DataFrame, markers: list[str] | None = None, reach: int = 8, letters: str = LETTERS) -> Gazetteer:
    """The rows of a dimension table (word, and kind, rank and alias where it has them); repeated words keep the lowest rank."""
    have = [F.col(c) if c in words.columns else F.lit(None).alias(c) for c in ("word", "kind", "rank", "alias")]
    rows = words.select(*have).filter("word is not null and word <> ''")
    if (n := rows.count()) > MOST_WORDS:
        raise ValueError(f"{n} words, more than {MOST_WORDS}")
    known: dict[str, tuple] = {}
    for row in sorted(rows.collect(), key=lambda r: (r["rank"] is None, r["rank"] or 0, r["word"], r["kind"] or "", r["alias"] or "")):
        known.setdefault(row["word"], tuple(row))
    found = list(known.values())
    return Gazetteer(*(list(x) for x in (zip(*found, strict=True) if found else [[]] * 4)), markers or [], reach, letters)


def _per_text(texts: DataFrame, keep: list[str], columns: list[str], one, schema: str) -> DataFrame:
    """`keep` and what one(a row's texts) gives."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch[list(columns)].astype(object).where(batch[list(columns)].notna(), None)
            found = [one(list(row)) for row in own.itertuples(index=False, name=None)]
            yield pd.concat([batch[keep].reset_index(drop=True), pd.DataFrame(found, columns=[f.split(" ")[0] for f in schema.split(", ")])], axis=1)

    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.select(*keep, *(c for c in columns if c not in keep)).mapInPandas(run, f"{fields}, {schema}")


def words_in(texts: DataFrame, keep: list[str], text: str, names: Gazetteer) -> DataFrame:
    """`keep` and word: a row for each word of the gazetteer that the text has anywhere."""
    shared = texts.sparkSession.sparkContext.broadcast(names)  # of checked size
    held = lambda row: (sorted({shared.value.words[k] for _, _, k in shared.value.occurrences(row[0])}),)
    return _per_text(texts, keep, [text], held, "words array<string>").select(*keep, F.explode("words").alias("word"))


def region_hints(texts: DataFrame, keep: list[str], text: str, names: Gazetteer, local: str, ambiguous: list[str] | None = None) -> DataFrame:
    """`keep`, hints (array) and kind: the regions a text is about, without those its speaker only comes from."""
    shared, odd = texts.sparkSession.sparkContext.broadcast(names), set(ambiguous or ())  # of checked size
    return _per_text(texts, keep, [text], lambda row: shared.value.hints(row[0], local, odd), "hints array<string>, kind string")


def areas(texts: DataFrame, keep: list[str], columns: list[str], names: Gazetteer, kind: str, fallback: str) -> DataFrame:
    """`keep` and area: the area that the columns name, in their order."""
    shared = texts.sparkSession.sparkContext.broadcast(names)  # of checked size
    return _per_text(texts, keep, columns, lambda row: (shared.value.area(row, kind, fallback),), "area string")


def regions_in_text(texts: DataFrame, keep: list[str], text: str, names: Gazetteer, excluded: str | None = None) -> DataFrame:
    """`keep` and region: the alias of the first name, by rank, that the text has outside of what `excluded` matches."""
    shared, out = texts.sparkSession.sparkContext.broadcast(names), re.compile(excluded) if excluded else None  # of checked size
    return _per_text(texts, keep, [text], lambda row: (shared.value.first_named(row[0], out),), "region string")


def region_of_address(address: Column, prefixes: dict[str, str], units: list[str]) -> Column:
    """struct(region, area): the region of the first token's prefix, the longest one; the first later token of two or more characters that ends in a unit."""
    tokens = F.filter(F.split(F.coalesce(address, F.lit("")), r"\s+"), lambda t: t != "")
    region = F.lit(None).cast("string")
    for prefix in sorted(prefixes, key=len):
        region = F.when(F.startswith(F.get(tokens, 0), F.lit(prefix)), prefixes[prefix]).otherwise(region)
    later = F.filter(F.slice(tokens, 2, 1_000_000), lambda t: (F.length(t) >= 2) & F.array_contains(F.array(*map(F.lit, units)), F.right(t, F.lit(1))))
    return F.struct(region.alias("region"), F.when(F.size(tokens) > 0, F.get(later, 0)).alias("area"))
