"""Dictionary mentions in text (E10, S14, H09-H10): tiers of aliases, joined or matched.

Tiers: exact spellings with capitals, Russian words by stem, English in lower case, element
symbols by case, and guarded symbols that need a number or a list beside them. Facilities need
a word of place near. The dictionary is a short, closed list and travels with the closure.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from factloom.functions.grammar import ENDINGS

_TOKEN = re.compile(r"[A-Za-zА-Яа-яЁё0-9]+(?:-[A-Za-zА-Яа-яЁё0-9]+)*|[^\s]")
_CYRILLIC = re.compile("[а-яё]", re.I)
#: words that tell a place of work (fixed values)
PLACE = ("завод", "комбинат", "фабрик", "рудник", "предприяти", "месторожден", "plant", "smelter", "refinery", "mine", "works")


@dataclass(frozen=True)
class Entry:
    type: str
    canon: str
    aliases: tuple[str, ...] = ()
    aliases_en: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()
    symbols_guarded: tuple[str, ...] = ()
    aliases_infl: tuple[str, ...] = ()
    geo: str | None = None


def checked(rows: Iterable[dict]) -> list[Entry]:
    """Required fields, lists where there are none, one entry for each (type, canon)."""
    out, seen = [], set()
    for row in rows:
        if not row.get("type") or not row.get("canon"):
            raise ValueError(f"an entry needs a type and a canon: {row}")
        key = (row["type"], row["canon"])
        if key in seen:
            raise ValueError(f"entered twice: {key}")
        seen.add(key)
        out.append(Entry(row["type"], row["canon"], *(tuple(row.get(k) or ()) for k in ("aliases", "aliases_en", "symbols", "symbols_guarded", "aliases_infl")), row.get("geo")))
    return out


def _stem(word: str) -> str:
    low = word.lower().replace("ё", "е")
    return next((low[: len(low) - n] for n in (3, 2, 1) if len(low) - n >= 3 and low[-n:] in ENDINGS), low)


class Matcher:
    def __init__(self, entries: list[Entry]):
        self.exact: dict[tuple[str, ...], Entry] = {}
        self.stems: dict[tuple[str, ...], Entry] = {}
        self.english: dict[tuple[str, ...], Entry] = {}
        self.symbols: dict[str, Entry] = {}
        self.guarded: dict[str, Entry] = {}
        for e in entries:
            for alias in (*e.aliases, *e.aliases_infl):
                words = tuple(_TOKEN.findall(alias))
                if any(c.isupper() for c in alias):
                    self.exact.setdefault(words, e)
                elif _CYRILLIC.search(alias):
                    self.stems.setdefault(tuple(map(_stem, words)), e)
                else:
                    self.english.setdefault(tuple(w.lower() for w in words), e)
            for alias in e.aliases_en:
                self.english.setdefault(tuple(w.lower() for w in _TOKEN.findall(alias)), e)
            self.symbols |= dict.fromkeys(e.symbols, e)
            self.guarded |= dict.fromkeys(e.symbols_guarded, e)
        self.longest = max([1, *(len(k) for t in (self.exact, self.stems, self.english) for k in t)])

    def match(self, text: str | None) -> list[dict]:
        """Mentions by place, the longest first; each (span, type, canon) once."""
        tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text or "")]
        words = [t[2] for t in tokens]
        out: dict[tuple, dict] = {}

        def add(i: int, n: int, e: Entry) -> None:
            if e.type == "Facility" and not any(w.lower().startswith(PLACE) for w in words[max(0, i - 5) : i + n + 5]):
                return
            span = (tokens[i][0], tokens[i + n - 1][1])
            out.setdefault((*span, e.type, e.canon), {"canon": e.canon, "type": e.type, "span_start": span[0], "span_end": span[1], "form": (text or "")[span[0] : span[1]]})

        for i in range(len(tokens)):
            for n in range(min(self.longest, len(tokens) - i), 0, -1):
                part = tuple(words[i : i + n])
                e = self.exact.get(part) or self.stems.get(tuple(map(_stem, part))) or self.english.get(tuple(w.lower() for w in part))
                if e:
                    add(i, n, e)
                    break
            word = words[i]
            if word in self.symbols:
                add(i, 1, self.symbols[word])
            elif word in self.guarded:
                near = words[max(0, i - 2) : i] + words[i + 1 : i + 3]
                listed = any(w in self.symbols or w in self.guarded for w in near) and "," in near
                if any(w[0].isdigit() or w == "%" for w in near) or listed:
                    add(i, 1, self.guarded[word])
        return sorted(out.values(), key=lambda m: (m["span_start"], m["span_end"], m["type"], m["canon"]))


def mentions_udf(entries: list[Entry]):
    """E10 as a column, in Arrow batches."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from factloom.schemas import MENTION

    matcher = Matcher(entries)  # travels with the function, built once

    @F.pandas_udf(T.ArrayType(MENTION))
    def mentions(text):
        return text.map(matcher.match)

    return mentions
