"""Many patterns at once: one automaton over all literals and over the fixed parts of regexes.

Case never counts. Characters are folded one to one (so places stay the same): lower case, with
the four characters that regular expressions also take for an ASCII letter turned into it.

A regular expression that can only match where one of some fixed parts stands is tried on lines
that hold one, and one without such parts on every line. So the time to scan hangs on the text and
on what it holds, hardly on the number of patterns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from re import _constants as codes
from re import _parser as parser

import ahocorasick

_AS_ASCII = str.maketrans({"İ": "i", "ı": "i", "ſ": "s", "K": "k"})


def fold(text: str) -> str:
    return text.translate(_AS_ASCII).lower() if not text.isascii() else text.lower()


def _parts(tokens) -> set[str] | None:
    """Texts of which one stands in any match, or None where nothing can be said."""
    found: list[set[str]] = []
    run = ""
    for op, value in tokens:
        if op is codes.LITERAL and (value < 128 or chr(value).lower() == chr(value).upper()):
            run += fold(chr(value))
            continue
        if run:
            found.append({run})
        run = ""
        inner = None
        if op is codes.SUBPATTERN and not value[1] and not value[2]:
            inner = _parts(value[3])
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _parts(value[2])
        elif op is codes.BRANCH:
            each = [_parts(branch) for branch in value[1]]
            inner = set().union(*each) if all(each) else None
        elif op is codes.ATOMIC_GROUP:
            inner = _parts(value)
        if inner:
            found.append(inner)
    if run:
        found.append({run})
    return max(found, key=lambda texts: min(map(len, texts)), default=None)


def fixed_parts(pattern: str) -> set[str] | None:
    """Folded texts of which one stands in any match of the regular expression; None: unknown."""
    return _parts(parser.parse(pattern, re.IGNORECASE))


class Matcher:
    """Patterns (text, is_regex), told by their places in the list."""

    def __init__(self, patterns: list[tuple[str, bool]]):
        self.patterns = patterns
        self.regexes = {k: re.compile(p, re.IGNORECASE) for k, (p, regex) in enumerate(patterns) if regex}
        self.everywhere: list[int] = []
        owners: dict[str, tuple[list[int], list[int]]] = {}
        for k, (p, regex) in enumerate(patterns):
            parts = fixed_parts(p) if regex else {fold(p)}
            if parts is None:
                self.everywhere.append(k)
            for part in parts or ():
                owners.setdefault(part, ([], []))[regex].append(k)
        self.automaton = ahocorasick.Automaton()
        for part, (literals, regexes) in owners.items():
            if part:
                self.automaton.add_word(part, (len(part), literals, regexes))
        self.automaton.make_automaton()

    def _met(self, folded: str) -> Iterator[tuple[int, tuple[int, list[int], list[int]]]]:
        return self.automaton.iter(folded) if len(self.automaton) else iter(())

    def lines(self, text: str) -> list[tuple[int, int]]:
        """(line from 0, pattern) of each line that has the pattern, in order."""
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        found, asked = set(), set()
        for end, (_, literals, regexes) in self._met(fold(text)):
            line = bisect_right(starts, end) - 1
            found.update((line, k) for k in literals)
            asked.update((line, k) for k in regexes)
        if asked or self.everywhere:
            split = text.split("\n")
            asked.update((line, k) for line in range(len(split)) for k in self.everywhere)
            found.update((line, k) for line, k in asked if self.regexes[k].search(split[line]))
        return sorted(found)

    def counts(self, text: str) -> dict[int, int]:
        """How often each pattern stands in the text, one place after the end of the one before."""
        found: dict[int, int] = {}
        upto: dict[int, int] = {}
        asked = set(self.everywhere)
        for end, (length, literals, regexes) in self._met(fold(text)):
            asked.update(regexes)
            for k in literals:
                if end - length >= upto.get(k, -1):
                    upto[k] = end
                    found[k] = found.get(k, 0) + 1
        for k in asked:
            if n := sum(1 for _ in self.regexes[k].finditer(text)):
                found[k] = n
        return found


_HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", re.MULTILINE)


def changed_lines(diff: str) -> Iterator[str]:
    """Added and removed lines of unified diffs, with their sign. A hunk's header tells how many
    lines each side has, so within them a line is content whatever it looks like, and outside of
    them nothing is. A text without any such header goes by signs alone, without what looks like
    the two lines that name files."""
    if not _HUNK.search(diff):
        yield from (line for line in diff.split("\n") if line[:1] in ("-", "+") and line[:3] not in ("---", "+++"))
        return
    old = new = 0
    for line in diff.split("\n"):
        if old > 0 or new > 0:
            sign = line[:1]
            if sign == "\\":  # the note on a missing line break belongs to neither side
                continue
            if sign in ("-", "+"):
                yield line
            old -= sign != "+"
            new -= sign != "-"
        elif m := _HUNK.match(line):
            old, new = (1 if n is None else int(n) for n in m.groups())
