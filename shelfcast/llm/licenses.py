"""Licence scans with a generalised suffix automaton over the words of licence templates.

The automaton holds every substring of every template. Streaming a text through it gives matching statistics: at each word, the longest
template substring that ends there. Long maximal matches are chained, by dynamic programming over matches in text order, into covered spans of a template.
Marked phrases are read off the same walk: a phrase ends at a word when its state is the current one or one of its suffix links.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf

from shelfcast.llm.common import words_of
from shelfcast.llm.licence_texts import TEMPLATES

#: Marked phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Shortest match that enters a chain, widest gap in words between two links of a chain, and least covered share of a template.
LEAST_MATCH, WIDEST_GAP, LEAST_COVER = 3, 6, 0.6
#: A longer span counts from so many covered words on, even where they are a lesser share of a long licence.
LEAST_WORDS = 24
#: Bytes of template text that a table may hold: each Python worker builds the automaton of all of it.
MOST_TEMPLATE_BYTES = 4 << 20


class SuffixAutomaton:
    """All substrings of several word sequences, and where they end."""

    def __init__(self, sequences: list[list[bytes]], phrases: dict[tuple[bytes, ...], str]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        prefixes: list[list[tuple[int, int]]] = [[]]
        for number, words in enumerate(sequences):
            last = 0
            for place, word in enumerate(words, 1):
                last = self._extend(last, word)
                prefixes += [[] for _ in range(len(self.next) - len(prefixes))]
                prefixes[last].append((number, place))
        self.phrases: dict[int, tuple[int, str]] = {}
        for phrase, label in phrases.items():
            state = 0
            for word in phrase:
                state = self.next[state][word]
            self.phrases[state] = (len(phrase), label)
        self.found: list[tuple[tuple[int, str], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = (self.phrases[state],) if state in self.phrases else ()
            self.found[state] = own + self.found[self.link[state]]
        self._number_ends(prefixes)

    def _number_ends(self, prefixes: list[list[tuple[int, int]]]) -> None:
        """`ends`: (sequence, place) of all prefixes in an order in which those below a state in the tree of suffix links are neighbours, from low[state] to high[state]."""
        below: list[list[int]] = [[] for _ in self.next]
        for state in range(1, len(self.next)):
            below[self.link[state]].append(state)
        self.ends: list[tuple[int, int]] = []
        self.low, self.high = [0] * len(self.next), [0] * len(self.next)
        todo = [(0, False)]
        while todo:
            state, done = todo.pop()
            if done:
                self.high[state] = len(self.ends)
                continue
            self.low[state] = len(self.ends)
            self.ends += prefixes[state]
            todo.append((state, True))
            todo += [(s, False) for s in below[state]]

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else -1)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, parent: int, child: int, word: bytes) -> int:
        if self.length[child] == self.length[parent] + 1:
            return child
        clone = self._state(self.length[parent] + 1, child)
        self.link[child] = clone
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, self.next[last][word], word)
        new, at = self._state(self.length[last] + 1), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        self.link[new] = 0 if at < 0 else self._split(at, self.next[at][word], word)
        return new

    def stream(self, words: list[bytes]):
        """(words read, state, length) after each word whose longest match is not empty."""
        state, length, step, link = 0, 0, self.next, self.link
        first = step[0]
        for i, word in enumerate(words, 1):
            if not length and word not in first:
                continue
            while state and word not in step[state]:
                state = link[state]
                length = self.length[state]
            to = step[state].get(word)
            if to is None:
                length = 0
                continue
            state, length = to, length + 1
            yield i, state, length


Match = tuple[int, int, int]


def best_chains(matches: list[Match]) -> list[tuple[int, int, int]]:
    """(first word, word after, template words covered) of chains of matches (first word, word after, place in the template), the best first; no match is in two chains.

    A chain runs forward in text and template, with at most WIDEST_GAP words of text between neighbours; words that two of its matches share count once.
    Where a chain meets matches of a better one, what is left of it begins behind them.
    """
    matches = sorted(set(matches), key=lambda m: (m[1], m[0], m[2]))
    score, before = [], []
    for i, (first, after, at) in enumerate(matches):
        best, link = after - first, -1
        for j in range(i - 1, -1, -1):
            a, b, c = matches[j]
            if b < first - WIDEST_GAP:
                break
            if a < first and c < at and c + b - a < at + after - first:
                fresh = after - first - max(0, b - first, c + b - a - at)
                if fresh > 0 and score[j] + fresh > best:
                    best, link = score[j] + fresh, j
        score.append(best)
        before.append(link)
    out, used = [], [False] * len(matches)
    for end in sorted(range(len(matches)), key=lambda i: (-score[i], i)):
        chain, i = [], end
        while i >= 0 and not used[i]:
            chain.append(i)
            i = before[i]
        if chain:
            for k in chain:
                used[k] = True
            out.append((matches[chain[-1]][0], matches[end][1], score[end] - (score[i] if i >= 0 else 0)))
    return out


class Scanner:
    """Templates and phrases made ready; one of these per Python worker."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str] | None = None):
        marked = {tuple(words_of(p.encode())): label for p, label in (PHRASES if phrases is None else phrases).items()}
        self.texts = [(label, words_of(t.encode())) for label, t in templates]
        self.automaton = SuffixAutomaton([w for _, w in self.texts] + [list(p) for p in marked], marked)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
        """Marked phrases (label, first word, word after), and chained spans (label, first word, word after, share of the template)."""
        marks, matches, last = [], [], None
        found = self.automaton.found
        for i, state, length in self.automaton.stream(words):
            for n, label in found[state]:
                if n <= length:
                    marks.append((label, i - n, i))
            if last and not (last[1] == i - 1 and last[0] == i - length):
                matches.append(last)
            last = (i - length, i, state)
        if last:
            matches.append(last)
        links: dict[int, list[Match]] = {}
        for first, after, state in matches:
            if after - first >= LEAST_MATCH:
                for t, end in self.automaton.ends[self.automaton.low[state] : self.automaton.high[state]]:
                    if t < len(self.texts):
                        links.setdefault(t, []).append((first, after, end - (after - first)))
        spans = []
        for t, of in links.items():
            label, size = self.texts[t][0], len(self.texts[t][1])
            taken: list[tuple[int, int]] = []  # apart from each other, in order of place, so only the neighbours of a span can meet it
            for first, after, covered in best_chains(of):
                at = bisect.bisect(taken, (first, after))
                clear = (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or after <= taken[at][0])
                if (covered >= LEAST_COVER * size or covered >= LEAST_WORDS) and clear:
                    taken.insert(at, (first, after))
                    spans.append((label, first, after, min(1.0, covered / size)))
        return marks, sorted(spans, key=lambda s: (s[1], s[2], s[0], s[3]))


_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64()), ("cover", pa.float64())])
_RESULT = pa.struct([("n_words", pa.int64()), ("phrases", pa.list_(_SPAN)), ("spans", pa.list_(_SPAN))])
_SCHEMA = "struct<n_words: long, phrases: array<struct<label: string, first: long, after: long, cover: double>>, spans: array<struct<label: string, first: long, after: long, cover: double>>>"


def known_templates() -> list[tuple[str, str]]:
    return [(label, text) for label, of in TEMPLATES.items() for text in of]


def templates_of(table: DataFrame) -> list[tuple[str, str]]:
    """The rows of a table of templates (label, text). It goes to every worker, so it may hold MOST_TEMPLATE_BYTES; rows with nulls are left out."""
    from pyspark.sql import functions as F

    table = table.select("label", "text").dropna().distinct()
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of templates are more than {MOST_TEMPLATE_BYTES}")
    return sorted((r["label"], r["text"]) for r in table.collect())


def scan_licenses(text: Column, templates: list[tuple[str, str]] | None = None) -> Column:
    """struct<n_words, phrases, spans> of a text: every marked phrase and every chained template span, by word. Null and empty texts have none."""
    of = known_templates() if templates is None else templates
    ready: list[Scanner] = []

    def scanned(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Scanner(of))
        out = []
        for text in texts:
            words = words_of(text.as_py())
            marks, spans = ready[0].scan(words)
            out.append({"n_words": len(words), "phrases": [dict(zip(("label", "first", "after", "cover"), (*m, 1.0), strict=True)) for m in marks], "spans": [dict(zip(("label", "first", "after", "cover"), s, strict=True)) for s in spans]})
        return pa.array(out, _RESULT)

    return arrow_udf(scanned, _SCHEMA)(text.cast("binary"))
