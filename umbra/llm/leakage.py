"""Test items that leaked into a corpus (problem 7).

Method: the normalised words of the items form one generalised suffix automaton; each
document is streamed through it word by word while the longest matching length is
tracked.  Maximal matches of at least ``ANCHOR`` words are chained along an item while the
gaps stay small, so a changed or missing word does not end a passage; a chain that spans at
least ``MIN_WORDS`` consecutive words of the item with at least ``MIN_COVERAGE`` of them
matched is a leak.  ``ANCHOR`` is derived from these two: a passage at the limits holds a
run of that length wherever its other words are changed.

Word runs that several items share (the instruction before the task) are taken out of the
items first; items that are near copies of each other count once there, so what only they
share stays.  The automaton is built once in every Python worker from the items' words, in
shards of at most ``SHARD_WORDS`` words; ``SHARDS_AT_ONCE`` of them, which bounds what a
worker holds, are streamed past in one pass over the corpus, more items mean more passes.
``removed`` gives the corpus without the leaked spans, by limits of length and coverage.

Defined results: null and blank documents or items give no row; an item that stands
twice in the items is reported under each of its ids; a document is reported once for
each item, with its best passage.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.words import _NOTE, _TAG, _WORD, fold, words

MIN_WORDS = 20
MIN_COVERAGE = 0.8
_RIGHT = math.ceil(MIN_WORDS * MIN_COVERAGE)
ANCHOR = math.ceil(_RIGHT / (MIN_WORDS - _RIGHT + 1))  # right words, parted by the changed ones
ITEM_GAP = 5
DOC_GAP = 8
SHARED_RUN = 6
SHARED_ITEMS = 3
NEAR = 0.5  # share of an item's later runs that makes it a near copy of another
SHARD_WORDS = 300_000
SHARDS_AT_ONCE = 4
MAX_COVERAGE = 0.5  # a document of which more has leaked is dropped whole by ``removed``


_ESCAPE = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);?")


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; strings are parted by unique numbers."""

    def __init__(self, sequence: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first_end = [-1]
        self.sequence = sequence
        self._places: dict[int, list[int]] = {}
        last = 0
        for at, symbol in enumerate(sequence):
            last = self._extend(last, symbol, at)
        self._children: list[list[int]] | None = None

    def _extend(self, last: int, symbol: int, at: int) -> int:
        current = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        self.first_end.append(at)
        state = last
        while state != -1 and symbol not in self.next[state]:
            self.next[state][symbol] = current
            state = self.link[state]
        if state == -1:
            return current
        target = self.next[state][symbol]
        if self.length[state] + 1 == self.length[target]:
            self.link[current] = target
            return current
        clone = len(self.next)
        self.next.append(dict(self.next[target]))
        self.length.append(self.length[state] + 1)
        self.link.append(self.link[target])
        self.first_end.append(-1 - self.first_end[target] if self.first_end[target] >= 0 else self.first_end[target])
        while state != -1 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = clone
            state = self.link[state]
        self.link[target] = self.link[current] = clone
        return current

    def ends(self, state: int) -> list[int]:
        """Every place where a word run of this state ends."""
        if self._children is None:
            self._children = [[] for _ in self.next]
            for child, parent in enumerate(self.link):
                if parent >= 0:
                    self._children[parent].append(child)
        out, stack = [], [state]
        while stack:
            at = stack.pop()
            if self.first_end[at] >= 0:
                out.append(self.first_end[at])
            stack.extend(self._children[at])
        return out

    def places(self, state: int) -> list[int]:
        """Every place where the last ANCHOR words of a state's runs end."""
        link, lengths = self.link, self.length
        while lengths[link[state]] >= ANCHOR:
            state = link[state]
        if state not in self._places:
            self._places[state] = self.ends(state)
        return self._places[state]

    def maximal_matches(self, sequence: list[int]) -> list[tuple[int, int, int]]:
        """(start, start in the strings, length) of all matches of at least ANCHOR words that can be carried on neither way.

        The longest matching length is tracked word by word; a string that parts from the
        longest match before its end, because others go on with it, has its own match there.
        """
        nexts, link, lengths, strings = self.next, self.link, self.length, self.sequence
        state = length = 0
        out = []
        for at, symbol in enumerate(sequence):
            if symbol < 0:
                state = length = 0
                continue
            target = nexts[state].get(symbol)
            while target is None and state:
                state = link[state]
                target = nexts[state].get(symbol)
                length = lengths[state]
            if target is None:
                state = length = 0
                continue
            state = target
            length += 1
            if length < ANCHOR:
                continue
            after = sequence[at + 1] if at + 1 < len(sequence) else -1
            for place in self.places(state):
                if after >= 0 and place + 1 < len(strings) and strings[place + 1] == after:
                    continue
                size = ANCHOR
                while size <= at and size <= place and sequence[at - size] == strings[place - size] >= 0:
                    size += 1
                out.append((at + 1 - size, place + 1 - size, size))
        return out


def near_copies(items: dict[int, list[str]]) -> dict[int, int]:
    """The class of each item: items whose second halves share at least NEAR of their word runs are one."""
    parent = {item: item for item in items}

    def root(item: int) -> int:
        while parent[item] != item:
            parent[item] = parent[parent[item]]
            item = parent[item]
        return item

    first: dict[tuple[str, ...], int] = {}
    for item, tokens in items.items():
        runs = {tuple(tokens[at : at + SHARED_RUN]) for at in range(len(tokens) // 2, len(tokens) - SHARED_RUN + 1)}
        met = Counter(first.setdefault(run, item) for run in runs)
        for other, n in met.items():
            if other != item and n >= NEAR * len(runs):
                parent[root(item)] = root(other)
    return {item: root(item) for item in items}


def without_shared_runs(items: dict[int, list[str]]) -> dict[int, list[str | None]]:
    """The items' words, with None in place of words in runs that several items, no near copies of each other, share."""
    of = near_copies(items)
    holders: dict[tuple[str, ...], set[int]] = defaultdict(set)
    for item, tokens in items.items():
        for at in range(len(tokens) - SHARED_RUN + 1):
            holders[tuple(tokens[at : at + SHARED_RUN])].add(of[item])
    out: dict[int, list[str | None]] = {}
    for item, tokens in items.items():
        masked: list[str | None] = list(tokens)
        for at in range(len(tokens) - SHARED_RUN + 1):
            if len(holders[tuple(tokens[at : at + SHARED_RUN])]) >= SHARED_ITEMS:
                masked[at : at + SHARED_RUN] = [None] * SHARED_RUN
        out[item] = masked
    return out


class LeakFinder:
    """Streams documents through the automaton of one shard of items."""

    def __init__(self, items: list[tuple[int, list[str | None]]]):
        self.vocabulary: dict[str, int] = {}
        sequence: list[int] = []
        self.item_at: list[int] = []  # index into item_ids for every place of the sequence
        self.item_ids = [item for item, _ in items]
        part = -2
        for index, (_, tokens) in enumerate(items):
            for token in [*tokens, None]:
                if token is None:
                    sequence.append(part)
                    part -= 1
                else:
                    sequence.append(self.vocabulary.setdefault(token, len(self.vocabulary)))
                self.item_at.append(index)
        self.sequence = sequence
        runs = zip(*(sequence[at:] for at in range(ANCHOR)))
        self.runs = {run for run in runs if min(run) >= 0}
        self.automaton = SuffixAutomaton(sequence)

    def leaks(self, tokens: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(item, first word, word after the last, item words spanned, item words matched)."""
        get = self.vocabulary.get
        sequence = [get(token, -1) for token in tokens]
        # a document without a run of ANCHOR item words has no leak and need not be walked through the automaton
        if self.runs.isdisjoint(zip(*(sequence[at:] for at in range(ANCHOR)))):
            return []
        matches = self.automaton.maximal_matches(sequence)
        anchors: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for doc, place, length in matches:
            anchors[self.item_at[place]].append((doc, place, length))
        out = []
        for index, found in anchors.items():
            best = self._best_chain(sequence, sorted(found))
            if best:
                out.append((self.item_ids[index], *best))
        return out

    def _best_chain(self, sequence: list[int], found: list[tuple[int, int, int]]) -> tuple[int, int, int, int] | None:
        chains: list[list[int]] = []  # doc start, doc end, item start, item end, matched words
        ending: dict[int, list[list[int]]] = defaultdict(list)  # by item end, those still within reach
        for doc, item, length in found:
            best = None
            for end in range(item - ITEM_GAP, item + min(ANCHOR, length - 1) + 1):
                if end not in ending:
                    continue
                ending[end] = [c for c in ending[end] if c[3] == end and doc - c[1] <= DOC_GAP]  # places only grow
                for chain in ending[end]:
                    doc_gap, item_gap = doc - chain[1], item - chain[3]
                    if doc_gap < -ANCHOR:
                        continue
                    between = Counter(sequence[chain[1] : doc]) & Counter(self.sequence[chain[3] : item]) if doc_gap > 0 and item_gap > 0 else None
                    matched = length + min(doc_gap, item_gap, 0) + (sum(between.values()) if between else 0)
                    if matched > 0 and (best is None or chain[4] + matched > best[1]):
                        best = (chain, chain[4] + matched)
            if best:
                chain, matched = best
                chain[1], chain[3], chain[4] = doc + length, item + length, matched
            else:
                chain = [doc, doc + length, item, item + length, length]
                chains.append(chain)
            ending[item + length].append(chain)
        good = None
        for doc, doc_end, item, item_end, matched in chains:
            before, after = self._steps(sequence, doc - 1, item - 1, -1), self._steps(sequence, doc_end, item_end, 1)
            for back, more in before:
                for on, again in after:
                    span, right = item_end - item + back + on, matched + more + again
                    if span >= MIN_WORDS and right >= MIN_COVERAGE * span and (good is None or right > good[3]):
                        good = (doc - back, doc_end + on, span, right)
        return good

    def _steps(self, sequence: list[int], doc: int, item: int, by: int) -> list[tuple[int, int]]:
        """How far an end of a passage may be carried on over changed words, and how many right words are gained by it.

        Behind more than one changed word two right ones must follow each other, for a
        single one may be chance.
        """
        out = [(0, 0)]
        equal = missed = run = 0
        at = 0
        while 0 <= doc + by * at < len(sequence) and 0 <= item + by * at < len(self.sequence) and self.sequence[item + by * at] >= 0:
            at += 1
            if sequence[doc + by * (at - 1)] == self.sequence[item + by * (at - 1)]:
                equal, run = equal + 1, run + 1
                if missed <= 1 or run >= 2:
                    out.append((at, equal))
            else:
                missed, run = missed + 1, 0
                if missed > MIN_WORDS - _RIGHT:
                    break
        return out


_SCHEMA = "doc_id long, item_id long, word_start int, word_end int, n_words int, n_matched int, doc_words int"
_COLUMNS = [part.split()[0] for part in _SCHEMA.split(", ")]


def item_shards(items: DataFrame, id_col: str, text_col: str) -> list[list[tuple[int, list[str | None]]]]:
    """The items' words without shared runs, in shards of at most SHARD_WORDS words.

    The items are a fixed test set, read to the driver; the corpus never is.
    """
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null").dropDuplicates(["item_id"]).orderBy("item_id").toLocalIterator()
    masked = without_shared_runs({row["item_id"]: words(row["text"]) for row in rows})
    shards: list[list[tuple[int, list[str | None]]]] = [[]]
    size = 0
    for item, tokens in masked.items():
        if size and size + len(tokens) > SHARD_WORDS:
            shards.append([])
            size = 0
        shards[-1].append((item, tokens))
        size += len(tokens)
    return shards


_HELD: dict[int, list[LeakFinder]] = {}  # of this worker, by broadcast


def _finders(number: int, shards) -> list[LeakFinder]:
    """The automata of the shards, built once in each worker."""
    if number not in _HELD:
        _HELD.clear()
        _HELD[number] = [LeakFinder(shard) for shard in shards]
    return _HELD[number]


def find_leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that leaked into it.  No shuffle of the corpus."""
    spark = documents.sparkSession
    narrow = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null AND doc_id is not null")
    shards = item_shards(items, item_col, item_text)
    out = None
    for at in range(0, len(shards), SHARDS_AT_ONCE):
        sent = spark.sparkContext.broadcast(shards[at : at + SHARDS_AT_ONCE])

        def scan(batches: Iterator[pd.DataFrame], sent=sent, number=sent._jbroadcast.id()) -> Iterator[pd.DataFrame]:
            finders = _finders(number, sent.value)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    tokens = words(text)
                    rows += [(doc_id, *leak, len(tokens)) for finder in finders for leak in finder.leaks(tokens)]
                yield pd.DataFrame(rows, columns=_COLUMNS)

        part = narrow.mapInPandas(scan, _SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def removed(documents: DataFrame, items: DataFrame, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """doc_id, text without its leaked spans (null if they cover more than ``max_coverage`` of it) and n_removed words, of every affected document."""
    spans = F.array_sort(F.collect_list(F.struct("word_start", "word_end"))).alias("spans")
    leaks = find_leaks(documents, items).groupBy("doc_id").agg(spans)
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [[(s["word_start"], s["word_end"]) for s in spans] for spans in batch["spans"]]
            texts = [remove_spans(text, spans, max_coverage) for text, spans in zip(batch["text"], held)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts, "n_removed": [len({w for a, b in spans for w in range(a, b)}) for spans in held]})

    return narrow.join(leaks, "doc_id").mapInPandas(clean, "doc_id long, text string, n_removed int")


def remove_spans(text: str | None, spans: list[tuple[int, int]], max_coverage: float) -> str | None:
    """The text without the word spans; null if they cover more than ``max_coverage`` of its words."""
    if text is None:
        return None
    pieces = located(text)
    gone = {at for start, end in spans for at in range(start, min(end, len(pieces)))}
    if len(gone) > max_coverage * max(len(pieces), 1):
        return None
    out, at = [], 0
    for start, end in sorted(spans):
        if start < len(pieces):
            left, right = pieces[start][0], pieces[min(end, len(pieces)) - 1][1]
            if left >= at:
                out.append(text[at:left])
            at = max(at, right)
    return "".join([*out, text[at:]])


def located(text: str) -> list[tuple[int, int]]:
    """Start and end in the text as given of each word that ``words`` returns."""
    gone = {at for pattern in (_TAG, _NOTE) for m in pattern.finditer(text) for at in range(m.start(), m.end())}
    shown: list[str] = []
    places: list[tuple[int, int]] = []
    at = 0
    while at < len(text):
        escape = _ESCAPE.match(text, at) if text[at] == "&" and at not in gone else None
        end = escape.end() if escape else at + 1
        piece = " " if at in gone else html.unescape(text[at:end])
        for ch in piece:
            folded = " " if ch in "&<" else fold(ch)  # these alone would be read as the beginning of markup
            shown.append(folded)
            places += [(at, end)] * len(folded)
        at = end
    return [(places[m.start()][0], places[m.end() - 1][1]) for m in _WORD.finditer("".join(shown))]
