"""Toxicity scores from a learnt lexicon that is matched with misspellings.

The lexicon is learnt from labelled documents: words, and stems that many
words begin with, which occur significantly more often in toxic texts. A
Levenshtein automaton runs over the lexicon's trie: its states are sets of
(trie node, edits so far), built as words need them, so that a word costs one
table look-up a character and most words leave the automaton after a few.
Insertions, deletions, substitutions and swaps count one edit each.

Each hit is judged in its context window. Hits inside quotation marks or next
to a reporting verb are counted apart from plain ones, and the labelled texts
tell how far either kind means abuse; without evidence, quoted hits weigh half.
Each word counts for one entry, the nearest. A text's score is the noisy-or over its words' best hits.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh, materialize

#: At most so many labelled rows are learnt from, chosen by a hash of their doc_id.
FIT_ROWS = 20_000
THRESHOLD = 0.7
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: An entry occurs in this share of the toxic texts and in three of them at least.
SUPPORT = 0.01
#: Of the texts that have an entry, at least this share is toxic.
PURITY = 0.95
#: Letters from which a word, and a stem, may have one edit; and two.
ONE_EDIT = {"word": 5, "stem": 6}
TWO_EDITS = {"word": 9, "stem": 10}
WINDOW = 6
#: Belief in a hit without evidence, by edits, and how many documents it counts for.
BELIEF, BELIEF_DOCS = (0.95, 0.75, 0.6), 4
QUOTED = 0.5
#: Hits below this say nothing.
LEAST_HIT = 0.5
BASE_SCORE = 0.01
#: Words that a worker remembers, and the letters of the longest of them.
CACHE_WORDS, CACHE_LETTERS = 300_000, 64
#: Features that a worker counts at once at most, but for those of one text more.
TALLY = 250_000

_WORD = re.compile(r"\w+")
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"
_REPORTING = frozenset("said says wrote writes called quoted quote quotes dit écrit appelle sagte schrieb nannte zitat dijo escribió llamó cita".split())


def fold(x: Column) -> Column:
    """crc32 of a column as text; null as the empty text."""
    return F.crc32(F.coalesce(x.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) % 3 == 1


# --- automaton ----------------------------------------------------------------


@dataclass(frozen=True)
class Entry:
    text: str
    kind: str  # word or stem

    @property
    def edits(self) -> int:
        n = len(self.text)
        return 2 if n >= TWO_EDITS[self.kind] else 1 if n >= ONE_EDIT[self.kind] else 0


class Automaton:
    """Levenshtein automata of all entries, intersected with their trie and made deterministic on demand."""

    def __init__(self, entries: list[Entry]):
        self.entries = entries
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]
        for n, entry in enumerate(entries):
            node = 0
            self.most[0] = max(self.most[0], entry.edits)
            for c in entry.text:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], entry.edits)
            self.ends[node].append(n)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.stems: list[tuple] = []  # entries whose stem a state has read: (entry, edits)
        self.words: list[tuple] = []  # entries that a word ending here is
        self.letters = {c for entry in entries for c in entry.text}
        self.start = self._state({(0, 0, "")})

    def _close(self, items: set) -> frozenset:
        """With deletions; of states at one node only those with the fewest edits."""
        least: dict[tuple[int, str], int] = {}
        todo = list(items)
        while todo:
            node, edits, swap = todo.pop()
            if edits > self.most[node] or least.get((node, swap), 99) <= edits:
                continue
            least[node, swap] = edits
            if not swap:
                todo.extend((child, edits + 1, "") for child in self.next[node].values())
        return frozenset((node, edits, swap) for (node, swap), edits in least.items())

    def _state(self, items: set) -> int:
        closed = self._close(items)
        if closed not in self.states:
            self.states[closed] = len(self.sets)
            self.sets.append(closed)
            self.moves.append({})
            found = [(n, edits) for node, edits, swap in closed if not swap for n in self.ends[node] if edits <= self.entries[n].edits]
            self.stems.append(tuple(x for x in found if self.entries[x[0]].kind == "stem"))
            self.words.append(tuple(x for x in found if self.entries[x[0]].kind == "word"))
        return self.states[closed]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits, swap in self.sets[state]:
            if swap:  # the first letter of a swapped pair has come second
                if c == swap:
                    out.add((node, edits, ""))
                continue
            out.add((node, edits + 1, ""))  # an extra letter
            for letter, child in self.next[node].items():
                out.add((child, edits + (letter != c), ""))
                if c in self.next[child]:
                    out.add((self.next[child][c], edits + 1, letter))
        to = self._state(out)
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple:
        """(entry, edits) for the entries that the word is, or whose stem it begins with, to their number of edits."""
        best: dict[int, int] = {}
        state, moves = self.start, self.moves
        for c in word:
            if c not in self.letters:
                c = ""  # all of these move alike
            state = moves[state].get(c, -1) if c in moves[state] else self._move(state, c)
            for n, edits in self.stems[state]:
                best[n] = min(edits, best.get(n, 9))
            if not self.sets[state]:
                break
        for n, edits in self.words[state]:
            best[n] = min(edits, best.get(n, 9))
        return tuple(sorted(best.items()))


# --- model --------------------------------------------------------------------


@dataclass
class Model:
    entries: list[Entry]
    belief: dict[tuple[int, int, bool], float] = field(default_factory=dict)

    def chance(self, entry: int, edits: int, quoted: bool) -> float:
        return self.belief.get((entry, edits, quoted), prior(edits, quoted))


def prior(edits: int, quoted: bool) -> float:
    return BELIEF[edits] * (QUOTED if quoted else 1.0)


class Matcher:
    """Hits of texts; a worker remembers the words that it has seen."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, Automaton(model.entries)
        self.clean: set[str] = set()
        self.hit: dict[str, tuple[int, int]] = {}

    def nearest(self, word: str) -> tuple[int, int] | None:
        """The one entry that a word counts for, and the edits: the fewest, then the longest entry, then the first."""
        found = self.automaton.match(word)
        return min(found, key=lambda x: (x[1], -len(self.model.entries[x[0]].text), x[0])) if found else None

    def hits(self, text: str | None) -> set[tuple[str, int, int, bool]]:
        """(word, entry, edits, quoted) of the hits of a text."""
        lowered = (text or "").lower()
        words = set(_WORD.findall(lowered))
        if len(self.clean) > CACHE_WORDS:
            self.clean.clear()
        if len(self.hit) > CACHE_WORDS:
            self.hit.clear()
        found = {w: self.hit[w] for w in words & self.hit.keys()}
        for word in words - self.clean - found.keys():
            if matched := self.nearest(word):
                found[word] = matched
                if len(word) <= CACHE_LETTERS:
                    self.hit[word] = matched
            elif len(word) <= CACHE_LETTERS:
                self.clean.add(word)
        out: set[tuple[str, int, int, bool]] = set()
        if found:
            spans = [m.span() for m in _WORD.finditer(lowered)]
            for at, (start, end) in enumerate(spans):
                if (word := lowered[start:end]) in found:
                    out.add((word, *found[word], quoted(lowered, spans, at)))
        return out

    def score(self, text: str | None) -> float:
        best: dict[str, float] = {}
        for word, entry, edits, apart in self.hits(text):
            best[word] = max(best.get(word, 0.0), self.model.chance(entry, edits, apart))
        clean = 1.0 - BASE_SCORE
        for chance in best.values():
            if chance >= LEAST_HIT:
                clean *= 1.0 - chance
        return 1.0 - clean


def quoted(text: str, spans: list[tuple[int, int]], at: int) -> bool:
    """Whether the word stands between quotation marks, or by a reporting verb, within its window."""
    low, high = spans[max(0, at - WINDOW)][0], spans[min(len(spans) - 1, at + WINDOW)][1]
    start, end = spans[at]
    before, after = text[low:start], text[end : high + 1]
    opened = any(before.count(a) > before.count(b) if a != b else before.count(a) % 2 == 1 for a, b in zip(_OPEN, _CLOSE))
    closed = any(b in after for b in _CLOSE)
    if opened and closed:
        return True
    return any(text[a:b] in _REPORTING for a, b in spans[max(0, at - WINDOW) : at + WINDOW + 1])


def choose(rows: list[tuple[str, int, int]], positive: int, negative: int) -> list[Entry]:
    """Lexicon from (feature, toxic texts, other texts); features are ``=word`` or ``^stem``.

    Kept are significant features (likelihood ratio, corrected for their
    number). Of a stem and its extensions the longest stands that has nearly the
    stem's support; what it covers goes.
    """
    if not positive or not negative:
        return []
    share = positive / (positive + negative)
    least = 2 * math.log(max(len(rows), 2)) + 8
    good: dict[str, int] = {}
    for feature, pos, neg in rows:
        n = pos + neg
        ratio = 2 * (pos * math.log(pos / n / share) + (neg * math.log(neg / n / (1 - share)) if neg else 0))
        if pos / n >= PURITY and ratio >= least:
            good[feature] = pos
    out: list[Entry] = []
    left = set(good)
    begins = lambda f, g: g[0] == "^" and f[1:].startswith(g[1:]) and f != g
    while left:
        root = min(left, key=lambda f: (len(f), f[0] == "=", f))
        final = max((f for f in left if (begins(f, root) or f == root) and good[f] >= 0.97 * good[root]), key=lambda f: (len(f), f[0] == "=", f))
        out.append(Entry(final[1:], "word" if final[0] == "=" else "stem"))
        left = {f for f in left if f != final and not begins(f, final) and f[1:] != final[1:] and not (begins(final, f) and good[f] <= good[final] / 0.97)}
    return sorted(out, key=lambda e: (e.text, e.kind))


def features(text: str) -> set[str]:
    words = {w for w in _WORD.findall(text.lower()) if len(w) >= 3 and not w.isdigit()}
    return {f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in STEM_LENGTHS if len(w) >= n}


def _near_keys(text: str) -> tuple[int, int]:
    """The least and the greatest of the hashed 5-word shingles: near copies mostly share one of them."""
    words = text.encode().lower().split()
    found = [xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 5])) >> 1 for i in range(max(1, len(words) - 4))]
    return min(found), max(found)


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        keys = list(zip(*map(_near_keys, texts))) or [(), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts), *(pa.array(k, pa.int64()) for k in keys)], names=["toxic", "text", "least", "greatest"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either kind that have a feature; merged over the batch, or less of it where it has many."""
    for batch in batches:
        found: tuple[Counter, Counter] = Counter(), Counter()
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found[toxic].update(features(text))
            if len(found[0]) + len(found[1]) >= TALLY:
                yield _counted(found)
        yield _counted(found)


def _counted(found: tuple[Counter, Counter]) -> pa.RecordBatch:
    """The counts so far, which begin anew."""
    names = list(found[0].keys() | found[1].keys())
    columns = [pa.array(names, pa.string()), *(pa.array([found[kind][n] for n in names], pa.int64()) for kind in (1, 0))]
    for counter in found:
        counter.clear()
    return pa.RecordBatch.from_arrays(columns, names=["feature", "pos", "neg"])


def _evidence(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            rows = [(*hit, t) for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in sorted({h[1:] for h in matcher.hits(text)})]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.bool_(), pa.int32()))], names=["entry", "edits", "quoted", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from the labelled documents outside the held-out fold, at most ``fit_rows`` of them.

    A doc_id with labels of both kinds counts as toxic. Near copies count once.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("toxic", "text")  # fit_rows rows of two numbers
    rows = rows.mapInArrow(_training, "toxic int, text string, least long, greatest long")
    for key, other in (("least", "greatest"), ("greatest", "least")):  # the same row of each group, whatever the partitions
        first = F.min(F.struct(F.xxhash64("text"), "text", other))
        rows = rows.groupBy("toxic", key).agg(first.alias("first")).select("toxic", key, "first.text", f"first.{other}")
    rows = materialize(rows.select("toxic", "text"), "training")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    support = max(3, math.ceil(SUPPORT * positive))
    counted = rows.mapInArrow(_tally, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    tested = counted.where(F.col("pos") >= support).select("feature", "pos", "neg").toArrow()  # no more than the features of a text / SUPPORT
    model = Model(choose(list(zip(*(c.to_pylist() for c in tested.columns))), positive, negative))
    if not model.entries:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seen = rows.select("toxic", "text").mapInArrow(_evidence(shared), "entry int, edits int, quoted boolean, toxic int")
    seen = seen.groupBy("entry", "edits", "quoted").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    belief = {}
    for r in seen.collect():  # at most six rows an entry
        base = prior(r["edits"], r["quoted"])
        belief[r["entry"], r["edits"], r["quoted"]] = (r["pos"] + BELIEF_DOCS * base) / (r["pos"] + r["neg"] + BELIEF_DOCS)
    return Model(model.entries, belief)


_matchers: dict[int, Matcher] = {}


def _matcher(shared) -> Matcher:
    """One for each broadcast model and worker."""
    model = shared.value
    if id(model) not in _matchers:
        _matchers.clear()
        _matchers[id(model)] = Matcher(model)
    return _matchers[id(model)]


def _score(shared, texts: int, kept: list[int], name: str):
    """The columns ``kept`` and the score, as column ``name``, of the column ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for batch in batches:
            scores = pa.array(np.array([matcher.score(x) for x in batch.column(texts).to_pylist()], np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), scores], names=[*(batch.schema.names[c] for c in kept), name])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= 0.7).

    Null and empty texts have the base score. Rows that repeat a doc_id are each
    scored. Extra columns are not carried; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(_score(shared, 1, [0], "score"), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold; the columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, name = docs.columns.index("text"), fresh(docs.columns, "toxic_score")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(_score(shared, at, list(range(len(docs.columns))), name), schema).where(F.col(name) < threshold).drop(name)
