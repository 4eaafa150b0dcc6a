"""Values typed by hand, mapped to the entries of a reference list that may be meant, or to none.

The reference entries stand in two tries, without marks and case: one holds
their whole names, the other their words.  A typed value runs through a trie as
a Levenshtein automaton (with swapped neighbours as one edit): the state is a
row of edit distances, a branch is left as soon as no distance within the limit
remains, and the limit depends on the length of what was typed.

Alias paths lead from the words to the same entries, without being written out
one by one: each typed word finds the entry words within its limit, and those
that it cuts short ("tak hes").  An entry is reached

* ``WHOLE``: by its name, or by all its words in any order;
* ``HELD``: by all its words, with further words around them ("test 3");
* ``SOME``: by at least two of its words and nothing but numbers around them;
* ``SHORT``: by all its words, some of them cut short.

Further words are never passed over where a word of the entry is missing, so a
value that only shares words with an entry doesn't reach it.  All entries
reached come out with their edits; the nearest is meant, and a tie names none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavak.llm.batches import mapped
from kavak.llm.plain import plain_many
from kavak.plans.lineage import written

NONE = -1
_FOLD = str.maketrans("çğıöşüâîûäàáéèêëïíóôúùñ", "cgiosuaiuaaaeeeeiioouun")
# Small letters of other scripts whose capitals look like Latin ones (a capital was exchanged, then the case).
_FOLD |= str.maketrans("вкмнтрсуохаеіѕјβεζηικμνορτυχα", "bkmhtpcyoxaeisjbezhikmvoptyxa")
_WORD = re.compile(r"[^\W_]+")
#: The least letters of a word that is cut short, and of all words of an entry reached by some of them.
CUT, LEAST_SOME = 3, 6
#: Names whose tries one worker holds; a longer list is searched in pieces of so many.
PIECE = 10_000
WHOLE, HELD, SOME, SHORT = range(4)
KINDS = ("whole", "held", "some", "short")


def folded(text: str) -> list[str]:
    """The words of a plain text without case and marks."""
    low = text.replace("İ", "i").replace("I", "i").lower().replace("̇", "")
    return _WORD.findall(low.translate(_FOLD))


def limit(length: int, kind: int) -> int:
    """Edits allowed in all on a path of ``kind`` for ``length`` signs."""
    if kind in (WHOLE, HELD):
        return 0 if length < 4 else 1 if length < 8 else 2 if length < 11 else 3 if length < 24 else 4
    if kind == SOME:
        return 0 if length < 8 else 1 if length < 14 else 2
    return 0 if length < 12 else 1


def word_limit(length: int) -> int:
    """Edits allowed in one word of ``length`` signs."""
    return 1 if length < 5 else 2 if length < 10 else 3


def _step(most: int, row: tuple[int, ...], before: tuple[int, ...] | None, same: int, swapped: int, depth: int, length: int) -> tuple[int, ...] | None:
    """The automaton's next state, None if nothing within ``most`` edits remains.

    A state holds the distances of the path so far to the beginnings of the
    value at most ``most`` signs shorter or longer: place k is the beginning of
    depth - most + k signs.
    """
    new, left, far = [], most + 1, most + 1
    for k in range(2 * most + 1):
        j = depth - most + k
        if j < 0 or j > length:
            cost = far
        elif j == 0:
            cost = depth
        else:
            cost = min(row[k] + (not same >> k & 1), left + 1)
            if k < 2 * most:
                cost = min(cost, row[k + 1] + 1)
            if j > 1 and swapped >> k & 1:
                cost = min(cost, before[k] + 1)
        left = cost = min(cost, far)
        new.append(cost)
    return tuple(new) if min(new) <= most else None


class _Node:
    __slots__ = ("next", "ends", "below")

    def __init__(self) -> None:
        self.next: dict[str, _Node] = {}
        self.ends: list[int] = []
        self.below: list[int] = []


class Trie:
    """Strings with a number each; :meth:`near` finds those within some edits of a value."""

    def __init__(self, strings: Iterable[tuple[int, str]], cut: int = 0) -> None:
        """With ``cut`` each beginning of so many letters or more leads to the string as well (:meth:`begun`)."""
        self.root = _Node()
        self.steps: dict[int, dict] = {}
        for n, text in strings:
            node = self.root
            for depth, c in enumerate(text, 1):
                node = node.next.setdefault(c, _Node())
                if cut and cut <= depth < len(text):
                    node.below.append(n)
            node.ends.append(n)

    def at(self, value: str) -> _Node | None:
        node = self.root
        for c in value:
            node = node.next.get(c)
            if node is None:
                return None
        return node

    def begun(self, value: str) -> list[int]:
        """The strings that ``value`` cuts short."""
        node = self.at(value)
        return node.below if node else []

    def near(self, value: str, most: int) -> dict[int, int]:
        """Number -> edits of every string within ``most`` edits of ``value``."""
        if not most:
            node = self.at(value)
            return dict.fromkeys(node.ends, 0) if node else {}
        length, wide = len(value), 2 * most + 1
        found: dict[int, int] = {}
        window = (1 << wide) - 1
        # where each sign stands in the value, moved so that windows begin at bit ``depth``
        places: dict[str, int] = {}
        for j, c in enumerate(value):
            places[c] = places.get(c, 0) | 1 << (j + most + 1)
        steps = self.steps.setdefault(most, {})
        if len(steps) > 400_000:
            steps.clear()
        first = tuple(k - most if k >= most and k - most <= length else most + 1 for k in range(wide))
        todo = [(node, c, 1, first, None, "") for c, node in self.root.next.items()]
        get = places.get
        while todo:
            node, c, depth, row, before, came = todo.pop()
            # which signs of the window are c; where c and the sign before it stand swapped
            same = get(c, 0) >> depth & window
            swapped = (get(c, 0) >> depth - 1) & (get(came, 0) >> depth) & window if before else 0
            rest = length - depth
            key = (row, before if swapped else None, same, swapped, depth if depth < most else most, rest if -wide < rest < most else most if rest >= most else -wide)
            new = steps.get(key, 0)
            if new == 0:
                new = steps[key] = _step(most, row, before, same, swapped, depth, length)
            if new is None:
                continue
            if node.ends and -most <= rest <= most and new[rest + most] <= most:
                for n in node.ends:
                    found[n] = min(new[rest + most], found.get(n, most))
            below = depth + 1
            for c2, follow in node.next.items():
                todo.append((follow, c2, below, new, row, c))
        return found


class Reached(NamedTuple):
    """How an entry was reached; the least is the nearest."""

    edits: int
    kind: int
    left: int  # signs of the words typed around the entry's


class Entries:
    """A reference list, or a piece of it, as tries; ``entries`` are (number, name)."""

    def __init__(self, entries: Sequence[tuple[int, str]]) -> None:
        self.words = [folded(name) for _, name in entries]
        self.numbers = [n for n, _ in entries]
        self.names = Trie((i, " ".join(w)) for i, w in enumerate(self.words) if w)
        self.most_words = max(map(len, self.words), default=0)
        distinct = sorted({w for words in self.words for w in words})
        place = {w: k for k, w in enumerate(distinct)}
        self.holders: list[list[tuple[int, int]]] = [[] for _ in distinct]
        for i, words in enumerate(self.words):
            for spot, w in enumerate(words):
                self.holders[place[w]].append((i, spot))
        self.vocabulary = Trie(enumerate(distinct), CUT)
        self.known: dict[str, list[tuple[int, int, bool]]] = {}

    def _word(self, word: str) -> list[tuple[int, int, bool]]:
        """(entry word, edits, cut short) of what a typed word may mean."""
        out = self.known.get(word)
        if out is None:
            out = [(w, edits, False) for w, edits in self.vocabulary.near(word, word_limit(len(word))).items()]
            out += [(w, 0, True) for w in self.vocabulary.begun(word)]
            if len(self.known) < 200_000:
                self.known[word] = out
        return out

    def _by_words(self, typed: list[str], found: dict[int, Reached]) -> None:
        """Entries whose words were typed, in any order."""
        met: dict[int, list[tuple[int, bool, int, int]]] = {}
        for t, word in enumerate(typed):
            for w, edits, cut in self._word(word):
                for i, spot in self.holders[w]:
                    met.setdefault(i, []).append((edits, cut, spot, t))
        for i, ways in met.items():
            ways.sort()
            whole = [way for way in ways if not way[1]]
            for some in (whole, ways) if len(whole) < len(ways) else (ways,):
                how = self._assigned(self.words[i], some, typed)
                if how and (self.numbers[i] not in found or how < found[self.numbers[i]]):
                    found[self.numbers[i]] = how

    @staticmethod
    def _assigned(words: list[str], ways: list[tuple[int, bool, int, int]], typed: list[str]) -> Reached | None:
        """Typed words take the entry's words, the least edits first; what remains decides the kind."""
        spots: set[int] = set()
        used: set[int] = set()
        edits = signs = 0
        short = False
        for cost, cut, spot, t in ways:
            if spot not in spots and t not in used:
                spots.add(spot)
                used.add(t)
                edits, short, signs = edits + cost, short or cut, signs + len(typed[t])
        around = [w for t, w in enumerate(typed) if t not in used]
        if len(spots) == len(words):
            kind = SHORT if short else HELD if around else WHOLE
            left = sum(map(len, around))
        elif len(used) >= 2 and signs >= LEAST_SOME and not short and all(w.isdigit() for w in around):
            kind, left = SOME, 0  # a tie, whatever is missing
        else:
            return None
        return Reached(edits, kind, left) if edits <= limit(signs + len(used) - 1, kind) else None

    def _by_name(self, typed: list[str], found: dict[int, Reached]) -> None:
        """Entries whose name stands in the value, blanks being signs as others are."""
        n = len(typed)
        alike = [bool(self._word(w)) for w in typed]
        for a in range(n):
            # an edit may set one blank, so a name takes a few words more than its own
            for b in range(a + 1, min(n, a + self.most_words + limit(99, WHOLE)) + 1):
                if b - a < n and not any(alike[a:b]):
                    continue
                text = " ".join(typed[a:b])
                left = sum(map(len, typed[:a])) + sum(map(len, typed[b:]))
                kind = HELD if left else WHOLE
                for i, edits in self.names.near(text, limit(len(text), kind)).items():
                    how = Reached(edits, kind, left)
                    if self.numbers[i] not in found or how < found[self.numbers[i]]:
                        found[self.numbers[i]] = how

    def within(self, text: str | None, all: bool = True) -> dict[int, Reached]:
        """Entry's number -> how it was reached, of every entry within the limits.

        Without ``all`` names are searched only where words reach no entry
        whole: blanks set amiss, or short words with several edits.
        """
        typed = folded(text or "")
        found: dict[int, Reached] = {}
        self._by_words(typed, found)
        if all or not any(how.kind in (WHOLE, HELD) for how in found.values()):
            self._by_name(typed, found)
        return found

    def nearest(self, text: str | None) -> tuple[Reached, int, bool] | None:
        """(how, number, whether it is the only one) of the nearest entry; None if none is reached."""
        found = self.within(text, all=False)
        if not found:
            return None
        least = min(found.values())
        numbers = [n for n, how in found.items() if how == least]
        return least, min(numbers), len(numbers) == 1


@lru_cache(4)
def _entries(entries: tuple[tuple[int, str], ...]) -> Entries:
    return Entries(entries)


def _pieces(reference: DataFrame, number: str, name: str, piece: int) -> list[tuple[tuple[int, str], ...]]:
    """The list's (number, name) in pieces; a name that stands twice has its least number, null names are left out."""
    names = reference.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(F.col(number).cast("int")).alias("number"))
    held = names.orderBy("number", "name").toArrow()
    pairs = list(zip(held["number"].to_pylist(), held["name"].to_pylist()))
    return [tuple(pairs[at : at + piece]) for at in range(0, len(pairs), piece)]


def _typed(rows: DataFrame, value: str) -> DataFrame:
    """Each value once, over as many tasks as there are cores for: it is little data and much work."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return rows.filter(F.col(value).isNotNull()).select(F.col(value).alias("value")).distinct().repartition(tasks)


def near_values(rows: DataFrame, value: str, reference: DataFrame, number: str, name: str, piece: int = PIECE) -> DataFrame:
    """``(value, number, edits, kind)``: every entry within the limits of each distinct value; values that reach none give no row.

    Null values and null names take no part; an empty list or table gives none.
    """
    typed, out = _typed(rows, value), None
    for entries in _pieces(reference, number, name, piece) or [()]:

        def work(batch: pa.RecordBatch, entries=entries) -> pa.RecordBatch:
            held, rows = _entries(entries), []
            for text, plain in zip(batch.column(0).to_pylist(), plain_many(batch.column(0).to_pylist())):
                rows += [(text, n, how.edits, KINDS[how.kind]) for n, how in held.within(plain).items()]
            columns = list(zip(*rows)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()))], ["value", "number", "edits", "kind"])

        part = typed.mapInArrow(mapped("value", work), "value string, number int, edits int, kind string")
        out = part if out is None else out.union(part)
    return out.select(F.col("value").alias(value), F.col("number").alias(number), "edits", "kind")


def mapped_values(rows: DataFrame, id: str, value: str, reference: DataFrame, number: str, name: str, piece: int = PIECE) -> DataFrame:
    """``(id, number)`` of each row whose value isn't null and isn't exactly a name of the list.

    ``number`` is -1 where the value reaches no entry, or several as near.
    Repeated rows count once.  Each distinct value is searched once, wherever it
    stands, and joined back; a value that very many rows hold is one row of the
    search, and the join's hot keys are split at run time.  A list of more than
    ``piece`` names is searched in pieces, whose nearest entries are compared.
    Entries with a null name are left out, a name that stands twice names its
    least number.  An empty list maps everything to -1; empty rows give none.
    """
    pieces = _pieces(reference, number, name, piece)
    exact = reference.filter(F.col(name).isNotNull()).select(F.col(name).alias("value")).distinct()
    typed = rows.select(F.col(id).cast("long").alias("id"), F.col(value).alias("value")).filter(F.col("value").isNotNull()).join(exact, "value", "left_anti")
    values, found = _typed(typed, "value"), None
    for entries in pieces or [()]:

        def work(batch: pa.RecordBatch, entries=entries) -> pa.RecordBatch:
            held = _entries(entries)
            near = [held.nearest(plain) for plain in plain_many(batch.column(0).to_pylist())]
            parts = [[r and r[0][k] for r in near] for k in range(3)] + [[r and r[1] for r in near], [r and r[2] for r in near]]
            types = [pa.int32()] * 4 + [pa.bool_()]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p, t) for p, t in zip(parts, types))], ["value", "edits", "kind", "left", "number", "only"])

        part = values.mapInArrow(mapped("value", work), "value string, edits int, kind int, left int, number int, only boolean")
        found = part if found is None else found.union(part)
    if len(pieces) > 1:
        # the nearest of the pieces' nearest; as many rows a value as there are pieces
        best = F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("edits", "kind", "left", "number", "only"))))
        top = found.groupBy("value").agg(best.alias("b"))
        rank = lambda k: F.struct(*(F.get("b", F.lit(k))[c] for c in ("edits", "kind", "left")))
        alone = F.get("b", F.lit(0))["only"] & ((F.size("b") < 2) | ~rank(0).eqNullSafe(rank(1)))
        found = top.select("value", F.get("b", F.lit(0))["number"].alias("number"), alone.alias("only"))
    meant = found.select("value", F.when(F.col("only"), F.col("number")).otherwise(F.lit(NONE)).alias("number"))
    done = typed.join(written(meant, "meant"), "value")
    return done.select(F.col("id").alias(id), F.col("number").alias(number)).distinct()
