"""The languages of documents and of their segments, by a linear-chain conditional random field.

Words are labelled in their sentence.  The features of a word are itself (the
lexicon of the labelled samples), its beginnings and ends, its runs of one to
four signs and the alphabet of its letters; the transitions between labels are
learned.  Forward-backward gives each word the probability of each language,
a sentence the language of the largest sum, and the mean probability as its
confidence.  Sentences of one language in a row form a segment.

Inference is numpy over whole batches: a word's feature scores are computed
once, and forward-backward takes one step for all sentences of a batch.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kavak.llm.batches import mapped
from kavak.llm.plain import plain_many
from kavak.llm.words import fold, words

LANGS = ("az", "de", "en", "fr", "ru", "tr")
# Names and longer codes of the languages.
NAMES = {
    "az": ("az", "aze", "azj", "azerbaijani", "azeri", "azərbaycan", "azərbaycanca", "azerice", "azerbaycan", "azerbaycanca", "azerbaycan türkçesi"),
    "de": ("de", "deu", "ger", "german", "deutsch", "almanca"),
    "en": ("en", "eng", "english", "ingilizce", "i̇ngilizce"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "fransızca", "fransizca"),
    "ru": ("ru", "rus", "russian", "русский", "rusça", "rusca"),
    "tr": ("tr", "tur", "turkish", "türkçe", "turkce", "türkisch", "turc"),
}
#: At most so many labelled rows are used to fit.
FIT_ROWS = 6_000
#: And, to learn more words, at most so many documents of each label, none of more signs than this.
FIT_DOCUMENTS = 60
FIT_SIGNS = 3_000
#: Features are hashed to so many places.
PLACES = 1 << 17
#: A full sentence ends with a full stop and has at least so many words.
SENTENCE_WORDS = 3
ROUNDS = 20
#: Words remembered in a worker before it starts anew.
REMEMBERED = 200_000
_NBSP = re.compile("&nbsp;", re.IGNORECASE)
_BARE = str.maketrans("çğıöşüâîûäəéèêëàùôïœß", "cgiosuaiuaeeeeeauoios")


class Model(NamedTuple):
    """``weights`` (places, languages) and ``moves`` (language before, language)."""

    weights: np.ndarray
    moves: np.ndarray


def features(word: str) -> list[int]:
    """The feature places of a folded word; none for a number."""
    if not word.isalpha():
        return []
    w = f"<{word}>"
    names = [w, *(w[: k + 1] + "~" for k in (2, 3, 4)), *("~" + w[-k - 1 :] for k in (1, 2, 3, 4, 5))]
    names += [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]
    names.append("?c" if "Ѐ" <= word[0] <= "ԯ" else "?l")
    return [zlib.crc32(x.encode()) % PLACES for x in dict.fromkeys(names)]


def _sums(weights: np.ndarray, lists: Sequence[Sequence[int]]) -> np.ndarray:
    """For each list of places the sum of their weights, over the square root of their number."""
    many = np.fromiter(map(len, lists), np.int64, len(lists))
    out = np.zeros((len(lists), weights.shape[1]))
    full = np.flatnonzero(many)
    if len(full):
        flat = np.fromiter((i for x in lists for i in x), np.int64, int(many.sum()))
        out[full] = np.add.reduceat(weights[flat], (np.cumsum(many) - many)[full], axis=0) / np.sqrt(many[full])[:, None]
    return out


def forward_backward(scores: np.ndarray, many: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each label for each word, expected number of each move).

    ``scores`` holds the words of all chains one after the other, ``many`` the
    words of each chain.
    """
    order = np.argsort(-many, kind="stable")
    first = (np.cumsum(many) - many)[order]
    long = many[order]
    e = np.exp(scores - scores.max(1, keepdims=True))
    m = np.exp(moves)
    ahead = np.empty_like(e)
    back = np.empty_like(e)
    steps = int(long[0]) if len(long) else 0
    live = np.searchsorted(-long, -np.arange(steps), "left").tolist()
    state = None
    for t in range(steps):
        at = first[: live[t]] + t
        state = e[at] if state is None else (state[: live[t]] @ m) * e[at]
        state = state / state.sum(1, keepdims=True)
        ahead[at] = state
    for t in range(steps - 1, -1, -1):
        at = first[: live[t]] + t
        b = np.ones((live[t], e.shape[1]))
        if t + 1 < steps:
            nxt = first[: live[t + 1]] + t + 1
            v = (back[nxt] * e[nxt]) @ m.T
            b[: live[t + 1]] = v / v.sum(1, keepdims=True)
        back[at] = b
    p = ahead * back
    p /= p.sum(1, keepdims=True)
    # moves: from each word that isn't the last of its chain to the next
    inner = np.ones(len(e), bool)
    inner[(np.cumsum(many) - 1)[many > 0]] = False
    here = np.flatnonzero(inner)
    pair = ahead[here][:, :, None] * m[None] * (back[here + 1] * e[here + 1])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return p, pair.sum(0)


def fit(samples: Sequence[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (language, text) rows, fitted to the conditional likelihood.

    Each sample also counts without its marks, and rows of samples of several
    languages are put in a row to show changes of language.
    """
    samples = [(LANGS.index(lang), _spaced(t)) for lang, t in samples if lang in LANGS and t]
    rng = np.random.default_rng(seed)
    texts = plain_many([t for _, t in samples])
    rows = [(lang, folded_words(t)) for (lang, _), t in zip(samples, texts)]
    rows += [(lang, [w.translate(_BARE) for w in ws]) for lang, ws in rows if lang != LANGS.index("ru")]
    rows = [(lang, ws) for lang, ws in rows if ws]
    if not rows:
        return Model(np.zeros((PLACES, len(LANGS))), np.eye(len(LANGS)))
    rng.shuffle(rows)
    chains: list[list[tuple[int, list[str]]]] = []
    at = 0
    while at < len(rows):
        n = int(rng.choice([1, 1, 2, 3]))
        chains.append(rows[at : at + n])
        at += n
    names = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in rows for w in ws))}
    lists = [features(w) for w in names]
    which = np.array([names[w] for c in chains for _, ws in c for w in ws])
    gold = np.array([lang for c in chains for lang, ws in c for _ in ws])
    many = np.array([sum(len(ws) for _, ws in c) for c in chains])
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((i for x in lists for i in x), np.int64, int(count.sum()))
    owner = np.repeat(np.arange(len(lists)), count)
    used, places = np.unique(flat, return_inverse=True)
    n_lang = len(LANGS)
    weights, moves = np.zeros((len(used), n_lang)), np.zeros((n_lang, n_lang))
    seen_w, seen_m = np.full_like(weights, 1e-2), np.full_like(moves, 1e-2)
    last = np.cumsum(many) - 1
    inner = np.ones(len(gold), bool)
    inner[last] = False
    here = np.flatnonzero(inner)
    true_moves = np.zeros_like(moves)
    np.add.at(true_moves, (gold[here], gold[here + 1]), 1)
    scale = 1 / np.sqrt(np.maximum(count, 1))
    truth = np.zeros((len(lists), n_lang))
    np.add.at(truth, (which, gold), 1)
    places_order = np.argsort(places, kind="stable")
    place_starts = np.searchsorted(places[places_order], np.arange(len(used)))
    word_starts = (np.cumsum(count) - count)[count > 0]
    for _ in range(ROUNDS):
        by_word = np.zeros((len(lists), n_lang))
        by_word[count > 0] = np.add.reduceat(weights[places], word_starts, axis=0)
        by_word *= scale[:, None]
        p, expected = forward_backward(by_word[which], many, moves)
        mass = np.stack([np.bincount(which, p[:, k], len(lists)) for k in range(n_lang)], 1)
        slope = ((truth - mass) * scale[:, None])[owner][places_order]
        slope = np.add.reduceat(slope, place_starts, axis=0) - 0.05 * weights
        seen_w += slope**2
        weights += 0.5 * slope / np.sqrt(seen_w)
        slope = true_moves - expected - 0.05 * moves
        seen_m += slope**2
        moves += 0.5 * slope / np.sqrt(seen_m)
    whole = np.zeros((PLACES, n_lang))
    whole[used] = weights
    return Model(whole.astype(np.float32), moves)


def folded_words(text: str) -> list[str]:
    """The words of a plain text, folded as :mod:`kavak.llm.words` does."""
    w = words([text])
    return ["".join(map(fold, text[a:b])) for a, b in zip(w.start.tolist(), w.end.tolist())]


#: Words from which on a run inside a sentence is another language; pieces of fewer words take their neighbour's.
SWITCH_WORDS, CARRY_WORDS = 4, 4
#: Mean probability under which a run has no certain language, and the label that it gets.
SURE, UND = 0.8, len(LANGS)


def _spaced(text: str | None) -> str | None:
    return _NBSP.sub(" ", text) if text and "&" in text else text


class Labeller:
    """Labels batches of texts with a model; remembers the scores of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.scores = np.zeros((0, len(LANGS)))

    def _scores(self, w) -> np.ndarray:
        if len(self.place) > REMEMBERED:
            self._forget()
        values, at, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        keys = values.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.place]
        if new:
            spots = at[new]
            spelled = ["".join(map(fold, map(chr, w.signs[a:b].tolist()))) for a, b in zip(w.start[spots].tolist(), w.end[spots].tolist())]
            self.scores = np.concatenate((self.scores, _sums(self.model.weights, [features(s) for s in spelled])))
            self.place.update(zip((keys[i] for i in new), range(len(self.place), len(self.place) + len(new))))
        return self.scores[np.fromiter((self.place[h] for h in keys), np.int64, len(keys))[back]]

    def sentences(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece with words: its text's number, begin and end there, whether it is a full sentence, language, confidence."""
        texts, of, begin, end, full, many, _, _, p = self.pieces(texts)
        if not len(of):
            return texts, of, begin, end, full, of, of.astype(float)
        total = np.add.reduceat(p, np.cumsum(many) - many, axis=0)
        return texts, of, begin, end, full, total.argmax(1), total.max(1) / many

    def pieces(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece with words: its text's number, begin and end there, whether it is a full sentence, its words; of each word: begin, end, the languages' probabilities."""
        texts = [t or "" for t in plain_many([_spaced(t) for t in texts])]
        w = words(texts)
        if not len(w.hashes):
            none = np.zeros(0, np.int64)
            return texts, none, none, none, none.astype(bool), none, none, none, np.zeros((0, len(LANGS)))
        s = w.signs
        stop = np.isin(s, _STOPS)
        follow = np.concatenate((s[1:], [10])).astype(np.int64)
        ends = stop & _BLANK[np.minimum(follow, len(_BLANK) - 1)]
        # a full stop after a digit and before a small letter belongs to an ordinal number
        dots = np.flatnonzero(ends & (s == 46))
        dots = dots[(dots > 0) & (dots + 2 < len(s))]
        after = np.minimum(s[np.minimum(dots + 2, len(s) - 1)], len(_SMALL) - 1)
        ordinal = (s[dots - 1] >= 48) & (s[dots - 1] <= 57) & ((s[dots + 1] == 32) & _SMALL[after])
        ends[dots[ordinal]] = False
        cut = ends | (s == 10) | (s == 13)
        piece = np.concatenate(([0], np.cumsum(cut)))[w.start]
        first = np.concatenate(([True], (piece[1:] != piece[:-1]) | (w.text[1:] != w.text[:-1])))
        begin = np.flatnonzero(first)
        many = np.diff(np.append(begin, len(piece)))
        p, _ = forward_backward(self._scores(w), many, self.model.moves)
        last = begin + many - 1
        cuts = np.flatnonzero(cut)
        stops = cuts[np.minimum(np.searchsorted(cuts, w.end[last]), len(cuts) - 1)]
        letters = np.add.reduceat((s[w.start] > 57).astype(np.int64), begin)
        full = stop[stops] & (letters >= SENTENCE_WORDS)
        text = w.text[begin]
        return texts, text, w.start[begin] - w.at[text], stops + 1 - w.at[text], full, many, w.start - w.at[w.text], w.end - w.at[w.text], p


def _word_labels(p: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The language of each word, from the chain's marginals; ``UND`` where its run isn't sure.

    A run of fewer than ``SWITCH_WORDS`` words inside a piece is a foreign word
    or phrase: it joins the longer of its neighbours, shortest runs first.
    """
    label = p.argmax(1)
    begin = np.cumsum(many) - many
    mixed = np.minimum.reduceat(label, begin) != np.maximum.reduceat(label, begin)
    for k in np.flatnonzero(mixed).tolist():
        a, b = int(begin[k]), int(begin[k] + many[k])
        own = label[a:b]
        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
        runs = [[int(own[x]), int(y - x)] for x, y in zip(edge, edge[1:])]
        while len(runs) > 1:
            i = min(range(len(runs)), key=lambda i: runs[i][1])
            if runs[i][1] >= SWITCH_WORDS:
                break
            j = i + 1 if i == 0 or (i + 1 < len(runs) and runs[i + 1][1] > runs[i - 1][1]) else i - 1
            runs[j][1] += runs.pop(i)[1]
            at = 1
            while at < len(runs):  # neighbours that now agree are one run
                if runs[at][0] == runs[at - 1][0]:
                    runs[at - 1][1] += runs.pop(at)[1]
                else:
                    at += 1
        label[a:b] = np.repeat([r[0] for r in runs], [r[1] for r in runs])
    piece = np.repeat(np.arange(len(many)), many)
    start = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (label[1:] != label[:-1]))))
    long = np.diff(np.append(start, len(label)))
    sure = np.add.reduceat(p[np.arange(len(label)), label], start) / long
    return np.where(np.repeat(sure < SURE, long), UND, label)


def _carried(label: np.ndarray, of: np.ndarray, full: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Short or unsure pieces that are no full sentence (titles, choices) take the language of the sentence before, else after, in their text."""
    begin = np.cumsum(many) - many
    head, tail = label[begin], label[begin + many - 1]
    keeps = full & (head != UND) & (tail != UND)
    place = np.arange(len(of))
    before = np.maximum.accumulate(np.where(keeps, place, -1))
    after = np.minimum.accumulate(np.where(keeps, place, len(of))[::-1])[::-1]
    before_ok = (before >= 0) & (of[np.maximum(before, 0)] == of)
    after_ok = (after < len(of)) & (of[np.minimum(after, len(of) - 1)] == of)
    near = np.where(before_ok, tail[np.maximum(before, 0)], np.where(after_ok, head[np.minimum(after, len(of) - 1)], UND))
    unsure = np.maximum.reduceat(label, begin) == UND
    takes = ~full & ((many < CARRY_WORDS) | unsure) & (before_ok | after_ok)
    return np.where(np.repeat(takes, many), np.repeat(near, many), label)


_STOPS = np.array([ord(c) for c in ".!?…"], np.uint32)
_BLANK = np.zeros(0x3001, bool)
_BLANK[[ord(c) for c in "\t\n\r  )\"'”’»*(]"]] = True
_SMALL = np.array([chr(o).islower() for o in range(0x530)])


@lru_cache(2)
def _labeller(blob: bytes) -> Labeller:
    import pickle

    return Labeller(pickle.loads(blob))


@lru_cache(4)
def _fitted(samples: tuple[tuple[str, str], ...], documents: tuple[tuple[str, str], ...]) -> bytes:
    import pickle

    model = fit(samples)
    if documents:
        more = trusted(model, documents)
        model = fit([*samples, *more])
    return pickle.dumps(model)


def trusted(model: Model, documents: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """(label, sentence) of labelled documents whose label a first model confirms and in which it is sure of no other language."""
    labeller, out = Labeller(model), []
    for k in range(0, len(documents), 300):
        part = documents[k : k + 300]
        texts, of, begin, end, full, lang, sure = labeller.sentences([t for _, t in part])
        label = np.array([LANGS.index(x) for x, _ in part])[of]
        rows = len(part)
        agree = np.bincount(of[full & (lang == label)], minlength=rows)
        other = np.bincount(of[full & (lang != label) & (sure > 0.85)], minlength=rows)
        total = np.bincount(of[full], minlength=rows)
        good = (other == 0) & (2 * agree > total)
        for i in np.flatnonzero(full & good[of]).tolist():
            out.append((LANGS[label[i]], texts[of[i]][begin[i] : end[i]]))
    # repeated sentences teach nothing new
    return list(dict.fromkeys(out))


def fitted(samples: DataFrame, lang: str, text: str, documents: DataFrame | None = None, id: str = "", label: str = "", body: str = "") -> bytes:
    """A model fitted on the driver to a bounded sample of labelled rows.

    At most ``FIT_ROWS`` of ``samples`` and, if documents are given, at most
    ``FIT_DOCUMENTS`` of each label, those of the least hash; of the latter,
    whose labels may be wrong, what a model of the samples alone confirms.
    """
    known = samples.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isin(*LANGS) & F.col("text").isNotNull())
    rows = known.orderBy(F.xxhash64("text"), "lang", "text").limit(FIT_ROWS).collect()
    taken: tuple[tuple[str, str], ...] = ()
    if documents is not None:
        coded = documents.select(F.col(id).alias("id"), code_of(F.col(label)).alias("code"), F.col(body).alias("text"))
        coded = coded.filter(F.col("code").isNotNull() & (F.length("text") <= FIT_SIGNS))
        order = Window.partitionBy("code").orderBy(F.xxhash64("id"), "id")
        some = coded.select("id", "code").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= FIT_DOCUMENTS).collect()
        code = {r["id"]: r["code"] for r in some}
        texts = coded.filter(F.col("id").isin(list(code))).select("id", "text").collect() if code else []
        taken = tuple(sorted((code[r["id"]], r["text"]) for r in texts))
    return _fitted(tuple((r["lang"], r["text"]) for r in rows), taken)


_COUNTS = "id long, languages array<struct<lang:string,sentences:int,confidence:double>>"
_SEGMENTS = "id long, segment int, lang string, confidence double, sentences int, text string"


def languages(documents: DataFrame, id: str, text: str, model: bytes) -> DataFrame:
    """``(id, languages)`` of each document: for each language its full sentences and their mean confidence.

    A text with words but no full sentence has the one language of its pieces,
    with 0 sentences; null and empty texts have an empty array.  Most sentences
    first.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, n = batch.num_rows, len(LANGS)
        _, of, _, _, full, lang, sure = _labeller(sent.value).sentences(batch.column(1).to_pylist())
        none = np.bincount(of[full], minlength=rows)[of] == 0
        used = full | none
        cell = of[used] * n + lang[used]
        many = np.bincount(cell, minlength=rows * n).reshape(rows, n)
        mean = np.bincount(cell, sure[used], minlength=rows * n).reshape(rows, n) / np.maximum(many, 1)
        # of a text without sentences the commonest language of its pieces alone
        bare = np.bincount(of[none], minlength=rows) > 0
        best = many == many.max(1, keepdims=True)
        many[bare] *= (best & (np.cumsum(best, axis=1) == 1))[bare]
        told = np.where(bare[:, None], 0, many)
        order = np.argsort(-many, axis=1, kind="stable")
        row = np.repeat(np.arange(rows), (many > 0).sum(1))
        col = np.concatenate([o[: (m > 0).sum()] for o, m in zip(order, many)]) if rows else np.zeros(0, np.int64)
        col = col.astype(np.int64)
        structs = pa.StructArray.from_arrays(
            [pa.array(np.array(LANGS, object)[col], pa.string()), pa.array(told[row, col].astype(np.int32)), pa.array(mean[row, col])], ["lang", "sentences", "confidence"]
        )
        bounds = np.concatenate(([0], np.cumsum((many > 0).sum(1)))).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), structs)], ["id", "languages"])

    rows = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(mapped("text", work), _COUNTS).withColumnRenamed("id", id)


def segments(documents: DataFrame, id: str, text: str, model: bytes) -> DataFrame:
    """Stretches of one language in each document, in order, in plain form; a stretch may begin and end inside a sentence.

    ``lang`` is ``und`` where no language is sure; ``confidence`` is the mean
    probability of the stretch's words in it (of their likeliest one for
    ``und``); ``sentences`` counts the full sentences that lie in it whole.
    Texts without words have none.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, of, begin, end, full, many, starts, ends, p = _labeller(sent.value).pieces(batch.column(1).to_pylist())
        if not len(of):
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string())], ["id", "segment", "lang", "confidence", "sentences", "text"])
        label = _carried(_word_labels(p, many), of, full, many)
        text = np.repeat(of, many)
        first = np.cumsum(many) - many
        ends[first + many - 1] = end  # the last word takes the piece's last sign along
        a = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (label[1:] != label[:-1]))))
        b = np.append(a[1:], len(label)) - 1
        number = np.arange(len(a)) - np.searchsorted(text[a], text[a])
        cut = [texts[t][x:y] for t, x, y in zip(text[a].tolist(), starts[a].tolist(), ends[b].tolist())]
        chosen = np.where(label == UND, p.max(1), p[np.arange(len(label)), np.minimum(label, len(LANGS) - 1)])
        segment = np.repeat(np.arange(len(a)), b - a + 1)
        whole = full & (segment[first] == segment[first + many - 1])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(text[a])),
                pa.array(number.astype(np.int32)),
                pa.array(np.array([*LANGS, "und"], object)[label[a]], pa.string()),
                pa.array(np.add.reduceat(chosen, a) / (b - a + 1)),
                pa.array(np.bincount(segment[first][whole], minlength=len(a)).astype(np.int32)),
                pa.array(cut, pa.string()),
            ],
            ["id", "segment", "lang", "confidence", "sentences", "text"],
        )

    rows = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(mapped("text", work), _SEGMENTS).withColumnRenamed("id", id)


def code_of(label: Column) -> Column:
    """The code that a label names in any spelling; null if it names none of the six languages."""
    low = F.lower(F.trim(F.regexp_replace(label, "\\s+", " ")))
    short = F.regexp_extract(low, "^([a-z]{2,3})(?:[-_].*)?$", 1)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(low.isin(*names) | short.isin(*(n for n in names if len(n) <= 3)), F.lit(code)).otherwise(out)
    return out


def mislabelled(documents: DataFrame, id: str, text: str, label: str, model: bytes, least: int = 2) -> DataFrame:
    """``(id, lang)``: documents whose label is missing or wrong, or whose text has several languages.

    One row for each language with at least ``least`` full sentences.  Null,
    blank and sentence-less texts give no rows.
    """
    labels = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.col(label).alias("label"))
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, n = batch.num_rows, len(LANGS)
        _, of, _, _, full, lang, _ = _labeller(sent.value).sentences(batch.column(1).to_pylist())
        many = np.bincount(of[full] * n + lang[full], minlength=rows * n).reshape(rows, n)
        row, col = np.nonzero(many >= least)
        several = (many >= least).sum(1)[row] > 1
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array(np.array(LANGS, object)[col], pa.string()), pa.array(several)], ["id", "label", "lang", "several"]
        )

    seen = labels.mapInArrow(mapped("text", work), "id long, label string, lang string, several boolean")
    wrong = F.col("several") | ~F.coalesce(code_of(F.col("label")) == F.col("lang"), F.lit(False))
    return seen.filter(wrong).select(F.col("id").alias(id), "lang")
