"""Language of whole texts by cross-parsing entropy.

Per language, a suffix automaton of labelled text recognises every substring of
it. A text is parsed greedily against each automaton: a phrase is the longest
match with the labelled text from where the last phrase ended. The fewer
phrases a text needs, each at the cost of the logarithm of the labelled text's
length, the lower its cross entropy; the lowest per character wins.

Bounded sample: at most ``sample_chars`` characters of labelled text a language
(30,000 by default), chosen by hash of the id among rows outside the evaluation
fold with a non-null lang; at most ``most_languages`` languages, the most
frequent ones. Texts are parsed whole, in pieces of ``PIECE`` characters side by
side; a piece's end ends a phrase for every language alike.

Letters: every letter of any language's sample is a symbol, whatever the script;
capitals share that of their lower case. A letter that a language's sample lacks is
a phrase of its own there, at the cost of the largest sample's phrase and of a letter
among all, so that no language is the cheaper for what it lacks. Only what is no letter is left out of texts and samples.
A language's DENSE most frequent letters have a column each in its table, its other
letters are looked up among the sorted transitions: the same answers in less memory.

Rows: a null text, or one without a letter, is ``und`` with score 0; so is every text if
there is no labelled text. Ties go to the first language by name: so does a text all of
whose letters no sample holds, with the score 1 / number of languages.
lang, source and doc_id are never inputs of a prediction; repeated rows are each
predicted; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import held_out, text_slabs

SAMPLE_CHARS = 30_000
MOST_LANGUAGES = 200
PIECE = 512
STRETCH = 2000  # characters that one labelled text gives to the sample at most
SLAB_CHARS = 4_000_000
DENSE = 96
_TABLES: dict[int, np.ndarray] = {}


def _transitions(codes: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of ``codes``: the transitions (symbol -> state) of each state."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        cur = len(step)
        step.append({})
        link.append(-1)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


def _sparse(step: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State, symbol and next state of every transition."""
    counts = [len(d) for d in step]
    return (np.repeat(np.arange(len(step)), counts), np.fromiter((c for d in step for c in d), np.int64, sum(counts)),
            np.fromiter((t for d in step for t in d.values()), np.int64, sum(counts)))


def suffix_automaton(codes: list[int], n_symbols: int) -> np.ndarray:
    """Transitions [state, symbol] -> state, -1 where no substring goes on."""
    step = _transitions(codes)
    table = np.full((len(step), n_symbols), -1, dtype=np.int32)
    state, symbol, to = _sparse(step)
    table[state, symbol] = to
    return table


def _normal(text: str) -> str:
    return " ".join(text.lower().split())


class Automaton:
    """One language's automaton over its own letters.

    Columns 0 to ``dense`` - 1 of ``go`` are its most frequent letters, the next one
    is every letter that it lacks; ``column`` maps the symbols of all languages to
    these and, from ``dense`` + 1 on, to its other letters, which are looked up in ``keys``.
    The last state is that after a lacking letter: whatever comes next starts a phrase."""

    def __init__(self, text: str, code: dict[str, int]):
        from collections import Counter
        seen = Counter(c for c in text if c in code)
        own = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        self.dense = min(len(own), DENSE)
        local = {c: i if i < self.dense else i + 1 for i, c in enumerate(own)}
        self.column = np.full(len(code) + 1, self.dense, np.int32)  # the last symbol: a letter of no sample
        for c, i in local.items():
            self.column[code[c]] = i
        step = _transitions([local[c] for c in text if c in local])
        state, symbol, to = _sparse(step)
        few = symbol < self.dense
        void = len(step)
        table = np.full((void + 1, self.dense), -1, np.int32)
        table[state[few], symbol[few]] = to[few]
        # A dead end starts a new phrase with the symbol that ended the last; the
        # lowest bit says so. A symbol the language lacks is a phrase of its own.
        dead = table < 0
        table = np.where(dead, table[0][None, :], table) * 2 + dead
        lacking = np.full((void + 1, 1), void * 2 + 1)
        lacking[0] = void * 2
        self.go = np.ascontiguousarray(np.concatenate([table, lacking], axis=1).astype(np.int32))
        self.width = len(own) + 1
        self.keys = state[~few] * self.width + symbol[~few]
        order = np.argsort(self.keys)
        self.keys, self.to = self.keys[order], (to[~few][order] * 2).astype(np.int32)
        self.root = np.zeros(self.width, np.int32)  # where a phrase goes that starts with a letter
        first = ~few & (state == 0)
        self.root[symbol[first]] = to[first] * 2 + 1

    def next(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Twice the next state, plus 1 where a phrase has ended before it."""
        if not len(self.keys):
            return self.go[state, column]
        got = self.go[state, np.minimum(column, self.dense)]
        rare = np.flatnonzero(column > self.dense)
        if len(rare):
            c = column[rare]
            key = state[rare].astype(np.int64) * self.width + c
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            got[rare] = np.where(self.keys[at] == key, self.to[at], self.root[c])
        return got


class Parser:
    """Automata of all languages, and the symbols of all their letters."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.alphabet = "".join(sorted({c for t in texts.values() for c in t if c.isalpha() or c == " "}))
        self.size = {k: max(2, len(t)) for k, t in texts.items()}
        code = {c: i for i, c in enumerate(self.alphabet)}
        self.automata = [Automaton(texts[name], code) for name in self.names]
        self.unknown = len(code)  # a letter of no sample
        self.other = len(code) + 1  # what is no letter

    def _table(self) -> np.ndarray:
        """Symbol of each code point; capitals share that of their lower case."""
        key = hash(self.alphabet)
        if key not in _TABLES:
            t = np.full(0x110000, self.other, np.int32)
            code = {c: i for i, c in enumerate(self.alphabet)}
            for point in range(0x110000):
                if (c := chr(point)).isalpha():
                    t[point] = code.get(c.lower()[0], self.unknown)
            space = self.alphabet.find(" ")
            if space >= 0:
                for c in "\n\t\r ":
                    t[ord(c)] = space
            _TABLES.clear()
            _TABLES[key] = t
        return _TABLES[key]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases [text, language], parsed characters [text])."""
        return self._phrases(texts)[:2]

    def _phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``phrases``, the letters that a language lacks [text, language], and whether
        a text has a letter."""
        table = self._table()
        total, lacks = np.zeros((2, len(texts), len(self.names)))
        chars = np.zeros(len(texts))
        known = np.zeros(len(texts), bool)
        space = self.alphabet.find(" ")
        for lo, hi in text_slabs(texts, SLAB_CHARS):
            symbols = [table[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")] for t in texts[lo:hi]]
            symbols = [s[s != self.other] for s in symbols]
            lens = np.asarray([len(s) for s in symbols])
            chars[lo:hi] = lens
            known[lo:hi] = [bool((s != space).any()) for s in symbols]
            flat = np.concatenate([*symbols, np.zeros(PIECE, np.int32)])
            to = np.cumsum(lens)
            starts = np.concatenate([[0], to[:-1]]) if len(lens) else np.zeros(0, int)
            pieces = -(-lens // PIECE)
            owner = np.repeat(np.arange(len(lens)), pieces)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at = starts[owner] + nth * PIECE
            size = np.minimum(PIECE, lens[owner] - nth * PIECE)
            order = np.argsort(-size, kind="stable")
            at, size, owner = at[order], size[order], owner[order]
            for k, automaton in enumerate(self.automata):
                columns = automaton.column[flat]
                lacking = np.flatnonzero(columns[:to[-1]] == automaton.dense)
                lacks[lo:hi, k] = np.bincount(to.searchsorted(lacking, "right"), minlength=len(lens))
                state = np.zeros(len(at), np.int32)
                ends = np.ones(len(at), np.int64)  # the phrase that the piece's end closes
                live = len(at)
                for j in range(int(size[0]) if len(size) else 0):
                    while size[live - 1] <= j:
                        live -= 1
                    got = automaton.next(state[:live], columns[at[:live] + j])
                    ends[:live] += got & 1
                    state[:live] = got >> 1
                total[lo:hi, k] += np.bincount(owner, weights=ends, minlength=len(lens))
        return total, chars, lacks, known

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        phrases, chars, lacks, known = self._phrases([t or "" for t in texts])
        phrase = np.log([self.size[n] for n in self.names])
        cost = (phrases * phrase + lacks * (phrase.max() - phrase + math.log(len(self.alphabet) + 1))) / np.maximum(chars, 1)[:, None]
        best = cost.argmin(axis=1)
        weight = np.exp(-(cost - cost.min(axis=1, keepdims=True)) * np.minimum(chars, 200)[:, None])
        score = np.where(known, 1 / weight.sum(axis=1), 0.0)
        return [self.names[b] if k else "und" for b, k in zip(best, known)], score


def train(docs: DataFrame, sample_chars: int = SAMPLE_CHARS, most_languages: int = MOST_LANGUAGES) -> Parser:
    """Automata of a bounded sample of the labelled training fold."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"), F.col("text").cast("string").alias("text"),
                       F.least(F.length("text"), F.lit(STRETCH)).cast("long").alias("n")).where("n > 0")
    sizes = {r["lang"]: r["c"] for r in rows.groupBy("lang").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "lang").limit(most_languages).collect()}
    if not sizes:
        return Parser({})
    # A row is drawn by its hash with the share that gives three samples' worth of text.
    share = F.create_map(*[F.lit(x) for k, c in sizes.items() for x in (k, min(1.0, 3.0 * sample_chars / c))])
    drawn = rows.where(F.col("lang").isin(list(sizes))).where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    texts: dict[str, list[str]] = {}
    held: dict[str, int] = {}
    for r in drawn.select("lang", "h", F.substring("text", 1, STRETCH).alias("t")).orderBy("h", "t").collect():
        if held.get(r["lang"], 0) < sample_chars:
            t = _normal(r["t"])[:sample_chars - held.get(r["lang"], 0)]
            texts.setdefault(r["lang"], []).append(t)
            held[r["lang"]] = held.get(r["lang"], 0) + len(t) + 1
    return Parser({k: " ".join(v) for k, v in texts.items()})


def identify(docs: DataFrame, model: Parser) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lang, score = shared.value.predict(b["text"].tolist())
            yield b[["doc_id", "held_out"]].assign(lang_pred=lang, score=score)

    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op1_language(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
