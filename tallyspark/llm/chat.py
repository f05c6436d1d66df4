"""Roles of transcript turns by a hidden Markov model, and canonical rendering.

A conversation is a sequence of blocks of text. Hidden states are the roles; a
block is observed through its speaker marker ("User:", "### Assistant", "[system]"
and the like at the start of its first line) and features of its lines (length,
number of lines, a closing question mark, code or list lines). The counts of
labelled blocks give initial, transition and emission probabilities (one added to
each count); Viterbi finds the most likely roles; a block is rendered as
``<|role|>``, its text without the marker, ``<|end|>``.

Roles are learnt from conversations whose crc32(conv_id as text) modulo 5 isn't 0,
and never are an input of a prediction. All labelled blocks are counted; only the
counts (roles x features x values) reach the driver. The MOST_ROLES (16) most
frequent roles are states (ties by name); a rarer role is never predicted.

Conversations are sorted over ranges of (conv_id, turn), so one of any length
spreads over tasks, and cut into segments of at most ``SEGMENT`` blocks. A segment
is a matrix of best scores from the state before it to its last state; matrices
combine, in groups of SEGMENT, until one is left for each conversation; the way
back fixes the states at each segment's ends, and every segment is then decoded
on its own. The result is that of Viterbi over the whole conversation.

Rows: a null or empty text is a block without marker; a null turn comes first;
blocks with equal conv_id and turn are ordered by a hash of the text, repeated
rows by their place; a null conv_id is one conversation; without labelled
blocks every role is ``user``. Ties go to the first role by name. Other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged

SEGMENT = 512
SEGMENT_CHARS = 1_000_000
MOST_ROLES = 16
_MARKER = re.compile(r"\s*(?:[#>*\-\[(<|]+\s*)?(user|human|question|q|customer|assistant|ai|bot|model|answer|a|gpt|system|instruction|instructions)"
                     r"(?:\s*[\])>|*]+\s*:?|\s*:)\s*", re.I)
_KINDS = {"user": 1, "human": 1, "question": 1, "q": 1, "customer": 1, "assistant": 2, "ai": 2, "bot": 2, "model": 2, "answer": 2, "a": 2,
          "gpt": 2, "system": 3, "instruction": 3, "instructions": 3}
N_FEATURES = 4


def observe(text: str | None) -> list[int]:
    """Marker, length, lines and ending of a block, as small numbers."""
    text = text or ""
    m = _MARKER.match(text)
    lines = text.count("\n") + 1
    shape = text.rstrip()[-1:] == "?"
    listed = any(x[:2] in ("- ", "* ", "``", "1.") for x in text.split("\n"))
    return [_KINDS[m.group(1).lower()] if m else 0, min(15, len(text).bit_length()), min(7, lines.bit_length()), 2 * shape + listed]


def render(role: str, text: str | None) -> str:
    text = text or ""
    m = _MARKER.match(text)
    return f"<|{role}|>\n{text[m.end():].strip() if m else text.strip()}\n<|end|>"


class Model:
    def __init__(self, counts: Counter):
        """counts: ('i', role), ('t', role, next role), ('e', role, feature, value) -> blocks."""
        seen: Counter = Counter()
        for (k, r, *rest), n in counts.items():
            if k == "e" and rest[0] == 0:
                seen[r] += n
        self.roles = sorted(r for r, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:MOST_ROLES]) or ["user"]
        n = len(self.roles)
        log = lambda part, whole, kinds: math.log((part + 1) / (whole + kinds))
        starts = sum(counts[("i", r)] for r in self.roles)
        self.step = np.zeros((n + 1, n))  # the last row: before the first block
        for i, r in enumerate(self.roles):
            out = sum(counts[("t", r, s)] for s in self.roles)
            for j, s in enumerate(self.roles):
                self.step[i, j] = log(counts[("t", r, s)], out, n)
            self.step[n, i] = log(counts[("i", r)], starts, n)
        self.emit = np.zeros((N_FEATURES, 16, n))
        for i, r in enumerate(self.roles):
            for f in range(N_FEATURES):
                whole = sum(counts[("e", r, f, v)] for v in range(16))
                for v in range(16):
                    self.emit[f, v, i] = log(counts[("e", r, f, v)], whole, 16)

    def scores(self, obs: list) -> np.ndarray:
        o = np.asarray([list(x) for x in obs], dtype=np.int64)
        return sum(self.emit[f, o[:, f]] for f in range(N_FEATURES))

    def matrix(self, obs: list) -> np.ndarray:
        """Best score from each state before the blocks to each state of the last."""
        e = self.scores(obs)
        m = self.step + e[0]
        n = len(self.roles)
        for x in e[1:]:
            m = (m[:, :, None] + self.step[None, :n, :]).max(axis=1) + x
        return m

    def decode(self, obs: list, entry: int, last: int) -> list[int]:
        """The best states of the blocks, given the state before and the last one."""
        e, n = self.scores(obs), len(self.roles)
        best, back = self.step[entry] + e[0], []
        for x in e[1:]:
            via = best[:, None] + self.step[:n]
            back.append(via.argmax(axis=0))
            best = via.max(axis=0) + x
        path = [last if last >= 0 else int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def _combine(ms: list[np.ndarray]) -> np.ndarray:
    out = ms[0]
    for m in ms[1:]:
        out = (out[:, :, None] + m[None, :-1, :]).max(axis=1)
    return out


def _ends(ms: list[np.ndarray], entry: int, last: int) -> list[tuple[int, int]]:
    """(state before, last state) of each of some matrices in a row."""
    best, back = ms[0][entry], []
    for m in ms[1:]:
        via = best[:, None] + m[:-1]
        back.append(via.argmax(axis=0))
        best = via.max(axis=0)
    path = [last if last >= 0 else int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    return list(zip([entry, *path[:-1]], path))


_SEGMENTS = "conv_id long, part int, chunk int, turns array<long>, roles array<string>, obs array<array<int>>, texts array<string>"


def segments(turns: DataFrame) -> DataFrame:
    """Segments of the sorted conversations, one row each."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                        F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("rid"))
    rows = staged(rows, "turns")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.xxhash64("text"), F.col("rid")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, chunk, held, size = TaskContext.get().partitionId(), 0, [], 0

        ready: list[tuple] = []
        waiting = 0

        def segment():
            ready.append((None if held[0][0] else held[0][1], part, chunk, [h[2] for h in held], [h[3] for h in held],
                          [observe(h[4]) for h in held], [h[4] for h in held]))

        def frame():
            out = pd.DataFrame(ready, columns=["conv_id", "part", "chunk", "turns", "roles", "obs", "texts"]).astype({"conv_id": "Int64"})
            ready.clear()
            return out

        for b in batches:
            for null, conv, no_turn, turn, role, text in zip(b["no_conv"], b["conv_id"], b["no_turn"], b["turn"], b["role"], b["text"]):
                if held and (held[0][:2] != (null, conv) or len(held) >= SEGMENT or size > SEGMENT_CHARS):
                    segment()
                    chunk, held, size, waiting = chunk + 1, [], 0, waiting + size
                    if waiting > SEGMENT_CHARS or len(ready) >= 2000:
                        yield frame()
                        waiting = 0
                held.append((null, conv, None if no_turn else turn, role, text))
                size += len(text or "")
        if held:
            segment()
        if ready:
            yield frame()

    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select(F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.col("turn").isNull().alias("no_turn"),
                       F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text")
    return staged(rows.mapInPandas(cut, _SEGMENTS), "segments")


def _placed(segs: DataFrame) -> DataFrame:
    """``segs`` with ``pos``, a segment's place in its conversation, and ``n``, the number
    of these. A part holds a conversation's segments one after the other, so counts by
    part, one row each, give the place; no task sees all segments of a conversation."""
    parts = segs.groupBy("conv_id", "part").agg(F.min("chunk").alias("c0"), F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("conv_id")
    parts = parts.withColumn("off", F.sum("k").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).withColumn("n", F.sum("k").over(w))
    parts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "c0", F.coalesce("off", F.lit(0)).alias("off"), "n")
    placed = segs.join(parts, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")))
    return placed.select(*segs.columns, (F.col("off") + F.col("chunk") - F.col("c0")).alias("pos"), "n")


def train(segs: DataFrame) -> Model:
    fold = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 5 != 0, F.lit(True))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for roles, obs in zip(b["roles"], b["obs"]):
                roles = list(roles)
                for r, o in zip(roles, obs):
                    if r is not None:
                        c.update(("e", r, str(f), str(v)) for f, v in enumerate(o))
                c.update(("t", r, s, "") for r, s in zip(roles, roles[1:]) if r is not None and s is not None)
            yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["k", "a", "b", "c", "n"])

    counts = segs.where(fold).select("roles", "obs").mapInPandas(count, "k string, a string, b string, c string, n long")
    # what meets between two segments of a conversation, and its first block: one row a segment
    ends = segs.where(fold).select("conv_id", "part", "chunk", F.element_at("roles", 1).alias("first"), F.element_at("roles", -1).alias("last"))
    ends = _placed(ends)
    before = ends.select(F.col("conv_id").alias("c"), (F.col("pos") + 1).alias("q"), F.col("last").alias("before"))
    ends = ends.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("q")), "left")
    met = ends.select(F.when(F.col("pos") == 0, "i").otherwise("t").alias("k"), F.when(F.col("pos") == 0, F.col("first")).otherwise(F.col("before")).alias("a"),
                      F.when(F.col("pos") == 0, "").otherwise(F.col("first")).alias("b"), F.lit("").alias("c")).where("a is not null and b is not null")
    met = met.groupBy("k", "a", "b", "c").agg(F.count(F.lit(1)).alias("n"))
    total: Counter = Counter()
    for r in counts.unionByName(met).groupBy("k", "a", "b", "c").agg(F.sum("n").alias("n")).collect():  # roles x features x values
        key = {"e": lambda r: ("e", r["a"], int(r["b"]), int(r["c"])), "t": lambda r: ("t", r["a"], r["b"]), "i": lambda r: ("i", r["a"])}[r["k"]](r)
        total[key] += r["n"]
    return Model(total)


def segment_ends(segs: DataFrame, model: Model) -> DataFrame:
    """(conv_id, part, chunk, entry, last): the states around each segment."""
    start, n = len(model.roles), len(model.roles)

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["conv_id", "part", "chunk"]].assign(m=[model.matrix(o).ravel().tolist() for o in b["obs"]]).astype({"conv_id": "Int64"})

    level = segs.select("conv_id", "part", "chunk", "obs").mapInPandas(matrices, "conv_id long, part int, chunk int, m array<double>")
    places = _placed(segs.select("conv_id", "part", "chunk")).select(F.col("part").alias("p"), F.col("chunk").alias("h"), "pos", "n")
    level = level.join(places, (F.col("part") == F.col("p")) & (F.col("chunk") == F.col("h"))).drop("p", "h")
    level = staged(level, "segment-scores")
    # a conversation of one segment needs no combining
    alone = level.where("n = 1").select("part", "chunk", F.lit(start).alias("entry"), F.lit(-1).alias("last"))
    levels = [level.where("n > 1")]
    shape = (n + 1, n)

    def up(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out = pd.DataFrame({"conv_id": [key[0]], "pos": [key[1]], "m": [_combine([np.reshape(m, shape) for m in pdf["m"]]).ravel().tolist()]})
        return out.astype({"conv_id": "Int64"})

    while (levels[-1].agg(F.max("pos")).first()[0] or 0) > 0:
        grouped = levels[-1].select("conv_id", "pos", "m", F.floor(F.col("pos") / SEGMENT).alias("grp"))
        levels.append(staged(grouped.groupBy("conv_id", "grp").applyInPandas(up, "conv_id long, pos long, m array<double>"), "segment-scores"))
    # top: one matrix a conversation
    ends = levels[-1].select("conv_id", "pos", F.lit(start).alias("entry"), F.lit(-1).alias("last"))

    def down(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        got = _ends([np.reshape(m, shape) for m in pdf["m"]], int(pdf["entry"].iloc[0]), int(pdf["last"].iloc[0]))
        return pdf[["conv_id", "pos"]].assign(entry=[e for e, _ in got], last=[x for _, x in got]).astype({"conv_id": "Int64"})

    for level in reversed(levels[:-1]):
        parents = ends.select(F.col("conv_id").alias("c"), F.col("pos").alias("grp"), "entry", "last")
        grouped = level.select("conv_id", "pos", "m", F.floor(F.col("pos") / SEGMENT).alias("grp"))
        joined = grouped.join(parents, F.col("conv_id").eqNullSafe(F.col("c")) & (grouped["grp"] == parents["grp"])).select("conv_id", "pos", "m", grouped["grp"], "entry", "last")
        ends = joined.groupBy("conv_id", "grp").applyInPandas(down, "conv_id long, pos long, entry int, last int")
    ends = ends.select(F.col("conv_id").alias("c"), F.col("pos").alias("p"), "entry", "last")
    together = levels[0].join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")))
    return together.select("part", "chunk", "entry", "last").unionByName(alone)


def recover_roles(turns: DataFrame, model: Model | None = None) -> DataFrame:
    """conv_id, turn, held_out, role_pred, rendered of every block."""
    segs = segments(turns)
    model = model or train(segs)
    ends = segment_ends(segs, model)
    # part and chunk number a segment on their own

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for conv, turns_, obs, texts, entry, last in zip(b["conv_id"].astype("Int64"), b["turns"], b["obs"], b["texts"], b["entry"], b["last"]):
                for s, turn, text in zip(model.decode(obs, int(entry), int(last)), turns_, texts):
                    rows.append((conv, None if turn is None or turn != turn else int(turn), model.roles[s], render(model.roles[s], text)))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=["conv_id", "turn", "role_pred", "rendered"]).astype({"conv_id": "Int64", "turn": "Int64"})
                    rows = []
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "role_pred", "rendered"]).astype({"conv_id": "Int64", "turn": "Int64"})

    out = segs.join(ends, ["part", "chunk"]).select("conv_id", "turns", "obs", "texts", "entry", "last")
    out = out.mapInPandas(decode, "conv_id long, turn long, role_pred string, rendered string")
    held = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("conv_id", "turn", held.alias("held_out"), "role_pred", "rendered")


def op6_chat(spark, sf_dir) -> DataFrame:
    return recover_roles(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
