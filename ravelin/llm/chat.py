"""Chat formatting with minimum-cost role repair.

A legal conversation is a path through a small automaton: an optional system
turn, then user and assistant turns by turns, the first from the user. Each turn
of a conversation may

* stay or be relabelled (cost RELABEL; unknown roles cost UNKNOWN to name),
* merge into the turn before it, which must have its role after relabelling
  (cost MERGE), and
* have an empty turn of the missing role inserted before it (cost INSERT).

Dynamic programming over the automaton finds the cheapest repair. Costs of turns
are (min, +) matrices over its states, and those of a stretch of turns are their
product. So a conversation is cut into blocks of BLOCK turns: blocks give their
matrices independently, a conversation's matrices (one a block) are chained, and
each block then traces its own turns back. No task needs a whole conversation.

The result has a row per given turn with its rendered piece; the pieces of a
conversation in order of `turn` make its text. Among equally cheap repairs the
one with the smaller state (system, user, assistant), then keep before merge
before insertion, is taken. Turns are ordered by (turn, role, text); null turns
come first, null roles are unknown, null texts are empty, repeated rows are
turns of their own, and conversations without an id are one. An empty table
gives an empty table. Columns besides the four named ones stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ROLES = ("system", "user", "assistant")
RELABEL, UNKNOWN, MERGE, INSERT = 4.0, 2.0, 1.0, 3.0
BLOCK = 256
INF = 1e18
# States: 0 nothing yet, then after a system, user or assistant turn.
_LEGAL = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
# The pieces of the rendered form.
OPEN, CLOSE = "<|im_start|>{role}\n", "<|im_end|>\n"


def naming(role: str | None, state: int) -> float:
    """Cost of giving a turn the role of a state."""
    r = (role or "").strip().lower()
    return 0.0 if r == ROLES[state - 1] else RELABEL if r in ROLES else UNKNOWN


def steps() -> list[list[tuple[float, str, int]]]:
    """For each pair of states the cheapest way over one turn: (cost without naming, action, inserted state)."""
    out = []
    for a in range(4):
        row = []
        for b in range(4):
            ways = []
            if b and (a, b) in _LEGAL:
                ways.append((0.0, "keep", 0))
            if b and a == b:
                ways.append((MERGE, "merge", 0))
            ways += [(INSERT, "insert", m) for m in (1, 2, 3) if b and (a, m) in _LEGAL and (m, b) in _LEGAL]
            row.append(min(ways, key=lambda w: (w[0], ("keep", "merge", "insert").index(w[1]), w[2])) if ways else (INF, "", 0))
        out.append(row)
    return out


_STEPS = steps()


def turn_matrix(role: str | None) -> np.ndarray:
    m = np.full((4, 4), INF)
    for a in range(4):
        for b in range(1, 4):
            if _STEPS[a][b][0] < INF:
                m[a, b] = _STEPS[a][b][0] + naming(role, b)
    return m


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), INF)


def block_matrix(roles: list[str | None]) -> np.ndarray:
    m = np.where(np.eye(4) > 0, 0.0, INF)
    for r in roles:
        m = chain(m, turn_matrix(r))
    return m


def trace(roles: list[str | None], start: int, end: int) -> list[tuple[int, str, int]]:
    """(state, action, inserted state) of each turn on the cheapest path from start to end."""
    best = np.full(4, INF)
    best[start] = 0
    back = []
    for r in roles:
        cost = best[:, None] + turn_matrix(r)
        back.append(cost.argmin(0))
        best = np.minimum(cost.min(0), INF)
    out, b = [], end
    for prev in reversed(back):
        a = int(prev[b])
        out.append((b, *_STEPS[a][b][1:]))
        b = a
    return out[::-1]


def format_chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, ord, role_given, role, action, inserted, cost, rendered) per given turn.

    `ord` counts the turns of a block; `cost` is the turn's share of the repair.
    """
    scratch = Scratch(turns.sparkSession)
    src = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    base = src.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK).cast("long"))
    # many rows of one block share turns: they are dealt further by the turn itself
    sized = base.groupBy("conv_id", "block").agg(F.count("*").alias("c"))
    null_safe = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    b2 = base.join(sized, null_safe(base, sized) & (base["block"] == sized["block"])).select(base["*"], "c")
    key = F.struct(F.coalesce("conv_id", F.lit(-(1 << 62))).alias("c"), F.col("block").alias("b"), F.when(F.col("c") > 8 * BLOCK, F.coalesce("turn", F.lit(-(1 << 62)))).otherwise(F.lit(-(1 << 62))).alias("t"))
    keyed = b2.select(key.alias("key"), "conv_id", "turn", "role", "text").select("key.c", "key.b", "key.t", "conv_id", "turn", "role", "text")
    dealt = keyed.repartition("c", "b", "t").sortWithinPartitions("c", "b", "t", "turn", "role", "text")

    def groups(batches, columns):
        """Rows of one block after the other."""
        last, rows = None, []
        for batch in batches:
            for r in zip(*(batch.column(x).to_pylist() for x in columns), strict=True):
                if r[:3] != last:
                    if rows:
                        yield last, rows
                    last, rows = r[:3], []
                rows.append(r[3:])
        if rows:
            yield last, rows

    def matrices(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
        rows = []
        for k, got in groups(batches, ("c", "b", "t", "role")):
            rows.append((*k, block_matrix([r[0] for r in got]).ravel().tolist()))
            if len(rows) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["c", "b", "t", "m"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["c", "b", "t", "m"])

    mats = scratch.keep(dealt.select("c", "b", "t", "role").mapInArrow(matrices, "c long, b long, t long, m array<double>"))
    ordered = mats.repartition("c").sortWithinPartitions("c", "b", "t")

    def borders(batches):
        out = []

        def close(c, rows):
            fore = np.full(4, INF)
            fore[0] = 0
            fores = [fore]
            for *_, m in rows:
                fores.append(np.minimum((fores[-1][:, None] + m).min(0), INF))
            end = int(fores[-1].argmin())
            ends = [end]
            for k in range(len(rows) - 1, -1, -1):
                ends.append(int((fores[k] + rows[k][2][:, ends[-1]]).argmin()))
            ends.reverse()
            out.extend((c, b, t, ends[k], ends[k + 1]) for k, (b, t, _) in enumerate(rows))

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(),) * 3 + (pa.int32(),) * 2, strict=True)], names=["c", "b", "t", "s0", "s1"])

        last, rows = None, []
        for batch in batches:
            for c, b, t, m in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if last is not None and c != last:
                    close(last, rows)
                    rows = []
                last = c
                rows.append((b, t, np.array(m).reshape(4, 4)))
                if len(out) >= 1000:
                    yield emit()
                    out.clear()
        if rows:
            close(last, rows)
        if out:
            yield emit()

    ends = ordered.mapInArrow(borders, "c long, b long, t long, s0 int, s1 int")
    final_block = mats.groupBy("c").agg(F.max(F.struct("b", "t")).alias("z")).select("c", F.col("z.b").alias("zb"), F.col("z.t").alias("zt"))
    plan = ends.join(final_block, "c").select("c", "b", "t", "s0", "s1", ((F.col("b") == F.col("zb")) & (F.col("t") == F.col("zt"))).alias("final"))
    work = keyed.join(plan, ["c", "b", "t"]).repartition("c", "b", "t").sortWithinPartitions("c", "b", "t", "turn", "role", "text")
    cols = ("c", "b", "t", "conv_id", "turn", "role", "text", "s0", "s1", "final")
    schema = "conv_id long, turn long, ord int, role_given string, role string, action string, inserted string, cost double, rendered string"
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4, pa.float64(), pa.string()]
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def render(batches):
        out = []
        for _, rows in groups(batches, cols):
            path = trace([r[2] for r in rows], rows[0][4], rows[0][5])
            state = rows[0][4]
            for k, ((conv, turn_, given, body, _, _, final), (to, action, ins)) in enumerate(zip(rows, path, strict=True)):
                piece = ""
                if action != "merge":
                    if state:
                        piece += CLOSE
                    if ins:
                        piece += OPEN.format(role=ROLES[ins - 1]) + CLOSE
                    piece += OPEN.format(role=ROLES[to - 1])
                else:
                    piece += "\n"
                piece += body or ""
                if final and k == len(rows) - 1:
                    piece += CLOSE
                out.append((conv, turn_, k, given, ROLES[to - 1], action, ROLES[ins - 1] if ins else None, _STEPS[state][to][0] + naming(given, to), piece))
                state = to
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return work.select(*cols).mapInArrow(render, schema)
