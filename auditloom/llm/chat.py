"""Chat formatting in budgeted windows.

1. Turns are counted in tokens as they will be formatted, and numbered within their conversation: ranges of (conv_id, turn) are
   sorted each on its own, and a conversation that runs over several gets the sum of the rows before as an offset.
2. A conversation is taken in segments of SEGMENT turns, so no task holds a long one; a window ends where a segment does, at
   every size. The last `history` turns go along to the next segment, a leading system turn to all.
3. In a segment, prefix sums of the turns' tokens choose the spans (`choose_spans`): one search finds how far back the repeated
   history reaches (at most `history` turns and a share of the budget), one how many new turns fit behind the system turn and
   that history. The system turn stands at the head of every window, and only assistant texts among the new turns are
   targets, so each assistant text is a target once.

Template: `<|turn:ROLE|>\\nTEXT<|end|>\\n`. Inside roles and texts a backslash is doubled and each control string gets a
backslash after its first character; `unescape` takes both back, so the format can be read back exactly.

Defined results: null text or role counts as empty; rows with a null conv_id form one conversation; equal (conv_id, turn)
rows are ordered by role and text, equal rows are turns each; a turn over the budget, however long, gets a window of its own,
behind the system turn alone (`over_budget`); an empty table has no windows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WorkDir, column, table
from .packing import VOCABULARY, encode

#: Turns from which a conversation goes on in another segment.
SEGMENT = 256
#: Control strings of common chat templates, and the opening of this one's marks.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, (*CONTROL, "\\"))))
_IN_ROLE = re.compile(_CONTROL.pattern + r"|\|")
_TURN = re.compile(r"<\|turn:((?:[^\\|]|\\.)*)\|>\n(.*?)<\|end\|>\n", re.S)

WINDOWS = "conv_id long, window long, n_repeated int, n_turns int, n_tokens long, over_budget boolean, loss array<struct<start:int,end:int>>, text string"


def escape(text: str, what: re.Pattern = _CONTROL) -> str:
    return what.sub(lambda m: f"\\{m[0]}" if len(m[0]) == 1 else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    return len(encode(text, vocabulary))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and ends in it."""
    head, body = f"<|turn:{escape(role, _IN_ROLE)}|>\n", escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def choose_spans(tokens: np.ndarray, begin: int, system: int, own_system: bool, budget: int, history: int, history_share: float) -> Iterator[tuple[int, int, int]]:
    """(first repeated, first new, end) of each window over a segment's turns, the first `begin` of which are only repeated.
    system: tokens of the system turn, 0 if there is none; own_system: it is the first of the turns."""
    total = np.concatenate([[0], np.cumsum(tokens)])
    at = begin
    while at < len(tokens):
        room = budget - (0 if own_system and at == 0 else system)
        back = max(int(np.searchsorted(total, total[at] - budget * history_share)), at - history, int(own_system))
        back = min(back, at)
        end = int(np.searchsorted(total, total[back] + room, side="right")) - 1
        if end <= at:  # a long turn keeps the system turn alone
            back = at
            end = max(at + 1, int(np.searchsorted(total, total[at] + room, side="right")) - 1)
        yield back, at, end
        at = end


def number_turns(turns: DataFrame, count: Callable[[str], int], work: WorkDir) -> DataFrame:
    """A table of conv_id, part, k, role, text, n_tokens: place k within the conversation's turns of a part, parts in order."""
    kind = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("k", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n_tokens", pa.int64())])

    def run(batches):
        part, now, k = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            out = {"k": [], "n_tokens": []}
            convs, roles, texts = (column(batch, c) for c in ("conv_id", "role", "text"))
            for conv, role, text in zip(convs.to_pylist(), roles.to_pylist(), texts.to_pylist()):
                now, k = (conv,), k + 1 if now == (conv,) else 0
                out["k"].append(k)
                out["n_tokens"].append(count(format_turn(role, text)[0]))
            yield pa.RecordBatch.from_arrays([convs, pa.array([part] * batch.num_rows, pa.int32()), pa.array(out["k"], pa.int64()), roles, texts, pa.array(out["n_tokens"], pa.int64())], schema=kind)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    ordered = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return work.cut(ordered.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, part int, k long, role string, text string, n_tokens long"), "turns")


def _segments(turns: DataFrame, history: int, segment: int, work: WorkDir) -> DataFrame:
    """conv_id, seg, place, role, text, n_tokens: the turns of each segment, and those that are repeated in it."""
    counts = work.cut(turns.groupBy("conv_id", "part").agg(F.count("*").alias("n")), "counts")
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # at most one conversation of each part began in an earlier one
    offsets = work.cut(counts.withColumn("offset", before).where("offset > 0").select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "offset"), "offsets")
    here = F.col("conv_id").eqNullSafe(F.col("_conv"))
    placed = turns.join(F.broadcast(offsets), here & (F.col("part") == F.col("_part")), "left").withColumn("place", F.col("k") + F.coalesce("offset", F.lit(0)))
    placed = placed.select("conv_id", F.floor(F.col("place") / segment).cast("long").alias("seg"), "place", "role", "text", "n_tokens")
    long = work.cut(counts.groupBy("conv_id").agg(F.sum("n").alias("n")).where(F.col("n") > segment).select(F.col("conv_id").alias("_conv"), F.floor((F.col("n") - 1) / segment).cast("long").alias("last")), "long")
    carried = placed.where(F.col("place") % segment >= segment - history).withColumn("seg", F.col("seg") + 1)
    system = placed.where("place = 0 and role = 'system'").join(long.hint("merge"), here)
    system = system.select("conv_id", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("seg"), "place", "role", "text", "n_tokens")
    return placed.unionByName(carried).unionByName(system)


def format_windows(turns: DataFrame, budget: int = 512, history: int = 2, history_share: float = 0.25, count: Callable[[str], int] | None = None, vocabulary: str = VOCABULARY, segment: int = SEGMENT) -> DataFrame:
    """Windows of each conversation; `window` is the number of its first new turn. count: tokens of a formatted turn, picklable;
    by default those of the vocabulary."""
    if not 0 <= history < segment:
        raise ValueError(f"history must be at least 0 and below {segment}")
    work = WorkDir(turns.sparkSession, "chat")
    count = count or partial(count_tokens, vocabulary=vocabulary)
    kind = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n_repeated", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("text", pa.string())])

    def windows(conv, seg: int, rows: list[tuple]):
        """rows: place, role, text, n_tokens, in order."""
        system = rows[0] if rows[0][0] == 0 and rows[0][1] == "system" else None
        if system and seg:
            rows = rows[1:]
        begin = sum(1 for r in rows if r[0] < seg * segment)
        tokens = np.array([r[3] for r in rows], np.int64)
        for back, at, end in choose_spans(tokens, begin, system[3] if system else 0, bool(system) and not seg, budget, history, history_share):
            repeated = ([system] if system and (seg or at) else []) + rows[back:at]
            parts, loss, size = [], [], 0
            for k, (_, role, text, _) in enumerate([*repeated, *rows[at:end]]):
                formatted, a, b = format_turn(role, text)
                if role == "assistant" and k >= len(repeated):
                    loss.append({"start": size + a, "end": size + b})
                parts.append(formatted)
                size += len(formatted)
            n = sum(r[3] for r in repeated) + int(tokens[at:end].sum())
            yield {"conv_id": conv, "window": rows[at][0], "n_repeated": len(repeated), "n_turns": end - at, "n_tokens": n, "over_budget": n > budget, "loss": loss, "text": "".join(parts)}

    def run(batches):
        now, held, out, size = None, [], [], 0
        for batch in batches:
            for conv, seg, *row in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "seg", "place", "role", "text", "n_tokens"))):
                if now != (conv, seg):
                    if held and held[-1][0] >= now[1] * segment:  # else turns were carried beyond the last
                        out.extend(windows(*now, held))
                    now, held = (conv, seg), []
                held.append(tuple(row))
                size += len(row[2])
                if len(out) >= 1000 or size > 2_000_000 and out:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out, size = [], 0
        if held and held[-1][0] >= now[1] * segment:
            out.extend(windows(*now, held))
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    rows = _segments(number_turns(turns, count, work), history, segment, work)
    return rows.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "place").mapInArrow(run, WINDOWS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(windows: DataFrame) -> DataFrame:
    """One row for each conversation, read from its formatted windows alone. A digest over a conversation is one stream, so its
    windows pass one task in order; nothing of them is held."""

    def run(batches):
        state, out = None, {k.split()[0]: [] for k in DIGEST.split(", ")}

        def flush():
            conv, n, turns, chars, loss, formatted, w = state
            for k, v in zip(out, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, w)):
                out[k].append(v)

        for batch in batches:
            for conv, repeated, loss, text in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "n_repeated", "loss", "text"))):
                if state is None or state[0] != conv:
                    if state:
                        flush()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in read_turns(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
                state[6] += 1
        if state:
            flush()
        kinds = [pa.string() if "string" in k else pa.int64() for k in DIGEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.select("conv_id", "n_repeated", "loss", "text").mapInArrow(run, DIGEST)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) as conv_id", "cast(turn as long) as turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    return read_back(format_windows(turns.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema))))
