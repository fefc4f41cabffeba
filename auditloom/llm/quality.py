"""Quality rules: a decision list learned from labelled statistics, applied as an ordered conditional expression.

`text_stats` counts over whole texts in numpy, a slice of a batch at a time. `learn_rules` is sequential covering: each
rule is grown on two thirds of the labelled rows, condition by condition, by FOIL's gain, pruned on the other third, and
kept only if it is precise there; the rows that it covers leave, and the next rule is learned. The list rejects what its
rules cover and keeps the rest. `verdict` writes the list as one ordered Spark `when` chain, so scoring is JVM code.

Defined results: a null text counts as empty (all counts 0, base_failed, not kept); an empty table gives an empty table;
without labelled rows the list is empty and only the base rules reject; repeated rows are scored each on its own; very long texts
are counted whole, one at a time; further columns are ignored, and `keep_good` hands them on untouched whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import WorkDir, column, row_struct, slices, table, text_bytes

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_lines")
WINDOW = 8
_SYMBOL, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK[list(b"!?.,;:")] = True


def _stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    words, start, end, row = K.word_hashes(data, offsets)
    inside = ~K.SPACE[data]
    out = {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": K.per_row(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": K.per_row(_SYMBOL[data], offsets),
        "n_upper": K.per_row((data >= 65) & (data <= 90), offsets),
        "n_marks": K.per_row(_MARK[data], offsets),
        "n_digits": K.per_row((data >= 48) & (data <= 57), offsets),
        "n_repeat_words": repeated_words(words, row, n),
    }
    out["n_dup_lines"], out["n_lines"] = _lines(data, offsets)
    return out


def repeated_words(words: np.ndarray, row: np.ndarray, n: int, size: int = WINDOW) -> np.ndarray:
    """Words that lie in a window of `size` words found twice or more in their row."""
    grams, at = K.ngram_hashes(words, row, size)
    if not len(at):
        return np.zeros(n, np.int64)
    key = K.mix(grams + row[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + size, -1)
    return np.bincount(row, weights=np.cumsum(edge[:-1]) > 0, minlength=n).astype(np.int64)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dup, count = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        count[i], dup[i] = len(lines), len(lines) - len(set(lines))
    return dup, count


def _stats_batches(batches):
    for batch in batches:
        data, offsets = text_bytes(column(batch, "text"))
        for i, j, part, at in slices(data, offsets):
            got = _stats(part, at)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(i, j - i), *(pa.array(got[k].astype(np.int64)) for k in STATS)], ["doc_id", *STATS])


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row's whole text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stats_batches, "doc_id long, " + ", ".join(f"{k} long" for k in STATS))


def with_stats(docs: DataFrame) -> DataFrame:
    """row (every column of the input) and the statistics of its text."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(column(batch, "text"))
            for i, j, part, at in slices(data, offsets):
                got = _stats(part, at)
                yield pa.RecordBatch.from_arrays([column(batch, "row").slice(i, j - i), *(pa.array(got[k].astype(np.int64)) for k in STATS)], ["row", *STATS])

    rows = docs.select(row_struct(docs).alias("row"), F.col("text").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *(T.StructField(k, T.LongType()) for k in STATS)]))


def base_failed() -> Column:
    words, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (words < 20) | (100 * repeated > 30 * words)


def features() -> dict[str, Column]:
    """Ratios that conditions may test; all defined for empty texts."""
    c = {k: F.col(k) for k in STATS}
    words, chars, lines = (F.greatest(c[k], F.lit(1)) for k in ("n_words", "word_chars", "n_lines"))
    return {
        "n_words": c["n_words"].cast("double"),
        "word_len": c["word_chars"] / words,
        "symbols_per_word": c["n_symbols"] / words,
        "dup_line_share": c["n_dup_lines"] / lines,
        "repeat_share": c["n_repeat_words"] / words,
        "upper_share": c["n_upper"] / chars,
        "marks_per_word": c["n_marks"] / words,
        "digit_share": c["n_digits"] / chars,
        "words_per_line": c["n_words"] / lines,
    }


@dataclass
class Rule:
    """A conjunction of (feature, ">=" or "<=", threshold), with what it covered when it was judged."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)
    hits: int = 0
    errors: int = 0

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, t in self.conditions:
            out &= x[name] >= t if op == ">=" else x[name] <= t
        return out

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, t in self.conditions:
            out = out & (of[name] >= t if op == ">=" else of[name] <= t)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {t:.6g}" for n, op, t in self.conditions) or "true"


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, tuple[str, str, float]] | None:
    """The condition with the largest FOIL gain over the rows inside."""
    p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
    if not p0 or not n0:
        return None
    was, best = np.log2(p0 / (p0 + n0)), None
    for name in sorted(x):
        v, y = x[name][inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1  # a new value starts here
        if not len(cut):
            continue
        below = np.concatenate([[0], np.cumsum(y)])
        for op in (">=", "<="):
            p = (p0 - below[cut]) if op == ">=" else below[cut]
            total = (len(v) - cut) if op == ">=" else cut
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / total) - was), -1.0)
            i = int(np.argmax(gain))
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0] + 1e-12):
                best = (float(gain[i]), (name, op, float((v[cut[i]] + v[cut[i] - 1]) / 2)))
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, max_rules: int = 32, max_conditions: int = 4, min_precision: float = 0.9, min_hits: int = 2) -> list[Rule]:
    """Ordered rules that cover bad rows. fold: 0 or 1 to grow on, 2 to prune and judge on."""
    left, rules = np.ones(len(bad), bool), []
    grow, judge = fold < 2, fold >= 2
    while len(rules) < max_rules and (bad & left & grow).sum() >= min_hits:
        rule, inside = Rule(), left & grow
        while len(rule.conditions) < max_conditions and (got := _best_condition(x, bad, inside)):
            rule.conditions.append(got[1])
            inside = left & grow & rule.covers(x)
        worth = lambda r: (lambda c: (float((bad & c).sum()) - float((~bad & c).sum())) / max(1, c.sum()))(left & judge & r.covers(x))
        cuts = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
        if not cuts:
            break
        rule = max(cuts, key=lambda r: (worth(r), -len(r.conditions)))
        seen, all_seen = left & judge & rule.covers(x), left & rule.covers(x)
        rule.hits, rule.errors = int((bad & all_seen).sum()), int((~bad & all_seen).sum())
        precise = (bad & seen).sum() >= min_precision * max(1, seen.sum()) and rule.hits >= min_precision * (rule.hits + rule.errors)
        if not rule.hits or not precise:
            break
        rules.append(rule)
        left &= ~rule.covers(x)
    return rules


def verdict(rules: list[Rule], of: dict[str, Column]) -> Column:
    """Number of the first rule that covers a row, -1 if none does."""
    out = None
    for i, rule in enumerate(rules):
        out = F.when(rule.column(of), F.lit(i)) if out is None else out.when(rule.column(of), F.lit(i))
    return F.lit(-1) if out is None else out.otherwise(F.lit(-1))


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = 20_000, **kw) -> list[Rule]:
    """Learn from at most `max_rows` labelled rows, those with the smallest hash of doc_id."""
    one = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    of = features()
    known = stats.join(one, "doc_id").where(~base_failed()).select("doc_id", "quality", *(c.alias(k) for k, c in of.items())).withColumn("_hash", F.xxhash64("doc_id"))
    # hashes are even, so the smallest lie below twice their share: tasks send the driver no more than that, however many they are
    n = known.count()
    if n > max_rows:
        known = known.where(F.col("_hash") < F.lit(int(-(2**63) + min(1.0, 2 * max_rows / n) * (2**64 - 1)) if 2 * max_rows < n else 2**63 - 1))
    rows = known.orderBy("_hash", "doc_id", *of).limit(max_rows).drop("_hash").toPandas()
    if not len(rows):
        return []
    fold = (K.mix(rows["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(3)).astype(int)
    return learn_rules({k: rows[k].to_numpy(float) for k in of}, rows["quality"].to_numpy() == 0, fold, **kw)


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """doc_id, the statistics, base_failed, kept, and the number of the rule that rejected the row (-1: none)."""
    work = WorkDir(docs.sparkSession, "quality")
    stats = work.cut(text_stats(docs), "stats")
    rules = fit(stats, labels, max_rows)
    failed, rule = base_failed(), verdict(rules, features())
    return stats.withColumn("base_failed", failed).withColumn("rule", F.when(failed, -1).otherwise(rule)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") < 0))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that the base or the learned rules reject go, the others stay as they are, whatever the names of their
    columns. Null and empty texts go; repeated rows are judged each on its own; an empty table stays empty. Texts are read
    once: rows and statistics are written together, and the list learned from them is applied to that table."""
    work = WorkDir(spark, "quality-stage")
    marked = work.cut(with_stats(docs), "marked")
    rules = fit(marked.select(F.col("row.doc_id").cast("long").alias("doc_id"), *STATS), table(spark, sf_dir, "labels"))
    return marked.where(~base_failed() & (verdict(rules, features()) < 0)).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
