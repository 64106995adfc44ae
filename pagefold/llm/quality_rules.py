"""Quality rules with risk-controlled thresholds.

Counts of a whole text feed a few ratios (symbols per word, share of repeated lines, share
of words in repeated 5-word windows, share of capitals, share of distinct words, mean word
length on both sides). Each rule rejects on one side of a cutoff. Cutoffs are not set by
hand: for every stratum and rule the cutoffs of a fixed grid are tested from the lenient to
the strict end on labelled documents - the hypothesis that more than ``risk`` / rules of the
good documents would be rejected must be refuted by the exact binomial tail at level
``delta`` / (rules * strata). The first cutoff that fails ends its sequence, so testing many
cutoffs costs no level (fixed-sequence testing); rules and strata are corrected for by
Bonferroni. With probability 1 - delta, no stratum loses more than ``risk`` of its good
documents to the rules. Among the cutoffs that passed, a rule takes the one that rejects the
most bad documents for the fewest good ones, the most lenient of equals. A stratum with too
few labels proves nothing and rejects nothing.

Everything is counted over all documents and all labels of the fold; cutoffs are chosen from
grid counts per stratum, a group of bounded size.

Defined results: null and empty texts have zero counts and fail the base rule; a null
stratum is a stratum of its own; unlabelled rows and null labels teach nothing; repeated
labels of one id count once (good if any says so); rows that repeat an id are judged each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagefold.llm import words as W

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_distinct")
#: Rule: (ratio as SQL, grid from lenient to strict). A value beyond the cutoff is rejected; for ``low`` rules the
#: ratio is negated, so that one comparison serves all.
RULES = {
    "symbols": ("n_symbols / n_words", [2.0 * 0.8 ** i for i in range(24)]),
    "dup_lines": ("n_dup_lines / n_lines", [0.95 - 0.05 * i for i in range(18)]),
    "repeats": ("n_repeat_words / n_words", [0.98 - 0.04 * i for i in range(24)]),
    "capitals": ("n_capitals / word_chars", [0.9 - 0.05 * i for i in range(17)]),
    "few_distinct": ("-n_distinct / n_words", [-0.02 - 0.02 * i for i in range(35)]),
    "long_words": ("word_chars / n_words", [30 * 0.95 ** i for i in range(40)]),
    "short_words": ("-word_chars / n_words", [-1.0 - 0.1 * i for i in range(40)]),
}
RISK, DELTA = 0.05, 0.05
#: The base rule: too short, or a fifth of it repeated.
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def _repeated(h: np.ndarray, doc: np.ndarray, offs: np.ndarray, k: int = 5) -> np.ndarray:
    """Words of each document inside a k-word window that the document holds twice or more."""
    full = W.window_hashes(h, k)
    m = len(full)
    if not m:
        return np.zeros(len(offs) - 1, np.int64)
    at = np.flatnonzero(doc[:m] == doc[k - 1:k - 1 + m])
    key = W.mix(full[at] ^ W.mix(doc[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    twin = np.zeros(len(s) + 1, bool)
    twin[1:-1] = s[1:] == s[:-1]
    hit = at[order[twin[1:] | twin[:-1]]]
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + k, -1)
    run = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return run[offs[1:]] - run[offs[:-1]]


def text_counts(texts) -> dict[str, np.ndarray]:
    """COUNTS of every text."""
    rule = W.space_rule()
    h, offs = W.hashed_words(texts, rule, W.byte_values(lower=False))
    doc = W.in_document(offs, len(h))
    buf, cuts = W.text_buffer(texts)
    symbols, capitals = np.zeros(256, bool), np.zeros(256, bool)
    symbols[[ord(c) for c in "#*$%&|<>"]] = True
    capitals[0x41:0x5B] = True
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[cuts])
    one = W.mix(h ^ W.mix(doc.astype(np.uint64)))
    own, first = np.unique(one, return_index=True)
    lines, dups = [], []
    for t in texts:
        held = [x for x in (t.as_py() or "").split("\n") if x.strip(" \t\n\v\f\r")]
        lines.append(len(held))
        dups.append(len(held) - len(set(held)))
    return {"n_words": np.diff(offs), "word_chars": count(rule[buf] & ((buf & 0xC0) != 0x80)), "n_symbols": count(symbols[buf]),
            "n_dup_lines": np.array(dups, np.int64), "n_repeat_words": _repeated(h, doc, offs), "n_lines": np.array(lines, np.int64),
            "n_capitals": count(capitals[buf]), "n_distinct": np.bincount(doc[first], minlength=len(offs) - 1).astype(np.int64)}


def with_counts(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``df`` with COUNTS, whatever was named like them before."""
    keep = [c for c in (keep or df.columns) if c not in COUNTS]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            _, offs = W.text_buffer(batch.column(batch.schema.get_field_index(text_col)))
            i = 0
            while i < batch.num_rows:  # some megabytes of text at a time
                j = min(max(i + 1, int(np.searchsorted(offs, offs[i] + (4 << 20), "right")) - 1), batch.num_rows)
                part = batch.slice(i, j - i)
                got = text_counts(part.column(part.schema.get_field_index(text_col)))
                cols = [part.column(part.schema.get_field_index(c)) for c in keep] + [pa.array(got[c]) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)
                i = j
    return df.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= x), exactly."""
    if x >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
            for i in range(x + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(v - top) for v in logs))


def select_cutoff(grid: list[float], good: list[int], bad: list[int], n_good: int, risk: float, level: float) -> float | None:
    """``good`` and ``bad``: rejected documents at each cutoff, from the lenient end on."""
    best, most = None, 0
    for cutoff, g, b in zip(grid, good, bad):
        if binomial_tail(g, n_good, risk) > level:
            break
        if b - g > most:
            best, most = cutoff, b - g
    return best


def _value(rule: str) -> Column:
    top, bottom = RULES[rule][0].split(" / ")
    return F.expr(f"CASE WHEN {bottom} > 0 THEN {top} / {bottom} END")


def _passes(rule: str) -> Column:
    value = _value(rule)
    grid = F.array(*[F.lit(float(c)) for c in RULES[rule][1]])
    return F.size(F.filter(grid, lambda c: value.isNull() | (value <= c)))


def calibrate(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", label_col: str = "quality",
              learn_from: Column | None = None, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, none, rule, cutoff): the rules in force, ``none`` for the null stratum. ``counted`` has COUNTS, the
    id and the stratum; it is read twice."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if learn_from is not None:
        usable = usable.where(learn_from)
    usable = usable.groupBy(id_col).agg((F.max(label_col) > 0).alias("_good"))
    held = (counted.where(f"NOT ({BASE_FAILED})").join(usable, id_col)
            .select(F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
                    F.col(stratum_col).isNull().alias("none"), "_good",
                    F.array(*[F.struct(F.lit(r).alias("rule"),
                                       # number of grid cutoffs that the value is not beyond, from the lenient end
                                       _passes(r).alias("passes")) for r in RULES]).alias("rules")))
    counts = (held.select("stratum", "none", "_good", F.explode("rules").alias("r"))
              .groupBy("stratum", "none", "r.rule", "r.passes").agg(F.sum(F.col("_good").cast("long")).alias("good"),
                                                                    F.sum((~F.col("_good")).cast("long")).alias("bad")))
    strata = held.select("stratum", "none").distinct().count()

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rule = pdf["rule"].iloc[0]
        grid = RULES[rule][1]
        good, bad = np.zeros(len(grid) + 1, int), np.zeros(len(grid) + 1, int)
        np.add.at(good, pdf["passes"], pdf["good"])
        np.add.at(bad, pdf["passes"], pdf["bad"])
        level = delta / (len(RULES) * max(1, strata))
        # a document that passes p cutoffs is rejected by all cutoffs after those
        cutoff = select_cutoff(grid, np.cumsum(good)[:-1].tolist(), np.cumsum(bad)[:-1].tolist(), int(good.sum()),
                               risk / len(RULES), level) if good.sum() else None
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "none": [pdf["none"].iloc[0]], "rule": [rule], "cutoff": [cutoff]})
    picked = counts.groupBy("stratum", "none", "rule").applyInPandas(pick, "stratum string, none boolean, rule string, cutoff double")
    return picked.where("cutoff IS NOT NULL")


def judge(counted: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """``counted`` with ``base_failed`` and ``kept``."""
    table = cutoffs.groupBy("stratum", "none").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES])
    rows = counted.drop("base_failed", "kept").withColumn("base_failed", F.expr(BASE_FAILED))
    joined = rows.join(table, F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).eqNullSafe(table["stratum"])
                       & (F.col(stratum_col).isNull() == table["none"]), "left")
    beyond = [F.coalesce(_value(r) > F.col(f"_{r}"), F.lit(False)) for r in RULES]
    any_rule = beyond[0]
    for b in beyond[1:]:
        any_rule = any_rule | b
    return joined.withColumn("kept", ~F.col("base_failed") & ~any_rule).select(*rows.columns, "kept")
