"""How distinctive a term is of its record (problem 4): hypergeometric enrichment.

A record with ``n`` occurrences of terms is a draw without replacement from the ``N`` occurrences of the whole
collection, ``K`` of them of the term. The probability of seeing the term ``k`` times or more is computed exactly from
log-gamma values, and adjusted for the false discovery rate over all (record, term) pairs. The score is the negative
logarithm of the adjusted probability.

Probabilities depend on ``(k, K, n)`` alone, of which there are far fewer than pairs: they are computed and ranked once
for each such combination, with the number of its pairs as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions.text import words
from foliospark.sources.tables import stage

#: Slots for each unit of log(1 - log p) in which ranks are counted; each slot is ordered by itself, in parallel.
SLOTS_PER_UNIT = 4096

_ROWS = 4_096  # records counted at a time

#: Coefficients of the Stirling series of log-gamma: 1/12, -1/360, 1/1260, -1/1680, 1/1188.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of gamma for x > 0: raised to 8 or more by the recurrence, then the Stirling series."""
    x = np.array(x, dtype=np.float64)
    shift = np.zeros_like(x)
    while (low := x < 8).any():
        shift[low] -= np.log(x[low])
        x[low] += 1
    series, power = np.zeros_like(x), 1 / x
    for c in STIRLING:
        series += c * power
        power /= x * x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series


def log_upper_tail(k: np.ndarray, n: np.ndarray, K: np.ndarray, N: np.ndarray) -> np.ndarray:
    """log P(X >= k) for X hypergeometric: n drawn from N of which K are of the term. Vectorised, exact term by term."""
    k, n, K, N = (np.array(v, dtype=np.float64) for v in (k, n, K, N))
    top, bottom = np.minimum(n, K), np.maximum(0, n + K - N)
    # Sum from k upward where the terms fall, else the terms below k, and take the complement.
    upward = k >= n * K / N
    at = np.where(upward, k, k - 1)
    sure, never = k <= bottom, k > top
    at = np.clip(at, bottom, top)

    def choose(a, b):
        return log_gamma(a + 1) - log_gamma(b + 1) - log_gamma(a - b + 1)

    first = choose(K, at) + choose(N - K, n - at) - choose(N, n)
    term, total, live = np.ones_like(k), np.ones_like(k), ~(sure | never)
    while live.any():
        x = at[live]
        up = upward[live]
        Kl, nl, Nl = K[live], n[live], N[live]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(up, (Kl - x) * (nl - x) / ((x + 1) * (Nl - Kl - nl + x + 1)), x * (Nl - Kl - nl + x) / ((Kl - x + 1) * (nl - x + 1)))
        ended = np.where(up, x >= top[live], x <= bottom[live])
        term[live] = np.where(ended, 0.0, term[live] * ratio)
        total[live] += term[live]
        at[live] += np.where(up, 1, -1)
        live[live] = term[live] > total[live] * 1e-17
    log_sum = np.minimum(first + np.log(total), 0.0)
    with np.errstate(divide="ignore"):
        out = np.where(upward, log_sum, np.log1p(-np.exp(np.minimum(log_sum, -1e-300))))
    return np.where(sure, 0.0, np.where(never, -np.inf, out))


def _log_p(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for k, n, K, N in parts:
        yield pd.Series(log_upper_tail(k, n, K, N))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``field, id, term, tf, n`` of records ``id, content, tags`` given as lists of terms; counted batch by batch."""
    for whole in batches:
        for lo in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(lo, _ROWS)
            for field in ("content", "tags"):
                lists = batch.column(field)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                sizes = np.diff(offsets)
                coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
                kinds = len(coded.dictionary)
                if not kinds:
                    continue
                owner = np.repeat(np.arange(batch.num_rows), sizes)
                pairs, tf = np.unique(owner * kinds + coded.indices.to_numpy(), return_counts=True)
                of = pairs // kinds
                columns = [batch.column("id").take(pa.array(of)), coded.dictionary.take(pa.array(pairs % kinds)), pa.array(tf), pa.array(sizes[of])]
                yield pa.RecordBatch.from_arrays([pa.array([field] * len(of), pa.string()), *columns], ["field", "id", "term", "tf", "n"])


def terms(docs: DataFrame) -> DataFrame:
    """``field, id, term, tf, n``: how often each term occurs in each record, and how many occurrences the record has.

    Terms are the words of ``content`` and the tags of ``tags``, trimmed and in lower case, each once a record. Repeated
    rows count once; rows that share an id but differ are records of their own. Null ids, contents, lists and tags and
    blank tags give nothing.
    """
    tags = F.transform(F.filter("tags", lambda t: t.isNotNull()), lambda t: F.lower(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")))
    tags = F.coalesce(F.array_distinct(F.filter(tags, lambda t: t != "")), F.array().cast("array<string>"))
    rows = docs.select(F.col("id").cast("string").alias("id"), "content", "tags").where(F.col("id").isNotNull()).distinct()
    return rows.select("id", words(F.col("content")).alias("content"), tags.alias("tags")).mapInArrow(_counted, "field string, id string, term string, tf long, n long")


def enrich(counted: DataFrame) -> DataFrame:
    """``field, id, term, tf, df, cf, p_log, q_log, score`` for every pair of record and term of each field.

    ``counted`` has ``field, id, term, tf, n``, a row for each pair; fields are collections of their own. ``df`` is the
    number of records with the term, ``cf`` its occurrences in all. ``q_log`` is the logarithm of the probability
    adjusted after Benjamini and Hochberg over all pairs of the field, ``score`` is ``-q_log``: 0 for a term as common in
    the record as anywhere. An empty input gives no rows. Pairs meet their term's counts and their combination's
    probability in joins whose other side has one row a key, so the engine's skew handling can split hot terms.
    """
    counted = stage(counted, "terms")
    term = counted.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    pairs = stage(counted.join(term.hint("merge"), ["field", "term"]), "pairs")
    keys = ["field", "tf", "cf", "n"]
    weighed = stage(pairs.groupBy(*keys).agg(F.count("*").alias("w")), "weights")
    # The occurrences and the pairs of a field, from the combinations: a row for each field.
    total = weighed.groupBy("field").agg(F.sum(F.col("tf") * F.col("w")).alias("_all"), F.sum("w").alias("m"))
    combos = weighed.join(F.broadcast(total), "field").withColumn("p_log", F.pandas_udf(_log_p, "double")("tf", "n", "cf", "_all"))
    c = _adjust(stage(combos, "combos")).select(*keys, "p_log", "q_log")
    joined = pairs.join(c.hint("merge"), keys)
    return joined.select("field", "id", "term", "tf", "df", "cf", "p_log", "q_log", (-F.col("q_log")).alias("score"))


def _adjust(combos: DataFrame) -> DataFrame:
    """``q_log`` = min over p' >= p of log(p' * pairs / rank of p'), at most 0, with each row counting ``w`` times.

    Rows are ordered within slots of the logarithm of -log p; a number of any practical size falls into some hundred
    thousand slots at most, so the slots' totals and minima are carried over by a window over slots only.
    """
    slot = F.floor(F.log1p(-F.col("p_log")) * SLOTS_PER_UNIT)
    # Equal probabilities share the rank of the last of them.
    each = combos.groupBy("field", "p_log").agg(F.sum("w").alias("w"), F.max("m").alias("m")).withColumn("_s", slot)
    slots = each.groupBy("field", "_s").agg(F.sum("w").alias("_w"))
    below = Window.partitionBy("field").orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_before", F.coalesce(F.sum("_w").over(below), F.lit(0))).drop("_w")
    up = Window.partitionBy("field", "_s").orderBy("p_log").rowsBetween(Window.unboundedPreceding, 0)
    raw = each.join(slots, ["field", "_s"]).withColumn("_rank", F.col("_before") + F.sum("w").over(up))
    raw = raw.withColumn("_q", F.col("p_log") + F.log(F.col("m") / F.col("_rank")))
    least = raw.groupBy("field", "_s").agg(F.min("_q").alias("_min"))
    above = Window.partitionBy("field").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    least = least.withColumn("_later", F.coalesce(F.min("_min").over(above), F.lit(0.0))).drop("_min")
    down = Window.partitionBy("field", "_s").orderBy(F.col("p_log").desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = raw.join(least, ["field", "_s"]).withColumn("q_log", F.least(F.min("_q").over(down), "_later", F.lit(0.0)))
    return combos.join(q.select("field", "p_log", "q_log"), ["field", "p_log"])


def distinctive(docs: DataFrame) -> DataFrame:
    """:func:`enrich` for the words of ``content`` and the tags of ``tags``; deleted documents count."""
    return enrich(terms(docs))
