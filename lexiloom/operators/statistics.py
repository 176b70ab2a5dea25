"""Recency statistics over histories of records.

A history has an explicit order: ``seq`` counts from 0, the most recent first.
"""

from __future__ import annotations

import functools
import operator
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.functions.numbers import beta_posterior, exploration_bonus, kl_term, let, round_half_up
from lexiloom.session import ship_code, small_or_shuffled, stored

RECENT, TOP, OVERUSED = 10, 5, 2


#: Records of a context that one window may number.
WINDOW = 1_000_000


def with_seq(records: DataFrame, by: list[str], order: list[Column], most: int = WINDOW) -> DataFrame:
    """Adds seq, the place of a record (from 0) within its context.

    A context of more than ``most`` records is cut into ranges of its order;
    each range numbers its own records, and ranges start where those before
    them end.  Records that tie are numbered in any order.
    """
    numbered = lambda df, parts: df.withColumn("seq", F.row_number().over(W.partitionBy(*parts).orderBy(*order)) - 1)
    hot = stored(records.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most))
    ranges = sum(-(-r[0] // most) for r in hot.select("_n").collect())  # each has over ``most`` records, so there are few
    if not ranges:
        return numbered(records, by)
    same = lambda x, y: functools.reduce(operator.and_, [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in by])
    hot = F.broadcast(hot)
    large = records.alias("r").join(hot.alias("h"), same("r", "h"), "left_semi").withColumn("_row", F.monotonically_increasing_id())
    cut = stored(large.repartitionByRange(2 * ranges, *by, *order, "_row").withColumn("_range", F.spark_partition_id()))
    inner = numbered(cut, [*by, "_range"])
    counts = cut.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = F.broadcast(counts.withColumn("_start", F.coalesce(before, F.lit(0))).select(*by, "_range", "_start"))  # one row for a range and a context in it
    shifted = inner.alias("r").join(starts.alias("s"), same("r", "s") & (F.col("r._range") == F.col("s._range"))).select(*[F.col(f"r.{c}") for c in records.columns], (F.col("r.seq") + F.col("s._start")).cast("int").alias("seq"))
    rest = records.alias("r").join(hot.alias("h"), same("r", "h"), "left_anti")
    return numbered(rest, by).unionByName(shifted)


def recent(records: DataFrame, n: int = RECENT) -> DataFrame:
    return records.where(F.col("seq") < n)


def historical(records: DataFrame, n: int = RECENT) -> DataFrame:
    return records.where(F.col("seq") >= n)


def loose_match(column: Column, wanted: Column) -> Column:
    """True where either side is blank, else equality."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return blank(column) | blank(wanted) | (column == wanted)


#: Which fields of a context are given: both, exam, subject, none.
LEVELS = ("both", "exam", "subject", "none")


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def record_levels(records: DataFrame) -> DataFrame:
    """records with level, k1, k2: once for each kind of context, under the fields that such a context looks at.

    A field that a record leaves blank is the key '', which contexts ask for too.
    """
    exam, subject, none = F.coalesce("exam", F.lit("")), F.coalesce("subject", F.lit("")), F.lit("")
    keys = [F.struct(F.lit(level).alias("level"), k1.alias("k1"), k2.alias("k2")) for level, k1, k2 in (("both", exam, subject), ("exam", exam, none), ("subject", none, subject), ("none", none, none))]
    return records.select("*", F.inline(F.array(*keys)))


def context_levels(contexts: DataFrame) -> DataFrame:
    """contexts (c_exam, c_subject) with level, k1, k2: once for each key whose records fit loosely.

    Blank fields are wildcards on both sides, so a context asks for its own
    value and for blank ones, which makes the loose join an equality join.
    """
    exam, subject, none = F.coalesce("c_exam", F.lit("")), F.coalesce("c_subject", F.lit("")), F.lit("")
    key = lambda level, k1, k2: F.struct(F.lit(level).alias("level"), k1.alias("k1"), k2.alias("k2"))
    both = F.array(key("both", exam, subject), key("both", exam, none), key("both", none, subject), key("both", none, none))
    some = F.when(_blank("c_exam") & _blank("c_subject"), F.array(key("none", none, none))).when(_blank("c_exam"), F.array(key("subject", none, subject), key("subject", none, none))).when(_blank("c_subject"), F.array(key("exam", exam, none), key("exam", none, none))).otherwise(both)
    return contexts.select("*", F.inline(some))


def match_contexts(contexts: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs of contexts (c_exam, c_subject) and records whose exam and subject fit loosely.

    Use ``context_totals`` or ``latest_of_contexts`` where sums or the latest
    records are wanted: they cut the records down before they meet contexts.
    """
    keys = ["level", "k1", "k2"]
    return context_levels(contexts).join(record_levels(records), keys).drop(*keys)


def context_totals(contexts: DataFrame, records: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """contexts with sums over the records that fit loosely; contexts without records are absent.

    Records are added up by their keys before contexts meet them.
    """
    keys = ["level", "k1", "k2"]
    parts = record_levels(records).groupBy(*keys).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    return context_levels(contexts).join(parts, keys).groupBy(*contexts.columns).agg(*[F.sum(f"_{n}").alias(n) for n in sums])


def latest_of_contexts(contexts: DataFrame, records: DataFrame, order: list[Column], n: int) -> DataFrame:
    """contexts with the n first records by order of those that fit loosely, and rank (from 1).

    Each key keeps its n first records before contexts meet them, so a context
    meets at most 4 n rows.
    """
    keys = ["level", "k1", "k2"]
    cut = record_levels(records).withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
    met = context_levels(contexts).join(cut, keys).drop(*keys)
    return met.withColumn("rank", F.row_number().over(W.partitionBy(*contexts.columns).orderBy(*order))).where(F.col("rank") <= n)


def frequency(items: DataFrame, by: list[str], item: str = "item") -> DataFrame:
    """by, item, n; trimmed, blanks left out."""
    return items.select(*by, F.trim(F.col(item)).alias("item")).where("item <> ''").groupBy(*by, "item").agg(F.count("*").alias("n"))


def probabilities(counts: DataFrame, by: list[str]) -> DataFrame:
    """Adds p; contexts whose total is not positive have no rows.  Totals are pre-aggregated, not windowed."""
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total")).where("_total > 0")
    joined = counts.join(totals, by) if by else counts.crossJoin(F.broadcast(totals))
    return joined.withColumn("p", F.col("n") / F.col("_total")).drop("_total")


def entropy(probs: DataFrame, by: list[str]) -> DataFrame:
    """by, entropy (bits), normalized (0 for one category)."""
    terms = F.when(F.col("p") > 0, -F.col("p") * F.log2("p")).otherwise(0.0)
    summed = probs.groupBy(*by).agg(F.sum(terms).alias("entropy"), F.count_if(F.col("p") > 0).alias("_k"))
    return summed.withColumn("normalized", F.when(F.col("_k") <= 1, 0.0).otherwise(F.col("entropy") / F.log2("_k"))).drop("_k")


def divergence(p: DataFrame, q: DataFrame, by: list[str]) -> DataFrame:
    """by, jsd of two distributions; 1 where one side is empty.  Contexts without any rows are absent and count as 0."""
    a, b = p.select(*by, "item", F.col("p").alias("pa")), q.select(*by, "item", F.col("p").alias("pb"))
    both = a.join(b, [*by, "item"], "full_outer")
    pa, pb = F.coalesce("pa", F.lit(0.0)), F.coalesce("pb", F.lit(0.0))
    mid = (pa + pb) / 2
    sums = both.groupBy(*by).agg(F.sum(kl_term(pa, mid) + kl_term(pb, mid)).alias("_s"), F.count("pa").alias("_a"), F.count("pb").alias("_b"))
    return sums.select(*by, F.when((F.col("_a") == 0) | (F.col("_b") == 0), 1.0).otherwise(F.col("_s") / 2).alias("jsd"))


def weighted_counts(records: DataFrame, by: list[str], field: str) -> DataFrame:
    """by, item, weight, first_seq, first_pos: each occurrence adds n - seq, where n is the context's number of records."""
    sized = records.join(records.groupBy(*by).agg(F.count("*").alias("_n")), by) if by else records.crossJoin(F.broadcast(records.agg(F.count("*").alias("_n"))))
    items = sized.select(*by, "seq", (F.col("_n") - F.col("seq")).alias("_w"), F.posexplode(field).alias("_pos", "_raw"))
    clean = items.withColumn("item", F.trim(F.col("_raw").cast("string"))).where("item <> ''")
    first = F.min(F.struct("seq", "_pos"))
    return clean.groupBy(*by, "item").agg(F.sum("_w").alias("weight"), first.alias("_f")).select(*by, "item", "weight", F.col("_f.seq").alias("first_seq"), F.col("_f._pos").alias("first_pos"))


def top_by_weight(counts: DataFrame, by: list[str], least: int = 0, limit: int = TOP) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("weight"), "first_seq", "first_pos")
    return counts.where(F.col("weight") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def least_recently_used(all_counts: DataFrame, recent_counts: DataFrame, by: list[str], limit: int = TOP) -> DataFrame:
    """Items of the whole history that are not in the recent part, the lowest weight first."""
    old = all_counts.join(recent_counts.select(*by, "item"), [*by, "item"], "left_anti")
    order = W.partitionBy(*by).orderBy("weight", "first_seq", "first_pos")
    return old.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def fill_rate(field: str) -> Column:
    """Aggregate: the share of records whose array field is not empty; 0 without records."""
    return F.coalesce(F.avg(F.when(F.size(field) > 0, 1.0).otherwise(0.0)), F.lit(0.0))


def fill_posterior(records: DataFrame, by: list[str], field: str) -> DataFrame:
    counts = records.groupBy(*by).agg(F.count_if(F.size(field) > 0).alias("_s"), F.count("*").alias("observations"))
    made = counts.withColumn("_b", beta_posterior(F.col("_s"), F.col("observations") - F.col("_s")))
    return made.select(*by, "observations", F.col("_b.alpha").alias("alpha"), F.col("_b.beta").alias("beta"), F.col("_b.mean").alias("mean"), F.col("_b.variance").alias("variance"))


#: Concepts of one automaton, some hundred bytes each; more are looked for in several passes.
AUTOMATON = 100_000


def coverage_probability(concepts: DataFrame, records: DataFrame, most: int = AUTOMATON) -> DataFrame:
    """concept, coverage_probability, observations: in how many records' joined, lower-cased texts each concept stands.

    All concepts are found in one run over a text, overlapping and nested ones
    too (see ``texts_with``).
    """
    wanted = stored(concepts.select(F.trim("concept").alias("concept")).where("concept <> ''").distinct().withColumn("key", F.lower("concept")))
    hay = F.lower(F.array_join(F.coalesce("concepts_taught", F.array().cast("array<string>")), " | "))
    hits = texts_with(wanted.select("key").distinct(), records.select(hay.alias("text")), most)
    total = records.agg(F.count("*").alias("observations"))
    joined = wanted.join(small_or_shuffled(stored(hits)), "key", "left").crossJoin(F.broadcast(total))  # one row
    s = F.coalesce("_s", F.lit(0))
    return joined.select("concept", round_half_up(beta_posterior(s, F.col("observations") - s)["mean"], 2).alias("coverage_probability"), "observations")


def texts_with(keys: DataFrame, rows: DataFrame, most: int = AUTOMATON) -> DataFrame:
    """key, _s: how many texts (text) hold each of the distinct keys (key), by an Aho-Corasick automaton.

    ``most`` keys at most make an automaton, which every task builds from a
    broadcast list; a text is walked once for each automaton, however many keys
    that has.  Tasks send one row for each key they found.  Null texts hold
    nothing; empty keys are not looked for.
    """
    ship_code(rows.sparkSession)
    keys = stored(keys.where("key <> ''"))
    parts = max(1, -(-keys.count() // most))
    out = None
    for part in range(parts):
        listed = sorted(r.key for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).collect())  # about ``most``
        held = rows.sparkSession.sparkContext.broadcast(listed)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine, counts = ahocorasick.Automaton(), Counter()
            for k, key in enumerate(held.value):
                machine.add_word(key, k)
            machine.make_automaton()
            for batch in batches:
                for text in batch.column(0).to_pylist() if held.value else []:
                    counts.update({k for _, k in machine.iter(text)} if text else ())
            yield pa.RecordBatch.from_arrays([pa.array([held.value[k] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["key", "_s"])

        found = rows.select("text").mapInArrow(run, "key string, _s long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("key").agg(F.sum("_s").alias("_s"))


def ewma_by(rows: DataFrame, by: list[str], value: Column, alpha: float = 0.3) -> DataFrame:
    """by, ewma over rows with seq (0 is the latest): a weighted sum, so a long history is added up in parts.

    The oldest value seeds the average; values that are no numbers are left out
    of the series, which needs seq to be counted over numbers only.
    """
    oldest = F.max_by(value, F.col("seq"))
    weighted = F.sum(F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("seq")) * value)
    made = rows.groupBy(*by).agg(weighted.alias("_w"), oldest.alias("_o"), F.max("seq").alias("_n"))
    # the oldest value counts in full where the formula gives it alpha only
    return made.select(*by, (F.col("_w") + F.pow(F.lit(1 - alpha), F.col("_n") + 1) * F.col("_o")).alias("ewma"))


def coverage_summary(items: DataFrame, gap: float = 0.35) -> DataFrame:
    """One row: data_available, average_coverage, gaps, for a catalogue whose gaps fit into a row; ``coverage_gaps`` gives them as rows."""
    p = F.col("coverage_probability")
    return items.agg((F.count("*") > 0).alias("data_available"), F.coalesce(round_half_up(F.avg(p), 2), F.lit(0.0)).alias("average_coverage"), F.array_sort(F.collect_list(F.when(p < gap, F.col("concept")))).alias("gaps"))


def coverage_gaps(items: DataFrame, by: list[str], gap: float = 0.35) -> DataFrame:
    """by, concept, coverage_probability, rank of the concepts below the gap, the least covered first: gaps as rows, however many there are."""
    low = items.where(F.col("coverage_probability") < gap).select(*by, "concept", "coverage_probability")
    return low.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("coverage_probability", "concept")))


def drift(scores: DataFrame, by: list[str], order: str = "seq", value: str = "score") -> DataFrame:
    """by, slope (3 places), data_available: the trend of a score over its order."""
    made = scores.groupBy(*by).agg(F.count("*").alias("_n"), F.regr_slope(F.col(value), F.col(order).cast("double")).alias("_s"))
    return made.select(*by, F.when(F.col("_n") < 2, 0.0).otherwise(round_half_up(F.coalesce("_s", F.lit(0.0)), 3)).alias("slope"), (F.col("_n") >= 2).alias("data_available"))


def rank_with_exploration(candidates: DataFrame, by: list[str], weight: float = 1.0, trials: Column | None = None) -> DataFrame:
    """Adds bonus, total and rank to candidates (id, exploit, used): exploitation plus a bonus for what was rarely used."""
    used = F.greatest(F.coalesce("used", F.lit(0)), F.lit(0))
    if trials is None:
        totals = candidates.groupBy(*by).agg(F.sum(used).alias("_trials"))
        candidates = candidates.join(totals, by) if by else candidates.crossJoin(F.broadcast(totals))
        trials = F.col("_trials")
    scored = candidates.withColumn("bonus", exploration_bonus(trials, used, weight)).withColumn("total", F.coalesce("exploit", F.lit(0.0)) + F.col("bonus")).drop("_trials")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("total"), F.col("id").cast("string"))))
