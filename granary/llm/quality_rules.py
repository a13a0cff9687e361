"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets counts (words, symbols, repeated lines, repeated words). Fixed base rules drop
the plainly unusable. For all others, limits are learnt from the corpus itself: one mergeable
quantile sketch (KLL) per measure, language and source. Groups of fewer than ``least_rows`` rows take
the sketch merged over their language, and languages of too few rows the one merged over all. A limit
lies beyond the sketch's quantile ``TAIL`` by ``FENCE`` times that quantile's distance from the median;
word length is limited on the low side likewise.

Of a share most documents may have none, so that its quantile is 0. Then the documents that have any decide, by
a sketch of their own: of the ordered list of the group's resolution and their quantiles above it, the limit is in the middle (by
ratio) of the widest gap, if neighbours there differ by ``GAP`` times or more; that is where ordinary documents end and odd ones
begin. Without such a gap they are one population, and the limit lies beyond its upper quantiles by ratios. The resolution
of a share is ``EVENTS`` events in a short text of the group (quantile 1 - ``TAIL`` of the number that it is a share of): less than
that can't be told from chance there, and no limit is lower. Verdicts compare shares with limits alone, so texts of any
length with equal shares get equal verdicts.

Cost at scale: one scan, a small written table of counts (no texts), one aggregation whose partial
sketches are made before the shuffle, and a join of counts with limits in which the hot groups, whose
number is bounded, are broadcast, since one source may hold a third of all rows.

Null texts have no words, so they fail the base rules. A null language or source counts as the empty
string. Repeated rows each get a row. An empty table gives an empty result; ``with_verdicts`` keeps
extra columns, replacing those named like its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_keyed, materialize, read_table

BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Quantile whose distance from the median measures a group's spread, how far beyond it limits lie, events that a share resolves, and the ratio that parts two populations.
TAIL, FENCE, EVENTS, GAP = 0.85, 6.0, 3, 3.0
#: Quantiles of the documents that have any.
GRID = (0.02, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.98)
#: Shares: (count, number that it is a share of, size of one event: a window found again makes six words).
SHARES = {"symbols_per_word": ("n_symbols", "n_words", 1), "dup_line_share": ("n_dup_lines", "n_lines", 1), "repeat_share": ("n_repeat_words", "n_words", 6)}
MEASURES = (*SHARES, "word_length")


def add_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words.

    Repeated words are those in a window of three words that the text has twice or more. Windows are
    sorted by hash with their position in the low bits (as many as the text needs), so equal windows
    are neighbours; neighbours with equal hashes are compared word by word.
    """
    get, lit = F.get, F.lit
    out = docs.withColumn("__t", F.coalesce(F.col(text).cast("string"), lit("")))
    out = out.withColumn("__trim", F.btrim("__t", lit(BLANKS)))
    out = out.withColumn("__w", F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(F.split("__trim", r"[\x20\x09-\x0D]+")))
    out = out.withColumn("n_words", F.size("__w").cast("long"))
    out = out.withColumn("__bits", F.ceil(F.log2(F.greatest(F.col("n_words"), lit(2)).cast("double"))).cast("int"))
    out = out.withColumn("__mask", F.expr("shiftleft(1L, __bits) - 1L"))
    windows = F.expr("transform(sequence(0, n_words - 3), i -> (xxhash64(__w[i], __w[i + 1], __w[i + 2]) & ~__mask) | i)")
    out = out.withColumn("__k", F.when(F.col("n_words") >= 4, F.sort_array(windows)).otherwise(F.array().cast("array<bigint>")))

    def same(k: str, j: str) -> str:
        p, q = f"__k[{k}] & __mask", f"__k[{j}] & __mask"
        words = " and ".join(f"__w[({p}) + {d}] = __w[({q}) + {d}]" for d in range(3))
        return f"(shiftright(__k[{k}] ^ __k[{j}], __bits) = 0 and {words})"

    starts = F.expr(
        f"sort_array(transform(filter(sequence(0, size(__k) - 1), k -> (k > 0 and {same('k', 'k - 1')}) or (k < size(__k) - 1 and {same('k', 'k + 1')})), k -> __k[k] & __mask))"
    )
    out = out.withColumn("__s", F.when(F.size("__k") > 1, starts).otherwise(F.array().cast("array<bigint>")))
    # neighbouring starts share words: three for each start, less what it shares with the one before
    covered = F.expr("cast(aggregate(sequence(1, size(__s)), 0L, (a, k) -> a + if(k = 1, 3L, least(3L, __s[k - 1] - __s[if(k > 1, k - 2, 0)]))) as bigint)")
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("__l", lines)
    out = out.select(
        *[c for c in docs.columns if c.lower() not in (*COUNTS, "n_lines")],
        "n_words",
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        F.when(F.size("__s") > 0, covered).otherwise(lit(0).cast("long")).alias("n_repeat_words"),
    )
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    of = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    return {m: F.col(c) / of(n) for m, (c, n, _) in SHARES.items()} | {"word_length": F.col("word_chars") / of("n_words")}


def split_limit(positive: Column, resolution: Column) -> Column:
    """Limit from the quantiles of the documents that have any (ascending), in the widest gap or beyond them."""
    steps = F.concat(F.array(resolution), F.filter(positive, lambda x: x > resolution))
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda i: F.struct((F.coalesce(F.get(steps, i), resolution) / F.get(steps, i - 1)).alias("ratio"), (-i).alias("first"), F.sqrt(F.coalesce(F.get(steps, i), resolution) * F.get(steps, i - 1)).alias("middle")))
    widest = F.array_max(gaps)
    mid, high = F.greatest(F.get(positive, F.lit(GRID.index(0.5))), resolution), F.greatest(F.get(positive, F.lit(GRID.index(0.9))), resolution)
    return F.when(widest["ratio"] >= GAP, widest["middle"]).otherwise(high * F.pow(high / mid, F.lit(FENCE)))


def limits(counts: DataFrame, fence: float = FENCE, least_rows: int = 200, k: int = 1000) -> DataFrame:
    """One row per language and source: ``hi_*`` of each measure, ``lo_word_length``, and ``rows_of``, the rows of the group."""
    values = measures() | {f"any_{m}": F.when(F.col(c) > 0, measures()[m]) for m, (c, _, _) in SHARES.items()} | {f"size_{m}": F.greatest(F.col(n), F.lit(1)).cast("double") for m, (_, n, _) in SHARES.items()}
    passed = counts.select("__lang", "__source", base_failed().alias("failed"), *[F.when(~base_failed(), c).alias(m) for m, c in values.items()])
    counted = [F.count("*").alias("rows_of"), F.count_if(~F.col("failed")).alias("n"), *[F.count(f"any_{m}").alias(f"n_{m}") for m in SHARES]]
    sketches = passed.groupBy("__lang", "__source").agg(*counted, *[F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in values])
    sketches = materialize(sketches, "sketches")
    some = sketches.filter("n > 0")
    merged = [F.sum("n").alias("n"), *[F.sum(f"n_{m}").alias(f"n_{m}") for m in SHARES], *[F.kll_merge_agg_double(m, F.lit(k)).alias(m) for m in values]]
    q = lambda m, p: F.kll_sketch_get_quantile_double(m, F.lit(p))

    def quantiles() -> Column:
        ends = [F.struct(q(m, 1 - TAIL).alias("low"), q(m, 0.5).alias("mid"), q(m, TAIL).alias("high")).alias(m) for m in MEASURES]
        return F.struct("n", *ends, *[(EVENTS * size / q(f"size_{m}", 1 - TAIL)).alias(f"res_{m}") for m, (_, _, size) in SHARES.items()])

    def positives() -> Column:
        """The quantiles of those that have any; an empty sketch has none."""
        grid = lambda m: F.when(F.col(f"n_{m}") > 0, F.array(*[q(f"any_{m}", p) for p in GRID]))
        return F.struct(*[F.struct(F.col(f"n_{m}").alias("n"), F.coalesce(grid(m), F.array().cast("array<double>")).alias("at")).alias(m) for m in SHARES])

    both = [quantiles().alias("q"), positives().alias("p")]
    by_lang = some.groupBy("__lang").agg(*merged).select("__lang", F.struct(*both).alias("lang"))
    total = some.groupBy().agg(*merged).filter("n > 0").select(F.struct(*both)).scalar()
    own = sketches.select("__lang", "__source", "rows_of", F.when(F.col("n") > 0, F.struct(*both)).alias("own"))
    levels = own.join(by_lang, "__lang", "left").withColumn("total", total)
    enough = lambda field, least: F.when(F.col(f"own.{field}") >= least, F.lit("own")).when(F.col(f"lang.{field}") >= least, F.lit("lang")).otherwise(F.lit("total"))
    pick = lambda level, field: F.when(level == "own", F.col(f"own.{field}")).when(level == "lang", F.col(f"lang.{field}")).otherwise(F.col(f"total.{field}"))
    out = levels.select("__lang", "__source", "rows_of", pick(enough("q.n", least_rows), "q").alias("u"), *[pick(enough(f"p.{m}.n", least_rows // 4), f"p.{m}.at").alias(f"any_{m}") for m in SHARES])
    at = lambda m, end: F.col(f"u.{m}.{end}") + fence * (F.col(f"u.{m}.{end}") - F.col(f"u.{m}.mid"))

    def share_limit(m: str) -> Column:
        res = F.col(f"u.res_{m}")
        return F.greatest(res, F.when(F.col(f"u.{m}.high") > 0, at(m, "high")).otherwise(split_limit(F.col(f"any_{m}"), res)))

    return out.select("__lang", "__source", "rows_of", *[share_limit(m).alias(f"hi_{m}") for m in SHARES], at("word_length", "high").alias("hi_word_length"), at("word_length", "low").alias("lo_word_length"))


def beyond() -> list[Column]:
    """Names of the measures that are beyond their limits, else null."""
    of = measures()
    high = [F.when(of[m] > F.col(f"hi_{m}"), F.lit(f"high_{m}")) for m in MEASURES]
    return [*high, F.when(of["word_length"] < F.col("lo_word_length"), F.lit("low_word_length"))]


def with_verdicts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", fence: float = FENCE, least_rows: int = 200) -> DataFrame:
    """Documents without their text, with the counts, ``base_failed``, ``failed`` (measures beyond their limits) and ``kept``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keyed = docs.withColumns({"__lang": blank(lang), "__source": blank(source)})
    counts = materialize(add_counts(keyed, text).drop(text), "quality-counts")
    lim = materialize(limits(counts, fence, least_rows), "quality-limits")
    judged = join_keyed(counts, lim, ["__lang", "__source"], counts.count()).withColumns({"failed": F.array_compact(F.array(*beyond())), "base_failed": base_failed()})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop(*[c for c in lim.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return with_verdicts(docs).select("doc_id", *COUNTS, "base_failed", "kept", F.array_join("failed", ",").alias("failed"))
