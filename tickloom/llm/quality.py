"""Quality rules: fixed rules and robust multivariate outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import SPACE, discard, stage

#: Words in one window of the repetition rule, and the thresholds of the fixed rules.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Share of a group's rows that the determinant is minimised over, and concentration steps.
COVERED, STEPS = 0.75, 4
#: Groups of fewer rows are judged by the estimate for all rows.
LEAST_ROWS = 60
#: Squared distance beyond which a text is rejected. For five normal dimensions 99.9 % lie within 20.5; real
#: texts have longer tails, so only what is far outside goes.
CUTOFF = 120.0
#: Least standard deviations of the transformed statistics, for groups in which one hardly varies.
FLOORS = {"z_words": 0.3, "z_length": 0.05, "z_symbols": 0.05, "z_lines": 0.05, "z_repeats": 0.05}
DIMS = list(FLOORS)


def _repeated_words(words: Column, n: Column) -> Column:
    """Words in windows of WINDOW words that occur at least twice in the text.

    Windows are compared by 64-bit hash. Most texts have no equal hashes and stop there; otherwise
    the sorted (hash, place) pairs give the places of repeated windows, and these their joint length.
    """
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            m = F.size(s)
            same = lambda j, k: F.get(s, j)["h"] == F.get(s, k)["h"]
            twice = F.filter(F.transform(s, lambda x, j: F.when(F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)), x["i"])), lambda x: x.isNotNull())
            return F.when(m > 0, F.array_sort(twice))

        def length(p: Column) -> Column:
            start = F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last"))
            add = lambda acc, x: F.struct((acc["sum"] + F.least(x - acc["last"], F.lit(WINDOW))).alias("sum"), x.alias("last"))
            return F.aggregate(p, start, add, lambda acc: acc["sum"])

        return F.transform(F.transform(F.array(pairs), places), length)[0]

    def judged(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(F.transform(F.array(hashes), judged)[0])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base statistics of every text, and the group (language, source) that it is compared with."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    group = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null")) if c in docs.columns else F.lit("null") for c in (lang_col, source_col)]
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(*group).alias("grp"), text.alias("text"))

    def counted(words: Column) -> Column:
        n = F.size(words)
        return F.struct(n.cast("long").alias("n_words"), _repeated_words(words, n).cast("long").alias("n_repeat_words"))

    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    both = F.transform(F.array(words), counted)[0]
    dup = F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
    out = src.select(
        "id",
        "grp",
        both.alias("both"),
        F.char_length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
    )
    out = out.select("id", "grp", F.col("both.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("both.n_repeat_words").alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return out.select(
        "*",
        failed.alias("base_failed"),
        F.log(n).alias("z_words"),
        F.log((F.col("word_chars") + 1) / n).alias("z_length"),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("z_symbols"),
        F.sqrt(F.col("n_dup_lines") / n).alias("z_lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("z_repeats"),
    )


def _distance(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance to the estimate of the row's cell, by forward substitution."""
    out = rows.join(est, "cell")
    ys: list[str] = []
    for i, d in enumerate(DIMS):
        rest = [F.col(f"l_{i}_{j}") * F.col(ys[j]) for j in range(i)]
        out = out.withColumn(f"y_{i}", reduce(lambda a, b: a - b, rest, F.col(d) - F.col(f"m_{i}")) / F.col(f"l_{i}_{i}"))
        ys.append(f"y_{i}")
    d2 = reduce(lambda a, b: a + b, [F.col(y) * F.col(y) for y in ys])
    return out.withColumn("d2", d2).select(*rows.columns, "d2")


def _estimate(rows: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Mean and Cholesky factor of the covariance per cell, written: one row per cell.

    One aggregation of moments with map-side combine, however large a cell is.
    """
    k = len(DIMS)
    sums = [F.avg(d).alias(f"m_{i}") for i, d in enumerate(DIMS)]
    sums += [F.covar_pop(DIMS[i], DIMS[j]).alias(f"s_{i}_{j}") for i in range(k) for j in range(i + 1)]
    est = rows.groupBy("cell").agg(*sums)
    for i, d in enumerate(DIMS):
        for j in range(i):
            s = reduce(lambda a, b: a - b, [F.col(f"l_{i}_{x}") * F.col(f"l_{j}_{x}") for x in range(j)], F.col(f"s_{i}_{j}"))
            est = est.withColumn(f"l_{i}_{j}", s / F.col(f"l_{j}_{j}"))
        s = reduce(lambda a, b: a - b, [F.col(f"l_{i}_{x}") * F.col(f"l_{i}_{x}") for x in range(i)], F.col(f"s_{i}_{i}"))
        est = est.withColumn(f"l_{i}_{i}", F.sqrt(F.greatest(s, F.lit(0.0)) + F.lit(FLOORS[d] ** 2)))
    keep = ["cell", *(f"m_{i}" for i in range(k)), *(f"l_{i}_{j}" for i in range(k) for j in range(i + 1))]
    return stage(est.select(*keep), label)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Fixed rules, then outliers by the minimum covariance determinant per language and source.

    Statistics are transformed (logarithms, square roots of shares). Texts that pass the fixed rules
    are judged in cells of equal language and source; cells of fewer than LEAST_ROWS rows share one. Each
    cell starts from its rows nearest to the coordinate medians in units of the median deviation;
    concentration steps then refit mean and covariance on the COVERED share of rows with the smallest
    distances, which never raises the determinant. A text whose squared distance to the last estimate
    exceeds CUTOFF times the median-consistent scale is rejected. Distances are quantiles per cell by mergeable sketches and
    moments by map-side sums, so no cell meets in one task.

    Result, one row per input row: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept``, ``distance`` (null where base_failed).
    Null text has no words and fails the base. Null language or source is a value of its own; repeated
    rows are judged alike; an empty table gives an empty result; other columns are not looked at.
    DataFrame functions only.
    """
    spark = docs.sparkSession
    stats, _ = stage(statistics(docs, id_col, text_col, lang_col, source_col), "quality-rows")
    good = stats.where("not base_failed")
    sizes = good.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ROWS).select("grp", F.col("grp").alias("cell"))
    sizes, sizes_path = stage(sizes, "quality-cells")
    cells = good.join(sizes, "grp", "left").select(F.coalesce("cell", F.lit(0).cast("long")).alias("cell"), *DIMS)

    # Start: distances by medians and median absolute deviations.
    mid = cells.groupBy("cell").agg(*[F.percentile_approx(d, 0.5, 1000).alias(f"m_{i}") for i, d in enumerate(DIMS)])
    away = cells.join(mid, "cell").select("cell", *DIMS, *[F.abs(F.col(d) - F.col(f"m_{i}")).alias(f"a_{i}") for i, d in enumerate(DIMS)])
    spread = away.groupBy("cell").agg(*[(F.percentile_approx(f"a_{i}", 0.5, 1000) * 1.4826 + FLOORS[d]).alias(f"s_{i}") for i, d in enumerate(DIMS)])
    first = away.join(spread, "cell").withColumn("d2", reduce(lambda a, b: a + b, [(F.col(f"a_{i}") / F.col(f"s_{i}")) ** 2 for i in range(len(DIMS))])).select("cell", *DIMS, "d2")
    measured, paths, est = first, [sizes_path], None
    for step in range(STEPS):
        limit = measured.groupBy("cell").agg(F.percentile_approx("d2", COVERED, 1000).alias("limit"))
        inside = measured.join(limit, "cell").where("d2 <= limit")
        est, path = _estimate(inside, f"quality-step{step}")
        paths.append(path)
        measured = _distance(cells, est)
    # Scale: the median distance of a cell is made that of five normal dimensions, 4.35.
    scale = measured.groupBy("cell").agg(F.greatest(F.percentile_approx("d2", 0.5, 1000) / 4.35, F.lit(1.0)).alias("scale"))
    scale, _ = stage(est.join(scale, "cell"), "quality-scale")
    judged = stats.join(sizes, "grp", "left").withColumn("cell", F.when(~F.col("base_failed"), F.coalesce("cell", F.lit(0).cast("long"))))
    judged, _ = stage(_judge(judged, scale, id_col), "quality-result")
    discard(spark, *paths)
    return judged


def _judge(rows: DataFrame, est: DataFrame, id_col: str) -> DataFrame:
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = rows.where("base_failed").select("id", *base, F.lit(None).cast("double").alias("distance"))
    passed = _distance(rows.where("not base_failed"), est.drop("scale")).join(est.select("cell", "scale"), "cell").select("id", *base, (F.col("d2") / F.col("scale")).alias("distance"))
    both = passed.unionByName(failed)
    return both.select(F.col("id").alias(id_col), *base, (F.coalesce(F.col("distance") <= CUTOFF, F.lit(False)) & ~F.col("base_failed")).alias("kept"), "distance")
