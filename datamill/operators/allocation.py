"""Scoring chunks for kinds of questions and choosing which to ask about.

Candidates (chunk x question type x image or none) are scored; each pool of one
type, with or without image, has a target. Pools are filled in order of scarcity, each
by the highest scores after a penalty for chunks and images that earlier pools used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datamill.operators.stats import ratio
from datamill.tables import materialize

TYPES = ["function_completion", "code_generation", "qa"]
#: Images that suit each kind of question; a code question about another image scores nothing.
CODE_IMAGES = ["circuit"]
QA_IMAGES = ["circuit", "chart", "bloch_sphere", "formula", "diagram", "table"]
LEAST_SCORE = 0.05
SUITABLE, FAIR = 0.5, 0.2


def code_score(text: Column, code: Column, image_type: Column) -> Column:
    """Suitability for code questions."""
    code_length = F.aggregate(code, F.lit(0), lambda a, c: a + F.length(c))
    base = F.when(F.size(code) > 0, 0.5 + F.least(code_length / 400, F.lit(0.3))).when(F.length(text) >= 200, 0.2).otherwise(0.0)
    fits = image_type.isin(CODE_IMAGES)
    return F.when(image_type.isNotNull() & ~fits, 0.0).otherwise(F.least(base + F.when(fits, 0.3).otherwise(0.0), F.lit(1.0)))


def qa_score(text: Column, image_type: Column, has_neighbours: Column) -> Column:
    """Suitability for questions about content."""
    length = F.length(text)
    base = F.when(length >= 50, 0.3 + F.least(length / 1000, F.lit(0.3))).otherwise(0.0)
    image = F.when(image_type.isNull(), 0.0).when(image_type.isin(QA_IMAGES), 0.3).otherwise(0.1)
    return F.least(base + image + F.when(has_neighbours, 0.1).otherwise(0.0), F.lit(1.0))


#: A scorer gives the suitability of (text, code, image type, has neighbours).
Scorer = Callable[[Column, Column, Column, Column], Column]
SCORERS: dict[str, Scorer] = {
    "function_completion": lambda text, code, image, near: code_score(text, code, image),
    "code_generation": lambda text, code, image, near: code_score(text, code, image),
    "qa": lambda text, code, image, near: qa_score(text, image, near),
}


def candidates(chunks: DataFrame, scorers: dict[str, Scorer] | None = None) -> DataFrame:
    """Scored candidates of ``chunks`` (chunk_key, ord, text, code, images: array of (image_id, image_type), has_neighbours).

    ``ord`` numbers chunks; the order of candidates is that of (chunk, type, images then none). ``scorers`` replaces
    those of some kinds of questions.
    """
    rules = SCORERS | (scorers or {})
    kinds = F.explode(F.transform(F.array(*map(F.lit, TYPES)), lambda t, i: F.struct(t.alias("question_type"), i.alias("type_ord"))))
    none = F.lit(None).cast(chunks.schema["images"].dataType.elementType)
    rows = chunks.withColumn("k", kinds).select("*", F.posexplode(F.array_append("images", none)).alias("image_ord", "image"))
    score = F.lit(0.0)
    for kind in TYPES:
        score = F.when(F.col("k.question_type") == kind, rules[kind](F.col("text"), F.col("code"), F.col("image.image_type"), F.col("has_neighbours"))).otherwise(score)
    return rows.select(
        "chunk_key", "ord", "k.question_type", "k.type_ord", "image_ord", F.col("image.image_id").alias("image_id"), F.col("image.image_type").alias("image_type"), score.alias("score")
    ).where(F.col("score") >= LEAST_SCORE)


def targets(total: int, shares: dict[str, float], image_shares: dict[str, float], factor: float = 1.0) -> dict[tuple[str, bool], int]:
    """How many to choose from each pool (type, with image); every product is cut to a whole number."""
    out = {}
    for kind in TYPES:
        of_type = int(total * shares.get(kind, 0.0))
        whole, with_image = int(of_type * factor), int(int(of_type * image_shares.get(kind, 0.0)) * factor)
        out[kind, True], out[kind, False] = with_image, whole - with_image
    return out


def pool_order(sizes: dict[tuple[str, bool], int], goals: dict[tuple[str, bool], int]) -> list[tuple[str, bool]]:
    """Pools with a target, scarcest first: by size over target, then as listed."""
    return sorted((p for p in goals if goals[p] > 0), key=lambda p: sizes.get(p, 0) / max(goals[p], 1))


#: Rows that one task may sort for a pool.
SORTED_ROWS = 100_000


def first_rows(df: DataFrame, order: list, n: int, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """The first ``n`` rows in ``order``. Many are found by ranges: whole ones as long as they fit, the last one sorted by itself."""
    if n <= sorted_rows:
        return df.orderBy(*order).limit(n)
    ranged = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    cut, before = None, 0
    for r in ranged.groupBy("_p").count().orderBy("_p").collect():  # one row for each range
        if before + r["count"] > n:
            cut = r["_p"]
            break
        before += r["count"]
    if cut is None:
        return ranged.drop("_p")
    part = ranged.where(F.col("_p") == cut).orderBy(*order).limit(n - before)
    return ranged.where(F.col("_p") < cut).unionByName(part).drop("_p")


def allocate(scored: DataFrame, goals: dict[tuple[str, bool], int], weight: float = 0.5) -> DataFrame:
    """The chosen candidates with ``adjusted`` scores. At most six passes, one for each pool; only six sizes reach the driver."""
    counted = scored.groupBy("question_type", F.col("image_id").isNotNull().alias("with_image")).count().collect()
    sizes = {(r["question_type"], r["with_image"]): r["count"] for r in counted}
    chosen = None
    for kind, with_image in pool_order(sizes, goals):
        pool = scored.where((F.col("question_type") == kind) & (F.col("image_id").isNotNull() if with_image else F.col("image_id").isNull()))
        penalty = F.lit(0.0)
        if chosen is not None:
            same = chosen.where(F.col("question_type") == kind).groupBy("chunk_key").agg(F.count("*").alias("type_uses"))
            any_type = chosen.groupBy("chunk_key").agg(F.count("*").alias("chunk_uses"))
            images = chosen.where("image_id is not null").groupBy("image_id").agg(F.count("*").alias("image_uses"))
            pool = pool.join(same, "chunk_key", "left").join(any_type, "chunk_key", "left").join(images, "image_id", "left")
            zero = lambda c: F.coalesce(c, F.lit(0))
            penalty = 0.5 * zero("type_uses") + 0.3 * zero("chunk_uses") + 0.2 * zero("image_uses")
        adjusted = F.col("score") * F.greatest(F.lit(0.1), 1 - penalty * weight)
        columns = [*scored.columns, "adjusted"]
        best = first_rows(pool.withColumn("adjusted", adjusted).select(*columns), [F.desc("adjusted"), "ord", "type_ord", "image_ord"], goals[kind, with_image])
        chosen = materialize(best if chosen is None else chosen.unionByName(best), "chosen")
    return chosen if chosen is not None else scored.withColumn("adjusted", F.col("score")).limit(0)


def allocation_metrics(chosen: DataFrame, total_chunks: int, total_images: int) -> DataFrame:
    """One row: how many, of what, how much of chunks and images is covered and how often reused."""
    return chosen.agg(
        F.count("*").alias("selected"), F.count_if(F.col("image_id").isNotNull()).alias("with_image"), F.count_distinct("chunk_key").alias("chunks"),
        F.count_distinct("image_id").alias("images"), ratio(F.count_distinct("chunk_key"), F.lit(total_chunks), 6).alias("chunk_coverage"),
        ratio(F.count_distinct("image_id"), F.lit(total_images), 6).alias("image_coverage"), ratio(F.count("*"), F.count_distinct("chunk_key"), 6).alias("avg_reuse"),
    )


def sweep(scored: DataFrame, runs: list[tuple[str, dict[tuple[str, bool], int], float]]) -> DataFrame:
    """One row for each run (name, goals, weight): what the allocation covers."""
    out = None
    for name, goals, weight in runs:
        row = allocate(scored, goals, weight).agg(F.count("*").alias("selected"), F.count_distinct("chunk_key").alias("chunks"), F.count_distinct("image_id").alias("images")).withColumn("name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def diversity_sweep(scored: DataFrame, goals: dict[tuple[str, bool], int], weights: list[float]) -> DataFrame:
    """One row for each weight of the penalty."""
    return sweep(scored, [(str(w), goals, w) for w in weights]).withColumn("weight", F.col("name").cast("double")).drop("name")


def over_allocation_sweep(scored: DataFrame, total: int, shares: dict[str, float], image_shares: dict[str, float], factors: list[float], weight: float = 0.5) -> DataFrame:
    """One row for each factor by which pools get more than is needed."""
    return sweep(scored, [(f"alloc_{f:.1f}x", targets(total, shares, image_shares, f), weight) for f in factors])


def target_sweep(scored: DataFrame, totals: list[int], shares: dict[str, float], image_shares: dict[str, float], weight: float = 0.5) -> DataFrame:
    """One row for each number of samples that are wanted."""
    return sweep(scored, [(f"target_{t}", targets(t, shares, image_shares), weight) for t in totals])


def suitability(score: Column) -> Column:
    return F.when(score >= SUITABLE, "high").when(score >= FAIR, "medium").otherwise("low")
