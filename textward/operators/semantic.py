"""Vector similarity: pair scores, category matches and drift over embeddings; nearest neighbours are in nearest.py."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, zero norms and unequal lengths."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(square)).otherwise(F.lit(1.7976931348623157e308))


def semantic_match(neighbours: DataFrame, seeds: DataFrame, benign: list, threshold: float = 0.65) -> DataFrame:
    """(query_id, category, score) from the nearest seeds: 0 if a benign one reaches the threshold, else the best similarity. seeds: row_id, category."""
    rows = neighbours.join(seeds, "row_id")
    calm = F.max(F.when(F.col("category").isin(benign), F.col("similarity")))
    best = F.max_by("category", F.struct("similarity", -F.col("row_id")))
    found = rows.groupBy("query_id").agg(calm.alias("calm"), best.alias("category"), F.max("similarity").alias("top"))
    return found.select("query_id", "category", F.when(F.col("calm") >= threshold, 0.0).otherwise(F.col("top")).alias("score"))


def drift(vectors: DataFrame, session: str, order: str, vec: str = "embedding") -> DataFrame:
    """vectors with drift: 1 - cosine to the one before in the session; null for the first."""
    before = F.lag(vec).over(W.partitionBy(session).orderBy(order))
    rows = vectors.withColumn("_before", before)
    return rows.withColumn("drift", F.when(F.col("_before").isNotNull(), 1 - cosine(F.col(vec), F.col("_before")))).drop("_before")


def _running(vectors: DataFrame, session: str, order: str, vec: str) -> DataFrame:
    """(session, order, dim, x, a): a row a dimension, with the sum of x up to it. Nothing that came before is read again."""
    cells = vectors.select(session, order, F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return cells.withColumn("a", F.sum("x").over(W.partitionBy(session, "dim").orderBy(order)))


def aggregate_drift(vectors: DataFrame, session: str, order: str, vec: str = "embedding") -> DataFrame:
    """(session, order, aggregate_drift, acceleration): 1 - cosine of the conversation up to a turn to the one up to the turn before, and the mean
    step of the last three such drifts where each is larger than the one before, else 0.

    A conversation's vector is the sum of its turns' (of word counts: those of all its words). Null for the first turn; turns have the same
    number of dimensions and none repeats.
    """
    x, a = F.col("x"), F.col("a")
    sums = _running(vectors, session, order, vec).groupBy(session, order).agg(F.sum(a * (a - x)).alias("ab"), F.sum(a * a).alias("aa"), F.sum((a - x) * (a - x)).alias("bb"))
    w = W.partitionBy(session).orderBy(order)
    norm = F.sqrt(F.col("aa") * F.col("bb"))
    moved = F.when(F.row_number().over(w) > 1, F.when(norm > 0, 1 - F.col("ab") / norm).otherwise(1.0))
    rows = sums.select(session, order, moved.alias("aggregate_drift"))
    p, q, r = F.lag("aggregate_drift", 2).over(w), F.lag("aggregate_drift", 1).over(w), F.col("aggregate_drift")
    return rows.withColumn("acceleration", F.when((p < q) & (q < r), (r - p) / 2).otherwise(0.0))


def aggregate_vectors(vectors: DataFrame, session: str, order: str, vec: str = "embedding") -> DataFrame:
    """(session, order, aggregate): the sum of the session's vectors up to each turn."""
    cells = _running(vectors, session, order, vec).groupBy(session, order).agg(F.array_sort(F.collect_list(F.struct("dim", "a"))).alias("cells"))
    return cells.select(session, order, F.col("cells.a").alias("aggregate"))


def centroid_distance(vectors: DataFrame, session: str, order: str, vec: str = "embedding") -> DataFrame:
    """(session, order, distance): 1 - cosine of each vector to the running mean up to it. Dimensions are rows, so no vector list is gathered for a session."""
    cells = vectors.select(session, order, F.posexplode(vec).alias("dim", "x")).withColumn("mean", F.avg(F.col("x").cast("double")).over(W.partitionBy(session, "dim").orderBy(order)))
    x, m = F.col("x").cast("double"), F.col("mean")
    sums = cells.groupBy(session, order).agg(F.sum(x * m).alias("xm"), F.sum(x * x).alias("xx"), F.sum(m * m).alias("mm"))
    norm = F.sqrt(F.col("xx") * F.col("mm"))
    return sums.select(session, order, F.when(norm > 0, 1 - F.col("xm") / norm).otherwise(1.0).alias("distance"))


#: Semantic category and attack phase; all others are harmless.
PHASES = (("instruction_override", "override"), ("policy_override", "override"), ("role_play", "setup"), ("persona_switch", "setup"), ("educational_framing", "prime"), ("research_context", "prime"), ("harmful_request", "exploit"), ("exploit_attempt", "exploit"))
#: Attack and its phases, in the order in which attacks are asked.
SEQUENCES = (("skeleton_key", ("setup", "prime", "override", "exploit")), ("crescendo", ("benign", "override", "exploit")), ("boiling_frog", ("benign", "prime", "exploit")))
#: Suspicious steps from one phase to the next.
STEPS = (("benign", "override", "direct_override_attempt"), ("setup", "exploit", "rushed_exploit"), ("prime", "exploit", "skipped_override"))


def phase_of(category: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in PHASES for x in pair)), category), F.lit("benign"))


def phase_sequence(turns: DataFrame, session: str, order: str) -> DataFrame:
    """turns (with phase) with attack, attack_score, transition (of this turn) and suspicious (any so far), as seen at each turn.

    A sequence is matched step by step, each at its first turn after the last one's; so its steps' turns are the same however far one looks,
    and what is matched at a turn are those up to it. At least two steps and over half of them make an attack; else an override does.
    """
    w, so_far = W.partitionBy(session), W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    by = W.partitionBy(session).orderBy(order)
    rows, columns, scores = turns, turns.columns, []
    for i, (_, phases) in enumerate(SEQUENCES):
        for j, phase in enumerate(phases):
            after = F.col("phase") == phase if j == 0 else (F.col("phase") == phase) & (F.col(order) > F.col(f"_s{i}_{j - 1}"))
            rows = rows.withColumn(f"_s{i}_{j}", F.min(F.when(after, F.col(order))).over(w))
        met = functools.reduce(lambda a, b: a + b, (F.coalesce(F.col(f"_s{i}_{j}") <= F.col(order), F.lit(False)).cast("int") for j in range(len(phases))))
        scores.append(F.when((met >= 2) & (met / len(phases) > 0.5), met / len(phases)))
    step = F.coalesce(*(F.when((F.lag("phase").over(by) == a) & (F.col("phase") == b), F.lit(n)) for a, b, n in STEPS))
    rows = rows.withColumn("transition", step).withColumn("suspicious", F.count("transition").over(so_far) > 0)
    several, override = F.row_number().over(by) >= 2, F.count_if(F.col("phase") == "override").over(so_far) > 0
    chosen = F.coalesce(*(F.when(s.isNotNull(), F.struct(F.lit(n).alias("n"), s.alias("s"))) for (n, _), s in zip(SEQUENCES, scores)), F.when(override, F.struct(F.lit("policy_override").alias("n"), F.lit(0.7).alias("s"))))
    rows = rows.withColumn("_x", F.when(several, chosen))
    return rows.select(*columns, F.col("_x.n").alias("attack"), F.coalesce("_x.s", F.lit(0.0)).alias("attack_score"), "transition", "suspicious")


#: Similarity of the whole conversation to an attack over which it counts, and by how much.
AGGREGATE_OVER, AGGREGATE_SHARE = 0.7, 0.8


def trajectory_risk(turns: DataFrame, block: float = 0.75) -> DataFrame:
    """turns with risk and block. turns: attack_score, aggregate_drift, acceleration (0 without), phase, confidence, distance, suspicious and, where known, aggregate_similarity."""
    d, a, phase, sure = F.coalesce("aggregate_drift", F.lit(0.0)), F.col("acceleration"), F.col("phase"), F.col("confidence")
    moved = F.when(a > 0, F.least(a * 2, F.lit(1.0))).when(d > 0.3, d).otherwise(0.0)
    total = 0.35 * F.col("attack_score") + 0.25 * moved + F.when(phase.isin("override", "exploit"), 0.25 * sure).otherwise(0.0) + F.when(F.col("distance") > 0.4, 0.15 * F.col("distance")).otherwise(0.0)
    total = total + F.when((phase == "override") & (sure > 0.8), 0.15).otherwise(0.0) + F.when(F.col("suspicious"), 0.10).otherwise(0.0)
    risk = F.least(total, F.lit(1.0))
    if "aggregate_similarity" in turns.columns:
        whole = F.col("aggregate_similarity")
        risk = F.when(whole > AGGREGATE_OVER, F.greatest(risk, whole * AGGREGATE_SHARE)).otherwise(risk)
    return turns.withColumn("risk", risk).withColumn("block", F.col("risk") >= block)


def hashed_vectors(corpus: DataFrame, dim: int = 64, unit: bool = True) -> DataFrame:
    """(doc_id, embedding): hashed word counts, as unit vectors or as they are; stands in where no embedding column is there."""
    bucket = F.pmod(F.xxhash64("w"), F.lit(dim)).cast("int")
    counts = corpus.select("doc_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).filter("w <> ''").groupBy("doc_id", bucket.alias("i")).count()
    maps = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("i", F.col("count").cast("double")))).alias("m"), (F.sqrt(F.sum(F.col("count") * F.col("count"))) if unit else F.lit(1.0)).alias("norm"))
    return maps.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).alias("embedding"))


def classify_batch(texts: DataFrame, model, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """(doc_id, probability, decision) by a fitted pyspark.ml PipelineModel with a probability column: BLOCK, ALLOW or UNCERTAIN between the thresholds."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")[1]
    return model.transform(texts).select("doc_id", p.alias("probability"), F.when(p >= high, "BLOCK").when(p <= low, "ALLOW").otherwise("UNCERTAIN").alias("decision"))
