"""Mixing sources to target weights (operator 4), DataFrame operations only.

Words are counted per document and summed per source (partial sums, so a source that holds a third of
all rows is a few numbers before the shuffle). Sources in code-point order (null last) weigh 5, 2, 1,
repeating, and share the total; a target above ``CAP`` times its source stops there and the excess is
shared again by weight until none is above. One number, the words per unit of weight, is carried from
round to round. A document's rate is target / size of its source: it is taken floor(rate) times plus
one Bernoulli copy with probability equal to the fraction, seeded by a hash of id and text, so reruns agree.

Rates meet the documents by a broadcast only if the rate table is under ``BROADCAST_BYTES`` (measured);
beyond that, rates are repeated per salt and joined with salted documents.

Defined cases: a null or empty text has size 0; a source of size 0 has target 0 and nothing is taken;
a null source is a source of its own; repeated rows draw alike and are all counted; a null id draws by its
text; an empty table gives an empty result; extra columns pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickoff.operators.splits import with_row_index
from kickoff.session import materialize

WEIGHTS = (5, 2, 1)  # fixed values of the contract
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
SEED = 20
BROADCAST_BYTES = 4 << 20
SALTS = 32


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, size) rows → (source, source_size, target, rate), one row per source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_row_index(totals.withColumn("null_last", F.col("source").isNull().cast("int")),
                            order=("null_last", "source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("idx") % len(WEIGHTS) + 1).cast("int"))
    sources = materialize(ranked.select("source", "source_size", weight.alias("weight")), "mix-sources")
    cap = F.col("source_size") * CAP
    total, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    unit, before = (total / weights if weights else 0.0), None
    while unit != before:
        over = cap < F.col("weight") * F.lit(unit)
        stopped, open_weight = sources.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0)),
                                           F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        before, unit = unit, ((total - stopped) / open_weight if open_weight else unit)
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(float(unit)))
    return sources.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(CAP))))
        .otherwise(F.lit(0.0)))


def _draw(identity: Column, text: Column) -> Column:
    """Uniform in [0, 1) from a hash of id and text."""
    bits = F.shiftrightunsigned(F.xxhash64(identity, text, F.lit(SEED)), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def _copies(rate: Column, draw: Column) -> Column:
    whole = F.floor(rate)
    return whole + (draw < rate - whole).cast("long")


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Join (…, source, draw) with the rates on the source, null matching null."""
    size = rates.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 40)).first()[0] or 0
    rates = rates.withColumnRenamed("source", "rate_source")
    same = F.col("source").eqNullSafe(F.col("rate_source"))
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(rates), same).drop("rate_source")
    spread = rates.withColumn("rate_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.floor(F.col("draw") * SALTS * 1024) % SALTS
    return (rows.withColumn("salt", salt.cast("int")).join(spread, same & (F.col("salt") == F.col("rate_salt")))
            .drop("rate_source", "rate_salt", "salt"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``rate``, ``copies``, ``taken``."""
    text = F.col(text_col)
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                    word_count(text).alias("size"), _draw(F.col(id_col), text).alias("draw")), "mix-sizes")
    rows = _with_rates(sized, source_targets(sized)).withColumn("copies", _copies(F.col("rate"), F.col("draw")))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies",
                       (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: every row of ``docs``, all its columns, as often as the plan takes it."""
    text = F.col(text_col)
    rates = materialize(source_targets(docs.select(F.col(source_col).alias("source"), word_count(text).alias("size"))),
                        "mix-rates")
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"),
                       _draw(F.col(id_col), text).alias("draw"))
    taken = _with_rates(rows, rates).select("row", _copies(F.col("rate"), F.col("draw")).alias("copies"))
    return taken.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
                                            ).select("row.*")
