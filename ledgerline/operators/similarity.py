"""Best-guess mission of a company by code and keyword similarity."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import keywords
from ledgerline.operators.keys import salted_join


def keyword_rows(df: DataFrame, text: str, ids: list[str]) -> DataFrame:
    return df.select(*ids, F.explode(keywords(F.col(text))).alias("keyword"))


def profiles(known: DataFrame, missions: list[str], code: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Companies per code and per keyword, one count column per mission."""
    counts = [F.count_if(F.col("mission") == m).alias(f"n{i}") for i, m in enumerate(missions)]
    by_code = known.filter(F.col(code).isNotNull()).groupBy(code).agg(*counts)
    by_word = keyword_rows(known, text, ["mission"]).groupBy("keyword").agg(*counts)
    return by_code, by_word


def _sizes(known: DataFrame, missions: list[str]) -> list[Column]:
    return [known.filter(F.col("mission") == m).select(F.count("*")).scalar() for m in missions]


def _normalised(shares: list[Column]) -> list[Column]:
    total = sum(shares[1:], shares[0])
    return [F.when(total > 0, F.try_divide(s, total)).otherwise(0.0) for s in shares]


def assign_missions(
    targets: DataFrame, known: DataFrame, missions: list[str], code: str, text: str
) -> DataFrame:
    """Mission with the largest code share plus keyword share.

    Equal scores go to the mission listed first; without any signal the largest
    mission is taken and the method says so."""
    n = range(len(missions))
    by_code, by_word = profiles(known, missions, code, text)
    words = salted_join(keyword_rows(targets, text, ["company_id"]), by_word, ["keyword"], "company_id", how="inner")
    word_hits = words.groupBy("company_id").agg(*[F.sum(f"n{i}").alias(f"w{i}") for i in n])
    coded = by_code.select(code, *[F.col(f"n{i}").alias(f"c{i}") for i in n])
    out = salted_join(targets.select("company_id", code), coded, [code], "company_id")
    out = out.join(word_hits, "company_id", "left").fillna(0)
    sizes = {f"_size{i}": s for i, s in enumerate(_sizes(known, missions))}
    out = out.withColumns(sizes)

    def share(prefix: str, i: int) -> Column:
        return F.coalesce(F.try_divide(F.col(f"{prefix}{i}").cast("double"), F.col(f"_size{i}")), F.lit(0.0))

    code_share, word_share = [share("c", i) for i in n], [share("w", i) for i in n]
    has_code = sum((F.col(f"c{i}") for i in n), F.lit(0)) > 0
    has_word = sum((F.col(f"w{i}") for i in n), F.lit(0)) > 0
    scores = [a + b for a, b in zip(_normalised(code_share), _normalised(word_share), strict=True)]
    out = out.withColumns({f"s{i}": s for i, s in enumerate(scores)} | {"_code": has_code, "_word": has_word})

    def first_largest(columns: list[str]) -> Column:
        best = F.greatest(*columns)
        picked = F.lit(None).cast("string")
        for c, m in reversed(list(zip(columns, missions, strict=True))):
            picked = F.when(F.col(c) == best, m).otherwise(picked)
        return picked

    signal = F.col("_code") | F.col("_word")
    by_score = first_largest([f"s{i}" for i in n])
    by_size = first_largest([f"_size{i}" for i in n])
    # Method labels.
    method = (
        F.when(~signal, "fallback_plurality_mission_no_signal")
        .when(F.col("_code") & F.col("_word"), "sic_and_keyword_similarity")
        .when(F.col("_code"), "sic_similarity_only_no_keyword_match")
        .otherwise("keyword_similarity_only_no_sic_match")
    )
    labels = [f"assignment_score_{m.lower().replace(' ', '_')}" for m in missions]
    return out.select(
        "company_id",
        F.when(signal, by_score).otherwise(by_size).alias("assigned_mission"),
        method.alias("assignment_method"),
        *[F.col(f"s{i}").alias(label) for i, label in enumerate(labels)],
    )
