"""Feature-matrix preparation fitted on a training fold.

The fitted numbers (medians, means, deviations, how many categories are frequent) are a
few values per feature. Categories are indexed by falling frequency and encoded as sparse
vectors, so neither a statement nor the driver's part of a fit grows with their number."""

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import (
    OneHotEncoder,
    OneHotEncoderModel,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import category
from ledgerline.operators.ranks import quantile
from ledgerline.settings import (
    ESTIMATION_CATEGORIES,
    ESTIMATION_LOG,
    ESTIMATION_PLAIN,
    FORECAST_CATEGORIES,
    FORECAST_LOG,
    FORECAST_PLAIN,
    RARE_CATEGORY,
)


@dataclass(frozen=True)
class FeatureSet:
    log: list[str]
    plain: list[str]
    categories: list[str]
    # None fills a missing category with the most frequent one.
    missing_label: str | None = "missing"

    @property
    def numeric(self) -> list[str]:
        return self.log + self.plain


ESTIMATION_SET = FeatureSet(ESTIMATION_LOG, ESTIMATION_PLAIN, ESTIMATION_CATEGORIES)
POOLED_SET = FeatureSet(ESTIMATION_LOG, ESTIMATION_PLAIN, [*ESTIMATION_CATEGORIES, "mission"])
FORECAST_SET = FeatureSet(FORECAST_LOG, FORECAST_PLAIN, FORECAST_CATEGORIES, None)


def cast_inputs(df: DataFrame, features: FeatureSet) -> DataFrame:
    """Numbers as doubles, categories as plain labels."""
    text = {f.name for f in df.schema if f.dataType.typeName() == "string"}
    columns = {c: F.col(c).cast("double") for c in features.numeric}
    columns |= {c: category(F.col(c)) for c in features.categories if c not in text}
    return df.withColumns(columns)


def log_features(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(c) for c in columns})


def medians(df: DataFrame, columns: list[str], groups: list[str] | None = None) -> DataFrame:
    """Exact median per column (and group), one row each."""
    keys = groups or []
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return quantile(long.unpivot(keys, columns, "feature", "value"), [*keys, "feature"], "value", 0.5, "median")


def fold_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median of every column that has values."""
    return {r["feature"]: r["median"] for r in medians(df, columns).collect()}


def category_counts(df: DataFrame, columns: list[str], groups: list[str] | None = None) -> DataFrame:
    keys = groups or []
    long = df.select(*keys, *columns).unpivot(keys, columns, "feature", "value")
    counted = long.filter(F.col("value").isNotNull()).groupBy(*keys, "feature", "value")
    return counted.agg(F.count("*").alias("n"))


def bucketed_categories(counts: DataFrame, rare: int = RARE_CATEGORY) -> DataFrame:
    """Categories with the label they are encoded under."""
    label = F.when(F.col("n") < rare, "infrequent").otherwise(F.col("value"))
    return counts.withColumn("encoded", label)


def scaling_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation per column, one pass."""
    rows = [
        F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")) for c in columns
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


@dataclass
class Prepared:
    """Fitted preparation: numbers per feature, indexed categories per field."""

    features: FeatureSet
    median: dict[str, float]
    mean: dict[str, float]
    std: dict[str, float]
    fill: dict[str, str | None]
    indexers: dict[str, StringIndexerModel]
    frequent: dict[str, int]  # categories that are not rare: those of the smallest indices
    encoder: OneHotEncoderModel | None = None

    def number(self, c: str) -> str:
        source = f"ln(1 + {c})" if c in self.features.log else c
        return f"coalesce({source}, {self.median[c]!r}D)"

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.features.numeric if c in self.median]

    def inputs(self, scale: bool) -> SQLTransformer:
        """Numbers f0, f1, ... and filled categories s_<field>."""
        cells = []
        for i, c in enumerate(self.numeric):
            number = self.number(c)
            if scale and self.std[c]:
                number = f"({number} - {self.mean[c]!r}D) / {self.std[c]!r}D"
            cells.append(f"{number} as f{i}")
        for c in self.indexers:
            cells.append(f"coalesce({c}, {_quoted(self.fill[c])}) as s_{c}" if self.fill[c] is not None else f"{c} as s_{c}")
        return SQLTransformer(statement=f"select *, {', '.join(cells)} from __THIS__")

    def codes(self) -> list:
        """Index of each category, all rare ones sharing the index after the frequent ones."""
        cells = []
        for c, indexer in self.indexers.items():
            known, kept = len(indexer.labels), self.frequent[c]
            cells.append(f"case when i_{c} < {known} then least(i_{c}, {kept}D) else {kept + 1}D end as e_{c}")
        if not cells:
            return []
        return [*self.indexers.values(), SQLTransformer(statement=f"select *, {', '.join(cells)} from __THIS__")]

    def stages(self, scale: bool) -> list:
        vectors = [f"v_{c}" for c in self.indexers]
        assembler = VectorAssembler(inputCols=[*(f"f{i}" for i in range(len(self.numeric))), *vectors], outputCol="features")
        return [self.inputs(scale), *self.codes(), *([self.encoder] if self.encoder else []), assembler]

    def index_stages(self) -> list:
        """Category indices, which trees split as sets, instead of a column for each category."""
        inputs = [*(f"f{i}" for i in range(len(self.numeric))), *(f"i_{c}" for c in self.indexers)]
        return [self.inputs(False), *self.indexers.values(), VectorAssembler(inputCols=inputs, outputCol="features")]

    @property
    def index_names(self) -> list[str]:
        return [*self.numeric_names, *(f"categorical__{c}" for c in self.indexers)]

    @property
    def numeric_names(self) -> list[str]:
        kinds = {True: "log_numeric", False: "plain_numeric"}
        return [f"{kinds[c in self.features.log]}__{c}" for c in self.numeric]

    @property
    def names(self) -> list[str]:
        """Of the inputs of the feature vector, in order."""
        names = self.numeric_names
        for c, size in zip(self.indexers, self.encoder.categorySizes if self.encoder else [], strict=True):
            labels = [*self.indexers[c].labels[: self.frequent[c]], "infrequent"]
            names += [f"categorical__{c}_{label}" for label in labels[:size]]
        return names


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_preparation(train: DataFrame, features: FeatureSet) -> Prepared:
    return fit_preparations([train], features)[0]


def _deviations(logged: DataFrame, features: FeatureSet, median: list[dict[str, float]]) -> dict:
    """Mean and deviation of every filled number, a row a fold."""
    facts = [
        F.create_map(*[x for i, m in enumerate(median) for x in (F.lit(i), F.lit(m.get(c)).cast("double"))])
        for c in features.numeric
    ]
    filled = logged.select(
        "_split",
        *[F.coalesce(F.col(c).cast("double"), F.element_at(f, F.col("_split"))).alias(c) for c, f in zip(features.numeric, facts, strict=True)],
    )
    spread = [x for c in features.numeric for x in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))]
    return {r["_split"]: r for r in filled.groupBy("_split").agg(*spread).collect()}


def fit_preparations(trains: list[DataFrame], features: FeatureSet, scaled: bool = True) -> list[Prepared]:
    """Fit on several training folds of the same rows together: one quantile job, one pass for
    the deviations (none where no learner is `scaled`) and one for the categories, whatever their number.

    The driver gets a row per fold and feature, and the category table as index models,
    which hold their labels there in any case."""
    stacked = reduce(
        DataFrame.unionByName,
        [t.select(*features.numeric, *features.categories, F.lit(i).alias("_split")) for i, t in enumerate(trains)],
    )
    logged = log_features(stacked, features.log)
    median: list[dict[str, float]] = [{} for _ in trains]
    for r in medians(logged, features.numeric, ["_split"]).collect():
        median[r["_split"]][r["feature"]] = r["median"]
    stats = _deviations(logged, features, median) if scaled else None
    counted: list[dict[str, list[tuple[int, str]]]] = [{} for _ in trains]
    if features.categories:
        labelled = stacked
        if features.missing_label is not None:
            labelled = stacked.fillna(features.missing_label, features.categories)
        for r in category_counts(labelled, features.categories, ["_split"]).collect():
            counted[r["_split"]].setdefault(r["feature"], []).append((-r["n"], r["value"]))
    out = []
    for i, found in enumerate(median):
        kept = [c for c in features.numeric if c in found]
        out.append(
            _prepared(
                trains[i].sparkSession,
                features,
                found,
                {c: stats[i][f"mean_{c}"] for c in kept} if stats else {},
                {c: stats[i][f"std_{c}"] for c in kept} if stats else {},
                {c: sorted(counted[i][c]) for c in features.categories if c in counted[i]},
            )
        )
    return out


def _prepared(spark, features: FeatureSet, median, mean, std, counted: dict[str, list[tuple[int, str]]]) -> Prepared:
    """Index and encoder models from the categories of each field, by falling frequency."""
    frequent = {c: sum(-n >= RARE_CATEGORY for n, _ in rows) for c, rows in counted.items()}
    fill = {c: features.missing_label or rows[0][1] for c, rows in counted.items()}
    prepared = Prepared(features, median, mean, std, fill, {}, frequent)
    for c, rows in counted.items():
        indexer = StringIndexerModel.from_labels([v for _, v in rows], f"s_{c}", f"i_{c}", "keep")
        prepared.indexers[c] = indexer
    if counted:
        # the encoder reads its sizes from a row that holds each field's largest code
        last = {c: frequent[c] if len(rows) > frequent[c] else frequent[c] - 1 for c, rows in counted.items()}
        sizes = spark.range(1).select(*[F.lit(float(n)).alias(f"e_{c}") for c, n in last.items()])
        encoder = OneHotEncoder(inputCols=sizes.columns, outputCols=[f"v_{c}" for c in counted], handleInvalid="keep")
        prepared.encoder = encoder.fit(sizes)
    return prepared
