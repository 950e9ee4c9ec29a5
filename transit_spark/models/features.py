"""Feature preparation shared by the booking models, without a list of categories on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from transit_spark.operators.encode import frequency_codes, median_impute
from transit_spark.operators.joins import join_counted, with_global
from transit_spark.session import stage

# Feature columns of the booking models.
CATEGORICAL = (
    "Class",
    "Quota",
    "FromStation",
    "ToStation",
    "BookingStatus",
    "PassengerType",
    "BookingChannel",
    "TrainType",
    "Concession",
)
NUMERIC = (
    "Distance",
    "Fare",
    "Passengers",
    "IsWaitlisted",
    "WaitlistRank",
    "IsHoliday",
    "HasConcession",
    "IsConfirmed_AtBooking",
    "route_confirmation_rate",
    "avg_fare_on_route",
    "avg_distance",
    "bookings_count",
)

#: Rows of prepared features for each task of a training step.
ROWS_PER_TASK = 25_000

#: Widest feature vector that is made dense to be scored by a forest.
DENSE_WIDTH = 4_096

_DENSE = "__dense_features"


@dataclass(frozen=True)
class Categories:
    """The codes of one column: ``size`` of them, in a table ``(value, code)``; hashed columns need no table."""

    column: str
    size: int
    table: DataFrame | None = None

    @property
    def index(self) -> str:
        return f"{self.column}_idx"


def fit_categories(df: DataFrame, column: str, width: int | None = None) -> Categories:
    """Codes by falling frequency, ties by value, as a written table of any length.

    With ``width`` the values are hashed into so many codes instead.
    """
    if width is not None:
        return Categories(column, width)
    table = stage(frequency_codes(df, column, "code").select(F.col(column).alias("value"), "code"))
    return Categories(column, max(1, table.count()), table)


def hashed_code(column: Column, width: int) -> Column:
    return F.pmod(F.xxhash64(column.cast("string")), F.lit(width)).cast("int")


def add_codes(df: DataFrame, categories: Sequence[Categories]) -> DataFrame:
    """Add ``<column>_idx``; NULL and unseen values get the next free code.

    Each table is joined on, broadcast only when its counted size is within the bounds of ``join_counted``.
    """
    for c in categories:
        unseen = F.lit(c.size)
        if c.table is None:
            code = F.when(F.col(c.column).isNotNull(), hashed_code(F.col(c.column), c.size)).otherwise(unseen)
            df = df.withColumn(c.index, code)
        else:
            codes = c.table.select(F.col("value").alias(c.column), F.col("code").alias(c.index))
            df = join_counted(df, codes, c.column).withColumn(c.index, F.coalesce(c.index, unseen))
    return df


def offsets(categories: Sequence[Categories]) -> dict[str, int]:
    """Where the entries of each column begin in the assembled vector; the numbers come behind the last."""
    found, at = {}, 0
    for c in categories:
        found[c.column], at = at, at + c.size
    return found


def one_hot_positions(df: DataFrame, categories: Sequence[Categories], name: str = "positions") -> DataFrame:
    """Add the positions of the ones in the assembled vector; a NULL or unseen value has none."""
    begin = offsets(categories)
    spots = [F.when(F.col(c.index) < c.size, F.col(c.index) + begin[c.column]) for c in categories]
    return add_codes(df, categories).withColumn(name, F.array_compact(F.array(*spots))).drop(*[c.index for c in categories])


def assembled(df: DataFrame, categories: Sequence[Categories], numeric: Sequence[str]) -> DataFrame:
    """The assembled vector as plain columns: ``positions`` of the ones, and each number with its median filled in
    and divided by its sample standard deviation, as ``<column>_scaled``; a constant column stays as it is."""
    filled = median_impute(one_hot_positions(df, categories), numeric)
    spread = filled.agg(*[F.stddev_samp(f"{c}_imp").alias(c) for c in numeric])
    both = with_global(filled, spread, "__sd_")
    divisor = {c: F.when(F.col(f"__sd_{c}") > 0, F.col(f"__sd_{c}")).otherwise(1.0) for c in numeric}
    scaled = {f"{c}_scaled": F.col(f"{c}_imp") / divisor[c] for c in numeric}
    return both.select(*df.columns, "positions", *[v.alias(n) for n, v in scaled.items()])


def feature_names(categories: Sequence[Categories], numeric: Sequence[str], spark: SparkSession) -> DataFrame:
    """``(position, feature)`` of every entry of the assembled vector, as a table."""
    begin = offsets(categories)
    width = sum(c.size for c in categories)
    names = spark.createDataFrame([(width + k, f"{n}_imp") for k, n in enumerate(numeric)], "position INT, feature STRING")
    for c in categories:
        if c.table is None:
            own = spark.range(c.size).select(F.col("id").cast("int").alias("code"), F.col("id").cast("string").alias("value"))
        else:
            own = c.table.select("code", F.col("value").cast("string"))
        text = F.concat(F.lit(f"{c.column}_ohe_"), F.col("value"))
        names = names.unionByName(own.select((F.col("code") + begin[c.column]).alias("position"), text.alias("feature")))
    return names


@dataclass(frozen=True)
class Features:
    """Fitted feature stages: codes of the categories, then one-hot, median, assembly and scaling."""

    categories: tuple[Categories, ...]
    numeric: tuple[str, ...]
    stages: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        return self.stages.transform(self.indexed(df))

    def indexed(self, df: DataFrame) -> DataFrame:
        coded = add_codes(as_double(df, self.numeric), self.categories)
        return coded.withColumns({c.index: F.col(c.index).cast("double") for c in self.categories})

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.stages.write().overwrite().save(f"{path}/stages")
        rows = [(k, c.column, c.size, c.table is not None) for k, c in enumerate(self.categories)]
        columns = spark.createDataFrame(rows, "place INT, column STRING, size INT, has_table BOOLEAN")
        columns.coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
        numbers = spark.createDataFrame(list(enumerate(self.numeric)), "place INT, column STRING")
        numbers.coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers")
        for k, c in enumerate(self.categories):
            if c.table is not None:
                c.table.write.mode("overwrite").parquet(f"{path}/codes-{k}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Features:
        columns = spark.read.parquet(f"{path}/columns").orderBy("place").collect()
        numbers = spark.read.parquet(f"{path}/numbers").orderBy("place").collect()
        categories = [
            Categories(r["column"], r["size"], spark.read.parquet(f"{path}/codes-{r['place']}") if r["has_table"] else None)
            for r in columns
        ]
        return Features(tuple(categories), tuple(r["column"] for r in numbers), PipelineModel.load(f"{path}/stages"))


def fit_features(
    train: DataFrame,
    categorical: Sequence[str] = CATEGORICAL,
    numeric: Sequence[str] = NUMERIC,
    features: str = "features",
    center: bool = False,
    widths: Mapping[str, int] | None = None,
) -> Features:
    """Index, one-hot, impute, assemble and scale.

    Codes live in tables, so a column may have any number of values; one-hot vectors are sparse and need only the
    number of codes. NULL and unseen values are all zeros. ``widths`` names columns to hash into so many entries,
    where a model could not bear one entry per value.

    ``center=True`` also shifts every feature to mean 0, which turns the sparse
    one-hot vectors into dense ones. The shift changes neither tree splits nor,
    with an intercept, a linear fit, so it is off unless asked for.
    """
    categories = tuple(fit_categories(train, c, (widths or {}).get(c)) for c in categorical)
    empty = Features(categories, tuple(numeric), PipelineModel([]))
    hot = [f"{c}_ohe" for c in categorical]
    filled = [f"{c}_imp" for c in numeric]
    indexed = empty.indexed(train)
    encoder = OneHotEncoder(inputCols=[c.index for c in categories], outputCols=hot, handleInvalid="keep")
    # One row that has the last code of every column tells the encoder the sizes.
    sizes = train.sparkSession.range(1).select(*[F.lit(float(max(c.size - 1, 0))).alias(c.index) for c in categories])
    encoded = encoder.fit(sizes)
    rest = Pipeline(
        stages=[
            Imputer(inputCols=list(numeric), outputCols=filled, strategy="median"),
            VectorAssembler(inputCols=hot + filled, outputCol="raw_features", handleInvalid="keep"),
            StandardScaler(inputCol="raw_features", outputCol=features, withMean=center, withStd=True),
        ]
    ).fit(encoded.transform(indexed))
    return Features(categories, tuple(numeric), PipelineModel([encoded, *rest.stages]))


def score_features(model: Model, df: DataFrame, features: str = "features") -> DataFrame:
    """``model.transform`` on prepared features; the vectors of a forest are made dense for it, up to `DENSE_WIDTH`.

    Every node of every tree looks a feature up by its place, which is a search in a sparse vector. The values, and so
    the predictions, are the same; a linear model keeps sparse vectors, whose products skip the zeros.
    """
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if not hasattr(last, "trees") or last.numFeatures > DENSE_WIDTH:
        return model.transform(df)
    dense = df.withColumn(_DENSE, array_to_vector(vector_to_array(features)))
    return model.transform(dense, {last.featuresCol: _DENSE}).drop(_DENSE)


def as_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns if c in df.columns})


def prepare(fitted: Features, df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
    """Features computed once and written, so that no fold or grid point computes them again.

    Small sets are read in few tasks: a training step is a job of its own, of which there are thousands.
    """
    rows = stage(fitted.transform(df).select(*keep, features))
    return rows.coalesce(max(1, rows.count() // ROWS_PER_TASK))
