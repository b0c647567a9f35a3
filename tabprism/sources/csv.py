"""CSV source and sink (A1, A3, A4).

Reading keeps pandas' missing-value semantics: the whole file is read as
text, every pandas NA token becomes NULL, then each column gets the narrowest
of boolean / long / double / string that all its non-missing values parse as
— decided for all columns in a single aggregate pass, then applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from tabprism.functions.expressions import NUMBER

# The strings pandas.read_csv reads as booleans by default.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

# The strings pandas.read_csv treats as missing by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]


def _na_to_null(c: str):
    v = F.col(c)
    return F.when(v.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(v)


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None,
             missing_ok: bool = False, multi_line: bool = False) -> DataFrame | None:
    """Header CSV → DataFrame; NA tokens → NULL; types from ``schema`` or inferred.

    With ``missing_ok`` a path that does not exist gives ``None`` (callers then
    skip their work, as the reference's loader does) instead of an error.
    Quotes inside quoted text are doubled, as pandas writes them.
    ``multi_line`` allows line breaks inside quotes; such a file is read by one
    task, so large data should come in many files.
    """
    try:
        raw = (spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"')
               .option("multiLine", multi_line).csv(path))
    except AnalysisException:
        if missing_ok:
            return None
        raise
    raw = raw.select(*[_na_to_null(c).alias(c) for c in raw.columns])
    if schema is not None:
        return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    cols = raw.columns
    checks = []
    for i, c in enumerate(cols):
        d = F.when(F.col(c).rlike(NUMBER), F.col(c).try_cast("double"))
        lg = F.col(c).try_cast("long")
        b = F.when(F.col(c).isin(*TRUE_TOKENS, *FALSE_TOKENS), F.lit(1))
        checks += [F.count(F.col(c)).alias(f"_n{i}"), F.count(d).alias(f"_d{i}"),
                   F.count(lg).alias(f"_l{i}"), F.count(b).alias(f"_b{i}")]
    row = raw.agg(*checks).first() if cols else None
    out = []
    for i, c in enumerate(cols):
        n, nd, nl, nb = row[f"_n{i}"], row[f"_d{i}"], row[f"_l{i}"], row[f"_b{i}"]
        if n > 0 and nb == n:
            out.append(F.col(c).isin(*TRUE_TOKENS).alias(c))
        elif n > 0 and nl == n:
            out.append(F.col(c).try_cast("long").alias(c))
        elif nd == n:                      # includes all-missing columns (pandas: float64)
            out.append(F.col(c).try_cast("double").alias(c))
        else:
            out.append(F.col(c))
    return raw.select(*out)


#: timestamps keep microseconds (Spark's CSV defaults stop at milliseconds),
#: for zoned and zone-less (NTZ) timestamps alike
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
TIMESTAMP_NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Distributed part files with a header; nothing passes through the driver."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("timestampFormat", TIMESTAMP_FORMAT)
     .option("timestampNTZFormat", TIMESTAMP_NTZ_FORMAT).csv(path))
    return path
