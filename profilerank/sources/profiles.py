"""Profile sources: JSON lines (plain or gzip) and Parquet, batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from profilerank.schema import CORRUPT, profile_schema


def _is_parquet(path: str, fmt: str | None) -> bool:
    return (fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "json")) == "parquet"


def _with_doubles(kind: T.DataType) -> T.DataType:
    """The type with whole numbers as doubles: JSON may write 30 as 30.0."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _with_doubles(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_with_doubles(kind.elementType))
    return T.DoubleType() if isinstance(kind, T.IntegerType) else kind


def _json_schema(signals_field: str) -> T.StructType:
    return _with_doubles(profile_schema(signals_field)).add(CORRUPT, T.StringType())


def _typed(raw: DataFrame, signals_field: str, more: list[str] | None = None) -> DataFrame:
    """Records read by ``_json_schema`` in the types of the profile schema; parts of whole numbers are cut."""
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in profile_schema(signals_field).fields],
                      *(more or []), CORRUPT)


def read_profiles(spark: SparkSession, path: str, signals_field: str = "signals",
                  fmt: str | None = None, spread: int | None = None) -> DataFrame:
    """Read profile records as they are, with unparsable lines kept in ``_corrupt``.

    The codec follows from the file suffix.  A gzip file cannot be split and
    arrives as one partition, so input with such files is spread over ``spread``
    partitions (default: ``spark.sql.shuffle.partitions``) before any work.
    """
    if _is_parquet(path, fmt):
        return (spark.read.schema(profile_schema(signals_field)).parquet(path)
                .withColumn(CORRUPT, F.lit(None).cast("string")))
    raw = (spark.read.schema(_json_schema(signals_field))
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
           .json(path))
    if spread or any(f.endswith(".gz") for f in raw.inputFiles()):
        raw = raw.repartition(spread or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _typed(raw, signals_field)


def stream_profiles(spark: SparkSession, path: str, signals_field: str = "signals",
                    fmt: str | None = None, files_per_batch: int | None = None, extra: str = "") -> DataFrame:
    """The same source as a stream over the files arriving below ``path``.

    ``extra`` names further columns of the records, as ``"version int"``.
    """
    more = T.StructType.fromDDL(extra).fields if extra else []
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if _is_parquet(path, fmt):
        return (reader.schema(T.StructType([*profile_schema(signals_field).fields, *more])).parquet(path)
                .withColumn(CORRUPT, F.lit(None).cast("string")))
    raw = (reader.schema(T.StructType([*_json_schema(signals_field).fields, *more]))
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path))
    return _typed(raw, signals_field, [f.name for f in more])


def accepted(raw: DataFrame) -> DataFrame:
    """Records with an id.  A line that is no JSON object has none; a record with
    one badly typed field keeps its id and its other fields."""
    return raw.filter(F.col("candidate_id").isNotNull())


def reject_counts(raw: DataFrame) -> list[Column]:
    """Counts: lines read, records accepted, lines rejected, records with a badly typed field, records with every part present.

    The last count also makes the reader parse every part: a bad field only
    shows if its column is read.
    """
    no_id = F.col("candidate_id").isNull()
    bad = F.col(CORRUPT).isNotNull()
    complete = ~no_id
    for name in raw.columns:
        if name != CORRUPT:
            complete = complete & F.col(name).isNotNull()
    return [
        F.count("*").alias("lines"),
        F.count_if(~no_id).alias("accepted"),
        F.count_if(no_id).alias("rejected"),
        F.count_if(~no_id & bad).alias("partly_read"),
        F.count_if(complete).alias("complete"),
    ]


def reject_report(raw: DataFrame) -> DataFrame:
    """One row of ``reject_counts``, by a pass of its own."""
    return raw.agg(*reject_counts(raw))


def observed(raw: DataFrame, watch: Observation | str = "rejects") -> DataFrame:
    """``raw``, whose ``reject_counts`` are taken in the pass that reads it.

    A batch gives them to the observation; a stream of every micro-batch to ``observedMetrics`` of its progress.
    """
    return raw.observe(watch, *reject_counts(raw))


def keep_last(df: DataFrame, order: list[str], key: str = "candidate_id") -> DataFrame:
    """Exactly one record per key: the one that is last by the ``order`` columns.

    Null is before every other value, and null keys are one key.  Of records that tie
    on all order columns the one with the largest hash of its fields is taken.
    The aggregation combines on the map side, so a key held by a third of all
    rows sends one record of each task.
    """
    hashed = [c for c, kind in df.dtypes if "map<" not in kind]
    place = F.struct(*order, F.xxhash64(*hashed).alias("_hash"))
    names = df.columns
    return (df.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*names), place).alias("_last"))
            .select(*[F.col("_last")[c].alias(c) for c in names]))


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _flag(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def _list(name: str) -> Column:
    return F.filter(F.coalesce(F.col(name), F.array()), lambda x: x.isNotNull())


def normalise(raw: DataFrame, signals_field: str = "signals", keep: tuple[str, ...] = ()) -> DataFrame:
    """Flatten a profile record and fill in the default of every missing field.

    A null counts as missing.  Willingness to relocate stays nullable because
    its default depends on who asks (no for the gate, yes for the explanation).
    """
    head, sig = F.col("profile"), F.col(signals_field)

    def job(j, pos):
        return F.struct(
            pos.alias("pos"), _text(j["title"]).alias("title"),
            _text(j["description"]).alias("description"),
            _text(j["company"]).alias("company"), _text(j["industry"]).alias("industry"),
            _text(j["company_size"]).alias("company_size"),
            _text(j["start_date"]).alias("start_date"), _text(j["end_date"]).alias("end_date"),
            F.coalesce(j["duration_months"], F.lit(0)).alias("months"),
            _flag(j["is_current"]).alias("is_current"))

    def skill(s):
        return F.struct(
            _text(s["name"]).alias("name"), s["proficiency"].alias("proficiency"),
            F.coalesce(s["duration_months"], F.lit(0)).alias("months"),
            F.coalesce(s["endorsements"], F.lit(0)).alias("endorsements"))

    salary = sig["expected_salary_range_inr_lpa"]
    return raw.select(
        F.col("candidate_id"),
        *keep,
        _text(head["summary"]).alias("summary"),
        _text(head["headline"]).alias("headline"),
        head["current_title"].alias("current_title"),
        _text(head["country"]).alias("country"),
        _text(head["location"]).alias("location"),
        F.coalesce(head["years_of_experience"], F.lit(0.0)).alias("years"),
        F.transform(_list("career_history"), job).alias("jobs"),
        F.transform(_list("skills"), skill).alias("skills"),
        F.transform(_list("certifications"), lambda c: _text(c["name"])).alias("certificates"),
        sig["skill_assessment_scores"].alias("assessed"),
        sig["willing_to_relocate"].alias("relocate"),
        _flag(sig["open_to_work_flag"]).alias("open_to_work"),
        _text(sig["last_active_date"]).alias("last_active"),
        _text(sig["signup_date"]).alias("signup"),
        F.coalesce(sig["notice_period_days"], F.lit(90)).alias("notice_days"),
        F.coalesce(sig["recruiter_response_rate"], F.lit(0.0)).alias("response_rate"),
        F.coalesce(sig["interview_completion_rate"], F.lit(0.0)).alias("completion_rate"),
        F.coalesce(sig["github_activity_score"], F.lit(-1.0)).alias("github"),
        (_flag(sig["verified_email"]) | _flag(sig["verified_phone"])).alias("verified"),
        F.coalesce(salary["min"], F.lit(0.0)).alias("salary_min"),
        F.coalesce(salary["max"], F.lit(0.0)).alias("salary_max"),
    )
