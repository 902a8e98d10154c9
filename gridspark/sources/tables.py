"""Readers, writers and lookups of the input tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.contracts import CELL_SCHEMA, missing_columns
from gridspark.functions.scalars import canonical_key, name_from_file, norm_name, norm_support, title_name, to_bool, to_num
from gridspark.scope import AREA, Scope, attach

# Tag rule of each map layer (True: any value of the tag).
LAYER_RULES: dict[str, dict[str, object]] = {
    "buildings": {"building": True},
    "bus_stops": {"highway": "bus_stop"},
    "parks": {"leisure": "park"},
    "schools": {"amenity": ["school", "kindergarten"]},
    "hospitals": {"amenity": ["hospital", "clinic"]},
    "shops": {"shop": True},
}


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """S01. A folder with one CSV per area; the area key comes from the file name. Bad numbers become null."""
    raw = spark.read.schema(CELL_SCHEMA).option("header", True).option("enforceSchema", False).csv(path)
    keyed = raw.withColumns({"source_file": F.col("_metadata.file_name"), "area_key": name_from_file(F.col("_metadata.file_name"))})
    numbers = [f.name for f in CELL_SCHEMA.fields if f.name not in ("cell_id", "latitude", "longitude")]
    return keyed.withColumns({c: to_num(F.col(c)) for c in numbers})


def clean_totals(df: DataFrame) -> DataFrame:
    """S02. Structured totals: coerce, keep positive, largest value per key wins (mergeable)."""
    lost = missing_columns(df.columns, ("city_name", "normalized_city_name", "population"))
    if lost:
        raise ValueError(f"totals are missing columns: {lost}")
    good = df.withColumns(
        {"normalized_city_name": norm_name(F.col("normalized_city_name")), "population": to_num(F.col("population")).cast("long")}
    ).where(F.col("normalized_city_name").isNotNull() & (F.col("population") > 0))
    rest = [c for c in good.columns if c != "normalized_city_name"]
    picked = good.groupBy("normalized_city_name").agg(F.max_by(F.struct(*rest), F.struct("population", "city_name")).alias("_r"))
    return picked.select("normalized_city_name", "_r.*")


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    return clean_totals(spark.read.option("header", True).csv(path))


def parse_total_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S03. Malformed ``city,population`` lines (``line_no, line``) to totals and rejected lines with a reason."""
    text = F.translate(F.regexp_replace(F.trim("line"), r'^"+|"+$', ""), "\t", "")
    parts = lines.where(F.trim("line") != "").withColumn("_t", text)
    number = F.regexp_replace(F.regexp_extract("_t", r"^(.*),([^,]*)$", 2), r'[\s"]', "")
    value = F.floor(number.try_cast("double")).cast("long")
    parsed = parts.withColumns(
        {"city_name": F.trim(F.regexp_extract("_t", r"^(.*),([^,]*)$", 1)), "population": F.when(value > 0, value)}
    ).withColumn("normalized_city_name", norm_name(F.col("city_name")))
    reason = (
        F.when(~F.contains("_t", F.lit(",")), "could not split city/population")
        .when(F.col("normalized_city_name") == "", "empty city name")
        .when(F.col("population").isNull(), "invalid or non-positive population")
    )
    judged = parsed.withColumn("reason", reason)
    best = F.max_by("city_name", F.struct("population", -F.col("line_no"))).alias("city_name")
    good = judged.where(F.col("reason").isNull()).groupBy("normalized_city_name").agg(best, F.max("population").alias("population"))
    return good, judged.where(F.col("reason").isNotNull()).select("line_no", "line", "reason")


def read_totals_lenient(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S03 from a file. Line numbers need the whole (small) totals file as one value; the header is dropped."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("_i", "line")).where("_i > 0")
    return parse_total_lines(lines.select((F.col("_i") + 1).alias("line_no"), "line"))


def with_total(cells: DataFrame, totals: DataFrame, on_missing: str = "error", scope: Scope = AREA) -> DataFrame:
    """S04. Attach the official total; areas without one raise, are dropped, or keep a null."""
    if on_missing == "error":
        lost = missing_totals(cells, totals, scope).limit(5).collect()
        if lost:
            raise ValueError(f"no official total for {[tuple(r) for r in lost]}")
    return attach(cells, totals, scope, "left" if on_missing == "keep" else "inner")


def missing_totals(cells: DataFrame, totals: DataFrame, scope: Scope = AREA) -> DataFrame:
    return cells.select(*scope.keys).distinct().join(totals.select(*scope.keys), list(scope.keys), "left_anti")


def clean_districts(df: DataFrame) -> DataFrame:
    """S05. District reference: required columns, normal names, numeric total, flag, match tokens as array."""
    lost = missing_columns(df.columns, ("city_name", "district_name", "district_query", "official_population", "use_in_metrics"))
    if lost:
        raise ValueError(f"district reference is missing columns: {lost}")
    out = df.withColumns(
        {
            "normalized_city_name": norm_name(F.col("city_name")),
            "normalized_district_name": norm_name(F.col("district_name")),
            "official_population": to_num(F.col("official_population")),
            "use_in_metrics": to_bool(F.col("use_in_metrics")),
        }
    )
    if "match_tokens" in df.columns:
        out = out.withColumn("match_tokens", F.filter(F.split(F.coalesce("match_tokens", F.lit("")), r"\|"), lambda t: F.trim(t) != ""))
    return out


def read_districts(spark: SparkSession, path: str) -> DataFrame:
    return clean_districts(spark.read.option("header", True).csv(path))


# Boolean columns of the status registry.
REGISTRY_FLAGS = (
    "verified",
    "official_total_available",
    "supported_for_calibrated_inference",
    "feature_generated",
    "qa_passed",
    "included_in_training",
    "validated_batch",
    "smoke_passed",
    "saved_inference_example",
    "district_benchmark_reference_available",
    "district_benchmark_completed",
    "recommended_for_baseline_use",
)


def clean_registry(df: DataFrame) -> DataFrame:
    """S06. Registry with real booleans."""
    return df.withColumns({c: to_bool(F.col(c)) for c in REGISTRY_FLAGS if c in df.columns})


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return clean_registry(spark.read.option("header", True).csv(path))


def attach_geometry(attrs: DataFrame, geoms: DataFrame, keys: Sequence[str] = ("area_id", "cell_id")) -> tuple[DataFrame, DataFrame]:
    """S07. Left join of geometry by cell, and the check row: duplicate keys and cells without geometry."""
    keys = list(keys)
    joined = attrs.join(geoms, keys, "left")
    dup = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).agg(F.coalesce(F.sum(F.col("_m") - 1), F.lit(0)).alias(n))
    column = next(c for c in geoms.columns if c not in keys)
    empty = joined.agg(F.count_if(F.col(column).isNull()).alias("missing_geometry"))
    check = empty.crossJoin(F.broadcast(dup(attrs, "duplicate_attribute_keys"))).crossJoin(F.broadcast(dup(geoms, "duplicate_geometry_keys")))
    return joined, check


def rule_condition(rule: Mapping[str, object], tags: Column) -> Column:
    """True: tag present; a value: equal; a list: one of."""
    cond = F.lit(False)
    for key, wanted in rule.items():
        value = tags[key]
        if wanted is True:
            cond = cond | value.isNotNull()
        elif isinstance(wanted, (list, tuple)):
            cond = cond | F.coalesce(value.isin(*wanted), F.lit(False))
        else:
            cond = cond | F.coalesce(value == F.lit(wanted), F.lit(False))
    return cond


def layer(objects: DataFrame, rule: Mapping[str, object]) -> DataFrame:
    """S08. Objects of one layer; rows without geometry are dropped."""
    return objects.where(F.col("geom").isNotNull() & rule_condition(rule, F.col("tags")))


def label_layers(objects: DataFrame, rules: Mapping[str, Mapping[str, object]] = LAYER_RULES) -> DataFrame:
    """S08 for all layers in one pass: an object gets one row per layer it belongs to."""
    names = F.array_compact(F.array(*[F.when(rule_condition(r, F.col("tags")), F.lit(n)) for n, r in rules.items()]))
    return objects.where(F.col("geom").isNotNull()).withColumn("layer", F.explode(names))


def extract_totals(rows: DataFrame, rules: DataFrame, manual: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """S09. Totals from statistics rows, and warnings.

    ``rows`` has ``source_id, row_no, label, value``; ``rules`` ``source_id, area_key, terms ARRAY``. The
    first row (by number) whose label holds a term decides; its rounded value must be positive.
    """
    joined = rows.join(rules.withColumn("term", F.explode("terms")), "source_id")
    hit = joined.where(F.contains(F.lower("label"), F.lower("term")))
    first = hit.groupBy("source_id", "area_key").agg(F.min_by(F.struct("label", "value"), "row_no").alias("_r"))
    value = F.bround(to_num(F.col("_r.value"))).cast("long")
    judged = rules.select("source_id", "area_key").join(first, ["source_id", "area_key"], "left").withColumns(
        {"population": F.when(value > 0, value), "matched_label": F.trim("_r.label")}
    )
    good = judged.where(F.col("population").isNotNull()).select("area_key", "population", "matched_label")
    if manual is not None:
        good = manual.select("area_key", "population", "matched_label").unionByName(good)
    reason = F.when(F.col("_r").isNull(), "no matching row").otherwise("population was invalid")
    return good, judged.where(F.col("population").isNull()).select("source_id", "area_key", reason.alias("warning"))


OPTION_PATTERN = r'(?is)<option[^>]*\bvalue="([^"]*)"[^>]*>(.*?)</option>'


def extract_options(pages: DataFrame, district_token: str, population_tokens: Sequence[str], html: str = "html") -> DataFrame:
    """S10. ``<option>`` value/label pairs of pages whose label has the district and a population token."""
    ids = F.regexp_extract_all(F.col(html), F.lit(OPTION_PATTERN), 1)
    labels = F.regexp_extract_all(F.col(html), F.lit(OPTION_PATTERN), 2)
    pair = pages.drop(html).columns
    rows = pages.select(*pair, F.explode(F.arrays_zip(ids.alias("i"), labels.alias("l"))).alias("_o"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("_o.l", r"<[^>]*>", " "), r"\s+", " "))
    out = rows.select(*pair, F.trim("_o.i").alias("option_id"), clean.alias("option_label")).where((F.col("option_id") != "") & (F.col("option_label") != ""))
    low = F.lower("option_label")
    any_token = F.exists(F.array(*[F.lit(t) for t in population_tokens]), lambda t: F.contains(low, t))
    return out.where(F.contains(low, F.lit(district_token)) & any_token)


def write_surface(df: DataFrame, path: str, geom: str | None = "geom", key: str = "area_id") -> None:
    """S11. CSV of the attributes and GeoJSON features as text, both partitioned by area."""
    attrs = [c for c in df.columns if c != geom]
    df.select(*attrs).write.mode("overwrite").partitionBy(key).option("header", True).csv(f"{path}/csv")
    if geom is None or geom not in df.columns:
        return
    ring = F.transform(F.col(geom), lambda p: F.array(p["x"], p["y"]))
    closed = F.concat(ring, F.slice(ring, 1, 1))
    feature = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")).alias("geometry"),
            F.struct(*attrs).alias("properties"),
        )
    )
    df.select(key, feature.alias("value")).write.mode("overwrite").partitionBy(key).text(f"{path}/geojson")


def upsert_summary(old: DataFrame | None, new: DataFrame, key: str = "area_slug", columns: Sequence[str] | None = None) -> DataFrame:
    """S12. New rows replace those of the same key; fixed columns and order."""
    columns = list(columns or new.columns)
    merged = new if old is None else old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
    have = set(merged.columns)
    return merged.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in columns])


def read_runs(spark: SparkSession, path: str, fmt: str = "parquet", areas: DataFrame | None = None, scope: Scope = AREA) -> DataFrame:
    """S15. All per-area results under a folder in one read, tagged with their file; optionally some areas."""
    runs = spark.read.option("header", True).format(fmt).load(path).withColumn("source_path", F.col("_metadata.file_path"))
    return runs if areas is None else runs.join(areas.select(*scope.keys), list(scope.keys), "left_semi")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """S16. Question bank CSV; a byte-order mark on the first column name is dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    return raw.toDF(*[c.lstrip("﻿") for c in raw.columns])


# Internal support by district benchmark quality.
QUALITY_SUPPORT = {"strong": 0.75, "partial": 0.55, "mixed": 0.50}


def with_context(df: DataFrame, registry: DataFrame, completeness: DataFrame, scope: Scope = AREA) -> DataFrame:
    """S17. Display name, completeness support and label, internal support; defaults where a table is silent.

    A registry row of any other quality than the known ones scores 0.40 (so "full" does too, as published).
    """
    table = F.create_map(*[F.lit(x) for kv in QUALITY_SUPPORT.items() for x in kv])
    quality = F.lower(F.trim(F.coalesce("district_benchmark_quality", F.lit("none"))))
    reg = registry.select(*scope.keys, F.col("area_name").alias("_name"), F.coalesce(table[quality], F.lit(0.40)).alias("_sup"))
    com = completeness.select(*scope.keys, norm_support(F.col("completeness_score")).alias("_score"), F.col("completeness_label").alias("_label"))
    joined = attach(attach(df, reg, scope), com, scope)
    return joined.withColumns(
        {
            "display_name": F.coalesce("_name", title_name(F.col(scope.keys[0]).cast("string"))),
            "completeness_support": F.coalesce("_score", F.lit(0.0)),
            "completeness_label": F.coalesce("_label", F.lit("unknown")),
            "internal_support_score": F.coalesce("_sup", F.lit(0.50)),
        }
    ).drop("_name", "_sup", "_score", "_label")


def resolve_alias(areas: DataFrame, available: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S19. First alias (in list order) that has data, per area, and the areas with none."""
    tried = areas.select("area_id", F.posexplode("aliases").alias("_pos", "alias"))
    hit = tried.join(available.select("alias").distinct(), "alias").groupBy("area_id").agg(F.min_by("alias", "_pos").alias("alias"))
    return hit, areas.join(hit, "area_id", "left_anti").select("area_id")


def find_surface(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """S20. First path (sorted) per wanted ``area_slug, model_suffix`` in a listing of ``area_slug, model, path``."""
    joined = wanted.join(listing, "area_slug", "left").where(F.col("path").isNull() | F.endswith("model", F.col("model_suffix")))
    found = joined.groupBy("area_slug", "model_suffix").agg(F.min("path").alias("path"))
    return wanted.join(found, ["area_slug", "model_suffix"], "left")


def tag_run(df: DataFrame, run_id: str) -> DataFrame:
    """S21. Run id as first column."""
    return df.drop("run_id").select(F.lit(run_id).alias("run_id"), *[c for c in df.columns if c != "run_id"])


def attach_display(features: DataFrame, surface: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("area_id", "cell_id")) -> DataFrame:
    """S21. Display fields on features by cell."""
    return features.join(surface.select(*keys, *fields), list(keys), "left")
