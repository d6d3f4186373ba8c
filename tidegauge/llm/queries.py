"""Queries of the problems solved in this package, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import model
from tidegauge.llm import language, mixing, nearest, packing, percentiles, tokens
from tidegauge.operators import validity

SETUP = "LYRA"
TOLERANCE_US = 20_000_000


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each spot check with the nearest reading with a value of its endpoint, at most 20 s away, or NULLs."""
    entries = validity.bound_entries(model.table(spark, d, "sensor_table"), SETUP)
    names = model.broadcast_if_small(nearest.endpoint_names(entries, model.table(spark, d, "endpoint_id_map"), SETUP))
    checks = model.table(spark, d, "spot_check").where("check_id is not null").dropDuplicates(["check_id"])
    checks = checks.withColumn("spelling", nearest.spelling(F.col("endpoint_name"), SETUP)).join(names, "spelling", "left")
    checks = checks.select("check_id", "endpoint", "checked_at", "value_ref")
    readings = model.table(spark, d, "numeric_data").where(model.has_value("value_raw")).select("endpoint_name", "timestamp", "reading_id", "value_raw")
    found = nearest.match_nearest(checks, readings, ("endpoint", "checked_at"), ("endpoint_name", "timestamp"), "reading_id", TOLERANCE_US)
    return found.select("check_id", "endpoint", "value_ref", "reading_id", "value_raw", "delta_us")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_checks(spark, d).where("reading_id is not null").select("check_id", "reading_id")


QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per endpoint and day (``day`` as a date's text) and over all days (``all``), these from the days' summaries."""
    days = percentiles.summarise(model.table(spark, d, "numeric_data"), "endpoint_name", "timestamp", "value_raw", "reading_id")
    model.checkpoint_dir(spark)
    days = days.checkpoint()
    daily = percentiles.percentiles(days, ["endpoint_name", "day"], QUANTILES)
    daily = daily.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).cast("string"))
    overall = percentiles.percentiles(percentiles.over_days(days, "endpoint_name"), ["endpoint_name"], QUANTILES).withColumn("day", F.lit("all"))
    return daily.unionByName(overall)


def p4_bound(spark: SparkSession, d: str) -> DataFrame:
    """Each percentile's true rank against its stated bound, with the exact count and extremes, per endpoint and day and overall."""
    found = p4_percentiles(spark, d)
    names = [c for c in found.columns if c[0] == "p" and c[1:].replace("_", "").isdigit()]
    r = model.table(spark, d, "numeric_data").where(model.has_value("value_raw")).where("endpoint_name is not null and timestamp is not null")
    r = r.select("reading_id", "endpoint_name", F.col("timestamp").cast("date").cast("string").alias("day"), "value_raw").distinct()
    r = r.withColumn("day", F.explode(F.array("day", F.lit("all")))).join(model.broadcast_if_small(found), ["endpoint_name", "day"])
    ranks = [c for p in names for c in (F.count_if(F.col("value_raw") < F.col(p)).alias(f"{p}_below"), F.count_if(F.col("value_raw") <= F.col(p)).alias(f"{p}_upto"))]
    r = r.groupBy("endpoint_name", "day", "n", "least", "most", "rank_error").agg(*ranks)

    def within(p: str, q: float):
        want, slack = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n") - 1e-9)), F.col("rank_error") * F.col("n") + 1e-6
        return ((F.col(f"{p}_below") + 1 - want <= slack) & (want - F.col(f"{p}_upto") <= slack)).alias(f"{p}_within")

    return r.select("endpoint_name", "day", "n", "least", "most", *(within(p, q) for p, q in zip(names, QUANTILES)))


TOKENIZER = tokens.DEFAULT_FILE
CAPACITY = 2048


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Containers of 2,048 tokens with their contents."""
    return packing.pack(model.table(spark, d, "documents"), CAPACITY, TOKENIZER)


def p7_space(spark: SparkSession, d: str) -> DataFrame:
    """How much of the containers' space is used, by the tokenizer named."""
    return packing.fill(p7_containers(spark, d), CAPACITY).withColumn("tokenizer", F.lit(os.path.basename(TOKENIZER)))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The containers' contents put together again: each document's pieces in order, decoded to its text, as a digest."""
    c = p7_containers(spark, d)
    item = F.explode(F.arrays_zip("doc_ids", "pieces", "starts", "lengths", F.sequence(F.lit(0), F.col("n_items") - 1).alias("no")))
    before = F.aggregate(F.slice("lengths", F.lit(1), F.col("i.no")), F.lit(0), lambda s, x: s + x)
    items = c.select("token_ids", "lengths", item.alias("i")).select(F.col("i.doc_ids").alias("doc_id"), F.col("i.pieces").alias("piece"), F.col("i.starts").alias("start"), F.slice("token_ids", before + 1, F.col("i.lengths")).alias("ids"))
    docs = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "start", "ids"))).alias("p"))
    apart = F.transform("p", lambda x, i: (x["piece"] == i) & (x["start"] == i * CAPACITY) & ((F.size(x["ids"]) == CAPACITY) | (i == F.size("p") - 1)))
    docs = docs.select("doc_id", F.forall(apart, lambda x: x).alias("in_order"), F.flatten("p.ids").alias("ids"))
    return docs.select("doc_id", "in_order", F.md5(tokens.decoder(TOKENIZER)("ids")).alias("digest"))


def p8_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The mixed corpus: documents with the number of copies and the share their source reaches."""
    model.checkpoint_dir(spark)
    counted = mixing.count_tokens(model.table(spark, d, "documents"), TOKENIZER).checkpoint()
    return mixing.mix(counted, model.table(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share, tokens, documents and most copies of each source."""
    return p8_corpus(spark, d).groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("reached_share").alias("reached_share"), F.sum(F.expr("copies * n_tokens")).alias("tokens"),
        F.count("*").alias("documents"), F.max("copies").alias("most_copies")).withColumn("tokenizer", F.lit(os.path.basename(TOKENIZER)))


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """Of each target: whether its documents exist and keep to its most repeats, and the share reached, to three places."""
    t = model.table(spark, d, "mix_target").where("source is not null and target_share > 0 and max_repeats > 0").select(mixing.source_key().alias("source"), "target_share", "max_repeats")
    used = p8_corpus(spark, d).groupBy("source").agg(F.max("copies").alias("most"), F.max("reached_share").alias("share"), F.count_distinct("doc_id").alias("ids"), F.count("*").alias("rows"))
    kept = (F.col("most") <= F.col("max_repeats")) & (F.col("ids") == F.col("rows"))
    return t.join(used, "source", "left").select("source", F.coalesce(kept, F.lit(True)).alias("kept"), F.round(F.coalesce("share", F.lit(0.0)), 3).alias("share"))


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, language.LanguageModel]:
    documents = model.table(spark, d, "documents")
    return documents, language.train(model.table(spark, d, "lang_sample"), documents)


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language or languages of each page with a text, whatever its label says."""
    documents, m = _documents(spark, d)
    return language.document_languages(documents, m)


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """Each stretch of a page in one language, with a confidence."""
    documents, m = _documents(spark, d)
    return language.segments(documents, m)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose label is missing or wrong or that are in several languages, one row per language."""
    documents, m = _documents(spark, d)
    return language.relabelled(documents, m).select("doc_id", "lang").distinct()


def p9_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Whether each page's stretches lie in its text, follow each other without overlap and bear confidences from 0 to 1."""
    s = p9_segments(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("segment", "start", "stop", "lang", "confidence"))).alias("s"))
    t = model.table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("size"))
    ordered = F.transform("s", lambda x, i: (x["segment"] == i) & (x["start"] < x["stop"]) & (x["stop"] <= F.col("size")) & ((i == 0) | (F.col("s")[i - 1]["stop"] <= x["start"])))
    changes = F.transform("s", lambda x, i: (i == 0) | (F.col("s")[i - 1]["lang"] != x["lang"]))
    sure = F.transform("s", lambda x: (x["confidence"] >= 0) & (x["confidence"] <= 1))
    every = lambda c: F.forall(c, lambda x: x)
    return s.join(t, "doc_id").select("doc_id", every(ordered).alias("in_text"), every(changes).alias("changes"), every(sure).alias("sure"))


QUERIES = {f.__name__: f for f in (p1_found, p1_checks, p4_percentiles, p4_bound, p7_containers, p7_space, p7_round_trip, p8_corpus, p8_shares, p8_limits, p9_found, p9_languages, p9_segments, p9_confidence)}

_SPELL = "regexp_replace(replace(lower(trim({0}, ' \t\n')), '.', '_'), '_lyra$', '')"
_P1 = f"""
bound as (
  select distinct entry_id, sensor_name, coalesce(nullif(trim(dripline_endpoint), ''), array_to_string(list_concat(
    [case when default_calibration like '%:%' then trim(split_part(default_calibration, ':', 1)) else split_part(sensor_name, '.', 1) end],
    (string_split(regexp_replace(sensor_name, '\\.{SETUP}$', '', 'i'), '.'))[2:]), '_')) as endpoint from sensor_table),
spelt as (
  select {_SPELL.format("endpoint")} as spelling, endpoint, 2 as own, 0 as votes from (select distinct endpoint_name as endpoint from endpoint_id_map union select endpoint from bound)
  union all select {_SPELL.format("sensor_name")}, endpoint, 1, count(*) from bound group by 1, 2),
names as (select spelling, max_by(endpoint, (own, votes, endpoint)) as endpoint from spelt group by 1),
checks as (select distinct check_id, endpoint, checked_at, value_ref from spot_check left join names on spelling = {_SPELL.format("endpoint_name")}),
read as (select distinct reading_id, endpoint_name, "timestamp" as t, value_raw from numeric_data where value_raw is not null and not isnan(value_raw)),
near as (
  select c.*, r.reading_id, r.value_raw, epoch_us(r.t) - epoch_us(c.checked_at) as delta_us from checks c
    asof left join read r on c.endpoint = r.endpoint_name and c.checked_at >= r.t
  union all select c.*, r.reading_id, r.value_raw, epoch_us(r.t) - epoch_us(c.checked_at) from checks c
    asof left join read r on c.endpoint = r.endpoint_name and c.checked_at <= r.t),
best as (select * from near where abs(delta_us) <= {TOLERANCE_US} qualify row_number() over (partition by check_id order by abs(delta_us), delta_us, reading_id) = 1)
"""
ORACLE = {
    "p1_found": f"with {_P1} select check_id, reading_id from best",
    "p4_bound": """with r as (select distinct reading_id, endpoint_name, "timestamp" as t, value_raw as v from numeric_data
        where value_raw is not null and not isnan(value_raw) and endpoint_name is not null and "timestamp" is not null),
      k as (select *, cast(cast(t as date) as varchar) as day from r union all select *, 'all' from r)
      select endpoint_name, day, count(*) as n, min(v) as least, max(v) as most, """
    + ", ".join(f"true as p{100 * q:g}_within" for q in QUANTILES)
    + " from k group by 1, 2",
    "p7_round_trip": "select doc_id, true as in_order, md5(text) as digest from documents where doc_id is not null and text <> ''",
    "p8_limits": r"""with t as (select lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) as source, target_share as share from mix_target where source is not null and target_share > 0 and max_repeats > 0),
      there as (select distinct lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) as source from documents where text <> '' and doc_id is not null)
      select source, true as kept, round(case when source in (select source from there) then share / (select sum(share) from t where source in (select source from there)) else 0 end, 3) as share from t""",
    "p9_confidence": r"select doc_id, true as in_text, true as changes, true as sure from documents where doc_id is not null and regexp_matches(text, '\S')",
    "p1_checks": f"with {_P1} select check_id, c.endpoint, c.value_ref, b.reading_id, b.value_raw, b.delta_us from checks c left join best b using (check_id)",
}
