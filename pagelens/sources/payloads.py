"""Crawl payloads: JSON text of any envelope to one row per crawl record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.sources import records as R

def read_payloads(df: DataFrame) -> DataFrame:
    """``payloads(request_id, target_urls, raw)`` with the text read as VARIANT.

    Missing or empty text becomes an empty object. Unreadable text becomes an
    object whose ``raw`` field holds all of it, also given in ``corrupt_text``.
    """
    text = F.when(F.coalesce(F.length("raw"), F.lit(0)) == 0, F.lit("{}")).otherwise(F.col("raw"))
    parsed = F.try_parse_json(text)
    corrupt = F.to_variant_object(F.struct(F.col("raw")))
    # The number of result keys in the text bounds how deep the envelope can nest.
    depth = F.coalesce(F.regexp_count("raw", F.lit('"results?"')), F.lit(0))
    return (
        df.withColumn("parsed", parsed)
        .withColumn("corrupt_text", F.when(F.col("parsed").isNull(), F.col("raw")))
        .withColumn("envelope_depth", depth)
        .withColumn("payload", F.coalesce("parsed", corrupt))
        .drop("parsed")
    )


def _present(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v)


def _unwrap(payload: Column, depth: Column) -> Column:
    """Follow ``results``, else ``result``, as long as the value is an object holding one."""

    def step(value: Column, _: Column) -> Column:
        results = F.try_variant_get(value, "$.results", "variant")
        result = F.try_variant_get(value, "$.result", "variant")
        return F.when(_present(results), results).when(_present(result), result).otherwise(value)

    return F.aggregate(F.array_repeat(F.lit(0), depth), payload, step)


def _items(content: Column) -> Column:
    """The content itself, or its array items with one level of nesting opened."""

    def opened(x: Column) -> Column:
        return F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))

    listed = F.flatten(F.transform(F.try_variant_get(content, "$", "array<variant>"), opened))
    return F.coalesce(listed, F.array(content))


def crawl_records(
    payloads: DataFrame,
    view: str = "bulk",
    fallback: str = "filtered_index",
    fields: tuple[str, ...] | None = None,
) -> DataFrame:
    """One typed row per record that the named view accepts.

    Holds the header and the fields the view reads; ``fields`` names others.

    Everything happens inside the payload's own row, so nothing is shuffled, and
    the record position counts the kept records of that payload.

    ``fallback`` picks the target URL used for a record without its own URL:
    ``filtered_index`` takes it by the position among the kept records,
    ``ordinal`` by the position in the whole payload.
    """
    opened = payloads.select(
        "request_id", "target_urls", _items(_unwrap(F.col("payload"), F.col("envelope_depth"))).alias("items")
    )
    numbered = F.filter(
        F.transform(F.col("items"), lambda x, i: F.struct(x.alias("record"), i.alias("ordinal"))),
        lambda item: R.is_object(item["record"]) & R.PREDICATES[view](R.VariantFields(item["record"])),
    )
    rows = opened.select("request_id", "target_urls", F.posexplode(numbered).alias("record_pos", "item"))
    index = F.col("record_pos") if fallback == "filtered_index" else F.col("item.ordinal")
    record = R.VariantFields(F.col("item.record"))
    wanted = dict.fromkeys((*R.HEADER_FIELDS, *(R.FIELDS[view] if fields is None else fields)))
    return rows.select(
        "request_id",
        F.get("target_urls", F.lit(0)).alias("target"),
        "record_pos",
        F.get("target_urls", index).alias("fallback_url"),
        *[record[name].alias(name) for name in wanted],
    )
