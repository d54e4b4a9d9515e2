"""Usage, prices and costs of model calls."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.hof import indices, let
from lectern.functions.text import estimate_usage_tokens

MILLION = 1_000_000


def usage_tokens(reported: Column, *texts: Column) -> Column:
    """Reported tokens, else the estimate over the given texts."""
    total = F.lit(0)
    for t in texts:
        total = total + estimate_usage_tokens(t)
    return F.coalesce(reported, total)


def to_currency(usd: Column, rate) -> Column:
    """Converted amount, null-safe."""
    return usd * F.lit(rate)


def call_cost(usage: DataFrame, prices: DataFrame, rate: float | None = None) -> DataFrame:
    """tokens/1e6 times price; an unknown price gives null, negative tokens count as zero.

    The total is null only when both parts are.  The price list is small; adaptive execution turns
    the join into a broadcast when its measured size allows.
    """
    out = usage.join(prices.select("model_name", "input_price_per_million_usd", "output_price_per_million_usd"),
                     "model_name", "left")
    clip = lambda c: F.greatest(F.lit(0), F.col(c))
    out = (out.withColumn("input_tokens", clip("input_tokens")).withColumn("output_tokens", clip("output_tokens"))
           .withColumn("input_cost_usd", F.col("input_tokens") / MILLION * F.col("input_price_per_million_usd"))
           .withColumn("output_cost_usd", F.col("output_tokens") / MILLION * F.col("output_price_per_million_usd")))
    zero = F.lit(0.0)
    out = out.withColumn("total_cost_usd", F.when(
        F.col("input_cost_usd").isNotNull() | F.col("output_cost_usd").isNotNull(),
        F.coalesce("input_cost_usd", zero) + F.coalesce("output_cost_usd", zero)))
    out = out.drop("input_price_per_million_usd", "output_price_per_million_usd")
    return out.withColumn("total_cost", to_currency(F.col("total_cost_usd"), rate)) if rate else out


def usage_snapshot(costed: DataFrame) -> DataFrame:
    """I16: totals per model and the last call; partial aggregates, so a hot model is no problem."""
    return costed.groupBy("model_name").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("total_cost_usd").alias("total_cost_usd"),
        F.max_by(F.struct("request_id", "input_tokens", "output_tokens"), F.struct("ts", "request_id")).alias("_l")
    ).select("model_name", "calls", "input_tokens", "output_tokens", "total_cost_usd",
             F.col("_l.request_id").alias("last_request_id"), F.col("_l.input_tokens").alias("last_input_tokens"),
             F.col("_l.output_tokens").alias("last_output_tokens"))


def usage_history(costed: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` calls, newest first (a distributed top-k, not a global sort)."""
    return costed.orderBy(F.desc("ts"), F.desc("request_id")).limit(n)


CATALOGUE = ("products map<string,struct<attributes:map<string,string>>>, terms struct<OnDemand:map<string,"
             "map<string,struct<priceDimensions:map<string,struct<description:string,"
             "pricePerUnit:map<string,string>>>>>>>")


def extract_prices(catalogues: DataFrame, raw: str = "catalogue", key: str = "catalogue_id") -> DataFrame:
    """Nested catalogue JSON -> one row per product: attributes, price per million and a score.

    A unit price "per 1K tokens" is multiplied by a thousand.  The standard tier scores 3 and
    on-demand inference 2.  Products meet their terms by one sort of a catalogue's entries, so a row carries its own
    term alone and nothing is shuffled.
    """
    doc = catalogues.select(key, F.from_json(raw, CATALOGUE).alias("c"))
    products, terms = F.map_entries("c.products"), F.map_entries("c.terms.OnDemand")
    first = lambda m: F.try_element_at(F.map_values(m), F.lit(1))
    term_type = "struct<description:string,pricePerUnit:map<string,string>>"
    attr_type = "struct<attributes:map<string,string>>"
    entries = F.concat(
        F.coalesce(F.transform(products, lambda e: F.struct(
            e["key"].alias("sku"), e["value"].alias("p"), F.lit(None).cast(term_type).alias("dim"),
            F.lit(True).alias("is_product"))), F.array()),
        F.coalesce(F.transform(terms, lambda e: F.struct(
            e["key"].alias("sku"), F.lit(None).cast(attr_type).alias("p"),
            first(first(e["value"])["priceDimensions"]).alias("dim"), F.lit(False).alias("is_product"))), F.array()))
    # maps have no order: sort by (sku, product first) alone
    order = lambda x, y: F.when(x["sku"] < y["sku"], -1).when(x["sku"] > y["sku"], 1).otherwise(
        y["is_product"].cast("int") - x["is_product"].cast("int"))
    met = let(F.array_sort(entries, order), lambda s: F.transform(
        F.filter(indices(s), lambda i: F.element_at(s, i)["is_product"]), lambda i: let(
            F.struct(F.element_at(s, i).alias("e"), F.try_element_at(s, i + 1).alias("next")), lambda v: F.struct(
                v["e"]["sku"].alias("sku"), v["e"]["p"].alias("p"),
                F.when(v["next"]["sku"] == v["e"]["sku"], v["next"]["dim"]).alias("dim")))))
    products = doc.select(key, F.explode(met).alias("_m")).select(key, "_m.sku", "_m.p", "_m.dim")
    dim = F.col("dim")
    attr = lambda k: F.try_element_at(F.col("p.attributes"), F.lit(k))
    low = lambda k: F.lower(F.trim(F.coalesce(attr(k), F.lit(""))))
    rows = products.select(
        key, "sku", attr("regionCode").alias("region"), attr("model").alias("model"),
        attr("servicename").alias("service_name"), attr("usagetype").alias("usage_type"),
        low("inferenceType").alias("inference_type"), low("feature").alias("feature"),
        low("service_tier").alias("service_tier"), F.lower(F.coalesce(dim["description"], F.lit(""))).alias("_d"),
        F.try_element_at(dim["pricePerUnit"], F.lit("USD")).alias("_usd"))
    per_thousand = F.col("_d").rlike("per 1k (input |output )?token")
    usd = F.nullif(F.col("_usd"), F.lit("")).try_cast("double")
    return rows.withColumn("price_per_million_usd", F.when(per_thousand, usd * 1000.0).otherwise(usd)).withColumn(
        "score", F.when(F.col("service_tier") == "standard", 3).otherwise(0)
        + F.when(F.col("feature") == "on-demand inference", 2).otherwise(0)).filter(
        F.col("price_per_million_usd").isNotNull()).drop("_d", "_usd")


def best_prices(candidates: DataFrame, region: str) -> DataFrame:
    """Standard prices of a region, the best-scored candidate per model and token kind."""
    ok = candidates.filter((F.col("region") == region) & F.col("inference_type").isin("input tokens", "output tokens")
                           & ((F.col("feature") == "on-demand inference") | (F.col("service_tier") == "standard")))
    best = ok.groupBy("model", "inference_type").agg(F.max_by(
        "price_per_million_usd", F.struct(F.col("score"), F.col("sku"))).alias("price"))
    price = lambda kind: F.max(F.when(F.col("inference_type") == kind, F.col("price")))
    return best.groupBy(F.col("model").alias("model_name")).agg(
        price("input tokens").alias("input_price_per_million_usd"),
        price("output tokens").alias("output_price_per_million_usd"))


def resolve_prices(models: DataFrame, live: DataFrame, fallback: DataFrame) -> DataFrame:
    """Live price, else fallback, else unavailable."""
    pick = ["model_name", "input_price_per_million_usd", "output_price_per_million_usd"]
    side = lambda df, p: df.select("model_name", *[F.col(c).alias(p + c) for c in pick[1:]],
                                   F.lit(True).alias(p))
    out = models.select("model_name").distinct().join(side(live, "l_"), "model_name", "left").join(
        side(fallback, "f_"), "model_name", "left")
    chosen = lambda c: F.when(F.col("l_"), F.col("l_" + c)).otherwise(F.col("f_" + c)).alias(c)
    return out.select("model_name", chosen(pick[1]), chosen(pick[2]), F.when(F.col("l_"), "live").when(
        F.col("f_"), "fallback").otherwise("unavailable").alias("source_status"))
