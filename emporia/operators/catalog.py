"""Catalogue jobs: document, three-way variant merge, duplicates, feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (MONEY, UPDATE_INITIAL_QUANTITY, WARMUP_INITIAL_QUANTITY, active_default,
                                 image_fallback, patch, price_fallback)


def catalog_document(product: DataFrame, variant: DataFrame, image: DataFrame) -> DataFrame:
    """Product ⟕ variant ⟕ image, flattened (one row per gallery image;
    nulls where a level is empty). Two equi left joins; the nested form is
    this result grouped back, which we leave to the reader of the rows."""
    v = variant.select("product_id", "sku", "color", "size", F.col("price").alias("variant_price"),
                       F.col("image_url").alias("variant_image"), "is_active")
    p = product.select("product_id", "name", "category", "base_price", F.col("image_url").alias("product_image"))
    return (p.join(v, "product_id", "left").join(image.withColumnRenamed("url", "gallery_url"), "sku", "left")
            .select("product_id", "name", "category", "base_price", "product_image", "sku", "color", "size",
                    "variant_price", "variant_image", "is_active", "gallery_url"))


PATCHED = ["name", "category", "base_price", "image_url"]


def product_patch(product: DataFrame, product_req: DataFrame) -> DataFrame:
    """The product after an update: each field that the request carries
    replaces the stored one, a missing field leaves it. Products without a
    request stay as they are."""
    req = product_req.select("product_id", *[F.col(c).alias(f"_{c}") for c in PATCHED])
    return product.join(req, "product_id", "left").select(
        "product_id", *[patch(F.col(f"_{c}"), F.col(c)).cast(product.schema[c].dataType).alias(c) for c in PATCHED])


def galleries(image: DataFrame) -> DataFrame:
    """(sku, gallery): a variant's image addresses in order; as many as the
    variant has images."""
    return image.groupBy("sku").agg(F.sort_array(F.collect_list("url")).alias("gallery"))


def variant_merge(product: DataFrame, product_req: DataFrame, stored: DataFrame, req: DataFrame,
                  image: DataFrame) -> DataFrame:
    """D7 (+G2, G3, I5, C2, C3, C5, C6): three-way merge of a product's variants.

    The product's own fields are patched first. Then, per product that
    receives an update: a request with a *null* variant list keeps every
    stored variant (KEEP); otherwise by SKU: in both -> UPDATE, only requested
    -> INSERT, only stored -> DELETE. New values take the request's fields with
    price falling back to the product's (patched) base price, image to the
    product's image, active to true. A gallery in the request replaces the
    stored one, an empty one clears it, a null one keeps it. One full outer
    join on (product, SKU).
    """
    patched = product_patch(product, product_req).select("product_id", "base_price", F.col("image_url").alias("p_image"))
    pr = product_req.select("product_id", "has_list").join(patched, "product_id")
    s = (stored.join(galleries(image), "sku", "left").join(pr.select("product_id"), "product_id", "left_semi")
         .select("product_id", "sku", F.struct("color", "size", "price", "image_url", "is_active", "gallery").alias("old")))
    r = (req.join(pr.select("product_id"), "product_id", "left_semi")
         .select("product_id", "sku", F.struct("color", "size", "price", "image_url", "is_active", "gallery").alias("new")))
    j = s.join(r, ["product_id", "sku"], "full_outer").join(pr, "product_id", "left")
    action = (F.when(~F.col("has_list"), F.lit("KEEP"))
              .when(F.col("old").isNotNull() & F.col("new").isNotNull(), F.lit("UPDATE"))
              .when(F.col("new").isNotNull(), F.lit("INSERT"))
              .otherwise(F.lit("DELETE")))
    write = F.col("action").isin("UPDATE", "INSERT")
    none = F.array().cast("array<string>")
    gallery = F.when(write, F.coalesce("new.gallery", "old.gallery", none)).otherwise(F.coalesce("old.gallery", none))
    return j.withColumn("action", action).select(
        "product_id", "sku", "action",
        F.when(write, F.col("new.color")).otherwise(F.col("old.color")).alias("color"),
        F.when(write, F.col("new.size")).otherwise(F.col("old.size")).alias("size"),
        F.when(write, price_fallback(F.col("new.price"), F.col("base_price")))
         .otherwise(F.col("old.price").cast(MONEY)).alias("price"),
        F.when(write, image_fallback(F.col("new.image_url"), F.col("p_image")))
         .otherwise(F.col("old.image_url")).alias("image_url"),
        F.when(write, active_default(F.col("new.is_active"))).otherwise(F.col("old.is_active")).alias("is_active"),
        gallery.alias("gallery"))


def duplicate_sku(variants: DataFrame) -> DataFrame:
    """A SKU twice in one product's variant list (the unique-key map
    build fails on it)."""
    return (variants.groupBy("product_id", "sku").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .filter(F.col("n") > 1))


def catalog_feed(product: DataFrame, variant: DataFrame, initial_quantity: int = WARMUP_INITIAL_QUANTITY) -> DataFrame:
    """I2 (+B7, C2, C3): per variant one cache row and one stock-created row.

    Warm-up sends 1000 per variant (and *adds* it each time); an update
    sends 0. Products without variants send nothing (inner join = explode,
    not explode_outer).
    """
    p = product.select("product_id", F.col("name"), "base_price", F.col("image_url").alias("p_image"))
    j = variant.join(p, "product_id")
    cache = j.select(F.lit("cache").alias("feed"), "sku", "name",
                     price_fallback(F.col("price"), F.col("base_price")).alias("price"),
                     image_fallback(F.col("image_url"), F.col("p_image")).alias("image_url"), "color", "size",
                     F.lit(None).cast("int").alias("initial_quantity"))
    created = j.select(F.lit("created").alias("feed"), "sku", F.lit(None).cast("string").alias("name"),
                       F.lit(None).cast(MONEY).alias("price"), F.lit(None).cast("string").alias("image_url"),
                       F.lit(None).cast("string").alias("color"), F.lit(None).cast("string").alias("size"),
                       F.lit(initial_quantity).cast("int").alias("initial_quantity"))
    return cache.unionByName(created)


def create_feed(product: DataFrame, requested: DataFrame) -> DataFrame:
    """I2 at product creation: per requested variant a cache row and a
    stock-created row with the requested initial quantity. Unlike warm-up and
    update, the cache row carries the variant's own image with no fallback to
    the product image (the price still falls back to the base price)."""
    p = product.select("product_id", "name", "base_price")
    j = requested.join(p, "product_id")
    cache = j.select(F.lit("cache").alias("feed"), "sku", "name",
                     price_fallback(F.col("price"), F.col("base_price")).alias("price"),
                     F.col("image_url"), "color", "size", F.lit(None).cast("int").alias("initial_quantity"))
    created = j.select(F.lit("created").alias("feed"), "sku", F.lit(None).cast("string").alias("name"),
                       F.lit(None).cast(MONEY).alias("price"), F.lit(None).cast("string").alias("image_url"),
                       F.lit(None).cast("string").alias("color"), F.lit(None).cast("string").alias("size"),
                       F.col("initial_quantity").cast("int").alias("initial_quantity"))
    return cache.unionByName(created)


def merge_feed(merged: DataFrame, product: DataFrame) -> DataFrame:
    """I2 after a D7 merge: the product's variants after the save each send a
    cache row and a stock-created row with 0 (which *adds* 0, despite the
    intent to reset). A product whose request had a null variant list sends
    nothing, so a base-price change leaves cached prices stale (KEEP rows)."""
    kept = merged.filter(F.col("action").isin("UPDATE", "INSERT"))
    p = product.select("product_id", "name", F.col("image_url").alias("p_image"))
    j = kept.join(p, "product_id")
    cache = j.select(F.lit("cache").alias("feed"), "sku", "name", F.col("price").cast(MONEY).alias("price"),
                     image_fallback(F.col("image_url"), F.col("p_image")).alias("image_url"), "color", "size",
                     F.lit(None).cast("int").alias("initial_quantity"))
    created = j.select(F.lit("created").alias("feed"), "sku", F.lit(None).cast("string").alias("name"),
                       F.lit(None).cast(MONEY).alias("price"), F.lit(None).cast("string").alias("image_url"),
                       F.lit(None).cast("string").alias("color"), F.lit(None).cast("string").alias("size"),
                       F.lit(UPDATE_INITIAL_QUANTITY).cast("int").alias("initial_quantity"))
    return cache.unionByName(created)

