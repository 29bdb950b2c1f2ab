"""Static analysis of stored pages and their headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslake import refdata


def _drop_element(html: Column, tag: str) -> Column:
    """Elements with their content; an unclosed one takes the rest of the text."""
    return F.regexp_replace(html, rf"(?is)<{tag}.*?</{tag}>|(?is)<{tag}.*$", "")


def title(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.regexp_replace(inner, r"^\s+|\s+$", "")


def visible_text(html: Column) -> Column:
    """Text outside tags, scripts and styles, blanks collapsed; entities stay as they are."""
    bare = _drop_element(_drop_element(html, "script"), "style")
    text = F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*(>|$)", ""), ">", "")
    return F.trim(F.regexp_replace(text, r"[\s\u0085\p{Z}]+", " "))


def parking(html: Column) -> Column:
    lower = F.lower(html)
    return F.coalesce(*[F.when(lower.contains(mark), F.lit(provider))
                        for mark, provider in refdata.PARKING.items()], F.lit(""))


def is_pixel(content_type: Column, body: Column) -> Column:
    """A GIF or PNG body of 1..100 bytes; ``body`` is binary."""
    size = F.octet_length(body)
    head = F.hex(F.substring(body, 1, 8))
    return F.coalesce(content_type.startswith("image/") & size.between(1, 100)
                      & (head.startswith("47494638") | (head == "89504E470D0A1A0A")),
                      F.lit(False))


def analyze_pages(df: DataFrame, html: str = "html", content_type: str | None = None) -> DataFrame:
    """Add ``title``, ``text_len`` (bytes), ``body_len``, ``is_html`` and ``parking``.

    The whole stored body counts.
    """
    kind = (F.lower(F.trim(F.substring_index(content_type, ";", 1))) if content_type
            else F.lit("text/html"))
    is_html = kind.startswith("text/html")
    return (df.withColumn("_body", F.col(html)).withColumn("is_html", is_html)
            .withColumn("body_len", F.octet_length("_body"))
            .withColumn("title", F.when(is_html, title(F.col("_body"))).otherwise(""))
            .withColumn("text_len", F.when(is_html, F.octet_length(visible_text(F.col("_body"))))
                        .otherwise(0))
            .withColumn("parking", F.when(is_html, parking(F.col("_body"))).otherwise(""))
            .drop("_body"))


def tracking_cookie(df: DataFrame, cookies: str = "set_cookie", as_of: str | None = None
                    ) -> DataFrame:
    """First cookie sent across sites (``SameSite=None; Secure``) that lives 90 days or more.

    ``cookies`` is an array of ``Set-Cookie`` values.  Adds ``tracking_cookie``, ``cookie_max_days``.
    """
    def days(c: Column) -> Column:
        age = F.regexp_extract(c, r"(?i);\s*max-age=([0-9]+)", 1).try_cast("long")
        expires = F.regexp_extract(
            c, r"(?i);\s*expires=\w+,\s*(\d{1,2})[ -](\w{3})[ -](\d{4}) (\d{2}:\d{2}:\d{2})", 0)
        stamp = F.try_to_timestamp(
            F.regexp_replace(F.regexp_extract(expires, r"\d{1,2}[ -]\w{3}[ -]\d{4} [0-9:]{8}", 0),
                             "-", " "), F.lit("d MMM yyyy HH:mm:ss"))
        now = F.lit(as_of).cast("timestamp") if as_of else F.lit(None).cast("timestamp")
        left = F.floor((F.unix_seconds(stamp) - F.unix_seconds(now)) / refdata.DAY)
        return F.coalesce(F.when(age > 0, F.floor(age / refdata.DAY)).otherwise(left), F.lit(0))

    shared = F.transform(
        F.filter(cookies, lambda c: c.rlike(r"(?i);\s*samesite=none\s*(;|$)")
                 & c.rlike(r"(?i);\s*secure\s*(;|$)")),
        lambda c: F.struct(F.trim(F.substring_index(c, "=", 1)).alias("name"),
                           days(c).cast("int").alias("days")))
    long_lived = F.get(F.filter(shared, lambda s: s["days"] >= refdata.TRACKING_COOKIE_MIN_DAYS),
                       F.lit(0))
    return (df.withColumn("_c", long_lived)
            .withColumn("tracking_cookie", F.coalesce("_c.name", F.lit("")))
            .withColumn("cookie_max_days", F.coalesce("_c.days", F.lit(0))).drop("_c"))
