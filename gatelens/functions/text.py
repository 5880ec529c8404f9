"""Text rendering: address masking, alert details, feed fields and message bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens.functions.timeparts import ts_text


def mask_ip(ip) -> Column:
    """Keep the first two octets. Text that is not a dotted address is masked whole; null stays null."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    prefix = F.regexp_extract(ip, r"^(\d{1,3}\.\d{1,3})\.\d{1,3}\.\d{1,3}$", 1)
    return F.when(ip.isNull(), F.lit(None)).otherwise(
        F.when(prefix != "", F.concat(prefix, F.lit(".xxx.xxx"))).otherwise("xxx.xxx.xxx.xxx")
    )


def visible_ip(role: Column, has_alerts: Column, ip) -> Column:
    """Address as a role may see it: only on events with alerts, unmasked for admins only."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    return F.when(has_alerts, F.when(role == "admin", ip).otherwise(mask_ip(ip)))


def two_digits(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def fixed_width(text, width: int) -> Column:
    """Cut or pad to ``width`` characters."""
    return F.rpad(F.substring(text, 1, width), width, " ")


def feed_time(ts) -> Column:
    """``MM/dd HH:mm:ss``."""
    text = ts_text(ts)
    return F.concat(F.substring(text, 6, 2), F.lit("/"), F.substring(text, 9, 2), F.lit(" "), F.substring(text, 12, 8))


def short_time(ts) -> Column:
    """``MM-dd HH:mm``."""
    return F.substring(ts_text(ts), 6, 11)


def spaced(name) -> Column:
    return F.translate(name, "_", " ")


def html_escape(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit(">"), F.lit("&gt;"))
