"""Seeded demo events for three settings, generated by Spark from row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EventSource

#: event -> (rows, fields); a field is (type, kind, range)
DEMOS: dict[str, dict[str, tuple[int, dict[str, tuple]]]] = {
    "adtech": {
        "Impression": (6000, {"user_id": ("str", "u", 500), "campaign_id": ("str", "c", 20), "page": ("str", "/p", 8)}),
        "Click": (3000, {"user_id": ("str", "u", 500), "campaign_id": ("str", "c", 20)}),
        "Conversion": (1000, {"user_id": ("str", "u", 500), "campaign_id": ("str", "c", 20), "value": ("f64", 1.0, 200.0)}),
    },
    "ecommerce": {
        "PageView": (6000, {"user_id": ("str", "u", 500), "page": ("str", "/p", 8)}),
        "AddToCart": (3000, {"user_id": ("str", "u", 500), "sku": ("str", "sku", 100), "price": ("f64", 1.0, 100.0)}),
        "Purchase": (1000, {"user_id": ("str", "u", 500), "total": ("f64", 5.0, 500.0), "n_items": ("i64", 1, 10)}),
    },
    "fraud": {
        "Txn": (8000, {"user_id": ("str", "u", 500), "amount": ("f64", 1.0, 1000.0), "merchant": ("str", "m", 50), "ip": ("str", "10.0.0.", 250), "lat": ("f64", -60.0, 60.0), "lon": ("f64", -180.0, 180.0)}),
        "Login": (2000, {"user_id": ("str", "u", 500), "ip": ("str", "10.0.0.", 250), "device_id": ("str", "d", 300)}),
    },
}


def _draw(seed: int, name: str) -> Column:
    """A number in [0, 1) from the row's number, the seed and the field's name."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(1 << 40)).cast("double") / float(1 << 40)


def demo(spark: SparkSession, name: str, seed: int = 42) -> dict[str, tuple[EventSource, DataFrame]]:
    """Sources and their events (with `ts` in epoch milliseconds and `seq`) of a demo."""
    if name not in DEMOS:
        raise ValueError(f"unknown demo {name!r}: one of {sorted(DEMOS)}")
    out = {}
    for event, (rows, fields) in DEMOS[name].items():
        columns = []
        for f, (kind, low, high) in fields.items():
            r = _draw(seed, f"{event}.{f}")
            if kind == "str":
                columns.append(F.concat(F.lit(low), F.floor(r * high).cast("string")).alias(f))
            elif kind == "i64":
                columns.append((F.floor(r * (high - low + 1)) + low).alias(f))
            else:
                columns.append(F.round(r * (high - low) + low, 2).alias(f))
        ts = F.lit(1_700_000_000_000) + F.col("id") * 1000 + F.floor(_draw(seed, f"{event}.ts") * 1000)
        df = spark.range(rows).select(*columns, ts.cast("long").alias("ts"), F.col("id").alias("seq"))
        out[event] = (EventSource(event, {f: k for f, (k, _, _) in fields.items()} | {"ts": "i64"}), df)
    return out
