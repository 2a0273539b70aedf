"""Features as states that take one event at a time: what the streaming path keeps per entity.

States are small Python objects that pickle. Windowed features hold one mergeable state per
bucket of a 64th of the window; all others hold one state for the entity's life.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from typing import Any

from ..model import Feature, duration_ms
from ..operators.compile import BUCKETS, DAYS, EARTH_KM, GOLDEN, KM_PER_DEGREE, MAX_CATEGORIES, SALT, ZERO_SEED, bucket_labels

_U64 = (1 << 64) - 1


def _isnan(v: Any) -> bool:
    return isinstance(v, float) and math.isnan(v)


def number(v: Any) -> float | None:
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


class Fold:
    """update(t, value, hit): one event; value(now): the feature."""

    def update(self, t: int, v: Any, hit: bool) -> None:
        if hit:
            self.add(t, v)

    def add(self, t: int, v: Any) -> None:
        raise NotImplementedError

    def value(self, now: int) -> Any:
        raise NotImplementedError


class Count(Fold):
    def __init__(self):
        self.n = 0

    def add(self, t, v):
        self.n += 1

    def merge(self, o):
        self.n += o.n

    def value(self, now):
        return self.n


class Moments(Fold):
    """Count, sum, mean and squared deviations, mergeable."""

    def __init__(self, want: str):
        self.want, self.n, self.total, self.mean, self.m2 = want, 0, 0.0, 0.0, 0.0

    def add(self, t, v):
        x = number(v)
        if x is None:
            return
        self.n += 1
        self.total += x
        d = x - self.mean
        self.mean += d / self.n
        self.m2 += d * (x - self.mean)

    def merge(self, o):
        if not o.n:
            return
        n, d = self.n + o.n, o.mean - self.mean
        self.m2 += o.m2 + d * d * self.n * o.n / n
        self.mean += d * o.n / n
        self.n, self.total = n, self.total + o.total

    def var(self):
        return self.m2 / (self.n - 1) if self.n > 1 else None

    def value(self, now):
        if self.want == "sum":
            return self.total if self.n else None
        if self.want == "mean":
            return self.total / self.n if self.n else None
        v = self.var()
        return v if v is None or self.want == "var" else math.sqrt(max(v, 0.0))


class Extreme(Fold):
    def __init__(self, sign: int):
        self.sign, self.best = sign, None

    def add(self, t, v):
        if v is None:
            return
        if self.best is None or _isnan(self.best) and not _isnan(v):
            self.best = v
        elif not isinstance(v, (bool, bytes)) and not _isnan(v) and (v < self.best if self.sign < 0 else v > self.best):
            self.best = v

    def merge(self, o):
        self.add(0, o.best)

    def value(self, now):
        return self.best


class Ratio(Fold):
    def __init__(self):
        self.hits = self.all = 0

    def update(self, t, v, hit):
        self.all += 1
        self.hits += hit

    def merge(self, o):
        self.hits, self.all = self.hits + o.hits, self.all + o.all

    def value(self, now):
        return self.hits / self.all if self.all else None


class Distinct(Fold):
    def __init__(self):
        self.seen = set()

    def add(self, t, v):
        if v is not None:
            self.seen.add(v)

    def merge(self, o):
        self.seen |= o.seen

    def value(self, now):
        return len(self.seen)


class Values(Fold):
    def __init__(self, q: float):
        self.q, self.values = q, Counter()

    def add(self, t, v):
        x = number(v)
        if x is not None and math.isfinite(x):
            self.values[x] += 1

    def merge(self, o):
        self.values.update(o.values)

    def value(self, now):
        n = self.values.total()
        if not n:
            return None
        at = self.q * (n - 1)
        low, got, below, above = int(at), 0, None, None
        for x in sorted(self.values):
            got += self.values[x]
            if below is None and got > low:
                below = x
            if got > min(low + 1, n - 1):
                above = x
                break
        return below + (above - below) * (at - low)


class Categories(Fold):
    def __init__(self, want: str, k: int = 10, cap: int | None = None):
        self.want, self.k, self.cap, self.counts = want, k, cap, Counter()

    def add(self, t, v):
        if v is not None and not isinstance(v, bytes) and (v in self.counts or self.cap is None or len(self.counts) < self.cap):
            self.counts[v] += 1

    def merge(self, o):
        for v, n in o.counts.items():
            if v in self.counts or self.cap is None or len(self.counts) < self.cap:
                self.counts[v] += n

    def value(self, now):
        if self.want == "top_k":
            best = sorted(self.counts.items(), key=lambda x: (-x[1], x[0]))[: self.k]
            return [{"value": v, "count": n} for v, n in best]
        n = self.counts.total()
        return max(0.0, -sum(c / n * math.log2(c / n) for c in self.counts.values())) if n else 0.0


class Windowed(Fold):
    def __init__(self, span: int, make):
        self.span, self.size, self.make, self.buckets = span, -(-span // BUCKETS), make, {}

    def update(self, t, v, hit):
        at = t // self.size * self.size
        if at not in self.buckets:
            self.buckets[at] = self.make()
            if len(self.buckets) > BUCKETS:
                del self.buckets[min(self.buckets)]
        self.buckets[at].update(t, v, hit)

    def value(self, now):
        out = self.make()
        for at in sorted(self.buckets):
            if 0 <= now - at < self.span:
                out.merge(self.buckets[at])
        return out.value(now)


class Keep(Fold):
    """First, last or listed values; `n` back for lag."""

    def __init__(self, want: str, n: int = 1):
        self.want, self.n = want, n
        self.held = deque(maxlen=None if want in ("first", "first_n") else n + (want == "lag"))

    def add(self, t, v):
        if v is None or self.want in ("first", "first_n") and len(self.held) >= self.n:
            return
        self.held.append(v)

    def value(self, now):
        if self.want in ("first", "last"):
            return self.held[0] if self.held else None
        if self.want == "lag":
            return self.held[0] if len(self.held) > self.n else None
        return list(self.held)


class Any_(Fold):
    def __init__(self):
        self.seen = False

    def add(self, t, v):
        self.seen = self.seen or v is not None and not isinstance(v, bytes)

    def value(self, now):
        return self.seen


class Seen(Fold):
    def __init__(self, want: str, n: int = 1, span: int | None = None):
        self.want, self.span, self.first, self.times = want, span, None, deque(maxlen=n)

    def add(self, t, v):
        self.first = t if self.first is None else self.first
        self.times.append(t)

    def value(self, now):
        if self.want == "has_seen":
            return bool(self.times)
        if self.want == "first_seen_in_window":
            return bool(self.times) and (self.span is None or 0 <= now - self.times[-1] < self.span)
        if not self.times or len(self.times) < self.times.maxlen:
            return None
        if self.want in ("first_seen", "age"):
            return self.first if self.want == "first_seen" else max(now - self.first, 0)
        return self.times[-1] if self.want == "last_seen" else max(now - self.times[0], 0)


class Streak(Fold):
    def __init__(self, want: str):
        self.want, self.run, self.best = want, 0, 0

    def update(self, t, v, hit):
        self.run = self.run + 1 if hit != (self.want == "negative_streak") else 0
        self.best = max(self.best, self.run)

    def value(self, now):
        return self.best if self.want == "max_streak" else self.run


class Decay(Fold):
    def __init__(self, want: str, half_life: int):
        self.want, self.rate = want, math.log(2) / half_life
        self.t = self.v = self.x = None
        self.m2 = 0.0

    def add(self, t, v):
        x = 1.0 if self.want == "decayed_count" else number(v)
        if x is None:
            return
        gap = None if self.t is None else t - self.t
        self.x = x
        if gap is None:
            self.v = x
        elif self.want.startswith("decayed"):
            self.v = self.v * math.exp(-self.rate * max(gap, 0)) + x
        else:
            a = -math.expm1(-self.rate * gap) if gap > 0 else 0.5 if self.want == "ewma" else 0.0
            d = x - self.v
            self.v += a * d
            self.m2 = (1 - a) * self.m2 + a * d * (x - self.v)
        if gap is None or gap > 0:
            self.t = t

    def value(self, now):
        if self.v is None:
            return 0.0 if self.want == "decayed_count" else None
        if self.want == "ewvar":
            return max(0.0, self.m2)
        if self.want == "ew_zscore":
            return (self.x - self.v) / math.sqrt(self.m2) if self.m2 > 0 else None
        return self.v


class Pairs(Fold):
    """What needs the event before: rates, changes, time-weighted means."""

    def __init__(self, want: str):
        self.want, self.last, self.out, self.area, self.time, self.n = want, None, None, 0.0, 0, 0

    def add(self, t, v):
        x = v if self.want == "value_change_count" else number(v)
        if x is None:
            return
        if self.last is not None:
            t0, x0 = self.last
            if self.want == "value_change_count":
                self.n += x != x0
            elif self.want == "delta_from_prev":
                self.out = x - x0
            elif t > t0 and self.want == "rate_of_change":
                self.out = (x - x0) / (t - t0)
            self.area += 0.0 if self.want == "value_change_count" else x0 * (t - t0)
            self.time += t - t0
        self.last = (t, x)

    def value(self, now):
        if self.want == "value_change_count":
            return self.n
        if self.want == "twa":
            return None if self.last is None else self.area / self.time if self.time > 0 else self.last[1]
        return self.out


class Gaps(Fold):
    def __init__(self):
        self.first = self.last = None
        self.n = 0

    def add(self, t, v):
        self.first = t if self.first is None else self.first
        self.last, self.n = t, self.n + 1

    def value(self, now):
        return (self.last - self.first) / (self.n - 1) if self.n > 1 else None


class Burst(Fold):
    def __init__(self, size: int):
        self.size, self.at, self.n, self.best = size, None, 0, 0

    def add(self, t, v):
        at = t // self.size
        self.at, self.n = at, self.n + 1 if at == self.at else 1
        self.best = max(self.best, self.n)

    def value(self, now):
        return self.best


class Line(Fold):
    def __init__(self, want: str):
        self.want, self.t0, self.n, self.t, self.x, self.tt, self.tx, self.last = want, None, 0, 0.0, 0.0, 0.0, 0.0, None

    def add(self, t, v):
        x = number(v)
        if x is None:
            return
        self.t0 = t if self.t0 is None else self.t0
        d, self.n = float(t - self.t0), self.n + 1
        dt, dx = d - self.t, x - self.x
        self.t += dt / self.n
        self.x += dx / self.n
        self.tt += dt * (d - self.t)
        self.tx += dt * (x - self.x)
        self.last = (d, x)

    def value(self, now):
        if self.n < 2 or self.tt == 0:
            return None
        slope = self.tx / self.tt
        return slope if self.want == "trend" else self.last[1] - (self.x + slope * (self.last[0] - self.t))


class Outliers(Moments):
    def __init__(self, sigma: float):
        super().__init__("var")
        self.sigma, self.far = sigma, 0

    def add(self, t, v):
        x = number(v)
        if x is not None and self.n >= 5 and self.m2 > 0 and abs(x - self.mean) > self.sigma * math.sqrt(self.var()):
            self.far += 1
        super().add(t, v)

    def value(self, now):
        return self.far


class Score(Moments):
    """Z-score of the last value, within its hour of day if `hourly`."""

    def __init__(self, hourly: bool = False):
        super().__init__("var")
        self.hours = {} if hourly else None
        self.last = None

    def add(self, t, v):
        x = number(v)
        if x is None:
            return
        own = self if self.hours is None else self.hours.setdefault(t // 3_600_000 % 24, Moments("var"))
        Moments.add(own, t, x)
        self.last = (x, own if own is not self else None)

    def value(self, now):
        if self.last is None:
            return None
        x, own = self.last
        own = own or self
        v = own.var()
        return (x - own.mean) / math.sqrt(v) if v and v > 0 else None


class Cells(Fold):
    def __init__(self, want: str, edges: list[float] | None = None):
        self.want, self.edges, self.counts = want, edges, Counter()

    def add(self, t, v):
        if self.want == "histogram":
            x = number(v)
            if x is not None:
                self.counts[next((i for i, e in enumerate(self.edges) if x < e), len(self.edges))] += 1
        elif self.want == "hour_of_day_histogram":
            self.counts[t // 3_600_000 % 24] += 1
        else:
            self.counts[(t // 86_400_000 + 3) % 7 * 24 + t // 3_600_000 % 24] += 1

    def value(self, now):
        if self.want == "histogram":
            return dict(sorted((label, self.counts[i]) for i, label in enumerate(bucket_labels(self.edges))))
        if self.want == "hour_of_day_histogram":
            return [self.counts[h] for h in range(24)]
        return dict(sorted((f"{d}-{h:02d}", self.counts[i * 24 + h]) for i, d in enumerate(DAYS) for h in range(24)))


class Mix(Fold):
    def __init__(self, allowed: list[str] | None, cap: int):
        self.allowed, self.cap, self.counts, self.n = allowed, cap, Counter(), 0

    def add(self, t, v):
        if isinstance(v, bool):
            v = "true" if v else "false"
        elif isinstance(v, int):
            v = str(v)
        if not isinstance(v, str):
            return
        self.n += 1
        if v in self.allowed if self.allowed is not None else v in self.counts or len(self.counts) < self.cap:
            self.counts[v] += 1

    def value(self, now):
        return {k: c / self.n for k, c in sorted(self.counts.items())}


class Reservoir(Fold):
    def __init__(self, k: int):
        self.k, self.held, self.n = k, [], 0

    def add(self, t, v):
        if v is None:
            return
        self.n += 1
        if len(self.held) < self.k:
            self.held.append(v)
            return
        s = self.n ^ SALT ^ GOLDEN or ZERO_SEED
        for shift in (13, -7, 17):
            s ^= (s << shift if shift > 0 else s >> -shift) & _U64
        if s % self.n < self.k:
            self.held[s % self.n] = v

    def value(self, now):
        return list(self.held)


def km_between(a: tuple[float, float], b: tuple[float, float]) -> float:
    (p, q), (r, s) = ((math.radians(x), math.radians(y)) for x, y in (a, b))
    h = min(1.0, math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2)
    return 2 * EARTH_KM * math.atan2(math.sqrt(h), math.sqrt(1 - h))


class Place(Fold):
    def __init__(self, want: str, n: int = 1):
        self.want, self.last, self.best, self.path = want, None, 0.0, 0.0
        self.recent, self.lat, self.lon = deque(maxlen=n), Moments("var"), Moments("var")

    def add(self, t, v):
        lat, lon = map(number, v)
        if lat is None or lon is None:
            return
        at = (lat, lon)
        if self.last is not None:
            km = km_between(self.last[1], at)
            self.path += km
            if t > self.last[0]:
                self.best = max(self.best, km / ((t - self.last[0]) / 3_600_000))
        self.last = (t, at)
        self.recent.append(at)
        self.lat.add(t, lat)
        self.lon.add(t, lon)

    def value(self, now):
        n = self.lat.n
        if self.want == "geo_distance":
            return self.path
        if self.want == "geo_velocity":
            return self.best if n else None
        if self.want == "geo_spread":
            if n < 2:
                return None
            return math.sqrt(self.lat.m2 / n * KM_PER_DEGREE**2 + self.lon.m2 / n * (KM_PER_DEGREE * math.cos(math.radians(self.lat.mean))) ** 2)
        if not n:
            return None
        home = tuple(sum(p[i] for p in self.recent) / len(self.recent) for i in (0, 1))
        return km_between(self.last[1], home)


def fold_of(f: Feature) -> Fold:
    """A fresh state for a feature."""
    op, p = f.op, f.params
    plain = {
        "count": Count,
        "ratio": Ratio,
        "n_unique": Distinct,
        "min": lambda: Extreme(-1),
        "max": lambda: Extreme(1),
        "quantile": lambda: Values(p["q"]),
        "top_k": lambda: Categories("top_k", p.get("k", 10)),
        "entropy": lambda: Categories("entropy", cap=MAX_CATEGORIES),
        **{w: (lambda w=w: Moments(w)) for w in ("sum", "mean", "var", "std")},
    }
    if p.get("approx"):
        from .sketches import DistinctSketch, FrequentSketch, QuantileSketch

        plain |= {"n_unique": DistinctSketch, "quantile": lambda: QuantileSketch(p["q"]), "top_k": lambda: FrequentSketch(p.get("k", 10))}
    if op in plain:
        span = duration_ms(f.window)
        return plain[op]() if span is None else Windowed(span, _Maker(f))
    if op in ("first", "last", "first_n", "last_n", "lag"):
        return Keep(op, p.get("n", 1))
    if op == "most_recent_n":
        return Keep("last_n", p["n"])
    if op in ("first_seen", "last_seen", "age", "has_seen", "time_since", "time_since_last_n", "first_seen_in_window"):
        return Seen(op, p.get("n", 1), duration_ms(f.window))
    if op in ("streak", "max_streak", "negative_streak"):
        return Streak(op)
    if op in ("ewma", "ema", "ewvar", "ew_zscore", "decayed_sum", "decayed_count"):
        return Decay("ewma" if op == "ema" else op, duration_ms(f.half_life))
    if op in ("twa", "rate_of_change", "delta_from_prev", "value_change_count"):
        return Pairs(op)
    if op in ("trend", "trend_residual"):
        return Line(op)
    if op in ("histogram", "hour_of_day_histogram", "dow_hour_histogram"):
        return Cells(op, p.get("buckets"))
    if op.startswith("geo_") or op == "distance_from_home":
        return Place(op, p.get("samples", 100))
    rest = {
        "bloom_member": Any_,
        "inter_arrival_stats": Gaps,
        "burst_count": lambda: Burst(duration_ms(p["sub_window"])),
        "outlier_count": lambda: Outliers(p.get("sigma", 3.0)),
        "z_score": Score,
        "seasonal_deviation": lambda: Score(True),
        "event_type_mix": lambda: Mix(p.get("categories"), p.get("max_categories", 256)),
        "reservoir_sample": lambda: Reservoir(p["samples"]),
    }
    return rest[op]()


class _Maker:
    """Makes a bucket's state; a class, so that states pickle."""

    def __init__(self, f: Feature):
        self.f = Feature(f.op, f.field, None, None, None, f.params)

    def __call__(self) -> Fold:
        return fold_of(self.f)


def input_of(f: Feature, row: dict[str, Any]) -> Any:
    """What a feature reads of a row."""
    return (row.get(f.params["lat"]), row.get(f.params["lon"])) if "lat" in f.params else row.get(f.field) if f.field else None
