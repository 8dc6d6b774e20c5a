"""Plain-Python statements of the rules, for comparison on small inputs. Written from their text."""

from __future__ import annotations

import datetime as dt
import math
import random
from statistics import median

from daytrace.operators import days as od

START = dt.date(2010, 1, 1)
DAY_COLUMNS = """well string, production_date date, on_stream_hours double, oil_volume_sm3 double,
gas_volume_sm3 double, water_volume_sm3 double, well_status string, choke_size double, choke_unit string,
downhole_pressure_bar double, wellhead_pressure_bar double, choke_dp_bar double, source string"""
NAMES = [c.strip().split(" ")[0] for c in DAY_COLUMNS.split(",")]


def row(offset=0, **over):
    base = {
        "well": "W", "production_date": START + dt.timedelta(days=offset), "on_stream_hours": 24.0,
        "oil_volume_sm3": 100.0, "gas_volume_sm3": 10.0, "water_volume_sm3": 1.0, "well_status": "producing",
        "choke_size": 50.0, "choke_unit": "%", "downhole_pressure_bar": 200.0, "wellhead_pressure_bar": 40.0,
        "choke_dp_bar": 2.0, "source": "a",
    }
    return {**base, **over}


def frame(spark, rows):
    return spark.createDataFrame([[r[n] for n in NAMES] for r in rows], DAY_COLUMNS)


def days_of(spark, rows):
    return od.classify(frame(spark, rows))


def random_history(rng: random.Random, n=160, well="W"):
    """Rows with steady periods, drops, downtime, bad days, status changes and control steps."""
    rows, level, control = [], 100.0, 50.0
    low_until = -1
    for i in range(n):
        if rng.random() < 0.02:
            control = rng.choice([40.0, 44.0, 50.0, 52.0, 70.0])
        if i > 45 and low_until < i and rng.random() < 0.08:
            low_until = i + rng.randint(4, 30)
        rate = level * (0.6 if i <= low_until and rng.random() > 0.12 else 1.0) + rng.choice([0, 1, 2, 3])
        hours = rng.choices([24.0, 12.0, 3.0, 0.0, None, 30.0], [90, 3, 2, 2, 1.2, 0.8])[0]
        status = rng.choices(["producing", "injecting", None], [98.6, 0.7, 0.7])[0]
        oil = None if hours is None else rate * min(hours, 24.0) / 24.0
        rows.append(
            row(i, well=well, on_stream_hours=hours, oil_volume_sm3=oil, well_status=status,
                choke_size=None if rng.random() < 0.03 else control)
        )
    return rows


def klass(r):
    hours, oil, status = r["on_stream_hours"], r["oil_volume_sm3"], r["well_status"]
    if status is None or hours is None or (status == "producing" and oil is None):
        return "missing"
    vols = [v for v in (oil, r["gas_volume_sm3"], r["water_volume_sm3"]) if v is not None]
    if hours < 0 or hours > 24 or any(v < 0 for v in vols) or (hours == 0 and oil not in (None, 0.0)):
        return "quarantined"
    if status == "producing" and hours > 0 and oil == 0 and not r["gas_volume_sm3"] and not r["water_volume_sm3"]:
        return "quarantined"
    if status != "producing":
        return "non_producing"
    return "downtime" if hours == 0 else "partial" if hours < 6 else "valid_producing"


def rate(r):
    return r["oil_volume_sm3"] / r["on_stream_hours"] * 24.0 if klass(r) == "valid_producing" else None


def pieces(rows, tolerance=0.1):
    """A run of rows cut until the control readings of every piece are near their median."""
    read = [(i, r["choke_size"]) for i, r in enumerate(rows) if klass(r) == "valid_producing" and r["choke_size"] is not None]
    if len(read) < 2:
        return [rows]
    mid = median(v for _, v in read)
    if mid == 0 or all(abs(v - mid) / abs(mid) <= tolerance for _, v in read):
        return [rows]
    jumps = [abs(b[1] - a[1]) for a, b in zip(read, read[1:], strict=False)]
    at = read[jumps.index(max(jumps)) + 1][0]
    return pieces(rows[:at], tolerance) + pieces(rows[at:], tolerance)


def windows(rows, tolerance=0.1, activity=()):
    segments, current = [], []
    for i, r in enumerate(rows):
        before = rows[i - 1] if i else None
        changed = before is not None and klass(before) != "quarantined" and before["well_status"] != r["well_status"]
        if klass(r) == "quarantined" or r["production_date"] in activity or changed:
            segments.append(current)
            current = []
        else:
            current.append(r)
    segments.append(current)
    out = []
    for segment in segments:
        for part in pieces(segment, tolerance) if tolerance is not None else [segment]:
            if sum(klass(r) == "valid_producing" for r in part) >= 20:
                out.append((part[0]["production_date"], part[-1]["production_date"]))
    return sorted(out)


def nearest_rank(values, q):
    ordered = sorted(values)
    return ordered[max(0, math.ceil(q * len(ordered)) - 1)]


def episodes(rows, spans):
    """Episodes under the trailing-median model, counted day by day."""
    found = []
    last_valid = max((r["production_date"] for r in rows if rate(r) is not None), default=None)
    for n, (start, end) in enumerate(spans):
        until = spans[n + 1][1] if n + 1 < len(spans) else dt.date.max
        rates = [rate(r) for r in rows if start <= r["production_date"] <= end and rate(r) is not None]
        tail = rates[-28:]
        expected, lower = median(tail), max(nearest_rank(tail, 0.1), 0.0)
        span = [r for r in rows if end < r["production_date"] <= until]
        marks = [(i, rate(r) < lower) for i, r in enumerate(span) if rate(r) is not None]
        k = 0
        while k < len(marks):
            if not all(below for _, below in marks[k : k + 7]) or k + 7 > len(marks):
                k += 1
                while k < len(marks) and marks[k - 1][1] and marks[k][1]:
                    k += 1
                continue
            run = k
            while run + 1 < len(marks) and marks[run + 1][1]:
                run += 1
            last, inside, j = run, 0, run + 1
            while j < len(marks) and inside < 3:
                inside = 0 if marks[j][1] else inside + 1
                last = j if marks[j][1] else last
                j += 1
            body = span[marks[k][0] : marks[last][0] + 1]
            valid = sum(rate(r) is not None for r in body)
            short = held = 0.0
            for r in body:
                if klass(r) in ("downtime", "partial", "valid_producing"):
                    hours = min(r["on_stream_hours"], 24.0)
                    short += expected * hours / 24 - r["oil_volume_sm3"]
                    held += expected * (24 - hours) / 24
            if valid >= 10 and short >= 0.15 * median(rates) * valid:
                gaps = sum(klass(r) in ("quarantined", "missing") for r in body)
                open_ended = inside < 3 and body[-1]["production_date"] == last_valid
                found.append(
                    (body[0]["production_date"], body[-1]["production_date"], valid, run - k + 1,
                     round(short, 6), round(held, 6), round(gaps / len(body), 9), open_ended)
                )
            k = last + 1
    return found
