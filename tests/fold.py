"""A plain row-by-row fold of the same semantics, to compare results with."""
import math


def fold(rows, p):
    """Ticks, snapshots and alerts of ``(asset, market, price, bid, ask, ts, ord)`` rows."""
    states, ticks, snaps, alerts = {}, [], [], []
    for asset, market, price, bid, ask, ts, ord_ in sorted(rows, key=lambda r: (r[5], r[6])):
        s = states.setdefault(
            asset, dict(m="", b=0.0, k=0.0, last=0.0, seq=0, ring=[], snap=None, fire=None))
        s["m"], s["b"], s["k"] = market or s["m"], bid or s["b"], ask or s["k"]
        changed = price != 0 and price != s["last"]
        if price:
            s["last"] = price
            if not s["ring"] or ts - s["ring"][-1][0] >= p.gap_ms:
                s["ring"] = (s["ring"] + [(ts, price)])[-p.ring:]
        if not s["last"]:
            continue

        def asof(target):
            old = [x for x in s["ring"] if x[0] <= target]
            return old[-1][1] if old else None

        def row():
            short, long = asof(ts - p.short_ms), asof(ts - p.long_ms)
            window = [x[1] for x in s["ring"] if x[0] >= ts - p.vol_ms]
            vol, ok = 0.0, False
            if len(window) >= 3:
                r = [math.log(b / a) for a, b in zip(window, window[1:]) if a > 0 and b > 0]
                if len(r) >= 2:
                    mean = sum(r) / len(r)
                    vol, ok = math.sqrt(sum((x - mean) ** 2 for x in r) / (len(r) - 1)), True
            return (
                asset, s["m"], s["last"], s["b"], s["k"],
                (s["last"] - short) * 100 if short is not None else 0.0,
                (s["last"] - long) * 100 if long is not None else 0.0,
                round(vol, 8), s["seq"], ts, ord_, short is not None, long is not None, ok,
            )

        if changed:
            s["seq"] += 1
            ticks.append(row())
            old = asof(ts - p.surge_ms)
            if (
                old is not None and abs((s["last"] - old) * 100) >= p.threshold
                and (s["fire"] is None or ts - s["fire"] >= p.cooldown_ms)
            ):
                s["fire"] = ts
                alerts.append((asset, ts, ord_, s["m"], old, s["last"]))
        if s["snap"] is None or ts - s["snap"] >= p.snapshot_ms:
            s["snap"] = ts
            snaps.append(row())
    return sorted(ticks), sorted(snaps), sorted(alerts)


def greedy(rows, gap):
    last, kept = {}, []
    for key, ts, ord_ in sorted(rows):
        if key not in last or ts - last[key] >= gap:
            kept.append((key, ts, ord_))
            last[key] = ts
    return kept
