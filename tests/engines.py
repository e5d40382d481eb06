"""Slow, plain engines of one configuration, written from the rules: what the vector ones are tested against."""

from __future__ import annotations

import math

import numpy as np


def bars(seed: int, n: int = 1500, gap: float = 0.0) -> dict:
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.012, n)))
    o = np.concatenate([[100], c[:-1]]) * np.exp(rng.normal(0, 0.004, n))
    h = np.maximum(o, c) * (1 + np.abs(rng.normal(0, 0.005, n)))
    lo = np.minimum(o, c) * (1 - np.abs(rng.normal(0, 0.005, n)))
    w = 12
    ma = np.full(n, np.nan)
    for i in range(w, n):
        ma[i] = c[i - w : i].mean()
    if gap:
        ma[rng.random(n) < gap] = np.nan
    vol = 0.01 * np.exp(0.3 * rng.normal(size=n))
    vol[rng.random(n) < 0.05] = np.nan
    slow = 0.012 * np.exp(0.2 * np.sin(np.arange(n) / 50))
    return {"ts": np.arange(n) * 3_600_000, "o": o, "h": h, "l": lo, "c": c, "ma": ma, "vol": vol, "slow": slow}


class One:
    """One account: rules by name, one method per event."""

    def __init__(self, b, cfg, *, strict=False, carry=False, reenter=False, trail_now=False, dust=1e-9, start=10_000.0, floor=0, plan=None, breaker=None):
        self.b, self.g, self.dust, self.bal, self.peak = b, cfg, dust, start, start
        self.strict, self.carry, self.reenter, self.trail_now, self.floor = strict, carry, reenter, trail_now, floor
        self.plan, self.breaker, self.run, self.slow_until = plan, breaker, 0, -1
        self.side, self.out, self.equity, self.slowed = 0, [], {}, set()

    def holds(self, i):
        lo, h, m = self.b["l"][i], self.b["h"][i], self.b["ma"][i]
        return lo < m < h if self.strict else lo <= m <= h

    def trade(self):
        b, last = self.b, None
        for i in range(len(b["c"])):
            day = int(b["ts"][i] // 86_400_000)
            m = b["ma"][i]
            usable = not math.isnan(m) and (self.carry or (i > 0 and not math.isnan(b["ma"][i - 1])))
            before = last if self.carry else (i - 1 if i else None)
            if not math.isnan(m):
                last = i
            if not usable or i < self.floor:
                self.equity[day] = self.bal
                continue
            sig = 0
            if before is not None and self.holds(before) and not self.holds(i):
                sig = 1 if b["c"][i] > m else -1
            was_flat, reversed_ = self.side == 0, False
            if self.side:
                reversed_ = self.manage(i, sig, day) == "REVERSE"
            alive = self.bal > 0 if self.carry else self.bal > 1e-9
            if sig and self.side == 0 and alive and (self.reenter or was_flat or reversed_) and not self.far(i):
                self.enter(i, sig, day)
            self.equity[day] = self.bal + (b["c"][i] - self.entry) * self.side * self.rem if self.side else self.bal
        return self

    def far(self, i):
        limit, m = self.g["maxdist"], self.b["ma"][i]
        return bool(limit and limit > 0 and m and abs(self.b["c"][i] - m) / m > limit)

    def enter(self, i, side, day):
        g = dict(self.g)
        if self.plan is not None:
            g.update(self.plan.get(day, {}))
        price, vol, slow = self.b["c"][i], self.b["vol"][i], self.b["slow"][i]
        stop = g["stop_k"] * vol if g["stop_k"] is not None and math.isfinite(vol) and vol > 0 else g["stop"]
        lev = g["lev"]
        if self.breaker and day <= self.slow_until:
            lev *= self.breaker[2]
            self.slowed.add(day)
        if g["vol_target"] is not None and math.isfinite(slow) and slow > 0:
            lev *= min(g["vol_hi"], max(g["vol_lo"], g["vol_target"] / slow))
        if g["boost"] is not None and g["boost"] > 1:
            down = (self.peak - self.bal) / self.peak
            if down >= g["boost_from"]:
                part = min(1, (down - g["boost_from"]) / g["boost_decay"]) if g["boost_decay"] > 0 else 1
                lev *= 1 + (g["boost"] - 1) * part
        caps = [g["max_lev"]] + ([(1 - g["mmr"]) / stop * 0.999] if g["liq_guard"] and stop > 0 else [])
        lev = min([g["risk_frac"] / stop if g["risk_frac"] is not None and stop > 0 else lev, *caps])
        if g["taper_ref"] is not None and g["taper_ref"] > 0:
            near = min(1, abs(price - self.b["ma"][i]) / self.b["ma"][i] / g["taper_ref"])
            lev *= g["taper_near"] + (g["taper_far"] - g["taper_near"]) * near
        self.side, self.entry, self.stop, self.hits, self.trail = side, price, price * (1 - side * stop), 0, -math.inf * side
        self.qty = self.rem = self.bal * lev / price
        self.tpd, self.ntp, self.sltp = g["tpd"], g["ntp"], g["sltp"]
        self.liq = price * (1 - side * (1 - g["mmr"]) / lev) if g["liq"] and lev > 0 else None
        self.bal0, self.opened, self.lev = self.bal, int(self.b["ts"][i]), lev
        self.bal -= g["fee"] * self.qty * price

    def sell(self, price, q):
        self.bal += (price - self.entry) * self.side * q - self.g["fee"] * q * price
        self.rem -= q

    def leave(self, i, price, why):
        self.out.append((self.opened, int(self.b["ts"][i]), "LONG" if self.side > 0 else "SHORT", self.entry, price, why, self.bal, self.lev))
        self.side, self.peak = 0, max(self.peak, self.bal)
        return why

    def lost(self, bad, day):
        if self.breaker:
            self.run = self.run + 1 if bad else 0
            if bad and self.run >= self.breaker[0]:
                self.slow_until = day + self.breaker[1]

    def manage(self, i, sig, day):
        o, h, lo, c, m = (self.b[k][i] for k in ("o", "h", "l", "c", "ma"))
        level = self.stop
        tighter = max if self.side > 0 else min
        if self.hits >= self.sltp:
            k = self.g["trail_mult"]
            if k is not None and k > 0:
                at = i if self.trail_now else i - 1
                if math.isfinite(self.b["vol"][at]):
                    self.trail = tighter(self.trail, self.b["c"][at] * (1 - self.side * k * self.b["vol"][at]))
                level = tighter(level, self.trail)
            else:
                level = tighter(level, m)
        past = lambda price, at: price <= at if self.side > 0 else price >= at
        worst, best = (lo, h) if self.side > 0 else (h, lo)
        if self.liq is not None and past(worst, self.liq) and (past(level, self.liq) or past(o, self.liq)):
            self.bal = max(0.0, self.bal - self.rem / self.qty * self.bal0)
            return self.leave(i, self.liq, "LIQ")
        if past(worst, level):
            self.sell(level, self.rem)
            self.lost((level - self.entry) * self.side <= 0, day)
            return self.leave(i, level, "SL")
        while self.hits < self.ntp:
            price = self.entry * (1 + self.side * self.tpd * (self.hits + 1))
            if not (best >= price if self.side > 0 else best <= price):
                break
            q = max(0.0, self.rem - self.g["runner"] * self.qty) if self.hits == self.ntp - 1 else self.qty / self.ntp
            self.sell(price, min(q, self.rem))
            self.hits += 1
            self.run = 0
            if self.rem <= self.dust:
                return self.leave(i, price, "TP")
        if sig == -self.side:
            before = self.bal
            self.sell(c, self.rem)
            self.lost(self.bal < before, day)
            return self.leave(i, c, "REVERSE")
        return None
