"""The bar rules applied one row at a time, as an independent check of the set form."""

from __future__ import annotations

from dataclasses import dataclass

MS = {"1m": 60_000, "5m": 300_000, "30m": 1_800_000, "1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000, "1w": 604_800_000}
MONDAY = 259_200_000


def start_of(ts: int, period: str) -> int:
    shift = MONDAY if period == "1w" else 0
    return ts - (ts + shift) % MS[period]


@dataclass
class Open:
    start: int
    values: list  # o h l c volume turnover count taker_volume taker_turnover


class Fold:
    """State per (symbol, period): one open bar; ``final`` collects closed ones."""

    def __init__(self, periods):
        self.periods, self.state, self.final, self.late = periods, {}, {}, []

    def seed(self, symbol, period, start, values):
        self.state[symbol, period] = Open(start, list(values))

    def _fresh(self, price, qty, maker):
        bought = 0.0 if maker else qty
        return [price, price, price, price, qty, price * qty, 1, bought, price * bought]

    def _close(self, key, target):
        """Emit the open bar and the flat bars up to ``target``."""
        bar, step = self.state[key], MS[key[1]]
        close = bar.values[3]
        self.final[(*key, bar.start)] = bar.values
        at = bar.start + step
        while at < target:
            self.final[(*key, at)] = [close] * 4 + [0, 0, 0, 0, 0]
            at += step
        return close

    def trade(self, symbol, price, qty, ts, maker):
        for period in self.periods:
            key, b = (symbol, period), start_of(ts, period)
            bar = self.state.get(key)
            if bar is None:
                self.state[key] = Open(b, self._fresh(price, qty, maker))
            elif b < bar.start:
                self.late.append((symbol, period, ts))
            elif b > bar.start:
                self._close(key, b)
                self.state[key] = Open(b, self._fresh(price, qty, maker))
            elif bar.values[6] == 0:
                bar.values = self._fresh(price, qty, maker)
            else:
                v, bought = bar.values, 0.0 if maker else qty
                bar.values = [
                    v[0], max(v[1], price), min(v[2], price), price, v[4] + qty, v[5] + price * qty,
                    v[6] + 1, v[7] + bought, v[8] + price * bought,
                ]

    def heartbeat(self, t):
        for key, bar in list(self.state.items()):
            if bar.start + MS[key[1]] <= t:
                b = start_of(t, key[1])
                close = self._close(key, b)
                self.state[key] = Open(b, [close] * 4 + [0, 0, 0, 0, 0])

    def result(self):
        """{(symbol, period, start): (values, is_final)}"""
        out = {k: (v, True) for k, v in self.final.items()}
        out.update({(*k, bar.start): (bar.values, False) for k, bar in self.state.items()})
        return {k: (tuple(round(x, 6) for x in v), f) for k, (v, f) in out.items()}


VALUES = ("open", "high", "low", "close", "volume", "turnover", "trade_count", "taker_buy_volume", "taker_buy_turnover")


def bars_of(df):
    return {
        (r["symbol"], r["period"], r["open_time"]): (tuple(round(r[c], 6) for c in VALUES), r["is_final"])
        for r in df.collect()
    }
