"""The whole feature table: all builders over one merged table, in one scan, two projections and one weekly join."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_fields, seasonal_flags
from ..functions.columns import Over, ratio
from . import features as feat
from .scan import Scan, ewm, ordered_scan


@dataclass(frozen=True)
class Roles:
    """Which columns of the merged table are what; what is left out makes no features.

    market: other closing prices, for returns; lagged_market: those of them that get lags; months: later contracts by name, the first being the front's
    neighbour; stocks: inventories, for changes and seasonal norms; correlated: columns by the name in their features.
    """

    price: str
    open: str | None = None
    high: str | None = None
    low: str | None = None
    volume: str | None = None
    rival: str | None = None
    gasoline: str | None = None
    heating: str | None = None
    front: str | None = None
    months: dict[str, str] = field(default_factory=dict)
    macro: tuple[str, ...] = ()
    positions: tuple[str, ...] = ()
    flows: tuple[str, ...] = ()
    indicators: tuple[str, ...] = ()
    market: tuple[str, ...] = ()
    lagged_market: tuple[str, ...] = ()
    correlated: dict[str, str] = field(default_factory=dict)
    stocks: tuple[str, ...] = ()
    risk: str | None = None
    activity: str | None = None


@dataclass(frozen=True)
class Windows:
    """Sizes in rows."""

    lags: tuple[int, ...] = (1, 3, 7, 30)
    slow_lags: tuple[int, ...] = (7, 14)
    market_lags: tuple[int, ...] = (1, 7)
    rolling: tuple[int, ...] = (14, 50, 200)
    bollinger: int = 20
    rsi: int = 14
    macd: tuple[int, int, int] = (12, 26, 9)
    atr: int = 14
    williams: int = 14
    stochastic: tuple[int, int] = (14, 3)
    money_flow: int = 20
    volatility: tuple[int, ...] = (5, 20, 60)
    correlation: tuple[int, ...] = (30, 90)
    momentum: tuple[int, ...] = (21, 63, 126)
    flows: dict[str, int] = field(default_factory=lambda: {"4w": 20, "13w": 65})
    stock_change: int = 7
    activity: int = 63


def _scans(p: str, bars: bool, w: Windows) -> list[Scan]:
    fast, slow, signal = w.macd
    out = [Scan(f"{p}_ema_{n}", ewm(p, n)) for n in w.rolling]
    out += [Scan("_up", ewm("_gain", w.rsi)), Scan("_down", ewm("_loss", w.rsi))]
    out += [Scan(f"{p}_macd", lambda f: ewm(p, fast)(f) - ewm(p, slow)(f)), Scan(f"{p}_macd_signal", ewm(f"{p}_macd", signal))]
    return out + ([Scan(f"{p}_atr_{w.atr}", ewm("_tr", w.atr))] if bars else [])


def build_features(df: DataFrame, keys: list[str], date: str, roles: Roles, windows: Windows = Windows(), complete: bool = True) -> DataFrame:
    """df (keys, date, the columns of roles) with every feature; complete drops rows where any column is null, the warm-up among them.

    Recursions are one Arrow pass, windows share one sort, seasonal norms of all stocks are one weekly join.  A
    column that roles name and df lacks raises; keys are worked on side by side.
    """
    p, w, o = roles.price, windows, Over(keys, date)
    bars = bool(roles.high and roles.low)
    change = o.change(p)
    scratch = {"_gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "_loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))}
    if bars:
        scratch["_tr"] = feat.true_range(o, roles.high, roles.low, p)
    narrow = feat.add(df.select(*keys, date, *dict.fromkeys([p, *([roles.high, roles.low] if bars else [])])), scratch).select(*keys, date, p, *scratch)
    scans = _scans(p, bars, w)
    scanned = ordered_scan(narrow, keys, date, scans).select(*keys, date, *[s.output for s in scans])
    base = df.join(scanned, [*keys, date])

    columns = feat.lags(o, [p], list(w.lags)) | feat.lags(o, [*roles.macro, *roles.positions, *roles.indicators], list(w.slow_lags)) | feat.lags(o, list(roles.lagged_market), list(w.market_lags))
    for name in roles.flows:
        columns |= {f"{name}_chg_{n}": o.change(name, k) for n, k in w.flows.items()}
    columns |= feat.rolling_mean_std(o, p, list(w.rolling)) | feat.bollinger(o, p, w.bollinger) | feat.price_level(o, p, list(w.rolling)) | feat.momentum(o, p, list(w.momentum))
    columns |= {f"{p}_rsi_{w.rsi}": 100 - ratio(F.lit(100.0), 1 + ratio("_up", "_down")), f"{p}_macd_hist": F.col(f"{p}_macd") - F.col(f"{p}_macd_signal")}
    columns |= feat.returns(o, list(dict.fromkeys([p, *([roles.rival] if roles.rival else []), *roles.market])))
    columns |= feat.row_change(o, list(roles.stocks), w.stock_change) | calendar_fields(F.col(date)) | seasonal_flags(F.col(date))
    if roles.activity:
        columns[f"{roles.activity}_chg_3m"] = o.change(roles.activity, w.activity)
    if roles.correlated:
        zero = {n: F.coalesce(F.col(c), F.lit(0.0)) for n, c in roles.correlated.items()}
        columns |= {f"corr_{n}_{s}": o.correlation(F.coalesce(F.col(p), F.lit(0.0)), c, s) for n, c in zero.items() for s in w.correlation}
    steps = []
    if bars:
        columns |= {f"{p}_atr_pct_{w.atr}": ratio(f"{p}_atr_{w.atr}", p)} | feat.williams_r(o, p, roles.high, roles.low, w.williams)
        steps.append(feat.stochastic_steps(o, p, roles.high, roles.low, *w.stochastic))
        if roles.volume:
            steps.append(feat.money_flow_steps(o, p, roles.high, roles.low, roles.volume, w.money_flow))
        if roles.open:
            steps.append(feat.range_volatility_steps(o, roles.open, roles.high, roles.low, p, list(w.volatility)))
    if roles.rival:
        steps.append(feat.spread_steps(o, p, roles.rival, "rival"))
    if roles.gasoline or roles.heating:
        steps.append(feat.crack_steps(o, p, roles.gasoline, roles.heating))
    if roles.months:
        (_, second), *later = roles.months.items()
        steps.append(feat.term_structure_steps(o, roles.front or p, second, dict(later)))
    if roles.risk:
        steps.append(feat.risk_index_steps(o, roles.risk))
    out = feat.add_steps(base, feat.Steps(columns, {}, ("_up", "_down")), *steps)
    out = feat.seasonal_stocks(out, keys, date, list(roles.stocks))
    return out.na.drop() if complete else out
