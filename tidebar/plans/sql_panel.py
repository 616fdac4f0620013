"""Checking SQL for the panel: bars, feature blocks and explorer block, written apart from the Spark expressions."""

from __future__ import annotations

from .registry import cte

SIZES = (2, 3, 5, 6, 10, 11, 14, 15, 20, 30, 50, 55, 60)
WIN = (
    "WINDOW w AS (PARTITION BY ticker ORDER BY date), "
    "wu AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), "
    + ", ".join(f"w{n} AS (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)" for n in SIZES)
)


def R(fn: str, x: str, n: int, need: int | None = None) -> str:
    need = n if need is None else need
    return f"(CASE WHEN count({x}) OVER w{n} >= {need} THEN {fn}({x}) OVER w{n} END)"


def L(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER w"


def D(a: str, b: str) -> str:
    """Division guarded with the small constant."""
    return f"(({a}) / (({b}) + 1e-9))"


def Q(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def strength(g: str, s: str) -> str:
    return f"(100 - 100 / (1 + {D(g, s)}))"


def Z(x: str, n: int, need: int | None = None) -> str:
    need = max(5, n // 3) if need is None else need
    return Q(f"{x} - {R('avg', x, n, need)}", R("stddev_pop", x, n, need))


def step(name: str, src: str, drop: str = "", **cols: str) -> None:
    """A table expression that adds columns to another one, in a window-aware select."""
    lst = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    star = f"* EXCLUDE ({drop})" if drop else "*"
    cte(name, src, f"SELECT {star}, {lst} FROM {src} {WIN}")


def ewm_step(name: str, src: str, **specs: tuple[str, float]) -> None:
    """Exponential means by plain recursion over the row number; a value after g rows meets a mean that has faded g times."""
    xs = ", ".join(f"CAST({x} AS DOUBLE) AS x_{k}" for k, (x, _) in specs.items())
    cte(f"{name}_n", src, f"SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn, {xs} FROM {src}")
    first = ", ".join(f"x_{k} AS {k}, 1 AS g_{k}" for k in specs)
    nxt = ", ".join(
        f"CASE WHEN r.{k} IS NULL THEN n.x_{k} WHEN n.x_{k} IS NULL THEN r.{k} ELSE (CAST({a!r} AS DOUBLE) * n.x_{k} + power(1.0 - CAST({a!r} AS DOUBLE), r.g_{k}) * r.{k}) "
        f"/ (CAST({a!r} AS DOUBLE) + power(1.0 - CAST({a!r} AS DOUBLE), r.g_{k})) END, CASE WHEN n.x_{k} IS NULL THEN r.g_{k} + 1 ELSE 1 END"
        for k, (_, a) in specs.items())
    ks = ", ".join(f"n.{k}" for k in specs)
    cte(f"{name}_r", f"{name}_n",
        f"SELECT ticker, date, rn, {first} FROM {name}_n WHERE rn = 1 UNION ALL "
        f"SELECT n.ticker, n.date, n.rn, {nxt} FROM {name}_r r JOIN {name}_n n ON n.ticker = r.ticker AND n.rn = r.rn + 1")
    cte(name, f"{name}_r {src}", f"SELECT s.*, {ks} FROM {src} s JOIN {name}_r n USING (ticker, date)")


KEY = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)"
cte("bars", "", f"""
SELECT printf('S%09d', l_suppkey) AS ticker, date, open, high, low, close, volume, turnover, r_name AS market,
       n_name AS exchange, 'USD' AS currency, CAST(year(date) AS BIGINT) AS year
FROM (SELECT l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, arg_min(px, k) AS open, max(px) AS high,
             min(px) AS low, arg_max(px, k) AS close, sum(l_quantity) AS volume,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS turnover
      FROM (SELECT *, l_extendedprice / l_quantity AS px, {KEY} AS k FROM lineitem) GROUP BY ALL)
JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

step("t0", "bars", pc=L("close"), tp="(high + low + close) / 3")
step("t", "t0", tr="greatest(high - low, abs(high - pc), abs(low - pc))", chg="close - pc",
     gain="CASE WHEN close > pc THEN close - pc ELSE 0.0::DOUBLE END",
     loss="CASE WHEN close < pc THEN pc - close ELSE 0.0::DOUBLE END", pv="tp * volume", true_range="greatest(high - low, abs(high - pc), abs(low - pc))",
     logret_1=f"ln(close) - {L('ln(close)')}", ret_5=f"close / {L('close', 5)} - 1")
A = {n: R("avg", "tr", n) for n in (5, 10, 14)}
VW = {n: D(R("sum", "pv", n), R("sum", "volume", n)) for n in (10, 20)}
G = {n: R("avg", "gain", n) for n in (5, 6, 10, 14)}
S = {n: R("avg", "loss", n) for n in (5, 6, 10, 14)}
step("v1", "t", atr5=f"coalesce({A[5]}, tr)", atr10=f"coalesce({A[10]}, {A[5]})", atr14=f"coalesce({A[14]}, {A[10]})",
     vwap10=VW[10], vwap20=f"coalesce({VW[20]}, {VW[10]})",
     rsi5=strength(f"coalesce({G[5]}, gain)", f"coalesce({S[5]}, loss)"),
     rsi10=strength(f"coalesce({G[10]}, {G[5]}, gain)", f"coalesce({S[10]}, {S[5]}, loss)"),
     rsi14=strength(f"coalesce({G[14]}, {G[10]})", f"coalesce({S[14]}, {S[10]})"))
ewm_step("emas", "v1", ema5=("close", 2 / 6), ema10=("close", 2 / 11), ema20=("close", 2 / 21), ema50=("close", 2 / 51),
         ema12=("close", 2 / 13), ema26=("close", 2 / 27))
step("macd0", "emas", macd="ema12 - ema26")
ewm_step("macd1", "macd0", macd_signal=("macd", 2 / 10))
step("macds", "macd1", macd_hist="macd - macd_signal")

HI = {n: R("max", "high", n) for n in (5, 14, 20, 55)}
LO = {n: R("min", "low", n) for n in (5, 14, 20, 55)}
K5, K14 = f"100 * {D(f'close - {LO[5]}', f'{HI[5]} - {LO[5]}')}", f"100 * {D(f'close - {LO[14]}', f'{HI[14]} - {LO[14]}')}"
W5, W14 = f"-100 * {D(f'{HI[5]} - close', f'{HI[5]} - {LO[5]}')}", f"-100 * {D(f'{HI[14]} - close', f'{HI[14]} - {LO[14]}')}"
V2A = dict(
    **{f"sma{n}": R("avg", "close", n) for n in (5, 10, 20, 50)},
    **{f"roc{n}": f"close / {L('close', n)} - 1" for n in (5, 10, 20)},
    rsi6=strength(f"coalesce({G[6]}, gain)", f"coalesce({S[6]}, loss)"),
    stochk5=K5, stochk14=f"coalesce({K14}, {K5})", willr14=f"coalesce({W14}, {W5})",
    tpm10=R("avg", "tp", 10), tpm20=R("avg", "tp", 20),
    vol10=R("stddev_samp", "logret_1", 10), vol20=R("stddev_samp", "logret_1", 20),
    parkinson20=R("avg", "(power(ln(high / low), 2) / (4.0 * 0.6931471805599453))", 20),
    gk20=R("avg", "(0.5 * power(ln(high / low), 2) - (2.0 * 0.6931471805599453 - 1.0) * power(ln(close / open), 2))", 20),
    tr14=R("avg", "tr", 14),
    obv="sum(CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER wu",
    tp1=L("tp"), mf=f"{D('(close - low) - (high - close)', 'high - low')} * volume",
    vol_z20=D(f"volume - {R('avg', 'volume', 20)}", R("stddev_samp", "volume", 20)), vol_roc5=f"{D('volume', L('volume', 5))} - 1",
    don20_hi=HI[20], don20_lo=LO[20], don55_hi=HI[55], don55_lo=LO[55],
    pos_in_don20=D(f"close - {LO[20]}", f"{HI[20]} - {LO[20]}"), rel_range=D("high - low", "close"),
    chg1=L("chg"), vwap10=VW[10], vwap20=VW[20],
    dev_close=f"close - {R('avg', 'close', 20)}", dev_volume=f"volume - {R('avg', 'volume', 20)}",
    std_close=R("stddev_samp", "close", 20), std_volume=R("stddev_samp", "volume", 20),
    hmove=f"high - {L('high')}", lmove=f"{L('low')} - low", psar_proxy=R("avg", "close", 5),
)
step("v2a", "v1", drop="vwap10, vwap20", **V2A)
V2B = dict(
    stochd14=f"coalesce({R('avg', 'stochk14', 3)}, stochk14)", dtp10="abs(tp - tpm10)", dtp20="abs(tp - tpm20)",
    mfi14=strength(R("sum", "(CASE WHEN tp > tp1 THEN pv ELSE 0 END)", 14), R("sum", "(CASE WHEN tp < tp1 THEN pv ELSE 0 END)", 14)),
    cmf20=D(R("sum", "mf", 20), R("sum", "volume", 20)), curv5=R("avg", "(chg - chg1)", 5),
    dev_obv=f"obv - {R('avg', 'obv', 20)}", dev_vwap=f"vwap20 - {R('avg', 'vwap20', 20)}",
    std_obv=R("stddev_samp", "obv", 20), std_vwap=R("stddev_samp", "vwap20", 20),
    corr_close_vol20=D(R("avg", "(dev_close * dev_volume)", 20), "std_close * std_volume"),
    plus_dm="CASE WHEN hmove > lmove AND hmove > 0 THEN hmove ELSE 0 END",
    minus_dm="CASE WHEN lmove > hmove AND lmove > 0 THEN lmove ELSE 0 END",
    mfx="mf / (1 + 1e-9)", obv5=L("obv", 5), aroon_up20="pos_in_don20 * 100", aroon_dn20="(1 - pos_in_don20) * 100",
)
step("v2b", "v2a", **V2B)


def DI(x: str, n: int) -> str:
    return f"100 * {D(R('sum', x, n), R('avg', 'tr', n))}"


CC = {n: D(f"tp - tpm{n}", f"0.015 * {R('avg', f'dtp{n}', n)}") for n in (10, 20)}
VP = {n: D(R("sum", "mfx", n), R("sum", "volume", n)) for n in (10, 20)}
step("v2c", "v2b", stoch_spread="stochk14 - stochd14", cci20=f"coalesce({CC[20]}, {CC[10]})",
     corr_obv_vwap20=D(R("avg", "(dev_obv * dev_vwap)", 20), "std_obv * std_vwap"),
     plus_di14=f"coalesce({DI('plus_dm', 14)}, {DI('plus_dm', 5)})", minus_di14=f"coalesce({DI('minus_dm', 14)}, {DI('minus_dm', 5)})",
     v_pattern=f"coalesce({VP[20]}, {VP[10]})", v2_pattern=f"(obv - obv5) * (close - coalesce({VW[20]}, {VW[10]}))")
step("v2d", "v2c", dx=f"100 * {D('abs(plus_di14 - minus_di14)', 'plus_di14 + minus_di14')}")
step("v3a", "v2d", adx14=f"coalesce({R('avg', 'dx', 14)}, {R('avg', 'dx', 5)})")
cte("v2e", "v3a macds", "SELECT v.*, m.ema5, m.ema10, m.ema20, m.ema50, m.ema12, m.ema26, m.macd, m.macd_signal, m.macd_hist "
    "FROM v3a v JOIN macds m USING (ticker, date)")
step("v2f", "v2e", dev_sma20=D("close - sma20", "sma20"), dev_ema20=D("close - ema20", "ema20"),
     ma_squeeze_20_50=D("sma20 - sma50", "sma50"), ema12_26_rel=D("ema12 - ema26", "close"))
ewm_step("v3e", "v2f", ema14=("close", 2 / 15), kama10=("close", 0.2))

V1_COLS = "logret_1 ret_5 atr5 atr10 atr14 vwap10 vwap20 rsi5 rsi10 rsi14"
V2_COLS = ("sma5 sma10 sma20 sma50 ema5 ema10 ema20 ema50 roc5 roc10 roc20 rsi6 stochk5 stochk14 stochd14 stoch_spread "
           "willr14 cci20 macd macd_signal macd_hist vol10 vol20 parkinson20 gk20 tr14 obv mfi14 cmf20 vol_z20 vol_roc5 "
           "don20_hi don20_lo don55_hi don55_lo pos_in_don20 rel_range corr_close_vol20 corr_obv_vwap20 curv5 dev_sma20 "
           "dev_ema20 ma_squeeze_20_50 ema12_26_rel")
V3_COLS = "plus_di14 minus_di14 adx14 v_pattern v2_pattern ema14 aroon_up20 aroon_dn20 psar_proxy kama10"


def filled(x: str) -> str:
    return f"coalesce(last_value({x} IGNORE NULLS) OVER wu, 0)"


step("v3f", "v3e", atr5_plain=R("avg", "tr", 5))
FILL = {k: filled(k) for k in (V1_COLS + " " + V2_COLS + " " + V3_COLS).split() if k not in ("atr5", "rsi5")}
FILL["aroon_up20"], FILL["aroon_dn20"] = f"100 * {filled('pos_in_don20')}", f"100 * (1 - {filled('pos_in_don20')})"
BAR_COLS = "ticker, date, open, high, low, close, volume, turnover, market, exchange, currency, year"
cte("filled", "v3e", f"SELECT {BAR_COLS}, tp, pc, {', '.join(f'{v} AS {k}' for k, v in FILL.items())}, "
    f"{filled('atr5')} AS atr5, {filled('rsi5')} AS rsi5, coalesce({R('avg', 'tr', 5)}, 0) AS atr5_v3 FROM v3e {WIN}")

# regime block
step("min0", "macds", vol_z20=D(f"volume - {R('avg', 'volume', 20)}", R("stddev_samp", "volume", 20)))
cte("m0", "min0", f"SELECT {BAR_COLS}, {', '.join(f'{filled(k)} AS {k}' for k in ('rsi14', 'atr14', 'macd_hist', 'macd_signal', 'ema5', 'ema20', 'vol_z20'))} FROM min0 {WIN}")
step("m1", "m0", ret1=f"close / {L('close')} - 1", vol_roc1=f"{Q('volume', L('volume'))} - 1", delta_rsi=f"rsi14 - {L('rsi14')}",
     delta_rsi_3=f"rsi14 - {L('rsi14', 3)}", delta_macd=f"macd_hist - {L('macd_hist')}", ema_spread="ema5 - ema20",
     delta_atr=f"atr14 - {L('atr14')}", bb_mid=R("avg", "close", 20), bb_std=R("stddev_samp", "close", 20),
     atr_rel=D("atr14", R("avg", "atr14", 20)), volume_z="vol_z20", macd_signal_slope=f"macd_signal - {L('macd_signal')}",
     recent_high_60=R("max", "close", 60), recent_low_60=R("min", "close", 60))
step("m2", "m1", local_vol_index=D(R("stddev_samp", "ret1", 5), R("stddev_samp", "ret1", 20)), bb_upper="bb_mid + 2 * bb_std",
     bb_lower="bb_mid - 2 * bb_std", bb_band_width="(bb_mid + 2 * bb_std) - (bb_mid - 2 * bb_std)",
     close_norm=D("close - bb_mid", "bb_std"), ema_spread_rel=D("ema_spread", "ema20"), delta_ema_spread=f"ema_spread - {L('ema_spread')}",
     delta_atr_rel=D("delta_atr", R("stddev_samp", "atr14", 10)), atr_slope=f"atr_rel - {L('atr_rel')}",
     price_accel=f"ret1 - {L('ret1')}", price_slope="ret1",
     recovery_from_low_60=D("close - recent_low_60", "recent_low_60"), distance_from_high_60=D("close - recent_high_60", "recent_high_60"))
# A cubic fitted to k evenly spaced values, second derivative at point k // 2: exact weights as fractions.
CUBIC = {
    5: "2/7 -1/7 -2/7 -1/7 2/7",
    6: "5/126 10/63 -2/63 -16/63 -29/126 20/63",
    7: "5/42 0/1 -1/14 -2/21 -1/14 0/1 5/42",
    8: "1/33 23/462 4/231 -17/462 -19/231 -41/462 -2/77 3/22",
    9: "2/33 1/66 -4/231 -17/462 -10/231 -17/462 -4/231 1/66 2/33",
    10: "3/143 10/429 1/78 -2/429 -10/429 -16/429 -35/858 -4/143 1/143 10/143",
    11: "5/143 2/143 -1/429 -2/143 -3/143 -10/429 -3/143 -2/143 -1/429 2/143 5/143",
}


def cubic(win: str) -> str:
    arms = []
    for k, ws in CUBIC.items():
        lst = ", ".join(f"{a}::DOUBLE / {b}" for a, b in (w.split("/") for w in ws.split()))
        arms.append(f"WHEN {k} THEN list_inner_product({win}, [{lst}])")
    return f"CASE len({win}) {' '.join(arms)} END"


step("m3", "m2", pos_in_band_rel=f"least(greatest({D('close - bb_mid', 'bb_band_width')}, 0.0), 1.0)",
     bb_width=D("bb_band_width", "abs(bb_mid)"), ema_spread_rel_slope=f"ema_spread_rel - {L('ema_spread_rel')}",
     cwin="list_filter(list(close_norm) OVER w11, lambda v: v IS NOT NULL)")
cte("m3b", "m3", f"SELECT * EXCLUDE (cwin, pos_in_band_rel), CASE WHEN bb_band_width IS NOT NULL THEN pos_in_band_rel END AS pos_in_band_rel, "
    f"{cubic('cwin')} AS curv_2 FROM m3")
ewm_step("m4", "m3b", rsi_e=("rsi14", 2 / 6), macd_e=("macd_hist", 2 / 5), atr_e=("atr_rel", 2 / 4), vz_e=("volume_z", 2 / 5),
         sp_e=("ema_spread_rel", 2 / 5))


def F1(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


step("m5", "m4", rsi_smooth=f"coalesce({R('median', 'rsi_e', 3)}, rsi_e)", macd_smooth=R("avg", "macd_e", 3), atr_smooth=R("avg", "atr_e", 3),
     volume_z_smooth=R("avg", "vz_e", 3), ema_spread_smooth=R("avg", "sp_e", 3),
     event_local_vol_spike=F1("local_vol_index > 1.5"),
     event_rebound_candidate=F1("pos_in_band_rel < 0.35 AND delta_rsi_3 > 0 AND delta_macd > 0 AND volume_z > 0"),
     event_volume_regain=F1("volume_z > 0.8 AND vol_roc1 > 0 AND delta_rsi > 0"),
     event_exhaustion_candidate=F1("pos_in_band_rel > 0.85 AND delta_ema_spread < 0 AND delta_atr > 0 AND volume_z < 0.5"),
     event_breakdown_risk=F1("local_vol_index > 1.2 AND macd_hist < 0 AND delta_rsi < 0"))
step("m002", "m5", I_vr_and_vs=F1("event_volume_regain = 1 AND event_local_vol_spike = 1"),
     I_bd_early=F1("event_breakdown_risk = 1 AND curv_2 < 0 AND ema_spread_rel < 0 AND delta_rsi < 0"),
     I_bd_late=F1("event_breakdown_risk = 1 AND curv_2 > 0 AND rsi14 < 40 AND macd_signal_slope > 0"),
     event_volume_regain_freq20=R("sum", "event_volume_regain", 20), event_breakdown_freq20=R("sum", "event_breakdown_risk", 20),
     event_local_vol_freq20=R("sum", "event_local_vol_spike", 20),
     days_since_volume_regain="coalesce(date_diff('day', last_value(CASE WHEN event_volume_regain > 0 THEN date END IGNORE NULLS) OVER wu, date), 1000)",
     days_since_breakdown="coalesce(date_diff('day', last_value(CASE WHEN event_breakdown_risk > 0 THEN date END IGNORE NULLS) OVER wu, date), 1000)")
