"""Fixed values. Results depend on them, so they are stated plainly and in one place."""

from __future__ import annotations

# ---- fixed values: CAMEO root codes -> conflict / cooperation score ----------------------------
CAMEO_COOPERATION = {
    "01": 1.0, "02": 0.8, "03": 0.9, "04": 1.0, "05": 0.7, "06": 0.8, "07": 0.6, "08": 0.9,
}
CAMEO_CONFLICT = {
    "10": -0.3, "11": -0.5, "12": -0.7, "13": -0.6, "14": -0.9, "15": -1.0, "16": -0.8,
    "17": -0.9, "18": -0.7, "19": -0.6, "20": -1.0,
}
CAMEO_FALLBACK = {"1": -0.3, "0": 0.4}

# ---- fixed values: daily geopolitical score ------------------------------------------------------
GOLDSTEIN_SCALE = 10.0
TONE_SCALE = 100.0
CONFLICT_BELOW = -0.3
COOPERATION_ABOVE = 0.3
RISK_MEAN_WEIGHT = -0.6
RISK_CONFLICT_WEIGHT = 0.4

# ---- fixed values: text filters ------------------------------------------------------------------
MIN_SCORABLE_CHARS = 20   # kept when strictly longer
MIN_BODY_CHARS = 20       # kept when at least this long
REMOVED_BODIES = ("", "[removed]", "[deleted]")

# ---- fixed values: regime bins on the volatility index (right-closed) -----------------------------
REGIME_RISK_ON_MAX = 15.0
REGIME_TRANSITION_MAX = 25.0
REGIME_CLASSES = ("risk_off", "risk_on", "transition")   # alphabetical, as the label encoder orders

# ---- fixed values: prediction-market rules -------------------------------------------------------
MACRO_EVENTS = (
    "KXFED-26APR", "KXFED-26JUN", "KXCPI-26APR", "KXCPI-26MAY", "KXFEDDECISION-26APR",
    "KXRATECUTCOUNT-26DEC31",
)
HIGH_RATE_THRESHOLD = 4.25
THRESHOLD_PATTERN = r"-([TBUAH])(\d+(?:\.\d+)?)"
HIKE_WORDS = ("HIKE", "RAISE", "INCREASE", "ABOVE", "HIGHER")
CUT_WORDS = ("CUT", "LOWER", "DECREASE", "BELOW", "UNDER")
HOT_INFLATION_WORDS = ("ABOVE", "HIGHER", "HOT", "EXCEED", "OVER")
COOL_INFLATION_WORDS = ("BELOW", "LOWER", "UNDER", "COOL")
GDP_UP_WORDS = ("ABOVE", "HIGHER", "EXCEED")
GDP_DOWN_WORDS = ("BELOW", "LOWER", "UNDER")
UNEMPLOYMENT_UP_WORDS = ("ABOVE", "HIGHER", "RISE")
UNEMPLOYMENT_DOWN_WORDS = ("BELOW", "LOWER", "FALL")

# ---- fixed values: macro topic keywords, in tie order ---------------------------------------------
MACRO_TOPICS = {
    "inflation": ("inflation", "cpi", "prices", "cost", "purchasing power"),
    "monetary_policy": ("federal reserve", "fed", "interest rate", "rate hike", "powell", "fomc"),
    "recession": ("recession", "gdp", "growth", "contraction", "slowdown"),
    "credit": ("credit", "yield", "spread", "default", "bond", "debt"),
    "geopolitics": ("war", "sanction", "geopolitical", "conflict", "china", "russia"),
    "labor": ("unemployment", "jobs", "payroll", "hiring", "layoffs"),
    "energy": ("oil", "energy", "gas", "crude", "opec"),
    "equity": ("stock", "market", "equities", "earnings", "valuation"),
}
TOPIC_OTHER = "other"
TOPIC_NOISE = "noise"
NOISE_TOPIC_ID = -1

# ---- fixed values: keywords that keep an encyclopedia edit ------------------------------------------
MACRO_EDIT_KEYWORDS = (
    "economy", "inflation", "recession", "federal reserve", "interest rate", "gdp",
    "unemployment", "monetary", "fiscal", "central bank", "geopolitics", "sanctions", "war",
    "trade", "tariff",
)

# ---- fixed values: source selections ----------------------------------------------------------------
BACKFILL_PERIODS = {
    "covid_crash": ("2020-01-01", "2020-06-01"),
    "rate_hike_cycle": ("2022-01-01", "2022-12-31"),
    "svb_collapse": ("2023-02-01", "2023-05-01"),
    "post_svb": ("2023-05-01", "2024-01-01"),
}
BACKFILL_SUBREDDITS = ("investing", "MacroEconomics", "wallstreetbets", "Economics")
VOLATILITY_SERIES = "VIXCLS"

# ---- fixed values: validation ------------------------------------------------------------------------
PRICE_TICKERS = ("SPY", "TLT", "GLD", "DX-Y.NYB")
SIGNAL_MAP = {
    "SPY": ("risk_on_prob", 1.0),
    "GLD": ("risk_on_prob", 1.0),
    "TLT": ("risk_off_prob", -1.0),
    "DX-Y.NYB": ("risk_off_prob", -1.0),
}
HORIZONS = (1, 5, 10)
ROLLING_WINDOW = 63
MIN_OBSERVATIONS = 30
MIN_WINDOW_OBSERVATIONS = 20
TRADING_DAYS = 252

# ---- fixed values: composite signal and back-test -------------------------------------------------------
COMPOSITE_WEIGHTS = (0.6, 0.4)
MIN_BACKTEST_BARS = 30

# ---- fixed values: a compact finance word list for the default column-expression scorer -------------------
POSITIVE_WORDS = (
    "beat", "beats", "bullish", "exceed", "exceeded", "expansion", "gain", "gains", "growth",
    "improve", "improved", "optimistic", "outperform", "profit", "profitable", "profits",
    "rally", "rebound", "record", "recovery", "rise", "rises", "rising", "strong", "stronger",
    "surge", "surged", "upbeat", "upgrade", "upgraded",
)
NEGATIVE_WORDS = (
    "bankruptcy", "bearish", "collapse", "contraction", "crash", "crisis", "cut", "decline",
    "declined", "default", "downgrade", "downgraded", "drop", "dropped", "fall", "falls", "fear",
    "fears", "layoffs", "loss", "losses", "miss", "missed", "plunge", "plunged", "recession",
    "risk", "selloff", "slowdown", "slump", "war", "weak", "weaker", "worse",
)
