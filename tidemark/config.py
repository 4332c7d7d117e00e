"""Defaults of the operators; every one of them is a parameter where it is used."""

MAX_MISSING_PCT = 15.0
OUTLIER_THRESHOLD = 4.0
RISK_FREE_RATE = 0.035
MIN_WEIGHT, MAX_WEIGHT = 0.01, 0.40
TRADING_DAYS = 252
CALENDAR_DAYS = 365.25
BL_RISK_AVERSION, BL_TAU = 2.5, 0.025
INITIAL_INVESTMENT = 100_000.0
#: Factors whose change is a difference; others change by per cent.
LEVEL_FACTORS = ("FEDFUNDS", "DGS10", "DGS2", "T10Y2Y", "VIX")
