"""Declared schemas of the stored tables (natural keys in the comments)."""

PRICES = "ticker string, date date, close double"  # ticker, date
SECURITIES = (
    "ticker string, name string, asset_type string, sector string, industry string, exchange string, "
    "currency string, current_shares double, market_cap double, metadata_as_of date, source string"
)  # ticker
RATES = "date date, annualized_rate double, source string"  # date
HOLDINGS = "portfolio string, ticker string, weight double, shares double"  # portfolio, ticker
FACTOR_OBSERVATIONS = (
    "build_id string, factor string, date date, scaled_return double, cumulative_index double, coverage double, "
    "quality_flags array<string>, horizons map<int,double>, zscores map<int,double>"
)  # build_id, factor, date
DECISIONS = "strategy string, signal_date date, ticker string, weight double"  # strategy, signal_date, ticker
LIMITS = "portfolio string, metric string, factor string, lower_bound double, upper_bound double"
UNIVERSE_MEMBERS = "universe string, as_of date, source string, ticker string"
