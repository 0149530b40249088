"""Fixed values of the signal model: horizons, weights, thresholds and calibrated quantiles."""

from __future__ import annotations

# They have to equal the surveyed system's for equal results.
HORIZONS = {"1w": 5, "1m": 21}
DEFAULT_HORIZON = "1w"
PRIOR_WEIGHTS = {"k_ml": 0.15, "tech": 0.10, "news_company": 0.15, "news_market": 0.08, "news_politics": 0.05}
PRIOR_SIGMA = {"k_ml": 0.08, "tech": 0.08, "news_company": 0.50, "news_market": 0.35, "news_politics": 0.30}
WEIGHT_BOUNDS = {"k_ml": (0.0, 0.6), "tech": (0.0, 0.4), "news_company": (0.0, 0.9), "news_market": (0.0, 0.5), "news_politics": (0.0, 0.4)}
MIN_RESOLVED = 40
ADOPT_MARGIN = 0.0005
CONFIDENCE_MEDIUM, CONFIDENCE_HIGH = 0.05, 0.10
PEAD_COEF, PEAD_CLIP, PEAD_MEAN, PEAD_STD, PEAD_Z_CLIP, PEAD_SESSIONS = 0.085, 20.0, 5.3387, 8.7637, 3.0, 10
HALF_LIFE_COMPANY, HALF_LIFE_MACRO, UNDATED_HOURS = 48.0, 24.0, 72.0
EWMA_LAMBDA, EWMA_SEED = 0.97, 21
RANGE_QUANTILES = {5: (-1.1372, 1.2937), 21: (-1.1089, 1.4462)}
SCAN, FILL, PULLBACK_ATR, TARGET_ATR, STOP_ATR, HOLDER_TARGET_ATR = 20, 5, 0.6, 1.5, 1.0, 1.0
MIN_SAMPLES, COST_BPS = 60, 5.0
MIN_TRAIN, HOLDOUT_DAYS, RIDGE_C = 150, 60, 0.5
WALK_FORWARD = (("1 day", 1, 250, 1), ("1 week", 5, 100, 5), ("1 month", 21, 48, 21), ("1 year", 252, 90, 21))
FEATURES = ("ret1", "ret5", "ret10", "ret21", "rsi14", "macd_hist_n", "dist_sma20", "dist_sma50", "bb_pctb", "bb_bw", "vol21", "vol_ratio", "stoch_k", "atr_n")
