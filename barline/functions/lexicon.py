"""Sentiment word list and phrase rules."""

from __future__ import annotations

# Valences of finance and politics words on the -4 to 4 scale.
FINANCE = {
    "upgrade": 1.5, "upgraded": 1.5, "upgrades": 1.5, "downgrade": -1.5, "downgraded": -1.5, "downgrades": -1.5,
    "beats": 1.6, "misses": -1.6, "outperform": 1.3, "underperform": -1.3, "overweight": 1.0, "underweight": -1.0, "guidance": 0.0,
    "profit": 1.0, "profits": 1.0, "loss": -1.0, "losses": -1.2, "dividend": 0.8, "buyback": 1.2, "buybacks": 1.2,
    "surge": 1.9, "surges": 1.9, "surged": 1.9, "soar": 2.1, "soars": 2.1, "soared": 2.1, "rally": 1.7, "rallies": 1.7, "rallied": 1.7,
    "rebound": 1.3, "rebounds": 1.3, "jump": 1.3, "jumps": 1.3, "jumped": 1.3, "plunge": -2.1, "plunges": -2.1, "plunged": -2.1,
    "plummet": -2.3, "plummets": -2.3, "plummeted": -2.3, "tumble": -1.7, "tumbles": -1.7, "tumbled": -1.7, "slump": -1.7, "slumps": -1.7, "slumped": -1.7,
    "sink": -1.4, "sinks": -1.4, "slide": -1.1, "slides": -1.1, "selloff": -1.9, "sell-off": -1.9, "crash": -2.5, "crashes": -2.5,
    "layoffs": -1.5, "layoff": -1.4, "bankruptcy": -3.0, "bankrupt": -3.0, "insolvency": -2.6, "default": -1.7, "restructuring": -0.8,
    "lawsuit": -1.2, "sues": -1.2, "sued": -1.2, "fine": -0.8, "fined": -1.0, "probe": -1.0, "investigation": -0.8, "fraud": -2.4, "scandal": -1.8,
    "recall": -1.3, "recalls": -1.3, "breach": -1.6, "hack": -1.4, "outage": -1.2, "acquisition": 0.8, "merger": 0.6, "ipo": 0.5, "expansion": 1.0, "hiring": 1.0,
    "recession": -2.2, "downturn": -1.6, "slowdown": -1.2, "stagflation": -2.0, "inflation": -0.8, "deflation": -1.0, "stimulus": 1.2,
    "tariff": -1.0, "tariffs": -1.0, "sanctions": -1.0, "embargo": -1.2, "war": -2.0, "invasion": -2.2, "conflict": -1.4, "ceasefire": 1.2,
    "shutdown": -1.4, "strike": -1.2, "strikes": -1.2, "unrest": -1.4, "bailout": -0.6, "austerity": -1.0,
}

# Phrase patterns that move a score up or down once each.
PHRASE_UP = (
    r"record high|all[- ]time high|beats?\s+(?:wall street |analyst |market )?(?:expectations|estimates|forecasts)"
    r"|raises?\s+(?:guidance|forecast|outlook)|better[- ]than[- ]expected|rate cut|rates? (?:were )?cut"
)
PHRASE_DOWN = (
    r"record low|52[- ]week low|misses?\s+(?:expectations|estimates|forecasts)|cuts?\s+(?:guidance|forecast|outlook)"
    r"|worse[- ]than[- ]expected|profit warning|rate hike|rate rise"
)
PHRASE_STEP = 0.35

# Company name endings that do not count as part of the name.
COMPANY_ENDINGS = "inc|incorporated|corp|corporation|company|co|plc|ltd|limited|holdings?|group|technologies|technology|international|sa|nv|ag|se"

# The words of the published rules for social-media sentiment (negations, intensity, idioms, step sizes).
NEGATIONS = set(
    "aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neither neednt never none nope nor not nothing nowhere "
    "oughtnt shant shouldnt uhuh uh-uh wasnt werent without wont wouldnt rarely seldom despite".split()
)
MORE = set(
    "absolutely amazingly awfully completely considerable considerably decidedly deeply effing enormous enormously entirely especially exceptional exceptionally "
    "extreme extremely fabulously flipping flippin frackin fracking fricking frickin frigging friggin fully fuckin fucking fuggin fugging greatly hella highly "
    "hugely incredible incredibly intensely major majorly more most particularly purely quite really remarkably so substantially thoroughly total totally "
    "tremendous tremendously uber unbelievably unusually utter utterly very".split()
)
LESS = set("almost barely hardly kinda kindof kind-of less little marginal marginally occasional occasionally partly scarce scarcely slight slightly somewhat sorta sortof sort-of".split()) | {"just enough", "kind of", "sort of"}
IDIOMS = {"the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5, "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9}
BOOST, CAPITALS, NEGATED, NEVER_SO, FADE = 0.293, 0.733, -0.74, 1.25, (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT, EXCLAIM, ASK, ASK_MOST, NORMAL = 0.5, 1.5, 0.292, 0.18, 0.96, 15.0
