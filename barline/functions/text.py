"""Text scalars: HTML cleaning, company names, titles and sentiment."""

from __future__ import annotations

import html
import math
import re
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from barline.functions.lexicon import (
    AFTER_BUT, ASK, ASK_MOST, BEFORE_BUT, BOOST, CAPITALS, COMPANY_ENDINGS, EXCLAIM, FADE, FINANCE, IDIOMS, LESS, MORE, NEGATED, NEGATIONS, NEVER_SO, NORMAL,
    PHRASE_DOWN, PHRASE_STEP, PHRASE_UP,
)
from barline.functions.windows import clip

def unescape(c: Column) -> Column:
    """All HTML entities, in Arrow batches."""

    def batch(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else html.unescape(x))

    return F.pandas_udf(batch, "string")(c)


def replace_entities(c: Column, entities: list[tuple[str, str]]) -> Column:
    """The given entities only, one after the other, as nested ``replace`` in SQL; ``unescape`` knows all, cut ones too."""
    for name, char in entities:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


#: Blanks of any script, as \s is in Unicode mode, and the four separators U+001C to U+001F.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
#: Blanks as the SQL of pages has them: all of these but U+000B, which RE2's \s leaves out.
SQL_BLANKS = r"[ \t\n\f\r\p{Z}\x1c-\x1f\x85]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{BLANKS[4:]}|{BLANKS[4:]}$", "")


def squeeze(c: Column, length: int = 300, blanks: str = BLANKS) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, blanks, " ")), 1, length)


def clean_summary(c: Column, length: int = 300) -> Column:
    return squeeze(unescape(strip_tags(c)), length)


def clean_page(c: Column, entities: list[tuple[str, str]], length: int = 300) -> Column:
    """Like ``clean_summary``, with the entities and blanks of the SQL of pages."""
    return squeeze(replace_entities(strip_tags(c), entities), length, SQL_BLANKS)


def company_name(c: Column) -> Column:
    """The common name: punctuation to spaces, then all legal endings off at once."""
    bare = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[,.()]", " "))
    return F.trim(F.regexp_replace(bare, rf"(?i)(?:\s*\b(?:{COMPANY_ENDINGS})\b\s*)+$", ""))


def title_key(c: Column) -> Column:
    return F.left(F.lower(c), F.lit(80))


def mentions(title: Column, name: Column, ticker: Column) -> Column:
    """Whether the title holds the name (3 characters or more) or the ticker (2 or more) as a word."""
    quoted = lambda x: F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    word = lambda x: F.rlike(title, F.concat(F.lit(r"\b\Q"), quoted(x), F.lit(r"\E\b")))
    return ((F.length(name) >= 3) & word(name)) | ((F.length(ticker) >= 2) & word(ticker))


def label(score: Column) -> Column:
    return F.when(score >= 0.15, "positive").when(score <= -0.15, "negative").otherwise("neutral")


def lexicon_score(text: Column, lexicon: dict[str, float]) -> Column:
    """Sum of word valences s as s / sqrt(s^2 + 15), with no shuffle: the list is a literal map."""
    words = F.create_map(*(F.lit(x) for p in lexicon.items() for x in p))
    valence = lambda w: F.coalesce(F.element_at(words, w), F.lit(0.0))
    s = F.aggregate(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), F.lit(0.0), lambda acc, w: acc + valence(w))
    return F.get(F.transform(F.array(s), lambda x: x / F.sqrt(x * x + 15)), F.lit(0))


def phrase_boost(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(PHRASE_UP), PHRASE_STEP).otherwise(0.0) - F.when(low.rlike(PHRASE_DOWN), PHRASE_STEP).otherwise(0.0)


def sentiment(text: Column, lexicon: dict[str, float] = FINANCE) -> Column:
    return clip(lexicon_score(text, lexicon) + phrase_boost(text), -1.0, 1.0)


class _Sentence:
    """A text's words with what the rules ask of them."""

    def __init__(self, text: str, lexicon: dict[str, float]):
        bare = ((w, w.strip(string.punctuation)) for w in text.split())
        self.words = [b if len(b) > 2 else w for w, b in bare]
        self.low = [w.lower() for w in self.words]
        self.lexicon = lexicon
        self.shouts = 0 < sum(w.isupper() for w in self.words) < len(self.words)

    def at(self, i: int) -> str:
        return self.low[i] if 0 <= i < len(self.low) else ""

    def span(self, i: int, j: int) -> str:
        """Words i to j, empty unless all are there."""
        return " ".join(self.low[i : j + 1]) if 0 <= i and j < len(self.low) else ""

    def loud(self, i: int) -> float:
        return CAPITALS if self.shouts and self.words[i].isupper() else 0.0

    def boost(self, i: int, sign: int) -> float:
        """What the word before a valued one of that sign adds, capitals included."""
        w = self.low[i]
        step = BOOST if w in MORE else -BOOST if w in LESS else 0.0
        return sign * (step + self.loud(i)) if step else 0.0

    def negation(self, i: int, k: int) -> float:
        """Factor that the word ``k`` places before word ``i`` brings."""
        w, between = self.at(i - k), {self.at(i - j) for j in range(1, k)}
        if k > 1 and w == "never" and between & {"so", "this"}:
            return NEVER_SO
        if k > 1 and w == "without" and "doubt" in between:
            return 1.0
        return NEGATED if w in NEGATIONS or "n't" in w else 1.0

    def idiom(self, i: int, v: float) -> float:
        spans = [(i - 1, i), (i - 2, i), (i - 2, i - 1), (i - 3, i - 1), (i - 3, i - 2), (i, i + 1), (i, i + 2)]
        for k, (a, b) in enumerate(spans):
            if (said := self.span(a, b)) in IDIOMS:
                v = IDIOMS[said]
                if k < 5:
                    break
        for a, b in ((i - 3, i - 1), (i - 3, i - 2), (i - 2, i - 1)):
            if self.span(a, b) in LESS:
                v -= BOOST
        return v

    def valence(self, i: int) -> float:
        w = self.low[i]
        if w not in self.lexicon or w in MORE or w in LESS or self.span(i, i + 1) == "kind of":
            return 0.0
        v = self.lexicon[w]
        if w == "no" and self.at(i + 1) in self.lexicon:
            v = 0.0
        if "no" in (self.at(i - 1), self.at(i - 2)) or (self.at(i - 3) == "no" and self.at(i - 1) in ("or", "nor")):
            v = self.lexicon[w] * NEGATED
        v += self.loud(i) * (1 if v > 0 else -1)
        for k in (1, 2, 3):
            if i >= k and self.low[i - k] not in self.lexicon:
                v += FADE[k - 1] * self.boost(i - k, -1 if v < 0 else 1)
                v *= self.negation(i, k)
                if k == 3:
                    v = self.idiom(i, v)
        least = self.at(i - 1) == "least" and "least" not in self.lexicon
        return v * NEGATED if least and self.at(i - 2) not in ("at", "very") else v


def rule_score(text: str | None, lexicon: dict[str, float]) -> float:
    """The published rule set on top of word valences, to four places: negation, intensity, capitals, idioms, "but", marks.

    A null, empty or neutral text scores 0.  Emoji count only if the list has them.
    """
    text = text or ""
    s = _Sentence(text, lexicon)
    scores = [s.valence(i) for i in range(len(s.low))]
    if "but" in s.low:
        at = s.low.index("but")
        scores = [v * (BEFORE_BUT if i < at else AFTER_BUT if i > at else 1) for i, v in enumerate(scores)]
    total = float(sum(scores))
    asks = text.count("?")
    marks = min(text.count("!"), 4) * EXCLAIM + (0 if asks < 2 else asks * ASK if asks <= 3 else ASK_MOST)
    total += math.copysign(marks, total) if total else 0.0
    return round(max(-1.0, min(1.0, total / math.sqrt(total * total + NORMAL))), 4)


def rule_sentiment(lexicon: dict[str, float]):
    """Vectorised function of ``rule_score`` plus the phrase rules for any lexicon."""
    up, down = re.compile(PHRASE_UP), re.compile(PHRASE_DOWN)

    def score(s: pd.Series) -> pd.Series:
        def one(t):
            low = (t or "").lower()
            return max(-1.0, min(1.0, rule_score(t, lexicon) + PHRASE_STEP * (bool(up.search(low)) - bool(down.search(low)))))

        return s.map(one)

    return F.pandas_udf(score, "double")
