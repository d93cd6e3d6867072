"""Scores and budgets as native column expressions (S-29 to S-39, M-02 to M-04, D-10 to D-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectio.functions import text as tx

# Fixed values.
MOMENT_TYPES = ("slide", "transition", "reveal", "pointing", "ink", "figure", "chart", "table", "math", "code", "animation", "other")
CATEGORIES = ("style", "terminology", "length", "deixis", "faithfulness", "non_redundancy")
RUNG_WORDS = {1: 25, 2: 15, 3: 25, 4: 5}
WORDS_PER_MINUTE = 140.0
LAG_CAP_SECONDS = 20.0
BANDS = {"S": (12, 15), "M": (16, 25), "L": (23, 25), "XL": (40, 60)}
BAND_FOR_RUNG = {1: "L", 2: "S", 3: "M", 4: "S"}
UNRELATED_SIMILARITY = 0.7568846
POINTING_ACT = (
    "points to", "pointing to", "pointing at", "points at", "is pointing", "the cursor", "the pointer", "the mouse", "gestures",
    "gesturing", "hovers over", "hovering over", "clicks on",
)
POINTING_WORD = r"\b(?:this|these|those|that|here|there)\b"
MAXIMUM_WORD_GAP = 3


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def credit_for_similarity(similarity, knee: float = 0.17) -> Column:
    """S-29: full up to the knee, then falling to zero at one."""
    s = _col(similarity)
    return F.when(s <= knee, 1.0).otherwise(F.greatest((1 - s) / (1 - knee), F.lit(0.0)))


def rescale(value, floor: float = UNRELATED_SIMILARITY) -> Column:
    """S-30: similarity of unrelated sentences becomes 0; not clipped."""
    return (_col(value) - floor) / (1 - floor)


def normalised_rating(value, low: int = 1, high: int = 5) -> Column:
    """S-31."""
    return (_col(value) - low) / (high - low)


def distance_between(forward, backward) -> Column:
    """S-32: 0 for identical texts, 100 for disjoint ones, from the overlaps in both directions."""
    return 100 - 50 * (_col(forward) + _col(backward))


def spoken_seconds(words, words_per_minute: float = WORDS_PER_MINUTE) -> Column:
    """S-34."""
    return _col(words) / words_per_minute * 60


def fits(rung, words, pause, words_per_minute: float = WORDS_PER_MINUTE, lag_cap: float = LAG_CAP_SECONDS) -> Column:
    """S-34: a description of so many words can be delivered at the rung."""
    r, w, p = _col(rung), _col(words), _col(pause)
    length = spoken_seconds(w, words_per_minute)
    return (
        F.when(r == 1, length <= p)
        .when(r == 2, (length <= p) & (w <= RUNG_WORDS[2]))
        .when(r == 3, length <= p + lag_cap)
        .when(r == 4, w <= RUNG_WORDS[4])
        .otherwise(r == 5)
    )


def deliverable_words(rung, pause, words_per_minute: float = WORDS_PER_MINUTE, lag_cap: float = LAG_CAP_SECONDS) -> Column:
    """S-34: the most words that the rung delivers in the pause."""
    r, p = _col(rung), _col(pause)
    rate = words_per_minute / 60
    return F.when(r == 1, p * rate).when(r == 3, (p + lag_cap) * rate).when(r == 2, float(RUNG_WORDS[2])).otherwise(float(RUNG_WORDS[4]))


def reachable_rung(pause, budgets: dict[int, int] | int = 25) -> Column:
    """S-35, S-36: the lowest rung that fits its budget (one number: the same for every rung), else the last."""
    own = {r: budgets for r in RUNG_WORDS} if isinstance(budgets, int) else budgets
    out = F.lit(max(own))
    for rung in sorted(own, reverse=True):
        out = F.when(fits(F.lit(rung), F.lit(own[rung]), pause), rung).otherwise(out)
    return out


def band_for(coverage, rung, pause) -> Column:
    """S-37: (band, low, high); the widest only for an uncovered moment that can deliver its floor."""
    r = _col(rung)
    low, high = BANDS["XL"]
    ceiling = F.floor(deliverable_words(r, pause)).cast("int")
    widest = (F.upper(F.coalesce(_col(coverage), F.lit(""))) == "UNCOVERED") & r.isin(1, 3) & (ceiling >= low)
    made = lambda name, a, b: F.struct(F.lit(name).alias("band"), F.lit(a).alias("low"), b.alias("high"))
    by_rung = made("M", BANDS["M"][0], F.lit(BANDS["M"][1]))
    for k, name in BAND_FOR_RUNG.items():
        by_rung = F.when(r == k, made(name, BANDS[name][0], F.lit(BANDS[name][1]))).otherwise(by_rung)
    return F.when(widest, made("XL", low, F.least(F.lit(high), ceiling))).otherwise(by_rung)


def event_window(t, keyframes_apart, narrow=3, wide=5, wide_above=3.0, minimum_back=2.0, maximum_back=20.0, minimum_span=6.0, trail=2.0, trail_fraction=0.45) -> Column:
    """S-38: (n_stills, start, span, back) of the stills around an event."""
    apart = F.greatest(F.coalesce(_col(keyframes_apart).cast("double"), F.lit(0.0)), F.lit(0.0))
    back = F.greatest(F.lit(minimum_back), F.least(apart, F.lit(maximum_back)))
    count = F.when(apart > wide_above, wide).otherwise(narrow)
    span = F.greatest(F.lit(minimum_span), back + F.greatest(F.lit(trail), back * trail_fraction), back * (count - 1) / (count - 2))
    return F.struct(count.alias("n_stills"), F.greatest(F.lit(0.0), _col(t) - back).alias("start"), span.alias("span"), back.alias("back"))


def pair_violations(axis, a, b, stated_axis) -> Column:
    """S-39: what is wrong with a controlled pair, as an array of short names."""
    gap = F.abs(tx.word_count(a) - tx.word_count(b))
    blank = (F.trim(F.coalesce(_col(a), F.lit(""))) == "") | (F.trim(F.coalesce(_col(b), F.lit(""))) == "")
    length = _col(axis) == "length"
    faults = F.array(
        F.when(~_col(stated_axis).eqNullSafe(_col(axis)), "wrong axis"),
        F.when(blank, "empty side"),
        F.when(~blank & (F.trim(_col(a)) == F.trim(_col(b))), "same sides"),
        F.when(~blank & ~length & (gap > MAXIMUM_WORD_GAP), "length differs"),
        F.when(~blank & length & (gap <= MAXIMUM_WORD_GAP), "length does not differ"),
    )
    return F.filter(faults, lambda x: x.isNotNull())


def cosine(a, b) -> Column:
    """M-02: of two arrays of numbers; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x, y = _col(a), _col(b)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def softmax(logits) -> Column:
    """M-01: probabilities of an array of logits."""
    x = _col(logits)
    raised = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(raised, lambda v: v / F.aggregate(raised, F.lit(0.0), lambda s, w: s + w))


def clip_score(a, b) -> Column:
    """M-03: 2.5 max(cosine, 0)."""
    return 2.5 * F.greatest(cosine(a, b), F.lit(0.0))


def picture_difference(a, b) -> Column:
    """M-04: mean absolute difference of two rasters of bytes, over 255."""
    total = F.aggregate(F.zip_with(_col(a), _col(b), lambda p, q: F.abs(p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return total / (F.size(_col(a)) * 255)


# ---------------------------------------------------------------- components


def style_score(c, cost: float = 0.5) -> Column:
    """D-10: one less ``cost`` per violated property, 0 at least; a blank description scores 0."""
    violated = lambda found: sum((F.when(found[name] > 0, 1).otherwise(0) for name in tx.STYLE), F.lit(0))
    return F.when(tx.clean_description(c) == "", 0.0).otherwise(tx.bound(tx.style_counts(c), lambda found: F.greatest(1 - cost * violated(found), F.lit(0.0))))


def terminology_score(c, premise, cap: int = 40) -> Column:
    """D-11: share of content terms that the premise holds as substrings; 1 if there are none."""
    terms = tx.content_terms(tx.clean_description(c), cap)
    found = lambda b: F.size(F.filter(b["terms"], lambda t: F.contains(b["lower"], F.lower(t))))
    both = F.struct(terms.alias("terms"), F.lower(_col(premise)).alias("lower"))
    return tx.bound(both, lambda b: F.when(F.size(b["terms"]) == 0, 1.0).otherwise(found(b) / F.greatest(F.size(b["terms"]), F.lit(1))))


def length_score(c, pause, words_per_minute: float = WORDS_PER_MINUTE, lag_cap: float = LAG_CAP_SECONDS) -> Column:
    """D-12: pause and lag over spoken duration, 1 at most."""
    n = tx.word_count(c)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), (F.coalesce(_col(pause), F.lit(0.0)) + lag_cap) / F.greatest(spoken_seconds(n, words_per_minute), F.lit(1e-9))))


def deixis_score(c, premise, window: int = 6, cap: int = 60) -> Column:
    """D-13: share of pointing words followed, within ``window`` terms, by a term of the premise.

    Each pointing word is marked; the k-th remainder is what follows the k-th mark.
    """
    mark = "\u0001"

    def resolved(b: Column) -> Column:
        n = F.size(b["rests"])
        suffix = F.transform(b["rests"], lambda x, i: F.array_join(F.slice(b["rests"], i + 1, n), ""))
        named = F.size(F.filter(suffix, lambda x: F.exists(tx.content_terms(tx.following_terms(x, window), window), lambda t: F.contains(b["lower"], F.lower(t)))))
        plain = (n == 0) | (F.size(tx.content_terms(b["lower"], cap)) == 0)
        return F.when(plain, 1.0).otherwise(named / F.greatest(n, F.lit(1)))

    def scored(clean: Column) -> Column:
        acts = F.exists(F.array(*map(F.lit, POINTING_ACT)), lambda p: F.contains(F.lower(clean), p))
        marked = F.regexp_replace(clean, f"(?iU)({POINTING_WORD})", f"$1{mark}")
        both = F.struct(F.slice(F.split(marked, mark), 2, 1 << 30).alias("rests"), F.lower(_col(premise)).alias("lower"))
        return F.when(clean == "", 1.0).when(acts, 0.0).otherwise(tx.bound(both, resolved))

    return tx.bound(tx.clean_description(c), scored)


def novelty_factor(novelty, knee: float = 0.4) -> Column:
    """W-02: novelty over the knee, 1 at most."""
    return F.least(F.lit(1.0), _col(novelty) / knee)
