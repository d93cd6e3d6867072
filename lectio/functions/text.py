"""Text features as native column expressions (S-01 to S-13, S-26 to S-28).

Patterns carry ``(?U)`` so that word characters and white space are Unicode's, and null text is empty
unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers that a context field may carry in place of content.
SENTINELS = ("(no slide text detected)", "(no speech in this window)", "(none yet)", "(no speech)")

# Function words that never count as a content term.
STOP_TERMS = ("the", "and", "for", "with", "this", "that", "are", "was", "not", "you", "our", "from", "have", "all")

# Common words that the detector's content words leave out.
COMMON_WORDS = ("the", "and", "for", "are", "with", "that", "this", "from", "not", "but", "you", "can", "has", "have", "will", "was", "were", "its", "their", "which", "when")

# The patterns of the five style properties.
SECOND_PERSON = r"\byours?\b|\byou\b|\byourself\b"
PAST_AUXILIARY = r"\b(was|were|had|did)\b"
NARRATIVE_PAST = (
    r"(?<!\bis )(?<!are )(?<!was )(?<!ere )(?<!een )(?<!ing )"
    r"\b(appeared|showed|became|went|came|drew|wrote|stood|grew|rose|fell|began|got|took|gave|"
    r"changed|moved|opened|closed|turned|vanished|disappeared|faded|zoomed|scrolled)\b"
)
DYNAMIC_PARTICIPLES = (
    "drawn|given|presented|depicted|illustrated|indicated|introduced|added|removed|revealed|erased|replaced|animated|"
    "overlaid|superimposed|zoomed|scrolled|advanced"
)
STATIVE_PARTICIPLES = (
    "labeled|labelled|titled|named|colored|coloured|numbered|dated|shaped|aligned|centered|centred|marked|divided|"
    "connected|linked|arranged|placed|positioned|surrounded|enclosed|listed|written|underlined|circled|highlighted|"
    "described|identified|defined|shown"
)
PASSIVE = (
    rf"\b(is|are)\s+(\w+ly\s+)?({DYNAMIC_PARTICIPLES})\b"
    rf"|\b(was|were|being)\s+(\w+ly\s+)?({DYNAMIC_PARTICIPLES}|{STATIVE_PARTICIPLES}|shown|displayed|\w{{3,}}ed)\b"
    rf"|\bbeen\s+(\w+ly\s+)?({DYNAMIC_PARTICIPLES})\b"
)
EVALUATIVE = (
    r"\b(beautiful(ly)?|elegant(ly)?|impressive(ly)?|interesting(ly)?|nice(ly)?|lovely|remarkab(le|ly)|striking(ly)?|"
    r"wonderful(ly)?|excellent(ly)?|great|amazing(ly)?|clever(ly)?|neat(ly)?|helpful(ly)?|useful(ly)?|important(ly)?|"
    r"clear(ly)?\s+(beautiful|elegant|impressive)|well[- ](designed|organized|organised|structured|made)|"
    r"easy\s+to\s+(read|see|follow)|hard\s+to\s+(read|see|follow))\b"
)
META_GRAMMAR = (
    r"\b(the|this|that)\s+(slide|image|figure|screen|visual|diagram|picture|photo|graphic|animation|chart|video|frame)"
    r"\s+(now\s+|currently\s+)?(shows?|showing|depicts?|depicting|displays?|displaying)\b"
)
META_FRAMES = (
    r"\bwhat\s+(appears|is\s+(shown|visible|displayed))\s+here\b|\bas\s+(we|you)\s+can\s+see\b|\bhere\s+(we|you)\s+(can\s+)?see\b|"
    r"\b(we|one)\s+can\s+(see|observe|notice)\b|\bis\s+visible\s+on\s+the\s+(slide|screen)\b|"
    r"\ban?\s+(image|picture|visual)\s+of\b|\bthe\s+presenter\b|\bthis\s+slide\b"
)
STYLE = {
    "second_person": (SECOND_PERSON,),
    "past_tense": (PAST_AUXILIARY, NARRATIVE_PAST),
    "passive_voice": (PASSIVE,),
    "evaluative": (EVALUATIVE,),
    "meta_reference": (META_GRAMMAR, META_FRAMES),
}

TERM = r"[A-Za-z][A-Za-z0-9\-]{2,}"


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once a row, however often it is named, also within a function over an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: What \s matches in a pattern with (?U).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def clean_description(c) -> Column:
    """S-01: without a leading ``[before]`` or ``[after]`` and surrounding space."""
    return _strip(F.regexp_replace(_text(c), r"(?iU)^\s*\[(before|after)\]\s*", ""))


def words(c) -> Column:
    return F.filter(F.split(_text(c), r"(?U)\s+"), lambda x: x != "")


def word_count(c) -> Column:
    """S-02: white-space separated words of the cleaned description."""
    return F.size(words(clean_description(c)))


def is_sentinel(c) -> Column:
    """S-03: the whole string is a marker."""
    return F.lower(_strip(_text(c))).isin([s.lower() for s in SENTINELS])


def strip_sentinels(c) -> Column:
    """S-04: every marker, the longest first, replaced by a space; ends trimmed."""
    found = "|".join(s.replace("(", r"\(").replace(")", r"\)") for s in sorted(SENTINELS, key=len, reverse=True))
    return _strip(F.regexp_replace(_text(c), f"(?i){found}", " "))


def slide_premise(slide_text, on_screen) -> Column:
    """S-05: slide text and on-screen summary, empty parts dropped, markers removed."""
    part = lambda c: F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return strip_sentinels(F.concat_ws(" ", part(slide_text), part(on_screen)))


def _first_by_lower(terms: Column, cap: int) -> Column:
    """The first ``cap`` distinct terms without regard to case, the first spelling of each, in order.

    ``terms`` is bound once: the distinct lower-case forms come from one hash pass, and each of at most
    ``cap`` of them looks up its first place.
    """

    def spelled(both: Column) -> Column:
        lowered = F.slice(F.array_distinct(both["l"]), 1, cap)
        return F.transform(lowered, lambda t: F.element_at(both["t"], F.array_position(both["l"], t).cast("int")))

    pair = F.transform(F.array(terms), lambda ts: F.struct(ts.alias("t"), F.transform(ts, lambda x: F.lower(x)).alias("l")))
    return F.element_at(F.transform(pair, spelled), 1)


def content_terms(c, cap: int = 30) -> Column:
    """S-06, K-08: distinct terms in order of first appearance, stop terms left out, at most ``cap``."""
    found = F.regexp_extract_all(strip_sentinels(c), F.lit(TERM), F.lit(0))
    return _first_by_lower(F.filter(found, lambda x: ~F.lower(x).isin(list(STOP_TERMS))), cap)


def following_terms(c, limit: int) -> Column:
    """S-07: the first terms joined by spaces."""
    return F.array_join(F.slice(F.regexp_extract_all(_text(c), F.lit(TERM), F.lit(0)), 1, limit), " ")


def token_set(c) -> Column:
    """S-08: lower-cased alphanumeric runs, distinct."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """S-09, U-06, U-07: overlap of two sets; ``both_empty`` if neither has a member."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def content_words(c) -> Column:
    """S-10: the detector's words, lower case, common ones left out."""
    found = F.regexp_extract_all(_text(c), F.lit(r"[A-Za-z][A-Za-z\-']{2,}"), F.lit(0))
    return F.array_except(F.array_distinct(F.transform(found, F.lower)), F.array(*map(F.lit, COMMON_WORDS)))


def slide_title(c, limit: int = 12) -> Column:
    """S-11: the first clause of the first line, at most ``limit`` words; null if there is none."""
    line = F.element_at(F.split(_strip(strip_sentinels(c)), "\n"), 1)
    clause = F.element_at(F.split(line, r"[.;:]| - "), 1)
    return F.nullif(F.array_join(F.slice(words(clause), 1, limit), " "), F.lit(""))


def normalise(c) -> Column:
    """S-13: white space collapsed, lower case."""
    return F.lower(F.array_join(words(c), " "))


def quote_is_grounded(quote, source) -> Column:
    """S-12: the quote stands in the source; around an ellipsis, its pieces stand there in order."""
    q, s = normalise(quote), normalise(source)
    pieces = F.filter(F.transform(F.split(q, r"…|\.\.\."), lambda x: F.trim(x)), lambda x: x != "")
    end = F.aggregate(pieces, F.lit(1), lambda at, x: F.when((at > 0) & (_position(x, s, at) > 0), _position(x, s, at) + F.length(x)).otherwise(F.lit(-1)))
    return (F.size(pieces) > 0) & (end > 0)


def _position(piece: Column, source: Column, start: Column) -> Column:
    return F.call_function("locate", piece, source, start)


#: Words of which a text that matches a pattern has at least one: no pattern is tried on a text that has none.
_GRADED = ("beautiful", "elegant", "impressive", "interesting", "nice", "striking", "wonderful", "excellent", "amazing", "clever", "neat", "helpful", "useful", "important")
_NEEDED = {
    SECOND_PERSON: ("you", "your", "yours", "yourself"),
    PAST_AUXILIARY: ("was", "were", "had", "did"),
    NARRATIVE_PAST: tuple(NARRATIVE_PAST[NARRATIVE_PAST.rindex("(") + 1 : NARRATIVE_PAST.rindex(")")].split("|")),
    PASSIVE: ("is", "are", "was", "were", "being", "been"),
    EVALUATIVE: (*_GRADED, *(w + "ly" for w in _GRADED), "lovely", "remarkable", "remarkably", "great", "clear", "clearly", "well", "easy", "hard"),
    META_GRAMMAR: ("slide", "image", "figure", "screen", "visual", "diagram", "picture", "photo", "graphic", "animation", "chart", "video", "frame"),
    META_FRAMES: ("here", "see", "observe", "notice", "visible", "image", "picture", "visual", "presenter", "slide"),
}


def style_violations(c) -> dict[str, Column]:
    """S-28: matches per property, outside quoted spans.

    A text's words are split once; a pattern runs only on a text with a word that it needs. Letters that a
    case-blind pattern takes for ASCII ones (long s, Kelvin sign, i with and without its dot) are folded first.
    """
    found = style_counts(c)
    return {name: found[name] for name in STYLE}


def style_counts(c) -> Column:
    """S-28 as one value: a struct of the matches per property, from one look for all needed words."""
    unquoted = F.regexp_replace(_text(c), '"[^"]{0,200}"', " ")
    said = F.split(F.lower(F.translate(unquoted, "\u017f\u212a\u0131\u0130", "skii")), r"(?U)\W+")
    any_needed = F.array(*map(F.lit, sorted({w for words in _NEEDED.values() for w in words})))

    def counted(b: Column) -> Column:
        count = lambda p: F.when(F.arrays_overlap(b["said"], F.array(*map(F.lit, _NEEDED[p]))), F.regexp_count(b["text"], F.lit(f"(?iU){p}"))).otherwise(0)
        return F.struct(*(sum((count(p) for p in patterns[1:]), count(patterns[0])).alias(name) for name, patterns in STYLE.items()))

    return bound(F.struct(unquoted.alias("text"), F.array_intersect(said, any_needed).alias("said")), counted)


def is_unfilled(c) -> Column:
    """PRJ-07: null, blank, or the literal None."""
    value = F.col(c) if isinstance(c, str) else c
    return value.isNull() | _strip(value.cast("string")).isin("", "None")


def says_something(c) -> Column:
    """S-27: filled, with a word character."""
    return ~is_unfilled(c) & _text(c).rlike(r"(?U)\w")


def is_pseudonym(c) -> Column:
    """S-26: R1, rater2, rater_3, rater-4."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).rlike(r"(?i)^(?:R|rater[_-]?)(\d{1,3})$")
