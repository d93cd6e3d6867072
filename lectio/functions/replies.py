"""Reading model replies (P-01 to P-12): native expressions, and one Arrow UDF where brackets must balance."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio.functions import text as tx

# Limits, the answer for no preference, and the patterns by which replies are read.
RAW_CAP = 2000
SHORT_REPLY_WORDS = 8
TIE = "tie"
BARE_CHOICE = r"""(?i)^[\s*_'"`.]*(1|2|tie)[\s*_'"`.!]*$"""
OPTION = r"(?U)\b([12])\b"
TIE_WORD = r"(?iU)\btie\b"
#: Brackets that are skipped at once where nesting is too deep to parse.
DEEP = 500
OUT_OF_TOP = r"(?U)\b(\d+)\s*/\s*{high}\b"
SCALE_MENTIONS = (r"(?iU)\bout of\s+{high}\b", r"(?iU)\b{low}\s*(?:-|to|–)\s*{high}\b(?:\s*(?:scale|range|point))?", r"(?iU)\bscale\b")


_OPENING = re.compile(r"[\[{]")


def _reply(c) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"(?U)^\s+|\s+$", "")


def parse_choice(c) -> Column:
    """P-01: 1, 2, tie, or null where the reply names none or both.

    A reply that is an answer and nothing else counts as it stands; a longer one if it names only a tie,
    or is short and names only one option.
    """
    reply = _reply(c)
    named = F.array_distinct(F.regexp_extract_all(reply, F.lit(OPTION), F.lit(1)))
    says_tie = reply.rlike(TIE_WORD)
    inside = F.when(says_tie, F.when(F.size(named) == 0, TIE)).when((F.size(named) == 1) & (F.size(tx.words(reply)) <= SHORT_REPLY_WORDS), F.get(named, F.lit(0)))
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(reply, BARE_CHOICE, 1)), F.lit("")), inside)


def parse_scale(c, low: int, high: int) -> Column:
    """P-02: the one integer within the scale, mentions of the scale itself left out; else null."""
    bounds = {"low": low, "high": high}
    reply = F.regexp_replace(_reply(c), OUT_OF_TOP.format(**bounds), "$1")
    for pattern in SCALE_MENTIONS:
        reply = F.regexp_replace(reply, pattern.format(**bounds), " ")
    kept = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(reply, F.lit(r"-?\d+"), F.lit(0)), lambda x: x.try_cast("int")), lambda x: x.between(low, high)))
    return F.when(F.size(kept) == 1, F.get(kept, F.lit(0)))


def strip_fences(c) -> Column:
    """P-05."""
    return _reply(F.regexp_replace(F.regexp_replace(_reply(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def keep_raw(c) -> Column:
    """P-05: the first RAW_CAP characters, and whether there were more."""
    value = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.struct(F.substring(value, 1, RAW_CAP).alias("raw"), (F.length(value) > RAW_CAP).alias("truncated"))


def parse_verdict(c) -> Column:
    """P-04: PASS or FAIL of ``{"verdict": ...}``, else null."""
    body = F.regexp_extract(strip_fences(c), r"(?s)\{.*\}", 0)
    verdict = F.upper(F.trim(F.get_json_object(body, "$.verdict")))
    return F.when(verdict.isin("PASS", "FAIL"), verdict)


def parse_rubric(c, names: list[str]) -> Column:
    """P-06: a struct of the named scores 1 to 5 and ``overall`` 1 to 10 from ``name: value`` lines; the last line wins."""

    def value(name: str, high: int) -> Column:
        found = F.regexp_extract_all(_reply(c), F.lit(rf"(?im)^[\s*_-]*{name}[\s*_]*:(.*)$"), F.lit(1))
        return parse_scale(F.get(F.reverse(found), F.lit(0)), 1, high).alias(name)

    return F.struct(*(value(n, 5) for n in names), value("overall", 10))


def _closed_within(text: str, start: int, stop: int) -> tuple[str, int]:
    """Of a stretch that parsed as JSON up to ``stop``: the longest object or array closed inside, and the first bracket within a string (else stop)."""
    best, opened, i, quoted = "", [], start, stop
    while i < stop:
        if text[i] == '"':
            i += 1
            while i < stop and text[i] != '"':
                if text[i] in "[{":
                    quoted = min(quoted, i)
                i += 2 if text[i] == "\\" else 1
        elif text[i] in "[{":
            opened.append(i)
        elif text[i] in "]}" and opened:
            best = max(best, text[opened.pop() : i + 1], key=len)
        i += 1
    return best, quoted


def _largest_json(reply: str | None) -> str | None:
    """The longest balanced object or array that parses; brackets within strings don't count.

    Where a reading fails, every bracket still open there fails too, so only what was closed before can
    be whole; the search goes on from the failure, or from a bracket that the failed reading took for
    part of a string.
    """
    text, best, at = reply or "", "", 0
    decoder = json.JSONDecoder()
    while (opening := _OPENING.search(text, at)) is not None:
        start = opening.start()
        try:
            _, at = decoder.raw_decode(text, start)
            best = max(best, text[start:at], key=len)
        except json.JSONDecodeError as failure:
            inside, at = _closed_within(text, start + 1, max(failure.pos, start + 1))
            best = max(best, inside, key=len)
        except RecursionError:  # deeper than the parser goes: a good part of the depth further in
            ahead = [m.start() for m, _ in zip(_OPENING.finditer(text, start), range(DEEP), strict=False)]
            at = ahead[-1]
    return best or None


@F.pandas_udf(T.StringType())
def extract_json(replies: pd.Series) -> pd.Series:
    """P-03: the largest parseable JSON document anywhere in a reply, as text; else null."""
    return replies.map(_largest_json)


def _strict(reply: str) -> str | None:
    return _ad_text(reply)


def _balanced(reply: str) -> str | None:
    return _ad_text(_largest_json(reply))


def _open_string(reply: str) -> str | None:
    _, mark, rest = reply.partition('"ad_text"')
    rest = rest.lstrip().removeprefix(":").lstrip()
    return rest[1:].split('",')[0].rstrip('"} \n') if mark and rest.startswith('"') and rest.strip('"} \n') else None


def _ad_text(body: str | None) -> str | None:
    try:
        value = json.loads(body or "")
    except (ValueError, RecursionError):
        return None
    text = value.get("ad_text") if isinstance(value, dict) else None
    return text if isinstance(text, str) else None


#: P-08: the readings of a reply, in the order in which they are tried.
SALVAGE_STEPS = {"strict_object": _strict, "balanced_object": _balanced, "open_string": _open_string}


@F.pandas_udf(T.StructType([T.StructField("how", T.StringType()), T.StructField("ad_text", T.StringType())]))
def salvage(replies: pd.Series) -> pd.DataFrame:
    """P-08: three readings in turn: the whole reply, the largest balanced object, an unclosed text field."""

    def read(reply: str | None) -> tuple[str | None, str | None]:
        return next(((how, text) for how, step in SALVAGE_STEPS.items() if (text := step(reply or "")) is not None), (None, None))

    return pd.DataFrame([read(r) for r in replies], columns=["how", "ad_text"])


def salvaged(c, step: str) -> Column:
    """One of SALVAGE_STEPS alone: the text it reads, else null."""

    @F.pandas_udf(T.StringType())
    def read(replies: pd.Series) -> pd.Series:
        return replies.map(lambda r: SALVAGE_STEPS[step](r or ""))

    return read(F.col(c) if isinstance(c, str) else c)


def parse_objects(df, reply: str, schema: str):
    """P-07: one row per line of the reply that is a JSON object."""
    lines = df.withColumn("_line", F.explode(F.split(F.coalesce(F.col(reply), F.lit("")), "\n"))).where("trim(_line) LIKE '{%}'")
    return lines.withColumn("parsed", F.from_json("_line", schema)).drop("_line")


def parse_candidates(c, schema: str) -> Column:
    """P-09: an array of candidates, from a list or from a single object."""
    body = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(body.startswith("["), F.from_json(body, f"array<{schema}>")).otherwise(F.array(F.from_json(body, schema)))


def winner_of(answer, order) -> Column:
    """P-11: the recorded side that an answer names, by the order of presentation."""
    a, o = (F.col(x) if isinstance(x, str) else x for x in (answer, order))
    return F.when(a == TIE, TIE).when(a.isin("1", "2"), F.when((a == "1") == (o == 0), "a").otherwise("b"))


def chat_example(system, user, answer) -> Column:
    """P-12: a conversation as an array of (role, content)."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), (F.col(c) if isinstance(c, str) else c).alias("content"))
    return F.array(turn("system", system), turn("user", user), turn("assistant", answer))


def answer_json(**columns: Column) -> Column:
    """P-12: the answer of a training example; null fields are kept."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in columns.items())), {"ignoreNullFields": "false"})
