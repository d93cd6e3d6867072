"""Queries over texts and described moments: features, components, compliance, tables of systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectio.functions import overlap, replies, scoring, statistics, times
from lectio.functions import ids as id_functions
from lectio.functions import text as tx
from lectio.operators import compliance, integrity, sampling, sequence
from lectio.plans.catalogue import query
from lectio.plans.relations import MOMENTS, moments, table
from lectio.sources.lectures import FieldMap
from lectio.sources.shared import written_once

_STOP = ", ".join(f"'{s}'" for s in tx.STOP_TERMS)
_SENTINEL = "|".join(s.replace("(", r"\(").replace(")", r"\)") for s in sorted(tx.SENTINELS, key=len, reverse=True))


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _clean(c: str) -> str:
    return _strip(rf"regexp_replace(coalesce({c}, ''), '^\s*\[(before|after)\]\s*', '', 'i')")


def _no_marks(c: str) -> str:
    return _strip(f"regexp_replace(coalesce({c}, ''), '{_SENTINEL}', ' ', 'gi')")


def _words(c: str) -> str:
    return rf"list_filter(string_split_regex({_clean(c)}, '\s+'), lambda x: x <> '')"


def _terms(c: str, cap: int) -> str:
    found = f"list_filter(regexp_extract_all({_no_marks(c)}, '{tx.TERM}'), lambda x: lower(x) NOT IN ({_STOP}))"
    return f"list_slice(list_filter({found}, lambda x, i: list_position(list_transform({found}, lambda y: lower(y)), lower(x)) = i), 1, {cap})"


def _tokens(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'))"


def _jaccard(a: str, b: str, empty: str = "0.0") -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN {empty} ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END"


_ORDERED = tx.NARRATIVE_PAST[tx.NARRATIVE_PAST.index(r"\b(appeared") :]


def _count(pattern: str, c: str = "u") -> str:
    return f"len(regexp_extract_all({c}, '{pattern}', 0, 'i'))"


_PAST = f"{_count(tx.PAST_AUXILIARY)} + len(list_filter(regexp_extract_all(u, '(?:\\bis |are |was |ere |een |ing )?{_ORDERED}', 0, 'i'), lambda x: NOT regexp_matches(x, '^(is |are |was |ere |een |ing )', 'i')))"
_STYLE = {"second_person": _count(tx.SECOND_PERSON), "past_tense": _PAST, "passive_voice": _count(tx.PASSIVE), "evaluative": _count(tx.EVALUATIVE), "meta_reference": f"{_count(tx.META_GRAMMAR)} + {_count(tx.META_FRAMES)}"}
_UNQUOTED = """regexp_replace(coalesce({c}, ''), '"[^"]{{0,200}}"', ' ', 'g')"""
_STYLE_SCORE = "(CASE WHEN " + _clean("ad_text") + " = '' THEN 0.0 ELSE greatest(0.0, 1 - 0.5 * (" + " + ".join(f"(({v}) > 0)::INT" for v in _STYLE.values()) + ")) END)::DOUBLE"


@query(f"SELECT doc_id, len({_words('text')}) AS n_words FROM documents")
def word_count(spark, sf_dir):
    """S-01, S-02."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.word_count("text").alias("n_words"))


@query(f"""WITH found AS (SELECT doc_id, list_filter(regexp_extract_all({_no_marks('text')}, '{tx.TERM}'), lambda x: lower(x) NOT IN ({_STOP})) AS ts FROM documents),
each AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM found),
firsts AS (SELECT doc_id, arg_min(t, i) AS t, min(i) AS i FROM each GROUP BY doc_id, lower(t)),
joined AS (SELECT doc_id, array_to_string(list_slice(list(t ORDER BY i), 1, 30), ',') AS terms FROM firsts GROUP BY doc_id)
SELECT doc_id, coalesce(terms, '') AS terms FROM documents LEFT JOIN joined USING (doc_id)""")
def content_terms(spark, sf_dir):
    """S-04, S-06, K-08."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.content_terms("text"), ",").alias("terms"))


@query(f"SELECT a.doc_id, round({_jaccard(_tokens('a.text'), _tokens('b.text'))}, 6) AS overlap FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def token_set_jaccard(spark, sf_dir):
    """S-08, S-09, U-06."""
    d = table(spark, sf_dir, "documents").select("doc_id", tx.token_set("text").alias("s"))
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("o"))
    return d.join(other, "doc_id").select("doc_id", F.round(tx.jaccard(F.col("s"), F.col("o")), 6).alias("overlap"))


@query(rf"SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z\-'']{{2,}}'), lambda x: lower(x))), lambda x: x NOT IN ({', '.join(repr(w) for w in tx.COMMON_WORDS)}))), ',') AS words FROM documents")
def detector_words(spark, sf_dir):
    """S-10."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(tx.content_words("text")), ",").alias("words"))


@query(f"SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _STYLE.items())} FROM (SELECT doc_id, {_UNQUOTED.format(c='text')} AS u FROM documents)")
def style_violations(spark, sf_dir):
    """S-28."""
    return table(spark, sf_dir, "documents").select("doc_id", *(v.alias(k) for k, v in tx.style_violations("text").items()))


@query(rf"SELECT item_id, nullif(array_to_string(list_slice(list_filter(string_split_regex(string_split_regex(string_split({_no_marks('text')}, chr(10))[1], '[.;:]| - ')[1], '\s+'), lambda x: x <> ''), 1, 12), ' '), '') AS title FROM benchmark")
def slide_title(spark, sf_dir):
    """S-11."""
    return table(spark, sf_dir, "benchmark").select("item_id", tx.slide_title("text").alias("title"))


_FOLD = r"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"


@query(f"""WITH q AS (SELECT x.item_id, x.text AS body, substr(y.text, 1, 25) AS foreign_part, substr(x.text, 10, 40) AS own FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1)
SELECT item_id, true AS whole, true AS pieces, contains({_FOLD.format(c='body')}, {_FOLD.format(c='own')}) AS own, contains({_FOLD.format(c='body')}, {_FOLD.format(c='foreign_part')}) AS other FROM q""")
def quote_grounded(spark, sf_dir):
    """S-12, S-13: a text's own quote, its two ends around an ellipsis, a stretch from its middle, and the head of the next text."""
    b = table(spark, sf_dir, "benchmark")
    b = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.substring("text", 1, 25).alias("next_head")), "item_id")
    ends = F.concat(F.substring("text", 1, 12), F.lit(" ... "), F.expr("right(text, 12)"))
    return b.select("item_id", tx.quote_is_grounded("text", "text").alias("whole"), tx.quote_is_grounded(ends, "text").alias("pieces"), tx.quote_is_grounded(F.substring("text", 10, 40), "text").alias("own"), tx.quote_is_grounded("next_head", "text").alias("other"))


_GAP_ID = "CASE WHEN event_type = 'error' THEN user_id || '#g' || lpad((event_id % 1000)::VARCHAR, 3, '0') ELSE user_id || '#' || lpad((event_id % 10000)::VARCHAR, 4, '0') END"


@query(f"SELECT event_id, m AS moment_id, m || '::' || event_type AS output_id, user_id::VARCHAR AS lecture, event_type AS writer, event_type = 'error' AS is_gap FROM (SELECT *, {_GAP_ID} AS m FROM events)")
def id_parse(spark, sf_dir):
    """S-20 to S-25: ids made, then taken apart again."""
    e = table(spark, sf_dir, "events")
    gap = F.col("event_type") == "error"
    made = id_functions.moment_id(F.col("user_id").cast("string"), F.when(gap, F.col("event_id") % 1000).otherwise(F.col("event_id") % 10000), gap)
    out = e.withColumn("m", made).withColumn("output_id", id_functions.description_id("m", "event_type"))
    return out.select("event_id", id_functions.moment_of("output_id").alias("moment_id"), "output_id", id_functions.lecture_of(id_functions.moment_of("output_id")).alias("lecture"), id_functions.writer_of("output_id").alias("writer"), id_functions.is_gap_moment("m").alias("is_gap"))


@query("""SELECT event_id, s AS seconds, s AS again, CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE s::DOUBLE END AS checked, s::INT AS packed
FROM (SELECT event_id, (event_id * 13) % 86400 AS s FROM events)""")
def timecode_parse(spark, sf_dir):
    """S-14 to S-19: seconds to a clock and back; a minute of 60 is unreadable."""
    s = (F.col("event_id") * 13) % 86400
    clock = times.seconds_to_clock(s)
    broken = F.when(F.col("event_id") % 7 == 0, F.regexp_replace(clock, r":\d\d:", ":60:")).otherwise(clock)
    return table(spark, sf_dir, "events").select("event_id", s.alias("seconds"), times.clock_to_seconds(clock).cast("long").alias("again"), times.as_seconds(broken).alias("checked"), times.packed_to_seconds(F.concat(times.seconds_to_packed(s), F.lit(".jpg"))).alias("packed"))


_PREMISE = _no_marks("concat_ws(' ', nullif(slide_ocr, ''), nullif(what_on_screen, ''))")
_TERMS40 = _terms(_clean("ad_text"), 40)
_TERMINOLOGY = f"CASE WHEN len({_TERMS40}) = 0 THEN 1.0 ELSE len(list_filter({_TERMS40}, lambda t: contains(lower(premise), lower(t)))) / len({_TERMS40})::DOUBLE END"
_LENGTH = f"CASE WHEN len({_words('ad_text')}) = 0 THEN 1.0 ELSE least(1.0, (coalesce(pause_after, 0) + 20.0) / (len({_words('ad_text')}) / 140.0 * 60.0)) END"
_ACTS = " OR ".join(f"contains(lower({_clean('ad_text')}), '{p}')" for p in scoring.POINTING_ACT)
_RESTS = rf"list_slice(string_split(regexp_replace({_clean('ad_text')}, '({scoring.POINTING_WORD})', '\1' || chr(1), 'gi'), chr(1)), 2, 1000000)"
_AFTER = f"list_transform(rests, lambda r, i: array_to_string(list_slice(rests, i, len(rests)), ''))"
_WINDOW = f"list_filter(list_slice(regexp_extract_all(r, '{tx.TERM}'), 1, 6), lambda t: lower(t) NOT IN ({_STOP}))"
_RESOLVED = f"len(list_filter({_AFTER}, lambda r: len(list_filter({_WINDOW}, lambda t: contains(lower(premise), lower(t)))) > 0))"
_DEIXIS = f"CASE WHEN {_clean('ad_text')} = '' THEN 1.0 WHEN {_ACTS} THEN 0.0 WHEN len(rests) = 0 OR len({_terms('lower(premise)', 60)}) = 0 THEN 1.0 ELSE {_RESOLVED} / len(rests)::DOUBLE END"
SCORED = f"""{MOMENTS}, premised AS (SELECT *, {_PREMISE} AS premise, {_RESTS} AS rests, {_UNQUOTED.format(c='ad_text')} AS u FROM moments),
parts AS (SELECT * EXCLUDE (u, rests), {_STYLE_SCORE} AS style, {_TERMINOLOGY} AS terminology, {_LENGTH} AS length,
  CASE WHEN renders_cursor IS DISTINCT FROM false THEN {_DEIXIS} END AS deixis FROM premised),
scored AS (SELECT *, (style + terminology + length + coalesce(deixis, 0)) / (3 + (deixis IS NOT NULL)::INT) AS overall FROM parts)"""
NOVEL = f"""{SCORED}, tokens AS (SELECT *, {_tokens('ad_text')} AS toks FROM scored),
novel AS (SELECT a.moment_id, a.system, 1 - coalesce(max({_jaccard('a.toks', 'b.toks')}), 0.0) AS novelty FROM tokens a LEFT JOIN tokens b
  ON a.lecture = b.lecture AND a.system = b.system AND (b.t, b.moment_id) < (a.t, a.moment_id) GROUP BY ALL),
final AS (SELECT s.* EXCLUDE (overall), s.overall AS base, novelty, least(1.0, novelty / 0.4) AS factor, s.overall * least(1.0, novelty / 0.4) AS overall FROM scored s JOIN novel USING (moment_id, system))"""


def _scored(spark, sf_dir):
    return compliance.score(moments(spark, sf_dir))


def _final(spark, sf_dir, knee: float = 0.4):
    return compliance.with_novelty(_scored(spark, sf_dir), "lecture", ["t", "moment_id"], knee=knee, by=("system",))


@query(f"WITH {SCORED} SELECT moment_id, system, round(terminology, 6) AS terminology, round(length, 6) AS length, round(deixis, 6) AS deixis FROM scored")
def mechanical_components(spark, sf_dir):
    """D-11, D-12, D-13, S-05."""
    s = _scored(spark, sf_dir)
    return s.select("moment_id", "system", *(F.round(c, 6).alias(c) for c in ("terminology", "length", "deixis")))


@query(f"WITH {SCORED} SELECT moment_id, system, round(style, 6) AS style, round(overall, 6) AS overall FROM scored")
def compliance_mechanical(spark, sf_dir):
    """D-09, D-10, D-16."""
    return _scored(spark, sf_dir).select("moment_id", "system", F.round("style", 6).alias("style"), F.round("overall", 6).alias("overall"))


@query(f"WITH {NOVEL} SELECT moment_id, system, round(novelty, 6) AS novelty, round(factor, 6) AS factor FROM final")
def novelty(spark, sf_dir):
    """W-01, W-02, W-03, J-03."""
    return _final(spark, sf_dir).select("moment_id", "system", F.round("novelty", 6).alias("novelty"), F.round("novelty_factor", 6).alias("factor"))


@query(f"WITH {NOVEL} SELECT system, round(avg(overall), 6) AS score, count(overall) AS n_scored, count(*) AS n_moments FROM final GROUP BY system")
def score_systems(spark, sf_dir):
    """The table of systems: D-18, D-19, A-04, A-06, PRJ-05."""
    return compliance.system_scores(_final(spark, sf_dir), ["system"]).withColumn("score", F.round("score", 6))


@query(f"""WITH {NOVEL}, seeds AS (SELECT system, conv_id % 3 AS seed, avg(overall) AS score, count(overall) AS n_scored FROM final GROUP BY ALL)
SELECT system, round(avg(score), 6) AS score, round(avg(n_scored))::BIGINT AS n_scored, string_agg(seed::VARCHAR, ',' ORDER BY seed) AS seeds FROM seeds GROUP BY system""")
def over_seeds(spark, sf_dir):
    """A-07."""
    per = compliance.system_scores(_final(spark, sf_dir).withColumn("seed", F.col("conv_id") % 3), ["system", "seed"])
    return compliance.over_seeds(per, "system", "seed").withColumn("score", F.round("score", 6))


_KNEES = (0.2, 0.3, 0.4, 0.5, 0.6)


def _by_knee(final, system: str):
    """Mean score of each system under each knee of the novelty factor."""
    base = F.when(F.col("novelty_factor") == 0, 0.0).otherwise(F.try_divide("overall", "novelty_factor"))
    each = final.withColumn("base", base).withColumn("knee", F.explode(F.array(*map(F.lit, _KNEES))))
    return each.groupBy("knee", system).agg(F.round(F.avg(F.col("base") * F.least(F.lit(1.0), F.col("novelty") / F.col("knee"))), 6).alias("score"))


@query(f"""WITH {NOVEL}, k AS (SELECT unnest([{', '.join(map(str, _KNEES))}])::DOUBLE AS knee),
means AS (SELECT knee, system, round(avg(base * least(1.0, novelty / knee)), 6) AS score FROM final, k GROUP BY ALL)
SELECT knee, system, score, row_number() OVER (PARTITION BY knee ORDER BY score DESC, system) AS position FROM means""")
def rank_stability(spark, sf_dir):
    """W-12, W-13: novelty once, the factor per knee."""
    return sequence.ranks(_by_knee(_final(spark, sf_dir), "system"), ["knee"], "score", "system")


@query(f"""WITH {NOVEL}, k AS (SELECT unnest([{', '.join(map(str, _KNEES))}])::DOUBLE AS knee), own AS (SELECT *, system || '-' || conv_id % 9 AS many FROM final),
means AS (SELECT knee, many, round(avg(base * least(1.0, novelty / knee)), 6) AS score FROM own, k GROUP BY ALL),
met AS (SELECT b.knee, a.score AS x, b.score AS y FROM means a JOIN means b USING (many) WHERE a.knee = {_KNEES[0]} AND b.knee <> {_KNEES[0]}),
r AS (SELECT knee, rank() OVER (PARTITION BY knee ORDER BY x) + (count(*) OVER (PARTITION BY knee, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY knee ORDER BY y) + (count(*) OVER (PARTITION BY knee, y) - 1) / 2.0 AS ry FROM met)
SELECT knee, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY knee""")
def stability_against_first(spark, sf_dir):
    """W-15, T-05: how far the order of the systems (a role in a ninth of the conversations) under each knee goes with that under the first."""
    many = _final(spark, sf_dir).withColumn("many", F.concat_ws("-", "system", F.col("conv_id") % 9))
    per = written_once(_by_knee(many, "many"), "knees")
    first = per.where(F.col("knee") == _KNEES[0]).select("many", F.col("score").alias("x"))
    both = per.where(F.col("knee") != _KNEES[0]).join(first, "many")
    return statistics.spearman_frame(both, "x", "score", ["knee"]).withColumn("rho", F.round("rho", 6))


_BLOCK = ", ".join(
    f"count({c}) AS {c}_n, count(*) - count({c}) AS {c}_abstained, round(avg({c}), 6) AS {c}_mean, round(quantile_cont({c}, 0.5), 6) AS {c}_median, count(*) FILTER ({c} >= 1.0) AS {c}_compliant, round(count(*) FILTER ({c} >= 1.0) / nullif(count({c}), 0)::DOUBLE, 6) AS {c}_share"
    for c in compliance.MECHANICAL
)


@query(f"""WITH {SCORED} SELECT type AS stratum, count(*) AS n_total, count(overall) AS n_scored, 0::BIGINT AS n_unfilled, 0::BIGINT AS n_missing,
count(DISTINCT moment_id) AS n_moments, round(avg(overall), 6) AS mean, round(quantile_cont(overall, 0.5), 6) AS median, {_BLOCK} FROM scored GROUP BY GROUPING SETS ((type), ())""")
def summarise_strata(spark, sf_dir):
    """A-02, A-03."""
    s = compliance.summarise(_scored(spark, sf_dir))
    rounded = [c for c in s.columns if c.endswith(("mean", "median", "share"))]
    return s.withColumns({c: F.round(c, 6) for c in rounded})


_RULE_ROWS = ", ".join(f"('{r}', {n}, '{g}', string_split('{t}', ','), {d}, {s}, '{route}', '{c}')" for r, n, g, t, d, s, route, c in compliance.RULES)
RULES_SQL = f"rules(rule, number, category, types, when_described, when_silent, route, checks) AS (VALUES {_RULE_ROWS})"


@query(f"""WITH {MOMENTS}, {RULES_SQL} SELECT m.moment_id, m.system, string_agg(r.rule, ',' ORDER BY r.number, r.rule) AS rules
FROM moments m JOIN rules r ON (list_contains(r.types, 'all') OR list_contains(r.types, m.type)) AND CASE WHEN m.turn % 4 <> 3 THEN r.when_described ELSE r.when_silent END GROUP BY ALL""")
def rule_applicability(spark, sf_dir):
    """PRJ-10, PRJ-11, SRC-19."""
    rows = moments(spark, sf_dir).withColumn("described", F.col("turn") % 4 != 3)
    found = compliance.applicable_rules(rows, compliance.rule_table(spark))
    return found.select("moment_id", "system", F.array_join("rules", ",").alias("rules"))


_COMPONENT = {c: k for k, c in compliance.MECHANICAL.items()}
_CHECK_ROWS = ", ".join(f"('{_COMPONENT[k]}', '{c}', {compliance.BREACH[k]})" for k, cs in compliance.CHECKS.items() if k in _COMPONENT for c in cs)
_LONG = " UNION ALL ".join(f"SELECT key, type, overall, '{c}' AS component, {c} AS value FROM keyed" for c in compliance.MECHANICAL)


@query(f"""WITH {NOVEL}, {RULES_SQL}, checks(component, chk, breach) AS (VALUES {_CHECK_ROWS}), keyed AS (SELECT *, moment_id || '::' || system AS key FROM final),
long AS ({_LONG}), within AS (SELECT DISTINCT c.component, c.breach, r.* FROM rules r JOIN checks c ON list_contains(string_split(r.checks, ';'), c.chk)),
hits AS (SELECT DISTINCT l.key, w.rule, w.breach AS broken FROM long l JOIN within w USING (component) WHERE l.value < 1.0 AND (list_contains(w.types, 'all') OR list_contains(w.types, l.type))
  UNION SELECT k.key, r.rule, true FROM keyed k JOIN rules r ON r.rule IN {compliance.SEQUENCE_RULES} AND (list_contains(r.types, 'all') OR list_contains(r.types, k.type)) WHERE k.factor < 1.0),
reached AS (SELECT DISTINCT rule, number, route, types FROM within UNION SELECT rule, number, route, types FROM rules WHERE rule IN {compliance.SEQUENCE_RULES})
SELECT rule, number, route, (SELECT count(*) FROM keyed k WHERE list_contains(x.types, 'all') OR list_contains(x.types, k.type)) AS applies_to,
  (SELECT count(*) FROM hits h WHERE h.rule = x.rule AND broken) AS broken_by, (SELECT count(*) FROM hits h WHERE h.rule = x.rule AND NOT broken) AS below FROM reached x""")
def rule_diagnostic(spark, sf_dir):
    """A-05, J-19, J-20, D-17, K-07."""
    rows = _final(spark, sf_dir).withColumn("key", id_functions.description_id("moment_id", "system")).select("key", "type", "overall", "novelty_factor", *compliance.MECHANICAL)
    rows = written_once(rows, "scored")
    found = compliance.rule_diagnostic(rows, compliance.rule_table(spark), "key")
    return found.select("rule", "number", "route", "applies_to", "broken_by", "below")


@query(f"""WITH {MOMENTS}, {RULES_SQL}, checks(component, chk, breach) AS (VALUES {_CHECK_ROWS}) SELECT rule, number, category, route, (SELECT count(*) FROM moments m WHERE (list_contains(r.types, 'all') OR list_contains(r.types, m.type)) AND r.when_described) AS applies_to
FROM rules r WHERE rule NOT IN {compliance.SEQUENCE_RULES} AND NOT EXISTS (SELECT 1 FROM checks WHERE list_contains(string_split(r.checks, ';'), chk))""")
def rules_out_of_reach(spark, sf_dir):
    """A-05: the rules that the mechanical mode can't speak for, by name, and the moments that they apply to."""
    rules = compliance.rule_table(spark)
    applied = compliance.applicable_rules(moments(spark, sf_dir).withColumn("described", F.lit(True)), rules).select(F.explode("rules").alias("rule"))
    counts = applied.groupBy("rule").agg(F.count("*").alias("applies_to"))
    return compliance.unreached_rules(rules).join(F.broadcast(counts), "rule", "left").fillna(0, ["applies_to"])


@query(f"WITH {MOMENTS} SELECT count(DISTINCT moment_id) AS moments, count(DISTINCT lecture) AS lectures, round(count(DISTINCT moment_id) / count(DISTINCT lecture)::DOUBLE, 2) AS moments_per_lecture FROM moments")
def lecture_grouping(spark, sf_dir):
    """A-19, Q-06."""
    return integrity.grouping_stats(moments(spark, sf_dir), "moment_id", "lecture")


@query("""SELECT printf('o#%04d', o_orderkey) AS moment_id, 'cust-' || o_custkey AS lecture, coalesce(TRY_CAST(o_orderstatus AS DOUBLE), 0.0) AS t,
round(o_totalprice, 2) AS pause_after, o_orderpriority AS type, o_orderkey AS own FROM orders""")
def field_map(spark, sf_dir):
    """PRJ-01 to PRJ-03: orders as foreign rows."""
    o = table(spark, sf_dir, "orders")
    foreign = o.select(F.format_string("o#%04d", "o_orderkey").alias("key"), F.concat(F.lit("cust-"), "o_custkey").alias("course"), F.col("o_orderstatus").alias("begin"), F.round("o_totalprice", 2).alias("gap"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("own"))
    mapped = FieldMap.parse(["moment_id=key", "lecture=course", "time=begin", "pause_after=gap", "type=kind"]).canonical(foreign)
    return mapped.select("moment_id", "lecture", "t", "pause_after", "type", "own")


@query(f"WITH {MOMENTS} SELECT lecture, system, turn AS first_turn, type FROM (SELECT *, row_number() OVER (PARTITION BY lecture ORDER BY turn) AS n FROM moments) WHERE n = 1")
def first_context_row(spark, sf_dir):
    """W-16."""
    rows = moments(spark, sf_dir).select("lecture", "system", F.col("turn").alias("first_turn"), "type")
    return sequence.first_row_per(rows, "lecture", "first_turn").select("lecture", "system", "first_turn", "type")


@query("""SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)), 5) AS cosine
FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)""")
def cosine_similarity(spark, sf_dir):
    """M-02: against one vector, which is broadcast."""
    e = table(spark, sf_dir, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(scoring.cosine("embedding", "q"), 5).alias("cosine"))


@query("""WITH c AS (SELECT vec_id, (vec_id % 101) / 100.0::DOUBLE AS s FROM embeddings)
SELECT vec_id, round(CASE WHEN s <= 0.17 THEN 1.0 ELSE greatest((1 - s) / 0.83, 0.0) END, 6) AS credit, round((s - 0.7568846) / (1 - 0.7568846), 6) AS rescaled, round(2.5 * greatest(s, 0.0), 6) AS clip FROM c""")
def similarity_credit(spark, sf_dir):
    """S-29, S-30, M-03."""
    s = F.col("vec_id") % 101 / 100.0
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(scoring.credit_for_similarity(s), 6).alias("credit"), F.round(scoring.rescale(s), 6).alias("rescaled"), F.round(2.5 * F.greatest(s, F.lit(0.0)), 6).alias("clip"))


def _fits(r: int, words: int) -> str:
    length = f"({words} / 140.0 * 60.0)"
    return {1: f"{length} <= p", 2: f"{length} <= p AND {words} <= 15", 3: f"{length} <= p + 20.0", 4: f"{words} <= 5"}[r]


def _reachable(budget) -> str:
    return "CASE " + " ".join(f"WHEN {_fits(r, budget[r])} THEN {r}" for r in (1, 2, 3, 4)) + " ELSE 4 END"


@query(f"SELECT event_id, {_reachable(scoring.RUNG_WORDS)} AS own_budgets, {_reachable({r: 25 for r in (1, 2, 3, 4)})} AS uniform FROM (SELECT event_id, value - 5 AS p FROM events)")
def rung_reachable(spark, sf_dir):
    """S-34 to S-36."""
    p = F.col("value") - 5
    return table(spark, sf_dir, "events").select("event_id", scoring.reachable_rung(p, scoring.RUNG_WORDS).alias("own_budgets"), scoring.reachable_rung(p, 25).alias("uniform"))


@query("""WITH e AS (SELECT event_id, (event_id % 4 + 1)::INT AS rung, value AS pause, event_id % 3 = 0 AS uncovered FROM events),
w AS (SELECT *, floor(CASE rung WHEN 1 THEN pause / 60 * 140 WHEN 3 THEN (pause + 20) / 60 * 140 ELSE 0 END)::INT AS ceiling FROM e)
SELECT event_id, CASE WHEN uncovered AND rung IN (1, 3) AND ceiling >= 40 THEN 'XL' ELSE ['L', 'S', 'M', 'S'][rung] END AS band,
CASE WHEN uncovered AND rung IN (1, 3) AND ceiling >= 40 THEN 40 ELSE [23, 12, 16, 12][rung] END AS low,
CASE WHEN uncovered AND rung IN (1, 3) AND ceiling >= 40 THEN least(60, ceiling) ELSE [25, 15, 25, 15][rung] END AS high FROM w""")
def band_for(spark, sf_dir):
    """S-37."""
    coverage = F.when(F.col("event_id") % 3 == 0, "UNCOVERED").otherwise("covered")
    band = scoring.band_for(coverage, (F.col("event_id") % 4 + 1).cast("int"), F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", band.alias("b")).select("event_id", "b.band", "b.low", "b.high")


@query("""WITH e AS (SELECT event_id, value AS t, (event_id % 30)::DOUBLE AS apart FROM events), b AS (SELECT *, greatest(2.0, least(apart, 20.0)) AS back, CASE WHEN apart > 3 THEN 5 ELSE 3 END AS n_stills FROM e)
SELECT event_id, n_stills, round(greatest(0.0, t - back), 6) AS start, round(greatest(6.0, back + greatest(2.0, 0.45 * back), back * (n_stills - 1) / (n_stills - 2)), 6) AS span, back FROM b""")
def event_window_plan(spark, sf_dir):
    """S-38."""
    plan = scoring.event_window("value", (F.col("event_id") % 30).cast("double"))
    out = table(spark, sf_dir, "events").select("event_id", plan.alias("p")).select("event_id", "p.*")
    return out.withColumn("start", F.round("start", 6)).withColumn("span", F.round("span", 6))


_REPLIES = ["1", "**2**", "Tie.", "Between 1 and 2, I choose 2.", "Description 2.", "It is a tie between them.", "quantities", "", "I think the first option, 1, is better because of the many details it gives"]
_CHOICES = ["1", "2", "tie", None, "2", "tie", None, None, None]
_SCALES = ["4 out of 5", "3/5", "2 on a scale from 1 to 5", "3 or 4", "7", "", "Score: 5", "-3", "five"]
_RATINGS = [4, 3, 2, None, None, None, 5, None, None]


def _listed(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


@query(f"SELECT event_id, {_listed(_CHOICES)}[event_id % 9 + 1] AS choice, {_listed(_RATINGS)}[event_id % 9 + 1] AS rating FROM events")
def parse_replies(spark, sf_dir):
    """P-01, P-02."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", replies.parse_choice(pick(_REPLIES)).alias("choice"), replies.parse_scale(pick(_SCALES), 1, 5).alias("rating"))


@query("""SELECT event_id, (props->>'$.k')::INT AS k, CASE WHEN (props->>'$.k')::INT % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN (props->>'$.k')::INT % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM events""")
def parse_json_replies(spark, sf_dir):
    """P-03, P-04, P-05, P-11: JSON within fences and prose."""
    k = F.get_json_object("props", "$.k").cast("int")
    verdict = F.when(k % 2 == 0, "PASS").otherwise("FAIL")
    reply = F.concat(F.lit('```json\n{"verdict": "'), verdict, F.lit('"}\n```'))
    inside = replies.extract_json(F.concat(F.lit("Well {sic}: "), F.col("props"), F.lit(" [1]")))
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object(inside, "$.k").cast("int").alias("k"), replies.parse_verdict(reply).alias("verdict"))
    return rows.withColumn("side", replies.winner_of(F.when(F.col("verdict") == "PASS", "1").otherwise("2"), F.lit(0)))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'open_string' WHEN c_custkey % 2 = 0 THEN 'strict_object' ELSE 'balanced_object' END AS how, 'Text ' || c_custkey AS ad_text FROM customer""")
def salvage_replies(spark, sf_dir):
    """P-08."""
    whole = F.format_string('{"ad_text": "Text %d", "rung": 1}', "c_custkey")
    reply = F.when(F.col("c_custkey") % 5 == 0, F.format_string('{"ad_text": "Text %d', "c_custkey")).when(F.col("c_custkey") % 2 == 0, whole).otherwise(F.concat(F.lit("Here: "), whole, F.lit(" Done.")))
    return table(spark, sf_dir, "customer").select("c_custkey", replies.salvage(reply).alias("s")).select("c_custkey", "s.how", "s.ad_text")


@query()
def chrf_neighbours(spark, sf_dir):
    """S-32, S-33, A-33: character overlap of each benchmark item with the next, both ways."""
    b = table(spark, sf_dir, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    both = b.join(other, "item_id").withColumn("forward", overlap.chrf("text", "other")).withColumn("backward", overlap.chrf("other", "text"))
    return both.select("item_id", F.round("forward", 6).alias("forward"), F.round(scoring.distance_between("forward", "backward"), 6).alias("distance"))


_NAMED = f"list_filter({_terms('ad_text', 40)}, lambda x: length(x) >= 4 AND lower(x) NOT IN ({', '.join(repr(w) for w in sequence.STRUCTURAL)}))"
_SHOWN = f"list_transform({_terms('slide_ocr', 80)}, lambda x: lower(x))"


@query(f"""WITH {MOMENTS}, seq AS (SELECT *, row_number() OVER (PARTITION BY lecture, system ORDER BY t, moment_id) AS turn_no, {_NAMED} AS named, {_SHOWN} AS shown FROM moments),
kept AS (SELECT *, CASE WHEN turn % 4 = 3 THEN [] WHEN coalesce(slide_ocr, '') = '' THEN named ELSE list_filter(named, lambda x: list_contains(shown, lower(x))) END AS ts FROM seq),
said AS (SELECT lecture, system, turn_no, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM kept),
firsts AS (SELECT lecture, system, arg_min(term, (turn_no, pos)) AS term, min((turn_no, pos)) AS f FROM said GROUP BY lecture, system, lower(term)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lecture, system ORDER BY f) AS n FROM firsts),
per AS (SELECT s.moment_id, s.system, list(k.term ORDER BY k.n) FILTER (k.f[1] < s.turn_no) AS l, list(k.term ORDER BY k.n) FILTER (k.f[1] = s.turn_no) AS new, count(*) AS so_far
  FROM seq s JOIN numbered k ON k.lecture = s.lecture AND k.system = s.system AND k.f[1] <= s.turn_no GROUP BY ALL)
SELECT s.moment_id, s.system, CASE WHEN len(l) > 0 THEN array_to_string(list_slice(l, greatest(len(l) - 39, 1), len(l)), '; ') ELSE '{sequence.NOTHING_DESCRIBED}' END AS described,
  coalesce(array_to_string(new, ','), '') AS new_elements, coalesce(so_far, 0)::INT AS elements_so_far FROM seq s LEFT JOIN per USING (moment_id, system)""")
def described_so_far(spark, sf_dir):
    """W-09, W-10: the turn before is the slide, every fourth turn is passed over."""
    rows = moments(spark, sf_dir).withColumn("emit", F.col("turn") % 4 != 3)
    found = sequence.described_so_far(rows, "lecture", "system", ["t", "moment_id"], "ad_text", "slide_ocr", "emit")
    return found.select("moment_id", "system", sequence.described_text().alias("described"), F.array_join("new_elements", ",").alias("new_elements"), "elements_so_far")


@query()
def hold_out_lectures(spark, sf_dir):
    """K-05, V-17: whole sources are held out until they hold a fifth of the documents."""
    return sampling.hold_out(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 0.2, 13).groupBy("held").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
