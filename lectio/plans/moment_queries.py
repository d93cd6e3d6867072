"""Queries over what surrounds a model call: predicates, contexts, batches, answers, probes, the rule book."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectio.functions import scoring, statistics
from lectio.operators import compliance, moments, probes, sequence, standard
from lectio.plans.catalogue import query
from lectio.plans.relations import GAPS, MOMENTS, PAIRS, RATERS, TIMELINE, gaps, pairs, raters, table, timeline
from lectio.plans.relations import moments as moment_rows
from lectio.plans.text_queries import _FOLD, RULES_SQL, SCORED, _jaccard, _tokens, _words
from lectio.sources.shared import written_once

_TYPES = ", ".join(f"'{t}'" for t in scoring.MOMENT_TYPES)


@query(f"""WITH {MOMENTS}, p AS (SELECT lecture, bool_or(renders_cursor) AS draws FROM moments GROUP BY lecture)
SELECT lecture, array_to_string(list_filter([{_TYPES}], lambda t: coalesce(draws, false) OR t <> 'pointing'), ',') AS types FROM p""")
def allowed_types(spark, sf_dir):
    """PRJ-12, J-21: the labels of each lecture, by whether its facts say that a pointer is drawn."""
    rows = moment_rows(spark, sf_dir).select("lecture", "renders_cursor")
    facts = moments.with_facts(rows.select("lecture").distinct(), rows, key="lecture", fact="renders_cursor")
    offered = moments.allowed_types(F.array(*map(F.lit, scoring.MOMENT_TYPES)), F.coalesce("renders_cursor", F.lit(False)))
    return facts.select("lecture", F.array_join(offered, ",").alias("types"))


@query(f"""WITH {MOMENTS} SELECT moment_id, system, turn % 4 <> 3 AND transcript_window IS NOT NULL AS scorable,
len({_words('ad_text')}) BETWEEN 20 AND 60 AND turn % 6 IN (1, 2, 3, 4) AS usable,
array_to_string(list_filter(['style', 'terminology', 'length', 'deixis', 'faithfulness', 'non_redundancy'], lambda a: a <> 'deixis' OR type = 'pointing'), ',') AS axes FROM moments""")
def moment_predicates(spark, sf_dir):
    """PRJ-13, PRJ-14, PRJ-15."""
    m = moment_rows(spark, sf_dir)
    there = moments.scorable(F.col("turn") % 4 != 3, references=F.array_compact(F.array("transcript_window")))
    usable = moments.usable_candidate("ad_text", F.col("turn") % 6, F.lit(20), F.lit(60))
    return m.select("moment_id", "system", there.alias("scorable"), usable.alias("usable"), F.array_join(moments.axes_for("type"), ",").alias("axes"))


@query("SELECT o_orderkey, c_mktsegment AS segment, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey")
def strict_context(spark, sf_dir):
    """J-01: each order with its customer as context; an order without one would fail the query."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    contexts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    context_of = orders.join(contexts, "o_custkey").drop("o_custkey")
    return moments.with_context(orders.select("o_orderkey"), context_of, "o_orderkey").select("o_orderkey", "segment", "nation")


@query(f"""WITH {TIMELINE}, img AS (SELECT lecture, t::INT AS s, 'f' || min(event_id) FILTER (event_type = 'error') AS path FROM timeline GROUP BY ALL HAVING min(event_id) FILTER (event_type = 'error') IS NOT NULL)
SELECT event_id, path FROM (SELECT * FROM timeline WHERE event_type <> 'error') x LEFT JOIN img ON img.lecture = x.lecture AND img.s = x.t::INT""")
def image_at_frame(spark, sf_dir):
    """J-12: the first picture of the same second."""
    t = timeline(spark, sf_dir)
    images = t.where("event_type = 'error'").groupBy("lecture", "t").agg(F.concat(F.lit("f"), F.min("event_id")).alias("path")).withColumnRenamed("t", "time")
    frames = t.where("event_type <> 'error'").select("lecture", "event_id", F.col("t").alias("time"))
    return moments.image_at(frames, images, "lecture").select("event_id", "path")


@query("""WITH a AS (SELECT 'r' || (event_id % 45) AS rule, CASE event_id % 7 WHEN 0 THEN 'FAIL' WHEN 1 THEN NULL WHEN 2 THEN 'UNSURE' ELSE 'PASS' END AS answer FROM events)
SELECT rule, round(avg((answer = 'PASS')::INT), 6) AS share, count(*) AS n FROM a WHERE answer IN ('PASS', 'FAIL') GROUP BY rule""")
def kept_per_rule(spark, sf_dir):
    """A-15."""
    k = F.col("event_id") % 7
    answer = F.when(k == 0, "FAIL").when(k == 2, "UNSURE").when(k != 1, "PASS")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("r"), F.col("event_id") % 45).alias("rule"), answer.alias("answer"))
    return moments.kept_per_rule(rows).withColumn("share", F.round("share", 6))


@query("""WITH p AS (SELECT CASE WHEN length(text) % 11 = 0 THEN 'None' WHEN length(text) % 13 = 0 THEN ' ' ELSE text END AS ad_text, turn % 3 = 1 AS emit, CASE WHEN length(text) % 5 = 0 THEN 'open_string' WHEN turn % 2 = 0 THEN 'strict_object' ELSE 'balanced_object' END AS how FROM conversations),
h AS (SELECT how, count(*) AS n FROM p GROUP BY how)
SELECT count(*) AS moments, count(*) FILTER (trim(ad_text) NOT IN ('', 'None')) AS described, count(*) FILTER (trim(ad_text) IN ('', 'None')) AS empty, count(*) FILTER (emit) AS chose_to_describe,
(SELECT string_agg(how || '=' || n, ',' ORDER BY how) FROM h) AS read_by FROM p""")
def prediction_summary(spark, sf_dir):
    """A-18."""
    n = F.length("text")
    text = F.when(n % 11 == 0, "None").when(n % 13 == 0, " ").otherwise(F.col("text"))
    how = F.when(n % 5 == 0, "open_string").when(F.col("turn") % 2 == 0, "strict_object").otherwise("balanced_object")
    return moments.summarise_predictions(table(spark, sf_dir, "conversations").select(text.alias("ad_text"), (F.col("turn") % 3 == 1).alias("emit"), how.alias("how")))


_WANTED = """wanted AS (SELECT user_id AS lecture, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS b, event_id AS id FROM events),
got AS (SELECT lecture, b, id - CASE WHEN id % 37 = 0 THEN 1 ELSE 0 END AS id, CASE id % 5 WHEN 0 THEN 'slide' WHEN 1 THEN 'figure' WHEN 2 THEN 'poem' ELSE 'reject' END AS type FROM wanted WHERE id % 41 <> 0)"""


def _answered(spark, sf_dir):
    e = sequence.batches(table(spark, sf_dir, "events").select(F.col("user_id").alias("lecture"), F.col("event_id").alias("id")), "lecture", ["id"], 10)
    wanted = e.select(F.concat_ws("/", "lecture", "batch").alias("batch"), "id")
    label = F.when(F.col("id") % 5 == 0, "slide").when(F.col("id") % 5 == 1, "figure").when(F.col("id") % 5 == 2, "poem").otherwise("reject")
    got = wanted.where("id % 41 != 0").withColumn("type", label).withColumn("id", F.col("id") - F.when(F.col("id") % 37 == 0, 1).otherwise(0))
    return wanted, got


@query(f"""WITH {_WANTED}, a AS (SELECT lecture, b, count(*) AS n_asked FROM wanted GROUP BY ALL), g AS (SELECT lecture, b, count(*) AS n_got, count(DISTINCT id) AS n_ids FROM got GROUP BY ALL),
m AS (SELECT w.lecture, w.b, count(*) AS n_missing FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM got WHERE got.lecture = w.lecture AND got.b = w.b AND got.id = w.id) GROUP BY ALL)
SELECT lecture || '/' || b AS batch, n_asked, coalesce(n_got, 0) AS n_got, coalesce(n_missing, 0) AS n_missing,
CASE WHEN n_asked <> coalesce(n_got, 0) THEN 'count' WHEN n_ids < n_got THEN 'repeated' WHEN coalesce(n_missing, 0) > 0 THEN 'missing' END AS fault FROM a LEFT JOIN g USING (lecture, b) LEFT JOIN m USING (lecture, b)""")
def batch_faults(spark, sf_dir):
    """D-22: answers that are lost, or given for the id before."""
    return moments.batch_faults(*_answered(spark, sf_dir))


_OFFER = "Choose one.\nTYPES - use exactly one:\n  slide    the slide itself\n  figure   a figure\n  chart    a chart\n  table    a table\n  reject   none of these\n poem    one blank only\n\n  song    after the list"
_FEW = "TYPES\n  slide   a slide\n  figure  a figure\n"


@query(f"""WITH {_WANTED} SELECT lecture || '/' || b AS batch, CASE WHEN lecture % 10 = 3 THEN 'few' ELSE 'outside' END AS fault, CASE WHEN lecture % 10 = 3 THEN '' ELSE string_agg(DISTINCT type, ',' ORDER BY type) FILTER (type = 'poem') END AS labels
FROM got GROUP BY lecture, b HAVING lecture % 10 = 3 OR count(*) FILTER (type = 'poem') > 0""")
def vocabulary_faults(spark, sf_dir):
    """D-22, V-10: labels that the prompt, read back, doesn't offer; every tenth lecture's prompt offers too few."""
    got = _answered(spark, sf_dir)[1]
    few = F.substring_index("batch", "/", 1).cast("long") % 10 == 3
    return moments.vocabulary_faults(got, moments.offered_types(F.when(few, _FEW).otherwise(_OFFER)))


@query("""SELECT 'e' || event_id AS id, user_id::VARCHAR AS lecture, CASE WHEN event_id % 3 = 0 THEN value ELSE ((event_id * 7) % 3600)::DOUBLE END AS t,
CASE event_id % 5 WHEN 0 THEN 'slide' WHEN 1 THEN 'figure' WHEN 2 THEN 'other' ELSE 'chart' END AS type, event_type AS what_on_screen FROM events WHERE event_id % 5 <> 4""")
def answers_to_moments(spark, sf_dir):
    """D-23: the stated minutes and seconds where they can be read, else the candidate's time."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id").alias("id"), "event_id", "user_id", "value", "event_type")
    s = (F.col("event_id") * 7) % 3600
    stated = F.when(F.col("event_id") % 3 == 0, "soon").otherwise(F.format_string("%02d:%02d", F.floor(s / 60), s % 60))
    k = F.col("event_id") % 5
    label = F.when(k == 0, "slide").when(k == 1, "figure").when(k == 2, "other").when(k == 3, "chart").otherwise("reject")
    answers = e.select("id", label.alias("type"), stated.alias("stated"), F.concat(F.lit(" "), "event_type").alias("what_on_screen"))
    return moments.to_moments(answers, e.select("id", F.col("user_id").cast("string").alias("lecture"), F.col("value").alias("t")))


@query(f"""WITH {MOMENTS} SELECT moment_id, system, array_to_string(list_filter([CASE WHEN turn % 6 = 5 THEN 'missing rung' END,
  CASE WHEN turn % 3 = 1 AND length(quote) > 0 AND NOT contains({_FOLD.format(c='ad_text')}, {_FOLD.format(c='quote')}) THEN 'quote is no span of ad_text' END,
  CASE WHEN turn % 7 = 6 THEN 'coverage outside its set: MAYBE' END], lambda x: x IS NOT NULL), ',') AS faults
FROM (SELECT *, CASE WHEN turn % 3 = 1 THEN coalesce(substr(slide_ocr, 1, 30), '') ELSE '' END AS quote FROM moments) WHERE faults <> ''""")
def contract_faults(spark, sf_dir):
    """D-24: replies that quote the slide where the text is asked for, lack a field, or leave a closed set."""
    m = moment_rows(spark, sf_dir).withColumn("key", F.struct("moment_id", "system"))
    quote = F.when(F.col("turn") % 3 == 1, F.coalesce(F.substring("slide_ocr", 1, 30), F.lit(""))).otherwise("")
    coverage = F.when(F.col("turn") % 7 == 6, "MAYBE").otherwise("COVERED")
    fields = F.create_map(F.lit("coverage"), coverage, F.lit("quote"), quote)
    reply = F.when(F.col("turn") % 6 == 5, fields).otherwise(F.map_concat(fields, F.create_map(F.lit("rung"), F.lit("1"))))
    found = moments.output_faults(m.withColumn("reply", reply), "key", "reply", ("coverage", "rung"), {"quote": "ad_text"}, {"coverage": moments.COVERAGE})
    return found.select("key.*", F.array_join("faults", ",").alias("faults"))


_AT = "v AS (SELECT lecture, event_id, t FROM timeline WHERE event_type = 'view')"


@query(f"""WITH {TIMELINE}, {GAPS}, {_AT}, said AS (SELECT lecture, t AS start, 'w' || event_id AS text FROM timeline WHERE event_type = 'click'),
shown AS (SELECT lecture, t AS time, 's' || event_id AS text FROM timeline WHERE event_type = 'signup'),
w AS (SELECT v.event_id, coalesce(string_agg(s.text, ' ' ORDER BY s.start, s.text), '') AS transcript_window FROM v LEFT JOIN said s ON s.lecture = v.lecture AND s.start >= v.t - 600 AND s.start < v.t + 900 GROUP BY v.event_id),
n AS (SELECT v.event_id, CASE WHEN abs(arg_min(s.time, (abs(s.time - v.t), s.time)) - v.t) <= 20000 THEN round(arg_min(s.time, (abs(s.time - v.t), s.time))) END AS slide_at FROM v JOIN shown s USING (lecture) GROUP BY v.event_id, v.t),
p AS (SELECT v.event_id, round(coalesce(max(g."end" - g.start), 0.0), 2) AS pause_after FROM v LEFT JOIN gaps g ON g.lecture = v.lecture AND g.start >= v.t - 0.5 AND g.start <= v.t + 600 GROUP BY v.event_id)
SELECT v.event_id, transcript_window, slide_at, round(pause_after, 1) AS pause_after FROM v JOIN w USING (event_id) LEFT JOIN n USING (event_id) JOIN p USING (event_id)""")
def writer_contexts(spark, sf_dir):
    """D-25: the words said around each view, the nearest slide, and the longest pause after."""
    t = timeline(spark, sf_dir)
    views = t.where("event_type = 'view'").select("lecture", F.col("event_id").alias("moment_id"), "t")
    words = t.where("event_type = 'click'").select("lecture", F.col("t").alias("start"), F.concat(F.lit("w"), "event_id").alias("text"))
    slides = t.where("event_type = 'signup'").select("lecture", F.col("t").alias("time"), F.col("t").cast("long").cast("string").alias("text"))
    found = moments.writer_contexts(views, words, slides, gaps(spark, sf_dir), "lecture", 600.0, 900.0, 20000.0, 600.0)
    return found.select(F.col("moment_id").alias("event_id"), "transcript_window", F.nullif(F.col("slide_ocr"), F.lit("")).cast("double").alias("slide_at"), F.round("pause_after", 1).alias("pause_after"))


@query(f"""WITH {MOMENTS} SELECT moment_id || '::' || system AS output_id, CASE WHEN turn % 5 <> 4 AND turn % 7 <> 6 THEN ['COVERED', 'PARTIAL', 'UNCOVERED'][turn % 3 + 1] END AS coverage,
CASE WHEN turn % 5 <> 4 AND turn % 7 <> 6 THEN turn % 2 = 0 END AS emit, CASE WHEN turn % 5 <> 4 AND turn % 7 <> 6 THEN turn % 4 + 1 END AS rung, CASE WHEN turn % 5 <> 4 AND turn % 7 <> 6 THEN type END AS type,
CASE WHEN turn % 5 = 4 THEN 'timeout' WHEN turn % 7 = 6 THEN 'unparsed' END AS error FROM moments""")
def reference_answers(spark, sf_dir):
    """P-10, D-26: a writer's replies as rows with their context, or as errors."""
    m = moment_rows(spark, sf_dir)
    coverage = F.element_at(F.array(*map(F.lit, ("COVERED", "PARTIAL", "UNCOVERED"))), (F.col("turn") % 3 + 1).cast("int"))
    body = F.format_string('Sure: {"coverage": "%s", "emit": %s, "rung": %d, "ad_text": "x"}', coverage, (F.col("turn") % 2 == 0).cast("string"), F.col("turn") % 4 + 1)
    reply = F.when(F.col("turn") % 7 == 6, '{"coverage": "MAYBE"}').otherwise(body)
    answers = m.select("moment_id", F.col("system").alias("writer"), moments.parse_reference(reply).alias("decision"), F.when(F.col("turn") % 5 == 4, "timeout").alias("error"), reply.alias("raw"))
    rows = moments.reference_rows(answers, m.drop("ad_text", "system"), "fixed")
    return rows.select("output_id", "coverage", "emit", "rung", "type", "error")


@query(f"""WITH {MOMENTS} SELECT moment_id, system, 'Moment type: ' || type || chr(10) || 'Lecturer said (+/-8s): ' || trim(coalesce(transcript_window, '')) || chr(10) || 'On-screen text (OCR): ' || trim(coalesce(slide_ocr, '')) || chr(10)
|| CASE WHEN turn % 2 = 0 THEN 'What is on screen: ' || trim(coalesce(what_on_screen, '')) || chr(10) ELSE '' END || 'Pause available after the moment: ' || pause_after || 's' AS package FROM moments""")
def package_text(spark, sf_dir):
    """S-40: both arms."""
    args = (F.col("type"), "transcript_window", "slide_ocr", "what_on_screen", "pause_after")
    text = F.when(F.col("turn") % 2 == 0, moments.package_text(*args, True)).otherwise(moments.package_text(*args, False))
    return moment_rows(spark, sf_dir).select("moment_id", "system", text.alias("package"))


_CELLS = "[(event_id * 3) % 256, (event_id // 4) % 256, (event_id * event_id) % 256, (event_id * 97) % 256]"
_DELTAS = f"""{TIMELINE}, shown AS (SELECT lecture, event_id, t, {_CELLS} AS c, lag({_CELLS}) OVER (PARTITION BY lecture ORDER BY event_id) AS b FROM timeline),
deltas AS (SELECT lecture, event_id, k - 1 AS cell, abs(c[k] - b[k])::DOUBLE AS delta FROM shown, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE b IS NOT NULL),
masked AS (SELECT lecture, cell FROM deltas GROUP BY ALL HAVING avg((delta > 25)::INT) >= 0.6)"""


def _deltas(spark, sf_dir):
    """Events as pictures of 32 by 32 pixels: four cells of one grey value each."""
    e = F.col("event_id")
    greys = [F.lpad(F.hex(v % 256), 2, "0") for v in (e * 3, F.floor(e / 4).cast("long"), e * e, e * 97)]
    line = lambda a, b: F.repeat(F.concat(F.repeat(a, 16), F.repeat(b, 16)), 16)
    frames = timeline(spark, sf_dir).select("lecture", "event_id", F.unhex(F.concat(line(*greys[:2]), line(*greys[2:]))).alias("picture"))
    return probes.frame_deltas(frames, "lecture", "event_id", "picture", 32)


@query(f"WITH {_DELTAS} SELECT lecture, cell::INT AS cell FROM masked")
def layout_cells(spark, sf_dir):
    """W-18, M-05."""
    return probes.layout_cells(_deltas(spark, sf_dir), "lecture")


@query(f"""WITH {_DELTAS}, seen AS (SELECT d.lecture, d.event_id, d.cell, CASE WHEN m.cell IS NULL THEN delta ELSE 0 END AS delta FROM deltas d LEFT JOIN masked m ON m.lecture = d.lecture AND m.cell = d.cell),
per AS (SELECT lecture, event_id, count(*) FILTER (delta > 25) AS hot, max(delta) AS peak, arg_max(cell, (delta, -cell)) AS top FROM seen GROUP BY ALL)
SELECT lecture, max(hot) AS hot_cells, round(max(peak), 4) AS peak_delta, count(*) AS pairs, CASE WHEN max(hot) > 0 THEN arg_max(top, (hot, -event_id)) END AS at_cell FROM per GROUP BY lecture""")
def probe_frames(spark, sf_dir):
    """W-17, M-05: a lecture's frames as one probe, its layout masked."""
    deltas = _deltas(spark, sf_dir)
    found = probes.probe(deltas, probes.layout_cells(deltas, "lecture"), "lecture", ["lecture"], "event_id")
    return found.select("lecture", "hot_cells", F.round("peak_delta", 4).alias("peak_delta"), "pairs", F.col("at_cell").cast("long").alias("at_cell"))


_LOCAL = f"""{SCORED}, sides AS (SELECT *, {_tokens('ad_text')} AS own, {_tokens('premise')} AS seen, {_tokens('transcript_window')} AS said FROM scored),
credit AS (SELECT *, CASE WHEN premise = '' THEN 1.0 ELSE 1 - (list_contains(own, 'not') AND NOT list_contains(seen, 'not'))::INT END AS faithfulness,
  CASE WHEN trim(coalesce(transcript_window, '')) = '' THEN 1.0 WHEN {_jaccard('own', 'said')} <= 0.17 THEN 1.0 ELSE greatest((1 - {_jaccard('own', 'said')}) / 0.83, 0.0) END AS fresh FROM sides)"""


@query(f"WITH {_LOCAL} SELECT moment_id, system, faithfulness::DOUBLE AS faithfulness, round(fresh, 6) AS non_redundancy, round((style + terminology + length + coalesce(deixis, 0) + faithfulness + fresh) / (5 + (deixis IS NOT NULL)::INT), 6) AS overall FROM credit")
def compliance_local(spark, sf_dir):
    """D-14, D-15, D-16: all six components, with the stand-in models that need no weights."""
    scored = compliance.score_local(compliance.score(moment_rows(spark, sf_dir)), compliance.stand_in_contradiction, compliance.stand_in_similarity)
    return scored.select("moment_id", "system", "faithfulness", F.round("non_redundancy", 6).alias("non_redundancy"), F.round("overall", 6).alias("overall"))


_RULED = f"""{RULES_SQL}, chk(component, chk, breach) AS (VALUES {', '.join(f"('{k}', '{c}', {compliance.BREACH[compliance.LOCAL[k]]})" for k in compliance.LOCAL for c in compliance.CHECKS[compliance.LOCAL[k]])}),
ruled AS (SELECT DISTINCT c.component, c.breach, r.rule, r.number, r.types FROM rules r JOIN chk c ON list_contains(string_split(r.checks, ';'), c.chk) WHERE r.when_described),
asked AS (SELECT *, turn % 7 = 6 AS lost, CASE WHEN turn % 5 = 4 THEN ' None ' ELSE ad_text END AS said FROM moments WHERE system = 'user')"""
_LONG6 = " UNION ALL ".join(f"SELECT moment_id, type, {k} AS place, '{c}' AS component, {c} AS value FROM six" for k, c in enumerate(scoring.CATEGORIES))


@query(f"""WITH {_LOCAL}, {_RULED}, six AS (SELECT c.moment_id, c.type, style, terminology, length, deixis, faithfulness, fresh AS non_redundancy FROM credit c JOIN asked a USING (moment_id, system) WHERE NOT lost AND a.turn % 5 <> 4),
long AS ({_LONG6}), low AS (SELECT DISTINCT ON (l.moment_id, w.rule, w.breach) l.moment_id, w.rule, w.breach, l.place, w.number FROM long l JOIN ruled w USING (component) WHERE l.value < 1.0 AND (list_contains(w.types, 'all') OR list_contains(w.types, l.type)) ORDER BY l.place),
lists AS (SELECT moment_id, string_agg(rule, ',' ORDER BY place, number, rule) FILTER (breach) AS broken, string_agg(rule, ',' ORDER BY place, number, rule) FILTER (NOT breach) AS short FROM low GROUP BY moment_id)
SELECT a.moment_id, CASE WHEN lost THEN 'missing' WHEN a.turn % 5 = 4 THEN 'unfilled' END AS reason, CASE WHEN s.moment_id IS NULL THEN '{','.join(scoring.CATEGORIES)}' WHEN s.deixis IS NULL THEN 'deixis' ELSE '' END AS abstained,
coalesce(l.broken, '') AS broken, coalesce(l.short, '') AS short FROM asked a LEFT JOIN six s USING (moment_id) LEFT JOIN lists l USING (moment_id)""")
def scored_rows(spark, sf_dir):
    """D-09, D-17, D-18, J-02, D-16: the user's turns as one system in local mode: some lost, some unfilled; each row with what it abstained on, broke and fell short of."""
    m = moment_rows(spark, sf_dir).where("system = 'user'")
    predictions = m.where("turn % 7 != 6").select("moment_id", F.when(F.col("turn") % 5 == 4, " None ").otherwise(F.col("ad_text")).alias("ad_text"))
    found = compliance.score_predictions(predictions, m.drop("ad_text"), compliance.rule_table(spark), "moment_id", "lecture", ["t", "moment_id"], (compliance.stand_in_contradiction, compliance.stand_in_similarity), knee=None)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("moment_id", "reason", joined("abstained"), joined("broken"), joined("short"))


@query(f"""WITH {_LOCAL}, {_RULED}, six AS (SELECT moment_id || '::' || system AS moment_id, type, style, terminology, length, deixis, faithfulness, fresh AS non_redundancy FROM credit),
long AS ({_LONG6}), hits AS (SELECT DISTINCT l.moment_id, w.rule, w.breach FROM long l JOIN ruled w USING (component) WHERE l.value < 1.0 AND (list_contains(w.types, 'all') OR list_contains(w.types, l.type)))
SELECT rule, (SELECT count(*) FROM six k WHERE list_contains(x.types, 'all') OR list_contains(x.types, k.type)) AS applies_to,
  (SELECT count(*) FROM hits h WHERE h.rule = x.rule AND breach) AS broken_by, (SELECT count(*) FROM hits h WHERE h.rule = x.rule AND NOT breach) AS below FROM (SELECT DISTINCT rule, types FROM ruled) x""")
def local_diagnostic(spark, sf_dir):
    """A-05 in local mode, which reaches seven rules more."""
    scored = compliance.score_local(compliance.score(moment_rows(spark, sf_dir)), compliance.stand_in_contradiction, compliance.stand_in_similarity)
    keyed = scored.withColumn("key", F.concat_ws("::", "moment_id", "system")).withColumn("novelty_factor", F.lit(1.0))
    rows = written_once(keyed.select("key", "type", "overall", "novelty_factor", *compliance.LOCAL), "scored")
    found = compliance.rule_diagnostic(rows, compliance.rule_table(spark), "key", parts=compliance.LOCAL)
    return found.where(~F.col("rule").isin(*compliance.SEQUENCE_RULES)).select("rule", "applies_to", "broken_by", "below")


@query(f"""WITH {PAIRS}, {RATERS}, v AS (SELECT pair_id, side, count(*) AS weight FROM raters WHERE side <> 'tie' GROUP BY ALL)
SELECT pair_id, source AS "group", (side = 'a')::INT::DOUBLE AS chose_a, weight::DOUBLE AS weight, (a_chars - b_chars)::DOUBLE AS chars, (a_parts - b_parts)::DOUBLE AS parts FROM v JOIN pairs USING (pair_id)""")
def head_training_rows(spark, sf_dir):
    """T-21, T-22, V-02: one row per side chosen, weighted by the raters who chose it."""
    return statistics.head_rows(_featured(spark, sf_dir), raters(spark, sf_dir), ["chars", "parts"])


def _featured(spark, sf_dir):
    both = lambda s: F.create_map(F.lit("chars"), F.col(f"{s}_chars").cast("double"), F.lit("parts"), F.col(f"{s}_parts").cast("double"))
    return pairs(spark, sf_dir).select("pair_id", F.col("source").alias("group"), both("a").alias("a"), both("b").alias("b"))


@query()
def frozen_head(spark, sf_dir):
    """T-15, T-16, T-19: weights fitted without a rater, then scored on that rater once."""
    scaled = _featured(spark, sf_dir)
    small = lambda c: F.transform_values(c, lambda k, v: v / 1000)
    featured = scaled.withColumn("a", small("a")).withColumn("b", small("b"))
    weights = statistics.freeze(featured, raters(spark, sf_dir), ["chars", "parts"], "R3")
    found = statistics.score_frozen(weights, featured, raters(spark, sf_dir).where("rater = 'R3'"), ["chars", "parts"])
    return found.select("agreed", "disagreed", *(F.round(c, 6).alias(c) for c in ("agreement", "low", "high")))


_BOOK = [{"id": r[0], "tag": "DOC" if r[1] % 2 else "PROV", "route": r[6], "text": f"As {r[0]} says." if r[1] % 3 else "See figure_001 to 004.", "reviewed": r[1] % 5 == 0} for r in compliance.RULES]
_BOOK_ROWS = ", ".join(f"('{b['id']}', '{b['tag']}', '{b['route']}', {b['reviewed']})" for b in _BOOK)


@query(f"""WITH {MOMENTS}, {RULES_SQL}, b(rule, tag, route, reviewed) AS (VALUES {_BOOK_ROWS}), n AS (SELECT b.route, count(*) AS rows_it_applies_to FROM moments m JOIN rules r ON (list_contains(r.types, 'all') OR list_contains(r.types, m.type)) AND r.when_described JOIN b USING (rule) GROUP BY b.route)
SELECT route, count(*) AS rules, count(*) FILTER (reviewed) AS reviewed, coalesce(max(rows_it_applies_to), 0) AS rows_it_applies_to, 0::BIGINT AS faults FROM b LEFT JOIN n USING (route) GROUP BY route""")
def standard_summary(spark, sf_dir):
    """SRC-20, A-32, Q-09, Q-10, V-16: the book of all rules by route, the moments that its rules apply to, and its faults against the table."""
    rules, book = compliance.rule_table(spark), standard.rule_book(spark, _BOOK)
    applied = compliance.applicable_rules(moment_rows(spark, sf_dir).withColumn("described", F.lit(True)), rules).select(F.explode("rules").alias("rule"))
    per = applied.groupBy("rule").agg(F.count("*").alias("n")).join(F.broadcast(book.select("rule", "route")), "rule").groupBy("route").agg(F.sum("n").alias("rows_it_applies_to"))
    by_route = book.groupBy("route").agg(F.count("*").alias("rules"), F.count_if("reviewed").alias("reviewed"))
    faults = standard.summary(rules, book).select("faults")
    return by_route.join(per, "route", "left").fillna(0, ["rows_it_applies_to"]).join(F.broadcast(faults))


@query("""WITH b AS (SELECT printf('figure_%03d', doc_id % 900) AS rule, CASE doc_id % 7 WHEN 0 THEN 'OLD' WHEN 1 THEN 'PROV' ELSE 'DOC' END AS tag, CASE WHEN doc_id % 5 = 0 THEN 'vote' ELSE 'judge' END AS route, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE lang || ' as ' || cited || ' says' END AS body, cited, doc_id
  FROM (SELECT *, printf('figure_%03d', (doc_id * 7) % 999) AS cited FROM documents))
SELECT rule, 'defined more than once' AS fault FROM b GROUP BY rule HAVING count(*) > 1 UNION ALL SELECT rule, 'unknown tag' FROM b WHERE tag = 'OLD' UNION ALL SELECT rule, 'unknown route' FROM b WHERE route = 'vote'
UNION ALL SELECT rule, 'no text' FROM b WHERE trim(coalesce(body, '')) = '' UNION ALL SELECT rule, 'cites ' || cited FROM b WHERE trim(coalesce(body, '')) <> '' AND cited NOT IN (SELECT rule FROM b)""")
def book_faults(spark, sf_dir):
    """Q-10: documents as the entries of a book, with faults of each kind."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 7
    tag = F.when(k == 0, "OLD").when(k == 1, "PROV").otherwise("DOC")
    body = F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.concat("lang", F.lit(" as "), F.format_string("figure_%03d", F.col("doc_id") * 7 % 999), F.lit(" says")))
    return standard.book_faults(d.select(F.format_string("figure_%03d", F.col("doc_id") % 900).alias("rule"), tag.alias("tag"), F.when(F.col("doc_id") % 5 == 0, "vote").otherwise("judge").alias("route"), body.alias("text")))


@query(f"WITH {MOMENTS} SELECT moment_id, system, array_to_string(list_distinct_in_order, ',') AS rules FROM (SELECT moment_id, system, CASE WHEN turn % 2 = 0 THEN ['slide_text_003', 'cross_cutting_006'] ELSE ['length_004', 'cross_cutting_006', 'slide_text_003'] END AS list_distinct_in_order FROM moments)")
def rules_in_order(spark, sf_dir):
    """U-05: rules broken by components, then those of the sequence, each once."""
    broken = F.when(F.col("turn") % 2 == 0, F.array(F.lit("slide_text_003"))).otherwise(F.array(F.lit("length_004")))
    again = F.when(F.col("turn") % 2 == 0, F.array(F.lit("cross_cutting_006"), F.lit("slide_text_003"))).otherwise(F.array(F.lit("cross_cutting_006"), F.lit("slide_text_003")))
    return moment_rows(spark, sf_dir).select("moment_id", "system", F.array_join(moments.rules_in_order(broken, again), ",").alias("rules"))


@query("""SELECT (row_number() OVER (ORDER BY a, b, c) - 1)::INT AS cell, a AS arm, b AS method, c::VARCHAR AS seed, (SELECT count(*) FROM conversations WHERE conv_id % 3 = c - 1) AS n_rows
FROM (SELECT unnest(['multimodal', 'text_only']) AS a), (SELECT unnest(['dpo', 'sft']) AS b), (SELECT unnest([1, 2, 3]) AS c)""")
def training_grid(spark, sf_dir):
    """D-28: the cells of a grid of settings, with the rows that each seed's third of the conversations trains on."""
    cells = moments.grid(spark, {"arm": ["multimodal", "text_only"], "method": ["dpo", "sft"], "seed": [1, 2, 3]})
    rows = table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 3 + 1).cast("string").alias("seed")).agg(F.count("*").alias("n_rows"))
    return cells.join(F.broadcast(rows), "seed", "left").fillna(0, ["n_rows"])


@query(f"""WITH {MOMENTS} SELECT system, count(*) AS n FROM moments WHERE moment_id IN (SELECT moment_id FROM moments WHERE system = 'user' AND len({_words('ad_text')}) > 30) GROUP BY system""")
def own_moments(spark, sf_dir):
    """PRJ-18: the moments that one writer described at length."""
    m = moment_rows(spark, sf_dir)
    wrote = m.where("system = 'user'").where(F.size(F.filter(F.split(F.trim("ad_text"), r"\s+"), lambda w: w != "")) > 30)
    return moments.own_moments(m, wrote.select("moment_id").distinct()).groupBy("system").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS w FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT count(*) AS rows, count(DISTINCT o_custkey) AS moments, (SELECT count(DISTINCT o_custkey) FROM orders) - count(DISTINCT o_custkey) AS left_out FROM orders JOIN d USING (o_custkey) WHERE w >= 2 AND o_orderpriority IN ('1-URGENT', '2-HIGH')
AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 2)""")
def complete_only(spark, sf_dir):
    """A-24: the rows of customers with an answer of both writers, and how many are left out."""
    o = table(spark, sf_dir, "orders").withColumn("error", F.when(F.col("o_orderstatus") == "F", "failed"))
    kept, left_out = moments.complete_only(o, "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH"])
    own = kept.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return own.agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("moments")).join(F.broadcast(left_out.agg(F.count("*").alias("left_out"))))

